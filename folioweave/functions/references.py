"""Comparing a translation with a reference, and finding source script left in it; plain functions over texts."""

from __future__ import annotations

import difflib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

from .matching import Index, ratio

BLANKS = re.compile(r"[\s　]+")
PLACEHOLDER = re.compile(r"\[\[P\d+\]\]")
# Marks that count as one in comparisons, runs of decoration and what they become, ends of sentences.
SAME_MARKS = (("…", "..."), ("‥", "..."), ("——", "-"), ("―", "-"), ("〜", "~"), ("～", "~"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("（", "("), ("）", ")"))
DECORATION = (("[-–—―─]{2,}", "-"), ("[=＝]{2,}", "="), ("[_＿]{2,}", "_"), ("[*＊]{2,}", "*"), ("[・‧]{2,}", "・"), ("[….．]{2,}", "..."))
SENTENCE_ENDS = "。！？!?\n"
# Brackets by direction, quotes without one, brackets of a note, ends before which a note must come.
OPENING, CLOSING, QUOTES = "（「『《〈＜“‘(｢", "）」』》〉＞”’)｣", "\"'"
NOTE, NOTE_STOPS, NOTE_SKIPS = "（(《〈＜", "。！？：；\n\r", " 　、，"
HIRAGANA = re.compile("[ぁ-ゖゝ-ゟ]+")
PHRASE = re.compile("[぀-ヿ一-鿿！-～　・ー―‐…A-Za-z0-9!?~\\-'&*+=<>.]")


def plain(text: str | None) -> str:
    """Without placeholders and white space."""
    return BLANKS.sub("", PLACEHOLDER.sub("", text or ""))


def canonical(text: str | None) -> str:
    """A form for comparing: NFKC, marks of one kind alike, decoration short, no placeholders and white space."""
    out = unicodedata.normalize("NFKC", PLACEHOLDER.sub("", text or ""))
    for a, b in SAME_MARKS:
        out = out.replace(a, b)
    for pattern, mark in DECORATION:
        out = re.sub(pattern, mark, out)
    return BLANKS.sub("", out)


def blank_like(line: str) -> bool:
    """Empty, or decoration only."""
    return not line.strip() or bool(re.fullmatch("[-=_*・….]+", canonical(line)))


@lru_cache(maxsize=2)  # a page's segments come together
def _indexed(text: str) -> Index:
    return Index(text)


@lru_cache(maxsize=2)
def _whole(reference: str) -> str:
    return canonical(reference)


def to_sentence(text: str, start: int, end: int, reach: int = 15) -> str:
    """text[start:end], widened to the sentence ends at most ``reach`` characters off on each side."""
    left = max((text.rfind(c, max(0, start - reach), start) for c in SENTENCE_ENDS), default=-1)
    ends = [p for c in SENTENCE_ENDS if (p := text.find(c, end, end + reach)) >= 0]
    return text[left + 1 if left >= 0 else start : min(ends) + 1 if ends else end]


def locate(reference: str, said: str) -> tuple[str, float]:
    """The fragment of the reference most like what is said, and how like: the same is 1; else windows of its length round
    the longest common block, the best of them widened to its sentence."""
    if not said:
        return "", 0.0
    if said in reference:
        return said, 1.0
    n, (a, b, _) = len(said), _indexed(reference).longest(said)
    last = max(0, len(reference) - n)
    best, at = 0.0, 0
    for start in dict.fromkeys(max(0, min(b - a + off, last)) for off in range(-8, 9)):
        score = ratio(said, reference[start : start + n])
        if score > best:
            best, at = score, start
    return to_sentence(reference, at, at + n), best


def difference(reference: str, said: str) -> str:
    """What the reference has besides [-so-] and what is said besides [+so+]."""
    a, b = plain(reference), plain(said)
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        out.append(a[i:j] if kind == "equal" else f"[-{a[i:j]}-]" * (j > i) + f"[+{b[k:m]}+]" * (m > k))
    return "".join(out)


def without_corrections(reference: str, said: str, corrections: list[dict]) -> tuple[str, int]:
    """The canonical form of what is said with its active corrections taken back (where both sides fit), and how many were."""
    out, n = canonical(said), 0
    for c in corrections or ():
        wrong, right = canonical(c["ref_err"]), canonical(c["corrected"])
        if c.get("status") in (None, "active") and wrong and right and right in out and wrong in reference:
            out, n = out.replace(right, wrong, 1), n + 1
    return out, n


def check(reference: str | None, said: str | None, source: str | None, corrections: list[dict] | None = None, threshold: float = 0.97, least: int = 4) -> dict | None:
    """score, fragment, diff, corrections_applied, covered of a translation that falls short of its reference; None if it
    doesn't, or there is nothing to compare."""
    if not reference or not (said or "").strip() or len(plain(source)) < least:
        return None
    whole = _whole(reference)
    form, applied = without_corrections(whole, said, corrections or [])
    fragment, score = locate(whole, form)
    if score >= threshold:
        return None
    covered = _indexed(whole).longest(form)[2] if form else 0
    return {"score": round(score, 4), "fragment": fragment, "diff": difference(fragment, form), "corrections_applied": applied, "covered": covered >= max(4, len(form) // 3)}


def uncovered_tail(reference: str | None, translations: list[str | None], least: int = 4) -> str:
    """The last lines of a reference that no translation covers by a common block of ``least`` characters."""
    lines = (reference or "").split("\n")
    forms = [canonical(line) for line in lines]
    whole, ends = "".join(forms), []
    for form in forms:
        ends.append((ends[-1] if ends else 0) + len(form))
    starts = [end - len(form) for end, form in zip(ends, forms, strict=True)]
    covered: set[int] = set()
    index = Index(whole)
    for form in {canonical(said) for said in translations}:
        for at, size in index.blocks(form, least):
            covered.update(n for n in range(bisect_right(ends, at), bisect_left(starts, at + size)) if forms[n])
    at = len(lines)
    while at and (blank_like(lines[at - 1]) or at - 1 not in covered):
        at -= 1
    return "\n".join(lines[at:]).strip() if whole else ""


def depths(text: str) -> list[int]:
    """How deep in brackets and quotes each character stands; a quote without direction opens and closes in turn."""
    out, depth, quoted = [], 0, 0
    for c in text:
        if c in QUOTES:
            quoted = 1 - quoted
        elif c in OPENING:
            depth += 1
        out.append(depth if c in OPENING or c in CLOSING else depth + quoted)
        if c in CLOSING:
            depth = max(0, depth - 1)
    return out


def note_follows(text: str, end: int) -> bool:
    """Whether, behind more of the same phrase only, a note in brackets follows."""
    for at in range(end, len(text)):
        c = text[at]
        if c in NOTE:
            return True
        if c in NOTE_STOPS or c in OPENING or c in CLOSING or c in QUOTES or text.startswith("[[P", at):
            return False
        if c not in NOTE_SKIPS and not PHRASE.match(c):
            return False
    return False


def residual(source: str | None, said: str | None, pad: int = 24) -> list[dict]:
    """token, start, excerpt of each hiragana run of a translation that its source has too, outside brackets and quotes, and
    without a note behind it."""
    out: list[dict] = []
    if not source or not said:
        return out
    deep = depths(said)
    for run in HIRAGANA.finditer(said):
        if run[0] in source and not deep[run.start()] and not note_follows(said, run.end()):
            low, high = max(0, run.start() - pad), min(len(said), run.end() + pad)
            out.append({"token": run[0], "start": run.start(), "excerpt": "…" * (low > 0) + said[low:high] + "…" * (high < len(said))})
    return out


def reference_lines(text: str | None) -> str:
    """The translated lines of a mixed draft: without empty lines, rules, headers, and lines of kana or of no script at all."""
    kept = []
    for line in (text or "").splitlines():
        line = line.strip()
        kana, han = len(re.findall("[぀-ヿ]", line)), len(re.findall("[一-鿿]", line))
        if line.strip("-=—―_ \t") and not line.startswith("●") and han > 0 and not (kana and kana >= han):
            kept.append(line)
    return "\n".join(kept)


def cleaned(reply: str | None) -> str:
    """A reply that isn't JSON as text: marks of the prompt and remains of JSON off."""
    text = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", reply or "")
    text = re.sub(r"\|(?:TEXT|DST|SRC)\|", "", text)
    text = re.sub(r'^\s*\{?\s*"translation"\s*:\s*"?', "", text)
    return re.sub(r'"?\s*(?:,\s*"(?:confidence|notes|flags|needs_human)"\s*:.*)?\s*\}?\s*$', "", text, flags=re.S).strip()
