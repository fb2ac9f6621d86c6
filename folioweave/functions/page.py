"""Pages as segments with character offsets, and putting them together again.

A page is text runs and the gaps between them. A gap with a block element, a comment or a declaration ends a segment; a gap
of inline markup inside a segment becomes a placeholder that counts on over the page; white space alone stays as it is. Inside
``pre`` a line end is a placeholder and several of them end the segment. Segments neither begin nor end with markup or white
space. Attributes ``alt`` and ``title`` with CJK text follow, the head's title comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Elements that end a segment, and those whose content is markup too.
BLOCKS = frozenset("p div blockquote table tr td th li ul ol h1 h2 h3 h4 h5 h6 center pre hr dl dt dd form option select title html head body".split())
ATOMIC = frozenset("script style title".split())
MARK = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|</?[A-Za-z][^>]*>", re.I | re.S)
BLANK = re.compile(r"[\s　]+|&(?:nbsp|#160|#32);", re.I)
ATTRIBUTE = re.compile(r"""\b(alt|title)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CJK = re.compile("[぀-ヿ一-鿿]")
SCHEMA = "id: int, kind: string, start: int, end: int, text: string, source_text: string, placeholders: array<struct<token: string, raw: string>>"


def tag_name(mark: str) -> str:
    return re.split(r"[\s/>]", mark.strip("<>/"))[0].lower()


def runs(source: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): text, blank, or the markup as ``inline`` or ``block``."""
    at, n = 0, len(source)
    while at < n:
        mark = MARK.search(source, at)
        upto = mark.start() if mark else n
        while at < upto:
            blank = BLANK.search(source, at, upto)
            if blank and blank.start() == at:
                yield "blank", at, blank.end()
                at = blank.end()
            else:
                stop = blank.start() if blank else upto
                yield "text", at, stop
                at = stop
        if not mark:
            return
        at = mark.end()
        if mark[0].startswith("<!"):
            yield "block", mark.start(), at
            continue
        name = tag_name(mark[0])
        if name in ATOMIC:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else n
        yield "block" if name in BLOCKS or name in ATOMIC else "inline", mark.start(), at


def gaps(source: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): text, white (kept inside a segment), inline (a placeholder) or block (an end)."""
    pre = [m.span() for m in re.finditer(r"<pre[^>]*>.*?</pre>", source, re.I | re.S)]
    held: list[tuple[str, int, int]] = []

    def closed() -> Iterator[tuple[str, int, int]]:
        kinds = {k for k, _, _ in held}
        if kinds - {"blank"}:
            yield "block" if "block" in kinds else "inline", held[0][1], held[-1][2]
        else:
            for _, a, b in held:
                ends = source.count("\n", a, b) if any(x <= a and b <= y for x, y in pre) else 0
                yield "white" if not ends else "inline" if ends == 1 else "block", a, b
        held.clear()

    for run in runs(source):
        if run[0] == "text":
            if held:
                yield from closed()
            yield run
        else:
            held.append(run)
    if held:
        yield from closed()


def segments(source: str | None, opening: str = "[[P", closing: str = "]]", alt: bool = True, title: bool = True) -> list[dict]:
    """The segments of a page: id (from 1), kind, start, end, text (with placeholders), source_text, placeholders."""
    source = source or ""
    out: list[dict] = []

    def add(kind: str, start: int, end: int, text: str, said: str, held: list[tuple[str, str]]) -> None:
        if text.strip():
            out.append({"id": len(out) + 1, "kind": kind, "start": start, "end": end, "text": text, "source_text": said, "placeholders": [{"token": t, "raw": r} for t, r in held]})

    head = re.search(r"<title[^>]*>(.*?)</title>", source, re.I | re.S)
    if head and title:
        name = re.sub(r"<[^>]+>", "", head[1])
        start = source.find(name)
        add("head_title", start, start + len(name), name, "", [])
    parts: list[str] = []
    held: list[tuple[str, str]] = []
    number, start, end = 0, -1, -1
    white = ""  # stays only if more of the segment follows
    for kind, a, b in [*gaps(source), ("block", len(source), len(source))]:
        if kind == "block":
            if start >= 0:
                add("text", start, end, "".join(parts), source[start:end], held)
            parts, held, start, white = [], [], -1, ""
        elif kind == "white":
            white += source[a:b] if start >= 0 else ""
        elif kind == "text" or start >= 0:
            start = a if start < 0 else start
            parts.append(white)
            if kind == "inline":
                token = f"{opening}{number}{closing}"
                number += 1
                held.append((token, source[a:b]))
                parts.append(token)
            else:
                parts.append(source[a:b])
            white, end = "", b
    for found in ATTRIBUTE.finditer(source):
        group = next((g for g in (2, 3, 4) if found[g] is not None), 0)
        kind = found[1].lower()
        if group and found[group].strip() and CJK.search(found[group]) and (alt if kind == "alt" else title):
            add(f"attr_{kind}", found.start(group), found.end(group), found[group], found[group], [])
    return out


def reassemble(source: str, found: list[dict]) -> str:
    """The page with each segment's trimmed ``translation`` (null: as it was) in its place, placeholders put back."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: s["start"]):
        if s.get("translation") is None or s["start"] < at:
            continue
        said = re.sub(r"^[\s　]+|[\s　]+$", "", s["translation"])
        for p in s["placeholders"] or ():
            said = said.replace(p["token"], p["raw"])
        out += [source[at : s["start"]], said]
        at = s["end"]
    return "".join([*out, source[at:]])


def quote_end(source: str, start: int, end: int, quote: str) -> int:
    """Where a quote ends in source[start:end]: literally, else with white space, markup and case left aside; -1 if it isn't there."""
    at = source.find(quote, start, end) if quote else -1
    if at >= 0:
        return at + len(quote)
    letters, places = [], []
    for kind, a, b in runs(source[start:end]):
        if kind == "text":
            for i in range(a, b):
                for c in source[start + i].lower():
                    letters.append(c)
                    places.append(start + i)
    wanted = re.sub(r"[\s　]+", "", quote).lower()
    at = "".join(letters).find(wanted) if wanted else -1
    return places[at + len(wanted) - 1] + 1 if at >= 0 else -1


def annotate(source: str, notes: list[tuple[int, str]], style: str = "", script: str = "") -> str:
    """The page with numbered marks behind the offsets of notes (end, text): numbers run in order of place, notes of one place
    share a mark; style goes before </head>, the notes as JSON and script before </body>, each at the page's end failing that."""
    import json

    placed = sorted((end, i) for i, (end, _) in enumerate(notes) if end >= 0)
    marks: dict[int, list[int]] = {}
    texts = []
    for number, (end, i) in enumerate(placed, 1):
        marks.setdefault(end, []).append(number)
        texts.append({"n": number, "text": notes[i][1]})
    out, at = [], 0
    for end, numbers in marks.items():
        out += [source[at:end], f'<sup class="note">[{",".join(map(str, numbers))}]</sup>']
        at = end
    out.append(source[at:])
    page = "".join(out)
    if not marks:
        return page
    for what, before in ((f"<style>{style}</style>" if style else "", "</head>"), (f'<script type="application/json" id="notes">{json.dumps(texts, ensure_ascii=False)}</script>' + (f"<script>{script}</script>" if script else ""), "</body>")):
        found = re.search(re.escape(before), page, re.I)
        spot = found.start() if found else len(page) if before == "</body>" else 0
        page = page[:spot] + what + page[spot:]
    return page
