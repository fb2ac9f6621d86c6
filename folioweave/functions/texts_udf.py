"""The small Arrow layer: what Catalyst has no primitive for (normal forms, sequence matching, tolerant JSON, diffs)."""

from __future__ import annotations

import difflib
import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = re.compile(r"\s+")
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[\[\]]', re.S)
# Keys of an answer that follow an array.
_KEY_NEXT = re.compile(r'\s*(,)\s*"(?:needs_human|confidence|glossary_conflicts|notes|translation)"')


def _vectorised(function, kind: str):
    """A scalar of texts as an Arrow-batched Column function; null counts as empty. The UDF itself is made at the call,
    so workers can import this module."""

    def call(*columns: Column) -> Column:
        if len(columns) == 1:

            @F.pandas_udf(kind)
            def run(a: pd.Series) -> pd.Series:
                return pd.Series([function(x or "") for x in a])
        else:

            @F.pandas_udf(kind)
            def run(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series([function(x or "", y or "") for x, y in zip(a, b, strict=True)])

        return run(*columns)

    return call


def canonical(text: str) -> str:
    """NFKC without placeholders and white space; runs of a decoration mark are one."""
    text = unicodedata.normalize("NFKC", re.sub(r"\[\[P\d+\]\]", "", text))
    return re.sub(r"([-=_*.~…])\1+", r"\1", _BLANK.sub("", text))


def sequence_ratio(a: str, b: str) -> float:
    a, b = (_BLANK.sub("", x).lower() for x in (a, b))
    return 1.0 if not a and not b else round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)


def longest_common(a: str, b: str) -> int:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def period(text: str, window: int = 16384, span: int = 2048) -> int:
    """The smallest period of the last ``window`` characters (white space folded) that repeats at least twice over ``span``
    characters and holds a letter or digit; 0 for none or a shorter text."""
    tail = _BLANK.sub(" ", text[-window:])
    if len(text) < window:
        return 0
    border = [0] * len(tail)
    for i in range(1, len(tail)):
        k = border[i - 1]
        while k and tail[i] != tail[k]:
            k = border[k - 1]
        border[i] = k + (tail[i] == tail[k])
    p = len(tail) - border[-1]
    whole = len(tail) // p
    return p if whole >= 2 and whole * p >= span and any(c.isalnum() for c in tail[:p]) else 0


def marked_diff(a: str, b: str) -> str:
    """b against a: [-gone-] and {+new+}."""
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append(a[i:j])
            continue
        out.append(f"[-{a[i:j]}-]" * (j > i) + f"{{+{b[k:m]}+}}" * (m > k))
    return "".join(out)


def change_count(a: str, b: str) -> int:
    cost = {"equal": 0, "delete": 1, "insert": 1, "replace": 2}
    return sum(cost[o[0]] for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes())


def html_diff(a: str, b: str, most: int = 2) -> str:
    """Up to ``most`` changes are shown inside the text, more as the whole old and new text; markup is escaped."""
    if a == b:
        return ""
    if change_count(a, b) > most:
        return f"<del>{html.escape(a)}</del><ins>{html.escape(b)}</ins>"
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        out.append(html.escape(a[i:j]) if kind == "equal" else f"<del>{html.escape(a[i:j])}</del>" * (j > i) + f"<ins>{html.escape(b[k:m])}</ins>" * (m > k))
    return "".join(out)


def first_object(text: str) -> str:
    """The first balanced {...}, strings and escapes respected; empty if none closes."""
    start = text.find("{")
    depth, inside, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        else:
            depth += (c == "{") - (c == "}")
            if not depth:
                return text[start : i + 1]
    return ""


def repair_strings(text: str) -> str:
    """Bare quotes and control characters inside JSON strings escaped: a quote ends a string only before , : } ] or the end."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if not inside:
            inside = c == '"'
            out.append(c)
        elif c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 1
        elif c == '"':
            rest = text[i + 1 :].lstrip()
            inside = bool(rest) and rest[0] not in ",:}]"
            out.append('\\"' if inside else '"')
        else:
            out.append(json.dumps(c)[1:-1] if c < " " else c)
        i += 1
    return "".join(out)


def close_arrays(text: str) -> str:
    """A ] before the comma where, inside an array that nothing closes, a string is followed by one of the object's own keys."""
    if text.count("[") <= text.count("]"):
        return text
    depth = 0
    for token in _TOKEN.finditer(text):
        if token[0] in "[]":
            depth += 1 if token[0] == "[" else -1
        elif depth > 0 and (key := _KEY_NEXT.match(text, token.end())):
            return f"{text[: key.start(1)]}]{text[key.start(1) :]}"
    return text


def tolerant_json(text: str, required: str = "translation") -> str:
    """The object in a model's answer as JSON: fences off, then as it is, balanced, repaired. Repairs count only if the
    object has the required key and are noted in it; null text or no object: empty."""
    text = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text)
    for attempt, methods in ((lambda: text, []), (lambda: first_object(text), []), (lambda: repair_strings(text), ["strings"]), (lambda: first_object(repair_strings(text)), ["strings"]), (lambda: close_arrays(repair_strings(text)), ["strings", "arrays"]), (lambda: first_object(close_arrays(repair_strings(text))), ["strings", "arrays"])):
        try:
            found = json.loads(attempt())
        except ValueError:
            continue
        if not isinstance(found, dict) or methods and required not in found:
            continue
        return json.dumps(found | ({"repaired": True, "repair_methods": methods} if methods else {}), ensure_ascii=False, sort_keys=True)
    return ""


canonical_udf = _vectorised(canonical, "string")
period_udf = _vectorised(period, "int")
object_udf = _vectorised(first_object, "string")
json_udf = _vectorised(tolerant_json, "string")
ratio_udf = _vectorised(sequence_ratio, "double")
common_udf = _vectorised(longest_common, "int")
diff_udf = _vectorised(marked_diff, "string")
changes_udf = _vectorised(change_count, "int")
html_diff_udf = _vectorised(html_diff, "string")
width_udf = _vectorised(lambda s: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s), "int")
