"""Text expressions as Column functions; character classes, lengths and thresholds are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the operators count it: ASCII blanks, no-break space and the ideographic space.
BLANKS = r"[ \t\n\r\f\x0B 　]"
PLACEHOLDER = r"\[\[P[0-9]+\]\]"
#: What n-grams leave out.
UNSPOKEN = r"[\s\p{Punct}　]+"


def normalize_ws(text: Column) -> Column:
    """Every run of white space becomes one blank; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{BLANKS}+", " "))


def norm_key(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, f"{BLANKS}+", ""))


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def placeholders(text: Column) -> Column:
    """Placeholder tokens in order."""
    return F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1))


def bracketed(text: Column, most: int = 60) -> Column:
    """Contents of round brackets of 1 to ``most`` characters."""
    return F.regexp_extract_all(text, F.lit(f"[(（]([^()（）]{{1,{most}}})[)）]"), F.lit(1))


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]+', "_")


def ngrams(text: Column, n: int = 2, drop: str = UNSPOKEN) -> Column:
    """Distinct n-grams of text without white space and punctuation; a shorter text is its own gram, an empty one none."""
    bare = F.regexp_replace(text, drop, "")
    chars = F.filter(F.split(bare, ""), lambda c: c != "")
    grams = chars  # neighbours are joined array by array: a lambda that cut the text would clean it anew for each gram
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(chars, k, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.when(F.length(bare) >= n, F.array_compact(grams)).when(F.length(bare) > 0, F.array(bare)).otherwise(F.array().cast("array<string>")))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two distinct gram arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length; both empty: 1."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def script_class(text: Column) -> Column:
    """kana before latin before han before other."""
    return F.when(text.rlike(r"[ぁ-ヿ]"), "kana").when(text.rlike("[A-Za-z]"), "latin").when(text.rlike(r"[一-鿿]"), "han").otherwise("other")


def detag(html: Column) -> Column:
    """Text without comments, scripts and tags; &nbsp; is a blank. Style elements' text stays."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), "(?is)<script.*?</script>", "")
    return F.replace(F.regexp_replace(bare, "(?s)<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" "))


def text_length(html: Column) -> Column:
    """Characters left without comments, scripts, styles, tags and white space."""
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        bare = F.regexp_replace(bare, f"(?is)<{tag}.*?</{tag}>", "")
    return F.length(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", ""), f"{BLANKS}+", ""))


def excerpt(text: Column, start: Column, length: Column, pad: int = 24) -> Column:
    """The span from 1-based start with ``pad`` characters around it, an ellipsis where text was cut."""
    low = F.greatest(F.lit(1), start - pad)
    high = F.least(F.length(text), start + length - 1 + pad)
    return F.concat(F.when(low > 1, F.lit("…")).otherwise(""), F.substring(text, low, high - low + 1), F.when(high < F.length(text), F.lit("…")).otherwise(""))


def clauses(text: Column, pauses: str = ",;:.!?，。！？；：、") -> Column:
    """Pieces that end with a pause mark (or the text), without those of punctuation alone."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^{pauses}]+[{pauses}]*)"), F.lit(1))
    return F.filter(pieces, lambda p: p.rlike(r"[\p{L}\p{N}]"))


def path_hops(a: Column, b: Column) -> Column:
    """Segments of two paths that aren't in their common prefix."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(F.size(same))
    return F.size(x) + F.size(y) - 2 * common


def hash_id(*fields: Column, prefix: str = "qa_", size: int = 12) -> Column:
    """prefix and the first characters of the MD5 of the fields joined by bars; null counts as empty."""
    return F.concat(F.lit(prefix), F.left(F.md5(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])), F.lit(size)))


def language_name(code: Column, names: dict[str, str]) -> Column:
    """The label of a language code, else that of its main subtag, else the code."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.try_element_at(table, F.substring_index(code, "-", 1)), code)


def count_occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal part; 0 for an empty one."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("bigint")
