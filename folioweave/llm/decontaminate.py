"""Benchmark decontamination by winnowing.

Words of a text are hashed; ``k``-word hashes are formed at every word, and of each ``window`` consecutive ones the
smallest is kept as a fingerprint. Two texts that share ``k + window - 1`` words share a fingerprint, whatever stands
around them, so with k + window - 1 = ``span`` no shared span of ``span`` words is missed. Training fingerprints are joined
with the benchmark's, each hit is extended word by word in both directions on the hit item's words, and the words of
every shared span are compared as text. Items shorter than a span are one window of their own length, for which the
window of k-grams shrinks to one.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_BYTES`` (sizes are summed before any row is
fetched), each block is broadcast and held against all documents, and the blocks' hits are united by document. The usual
benchmark is one block and then nothing is shuffled.

Defined results: null or wordless text has no words and no hits; null or wordless items never hit; equal items all count;
repeated document rows each give a row, also over several blocks; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 16 << 20
SPAN, K = 10, 5
_WORD = common.ascii_words()
_VALUES = common.byte_values(3, fold_case=True)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end bytes, and rows of all words."""
    starts, ends, rows = common.word_spans(data, offsets, _WORD)
    sums = common.prefix_sums(_VALUES[data])
    return common.range_hashes(sums, starts, ends), starts, ends, rows


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (words near the end: of none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = common.prefix_sums(words)
    at = np.arange(n)
    return common.range_hashes(sums, at, at + k)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest gram (the first of equals) of every ``window`` consecutive grams."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, have = grams, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    kept = np.zeros(len(grams), bool)
    for o in range(window):  # each gram that is the least of some window that holds it
        kept[o : o + n] |= grams[o : o + n] == least
    return np.flatnonzero(kept)


class Benchmark:
    """One block of items: their words, and the sorted fingerprints that lead to places in them."""

    def __init__(self, items: list[tuple[object, str]], span: int = SPAN, k: int = K):
        self.span, self.k, self.ids, self.words = span, k, [], []
        finger, places = [], []
        short: dict[int, tuple[list, list]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            hashes, starts, ends, _ = word_hashes(data, np.array([0, len(data)]))
            if not len(hashes):
                continue
            at, folded = len(self.ids), data.tobytes().translate(_LOWER)
            self.ids.append(str(item))
            self.words.append([folded[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            if len(hashes) < span:
                found = short.setdefault(len(hashes), ([], []))
                found[0].append(gram_hashes(hashes, len(hashes)))
                found[1].append(np.array([(at, 0)]))
            else:
                grams = gram_hashes(hashes, k)
                kept = winnow(grams, span - k + 1)
                finger.append(grams[kept])
                places.append(np.stack([np.full(len(kept), at), kept], 1))
        join = lambda f, p: (lambda h, q: (h[o := np.argsort(h, kind="stable")], q[o]))(np.concatenate(f), np.concatenate(p))
        self.long = join(finger, places) if finger else None
        self.short = {n: join(*x) for n, x in short.items()}

    def meets(self, table, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are fingerprints of the table."""
        known = table[0]
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes

    def places(self, table, h) -> np.ndarray:
        known = table[0]
        return table[1][np.searchsorted(known, h, "left") : np.searchsorted(known, h, "right")]


def hits(data: np.ndarray, offsets: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[str]]]]:
    """Words of each row; for rows with hits, the sorted numbers of hit words and the items that hit."""
    words, starts, ends, rows = word_hashes(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.r_[0, np.cumsum(counts)]
    found: dict[int, tuple[set[int], set[int]]] = {}

    def same(at: int, item: list[bytes], i: int) -> bool:
        return data[starts[at] : ends[at]].tobytes().translate(_LOWER) == item[i]

    def inside(length: int, n: int) -> np.ndarray:
        """Grams of n words that don't cross a row's end."""
        return rows[:length] == rows[n - 1 : n - 1 + length]

    if bench.long is not None:
        grams = gram_hashes(words, bench.k)
        kept = winnow(grams, bench.span - bench.k + 1)  # windows over a row's end keep some more, which inside() drops
        hot = kept[bench.meets(bench.long, grams[kept]) & inside(len(grams), bench.k)[kept]]
        covered: dict[tuple[int, int], int] = {}  # (item, document word minus item word) to the end of the last span
        for at in hot.tolist():
            row = int(rows[at])
            low, high = int(first[row]), int(first[row + 1])
            for item, i in bench.places(bench.long, grams[at]).tolist():
                if covered.get((item, at - i), -1) > at:
                    continue
                text, a, j = bench.words[item], at, i
                while a > low and j > 0 and same(a - 1, text, j - 1):
                    a, j = a - 1, j - 1
                b, j = at, i
                while b < high and j < len(text) and same(b, text, j):
                    b, j = b + 1, j + 1
                covered[item, at - i] = max(b, at + 1)
                if b - a >= bench.span:
                    into = found.setdefault(row, (set(), set()))
                    into[0].update(range(a - low, b - low))
                    into[1].add(item)
    for n, table in bench.short.items():
        grams = gram_hashes(words, n)
        for at in np.flatnonzero(bench.meets(table, grams) & inside(len(grams), n)).tolist() if len(grams) else []:
            row = int(rows[at])
            for item, _ in bench.places(table, grams[at]).tolist():
                if all(same(at + j, bench.words[item], j) for j in range(n)):
                    into = found.setdefault(row, (set(), set()))
                    into[0].update(range(at - int(first[row]), at - int(first[row]) + n))
                    into[1].add(item)
    return counts, {row: (np.array(sorted(w)), {bench.ids[i] for i in items}) for row, (w, items) in found.items()}


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """How many blocks (about), and the items in blocks of some ``most`` bytes of text, one on the driver at a time."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // most) if size > most else 1

    def blocks() -> Iterator[list[tuple[object, str]]]:
        block, held = [], 0
        for row in items.toLocalIterator():
            if block and held + len(row.text) > most:
                yield block
                block, held = [], 0
            block.append((row.id, row.text))
            held += len(row.text)
        yield block

    return count, blocks()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit_words (numbers of hit words), items (ids that hit, sorted) of each row of docs."""
    common.tune(docs.sparkSession)
    docs = common.only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = docs.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, n_words bigint, hit_words array<int>, items array<string>"
    parts = []
    count, blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    if count > 1:  # a row's own number keeps repeated rows apart when blocks are united
        docs = common.written(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    else:
        docs = docs.withColumn("row", F.lit(0).cast("bigint"))
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block, span, k))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = common.text_buffer(batch.column(1))
                n_words, words, items = [], [None] * batch.num_rows, [None] * batch.num_rows
                for a, b in common.slices(offsets):
                    counts, found = hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
                    n_words.append(counts)
                    for row, (hit, ids) in found.items():
                        words[a + row], items[a + row] = hit.astype(np.int32), sorted(ids)
                empty = np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array([empty if w is None else w for w in words], pa.list_(pa.int32())), pa.array([x or [] for x in items], pa.list_(pa.string()))], names=["doc_id", "row", "n_words", "hit_words", "items"])

        parts.append(common.arrow(docs, scan, schema))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.select("doc_id", "n_words", "hit_words", "items")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], span: int = SPAN) -> list[tuple]:
    """The same digest, window by window, for tests."""
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= got
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
