"""Token counts by a map-side two-tier lookup.

A text in the vocabulary's inner form is a run of pre-tokens; no piece of the vocabulary spans the seam between two of
them, so counts add up. Tier one is a compact hash table (pre-token hash to length) of pre-tokens frequent in a bounded
sample, broadcast to all executors. Tier two is each worker's own cache, which encodes a miss with the library once.
No pre-token is ever shuffled.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows are kept one to one, repeats included; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents sampled for tier one and characters of each, the pre-tokens kept from them, and the entries and characters of a
#: worker's cache.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT, CACHE, CACHE_CHARS = 2000, 20_000, 60_000, 800_000, 12 << 20
PRETOKEN = re.compile("\n|▁*[^▁\n]+|▁+")


def hash_names(names: list[str]) -> np.ndarray:
    """64-bit hashes of short strings, all at once."""
    data, offsets = common.text_buffer(pa.array(names, pa.string()))
    sums = common.prefix_sums(common.byte_values(9)[data])
    return common.range_hashes(sums, offsets[:-1], offsets[1:])


class Lengths:
    """Tier one as two sorted arrays."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[order], lengths[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The length for each hash, -1 for a miss."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.lengths[at], -1)


def load_model(path: str):
    """The library's processor; checks that pre-token seams are safe in this vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁|\n", p) for p in pieces if len(p) > 1):
        raise ValueError("a piece of this vocabulary spans pre-tokens")
    if model.encode(" a  b") != [*model.encode(" a"), *model.encode(" b")]:
        raise ValueError("this model changes white space; its pre-tokens can't be counted one by one")
    return model


def pretokens(text: str) -> list[str]:
    """The pieces between safe seams, in the model's inner form (a leading mark stands for each blank)."""
    return PRETOKEN.findall("▁" + text.replace(" ", "▁")) if text else []


def encode_lengths(model, names: list[str]) -> list[int]:
    """Tokens of each pre-token. The model puts one blank's mark before whatever it encodes, so one mark is taken off
    first; a pre-token without a mark follows a newline, behind which it is encoded (two tokens more: mark, newline)."""
    marked = [n[1:].replace("▁", " ") if n[0] == "▁" else f"\n{n}" for n in names]
    ids = model.encode(marked, num_threads=1)
    extra = len(model.encode("\n"))
    return [1 if n == "\n" else len(i) if n[0] == "▁" and n != "▁" else 1 if n == "▁" else len(i) - extra for n, i in zip(names, ids, strict=True)]


class TextCounter:
    """Counts of texts in one worker: tier one first, then the cache, then the library."""

    def __init__(self, path: str, frequent: Lengths):
        self.model, self.frequent, self.cache, self.chars = load_model(path), frequent, {}, 0

    def learn(self, names: list[str]) -> None:
        found = self.frequent.find(hash_names(names)).tolist()
        misses = [n for n, length in zip(names, found, strict=True) if length < 0]
        self.chars += sum(map(len, names))
        if len(self.cache) + len(names) > CACHE or self.chars > CACHE_CHARS:
            self.cache.clear()
            self.chars = sum(map(len, names))
        self.cache.update((n, x) for n, x in zip(names, found, strict=True) if x >= 0)
        for i in range(0, len(misses), 50_000):
            part = misses[i : i + 50_000]
            self.cache.update(zip(part, encode_lengths(self.model, part), strict=True))

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        for part in bounded_parts(text):
            names = PRETOKEN.findall(part)
            lengths = list(map(self.cache.get, names))
            if None in lengths:
                self.learn(list({n for n, x in zip(names, lengths, strict=True) if x is None}))
                lengths = list(map(self.cache.get, names))
                while None in lengths:  # the cache started anew: what it held before is learnt again
                    self.learn(list(set(names)))
                    lengths = list(map(self.cache.get, names))
            total += sum(lengths)
        return total


def bounded_parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The inner form of text in parts of about ``most`` characters, divided at safe seams only."""
    inner, at = "▁" + text.replace(" ", "▁"), 0
    seam = re.compile("(?<=[^▁])(?=▁)|(?<=\n)")
    while len(inner) - at > most:
        found = seam.search(inner, at + most)
        if not found:
            break
        yield inner[at : found.start()]
        at = found.start()
    yield inner[at:]


def frequent_lengths(docs: DataFrame, text: str, path: str, sample_docs: int = SAMPLE_DOCS, keep: int = FREQUENT) -> Lengths:
    """Tier one from at most sample_docs rows: it only decides what is fast, never what is counted."""
    rows = docs.where(F.col(text).isNotNull()).select(F.substring(text, 1, SAMPLE_CHARS)).limit(sample_docs).collect()
    counts = Counter(n for r in rows for n in pretokens(r[0]))
    names = [n for n, _ in counts.most_common(keep)]
    if not names:
        return Lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Lengths(hash_names(names), np.array(encode_lengths(load_model(path), names), np.int64))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs, whole texts, no shuffle."""
    common.tune(docs.sparkSession)
    docs = common.only(docs, id_col, text_col).toDF("doc_id", "text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, "text", model_path))

    key = ("token_counts", model_path, uuid.uuid4().hex)  # tier one is this call's own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if counter is None:
                counter = common.kept(key, lambda: TextCounter(model_path, frequent.value))
            texts = batch.column(1)
            sizes = np.diff(common.text_buffer(texts)[1])
            totals = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[0].dataType.simpleString()
    return common.arrow(docs, count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", key)
