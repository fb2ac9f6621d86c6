"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces (a forward pass), and a text's log-probability is the sum over its words, since no
piece crosses a blank. Piece probabilities are fitted by expectation-maximisation (forward and backward passes over all
segmentations) on the word counts of whole texts of a bounded sample of labelled rows. A forward pass keeps the last
``longest piece`` positions only, scaled as it goes, so a word of any length is scored whole.

Defined results: null text, and text without a letter, is ``und`` with score 0; null or unlisted labels teach nothing;
with no labelled row at all everything is ``und``; ties go to the language first in alphabetical order; repeated rows
each give a row; other columns are ignored. Whole texts are scored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows sampled for each language, rounds of fitting, pseudo-count, words in a worker's cache.
SAMPLE_ROWS, ROUNDS, PRIOR, CACHE = 600, 2, 0.1, 150_000
#: Words in one forward pass, and the length above which a word is scored alone, isn't cached, and teaches in spans that long.
AT_ONCE, LONG = 20_000, 128
#: Words of a language are weighed by this in fitting for each of their characters, which leaves shares as they are.
LIFT = 3.0
#: Log-probability of a character that no piece holds; equal in all languages.
UNKNOWN = -18.0
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def vocabulary(path: str) -> dict[str, int]:
    """Distinct lower-case letter pieces of the vocabulary, with an index each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i) and piece.strip("▁"):
            found.setdefault(piece, len(found))
    return found


class Pieces:
    """Piece strings to their index, for whole arrays of 64-bit hashes: two slot tables, each piece in one of them."""

    BITS = 18

    def __init__(self, pieces: dict[str, int]):
        self.hashes = np.zeros(len(pieces), np.uint64)
        for piece, i in pieces.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = self.step(h, np.array([ord(c)], np.uint64))
            self.hashes[i] = h[0]
        self.first = np.zeros(1 << self.BITS, np.int32)
        slots, kept = np.unique(self.slot(self.hashes, 0), return_index=True)
        self.first[slots] = kept
        rest = np.setdiff1d(np.arange(len(pieces)), kept)
        for self.turn in range(1, 40):
            slots = self.slot(self.hashes[rest], self.turn)
            if len(np.unique(slots)) == len(slots):
                break
        self.second = np.zeros(1 << self.BITS, np.int32)
        self.second[slots] = rest

    @staticmethod
    def step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The hash of a string with one more character."""
        h = (h ^ codes) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def slot(self, h: np.ndarray, turn: int) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93 + 2 * turn)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of h that are pieces, and those pieces."""
        at = self.first[self.slot(h, 0)]
        missed = np.flatnonzero(self.hashes[at] != h)
        at[missed] = self.second[self.slot(h[missed], self.turn)]
        rows = np.flatnonzero(self.hashes[at] == h)
        return rows, at[rows]


class Scorer:
    """Forward passes for all languages and many words at once, with a bounded cache of words."""

    def __init__(self, pieces: dict[str, int], probabilities: np.ndarray):
        self.pieces, self.p = Pieces(pieces), probabilities
        self.longest = max(map(len, pieces))
        self.cache: dict[str, int] = {}
        self.known = np.zeros((CACHE, probabilities.shape[1]))

    def words(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for each word, every segmentation summed."""
        out = np.zeros((len(words), self.p.shape[1]))
        order = np.argsort([-len(w) for w in words], kind="stable")
        alone = int(sum(len(w) > LONG for w in words))
        for r in order[:alone].tolist():
            out[r] = self.alone(words[r])
        at = alone
        while at < len(words):
            rows = order[at : at + at_once(len(words[order[at]]))]
            out[rows] = self.longest_first(["▁" + words[r] for r in rows])
            at += len(rows)
        return out

    def longest_first(self, words: list[str]) -> np.ndarray:
        """The same for words in order of length, longest first: at each position the words that reach it are a prefix."""
        n, floor, back = len(words[0]), np.exp(UNKNOWN), self.longest
        codes, reach = code_points(words)
        langs = self.p.shape[1]
        ring = np.zeros((back + 1, len(words), langs))  # forward values of the last positions, position j at j % (back + 1)
        ring[0] = 1.0
        hashes = np.zeros((back, len(words)), np.uint64)  # of the strings that start at i and end before j, at i % back
        logs, out = np.zeros((len(words), langs)), np.zeros((len(words), langs))
        for j in range(1, n + 1):
            m = reach[j]
            here = ring[(j - 1) % (back + 1), :m] * floor
            hashes[(j - 1) % back, :m] = 0
            for i in range(max(0, j - back), j):
                h = hashes[i % back, :m] = self.pieces.step(hashes[i % back, :m], codes[j - 1, :m])
                hit, piece = self.pieces.find(h)
                if len(hit):
                    here[hit] += ring[i % (back + 1), hit] * self.p[piece]
            ring[j % (back + 1), :m] = here
            done = reach[j + 1] if j < n else 0
            out[done:m] = np.log(np.maximum(here[done:], 1e-300)) + logs[done:m]
            if j % 8 == 0:
                top = ring[:, :m].max(axis=0)
                ring[:, :m] /= top
                logs[:m] += np.log(top)
        return out

    def alone(self, word: str, chunk: int = 4096) -> list[float]:
        """The same for one word of any length, with memory for a chunk of it."""
        codes = np.frombuffer(("▁" + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
        floor, back, langs = float(np.exp(UNKNOWN)), self.longest, range(self.p.shape[1])
        past, logs = [[1.0] * len(langs)], [0.0] * len(langs)
        for a in range(0, len(codes), chunk):
            b, low = min(len(codes), a + chunk), max(0, a - back + 1)
            ending: list[list[tuple[int, list[float]]]] = [[] for _ in range(b - a)]
            h = np.zeros(b - low, np.uint64)
            for size in range(1, min(back, b - low) + 1):
                h = self.pieces.step(h[: b - low - size + 1], codes[low + size - 1 : b])
                hit, piece = self.pieces.find(h)
                late = hit + low + size > a
                for end, row in zip((hit[late] + low + size - a - 1).tolist(), self.p[piece[late]].tolist(), strict=True):
                    ending[end].append((size, row))
            for pieces in ending:
                here = [x * floor for x in past[-1]]
                for size, row in pieces:
                    before = past[-size]
                    for x in langs:
                        here[x] += before[x] * row[x]
                past.append(here)
                if len(past) >= back + 16:
                    del past[:-back]
                    top = [max(f[x] for f in past) for x in langs]
                    past = [[f[x] / top[x] for x in langs] for f in past]
                    logs = [y + float(np.log(t)) for y, t in zip(logs, top, strict=True)]
        return [y + float(np.log(max(f, 1e-300))) for y, f in zip(logs, past[-1], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Put words into the cache, which starts anew when it is full."""
        words = {w for w in words if len(w) <= LONG}
        new = [w for w in words if w not in self.cache]
        if len(new) + len(self.cache) > CACHE:
            self.cache.clear()
            new = list(words)
        if new and len(new) <= CACHE:
            at = len(self.cache)
            self.known[at : at + len(new)] = self.words(new)
            self.cache.update(zip(new, range(at, at + len(new)), strict=True))

    def total(self, counts: Counter) -> np.ndarray:
        """The summed log-probabilities of counted words."""
        index = list(map(self.cache.get, counts))
        if None not in index:
            return np.fromiter(counts.values(), float, len(counts)) @ self.known[index]
        out = np.zeros(self.p.shape[1])
        known = [(i, n) for i, n in zip(index, counts.values(), strict=True) if i is not None]
        if known:
            out += np.array([n for _, n in known], float) @ self.known[[i for i, _ in known]]
        words = [w for w, i in zip(counts, index, strict=True) if i is None]  # too long, or more than the cache holds
        for i in range(0, len(words), AT_ONCE):
            part = words[i : i + AT_ONCE]
            out += np.array([counts[w] for w in part], float) @ self.words(part)
        return out


def at_once(longest: int) -> int:
    """Words of at most that many characters to take together."""
    return min(AT_ONCE, max(1, 400_000 // (longest + 1)))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters by position and word, for words in order of length, longest first; and how many words reach each position."""
    n = len(words[0])
    codes = np.frombuffer("".join(w.ljust(n, "\x00") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64)
    return codes, np.searchsorted(-np.array([len(w) for w in words]), -np.arange(n + 1), "right")


def word_counts(text: str | None) -> Counter:
    """Words of a text and their counts; none if the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    return Counter(found) if found and any(map(str.isalpha, text)) else Counter()


def spans(word: str) -> list[str]:
    """What a word teaches: its inner form, which a mark begins, in spans of at most LONG characters."""
    return [("▁" + word)[i : i + LONG] for i in range(0, len(word) + 1, LONG)]


def expected(words: list[str], weights: np.ndarray, pieces: Pieces, lifted: np.ndarray, floor: float, back: int, counts: np.ndarray) -> None:
    """Add to counts how often each piece is used in the words (longest first), all segmentations by their share."""
    codes, reach = code_points(words)
    n, rows = len(words[0]), np.arange(len(words))
    lengths = np.array([len(w) for w in words])
    forward = np.zeros((n + 1, len(words), lifted.shape[1]))
    forward[0] = 1.0
    hashes, arcs = np.zeros((n, len(words)), np.uint64), []
    for j in range(1, n + 1):
        m = reach[j]
        here = forward[j, :m]
        here += forward[j - 1, :m] * floor
        for i in range(max(0, j - back), j):
            h = hashes[i, :m] = pieces.step(hashes[i, :m], codes[j - 1, :m])
            hit, piece = pieces.find(h)
            if len(hit):
                here[hit] += forward[i, hit] * lifted[piece]
                arcs.append((i, j, hit, piece))
    share = weights / np.maximum(forward[lengths, rows], 1e-300)
    behind = np.zeros_like(forward)
    behind[lengths, rows] = 1.0
    at = len(arcs)
    for j in range(n, 0, -1):
        while at and arcs[at - 1][1] == j:
            at -= 1
            i, _, hit, piece = arcs[at]
            used = lifted[piece] * behind[j, hit]
            behind[i, hit] += used
            used = used * share[hit] * forward[i, hit]
            for x in range(used.shape[1]):
                counts[:, x] += np.bincount(piece, used[:, x], len(counts))
        behind[j - 1] += behind[j] * floor


def fit(path: str, words: dict[str, Counter], rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Languages, pieces and the piece probabilities (piece x language) from counts of spans() by language."""
    vocab = vocabulary(path)
    langs, index, back = sorted(words), Pieces(vocab), max(map(len, vocab))
    table = np.full((len(vocab), len(langs)), 1.0 / len(vocab))
    types = sorted({w for c in words.values() for w in c}, key=lambda w: (-len(w), w))
    weights = np.array([[words[x].get(w, 0) for x in langs] for w in types], float).reshape(len(types), len(langs))
    lift = np.exp(LIFT * np.array([len(p) for p in vocab]))[:, None]
    for _ in range(rounds):
        counts, at = np.full_like(table, prior), 0
        while at < len(types):
            upto = at + at_once(len(types[at]))
            expected(types[at:upto], weights[at:upto], index, table * lift, float(np.exp(UNKNOWN + LIFT)), back, counts)
            at = upto
        table = counts / counts.sum(axis=0)
    return langs, vocab, table


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, model_path: str, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Fit on the whole texts of at most sample_rows labelled rows of each language that aren't held out, chosen by a hash of
    their id."""
    from pyspark.sql import Window

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    # A hash threshold thins the rows before any sort; the ranks below make the bound exact.
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 3.0 * sample_rows / n))).otherwise(share)
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col, F.xxhash64(text_col))
    chosen = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20)).select(id_col, text_col, lang_col)
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_rows).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter((lang.as_py(), w) for lang, text in zip(batch.column(0), batch.column(1), strict=True) for w in WORD.findall(text.as_py().lower()) for w in spans(w))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    words: dict[str, Counter] = {}
    for lang, word, n in common.arrow(chosen, tally, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        words.setdefault(lang, Counter())[word] = n
    return fit(model_path, words) if words else ([], {}, np.zeros((0, 0)))


def predict(docs: DataFrame, model: tuple[list[str], dict[str, int], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words for every row; only the text is read for a prediction.

    score is the posterior of the best language with the text's log-probability divided by the square root of its words,
    so that long texts aren't all 1.
    """
    common.tune(docs.sparkSession)
    docs = common.only(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = ("language_id", uuid.uuid4().hex)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            langs, pieces, table = shared.value
            if scorer is None and langs:
                scorer = common.kept(key, lambda: Scorer(pieces, table))
            best, scores, sizes = [], [], []
            for a, b in common.slices(common.text_buffer(batch.column(1))[1], 4 << 20):
                counted = [word_counts(t.as_py()) for t in batch.column(1).slice(a, b - a)]
                if scorer:
                    scorer.learn(set().union(*counted))
                for counts in counted:
                    n = sum(counts.values())
                    sizes.append(n)
                    if not n or not scorer:
                        best.append("und")
                        scores.append(0.0)
                        continue
                    total = scorer.total(counts) / np.sqrt(n)
                    best.append(langs[int(np.argmax(total))])
                    scores.append(float(1.0 / np.exp(total - total.max()).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], names=["doc_id", "lang_pred", "score", "n_words"])

    kind = docs.schema[0].dataType.simpleString()
    return common.arrow(docs, score, f"doc_id {kind}, lang_pred string, score double, n_words bigint", key)


def language_id(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learnt from the rows that aren't held out."""
    model = train(docs, model_path, id_col, text_col, lang_col)
    found = predict(docs, model, id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
