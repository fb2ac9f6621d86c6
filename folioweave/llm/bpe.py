"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A pre-token's bytes are read from left to right by an automaton over the vocabulary, which names the entries that end at each
byte. For each prefix the transducer knows the last token of that prefix's encoding: the longest entry ending there that may
stand behind the token before it (two tokens may stand side by side when the merge list, run over their bytes, leaves the
seam between them). ``lookahead`` is computed from the merge list: how many bytes behind a token can decide whether it stays.
A token that ends that far back is stable and is emitted, so memory stays constant however long a pre-token is. Decoding maps
ids to bytes and bytes to text with an incremental UTF-8 state machine.

Defined results: null text is empty (no ids, empty decoded text); the special string inside a text is its own id, as in
the library; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries of each of the two generations of a worker's cache of chunks (one blank-separated piece of text each), the longest
#: chunk that is kept, seams known, and the bytes of a pre-token and characters of a text that are taken at once.
CACHE, LONGEST_CACHED, SEAMS, AT_ONCE, WINDOW = 200_000, 64, 400_000, 4096, 1 << 16
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_DOUBLE_BLANK = re.compile(r"\s\s|[\x00\x1c-\x1f]")
_SEAM = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, by rule: printable Latin-1
    stands for itself, every other byte for the next code point from 256 on."""
    table, after = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = b
        else:
            table[chr(after)] = b
            after += 1
    return table


class Vocabulary:
    """Tokens, merges and the seam test of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        characters = byte_characters()
        to_bytes = lambda s: bytes(characters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {to_bytes(s): i for s, i in vocab.items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        #: Rank of each token: bytes first, then merges in their order. halves: what a token was merged from.
        self.rank = {self.ids[bytes([b])]: b for b in range(256) if bytes([b]) in self.ids}
        self.halves: dict[int, tuple[int, int]] = {t: (t, t) for t in self.rank}
        self.merged: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = (to_bytes(s) for s in (merge if isinstance(merge, list) else merge.split(" ")))
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.merged[a, b] = c
            if c not in self.rank:
                self.rank[c], self.halves[c] = 256 + n, (a, b)
        #: What the merges can make of its own bytes; a vocabulary may hold entries that no text ever reaches.
        self.reached = set()
        for t in sorted(self.rank, key=self.rank.__getitem__):
            a, b = self.halves[t]
            if a == t or a in self.reached and b in self.reached and self._seam(a, b, self.rank[t]):
                self.reached.add(t)
        self.candidates = {b: i for b, i in self.ids.items() if i in self.reached}
        self.automaton = ahocorasick.Automaton()
        for b, t in self.candidates.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), t))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids))
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.seams: dict[int, bool] = {}  # by both tokens in one number
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Bytes behind a token that can decide whether it stays.

        In the order of the merges, reach[t] is how far from its start a token t depends on what follows: a merge (x, y) takes x
        away, or makes x + y, only if y is there, which is known within |x| and the larger of |y| and y's own reach so far."""
        size = {t: len(self.bytes[t]) for t in self.rank}
        reach = dict(size)
        for (x, y), z in self.merged.items():
            far = size[x] + max(size[y], reach[y])
            reach[x] = max(reach[x], far)
            reach[z] = max(reach[z], far)
        return max((far - size[t] for t, far in reach.items()), default=0)

    def seam(self, a: int, b: int) -> bool:
        """Whether the merges leave the seam between tokens a and b: undo merges at the seam, latest first, and see
        whether an earlier merge would have joined what meets there."""
        known = self.seams.get(a << 32 | b)
        if known is None:
            known = self._seam(a, b)
            if len(self.seams) > SEAMS:
                self.seams.clear()
            self.seams[a << 32 | b] = known
        return known

    def _seam(self, a: int, b: int, limit: float = float("inf")) -> bool:
        rank, halves, merged = self.rank, self.halves, self.merged
        while True:
            joined = merged.get((a, b))
            if joined is not None and rank[joined] < limit:
                return False
            # Of equal merges the left one runs first: one inside b that starts at the seam runs after one over it.
            split_a, split_b = halves[a][0] != a or halves[a][1] != a, halves[b][0] != b or halves[b][1] != b
            if not split_a and not split_b:
                return True
            if split_a and (not split_b or rank[a] > rank[b]):
                limit, a = rank[a], halves[a][1]
            else:
                limit, b = rank[b] + 1, halves[b][0]


def advance(v: Vocabulary, matches, tokens: list[int], starts: list[int], read: int) -> None:
    """Fill in the last token, and where it starts, of each prefix that ends in newly read bytes. matches are the entries that
    end there, longest first, by their place in the pre-token; the lists begin ``read`` bytes into it."""
    seams, seam = v.seams, v.seam
    first = 1 - read
    for end, (size, token) in matches:
        end += first
        if tokens[end] >= 0:
            continue
        start = end - size
        if start + read:
            before = tokens[start]
            known = seams.get(before << 32 | token)
            if known is None:
                known = seam(before, token)
            if not known:
                continue
        tokens[end], starts[end] = token, start


class Encoder:
    """The transducer for one pre-token: feed bytes, take stable tokens, then finish."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.matches = vocabulary, None
        self.done, self.n = 0, 0  # bytes whose tokens are out, bytes read
        self.tokens, self.starts = [-1], [0]  # of the prefixes that end at done, done + 1, ...

    def feed(self, data: bytes) -> list[int]:
        v, tokens, starts, done = self.v, self.tokens, self.starts, self.done
        text = data.decode("latin-1")
        if self.matches is None:
            self.matches = v.automaton.iter(text)
        else:
            self.matches.set(text, False)  # the automaton goes on where it stood
        tokens += [-1] * len(data)
        starts += [0] * len(data)
        advance(v, self.matches, tokens, starts, done)
        self.n += len(data)
        return self.emit(self.n - v.lookahead - done) if self.n - done > v.lookahead + AT_ONCE else []

    def emit(self, upto: int) -> list[int]:
        """The tokens that end at most ``upto`` bytes behind those already out; what is known of them is dropped."""
        tokens, starts = self.tokens, self.starts
        at, out = len(tokens) - 1, []
        while at > upto:
            at = starts[at]
        cut = at
        while at:
            out.append(tokens[at])
            at = starts[at]
        # Entries reach back one longest token at most; a prefix that doesn't pass through the cut can't be gone on with.
        self.tokens = tokens[cut:]
        self.starts = [s - cut for s in starts[cut:]]
        self.done += cut
        return out[::-1]

    def finish(self) -> list[int]:
        return self.emit(len(self.tokens) - 1)


def encode_word(v: Vocabulary, word: bytes) -> list[int]:
    """The tokens of one pre-token."""
    if (token := v.candidates.get(word)) is not None:
        return [token]
    n, out = len(word), []
    if n <= AT_ONCE:  # nothing need be emitted before the end
        tokens, starts = [-1] * (n + 1), [0] * (n + 1)
        advance(v, v.automaton.iter(word.decode("latin-1")), tokens, starts, 0)
        while n:
            out.append(tokens[n])
            n = starts[n]
        return out[::-1]
    encoder = Encoder(v)
    for a in range(0, len(word), AT_ONCE):
        out += encoder.feed(word[a : a + AT_ONCE])
    return out + encoder.finish()


class Codec:
    """Encoding and decoding of texts in one worker, with a bounded cache of two generations."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.names = {i: b"%d" % i for i in self.v.bytes}

    def learn(self, chunk: str) -> bytes:
        """Ids of a chunk, four bytes each: from the older generation, else made of its pre-tokens, which may be known."""
        got = self.old.get(chunk)
        if got is None:
            words = PRETOKEN.findall(chunk)
            if len(words) == 1:
                got = array.array("I", encode_word(self.v, chunk.encode())).tobytes()
            else:
                got = b"".join([self.new.get(w) or self.learn(w) for w in words])
        if len(chunk) <= LONGEST_CACHED:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[chunk] = got
        return got

    def windows(self, text: str) -> Iterator[str]:
        """Text in pieces of about WINDOW characters, cut at single blanks between words only."""
        at = 0
        while len(text) - at > WINDOW and (found := _SEAM.search(text, at + WINDOW)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids, a window of the text at a time. A window's chunks have seams that are seams of pre-tokens too: before a blank
        between two words, round a newline. Where white space is not single, the pre-tokens themselves are the chunks."""
        for part in self.v.special_split.split(text) if self.v.special_split else (text,):
            if part in self.v.special:
                yield [self.v.special[part]]
                continue
            for window in self.windows(part):
                if not window:
                    continue
                if _DOUBLE_BLANK.search(window):
                    names = PRETOKEN.findall(window)
                else:
                    names = window.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
                known = list(map(self.new.get, names))
                if None in known:
                    known = [self.learn(n) if x is None else x for n, x in zip(names, known, strict=True)]
                yield array.array("I", b"".join(known)).tolist()

    def decode(self, ids: Iterator[list[int]]) -> Iterator[str]:
        return decode(b"".join(map(self.v.bytes.__getitem__, some)) for some in ids)

    def digest(self, text: str, with_ids: bool = False) -> tuple[int, str, str, list[int], str]:
        """Number of ids, digests of the ids and of the decoded text; with_ids also both themselves."""
        id_sum, text_sum, n, kept, out = hashlib.sha256(), hashlib.sha256(), 0, [], []
        name = self.names.__getitem__

        def pass_on() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.encode(text):
                if ids:
                    id_sum.update(b"," * (n > 0) + b",".join(map(name, ids)))
                    n += len(ids)
                    if with_ids:
                        kept.extend(ids)
                    yield ids

        for some in self.decode(pass_on()):
            text_sum.update(some.encode())
            if with_ids:
                out.append(some)
        return n, id_sum.hexdigest(), text_sum.hexdigest(), kept, "".join(out)


def decode(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text as soon as bytes complete it; a broken sequence becomes the replacement character."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        if text := machine.decode(piece):
            yield text
    if text := machine.decode(b"", True):
        yield text


def codec(path: str) -> Codec:
    return common.kept(("bpe", path), lambda: Codec(path))


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with_ids adds ids (array) and decoded (text)."""
    common.tune(docs.sparkSession)
    docs = common.only(docs, id_col, text_col).toDF("doc_id", "text")
    kind = docs.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            found = [own.digest(text.as_py() or "", with_ids) for text in batch.column(1)]
            counts, id_sums, text_sums, ids, texts = zip(*found, strict=True) if found else ((),) * 5
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return common.arrow(docs, run, schema, ("bpe", path))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs with n_tokens, ids_sha256 and decoded_sha256 beside them, in one pass, no join."""
    names = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    return bpe(packed, path, "row").select("doc_id.*", "n_tokens", "ids_sha256", "decoded_sha256")
