"""Removal of repeated byte strings with an enhanced suffix array over sampled suffixes.

Every ``span`` bytes of text hold one anchor, the smallest-hashed ``GRAM`` bytes inside (the first of equals): a function of those
bytes alone, so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor are a run, and the
suffixes that start at anchors are the sampled suffixes. They are sorted and their common prefixes scanned with a stack into
the common-prefix interval tree; an interval of depth d together with a left extension of span - d bytes is a repeat of span bytes,
and members whose left contexts differ fall apart (left-extension diversity). ``repeat_groups`` does the same for all
suffixes of given texts and lists maximal repeats with all their occurrences.

Over a corpus: (1) documents are packed into blocks, written once; (2) each block sends (anchor, hash of the run's
whole bytes, smallest document) to the anchor's bucket, equal runs once; there the smallest document of equal runs
owns them, and anchors with several different runs of several documents are contested; (3) blocks send the bytes of
contested runs to the anchor's bucket, where the suffix array of their anchors is built and scanned, and each window's
smallest document found; (4) blocks learn which windows they don't own and drop the bytes those cover. Only owners are told
apart, so a run that a third of all documents share is one row a block. Equality of whole runs rests on 64 bits of
hash between runs whose anchors have equal 57-bit hashes; contested runs are compared as bytes. An anchor with more than ``HOT``
contested runs is split by what stands beside it: its windows that reach at least half of their other bytes to the left
meet by those left bytes, the others by as many right ones, so a phrase with many neighbours isn't one task's work.

Defined results: null text is empty; texts shorter than ``span`` lose nothing; rows with equal doc_id don't take from each
other; rows with a null id take no part and lose nothing; an empty table gives an empty result; further columns pass
through unchanged.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPAN, GRAM = 50, 20
#: Contested runs of an anchor above which its windows are dealt by their other bytes, and windows hashed at a time.
HOT, SEGMENT = 2048, 1 << 18
#: Text bytes of a block and rows of a block at most.
BLOCK, BLOCK_ROWS = 3 << 19, 20_000
_VALUES = common.byte_values(11)


# ---- the suffix array of given texts ------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes ordered by their first ``depth`` values (prefix doubling)."""
    rank, have = data.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        ahead = np.zeros_like(rank)
        if have < len(rank):
            ahead[:-have] = rank[have:]
        order = np.lexsort((ahead, rank))
        new = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])]
        rank[order] = np.cumsum(new) + 1
        have *= 2
        if new.sum() == len(rank) - 1:
            break
    return order


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(depth, first, last, depth of the parent) of every common-prefix interval of at least ``least``: one stack scan.
    lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is 0."""
    stack: list[tuple[int, int]] = []  # depth, first
    values = lcp.tolist()
    values.append(0)
    for i, depth in enumerate(values):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1, max(depth, stack[-1][0] if stack else 0)
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeat_groups(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least ``least`` bytes, each as its length and all (text, start) where it stands. A repeat is
    right-maximal as an interval, and left-maximal if the bytes before its occurrences differ."""
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = np.concatenate([np.r_[np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), n] for n, t in enumerate(texts)]) if texts else np.zeros(0, np.int64)
    if not len(data):
        return []
    order = suffix_array(data, len(data))
    lcp = np.zeros(len(order), np.int64)
    for i in range(1, len(order)):
        a, b, n = int(order[i - 1]), int(order[i]), 0
        while a + n < len(data) and b + n < len(data) and data[a + n] == data[b + n]:  # separators are all different
            n += 1
        lcp[i] = n
    out = []
    for depth, first, last, _ in intervals(lcp, least):
        places = np.sort(order[first : last + 1])
        before = {int(data[p - 1]) if p else -1 for p in places}
        if len(before) > 1 or min(before) < len(texts):
            of = np.searchsorted(bounds, places, "right") - 1
            out.append((depth, list(zip(of.tolist(), (places - bounds[of]).tolist(), strict=True))))
    return out


# ---- runs of one block --------------------------------------------------------------------------------------------


class Runs:
    """The runs of a block's texts: first and last window, anchor, hashes, row; and which run stands for its equals."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, span: int, gram: int):
        n, w = len(data), span - gram + 1
        self.span, self.data, self.offsets = span, data, offsets
        if n < span:
            self.first = self.last = self.anchor_at = self.row = np.zeros(0, np.int64)
            self.anchor = self.whole = np.zeros(0, np.uint64)
            self.stand = np.zeros(0, np.int64)
            self.doc = np.zeros(0, np.int64)
            return
        sums = common.prefix_sums(_VALUES[data])
        _, down = common.powers(n + 1)
        bits = np.uint64((1 << 32) - 1)  # the same for every block: which gram is least must not depend on its neighbours
        at = np.empty(n - span + 1, np.int64)
        for a in range(0, len(at), SEGMENT):
            b = min(len(at), a + SEGMENT)
            hashes = self.gram_hashes(sums, down, a, b + w - 1, gram)
            least = (hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64)
            have = 1
            while have < w:
                step = min(have, w - have)
                least = np.minimum(least[: len(least) - step], least[step:])
                have += step
            at[a:b] = (least & bits).astype(np.int64) + a
        edge = np.zeros(n + 1, np.int32)  # windows that would cross a row's end
        starts, ends = offsets[:-1], offsets[1:]
        np.add.at(edge, np.maximum(starts, ends - span + 1), 1)
        np.add.at(edge, ends, -1)
        inside = np.cumsum(edge)[: n - span + 1] == 0
        change = np.r_[True, at[1:] != at[:-1]]
        begins = inside & (change | np.r_[True, ~inside[:-1]])
        stops = inside & (np.r_[change[1:], True] | np.r_[~inside[1:], True])
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(stops)
        self.anchor_at = at[self.first]
        self.anchor = common.mix((sums[self.anchor_at + gram] - sums[self.anchor_at]) * down[self.anchor_at])
        self.whole = common.range_hashes(sums, self.first, self.last + span)
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        self.doc = ids[self.row]
        order = np.lexsort((self.doc, self.whole, self.anchor))
        new = np.r_[True, (self.anchor[order][1:] != self.anchor[order][:-1]) | (self.whole[order][1:] != self.whole[order][:-1])]
        self.stand = np.empty(len(order), np.int64)
        self.stand[order] = order[new][np.cumsum(new) - 1]

    @staticmethod
    def gram_hashes(sums: np.ndarray, down: np.ndarray, a: int, b: int, gram: int) -> np.ndarray:
        return common.mix((sums[a + gram : b + gram] - sums[a:b]) * down[a:b])

    def keepers(self) -> np.ndarray:
        """Runs that stand for their equals."""
        return np.flatnonzero(self.stand == np.arange(len(self.stand)))

    def removed(self, lost: np.ndarray, masks: dict) -> np.ndarray:
        """Which bytes go: lost are runs that another block owns, masks the windows (bit: bytes before the anchor) that it
        owns of others. Equals in a larger document go whole."""
        gone = np.zeros(len(self.stand), bool)
        gone[lost] = True
        gone = gone[self.stand] | (self.doc > self.doc[self.stand])
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, self.first[gone], 1)
        np.add.at(edge, self.last[gone] + self.span, -1)
        if len(masks[0]):
            order = np.argsort(masks[0])
            known, heads = np.unique(masks[0][order], return_index=True)
            bits = np.bitwise_or.reduceat(masks[1][order], heads)  # a split anchor's run has a mask from each side
            here = np.minimum(np.searchsorted(known, self.stand), len(known) - 1)
            some = np.flatnonzero((known[here] == self.stand) & ~gone)
            for o in range(int(self.span)):
                hit = some[(bits[here[some]] >> np.uint64(o)) & np.uint64(1) == 1]
                start = self.anchor_at[hit] - o
                np.add.at(edge, start, 1)
                np.add.at(edge, start + self.span, -1)
        return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def pack_planes(values: np.ndarray, keep: int = 8) -> bytes:
    """Byte planes of integers, the lowest ``keep`` of them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T[:keep]).tobytes()


def unpack_planes(blob: bytes, n: int, keep: int = 8, kind=np.int64) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :keep] = np.frombuffer(blob, np.uint8).reshape(keep, n).T
    return full.view(kind).ravel()


# ---- over a corpus ------------------------------------------------------------------------------------------------

BLOCK_SCHEMA = "block bigint, kind int, ids binary, sizes binary, payload binary, rest binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids, text sizes, compressed texts, and the other columns as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            data, offsets = common.text_buffer(table.column("text"))
            ids = table.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy().astype(np.int64)
            sizes = np.diff(offsets)
            sink = pa.BufferOutputStream()
            rest = table.drop(["text"]).combine_chunks()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rest)
            flags = np.where(null, -1, 1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([9], pa.int32()), pa.array([numbers.tobytes()]), pa.array([(sizes * flags - (flags < 0)).tobytes()]), pa.array([zstandard.ZstdCompressor(level=1).compress(data.tobytes())]), pa.array([sink.getvalue().to_pybytes()])], names=["block", "kind", "ids", "sizes", "payload", "rest"])

        for batch in batches:
            offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))[1]
            for a, b in common.slices(offsets, BLOCK // 2):
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                if size >= BLOCK // 2 or sum(x.num_rows for x in held) >= BLOCK_ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return common.arrow(docs, run, BLOCK_SCHEMA)


def open_block(ids: bytes, sizes: bytes, payload: bytes, span: int, gram: int) -> tuple[Runs, np.ndarray]:
    """The runs of a block (rows without an id take no part) and its rows' numbers."""
    numbers, flagged = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
    null = flagged < 0
    offsets = np.r_[0, np.cumsum(np.where(null, -flagged - 1, flagged))]
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    if not null.any():
        return Runs(data, offsets, numbers, span, gram), offsets
    runs = Runs(data, offsets, numbers, span, gram)
    keep = ~null[runs.row] if len(runs.row) else np.zeros(0, bool)
    for name in ("first", "last", "anchor_at", "anchor", "whole", "row", "doc"):
        setattr(runs, name, getattr(runs, name)[keep])
    order = np.lexsort((runs.doc, runs.whole, runs.anchor))
    new = np.r_[True, (runs.anchor[order][1:] != runs.anchor[order][:-1]) | (runs.whole[order][1:] != runs.whole[order][:-1])][: len(order)]
    runs.stand = np.empty(len(order), np.int64)
    if len(order):
        runs.stand[order] = order[new][np.cumsum(new) - 1]
    return runs, offsets


def anchors(stored: DataFrame, buckets: int, span: int, gram: int) -> DataFrame:
    """bucket, block, n, blob: anchor (48 bits beside the bucket), whole, document and number of a block's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, payload in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                runs, _ = open_block(ids, sizes, payload, span, gram)
                keep = runs.keepers()
                if not len(keep):
                    continue
                rows = []
                for b, (anchor, whole, doc, number) in common.by_bucket((runs.anchor[keep] % np.uint64(buckets)).astype(np.int64), [runs.anchor[keep] // np.uint64(buckets), runs.whole[keep], runs.doc[keep], keep]):
                    steps = np.diff(number, prepend=0)
                    rows.append((b, len(number), pack_planes(anchor, 6) + pack_planes(whole) + pack_planes(doc) + pack_planes(steps, 4)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "block", "n", "blob"])

    return common.arrow(stored, run, "bucket bigint, block bigint, n bigint, blob binary")


def by_group(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of sorted batches, one key's after another's."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[key] != at and rows:
                yield at, rows
                rows = []
            at = row[key]
            rows.append(row)
    if rows:
        yield at, rows


def owners(sent: DataFrame, partitions: int, hot: int = HOT) -> DataFrame:
    """block, kind, blob: numbers of runs that another block owns (kind 0), and of contested ones (kind 1; 3 for an anchor
    with more than ``hot`` of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches):
            parts = []
            for _, block, n, blob in rows:
                cuts = np.cumsum([0, 6 * n, 8 * n, 8 * n, 4 * n])
                a, w, d, s = (blob[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))
                parts.append((unpack_planes(a, n, 6), unpack_planes(w, n), unpack_planes(d, n), np.cumsum(unpack_planes(s, n, 4)), np.full(n, block)))
            anchor, whole, doc, number, block = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, whole, anchor))
            anchor, whole, doc, number, block = (x[order] for x in (anchor, whole, doc, number, block))
            new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
            new_run = new_anchor | np.r_[True, whole[1:] != whole[:-1]]
            run_of = np.cumsum(new_run) - 1
            lost = doc > doc[new_run][run_of]
            heads = np.flatnonzero(new_run)
            of = np.cumsum(new_anchor)[heads] - 1
            low, high = np.full(of[-1] + 1, np.iinfo(np.int64).max), np.full(of[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, of, doc[heads])
            np.maximum.at(high, of, doc[heads])
            contested = heads[(low != high)[of]]
            # Equal ids may hold one run in several blocks; each of them is told what the first is told.
            same = ~lost & np.isin(run_of, run_of[contested])
            many = (np.bincount(of) > hot)[np.cumsum(new_anchor) - 1]
            for kind, which in ((0, np.flatnonzero(lost)), (1, np.flatnonzero(same & ~many)), (3, np.flatnonzero(same & many))):
                out = [(b, pack_planes(x[0], 4)) for b, x in common.by_bucket(block[which], [number[which]])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([kind] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "kind", "blob"])

    return common.arrow(common.dealt(sent, partitions), run, "block bigint, kind int, blob binary")


def beside(stored: DataFrame, told: DataFrame, partitions: int) -> DataFrame:
    """Each block's row behind what it is told, in one task."""
    none = F.lit(None).cast("binary")
    told = told.select("block", "kind", none.alias("ids"), none.alias("sizes"), F.col("blob").alias("payload"), none.alias("rest"))
    return told.unionByName(stored).repartition(partitions, "block").sortWithinPartitions("block", "kind")


def contested_runs(stored: DataFrame, told: DataFrame, buckets: int, partitions: int, span: int, gram: int) -> DataFrame:
    """bucket, block, n, blob: the bytes of contested runs, before and from their anchors, with the side they stand for: 0 for all
    windows, 1 for those with at least half of their other bytes on the left, 2 for the rest."""
    left_width, half = span - gram, (span - gram) // 2
    up = common.powers(span)[0]

    def context(text: np.ndarray) -> np.ndarray:
        return (text.astype(np.uint64) * up[: text.shape[1]]).sum(axis=1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_group(batches):
            if rows[-1][1] != 9 or len(rows) == 1:
                continue
            told = [(unpack_planes(r[4], len(r[4]) // 4, 4), r[1]) for r in rows[:-1]]
            numbers, kinds = np.concatenate([x for x, _ in told]), np.concatenate([np.full(len(x), k) for x, k in told])
            order = np.argsort(numbers, kind="stable")
            numbers, kinds = numbers[order], kinds[order]
            runs, _ = open_block(rows[-1][2], rows[-1][3], rows[-1][4], span, gram)
            anchor, at, first, last = (x[numbers] for x in (runs.anchor, runs.anchor_at, runs.first, runs.last))
            left, right = at - first, last + span - at
            padded = np.r_[np.zeros(left_width, np.uint8), runs.data, np.zeros(span, np.uint8)]
            wide = np.lib.stride_tricks.sliding_window_view(padded, left_width + span)[at]
            wide[:, :left_width][np.arange(left_width)[None] < (left_width - left)[:, None]] = 0
            wide[:, left_width:][np.arange(span)[None] >= right[:, None]] = 0
            out = []
            split = kinds == 3
            one, two = np.flatnonzero(split & (left >= half)), np.flatnonzero(split & (at - last < half))
            rows_of = np.r_[np.flatnonzero(~split), one, two]
            side = np.repeat(np.array([0, 1, 2], np.uint8), [int((~split).sum()), len(one), len(two)])
            key = np.r_[anchor[~split], common.mix(anchor[one] ^ context(wide[one, left_width - half : left_width])), common.mix(~anchor[two] ^ context(wide[two, left_width + gram : left_width + gram + half]))]
            for b, (i, x) in common.by_bucket((key % np.uint64(buckets)).astype(np.int64), [rows_of, side]):
                blob = x.tobytes() + pack_planes(runs.doc[numbers[i]]) + pack_planes(numbers[i], 4) + left[i].astype(np.uint8).tobytes() + right[i].astype(np.uint8).tobytes() + wide[i].tobytes()
                out.append((b, len(i), zstandard.ZstdCompressor(level=1).compress(blob)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "block", "n", "blob"])

    return common.arrow(beside(stored, told.where("kind in (1, 3)"), partitions), run, "bucket bigint, block bigint, n bigint, blob binary")


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 100_000):
        b = min(len(rows), a + 100_000)
        differ = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def window_owners(doc: np.ndarray, left: np.ndarray, right: np.ndarray, wide: np.ndarray, span: int, gram: int, offsets: range | None = None) -> np.ndarray:
    """For each run a mask of its windows (bit: bytes before the anchor, of ``offsets`` if given) that a smaller document also has."""
    width = span - gram
    n = len(doc)
    after = np.ascontiguousarray(wide[:, width:])
    order = np.argsort(after.view(np.dtype((np.void, span))).ravel(), kind="stable")  # the sampled suffix array
    lcp = np.minimum(common_prefixes(after[order]), np.r_[0, np.minimum(right[order][1:], right[order][:-1])])
    # Classes of equal left contexts, by bytes: sorted from the anchor outwards, cut where they differ.
    before = np.ascontiguousarray(wide[:, :width][:, ::-1])
    by_left = np.argsort(before.view(np.dtype((np.void, width))).ravel(), kind="stable")
    left_common = common_prefixes(before[by_left])
    place = np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    tree = np.array(list(intervals(lcp, gram)), np.int64).reshape(-1, 4)
    mask = np.zeros(n, np.uint64)
    for o in offsets if offsets is not None else range(width + 1):
        depth = span - o
        own = tree[(tree[:, 0] >= depth) & (tree[:, 3] < depth)]  # the intervals that are whole at this depth
        if not len(own):
            continue
        sizes = own[:, 2] - own[:, 1] + 1
        at = np.repeat(own[:, 1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        member, interval = order[at], np.repeat(np.arange(len(own)), sizes)
        fits = (left[member] >= o) & (right[member] >= depth)
        member, interval = member[fits], interval[fits]
        extension = np.cumsum(left_common < o)[place[member]]  # equal for members whose o bytes before the anchor are
        rank = np.lexsort((doc[member], extension, interval))
        member, interval, extension = member[rank], interval[rank], extension[rank]
        if not len(member):
            continue
        new = np.r_[True, (interval[1:] != interval[:-1]) | (extension[1:] != extension[:-1])]
        lowest = doc[member][new][np.cumsum(new) - 1]
        mask[member[doc[member] > lowest]] |= np.uint64(1 << o)
    return mask


def window_masks(sent: DataFrame, partitions: int, span: int, gram: int) -> DataFrame:
    """block, kind 2, blob: for contested runs the windows that a smaller document owns."""
    wide_n, half = 2 * span - gram, (span - gram) // 2
    sides = (None, range(half, span - gram + 1), range(half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches):
            parts = []
            for _, block, n, blob in rows:
                blob = zstandard.ZstdDecompressor().decompress(blob)
                cuts = np.cumsum([0, n, 8 * n, 4 * n, n, n, wide_n * n])
                x, d, s, lo, hi, text = (blob[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))
                parts.append((np.frombuffer(x, np.uint8), unpack_planes(d, n), unpack_planes(s, n, 4), np.frombuffer(lo, np.uint8).astype(np.int64), np.frombuffer(hi, np.uint8).astype(np.int64), np.frombuffer(text, np.uint8).reshape(n, wide_n), np.full(n, block)))
            side, doc, number, left, right, wide, block = (np.concatenate(x) for x in zip(*parts, strict=True))
            mask = np.zeros(len(doc), np.uint64)
            for x, offsets in enumerate(sides):
                own = np.flatnonzero(side == x)
                if len(own):
                    mask[own] = window_owners(doc[own], left[own], right[own], wide[own], span, gram, offsets)
            some = np.flatnonzero(mask)
            out = [(b, pack_planes(x[0], 4) + pack_planes(x[1])) for b, x in common.by_bucket(block[some], [number[some], mask[some]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([2] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "kind", "blob"])

    return common.arrow(common.dealt(sent, partitions), run, "block bigint, kind int, blob binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """All columns of docs (without with_text: the id alone), with n_bytes, n_removed, n_spans, kept_sha256 beside them and,
    with with_text, the text reduced to its kept bytes (a character that loses some of its bytes goes whole)."""
    spark = docs.sparkSession
    common.tune(spark)
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")] if with_text else []
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`") for c in others])
    parts = common.partitions_for(docs)
    buckets = 4 * parts
    stored = common.written(blocks(docs), "blocks")
    told = common.written(owners(anchors(stored, buckets, span, gram), 2 * parts, hot), "owners")
    common.release(spark)
    masks = common.written(window_masks(contested_runs(stored, told, buckets, parts, span, gram), 2 * parts, span, gram), "masks")
    common.release(spark)
    facts = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *([T.StructField("text", T.StringType())] if with_text else []), *[docs.schema[c] for c in others], *facts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches):
            if rows[-1][1] != 9:
                continue
            runs, offsets = open_block(rows[-1][2], rows[-1][3], rows[-1][4], span, gram)
            lost = np.concatenate([np.zeros(0, np.int64)] + [unpack_planes(r[4], len(r[4]) // 4, 4) for r in rows[:-1] if r[1] == 0])
            some = [(unpack_planes(r[4][: 4 * n], n, 4), unpack_planes(r[4][4 * n :], n, 8, np.uint64)) for r in rows[:-1] if r[1] == 2 for n in (len(r[4]) // 12,)]
            masked = tuple(np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            gone = runs.removed(lost, masked)
            total = np.r_[0, np.cumsum(gone)]
            starts = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
            starts[offsets[:-1][offsets[:-1] < len(gone)]] = gone[offsets[:-1][offsets[:-1] < len(gone)]]
            spans = np.r_[0, np.cumsum(starts)]
            sums, texts = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                kept = runs.data[a:b]
                if total[b] > total[a]:
                    kept = kept[~gone[a:b]]
                kept = kept.tobytes()
                sums.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            rest = pa.ipc.open_stream(rows[-1][5]).read_all().combine_chunks()
            columns = [rest.column("doc_id"), *([pa.array(texts, pa.string())] if with_text else []), *[rest.column(c) for c in others], pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(sums, pa.string())]
            yield from pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches()

    return common.arrow(beside(stored, told.where("kind = 0").unionByName(masks), parts), run, schema)

