"""N-gram Jaccard join by parity sketches.

A document's set is its distinct ``n``-word shingles (64-bit hashes). XOR-hashing the set into ``m`` parts gives a sketch in
which a part is the XOR of its shingles' hashes; parts that differ between two sketches are at most as many as the sets'
symmetric difference, so sketch distance bounds set distance from below. Documents of equal sets are one class, met by an
aggregate; the join is between classes.

Candidates. For sizes a <= b with Jaccard >= 3/4 the symmetric difference is at most (a + b) / 7 <= max(a, b) / 3.5, so of m
parts at least m - (a + b) / 7 agree (pigeonhole). m is fixed by the size band; a set joins its own band and, if it is
small enough for a partner there, the band below. Parts that are empty can't be joined on: with e of them a
document needs only agree on ``s = m - t - e`` full parts, t its own bound, so its first ``full - s + 1`` parts in one global order
must hold a common one (prefix filter). The order puts parts of several shingles first, parts that only hold shingles
frequent in a bounded sample last; it decides speed only, any order is exact. The rare sets with s < 1 also send their
shingles as keys, on which any two such sets that link meet.

Links. Equal part keys form groups, whose ids become their classes'; each gives its smallest id's class, the centre, with the
others, a star. Both members of every link stand in some star. In each star, members that sizes and bit sketches (popcount of
the XOR of two parity sketches, a lower bound of the symmetric difference) allow no link with any other are dropped; of the
rest the whole texts meet, all with all, as one product of matrices. What comes out is a count of links for each member and
a tree for each connected part, so no table holds all pairs of a group of copies. A star of more than ``STAR`` members
(``TEXTS`` for texts) is compared in blocks, each two blocks a unit of work. A pair that meets in several stars counts in
the one of the smallest centre.

Defined results: null, empty or blank text has no shingles and links with nothing; with fewer than n words the whole
sequence is one shingle; rows with equal doc_id are one document, which links whatever any of its texts links, and each give
a row with its own n_shingles; rows with a null doc_id link with nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N = 5
#: Ratio of band limits, documents of the sample for hot shingles, sampled documents that make one hot, hot shingles kept,
#: members of a star that are compared at once by sketches, and by texts.
BAND, SAMPLE, HOT, HOT_KEPT, STAR, TEXTS = 2.0, 4000, 3, 200_000, 4096, 512
#: Keys held before they are handed to their buckets.
HELD = 750_000
#: Requests for texts that are broadcast (about 50 bytes a request, of more centres more).
ASKED = 250_000
#: Edges that one task may finish alone.
LOCAL = 200_000
_WORD = common.blank_words()
_VALUES = common.byte_values(7, fold_case=True)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, each row's ascending, and the row's offsets in them."""
    rows_n = len(offsets) - 1
    starts, ends, rows = common.word_spans(data, offsets, _WORD)
    words = common.range_hashes(common.prefix_sums(_VALUES[data]), starts, ends)
    counts = np.bincount(rows, minlength=rows_n)
    first = np.r_[0, np.cumsum(counts)]
    sums = common.prefix_sums(words)
    at = np.arange(len(words))
    upto = first[1:][rows] if len(rows) else at
    full = at + n <= upto
    short = np.flatnonzero((counts > 0) & (counts < n))
    a = np.r_[at[full], first[short]]
    hashes = common.range_hashes(sums, a, np.r_[at[full] + n, first[short] + counts[short]])
    of = np.r_[rows[full], short]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(rows_n + 1))


def bands(size: int | np.ndarray):
    """The band of a set of that size: limits are powers of BAND."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


def parts_of(band: int) -> int:
    """Parts for sets of this band and their partners above it: about 2 shingles a part at the largest, so that (but for
    few sets) more parts are full than may differ."""
    return max(4, int(np.ceil(BAND ** (band + 1) * 4 / 3 / 2)))


def part_keys(hashes: np.ndarray, size: int, band: int, hot: np.ndarray) -> np.ndarray:
    """Keys of the parts on which this set must meet any partner in the band."""
    m = parts_of(band)
    part = ((hashes >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, values = part[order], common.mix(hashes[order] * np.uint64(0x9E3779B97F4A7C15))
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    parity = np.bitwise_xor.reduceat(values, cuts)
    full = len(cuts)
    t = size // 3  # (a + b) / 7 with b <= 4a / 3
    s = m - t - (m - full)
    if s < 1:  # too many shingles fell together: by its own count no full part need agree, so such sets join on shingles
        own = common.mix(hashes ^ np.uint64(0xA0761D6478BD642F + band))
    keys = common.mix(parity ^ (part[cuts].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(band + 1))
    if s <= 1:
        return keys if s == 1 else np.r_[keys, own]
    many = np.diff(np.r_[cuts, len(part)])
    rank = np.where(many > 1, 0, 1)
    if len(hot):
        known = hot[np.minimum(np.searchsorted(hot, hashes[order]), len(hot) - 1)] == hashes[order]
        rank = rank + 2 * np.logical_and.reduceat(known, cuts)
    return keys[np.lexsort((keys, rank))[: full - s + 1]]


def bit_sketch(hashes: np.ndarray, times: int = 1) -> bytes:
    """The parity sketch: bit h is the parity of the shingles that hash to it. It is ``times`` a power of two of bits that
    is at least the set's size, and 64; the wider, the closer its distance comes to the sets'."""
    bits = times << max(6, (len(hashes) - 1).bit_length())
    at = (common.mix(hashes) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def linked_sizes(a, b, both):
    return 100 * both >= 75 * (a + b - both)


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.only(docs, id_col, text_col).toDF("doc_id", "text")


def digests(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (a 128-bit hash of the set) and wide (its sketch, of twice the bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            sizes, h1, h2, wides = [], [], [], []
            for a, b in common.slices(offsets):
                hashes, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                x = np.r_[np.uint64(0), np.cumsum(common.mix(hashes), dtype=np.uint64)]
                y = np.r_[np.uint64(0), np.cumsum(common.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
                sizes.append(np.diff(at))
                h1.append(x[at[1:]] - x[at[:-1]])
                h2.append(y[at[1:]] - y[at[:-1]])
                for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    wides.append(bit_sketch(hashes[i:j], 2) if j > i else b"")
            join = lambda parts, kind: pa.array(np.concatenate(parts).view(kind) if parts else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), join(sizes, np.int64), join(h1, np.int64), join(h2, np.int64), pa.array(wides, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "wide"])

    kind = docs.schema[0].dataType.simpleString()
    return common.arrow(docs, run, f"doc_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, wide binary")


def hot_shingles(docs: DataFrame, rows: int, n: int = N) -> np.ndarray:
    """Shingles of at least HOT documents in a sample of about SAMPLE of ``rows``, at most HOT_KEPT; only an order follows."""
    share = min(1.0, SAMPLE / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            for a, b in common.slices(offsets):
                values, counts = np.unique(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

    counted = common.arrow(sample, run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    found = counted.orderBy(F.desc("n"), "shingle").limit(HOT_KEPT).select("shingle").toArrow()
    return np.sort(found.column(0).combine_chunks().to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane: equal high bytes then compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(blob: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(kind).ravel()


def key_blobs(docs: DataFrame, buckets: int, hot: np.ndarray, n: int = N) -> DataFrame:
    """bucket, keys, ids: part keys of all documents, packed by bucket; equal sets are sent once from a task's hold."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            out = list(common.by_bucket((k % np.uint64(buckets)).astype(np.int64), [k, i]))
            keys.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([planes(x[0]) for _, x in out], pa.binary()), pa.array([planes(x[1]) for _, x in out], pa.binary())], names=["bucket", "keys", "ids"])

        seen: set[int] = set()
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            names = batch.column(0).to_numpy()
            for a, b in common.slices(offsets):
                hashes, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                for row in range(b - a):
                    own = hashes[at[row] : at[row + 1]]
                    size = len(own)
                    if not size:
                        continue
                    mark = hash((size, int(common.mix(own).sum(dtype=np.uint64))))
                    if mark in seen:
                        continue
                    seen.add(mark)
                    band = int(bands(size))
                    for g in {band, int(bands(size * 3 / 4 - 1e-6)) if size > 1 else band}:
                        k = part_keys(own, size, g, shared.value)
                        keys.append(k)
                        ids.append(np.full(len(k), names[a + row], np.int64))
                        held += len(k)
                if held >= HELD:
                    yield flush()
                    held = 0
                    seen.clear()
        if keys:
            yield flush()

    return common.arrow(docs, run, "bucket bigint, keys binary, ids binary")


def stars(blobs: DataFrame, partitions: int) -> DataFrame:
    """a, b: the smallest id of each group of equal keys with every other one; each pair once a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blobs_k: list[bytes], blobs_i: list[bytes]) -> Iterator[pa.RecordBatch]:
            k = np.concatenate([from_planes(x, np.uint64) for x in blobs_k])
            i = np.concatenate([from_planes(x) for x in blobs_i])
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.r_[True, k[1:] != k[:-1]]
            centre = i[new][np.cumsum(new) - 1]
            some = centre != i
            centre, i = centre[some], i[some]
            order = np.lexsort((i, centre))
            centre, i = centre[order], i[order]
            new = np.r_[True, (centre[1:] != centre[:-1]) | (i[1:] != i[:-1])][: len(i)]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(centre[new]), pa.array(i[new])], names=["a", "b"])

        at, blobs_k, blobs_i = None, [], []
        for batch in batches:
            for bucket, k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != at and blobs_k:
                    yield from done(blobs_k, blobs_i)
                    blobs_k, blobs_i = [], []
                at = bucket
                blobs_k.append(k)
                blobs_i.append(i)
        if blobs_k:
            yield from done(blobs_k, blobs_i)

    return common.arrow(common.dealt(blobs, partitions), run, "a bigint, b bigint")


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, on the narrower one's width: at most the symmetric difference of the sets."""
    size = min(len(x), len(y))
    x, y = (z if len(z) == size else narrow(z, size) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def narrow(x: np.ndarray, size: int) -> np.ndarray:
    """Bits are numbered by a hash's low bits, so a sketch of half the width is the XOR of the two halves."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def forest(edges: DataFrame) -> DataFrame:
    """u, v: in each task, every node with a smaller one joins the smallest of its part of the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = parent[up] = parent.setdefault(up, up)
                i = parent[i]
            return i

        def flush() -> pa.RecordBatch:
            pairs = [(i, r) for i in list(parent) if (r := root(i)) != i]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 2 * LOCAL:
                yield flush()
        yield flush()

    return common.arrow(edges.select("u", "v"), run, "u bigint, v bigint")


def components(edges: DataFrame, local: int = LOCAL, most: int = 60) -> DataFrame:
    """doc_id, component_id (smallest id reached) of every document on an edge.

    Each task first turns its edges into a forest. While more than ``local`` edges are left, rounds of large and small stars
    follow, each a table in the shared folder; a rest of at most ``local`` edges is one task's work, of a bounded size."""
    edges = common.written(forest(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")), "edges")
    before = None
    for _ in range(most):
        size = edges.count()
        if size <= local:
            last, edges = edges, common.written(forest(edges.coalesce(1)), "edges")
            common.dropped(last)
            break
        # Large star: all larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: all smaller neighbours of u, and u, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        last, edges = edges, common.written(small, "edges")
        common.dropped(last)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())


def blocked(members: DataFrame, most: int) -> DataFrame:
    """members (a, b, ...) in blocks of about ``most`` of a star, each once for every block it meets: with x <= y, the unit's
    blocks, and block, its own."""
    sizes = members.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("k"))
    rows = members.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("k", "other")


def partnered(members: DataFrame, digest: DataFrame, partitions: int) -> DataFrame:
    """The members (a, b) that sizes and sketches allow a link with some other member of their star a."""
    rows = blocked(members, STAR).join(digest.select(F.col("doc_id").alias("b"), "n_shingles", "wide"), "b").select("a", "x", "y", "block", "b", "n_shingles", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(a: int, group: list[tuple]) -> pa.RecordBatch:
            group.sort(key=lambda r: (r[2], r[1]))
            blocks, ids, sizes = (np.array([r[i] for r in group], np.int64) for i in range(3))
            several = len(np.unique(blocks)) > 1  # two blocks: only pairs between them, each block has a unit of its own
            stop = np.searchsorted(sizes, sizes * 4 // 3, "right")  # partners above in size
            wide = [np.frombuffer(r[3], np.uint8) for r in group]
            least = np.stack([narrow(x, len(wide[0])) for x in wide])  # all on the smallest set's width
            kept = np.zeros(len(group), bool)
            for r in range(len(group) - 1):
                far = slice(r + 1, int(stop[r]))
                fits = ~kept[far] if kept[r] else np.ones(int(stop[r]) - r - 1, bool)
                if several:
                    fits &= blocks[far] != blocks[r]
                if not fits.any():
                    continue
                apart = np.bitwise_count(least[far] ^ least[r]).sum(1)
                for o in (np.flatnonzero(fits & (apart * 7 <= sizes[far] + sizes[r])) + r + 1).tolist():
                    if not (kept[r] and kept[o]) and distance(wide[r], wide[o]) * 7 <= sizes[r] + sizes[o]:
                        kept[r] = kept[o] = True
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), a, np.int64)), pa.array(ids[kept])], names=["a", "b"])

        at, group = None, []
        for batch in batches:
            for a, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, x, y) != at and group:
                    yield found(at[0], group)
                    group = []
                at = (a, x, y)
                group.append(row)
        if group:
            yield found(at[0], group)

    rows = rows.repartition(partitions, "a", "x", "y").sortWithinPartitions("a", "x", "y")
    return common.arrow(rows, run, "a bigint, b bigint").distinct()


def overlaps(values: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many values the sets ``left`` share with the sets ``right``, all with all; each set's values are distinct."""
    out = np.zeros((len(left), len(right)), np.float32)  # counts below 2**24 are exact
    flat = np.concatenate(values)
    _, of, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(values)), [len(v) for v in values]), times[of] > 1
    column, owner = (np.cumsum(times > 1) - 1)[of[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(values), min(width, int(column[-1]) + 1 - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        out += held[left] @ held[right].T
    return out.astype(np.int64)


def trees(linked: np.ndarray) -> list[tuple[int, int]]:
    """(root, other) of every part of a symmetric matrix of links."""
    left, out = np.ones(len(linked), bool), []
    for root in np.flatnonzero(linked.any(1)).tolist():
        new = np.array([root]) if left[root] else []
        left[root] = False
        while len(new):
            new = np.flatnonzero(linked[new].any(0) & left)
            left[new] = False
            out += [(root, int(o)) for o in new]
    return out


def star_links(members: DataFrame, docs: DataFrame, partitions: int, n: int = N) -> DataFrame:
    """u, v, n: trees of the links (u, v) that members' whole texts make in each unit, with n 0; and rows (u, u) with the number n
    of links of u in a unit. A pair that meets in several stars is taken in that of the smallest centre."""
    centres = members.groupBy("b").agg(F.collect_set("a").alias("centres"))
    rows = blocked(members, min(STAR, TEXTS)).join(centres, "b").select("a", "x", "y", "block", F.col("b").alias("doc_id"), F.filter("centres", lambda c: c < F.col("a")).alias("centres"))
    # Few enough requests (counted) go to the texts; more of them meet the texts in a shuffle.
    asked = rows.agg(F.sum(1 + F.size("centres") / 4)).first()[0] or 0
    sent = (F.broadcast(rows) if asked <= ASKED else rows).join(docs, "doc_id").select("a", "x", "y", "block", "doc_id", "centres", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: list[tuple]) -> pa.RecordBatch:
            blocks, ids = (np.array([r[i] for r in group], np.int64) for i in range(2))
            sizes = np.array([len(r[3]) for r in group], np.int64)
            several = len(np.unique(blocks)) > 1
            one = np.flatnonzero(blocks == blocks[0]) if several else np.arange(len(group))
            two = np.flatnonzero(blocks != blocks[0]) if several else one
            both = overlaps([r[3] for r in group], one, two)
            fits = linked_sizes(sizes[one][:, None], sizes[two][None, :], both) & (both > 0) & (ids[one][:, None] != ids[two][None, :])
            fits &= overlaps([np.array(r[2], np.int64) for r in group], one, two) == 0
            linked = np.zeros((len(group), len(group)), bool)
            linked[np.ix_(one, two)] = fits
            linked[np.ix_(two, one)] |= fits.T
            counts, edges = linked.sum(1), trees(linked)
            some = np.flatnonzero(counts)
            u = np.r_[ids[some], ids[[i for i, _ in edges]]] if edges else ids[some]
            v = np.r_[ids[some], ids[[j for _, j in edges]]] if edges else ids[some]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.r_[counts[some], np.zeros(len(edges), np.int64)])], names=["u", "v", "n"])

        at, group = None, []
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(6))
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            blocks, ids, lists = (batch.column(c).to_pylist() for c in (3, 4, 5))
            for lo, hi in common.slices(offsets):
                hashes, cuts = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                for row in range(lo, hi):
                    if keys[row] != at and group:
                        yield found(group)
                        group = []
                    at = keys[row]
                    group.append((blocks[row], ids[row], lists[row], hashes[cuts[row - lo] : cuts[row - lo + 1]].copy()))
        if group:
            yield found(group)

    return common.arrow(sent.repartition(partitions, "a", "x", "y").sortWithinPartitions("a", "x", "y"), run, "u bigint, v bigint, n bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set), n_links (other classes that the class links)."""
    common.tune(docs.sparkSession)
    docs = documents(docs, id_col, text_col)
    if docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        return joined(docs, n)
    # Repeated ids: rows are numbered and compared as they are; those of one id are then tied together.
    rows = common.written(docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    names = rows.where("row is not null").select("row", "doc_id")
    first = names.groupBy("doc_id").agg(F.min("row").alias("a"), F.count("*").alias("k")).where("k > 1").select("doc_id", "a")
    found = joined(rows.select(F.col("row").alias("doc_id"), "text"), n, names.join(first, "doc_id").where("row != a").select("a", F.col("row").alias("b")))
    found = common.written(found.withColumnRenamed("doc_id", "row").join(names, "row", "left"), "rows-joined")
    least = lambda by, name: found.groupBy(by).agg(F.min("doc_id").alias(name))
    out = found.join(least("component_id", "c"), "component_id", "left").join(least("class_id", "k"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.col("c").alias("component_id"), F.col("k").alias("class_id"), "n_links")


def joined(docs: DataFrame, n: int, tied: DataFrame | None = None) -> DataFrame:
    """The same for documents with distinct ids; tied pairs (a, b) count as one document."""
    parts = common.partitions_for(docs)
    stored = common.written(digests(docs, n), "digests")
    docs = docs.where(F.col("doc_id").isNotNull())
    named = stored.where("n_shingles > 0 and doc_id is not null")
    classes = stored.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    same = common.written(named.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "class_id"), "classes")
    candidates = common.written(stars(key_blobs(docs, 8 * parts, hot_shingles(docs, stored.count(), n), n), parts).distinct(), "stars")
    common.release(docs.sparkSession)
    pairs = candidates.join(same.toDF("a", "ca"), "a").join(same.toDF("b", "cb"), "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    members = common.written(pairs.unionByName(pairs.select("a", F.col("a").alias("b"))).distinct(), "members")
    common.dropped(candidates)
    near = common.written(partnered(members, named.select("doc_id", "n_shingles", "wide"), parts), "partnered")
    common.dropped(members)
    common.release(docs.sparkSession)
    links = common.written(star_links(near, docs, parts, n), "links")
    common.dropped(near)
    common.release(docs.sparkSession)
    edges = links.where("u != v").select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(same.where("doc_id != class_id").toDF("a", "b"))
    labels = common.written(components(edges if tied is None else edges.unionByName(tied)), "labels")
    n_links = links.where("n > 0").groupBy(F.col("u").alias("class_id")).agg(F.sum("n").alias("n_links"))
    found = stored.select("doc_id", "n_shingles", "h1", "h2").join(classes.join(n_links, "class_id", "left"), ["h1", "h2", "n_shingles"], "left").join(labels, "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
