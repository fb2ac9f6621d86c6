import random

import numpy as np
import pyarrow as pa

from folioweave.llm import common
from folioweave.llm import near_duplicates as nd


def sets(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    found = [(i, sets(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(found):
        for j, b in found[x + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                u, v = sorted((root(i), root(j)))
                parent[v] = u
    return sorted((i, len(a), root(i)) for i, a in found)


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)] + ["É", "x,", "The"]
    line = " ".join(rng.choice(words) for _ in range(30))
    rows = [None, "", " \n", "one", "ONE", "a b c d", "a b c D", "a b c d e", "x " * 500]
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 200, 700]))]
        if rng.random() < 0.4:
            text = text[: len(text) // 2] + line.split() + text[len(text) // 2 :]
        rows.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(text)
            for _ in range(rng.randrange(0, max(1, len(near) // 15) + 1)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append("  ".join(near) if rng.random() < 0.3 else " ".join(near).upper().replace("É", "É"))
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(14):  # links only from one to the next
        chain = chain[3:] + [rng.choice(words) for _ in range(3)]
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = nd.near_duplicates(df).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_against_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(nd, "STAR", 7)  # stars are compared in blocks
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, "same text of several words in every copy here") for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nd.near_duplicates(df).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 2, "None")]
    assert nd.near_duplicates(df.where("false")).count() == 0


def test_linked_sets_share_a_key_and_sketch_bounds():
    rng = np.random.default_rng(2)
    for _ in range(400):
        size = int(rng.choice([1, 2, 3, 4, 5, 8, 15, 16, 17, 40, 64, 70, 250, 256, 300, 341]))
        a = np.sort(rng.integers(0, 1 << 63, size).astype(np.uint64))
        lost = int(rng.integers(0, size // 7 + 1))
        b = np.sort(np.r_[a[rng.permutation(size)[: size - lost]], rng.integers(0, 1 << 63, int(rng.integers(0, size // 7 + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        x, y = nd.bit_sketch(a), nd.bit_sketch(b)
        assert nd.distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= len(a) + len(b) - 2 * both
        if not nd.linked_sizes(len(a), len(b), both):
            continue
        keys = [set() for _ in range(2)]
        for k, s in zip(keys, (a, b), strict=True):
            for g in {int(nd.bands(len(s))), int(nd.bands(len(s) * 3 / 4 - 1e-6)) if len(s) > 1 else int(nd.bands(len(s)))}:
                k.update(nd.part_keys(s, len(s), g, np.zeros(0, np.uint64)).tolist())
        assert keys[0] & keys[1]


def test_shingles_of_rows():
    data, offsets = common.text_buffer(pa.array(["a b c d e f", None, "A B C D E F", "x"]))
    hashes, at = nd.shingle_sets(data, offsets)
    assert np.diff(at).tolist() == [2, 0, 2, 1] and (hashes[:2] == hashes[2:4]).all()


def test_components_by_stars(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {i: root(i) for e in edges if e[0] != e[1] for i in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for local in (5, 10**6):
        assert {r.doc_id: r.component_id for r in nd.components(df, local).collect()} == want


def test_links_of_each_class(spark, monkeypatch):
    monkeypatch.setattr(nd, "STAR", 7)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = corpus(4, 30)
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows += [(5000 + i, " ".join(t)), (6000 + i * 7 % 60, " ".join(t).upper())]
    classes = {}
    for i, t in rows:
        if s := sets(t):
            classes.setdefault(frozenset(s), []).append(i)
    want = {}
    for s, ids in classes.items():
        n = sum(s is not o and 100 * len(s & o) >= 75 * len(s | o) for o in classes)
        want |= {i: (min(ids), n) for i in ids}
    for partitions in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicates(df).collect()}
        assert got == {i: want.get(i, (i, 0)) for i, _ in rows}
