import random

from folioweave.llm import decontaminate as d


def case(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "c1", "é", "dd", "ee", "ff", "x"]
    text = lambda n: rng.choice(["", "  ", "..."]) + "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(14)] + [(99, None), (100, "same item of some ten words that stand in both here"), (101, "same item of some ten words that stand in both here")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)] + [(500, None), (501, "...")]
    docs += [(600 + i, text(5) + t.upper().replace("É", "é") + text(3)) for i, t in items if t]
    docs += [(700, "y " * 3000 + " ".join(rng.choice(words) for _ in range(3000))), (700, "repeated row x"), (700, "repeated row x")]
    return docs, items


def check(spark, docs, items, **more):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(df, bench, **more)
    got = sorted((r.doc_id, r.n_words, len(r.hit_words), len(r.items)) for r in found.collect())
    assert got == sorted(x[:4] for x in d.brute_force(docs, items))
    return df, bench


def test_against_brute_force(spark):
    docs, items = case(1)
    df, bench = check(spark, docs, items)
    got = sorted(map(tuple, d.contamination_digest(df, bench).collect()))
    assert got == sorted(d.brute_force(docs, items))


def test_blocks_of_the_benchmark(spark):
    check(spark, *case(2), block_bytes=120)


def test_nothing(spark):
    docs, items = case(3)
    check(spark, docs, [])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.contamination_digest(df, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_winnow_guarantee():
    import numpy as np

    rng = np.random.default_rng(4)
    grams = rng.integers(0, 50, 400).astype(np.uint64)
    kept = set(d.winnow(grams, 6).tolist())
    for i in range(len(grams) - 5):
        part = grams[i : i + 6]
        assert all(i + j in kept for j in range(6) if part[j] == part.min())
