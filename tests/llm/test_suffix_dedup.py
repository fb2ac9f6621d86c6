import hashlib
import random

import numpy as np

from folioweave.llm import suffix_dedup as sd


def brute(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - span + 1):
                w = b[p : p + span]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for p in range(len(b) - span + 1):
                if first[b[p : p + span]] < i:
                    gone[p : p + span] = True
        gone = gone[:-1]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=80):
    rng = random.Random(seed)
    syllables = ["the ", "th", "an", "in", "é", "er", "ou ", ". ", "on", "\n", "🙂"]
    text = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    passages = [text(rng.choice([20, 25, 40, 90])) for _ in range(6)]
    rows = [None, "", "short", "ab" * 400, "ab" * 300, "a" * 1000, "x" * 49, "x" * 50, "x" * 51]
    for _ in range(n):
        t = text(rng.choice([5, 30, 100, 400]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(passages) + t[at:]
        rows.append(t)
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(t))
            rows.append(rng.choice([t, t[:at] + "!" + t[at:], t[at:] + t[:at], t[:at]]))
    rng.shuffle(rows)
    return [(rng.randrange(10**6) if rng.random() < 0.9 else 7, t) for t in rows]


def run(spark, rows, partitions=6):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, n_bytes int").repartition(partitions)
    got = sd.remove_repeats(df, with_text=False)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)
    rows = corpus(2, 40) + [(None, t) for _, t in corpus(2, 8)[:6]]
    assert run(spark, rows, 20) == brute(rows)


def test_hot_anchors_are_split(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    texts = ["".join(word() for _ in range(4)) for _ in range(8)]
    phrase = "the one phrase that stands everywhere, "
    rows = [(i, rng.choice(texts)[-rng.randrange(1, 40) :] + phrase + rng.choice(texts)[: rng.randrange(1, 40)]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for hot in (1, 5, 10**6):
        got = sd.remove_repeats(df, with_text=False, hot=hot).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_texts_and_columns_pass(spark):
    passage = "".join(random.Random(4).choice("abcdefghij é") for _ in range(120))
    rows = [(5, "start " + passage + " end", None), (3, passage, "x"), (9, "own text", "y")]
    df = spark.createDataFrame([(t, s, i, 2) for i, t, s in rows], "text string, source string, doc_id long, kind int")
    got = {r.doc_id: r for r in sd.remove_repeats(df).collect()}
    assert got[5].text == "start  end" and got[3].text == passage and got[9].source == "y" and got[5].kind == 2 and got[5].source is None
    assert sd.remove_repeats(df.where("false")).count() == 0


def test_window_owners_by_brute_force():
    rng = random.Random(8)
    span, gram = 12, 5
    for _ in range(60):
        n = rng.randrange(2, 40)
        rows = []
        for _ in range(n):
            anchor = rng.choice([b"ANCHR", b"ANCHS"])
            lo, hi = rng.randrange(0, 8), 0
            hi = rng.randrange(max(gram, span - lo), span + 1)
            rows.append((rng.randrange(5), bytes(rng.choice(b"ab") for _ in range(lo)), anchor + bytes(rng.choice(b"ab") for _ in range(hi - gram))))
        wide = np.zeros((n, 2 * span - gram), np.uint8)
        for i, (_, lo, hi) in enumerate(rows):
            wide[i, span - gram - len(lo) : span - gram] = list(lo)
            wide[i, span - gram : span - gram + len(hi)] = list(hi)
        got = sd.window_owners(np.array([r[0] for r in rows]), np.array([len(r[1]) for r in rows]), np.array([len(r[2]) for r in rows]), wide, span, gram)
        first = {}
        for d, lo, hi in rows:
            for o in range(span - gram + 1):
                if len(lo) >= o and len(hi) >= span - o:
                    w = (o, lo[len(lo) - o :] + hi[: span - o])
                    first[w] = min(first.get(w, d), d)
        for (d, lo, hi), bits in zip(rows, got.tolist(), strict=True):
            for o in range(span - gram + 1):
                want = len(lo) >= o and len(hi) >= span - o and first[o, lo[len(lo) - o :] + hi[: span - o]] < d
                assert bool(bits >> o & 1) == want


def test_maximal_repeats_by_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 14))) for _ in range(3)]
        least = 2
        places = {}
        for t, x in enumerate(texts):
            for i in range(len(x)):
                for j in range(i + least, len(x) + 1):
                    places.setdefault(x[i:j], []).append((t, i))
        want = []
        for s, at in places.items():
            if len(at) < 2:
                continue
            before = {texts[t][i - 1 : i] or t for t, i in at} if all(i for _, i in at) else {1, 2}
            after = {texts[t][i + len(s) : i + len(s) + 1] or (t, i) for t, i in at}
            if len(before) > 1 and len(after) > 1:
                want.append((len(s), sorted(at)))
        assert sorted((n, sorted(p)) for n, p in sd.repeat_groups(texts, least)) == sorted(want)
    assert sd.repeat_groups([], 5) == [] and sd.repeat_groups([b""], 5) == []
