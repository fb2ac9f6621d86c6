"""Each registered query over its whole smallest table against a brute-force version, and the pipeline stage by stage."""

import hashlib
import math
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
import sentencepiece
from test_html_text import brute as html_brute
from test_near_duplicates import brute as near_brute
from test_neighbours import brute as neighbour_brute
from test_suffix_dedup import brute as repeat_brute
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from folioweave.llm import common, decontaminate, language_id, licenses

DIR = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def run(spark):
    found = __spark_entry__.queries()
    return lambda name: found[next(n for n in found if n.startswith(name))](spark, DIR).collect()


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in table("documents")]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_op1(run):
    pages = [(r["page_id"], r["url"], r["html"]) for r in table("pages")]
    texts = html_brute([p[1:] for p in pages])
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in run("op1_")) == sorted((i, u, t, len(t)) for (i, u, _), t in zip(pages, texts, strict=True))


def test_op2(run, docs):
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run("op2_")) == repeat_brute(docs)


def test_op3(run, docs):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    assert sorted(map(tuple, run("op3_"))) == sorted(decontaminate.brute_force(docs, items))


def test_op4(run, docs):
    library = Tokenizer.from_file(common.tokenizer_file("byte_bpe_50k.json"))
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, run("op4_"))) == sorted(want)


def test_op5(run):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in table("pages")]
    last = {}
    for i, raw in pages:
        if len(raw) >= 1000:
            last[raw] = max(i, last.get(raw, i))
    want = [(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if last.get(raw, i) != i else "response", last[raw] if last.get(raw, i) != i else None) for i, raw in pages]
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run("op5_")) == sorted(want)


def test_op6(run):
    want = neighbour_brute([(r["vec_id"], r["embedding"]) for r in table("embeddings")], 20)
    got = {}
    for r in run("op6_"):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(got[q]) & {j for j, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_op7(run, docs):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in run("op7_")) == near_brute(docs)


def test_op8(run):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    assert sorted(map(tuple, run("op8_"))) == sorted(con.execute(licenses.oracle()).fetchall())


def test_op9(run, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_file("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in docs]
    assert sorted(map(tuple, run("op9_"))) == sorted(want)


def brute_languages(docs, lang):
    """Predictions by expectation-maximisation and forward sums over plain lattices, one word after another."""
    pieces = language_id.vocabulary(common.tokenizer_file("piece_bpe_32k.model"))
    names = list(pieces)
    words = {}
    for i, t in docs:
        if lang[i] is not None and t is not None and not language_id.is_held_out(i):
            words.setdefault(lang[i], Counter()).update(language_id.WORD.findall(t.lower()))
    langs, floor, most = sorted(words), math.exp(language_id.UNKNOWN), max(map(len, names))
    arcs = lambda w: [(a, b, w[a:b]) for b in range(1, len(w) + 1) for a in range(max(0, b - most), b) if w[a:b] in pieces]

    def forward(w, p):
        f = [1.0] + [0.0] * len(w)
        found = iter(arcs(w))
        a, b, piece = next(found, (0, 0, ""))
        for j in range(1, len(w) + 1):
            f[j] = f[j - 1] * floor
            while b == j:
                f[j] += f[a] * p[piece]
                a, b, piece = next(found, (0, 0, ""))
        return f

    table = {x: dict.fromkeys(names, 1 / len(names)) for x in langs}
    for _ in range(language_id.ROUNDS):
        for x in langs:
            p, counts = table[x], dict.fromkeys(names, language_id.PRIOR)
            for w, n in words[x].items():
                w = "▁" + w
                f, g = forward(w, p), [0.0] * len(w) + [1.0]
                back = sorted(arcs(w), reverse=True)
                at = 0
                for a in range(len(w) - 1, -1, -1):
                    g[a] = g[a + 1] * floor
                    while at < len(back) and back[at][0] == a:
                        g[a] += p[back[at][2]] * g[back[at][1]]
                        at += 1
                for a, b, piece in back:
                    counts[piece] += n * f[a] * p[piece] * g[b] / f[-1]
            total = sum(counts.values())
            table[x] = {k: v / total for k, v in counts.items()}
    scores, out = {}, {}
    for i, t in docs:
        found = language_id.WORD.findall((t or "").lower())
        total = [0.0] * len(langs)
        for w in found:
            if w not in scores:
                scores[w] = [math.log(forward("▁" + w, table[x])[-1]) for x in langs]
            total = [y + s / math.sqrt(len(found)) for y, s in zip(total, scores[w], strict=True)]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out[i] = (langs[best], 1 / sum(math.exp(y - total[best]) for y in total)) if found else ("und", 0.0)
    return out


def test_op10(run, docs):
    lang = {r["doc_id"]: r["lang"] for r in table("documents")}
    want = brute_languages(docs, lang)
    got = run("op10_")
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == language_id.is_held_out(r.doc_id) and r.lang_pred == want[r.doc_id][0]
        assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-6)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_pipeline_by_brute_force(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    got = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [tuple(r) for r in got.select(names).collect()]
    for (name, stage), step in zip(corpus_pipeline.STAGES, range(5), strict=True):
        got = common.written(stage(spark, got, DIR), name)
        out = got.collect()
        if step == 0:
            rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
        elif step == 1:
            rows = [r for r, c in zip(sorted(rows), near_brute([(r[0], r[1]) for r in sorted(rows)]), strict=True) if c[2] == r[0]]
        elif step == 2:
            kept = {int(i): (n, gone) for i, n, gone, *_ in repeat_brute([(r[0], r[1]) for r in rows])}
            texts = {r.doc_id: r.text for r in out}
            assert all(len(t.encode()) <= kept[i][0] - kept[i][1] < len(t.encode()) + 8 or kept[i][1] for i, t in texts.items())
            assert all(texts[r[0]] == r[1] for r in rows if not kept[r[0]][1])
            rows = [(r[0], texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in rows]
        elif step == 3:
            hit = {x[0] for x in decontaminate.brute_force([(r[0], r[1]) for r in rows], [(r["item_id"], r["text"]) for r in table("benchmark")]) if x[2] >= corpus_pipeline.LEAST_HIT_WORDS}
            rows = [r for r in rows if r[0] not in hit]
        assert sorted(tuple(r)[:5] for r in out) == sorted(rows), name
    assert got.columns == [*names, "n_tokens", "ids_sha256", "decoded_sha256"]
