import random

import pytest
import sentencepiece

from folioweave.llm import common, language_id, token_counts

MODEL = common.tokenizer_file("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    odd = ["", None, " ", "\n", "a", " a", "a ", "a\nb", "\n\nb\n", "  two  blanks ", "tab\there", "▁mark▁", "<s>x</s>", "日本語 text", "é́", "x" * 5000, "a " * 3000, "\r\n", "\x00z", "🙂🙂"]
    alphabet = "abcdeéñß .,;\n\t▁<>'\"12日🙂"
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(150)]


def test_token_counts_equal_the_library(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, lang string, n_tokens long")
    got = {r.doc_id: r for r in token_counts.token_counts(df, MODEL, limit=50).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in rows:
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50), repr(t)


def test_bounded_parts_keep_counts():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = token_counts.TextCounter(MODEL, token_counts.Lengths(*(x[:0] for x in (common.mix(common.powers(1)[0]), common.powers(1)[0]))))
    text = "one two  three\nfour " * 20
    assert "".join(token_counts.bounded_parts(text, 7)) == "▁" + text.replace(" ", "▁")
    assert counter.count(text) == len(model.encode(text))


def test_token_counts_of_nothing(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "a": 1, "b": 2, "ab": 3, "▁ab": 4}
    import numpy as np

    p = np.array([[0.1], [0.2], [0.3], [0.15], [0.25]])
    scorer = language_id.Scorer(pieces, p)
    got = np.exp(scorer.words(["ab", "aab"]))[:, 0]
    u = np.exp(language_id.UNKNOWN)
    ab = 0.25 + 0.1 * (0.3 + u) + u * (0.15 + (0.2 + u) * (0.3 + u))
    assert got[0] == pytest.approx(ab)
    aab = (0.1 + u * (0.2 + u)) * (0.15 + (0.2 + u) * (0.3 + u))
    assert got[1] == pytest.approx(aab)


def test_language_id_rules(spark):
    rows = [(i, "the house and the garden of the man" if i % 2 else "das haus und der garten von dem mann", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 !!!", "en"), (102, "", None), (103, "das haus und der mann", None), (103, "das haus und der mann", None), (104, "²", "en")]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = language_id.language_id(df, MODEL).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "de", "und"]
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert all(by[i].held_out == language_id.is_held_out(i) and 0 <= by[i].score <= 1 for i in by)


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.language_id(df, MODEL).collect()] == ["und"]
    assert language_id.language_id(df.where("false"), MODEL).count() == 0


def test_long_words_are_summed_whole(monkeypatch):
    import numpy as np

    pieces = {"▁a": 0, "a": 1, "b": 2, "ab": 3, "▁ab": 4, "bab": 5}
    scorer = language_id.Scorer(pieces, np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 0.2], [0.15, 0.1], [0.25, 0.3], [0.01, 0.2]]))
    rng = random.Random(1)
    for n in (30, 100, 255, 256, 257, 3000, 9000):
        word = "".join(rng.choice("aabx") for _ in range(n))
        want = []
        for x in range(2):  # in logarithms, position by position
            f = [0.0]
            for j in range(1, n + 2):
                terms = [f[j - 1] + language_id.UNKNOWN] + [f[j - k] + float(np.log(scorer.p[i, x])) for k in (1, 2, 3) if j >= k and (i := pieces.get(("▁" + word)[j - k : j])) is not None]
                f.append(float(np.logaddexp.reduce(terms)))
            want.append(f[-1])
        assert scorer.words([word])[0] == pytest.approx(want, rel=1e-9)
        assert scorer.alone(word, chunk=64) == pytest.approx(want, rel=1e-9)


def test_texts_without_blanks_and_ties(spark):
    texts = {"de": "dieschnellenfreundesprechendeutschundschreibenlangesätze", "en": "thequickfriendsarespeakingenglishandwritelongsentences"}
    rows = [(i, texts["de" if i % 2 else "en"] * 8, "de" if i % 2 else "en") for i in range(40)] + [(99, texts["de"] * 2000, None), (98, "qqq", None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()}
    assert got[99].lang_pred == "de" and all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(40))
    same = spark.createDataFrame([(i, "one two", x) for i, x in enumerate(["xx", "aa"] * 20)], "doc_id long, text string, lang string").where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    same = same.groupBy("lang").agg({"doc_id": "min"}).selectExpr("`min(doc_id)` as doc_id", "lang", "'one two' as text")
    assert {r.lang_pred for r in language_id.language_id(same, MODEL).collect()} == {"aa"}  # equal in both: the first in order
