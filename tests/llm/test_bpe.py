import hashlib
import random

from tokenizers import Tokenizer

from folioweave.llm import bpe, common

PATH = common.tokenizer_file("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    odd = ["", None, " ", "  ", "\n", "a\n\nb", " a", "a ", "it's we'll I'D", "x" * 3000, " " * 500 + "y", "-=" * 700, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "日本語のテキスト" * 40, "\x00\x1c a\x1fb\x85c d  e", "½²³ ٣", "🙂👩‍👩‍👧", "tab\t\tx\r\ny"]
    alphabet = ["the ", " and", "tion", "a", "b", "é", "ß", ",", ".", " ", "  ", "\n", "'s", "12", "日", "🙂", "Th", "wh", "=", "\t"]
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(200)]


def test_equal_to_the_library(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.bpe(df, PATH, with_ids=True).collect()}
    library = Tokenizer.from_file(PATH)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids, repr(t)[:200]
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded == text
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_stream_is_stable_and_bounded(monkeypatch):
    v = bpe.codec(PATH).v
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    for letters in ("ab", "etaoinshr", "-="):
        word = "".join(rng.choice(letters) for _ in range(6000))
        for at_once in (1, 64, 4096):
            monkeypatch.setattr(bpe, "AT_ONCE", at_once)
            encoder, out, most = bpe.Encoder(v), [], 0
            for i in range(0, len(word), 7):
                out += encoder.feed(word[i : i + 7].encode())
                most = max(most, len(encoder.tokens))
            out += encoder.finish()
            assert out == library.encode(word).ids
            assert most <= v.lookahead + at_once + 8 + v.longest  # constant memory, whatever the word's length


def test_lookahead_is_that_of_the_merges():
    v = bpe.Vocabulary.__new__(bpe.Vocabulary)
    # bytes a b c; merges (b, c) then (a, b): whether ab is made is known one byte behind it, and no later.
    v.rank, v.bytes, v.merged = {0: 0, 1: 1, 2: 2, 3: 256, 4: 257}, {0: b"a", 1: b"b", 2: b"c", 3: b"bc", 4: b"ab"}, {(1, 2): 3, (0, 1): 4}
    assert v.sufficient_lookahead() == 2  # a waits for b, which waits for c


def test_long_text_without_blanks(spark):
    rng = random.Random(8)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    text = word + " and " + "日本語" * 30_000
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    got = bpe.bpe(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_decode_machine():
    raw = "é🙂x".encode()
    assert "".join(bpe.decode(iter([raw[i : i + 1] for i in range(len(raw))]))) == "é🙂x"
    assert "".join(bpe.decode(iter([raw[:1], b"x"]))) == "�x"


def test_rows_kept(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    got = bpe.tokenized(df, PATH)
    assert got.columns == ["doc_id", "text", "lang", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 3
    assert bpe.bpe(df.where("false"), PATH).count() == 0
