import random

from lodestone.llm.chunking import chunk, pieces
from lodestone.llm.tokens import encoding

ENC = encoding()


def check(text, limit=768, overlap=64):
    out = pieces(text, ENC, limit, overlap)
    assert "".join(text[s:e] for _, s, e, *_ in out) == text
    for k, s, e, piece, n, back in out:
        assert piece == text[s - back : e] and n == len(ENC.encode_ordinary(piece)) <= limit and e > s
        assert (back > 0) == (k > 0) or k == 0 or n > limit - overlap
    return out


def test_cuts_at_the_strongest_boundary_near_the_middle():
    line = "alpha beta gamma delta epsilon zeta eta theta.\n"
    text = line * 40 + "\n" + line * 40
    out = check(text, limit=len(ENC.encode_ordinary(text)) - 100)
    assert len(out) == 2 and text[: out[0][2]].endswith("\n\n")


def test_sections_beat_paragraphs():
    line = "one two three four five six seven eight nine ten.\n"
    text = line * 25 + "\n" + line * 10 + "# Next\n" + line * 30
    out = check(text, limit=500)
    assert any(text[s:].startswith("# Next") for _, s, *_ in out)


def test_odd_texts():
    rng = random.Random(5)
    for text in ("a" * 20_000, "é\U0001f600" * 3_000, "\r\n" * 5_000, "word " * 3_000, "".join(chr(rng.choice([10, 32, 46, 97, 0x4E2D, 0xFFFD])) for _ in range(8_000)), "x. " * 2_000 + "y" * 5_000):
        out = check(text)
        assert len(out) > 1


def test_overlap_is_about_64_tokens():
    text = " ".join(f"w{i}" for i in range(6_000))
    out = check(text)
    counts = [len(ENC.encode_ordinary(p[3][: p[5]])) for p in out[1:]]
    assert all(55 <= c <= 66 for c in counts)


def test_rows_nulls_limits_and_clashing_columns(spark):
    long = "alpha beta gamma.\n" * 400
    exact = " a" * 768
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, long, "x"), (4, long, "x"), (None, long, "x"), (5, exact, "x"), (6, exact + " a", "x")]
    got = chunk(spark.createDataFrame(rows, "doc_id bigint, text string, piece string"), "doc_id", "text").toPandas()
    assert set(got.doc_id.dropna()) == {4, 6} and got.doc_id.isna().any() and got.n_tokens.max() <= 768
    assert len(got[(got.doc_id == 4) & (got.piece_no == 0)]) == 2
    assert chunk(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").collect() == []
