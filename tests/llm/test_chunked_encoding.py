import random

import pytest

from lodestrata.llm.chunked_encoding import DEFAULT_RANKS, Encoder, chunk_bounds, encode_corpus, is_sure, power_table

tokenizers = pytest.importorskip("tokenizers")
POWERS = power_table(4096)


@pytest.fixture(scope="module")
def enc():
    with open(DEFAULT_RANKS, "rb") as f:
        return Encoder(f.read())


def texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "b ", "  ", "\n", "\n\n", "é", "中文字", "'s", "'", "12", "3 ", "—", "😀", " ", " word", "　", "x" * 30, "<|endoftext|>", "don't ", "\t"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 150))) for _ in range(n)]


@pytest.mark.parametrize("mean,least,most", [(20, 5, 40), (8, 2, 16), (384, 96, 4096)])
def test_stitching_equals_whole_encoding(enc, mean, least, most):
    for t in texts(600, mean):
        pieces, start, left = [], 0, False
        ends = chunk_bounds(t, mean, least, most, POWERS)
        assert ends[-1] == len(t) and ends == sorted(set(ends)) or not t
        for e in ends:
            right = e < len(t) and not is_sure(t, e)
            pieces.append(enc.piece(t[start:e], left, right))
            start, left = e, right
        assert enc.stitch(pieces).tolist() == enc.encode(t)


def test_copied_passages_share_chunks():
    r = random.Random(1)
    passage = " ".join(r.choice("ore vein grain fault rim zinc".split()) + str(r.randint(0, 99)) for _ in range(2000))

    def cut(t):
        ends = chunk_bounds(t, 384, 96, 4096, POWERS)
        return {t[a:b] for a, b in zip([0, *ends[:-1]], ends)}

    a, b = cut("first " + passage), cut("quite another opening, then: " + passage + " and an end")
    assert len(a & b) >= len(a) - 3


def test_corpus(spark):
    long = "unbroken" * 20_000
    rows = [(i, t, "clash") for i, t in enumerate(texts(60, 5))] + [(900, None, "c"), (901, "", "c"), (902, long, "c"), (903, " ", "c"), (904, "same text here", "c"), (904, "same text here", "c"), (None, "no id", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = encode_corpus(df, mean=32, least=8, most=256).collect()
    want = tokenizers.Tokenizer.from_file(DEFAULT_RANKS.replace(".tiktoken", ".json"))
    want.encode_special_tokens = True
    expected = sorted((-1 if i is None else i, tuple(want.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got) == expected


def test_empty_table_and_schema(spark):
    df = encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"))
    assert df.count() == 0 and dict(df.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


def test_one_chunk_in_a_third_of_all_texts(spark):
    rows = [(i, "The same opening line of boilerplate stands here. " * 20 + str(i if i % 3 else 0)) for i in range(3000)]
    got = {r.doc_id: r.ids for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), mean=64, least=16).collect()}
    with open(DEFAULT_RANKS, "rb") as f:
        e = Encoder(f.read())
    assert all(got[i] == e.encode(t) for i, t in rows)
