import random

from lodestrata.llm.eval_leakage import LeakIndex, find_leaks, item_words, words_of

R = random.Random(5)
WORDS = ["".join(R.choice("bdfgklmnprst") + R.choice("aeiou") for _ in range(R.randint(2, 4))) for _ in range(400)]
STOCK = "Read the following case carefully and choose the single best answer below."


def sentence(n, r):
    return " ".join(r.choice(WORDS) for _ in range(n))


QUESTIONS = [sentence(40, random.Random(i)) + "?" for i in range(12)]
ITEMS = [(i, f"{STOCK} {q}" if i % 2 else q) for i, q in enumerate(QUESTIONS)]


def found(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    q = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, question string, doc_id string")
    return sorted((r.doc_id, r.item_id) for r in find_leaks(d, q, **kw).collect())


def test_words():
    assert words_of("Fifty-\nsix  CÉDRES<br>Рyrite​ x_y") == ["fiftysix", "cedres", "pyrite", "x", "y"]


def test_stock_is_left_out(spark):
    def words(items):
        return {r.i: r.words for r in item_words(spark.createDataFrame(items, "item_id bigint, question string"), "item_id", "question").collect()}

    assert words(ITEMS)[1] == words_of(QUESTIONS[1])
    assert words([(1, "A b. C d"), (2, None), (3, "")]) == {1: ["a", "b", "c", "d"], 3: []}
    # copies of one item, as splits of a benchmark hold them, share an opening that is no stock
    assert words([(i, "A b c. D e f.") for i in range(5)]) == {i: ["a", "b", "c", "d", "e", "f"] for i in range(5)}
    # two stock sentences in a row; a question that is nothing else keeps the last
    rows = [(i, f"Read this. Think well. Item {i} x.") for i in range(4)] + [(i, f"Think well. Other {i}.") for i in range(5, 9)] + [(10, "Read this. Think well."), (None, "Read this. Item z.")]
    got = words(rows)
    assert got[0] == ["item", "0", "x"] and got[10] == ["think", "well"] and got[None] == ["item", "z"]


def test_leaks(spark):
    r = random.Random(1)
    w = [q.split() for q in QUESTIONS]
    noise = sentence(30, random.Random(99))
    edited = [x for k, x in enumerate(w[3][5:30]) for x in ([x, "quite"] if k == 9 else [] if k == 15 else ["other"] if k == 3 else [x])]
    docs = [
        f"{noise} {QUESTIONS[0]} {noise}", f"{noise} {' '.join(w[1][10:25])} {noise}", f"{noise} {' '.join(w[1][10:22])} {noise}", f"{noise} {STOCK} {noise}",
        QUESTIONS[2].upper().replace(" ", ",\n"), " ".join(edited), QUESTIONS[4].replace("a", "а"), " ".join(r.sample(w[5], 40)), None, "", noise * 50 + " " + QUESTIONS[6],
        " ".join(x if k % 2 else "other" for k, x in enumerate(w[7])), QUESTIONS[8] + " " + QUESTIONS[9],
    ]
    want = [(0, 0), (1, 1), (4, 2), (5, 3), (6, 4), (10, 6), (12, 8), (12, 9)]
    assert found(spark, docs) == want
    assert found(spark, docs, block_words=50) == want  # blocks never change the result


def test_empty_and_nulls(spark):
    assert found(spark, []) == [] and found(spark, [QUESTIONS[0]], []) == [] and found(spark, [QUESTIONS[0]], [(1, None), (2, "short one")]) == []


def test_repeated_items_all_count(spark):
    assert found(spark, [QUESTIONS[0]], [(1, QUESTIONS[0]), (2, QUESTIONS[0])]) == [(0, 1), (0, 2)]


def test_prefix_filter_loses_nothing():
    """Against brute force: every window of 15 words with up to 3 changed ones is found by its rarest shingles."""
    import numpy as np

    r = random.Random(8)
    index = LeakIndex([(i, words_of(q)) for i, q in enumerate(QUESTIONS)], 15, 3, 3)
    for _ in range(150):
        n = r.randrange(len(QUESTIONS))
        s = r.randrange(0, 20)
        text = words_of(QUESTIONS[n])[s : s + 19]
        for k in (4, 10, 15)[: r.randrange(4)]:
            text[k] = "changed"
        ids = np.array([index.vocabulary.get(x, 0) for x in text])
        assert n in index.found(ids)


def test_a_part_of_a_run_with_changed_ends_counts():
    """Six of 22 words are changed, too many for the whole run, but three of the first sixteen; every other word changed is still no case."""
    import numpy as np

    index = LeakIndex([(0, words_of(QUESTIONS[0]))], 15, 3, 3)
    ids = lambda changed: np.array([0 if k in changed else index.vocabulary[w] for k, w in enumerate(words_of(QUESTIONS[0])[:22])])
    assert index.found(ids({3, 16, 17, 18, 20})) == [0] and index.found(ids({2, 4, 16, 18, 20})) == [0]
    assert index.found(ids(set(range(0, 22, 2)))) == []
