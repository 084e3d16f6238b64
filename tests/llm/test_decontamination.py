import random

from helpers import sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from hgspark.llm import decontamination as D
from hgspark.llm.common import words_of


def brute(docs, items, n=D.WINDOW):
    """(doc, item) -> number of the item's distinct windows in the document, by comparing all windows."""

    def windows(t):
        w = words_of(t) if t else []
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    out = {}
    for d, t in docs:
        words = words_of(t) if t else []
        for i, q in items:
            hits = sum(any(tuple(words[k : k + len(s)]) == s for k in range(len(words) - len(s) + 1)) for s in windows(q))
            if hits:
                out[d, i] = hits
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=6), st.lists(st.text(alphabet="ab ", min_size=1, max_size=20), min_size=1, max_size=4))
def test_search_matches_brute_force(texts, items):
    strings = sorted({w for t in items for w in D.windows(t, 3)})
    if not strings:
        return
    text, string = D.WuManber(strings).search_texts(texts)
    got = set(zip(text.tolist(), string.tolist(), strict=True))
    folded = [b" " + b" ".join(words_of(t)) + b" " for t in texts]
    assert got == {(i, k) for i, t in enumerate(folded) for k, s in enumerate(strings) if s in t}


def test_long_texts_cross_lanes():
    rng = random.Random(1)
    needle = sentence(rng, 8)
    for at in (0, 500, 4090 // 6, 5000):
        words = sentence(rng, 6000).split()
        words[at:at] = needle.upper().split()
        text, _ = D.WuManber(D.windows(needle)).search_texts(["x", ", ".join(words)])
        assert text.tolist() == [1]


def test_whole_operator_matches_brute_force(spark):
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.randint(3, 30))) for i in range(12)] + [(50, None), (51, ""), (52, "?!")]
    items.append((60, items[0][1]))  # a repeated item
    docs = []
    for d in range(60):
        words = sentence(rng, rng.randint(0, 60)).split()
        if d % 3 == 0:
            q = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(q))
            words[5:5] = q[a:] if d % 2 else q
        docs.append((d, " ".join(words).upper()))
    b = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in D.benchmark_overlaps(df, b).collect()}
    assert got == brute(docs, [x for x in items if x[1]])
    assert {r.doc_id for r in D.drop_contaminated(df, b).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_several_tables_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, sentence(rng, 20)) for i in range(5)], "item_id int, text string")
    docs = items.selectExpr("item_id + 100L AS doc_id", "text")
    whole = sorted(D.benchmark_overlaps(docs, items).collect())
    monkeypatch.setattr(D, "TABLE_STRINGS", 7)
    assert sorted(D.benchmark_overlaps(docs, items).collect()) == whole
    assert D.drop_contaminated(docs, items).count() == 0


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    base = odd_rows[0][1]
    b = spark.createDataFrame([(1, base), (2, None), (3, "QWQ!")], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in D.benchmark_overlaps(odd_docs, b).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (7, 3)}
    clean = D.drop_contaminated(odd_docs, b)
    assert clean.columns == odd_docs.columns
    assert clean.count() == len(odd_rows) - 5
    assert D.benchmark_overlaps(no_docs, b).count() == 0
    assert D.benchmark_overlaps(odd_docs, b.limit(0)).count() == 0
    assert D.drop_contaminated(odd_docs, b.limit(0)).count() == len(odd_rows)
