import os
from collections import Counter

import pytest
from oracle import assert_same, connect

import corpus_pipeline as C
from hgspark.llm import decontamination as D
from hgspark.llm import queries as Q
from hgspark.llm import token_output as K
from hgspark.llm.common import words_of

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    found, sql = Q.queries()[name](spark, FOLDER), Q.oracle_sql().get(name)
    if sql:
        assert_same(found, connect(FOLDER).sql(sql))
    else:
        assert found.count() > 0


@needs_tables
def test_stages_hold_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in C.STAGES[:-1]:
        stage(spark, steps[-1], FOLDER).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
        assert steps[-1].columns == columns
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps]
    whole, good, unique, clean, _ = texts

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    seen = [(d in good, quality[d] == 1) for d in whole if d in quality]
    assert sum(a == b for a, b in seen) / len(seen) > 0.95

    def near(a, b):
        x, y = ({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (words_of(a), words_of(b)))
        return len(x & y) / len(x | y)

    gone = set(good) - set(unique)
    assert gone
    assert all(max(near(good[d], t) for k, t in good.items() if k != d) > 0.45 for d in gone)
    ids = sorted(unique)
    assert not [1 for i, a in enumerate(ids) for b in ids[:i] if near(unique[a], unique[b]) > 0.8]

    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    strings = {w for t in items for w in D.windows(t)}
    leaks = {d for d, t in unique.items() if any(s in b" " + b" ".join(words_of(t)) + b" " for s in strings)}
    assert set(unique) - set(clean) == leaks

    drawn = Counter(r.doc_id for r in steps[-1].collect())
    shards = C.STAGES[-1][1](spark, steps[-1], FOLDER).collect()
    encoder = K.load_tokenizer(K.TOKENIZER)
    written = Counter()
    for r in shards:
        for i, d in enumerate(r.doc_ids):
            assert encoder.decode(K.document_tokens(r, i).tolist()) == clean[d]
            written[d] += 1
    assert written == drawn


@needs_tables
def test_run(spark):
    assert C.run(spark, FOLDER).count() > 0


def test_stages_take_odd_rows(spark, odd_docs, odd_rows, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (20, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, odd_rows[-1][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, plain.limit(0), odd_docs):
        for name, stage in C.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "token_output":
                assert out.columns == docs.columns
            out.count()
