import os

import pytest
from oracle import assert_same, connect

from hgspark import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found, sql = queries.queries()[name](spark, FOLDER), queries.oracle_sql().get(name)
    if sql:
        assert_same(found, duck.sql(sql))
    else:
        assert found.count() > 0


def test_entry_needs_no_text_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['hgspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-2]) == len(NAMES)


def test_split_queries_have_a_row_for_each_row(spark, tmp_path):
    texts = ["a b", "a b", "", None, "x" * 1000, "word " * 700, "x" * 1001, None]
    rows = [(k // 2, t, 2000 if k == 7 else len(t or "")) for k, t in enumerate(texts)]  # ids repeat
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("txt_split_lossless", "txt_split_short"):
        assert_same(queries.queries()[name](spark, str(tmp_path)), connect(str(tmp_path)).sql(queries.oracle_sql()[name]))
