import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from oracle import assert_same, connect

from hgspark.llm import mixing as M
from hgspark.llm import queries as Q


def docs(spark, sizes):
    rows = [(i, " ".join(["w"] * 10), s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_exponent_meets_the_limits():
    tokens = np.array([9000, 900, 100])
    budget = 10_000
    alpha = M.bisect_exponent(tokens, budget, target_entropy=None, max_repeats=4)
    w = M.tempered(tokens / budget, alpha)
    assert (budget * w / tokens).max() == pytest.approx(4)
    alpha = M.bisect_exponent(tokens, budget, target_entropy=0.7, max_repeats=None)
    w = M.tempered(tokens / budget, alpha)
    assert -(w * np.log(w)).sum() == pytest.approx(0.7 * math.log(3))
    assert M.bisect_exponent(tokens, budget, target_entropy=None, max_repeats=None) == 0
    assert M.bisect_exponent(np.array([1]), budget) == 0
    assert M.bisect_exponent(tokens, budget, target_entropy=0.0, max_repeats=None) == 1


@pytest.mark.parametrize("block", [30, 10_000])
def test_quotas_are_met_within_a_document(spark, block):
    sizes = {"a": 60, "b": 20, "c": 5}
    got = M.mix_sources(docs(spark, sizes), target_entropy=None, max_repeats=3.0, block_tokens=block).collect()
    tokens = {s: 10 * n for s, n in sizes.items()}
    held = np.array(list(tokens.values()))
    alpha = M.bisect_exponent(held, 850, target_entropy=None, max_repeats=3.0)
    w = dict(zip(tokens, M.tempered(held / 850, alpha), strict=True))
    drawn = Counter(r.source for r in got)
    for s in sizes:
        assert drawn[s] == math.floor(w[s] * 850 + 0.5) // 10
    times = Counter(r.doc_id for r in got)
    assert max(times.values()) <= 3
    # whole passes come before a part of one, and a pass holds a document once
    assert max(Counter((r.doc_id, r.epoch) for r in got).values()) == 1
    for s in sizes:
        last = max(r.epoch for r in got if r.source == s)
        for e in range(last):
            assert sum(r.source == s and r.epoch == e for r in got) == sizes[s]


def test_blocks_are_permuted_anew_in_every_epoch(spark):
    got = M.mix_sources(docs(spark, {"a": 100, "b": 2000}), target_entropy=None, max_repeats=3.0, block_tokens=100).collect()
    orders = [sorted({(r.block_order, r.block) for r in got if r.source == "a" and r.epoch == e}) for e in (0, 1)]
    assert sorted(b for _, b in orders[0]) == sorted(b for _, b in orders[1])
    assert [b for _, b in orders[0]] != [b for _, b in orders[1]]


def test_odd_rows(odd_docs, no_docs):
    out = M.mix_sources(odd_docs, target_entropy=None, max_repeats=1.0)
    rows = out.collect()
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert all(r.epoch == 0 for r in rows)
    assert M.mix_sources(no_docs).count() == 0
    assert set(out.columns) == set(odd_docs.columns)


def test_sources_without_words_are_not_drawn(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert M.mix_sources(df).count() == 0


def test_sql_gives_the_same_with_uneven_sources(spark, tmp_path):
    df = docs(spark, {"a": 300, "b": 40, "c": 7})
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert_same(Q.op5_mixing(spark, str(tmp_path)), connect(str(tmp_path)).sql(Q.oracle_sql()["op5_mixing"]))


def test_last_pass_against_plain_sums(spark):
    """Uneven texts, blank ones, repeated and null ids; every document up to the first that doesn't fit, and no other."""
    rng = random.Random(3)
    rows = [(i if i % 40 else None, "w " * rng.choice([0, 1, 5, 60]), "ab"[i % 7 == 0]) for i in range(400)] + [(5, "w " * 30, "a")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for budget, block in ((700, 50), (9_000, 400), (15_000, 10**6)):
        got = M.mix_sources(df, budget=budget, target_entropy=None, max_repeats=2.5, block_tokens=block).collect()
        tokens = {s: sum(t.count("w") for _, t, x in rows if x == s) for s in "ab"}
        held = np.array(list(tokens.values()))
        w = M.tempered(held / held.sum(), M.bisect_exponent(held, budget, target_entropy=None, max_repeats=2.5))
        for s, share in zip(tokens, w, strict=True):
            quota = math.floor(share * budget + 0.5)
            blocks, rest, last = -(-tokens[s] // block), quota % tokens[s], quota // tokens[s]

            def md5(*parts):
                return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()

            keyed = {}
            for i, t, x in rows:
                if x == s:
                    own = "" if i is None else i
                    b = int(md5(M.SEED, "block", own)[:8], 16) % blocks
                    key = (int(md5(M.SEED, last, s, b)[:15], 16), int(md5(M.SEED, last, own)[:15], 16))
                    keyed.setdefault(key, []).append((i, t.count("w")))
            want, used = Counter(), 0
            for key in sorted(keyed):
                used += sum(n for _, n in keyed[key])
                if used > rest:
                    break
                want += Counter(i for i, _ in keyed[key])
            whole = Counter(i for i, _, x in rows if x == s)
            for _ in range(last):
                want += whole
            assert Counter(r.doc_id for r in got if r.source == s) == (want if quota else Counter())


def test_clashing_names_are_kept(spark):
    df = docs(spark, {"a": 3, "b": 3}).selectExpr("*", "'x' AS __id", "'y' AS __s", "7 AS __end", "1 AS `block.order`", "2 AS epoch")
    out = M.mix_sources(df, target_entropy=None, max_repeats=1.0)
    assert out.columns == ["doc_id", "text", "source", "__id", "__s", "__end", "block.order", "epoch", "block", "block_order"]
    assert {(r["__id"], r["__s"], r["__end"], r["block.order"], r.epoch) for r in out.collect()} == {("x", "y", 7, 1, 0)}
