import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import arrays as A
from episodica.functions import text as X
from episodica.operators import frames, joins, metrics, sampling, search, stats
from episodica.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_arrays(spark):
    lit = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    chunk = F.array(lit(3, 4, 5), lit(5, 6, 7))
    assert one(spark, A.chunk_delta(lit(1, 2, 3), chunk, [False, True])) == [[3, 2, 5], [5, 4, 7]]
    assert one(spark, A.absolute(lit(1, 2, 3), lit(3, 4, 5), [False, True])) == [3, 6, 5]
    assert A.bool_mask(2, -2, 2) == [True, True, False, False, True, True] and A.bool_mask(2, 0, 2) == [True] * 4
    assert one(spark, F.transform(lit(-1.5, -1, -0.999, 0, 0.5, 0.99999, 1, 5), A.digitize)) == [-1, 0, 0, 128, 192, 255, 255, 255]
    assert one(spark, A.pad(lit(1, 2), 4)) == [1, 2, 0, 0] and one(spark, A.pad(lit(1, 2), 1)) == [1, 2]
    assert one(spark, A.roll_right(lit(1, 2, 3), F.lit(1))) == [2, 3, 1]
    back = A.unzscore(A.zscore(lit(1, 2), [0, 1], [2, 3]), [0, 1], [2, 3])
    assert one(spark, back) == pytest.approx([1, 2])
    assert one(spark, A.mixed_radix(A.radix_digits(F.lit(157), [8, 5, 6]), [8, 5, 6])) == 157
    assert A.soft_weights(2, 6, 8)[:2] == [1.0, 1.0] and A.soft_weights(2, 6, 8)[6:] == [0.0, 0.0]


def test_text(spark):
    assert one(spark, X.clean_prompt(F.lit("  a_b\nc "))) == "a b c"
    assert one(spark, X.chunk_path(F.lit(2007))) == "data/chunk-002/file-007.parquet"
    assert one(spark, X.safe_name(F.lit("._a b/c._"))) == "a_b_c"
    assert one(spark, X.answer(F.lit("x Action: go | y"))) == "go"
    assert search.query_terms("The the CAT") == ["the", "cat"] and search.pack([("a", "xx"), ("b", "xxxx"), ("c", "x")], 3) == ["a", "c"]


def test_future_chunk_repeats_the_last_value(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(3)] + [(2, 0, 9.0)], "e long, f long, v double")
    rows = {(r.e, r.f): r.chunk for r in frames.future_chunk(df, "e", "f", "v", 4).collect()}
    assert rows == {(1, 0): [0, 1, 2, 2], (1, 1): [1, 2, 2, 2], (1, 2): [2, 2, 2, 2], (2, 0): [9, 9, 9, 9]}


def test_selection_includes_the_crossing_episode(spark):
    df = spark.createDataFrame([(k, 900) for k in range(20)], "e long, n long")
    assert frames.take_until(df, [F.col("e")], "n", 0.05 * 3600 * 30).count() == 6


def test_rollback_against_a_stack(spark):
    rng, rows, want = random.Random(5), [], set()
    for run in range(60):
        stack = []
        for k in range(rng.randrange(1, 25)):
            step, value = rng.randrange(6), float(k)
            rows.append((run, k, step, value))
            while stack and stack[-1][0] >= step:
                stack.pop()
            stack.append((step, value))
        want |= {(run, *s) for s in stack}
    df = spark.createDataFrame(rows, "run long, k long, step long, v double")
    assert {tuple(r) for r in metrics.rollback(df, "run", ["k"], "step", ["v"]).collect()} == want


def test_joins(spark):
    e = spark.createDataFrame([(1, k) for k in range(30)], "k long, f long")
    ranges = spark.createDataFrame([(1, 0, 10), (1, 5, 20)], "k long, start long, end long")
    assert joins.keep_ranges(e, ranges, "k", "f").count() == 20
    old = spark.createDataFrame([("r", s, 1.0) for s in (0, 10, 20, 30)], "run string, step long, v double")
    new = spark.createDataFrame([("r", s, -1.0) for s in (20, 30, 40)], "run string, step long, v double")
    assert sorted((r.step, r.v) for r in joins.override(old, new, ["run"], "step").collect()) == [(0, 1.0), (10, 1.0), (20, -1.0), (30, -1.0), (40, -1.0)]
    with pytest.raises(Exception, match="has no name"):
        joins.lookup(spark.createDataFrame([(2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, name string"), "k", "name").collect()


def test_statistics(spark):
    x = np.random.default_rng(1).normal(size=500)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    row = df.agg(*stats.moments("x")).first()
    assert row.mean == pytest.approx(x.mean()) and row.std == pytest.approx(x.std())
    q = stats.histogram_quantiles(df, "k", "x", {"q": 0.5}).first().q
    lo, hi = x.min() - 1e-10, x.max() + 1e-10
    counts, edges = np.histogram(x, 5000, (lo, hi))
    assert q == pytest.approx(edges[np.searchsorted(np.cumsum(counts), 250)], abs=1e-9)


def test_histogram_ranges_are_what_is_broadcast(spark):
    d = spark.range(400).select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: k * F.col("id") / 7)).alias("step", "x"))
    d = d.select(F.when(F.col("step") < 49, F.col("step")).alias("step"), "x")  # a key that is null goes
    out = stats.histogram_quantiles(d, "step", "x", {"q": 0.25}, also=[F.count("*").alias("n")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan  # all rows are on the left
    rows = {r.step: (r.q, r.n) for r in out.collect()}
    assert set(rows) == set(range(49)) and {n for _, n in rows.values()} == {400}
    x = np.arange(400) * 3 / 7
    counts, edges = np.histogram(x, 5000, (x.min() - 1e-10, x.max() + 1e-10))
    assert rows[2][0] == pytest.approx(edges[np.searchsorted(np.cumsum(counts), 100)], abs=1e-9)


def test_sampling(spark):
    df = spark.range(10)
    whole = [(r.id, r.batch) for r in sampling.batches(df, "id", 2, 1).orderBy("batch", "id").collect()]
    assert len({i for i, _ in whole}) == 10
    assert [(r.id, r.batch) for r in sampling.batches(df, "id", 2, 1, 2).orderBy("batch", "id").collect()] == [x for x in whole if x[1] >= 2]
    parts = [{r.id for r in sampling.rank_rows(df, "id", 2, k).collect()} for k in range(2)]
    assert parts[0] | parts[1] == set(range(10)) and not parts[0] & parts[1]
    mixed = sampling.mixture({"a": df, "b": df}, {"a": 0.9, "b": 0.1}, 2000, 3, "id")
    assert 0.86 < mixed.where("source = 'a'").count() / 2000 < 0.94
    with pytest.raises(ValueError):
        sampling.mixture({"a": df}, {"a": 0.5}, 1, 1, "id")


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
