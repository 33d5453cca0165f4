import json
import random

import pytest
from pyspark.sql import functions as F

from episodica.functions import text as X
from episodica.operators import records, sampling, stats
from episodica.operators import transforms as TR
from episodica.plans import catalog, logs
from episodica.sources import readers, writers
from episodica.sources.scratch import new_path
from episodica.streaming import windows


def test_places_don_t_depend_on_partitions(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**7), 120_000)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    rows = sampling.indexed(df, [F.col("id")]).collect()
    assert sorted(r["at"] for r in rows) == list(range(len(ids)))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["at"])] == sorted(ids)
    ranks = [{r["id"] for r in sampling.rank_rows(df, "id", 4, k).collect()} for k in range(4)]
    assert sum(map(len, ranks)) == len(ids) == len(set().union(*ranks))
    sizes = {r["count"] for r in sampling.batches(df, "id", 32, 5, 3).groupBy("batch").count().collect()}
    assert sizes == {32}


def test_running_sum(spark):
    rng = random.Random(4)
    values = {k: rng.randrange(100) for k in range(5000)}
    out = {r.k: r.before for r in sampling.running(spark.createDataFrame(list(values.items()), "k long, v long"), [F.col("k")], "v", "before").collect()}
    total = 0
    for k in sorted(values):
        assert out[k] == total
        total += values[k]


def test_mixture_returns_source_rows(spark):
    a, b = (spark.createDataFrame([(k, f"{name}{k}") for k in range(n)], "k long, x string") for name, n in (("a", 40), ("b", 3)))
    rows = sampling.mixture({"a": a, "b": b}, {"a": 0.75, "b": 0.25}, 2000, 1, "k").collect()
    assert sorted(r.draw for r in rows) == list(range(2000)) and all(r.x[0] == r.source for r in rows)
    assert 0.7 < sum(r.source == "a" for r in rows) / 2000 < 0.8 and {r.x for r in rows if r.source == "b"} == {"b0", "b1", "b2"}
    with pytest.raises(ValueError):
        sampling.mixture({"a": a, "b": b}, {"a": 0.7, "b": 0.2}, 10, 1, "k")


def test_exact_percentiles(spark):
    import numpy as np

    rng = random.Random(5)
    data = {"a": [rng.gauss(0, 1) for _ in range(999)], "b": [1.0] * 50, "c": [2.0], "d": [float(rng.randrange(4)) for _ in range(200)]}
    df = spark.createDataFrame([(k, x) for k, v in data.items() for x in v] + [("a", None), ("e", None)], "k string, x double")
    marks = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    out = {r.k: r for r in stats.exact_percentiles(df, ["k"], "x", marks).collect()}
    assert set(out) == set(data)
    for k, v in data.items():
        assert [out[k][m] for m in marks] == pytest.approx([np.quantile(v, q) for q in marks.values()])


def test_extremum_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([(1, -5.0, 3), (1, 5.0, 2), (1, None, 0), (2, None, 1)], "k long, x double, row long")
    out = {r.k: tuple(r.e) for r in rows.groupBy("k").agg(stats.extremum("x", "row").alias("e")).collect()}
    assert out == {1: (5.0, 2, 0), 2: (0.0, 0, 0)}


def test_transforms(spark):
    df = spark.createDataFrame([(1, (2.0, "x"))], "a long, b struct<c: double, d: string>")
    flat = TR.flatten(df)
    assert flat.columns == ["a", "b/c", "b/d"] and TR.unflatten(flat).schema.simpleString() == df.schema.simpleString()
    assert TR.rename([("b/(.)", r"\1"), (".*", None)])(flat).columns == ["c", "d"]
    with pytest.raises(ValueError):
        TR.rename([("b/.", "z")])(flat)
    with pytest.raises(ValueError):
        TR.unflatten(spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a/b")))
    with pytest.raises(KeyError):
        TR.repack({"x": "b/z"})(df)
    with pytest.raises(KeyError):
        TR.apply_to({"z": lambda c: c}, strict=True)(df)
    with pytest.raises(KeyError, match="committed_prefix"):
        TR.CONFIGURATIONS.get("comitted_prefix")
    assert TR.drop_strings(flat).columns == ["a", "b/c"]
    prompts = spark.createDataFrame([(None,), ("p",)], "prompt string")
    assert [r.prompt for r in TR.default_prompt("q")(prompts).collect()] == ["q", "p"]


def test_pipeline_undoes_in_the_inverse_order(spark):
    calls = []
    step = lambda name: lambda df: (calls.append(name), df)[1]
    pipe = TR.Pipeline().push([step("f1")], [step("b1")]).push([step("f2")], [step("b2")])
    pipe.undo(pipe.apply(spark.range(1)))
    assert calls == ["f1", "f2", "b2", "b1"]


def test_metric_rows():
    assert readers.metric_row({"global_step": 3, "metrics": {"train/loss": 1, "ok": True}, "x": {"y": 2.5}}) == ({"train/loss": 1.0, "x/y": 2.5, "step": 3.0, "loss": 1.0}, False)
    assert readers.metric_row({"step": 1, "loss": float("nan")}) == ({"step": 1.0}, True)
    assert readers.metric_row({"step": 1, "loss": 4, "other": "x"}, {"loss": "other"}) == ({"step": 1.0}, False)
    assert readers.metric_row({"step": "2", "a": "z"}, from_csv=True) == ({"step": 2.0}, False)
    assert readers.metric_row([1])[0] is None
    deep = {"a": 1}
    for _ in range(10):
        deep = {"n": deep}
    with pytest.raises(ValueError):
        readers.metric_row(deep)


def test_metric_files(spark):
    lines = ['{"step": 1, "loss": 2}', "{torn", "[1]", '{"step": 1.5}', '{"step": -1}', '{"step": 2, "loss": NaN}', '{"step": 3']
    files = spark.createDataFrame([("f", "\n".join(lines)), ("g", "")], "path string, text string")
    rows = readers.parse_metrics(readers.complete_lines(files)).orderBy("line_no").collect()
    assert [(r.step, r.invalid) for r in rows] == [(1, False), (None, True), (None, True), (None, True), (None, True), (2, True)]
    with pytest.raises(Exception, match="limit of bytes"):
        readers.complete_lines(files, most=10).collect()
    with pytest.raises(Exception, match="log_history"):
        readers.trainer_state(spark.createDataFrame([("f", "{}")], "path string, text string")).collect()


@pytest.fixture(scope="module")
def long_log(spark, tmp_path_factory):
    """Events of one type whose log has more bytes than one file may have."""
    path, of = str(tmp_path_factory.mktemp("long-log")), F.col("id") + 10**15
    e = spark.range(400_000).select(of.alias("event_id"), of.alias("user_id"), F.lit("view").alias("event_type"), ((F.col("id") + 1) / 7).alias("value"))
    e.write.parquet(f"{path}/events.parquet")
    assert e.agg(F.sum(F.octet_length(F.expr(logs.LINE)))).first()[0] > readers.MAX_BYTES
    return path


def test_a_log_tail_beyond_the_size_of_a_file(spark, long_log):
    assert [tuple(r) for r in catalog.QUERIES["r01_log_tail"](spark, long_log).collect()] == [("view", 400_000)]


def test_a_metric_file_beyond_the_size_of_a_file(spark, long_log):
    rows = catalog.QUERIES["s11_metric_file"](spark, long_log)
    good = rows.where("not invalid").join(spark.read.parquet(f"{long_log}/events.parquet"), F.col("step") == F.col("event_id"))
    same = (F.col("path") == "view") & (F.col("loss") == F.col("value")) & (F.col("lr") == F.col("user_id").cast("double"))
    assert tuple(good.agg(F.count("*"), F.count_if(same)).first()) == (400_000, 400_000)
    assert [tuple(r) for r in rows.where("invalid").collect()] == [("view", None, None, None, True)] * 2


@pytest.fixture
def gaps(spark, tmp_path):
    """Events without a value or a user."""
    rows = [(1, 7, "view", 0.5), (2, 7, "view", None), (3, None, "view", 1.5), (4, 8, "click", None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_metric_file_keeps_lines_without_a_value(spark, gaps):
    rows = catalog.QUERIES["s11_metric_file"](spark, gaps).where("not invalid").orderBy("step").collect()
    assert [tuple(r) for r in rows] == [("view", 1, 0.5, 7.0, False), ("view", 2, None, 7.0, False), ("view", 3, 1.5, None, False), ("click", 4, None, 8.0, False)]


def test_lenient_lines_beyond_the_size_of_a_file(spark, long_log):
    assert [tuple(r) for r in catalog.QUERIES["s12_lenient_lines"](spark, long_log).collect()] == [("view", 400_000, 10**15 + 399_999)]


def test_lenient_lines_of_one_file_beyond_the_limit_of_metric_files(spark, long_log, monkeypatch):
    monkeypatch.setattr(logs, "LOG_LINES", 10**6)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert [tuple(r) for r in catalog.QUERIES["s12_lenient_lines"](spark, long_log).collect()] == [("view", 400_000, 10**15 + 399_999)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_lenient_lines_keep_events_without_a_value(spark, gaps):
    assert {tuple(r) for r in catalog.QUERIES["s12_lenient_lines"](spark, gaps).collect()} == {("view", 3, 3), ("click", 1, 4)}


def test_writers_refuse(spark):
    path = new_path(spark, "test")
    df = spark.range(3)
    assert writers.write_once(df, path).count() == 3 and writers.write_once(df, path).count() == 3
    with pytest.raises(ValueError):
        writers.write_once(spark.range(4), path)
    with pytest.raises(FileExistsError):
        writers.rewritten(df, path, {})
    bad = spark.createDataFrame([(1, {"a": float("inf")})], "s long, m map<string,double>")
    with pytest.raises(Exception, match="finite"):
        writers.metric_events(bad, "s", "m").collect()
    good = spark.createDataFrame([(1, {"a": 2.0})], "s long, m map<string,double>")
    assert json.loads(writers.metric_events(good, "s", "m").first().value) == {"schema_version": 1, "step": 1, "metrics": {"a": 2.0}}


def test_episode_ids(spark):
    ids = lambda t: spark.range(1).select(readers.episode_ids(F.lit(t)).alias("x")).first().x
    assert ids("[3, 1]") == [1, 3]
    for bad in ("[]", "[1, 1]", "[-1]", "{}"):
        with pytest.raises(Exception, match="distinct ids"):
            ids(bad)


def test_sections():
    lines = "# A\nx\n```\n# A\n````\n## B\ny\n# C\n~~~\n# D\n~~~\n".splitlines(keepends=True)
    assert X.section(lines, "A") == "# A\nx\n```\n# A\n````\n## B\ny\n" and X.section(lines, "B") == "## B\ny\n"
    assert X.section(lines, "D") is None and X.section(["# A\n", "# A\n"], "A") is None


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(X.number_text(F.lit(v).cast("double"))) for v in (None, 0, 1.5, 0.00005, 2e-9, 12)] == ["—", "0", "1.5", "0.00005", "2e-09", "12"]
    with pytest.raises(Exception, match="finite"):
        one(X.number_text(F.lit(-1.0)))
    assert one(X.answer(F.lit("Action: a Action: b"))) == "a" and one(X.answer(F.lit("none"))) is None
    assert one(X.safe_name(F.lit("__"))) == "metric" and one(X.latency_text(F.lit(1234.5))) == "1,234.50"
    assert X.parse_spec("1:7:2") == [1, 3, 5] and X.parse_spec("4,2") == [4, 2] and X.parse_spec(None) is None
    for bad in ("3:3", "-1:2"):
        with pytest.raises(ValueError):
            X.parse_range(bad)


def test_record_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    sha = F.sha2(F.lit("a\n").cast("binary"), 256)
    assert [one(records.identity_relation(F.lit(t), sha)) for t in ("a\n", "a", "b")] == ["identical", "without_last_line_end", "differs"]
    assert [one(records.safe_identifier(F.lit(t))) for t in ("a/b", "a//b", "../a", "/a", "a/../b")] == [True, False, False, False, False]
    row = spark.createDataFrame([(12.7, 3.0, [1.0, 2.0])], "d double, s double, a array<double>")
    d, s, said = records.clamp_delays("d", "s", 10)
    assert tuple(row.select(d, s, said).first()) == (10, 0, ["d rounded", "d clamped", "s raised", "s clamped"])
    fit = lambda n: row.select(records.fit_length("a", F.lit(n), F.lit(0.0)).alias("x")).first().x
    assert fit(4) == [1, 2, 2, 2] and fit(1) == [2]


def test_tumbling_stream_with_late_rows(spark):
    from datetime import datetime

    path = new_path(spark, "late")
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    for rows in ([(at(1, 5), 1.0), (at(1, 50), 2.0)], [(at(5, 0), 4.0)], [(at(1, 10), 8.0), (at(5, 30), 16.0)]):
        spark.createDataFrame(rows, "ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = windows.tumbling(spark.readStream.schema("ts timestamp, v double").parquet(f"{path}/in"), "ts", "1 hour", [], "v", watermark="30 minutes")
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    found = {r.start.hour: (r.n, r.total) for r in spark.read.parquet(f"{path}/out").collect()}
    assert found.get(1) == (2, 3.0)  # the late row of the third file came after the watermark
