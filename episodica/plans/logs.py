"""Named queries of sources, sinks and logs. Files are written from the driver's tables into the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import frames, sampling, stats
from ..operators.transforms import flatten
from ..sources import readers, writers
from ..sources.scratch import new_path
from ..streaming import windows
from .catalog import FR, digest, digest_sql, events_frames, query, r, vectors

# --- Parquet sources ------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s01_projected_scan(read):
    return read("events").select("user_id", "value").groupBy("user_id").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query("SELECT o_custkey, o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def s04_shared_source(read):
    """Rows of many episodes from shared files: one scan and a join with the manifest, not a scan an episode."""
    manifest = read("orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    rows = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return rows.join(manifest, "o_orderkey").select("o_custkey", "o_orderkey", "l_linenumber")


@query(digest_sql("v[1:14]"))
def s05_matrix_column(read):
    """Vectors of a fixed length: any other length fails the scan."""
    v = vectors(read).withColumn("v", F.when(F.size("v") == 64, F.col("v")).otherwise(F.raise_error(F.lit("expected 64 dimensions"))))
    return digest(v, A.head("v", 14), "vec_id")


@query(f"WITH {FR} SELECT user_id, count(*) AS n, round(sum(value * (frame + 1)), 3) AS wsum FROM fr WHERE user_id % 10 <> 9 GROUP BY 1")
def s06_trajectories(read):
    """A trajectory a row, of the train split; steps stay in their order."""
    e = events_frames(read).where("user_id % 10 <> 9")  # the split is the feature
    t = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("steps"))  # an episode's steps
    return t.select("user_id", F.size("steps").cast("long").alias("n"), r(A.weighted_sum(F.transform("steps", lambda s: s["value"])), 3).alias("wsum"))


@query(f"WITH {FR} SELECT user_id, frame, lead(value, 2, last) OVER w AS plus_two FROM (SELECT *, last_value(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM fr) WINDOW w AS (PARTITION BY user_id ORDER BY frame)")
def s07_future_offsets(read):
    e = frames.future_chunk(events_frames(read), "user_id", "frame", "value", 3)
    return e.select("user_id", "frame", F.col("chunk")[2].alias("plus_two"))


@query("SELECT count(*) AS n, 2048 AS top, 4 AS dims, true AS inside FROM range(1000)")
def s22_synthetic(read):
    s = readers.synthetic(read("region").sparkSession, 1000, 4, 3)
    inside = F.bool_and(F.forall("state", lambda x: (x >= -1) & (x < 1)) & (F.col("token") >= 0) & (F.col("token") < 2048))
    return s.agg(F.count("*").alias("n"), F.lit(2048).alias("top"), F.max(F.size("state")).alias("dims"), inside.alias("inside"))


# --- Text sources ---------------------------------------------------------------------------------------------------
LINE = "concat('{\"step\":', coalesce(string(event_id), 'null'), ',\"train/loss\":', coalesce(string(value), 'null'), ',\"opt\":{\"lr\":', coalesce(string(user_id), 'null'), '}}')"


#: A log rolls over after so many lines. A line of LINE has at most 120 bytes, so a file has a fifth of readers.MAX_BYTES at most.
LOG_LINES = 50_000


def metric_logs(read, tail: str = '{"step":') -> str:
    """One log for each event type: an object a line, in files that rolled over (and were packed), and the file that grows: a broken line, a blank one, and a last one that isn't ended."""
    e = read("events").select("event_type", "event_id", F.expr(LINE).alias("value"))
    path = new_path(e.sparkSession, "metric-logs")
    ordered = e.repartitionByRange("event_type", "event_id").sortWithinPartitions("event_type", "event_id").select("value", "event_type")
    ordered.write.partitionBy("event_type").option("maxRecordsPerFile", LOG_LINES).option("compression", "gzip").text(path)
    growing = e.select("event_type").distinct().select(F.lit("{broken\n\n" + tail).alias("value"), "event_type")
    growing.write.mode("append").partitionBy("event_type").option("lineSep", "\x00").text(path)
    return path


def metric_files(read, tail: str = '{"step":'):
    files = read("events").sparkSession.read.text(metric_logs(read, tail), wholetext=True)
    return files.select(F.col("event_type").alias("path"), F.regexp_replace("value", "\x00$", "").alias("text"))


@query("SELECT event_type AS path, event_id AS step, value AS loss, user_id::DOUBLE AS lr, false AS invalid FROM events UNION ALL SELECT DISTINCT event_type, NULL, NULL, NULL, true FROM events UNION ALL SELECT DISTINCT event_type, NULL, NULL, NULL, true FROM events")
def s11_metric_file(read):
    rows = readers.parse_metrics(readers.complete_lines(metric_files(read)))
    return rows.select("path", "step", F.try_element_at("metrics", F.lit("loss")).alias("loss"), F.try_element_at("metrics", F.lit("opt/lr")).alias("lr"), "invalid")


@query("SELECT event_type AS path, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def s12_lenient_lines(read):
    """Files are read by lines and have no limit of bytes, and a last line that isn't ended counts if it is whole, as in the reference."""
    files = read("events").sparkSession.read.text(metric_logs(read))
    lines = files.select(F.col("event_type").alias("path"), F.lit(0).alias("line_no"), F.regexp_replace("value", "\x00$", "").alias("line"))
    return readers.json_lines(lines, "step long").where("step is not null").groupBy("path").agg(F.count("*").alias("n"), F.max("step").alias("last"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def s11_trainer_state(read):
    items = F.array_join(F.transform(F.collect_list("event_id"), lambda x: F.concat(F.lit('{"global_step":'), x, F.lit("}"))), ",")
    files = read("events").groupBy("user_id").agg(F.concat(F.lit('{"log_history":['), items, F.lit("]}")).alias("text"))
    rows = readers.parse_metrics(readers.trainer_state(files.select(F.col("user_id").cast("string").alias("path"), "text")))
    return rows.groupBy(F.col("path").cast("long").alias("user_id")).agg(F.count("step").alias("n"), F.max("step").alias("last"))


@query("SELECT event_id, value AS loss, (props::JSON->>'k')::DOUBLE AS k FROM events")
def p30_metric_flatten(read):
    """Nested records, with an alias and a field that is named explicitly."""
    line = F.concat(F.lit('{"train_loss":'), F.col("value").cast("string"), F.lit(',"metrics":{"a":'), "props", F.lit('},"global_step":'), F.col("event_id").cast("string"), F.lit("}"))
    rows = readers.parse_metrics(read("events").select(F.col("event_id").cast("string").alias("path"), F.lit(0).alias("line_no"), line.alias("line")), {"k": "a/k"})
    return rows.select(F.col("path").cast("long").alias("event_id"), F.col("metrics")["loss"].alias("loss"), F.try_element_at("metrics", F.lit("k")).alias("k"))


@query("SELECT 30 AS fps, count(*) AS n, min(c_custkey) AS first FROM customer")
def s09_json_document(read):
    spark, path = read("region").sparkSession, new_path(read("region").sparkSession, "document")
    read("customer").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first")).select(F.lit(30).alias("fps"), F.struct("n", "first").alias("episodes")).coalesce(1).write.option("multiLine", True).json(path)
    return spark.read.option("multiLine", True).schema("fps int, episodes struct<n: bigint, first: bigint>").json(path).select("fps", "episodes.*")


@query("SELECT o_custkey, unnest(list_sort(list(o_orderkey))) AS episode FROM orders GROUP BY 1")
def s10_episode_ids(read):
    lists = read("orders").groupBy("o_custkey").agg(F.to_json(F.collect_list("o_orderkey")).alias("text"))  # a customer's orders
    return lists.select("o_custkey", F.explode(readers.episode_ids(F.col("text"))).alias("episode"))


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]+')[1] IS NOT NULL AS has, coalesce(list_max(list_transform(regexp_extract_all(text, '([0-9]{1,6})', 1), lambda x: x::BIGINT)), -1) AS peak FROM documents WHERE text IS NOT NULL")
def s17_telemetry_text(read):
    d = read("documents").where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit("([0-9]{1,6})"), F.lit(1)).alias("m"))
    return d.select("doc_id", (F.size("m") > 0).alias("has"), F.coalesce(F.array_max(F.transform("m", lambda x: x.cast("long"))), F.lit(-1)).alias("peak"))


TOML = "[models.small]\nbackend = 'jax'\nsteps = 5\n[models.large]\nbackend = 'torch'\nsteps = 10\n"


@query("SELECT * FROM (VALUES ('small', 'jax', 5), ('large', 'torch', 10)) t(name, backend, steps)")
def s18_registry(read):
    t = readers.toml_table(read("region").sparkSession, TOML, "models")
    return t.select("name", F.col("settings")["backend"].alias("backend"), F.col("settings")["steps"].cast("int").alias("steps"))


@query("SELECT count(DISTINCT n_regionkey) AS files, true AS sized FROM nation")
def s19_inventory(read):
    path = new_path(read("nation").sparkSession, "inventory")
    read("nation").repartition(1).write.partitionBy("n_regionkey").parquet(path)
    found = readers.inventory(read("nation").sparkSession, path, "*.parquet")
    return found.agg(F.count("*").alias("files"), F.bool_and((F.col("size") > 0) & F.col("modified").isNotNull()).alias("sized"))


@query("SELECT n_nationkey, n_name FROM nation")
def s23_record_directory(read):
    spark, path = read("nation").sparkSession, new_path(read("nation").sparkSession, "records")
    read("nation").select("n_nationkey", "n_name").repartition(5).write.json(path)
    lines = readers.texts(spark, f"{path}/*.json").select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.json_lines(lines, "n_nationkey long, n_name string").select("n_nationkey", "n_name")


@query("SELECT label, count(*) AS n, 64 AS dims, true AS finite FROM embeddings GROUP BY 1")
def s14_arrays(read):
    """Arrays stored as .npy contents, with their hash and shape."""
    import io

    import numpy as np

    def save(parts):
        for part in parts:
            out = []
            for v in part["v"]:
                sink = io.BytesIO()
                np.save(sink, np.asarray(v))
                out.append(sink.getvalue())
            part["content"] = out
            yield part[["path", "content"]]

    stored = vectors(read).select(F.concat_ws("/", "label", "vec_id").alias("path"), "v").mapInPandas(save, "path string, content binary")
    a = readers.npy_arrays(stored).groupBy(F.split("path", "/")[0].cast("long").alias("label"))
    return a.agg(F.count("*").alias("n"), F.max(F.col("shape")[0]).alias("dims"), F.bool_and("finite").alias("finite"))


# --- Sinks ----------------------------------------------------------------------------------------------------------
def events_metrics(read):
    return read("events").select("event_id", F.create_map(F.lit("loss"), "value", F.lit("user"), F.col("user_id").cast("double")).alias("m"))


@query("SELECT event_id AS step, value AS loss, user_id::DOUBLE AS usr FROM events")
def k02_metric_append(read):
    spark, path = read("events").sparkSession, new_path(read("events").sparkSession, "metrics")
    e = events_metrics(read)
    for part in (0, 1):
        writers.append_metrics(e.where(F.col("event_id") % 2 == part), "event_id", "m", path)  # two appends make up the table
    lines = spark.read.text(path).select(F.lit("log").alias("path"), F.lit(0).alias("line_no"), F.col("value").alias("line"))
    rows = readers.parse_metrics(lines).where("not invalid")
    return rows.select("step", F.col("metrics")["loss"].alias("loss"), F.col("metrics")["user"].alias("usr"))


@query("SELECT event_id AS step, value AS loss, user_id::DOUBLE AS usr FROM events")
def k03_wide_csv(read):
    spark, path = read("events").sparkSession, new_path(read("events").sparkSession, "wide")
    wide = writers.wide_metrics(events_metrics(read).withColumnRenamed("event_id", "step"), "step", "m")
    wide.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("step long, loss double, user double").csv(path).withColumnRenamed("user", "usr")


@query("SELECT count(*) AS n, true AS refused FROM nation")
def k04_write_once(read):
    """Written, written again with the same rows, refused with others."""
    path = new_path(read("nation").sparkSession, "once")
    n = read("nation").select("n_nationkey", "n_name")
    writers.write_once(n, path)
    there = writers.write_once(n, path)
    try:
        writers.write_once(n.withColumn("n_name", F.lower("n_name")), path)
        refused = False
    except ValueError:
        refused = True
    return there.agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query(f"WITH {FR} SELECT user_id, count(*) AS n, 7 AS task FROM fr WHERE frame < 20 GROUP BY 1")
def k05_rewrite_constant(read):
    e = events_frames(read).select("user_id", "frame")
    out = writers.rewritten(e, new_path(e.sparkSession, "rewrite"), {"task": F.lit(7)}, F.col("frame") < 20)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.max("task").alias("task"))


@query(f"WITH {FR} SELECT user_id, round(sum(frame / 30.0::DOUBLE), 4) AS t FROM fr GROUP BY 1")
def k06_rewrite_column(read):
    e = events_frames(read).select("user_id", "frame")
    out = writers.rewritten(e, new_path(e.sparkSession, "rewrite"), {"time": F.col("frame") / F.lit(30.0)})
    return out.groupBy("user_id").agg(r(F.sum("time")).alias("t"))


@query("SELECT event_type AS key, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def k07_stats_json(read):
    s = read("events").groupBy(F.col("event_type").alias("key")).agg(*stats.moments("value"))
    s = s.select("key", F.array("mean").alias("mean"), F.array("std").alias("std"), F.lit(None).cast("array<double>").alias("q01"), F.lit(None).cast("array<double>").alias("q99"))
    back = writers.stats_from_json(writers.stats_json(s))
    return back.select("key", r(F.col("mean")[0], 6).alias("mean"), r(F.col("std")[0], 6).alias("std"))


@query("SELECT l_suppkey, count(*) AS n, max(l_quantity)::DOUBLE AS hi FROM lineitem GROUP BY 1")
def k08_episode_stats_lines(read):
    spark, path = read("lineitem").sparkSession, new_path(read("lineitem").sparkSession, "episode-stats")
    read("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").cast("double").alias("hi")).write.json(path)
    return spark.read.schema("l_suppkey long, n long, hi double").json(path)


@query("SELECT event_id, value AS reply, event_type AS kind FROM events")
def k09_policy_record(read):
    """Inputs and outputs of each step, flattened, appended to a table."""
    spark, path = read("events").sparkSession, new_path(read("events").sparkSession, "record")
    e = read("events").select("event_id", F.struct(F.col("event_type").alias("kind")).alias("inputs"), F.struct(F.col("value").alias("reply")).alias("outputs"))
    flatten(e).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("event_id", F.col("`outputs/reply`").alias("reply"), F.col("`inputs/kind`").alias("kind"))


@query("SELECT true AS refused")
def k12_refuse_existing(read):
    n = read("region")
    path = new_path(n.sparkSession, "existing")
    n.write.parquet(path)
    try:
        writers.refuse_existing(n.sparkSession, path)
        refused = False
    except FileExistsError:
        refused = True
    return n.limit(1).select(F.lit(refused).alias("refused"))


# --- Logs and streams -----------------------------------------------------------------------------------------------
@query("SELECT event_type AS path, count(*) AS n FROM events GROUP BY 1")
def r01_log_tail(read):
    """A growing log, read again as a whole: only lines that end count."""
    lines = readers.complete_lines(metric_files(read, '{"step":1,"loss":2}'))
    return readers.parse_metrics(lines).where("not invalid").groupBy("path").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT user_id, event_id % 7 AS step, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), i AS (SELECT *, sum(CASE WHEN step IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS g FROM (SELECT *, lag(step) OVER (PARTITION BY user_id ORDER BY k) AS p FROM a)), e AS (SELECT user_id, g, step, arg_max(value, k) AS value FROM i GROUP BY 1, 2, 3), m AS (SELECT *, min(step) OVER (PARTITION BY user_id ORDER BY g ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e) SELECT user_id, step, value FROM m WHERE later IS NULL OR later > step")
def r02_rollback_stream(read):
    """The rollback rule as a stream over the events table, once through; the sink holds what stays of each run."""
    e = read("events").select("user_id", "event_id", (F.col("event_id") % 7).alias("step"), "value")
    spark, path = e.sparkSession, new_path(e.sparkSession, "rollback")
    e.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
    out = windows.rollback_stream(stream, "user_id", "event_id", "step", "value")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("user_id", "step", "value")


@query(f"WITH {FR} SELECT user_id, frame, frame // 8 AS chunk, frame % 8 AS step FROM fr")
def r04_chunk_broker(read):
    e = events_frames(read)
    chunk, step = frames.chunk_step(F.col("frame"), 8)
    return e.select("user_id", "frame", chunk.alias("chunk"), step.alias("step"))


@query()
def r08_shuffled_batches(read):
    """Batches in a seeded global order, which is stronger than a shuffle buffer; the last incomplete batch is left out."""
    return sampling.batches(read("documents").select("doc_id"), "doc_id", 16, 7)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def r09_resumable_work(read):
    """What a receipt says is done isn't done again; the rest is added, and the table is whole."""
    o = read("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    path = new_path(o.sparkSession, "resumable")
    o.where("o_orderstatus = 'F'").drop("o_orderstatus").write.parquet(path)
    done = o.sparkSession.read.parquet(path)
    rest = o.drop("o_orderstatus").join(done.select("o_orderkey"), "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")
    rest.write.mode("append").parquet(path)
    return o.sparkSession.read.parquet(path)


@query("SELECT user_id, date_diff('second', max(ts), (SELECT max(ts) FROM events)) > 600 AS stale FROM events GROUP BY 1")
def r10_staleness(read):
    e = read("events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    last = e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(now)
    return last.select("user_id", (F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp")) > 600).alias("stale"))


@query("SELECT date_trunc('hour', ts) + to_minutes(30 * k) AS start, count(*) AS n FROM (SELECT ts, unnest([0, 1, -1]) AS k FROM events) WHERE ts >= date_trunc('hour', ts) + to_minutes(30 * k) AND ts < date_trunc('hour', ts) + to_minutes(30 * k + 60) GROUP BY 1")
def st_sliding(read):
    t = windows.tumbling(read("events"), "ts", "1 hour", [], "value", slide="30 minutes")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
