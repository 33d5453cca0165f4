"""Named queries of predicates, gates, joins with rules, and dataset integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import frames, joins, records, sampling, search, stats
from ..sources import readers, writers
from ..sources.scratch import new_path
from .catalog import FR, PAIR, VE, diffs, episode_mae, events_frames, query, r, vectors

# --- Predicates -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (7, 33, 70)")
def f01_episode_equality(read):
    return read("lineitem").where(F.col("l_orderkey").isin(7, 33, 70)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f04_episode_subset(read):
    chosen = read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read("orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def f06_contiguous_frames(read):
    n = F.col("l_linenumber")
    return read("lineitem").groupBy("l_orderkey").agg(((F.countDistinct(n) == F.count("*")) & (F.min(n) == 1) & (F.max(n) == F.count("*"))).alias("contiguous"))


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0")
def f09_nonblank_text(read):
    return read("documents").where(F.length(F.regexp_replace("text", r"\s", "")) > 0).select("doc_id")


SCOPE = {"project": "p", "type": "view"}


@query("SELECT event_id, event_type = 'view' AS fits FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, true FROM events WHERE event_id % 2 = 1")
def f11_scope_match(read):
    """Every key of the record's scope equals the query's; keys that the record lacks don't matter."""
    scope = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("project"), F.lit("p"), F.lit("type"), F.col("event_type"))).otherwise(F.create_map(F.lit("project"), F.lit("p")))
    return read("events").withColumn("scope", scope).select("event_id", search.scope_matches("scope", SCOPE).alias("fits"))


NOW = "2030-01-01T00:00:00Z"
RECORD = """struct(
    cast(event_id as string) as id, 'c' as claim, if(event_id % 11 = 0, ' ', 'o') as owner, if(event_id % 7 = 0, 'opinion', 'lesson') as kind,
    if(event_id % 2 = 0, 'verified', 'candidate') as status, map('project', if(event_id % 13 = 0, '', 'p')) as scope,
    concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), if(event_id % 5 = 0, '', 'Z')) as observed_at, '2029-01-01T00:00:00Z' as recorded_at,
    if(event_id % 3 = 0, 'on_change', 'always') as recheck, if(event_id % 17 = 0, '2029-01-01T00:00:00Z', null) as valid_until, array(if(event_id % 19 = 0, cast(event_id as string), 'x')) as supersedes,
    if(event_id % 4 = 0, cast(array() as array<struct<sha256: string, expected: string>>), array(struct('a' as sha256, if(event_id % 23 = 0, 'b', 'a') as expected))) as evidence,
    if(event_id % 6 = 0, cast(array() as array<struct<sha256: string, expected: string>>), array(struct('a' as sha256, 'a' as expected))) as depends_on,
    if(event_id % 9 = 0, struct('s' as symptom, if(event_id % 18 = 0, 'supported', 'maybe') as verdict), null) as attempt)"""


def sample_records(read):
    return read("events").select("event_id", F.expr(RECORD).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 11 = 0 THEN 'identity' END, CASE WHEN event_id % 7 = 0 THEN 'kind' END, CASE WHEN event_id % 13 = 0 THEN 'scope' END, CASE WHEN event_id % 5 = 0 THEN 'timezone' END, CASE WHEN event_id % 5 = 0 THEN 'timeline' END, CASE WHEN event_id % 17 = 0 THEN 'expired' END, CASE WHEN event_id % 19 = 0 THEN 'supersedes' END, CASE WHEN event_id % 4 = 0 AND event_id % 2 = 0 THEN 'evidence' END, CASE WHEN event_id % 23 = 0 AND event_id % 4 <> 0 THEN 'fingerprint' END, CASE WHEN event_id % 6 = 0 THEN 'dependencies' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events")
def f12_record_validity(read):
    found = records.reasons(records.record_checks(F.to_timestamp(F.lit(NOW))))
    return sample_records(read).select("event_id", F.array_join(found, ",").alias("reasons"))


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN '' WHEN event_id % 7 = 0 THEN 'attempt_kind' || CASE WHEN event_id % 18 <> 0 THEN ',attempt_verdict' ELSE '' END WHEN event_id % 18 <> 0 THEN 'attempt_verdict' ELSE '' END AS reasons FROM events")
def f13_optional_block(read):
    return sample_records(read).select("event_id", F.array_join(records.reasons(records.attempt_checks()), ",").alias("reasons"))


@query("SELECT user_id, event_id FROM events WHERE event_id < 5000")
def f14_resume_cut(read):
    return read("events").where("event_id < 5000").select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 4 = 3 THEN NULL ELSE value END AS kept FROM events")
def f15_scalar_filter(read):
    """Finite numbers stay; text, truth values and what isn't finite go."""
    raw = F.expr("case event_id % 4 when 0 then 'true' when 3 then 'NaN' else cast(value as string) end")
    number = raw.try_cast("double")
    return read("events").select("event_id", F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number).alias("kept"))


@query("SELECT event_id FROM events WHERE value >= 0 AND value = floor(value)")
def f16_whole_step(read):
    return read("events").where("value >= 0 and value = floor(value)").select("event_id")


@query(f"WITH {VE} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'state_size' WHEN vec_id % 5 = 0 THEN 'prompt' ELSE '' END AS reason FROM ve")
def f19_request_contract(read):
    v = vectors(read).select("vec_id", A.head("v", 14).alias("a"), A.head("v", 7).alias("b"))
    v = v.select("vec_id", F.expr("if(vec_id % 3 = 0, b, a)").alias("state"), F.expr("if(vec_id % 5 = 0, ' ', 'go')").alias("prompt"))
    return v.select("vec_id", F.coalesce(records.first_reason(records.request_checks("state", "prompt", 14)), F.lit("")).alias("reason"))


@query("SELECT vec_id, array_to_string(list_filter([CASE WHEN label > 6 THEN 'delay' END, CASE WHEN vec_id % 3 = 0 THEN 'target_tick' END, CASE WHEN vec_id % 5 = 0 THEN 'committed_tick' END], lambda x: x IS NOT NULL), ',') AS reasons FROM embeddings")
def f21_tick_checks(read):
    t = read("embeddings").select("vec_id", "label", F.col("vec_id").alias("observed"), F.expr("if(vec_id % 3 = 0, vec_id + 1, vec_id)").alias("target"))
    t = t.withColumn("committed", F.expr("if(vec_id % 5 = 0, target + 1, target)")).withColumn("prefix", F.array_repeat(F.lit(0.0), F.col("label").cast("int")))
    return t.select("vec_id", F.array_join(records.reasons(records.tick_checks("label", "observed", "target", "committed", "prefix", 6, 50)), ",").alias("reasons"))


@query("SELECT page_id, page_id % 3 = 0 AS safe FROM pages")
def f22_safe_identifier(read):
    name = F.expr("case page_id % 3 when 0 then 'a/b-1.txt' when 1 then '../up' else '/root' end")
    return read("pages").select("page_id", records.safe_identifier(name).alias("safe"))


@query("SELECT event_id, event_id % 5 = 0 OR value > 100 AS pending FROM events")
def f25_pending_upload(read):
    """Empty, or changed too recently: not complete yet. The value stands for the seconds that are left of the least age."""
    size = F.expr("if(event_id % 5 = 0, 0, 10)")
    return read("events").select("event_id", ((size == 0) | (F.col("value") > 100)).alias("pending"))


@query("SELECT l_suppkey, CASE WHEN n <> 9 THEN 'cases' WHEN top > 0.05 THEN 'max_abs' ELSE '' END AS reason FROM (SELECT s_suppkey AS l_suppkey, 9 - (s_suppkey % 2) AS n, s_suppkey % 10 / 100.0::DOUBLE AS top FROM supplier)")
def f26_promotion_gate(read):
    cases = F.transform(F.sequence(F.lit(1), F.lit(9) - (F.col("s_suppkey") % 2).cast("int")), lambda k: F.struct(F.element_at(F.array(F.lit(0), F.lit(1), F.lit(10)), (k % 3 + 1).cast("int")).alias("delay"), F.lit(True).alias("finite"), F.lit(True).alias("prefix_exact")))
    s = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), cases.alias("cases"), (F.col("s_suppkey") % 10 / F.lit(100.0)).alias("max_abs"), F.lit(0.0).alias("p99_abs"), F.lit("e").alias("engine_sha256"), F.lit("e").alias("report_sha256"))
    return s.select("l_suppkey", F.coalesce(records.first_reason(records.promotion_checks("cases", [0, 1, 10], 9, 0.05, 0.001)), F.lit("")).alias("reason"))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS resumes FROM customer")
def f27_contract_equality(read):
    """A resumed run's contract, as canonical JSON, must be the stored one."""
    stored, now = F.to_json(F.struct("c_name", "c_mktsegment")), F.to_json(F.struct("c_name", F.expr("if(c_custkey % 4 = 0, 'other', c_mktsegment)").alias("c_mktsegment")))
    return read("customer").select("c_custkey", (F.sha2(stored, 256) == F.sha2(now, 256)).alias("resumes"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'identical' WHEN 1 THEN 'without_last_line_end' ELSE 'differs' END AS relation FROM documents WHERE text IS NOT NULL AND NOT ends_with(text, chr(10))")
def f28_hash_identity(read):
    d = read("documents").where("text is not null").where(~F.col("text").endswith("\n"))
    expected = F.sha2(F.concat("text", F.expr("case doc_id % 3 when 0 then '' when 1 then '\\n' else 'x' end")).cast("binary"), 256)
    return d.select("doc_id", records.identity_relation(F.col("text"), expected).alias("relation"))


# --- Joins ----------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM (SELECT c_custkey, c_custkey * 10 AS s, c_custkey * 10 + 400 AS e FROM customer) k WHERE k.c_custkey = o_custkey AND o_orderkey >= s AND o_orderkey < e)")
def j02_range_semi(read):
    ranges = read("customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + 400).alias("end"))
    return joins.keep_ranges(read("orders").select("o_orderkey", "o_custkey"), ranges, "o_custkey", "o_orderkey")


@query("SELECT o_custkey, count(*) AS n, true AS ordered FROM orders GROUP BY 1")
def j03_manifest_order(read):
    """Manifest rows with their files by id; the positions of both must agree."""
    manifest = sampling.indexed(read("orders").select("o_custkey").distinct(), [F.col("o_custkey")], "at")
    files = sampling.indexed(read("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), [F.col("o_custkey")], "file_at")
    return manifest.join(files, "o_custkey").select("o_custkey", "n", (F.col("at") == F.col("file_at")).alias("ordered"))


@query(f"WITH {VE} SELECT a.vec_id, sha256(a.vec_id::VARCHAR) = sha256((a.vec_id - a.vec_id % 4 // 3)::VARCHAR) AS same_sample, round(abs(a.v[1] - b.v[1]), 6) AS diff FROM ve a JOIN ve b USING (vec_id)")
def j06_positional_pairs(read):
    """Reference and candidate samples by position; their hashes say whether it is the same sample."""
    v = vectors(read)
    a = v.select("vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("sha"), F.col("v")[0].alias("x"))
    b = v.select("vec_id", F.sha2((F.col("vec_id") - F.floor(F.col("vec_id") % 4 / 3)).cast("string"), 256).alias("sha_b"), F.col("v")[0].alias("y"))
    return a.join(b, "vec_id").select("vec_id", (F.col("sha") == F.col("sha_b")).alias("same_sample"), r(F.abs(F.col("x") - F.col("y")), 6).alias("diff"))


@query("SELECT s_suppkey, round(mae, 4) AS mae FROM supplier LEFT JOIN (SELECT l_suppkey, avg(abs(l_extendedprice / l_quantity - p_retailprice)) AS mae FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 2 = 0 GROUP BY 1) ON l_suppkey = s_suppkey")
def j11_run_with_comparison(read):
    c = episode_mae(read).where("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("s_suppkey"), r("mae").alias("mae"))
    return read("supplier").select("s_suppkey").join(c, "s_suppkey", "left")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c_nationkey' ELSE '' END AS differs, CASE WHEN c_custkey % 2 = 0 THEN 'c_mktsegment' ELSE '' END AS runtime, c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 AS comparable FROM customer")
def j12_confounder_gate(read):
    c = read("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    other = c.withColumns({"c_nationkey": F.expr("if(c_custkey % 3 = 0, c_nationkey + 1, c_nationkey)"), "c_mktsegment": F.expr("if(c_custkey % 2 = 0, 'x', c_mktsegment)")})
    out = records.confounders(c, other, "c_custkey", ["c_name", "c_nationkey"], ["c_mktsegment"], cross=False)
    return out.select("c_custkey", F.array_join("differs", ",").alias("differs"), F.array_join("runtime", ",").alias("runtime"), "comparable")


@query("SELECT c_custkey, coalesce(n, 0) AS length FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j13_metadata_update(read):
    """Lengths of all episodes by id; an episode without rows has none, one without id fails."""
    n = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    found = joins.left_default(read("customer").select("c_custkey"), n, "c_custkey", "n", 0)
    return joins.lookup(found.select("c_custkey"), found.select("c_custkey", F.col("n").alias("length")), "c_custkey", "length")


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def j14_subset_assertion(read):
    c = read("customer").select(F.col("c_custkey").alias("o_custkey"))
    return read("orders").select("o_custkey").distinct().join(c, "o_custkey", "left_anti").agg(F.count("*").alias("missing"))


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) SELECT event_id, round((value - m) / (d + 1e-6), 5) AS z FROM events, s")
def j15_apply_stats(read):
    s = read("events").agg(*stats.moments("value"))  # one row
    return read("events").crossJoin(F.broadcast(s)).select("event_id", r((F.col("value") - F.col("mean")) / (F.col("std") + 1e-6), 5).alias("z"))


@query("SELECT s_suppkey, 'run ' || CASE WHEN s_suppkey % 2 = 0 THEN 'jax' ELSE 'torch' END AS operation FROM supplier")
def j16_resolution(read):
    """model -> backend -> operation; an unknown name fails."""
    spark = read("supplier").sparkSession
    backends = readers.toml_table(spark, "[backends.jax]\nrun = 'run jax'\n[backends.torch]\nrun = 'run torch'\n", "backends").select(F.col("name").alias("backend"), F.col("settings")["run"].alias("operation"))
    s = read("supplier").select("s_suppkey", F.expr("if(s_suppkey % 2 = 0, 'jax', 'torch')").alias("backend"))
    return joins.lookup(s, F.broadcast(backends), "backend", "operation").select("s_suppkey", "operation")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j18_missing_files(read):
    return read("documents").select("doc_id").join(read("labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {VE} SELECT label, bool_and(vec_id % 7 <> 0) AS same, count(*) AS n, round(avg(abs(v[1] - v[2])), 6) AS mae FROM ve GROUP BY 1")
def j19_stored_runs(read):
    """Two stored runs, exactly equal or not, and the error against a third."""
    v = vectors(read).select("vec_id", "label", F.col("v")[0].alias("a"), F.expr("if(vec_id % 7 = 0, v[0] + 1, v[0])").alias("b"), F.col("v")[1].alias("c"))
    both = v.select("vec_id", "label", "a", "c").join(v.select("vec_id", "b"), "vec_id", "full")
    return both.groupBy("label").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"), F.count("*").alias("n"), r(F.avg(F.abs(F.col("a") - F.col("c"))), 6).alias("mae"))


@query("SELECT DISTINCT event_type || '/k' AS name FROM events")
def a22_key_union(read):
    """The union of all rows' metric names."""
    e = read("events").select(F.create_map(F.concat("event_type", F.lit("/k")), "value").alias("m"))
    return e.select(F.explode(F.map_keys("m")).alias("name")).distinct()


@query("SELECT o_orderstatus, count(DISTINCT l_linestatus) = 1 AS one, min(l_linestatus) AS fps FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a24_one_rate(read):
    """Exactly one rate for each selection."""
    both = read("orders").select("o_orderkey", "o_orderstatus").join(read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus"), "o_orderkey")
    return both.groupBy("o_orderstatus").agg((F.countDistinct("l_linestatus") == 1).alias("one"), F.min("l_linestatus").alias("fps"))


@query("WITH m AS (SELECT user_id, event_type, max(value) AS top FROM events GROUP BY 1, 2) SELECT user_id, round(max(top), 6) AS worst, count(*) = 5 AS seen_all FROM m GROUP BY 1")
def a33_protocol_receipt(read):
    """Of each case the greatest step, and whether every required kind was seen."""
    kinds = read("events").select("event_type").distinct().count()
    m = read("events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    return m.groupBy("user_id").agg(r(F.max("top"), 6).alias("worst"), (F.count("*") == kinds).alias("seen_all"))


@query("WITH a AS (SELECT p_partkey AS k FROM part), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem) SELECT coalesce(a.k, b.k) AS k FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def u05_key_difference(read):
    b = read("lineitem").select(F.col("l_suppkey").alias("k"), F.lit(1).alias("y")).distinct()
    both = joins.compare(read("part").select(F.col("p_partkey").alias("k"), F.lit(1).alias("y")), b, ["k"], "y")
    return both.where(F.col("status").isin("left_only", "right_only")).select("k")


@query()
def u07_weighted_sources(read):
    """Nine tenths and one tenth, each source with its own kept ranges."""
    e = events_frames(read).select("user_id", "event_id", "frame")
    span = lambda a, b: e.select("user_id").distinct().select("user_id", F.lit(a).alias("start"), F.lit(b).alias("end"))
    return sampling.mixture({"main": joins.keep_ranges(e, span(0, 50), "user_id", "frame"), "extra": joins.keep_ranges(e, span(10, 20), "user_id", "frame")}, {"main": 0.9, "extra": 0.1}, 500, 11, "event_id")


@query("SELECT doc_id, score FROM (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5")
def t03_ranked_budget(read):
    """The best records that fit a budget of bytes; what doesn't fit is skipped, not the end. At most the top is packed."""
    top = search.search(read("documents"), "doc_id", "text", "the tion", 5)
    rows = top.select("doc_id", "score", F.to_json(F.struct("doc_id", "score")).alias("j")).orderBy(F.desc("score"), "doc_id").collect()
    kept = search.pack([(x.doc_id, x.j) for x in rows], 4000)
    return top.where(F.col("doc_id").isin(kept or [None]))


# --- Integrity of datasets ------------------------------------------------------------------------------------------
SELECTED = "user_id % 3 = 0"
JUMP = "d AS (SELECT user_id, frame, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) AS j FROM fr), m AS (SELECT user_id, max(j) AS worst, count(*) FILTER (WHERE value > 200) AS n_out FROM d GROUP BY 1)"


@query(f"WITH {FR}, {JUMP} SELECT CASE WHEN grouping(sel) = 1 THEN 'all' WHEN sel THEN 'selected' ELSE 'rest' END AS grp, count(*) AS n, sum(n_out)::BIGINT AS n_out, round(quantile_cont(worst, 0.5), 6) AS median, round(quantile_cont(worst, 0.99), 6) AS q99, round(max(worst), 6) AS maximum FROM (SELECT *, {SELECTED} AS sel FROM m) GROUP BY GROUPING SETS ((), (sel))")
def d02_distribution_audit(read):
    """Greatest jumps of episodes, for all, for a selection and for the rest."""
    e = frames.adjacent_diff(events_frames(read), "user_id", "frame", "value")
    m = e.groupBy("user_id").agg(F.max(F.abs("diff")).alias("worst"), F.count_if(F.col("value") > 200).alias("n_out"))
    m = m.select("worst", "n_out", F.explode(F.array(F.lit("all"), F.when(F.expr(SELECTED), "selected").otherwise("rest"))).alias("grp"))
    s = m.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_out").alias("n_out"), F.max("worst").alias("maximum"))
    s = s.join(stats.exact_percentiles(m, ["grp"], "worst", {"median": 0.5, "q99": 0.99}), "grp")
    return s.select("grp", "n", "n_out", *[r(c, 6).alias(c) for c in ("median", "q99", "maximum")])


@query("SELECT o_custkey, count(*) AS n, true AS same FROM orders GROUP BY 1")
def d03_copy_verification(read):
    """A copy against its source, episode by episode: every row there, none more, all values the same."""
    o = read("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    copy = writers.write_once(o, new_path(o.sparkSession, "copy"))
    both = joins.compare(o, copy, ["o_custkey", "o_orderkey"], "o_totalprice")
    return both.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "same").alias("same"))


@query("WITH s AS (SELECT * FROM orders WHERE o_custkey % 2 = 0) SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS episode, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS idx FROM s")
def d04_subset_conversion(read):
    """Chosen episodes, numbered anew: episode, frame and global index. The choice is the feature."""
    o = read("orders").where("o_custkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderdate")
    lengths = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    ids = frames.episode_ranges(sampling.indexed(lengths, [F.col("o_custkey")], "episode"), "o_custkey", "n").select("o_custkey", "episode", "index_from")
    out = frames.number(o.join(ids, "o_custkey"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", "episode", "frame", (F.col("index_from") + F.col("frame")).alias("idx"))


@query("SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT value AS x, row_number() OVER (ORDER BY event_id) - 1 AS idx, count(*) OVER () AS al FROM events) WHERE idx < al - al % 64")
def d06_generic_stats(read):
    """Statistics over whole batches only."""
    e = sampling.indexed(read("events").select("event_id", "value"), [F.col("event_id")], "at")
    n = e.count()
    s = e.where(F.col("at") < n - n % 64).agg(F.count("*").alias("n"), *stats.moments("value"))
    return s.select("n", r("mean", 6).alias("mean"), r("std", 6).alias("std"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1) SELECT o_custkey, n FROM (SELECT *, sum(n) OVER (ORDER BY o_custkey) - n AS b FROM c) WHERE b < 300")
def d07_bounded_selection(read):
    """Episodes that are known elsewhere, whole ones up to a duration; the one that crosses it is included."""
    known = read("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    n = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(known, "o_custkey", "left_semi")
    return frames.take_until(n, [F.col("o_custkey")], "n", 300).select("o_custkey", "n")


@query(f"WITH {FR}, c AS (SELECT *, min(CASE WHEN round_even(frame * 1.25, 0) >= 40 THEN frame END) OVER (PARTITION BY user_id) AS cut FROM fr) SELECT user_id, count(*) AS length, 3 AS task FROM c WHERE cut IS NULL OR frame < cut GROUP BY 1")
def d08_subset_repair(read):
    """Tails without pictures are cut, a column is set, and the new lengths are the metadata."""
    e = events_frames(read).withColumn("t", F.col("frame") * 1.25).withColumn("have", F.lit(40))
    e = frames.trim_tail(e, "user_id", "frame", "t", 1.0, "have").withColumn("task", F.lit(3))
    return e.groupBy("user_id").agg(F.count("*").alias("length"), F.max("task").alias("task"))


@query(f"WITH {FR} SELECT user_id, count(*) AS n, round(max(abs(frame / 30.0::DOUBLE - frame * 0.0333::DOUBLE)), 5) AS max_change FROM fr GROUP BY 1")
def d09_time_rewrite(read):
    e = events_frames(read).select("user_id", "frame", (F.col("frame") * F.lit(0.0333)).alias("time"))
    new = writers.rewritten(e.withColumn("old", F.col("time")), new_path(e.sparkSession, "times"), {"time": F.col("frame") / F.lit(30.0)})
    return new.groupBy("user_id").agg(F.count("*").alias("n"), r(F.max(F.abs(F.col("time") - F.col("old"))), 5).alias("max_change"))


@query(f"WITH {VE}{PAIR}, l AS (SELECT quantile_cont(value, 0.5) FILTER (WHERE event_type = 'view') / quantile_cont(value, 0.5) FILTER (WHERE event_type = 'click') AS s FROM events) SELECT round(avg(abs(d)), 6) AS mae, round(max(abs(d)), 6) AS max_abs, round(quantile_cont(abs(d), 0.95), 6) AS p95, round(any_value(s), 6) AS speedup FROM pr, l")
def d10_suite_comparison(read):
    """Errors of a candidate against its reference, and the ratio of the median latencies."""
    d = diffs(read).withColumn("d", F.abs("x"))
    p = stats.exact_percentiles(read("events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.5})
    speed = p.agg((F.max(F.expr("if(event_type = 'view', p50, null)")) / F.max(F.expr("if(event_type = 'click', p50, null)"))).alias("speedup"))
    s = d.agg(F.avg("d").alias("mae"), F.max("d").alias("max_abs")).crossJoin(stats.exact_percentiles(d, [], "d", {"p95": 0.95})).crossJoin(speed)  # one row each
    return s.select(*[r(c, 6).alias(c) for c in ("mae", "max_abs", "p95", "speedup")])


@query("WITH t AS (SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS episodes, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1) SELECT event_type, calls, episodes, round(p50, 6) AS p50, p50 = (SELECT min(p50) FROM t) AS best FROM t")
def d11_report(read):
    t = read("events").groupBy("event_type").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("episodes"))
    t = t.join(stats.exact_percentiles(read("events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.5}), "event_type")
    best = t.agg(F.min("p50").alias("least"))  # one row
    return t.crossJoin(best).select("event_type", "calls", "episodes", r("p50", 6).alias("p50"), (F.col("p50") == F.col("least")).alias("best"))


@query(f"WITH {FR}, t AS (SELECT user_id, frame AS target FROM (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, frame) AS k FROM fr) WHERE k = 1) SELECT t.user_id, t.target, fr.frame - t.target AS off, round((value - 0) / (100 - 0 + 1e-6) * 2 - 1, 6) AS scaled FROM t JOIN fr ON fr.user_id = t.user_id AND fr.frame BETWEEN t.target - 4 AND t.target + 4")
def d12_spike_inspection(read):
    """The surroundings of each episode's greatest value, scaled by quantiles."""
    e = events_frames(read).select("user_id", "frame", "value")
    t = e.groupBy("user_id").agg(F.max_by("frame", F.struct("value", -F.col("frame"))).alias("target"))
    t = t.select("user_id", "target", F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("off")).withColumn("frame", F.col("target") + F.col("off"))
    return t.join(e, ["user_id", "frame"]).select("user_id", "target", "off", r(A.quantile_scale(F.array("value"), [0], [100])[0], 6).alias("scaled"))


@query(f"WITH {FR}, p AS (SELECT user_id, unnest([10, n // 2, n - 10]) AS probe FROM (SELECT DISTINCT user_id, n FROM fr WHERE n > 20)) SELECT DISTINCT user_id, probe, event_id, round(value, 4) AS value FROM p JOIN fr USING (user_id) WHERE frame = probe")
def d13_replay_cases(read):
    """Early, middle and late frames of each long episode, with what was observed there."""
    e = events_frames(read).where("n > 20")
    n = e.groupBy("user_id").agg(F.max("n").alias("n"))
    p = n.select("user_id", F.explode(F.array(F.lit(10).cast("long"), F.floor(F.col("n") / 2), F.col("n") - 10)).alias("probe")).distinct()
    return p.join(e, (p["user_id"] == e["user_id"]) & (p["probe"] == e["frame"])).select(p["user_id"], "probe", "event_id", r("value").alias("value"))


@query("SELECT a.conv_id, a.turn AS asked_at, b.turn AS answered_at, left(b.text, 20) AS head FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def d14_incident_cases(read):
    c = read("conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("asked_at"), F.col("turn").alias("answered_at"), F.substring("text", 1, 20).alias("head"))
    return c.where("role = 'user'").select("conv_id", F.col("turn").alias("asked_at")).join(b, ["conv_id", "asked_at"])


@query("SELECT DISTINCT sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def d16_seen_hashes(read):
    """What a reader has seen by hash isn't packed again: of equal texts the one with the least id remains."""
    d = read("documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "doc_id")
    return d.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("sha")


@query("SELECT o_custkey, list_has_all(list(DISTINCT o_orderstatus), ['F', 'O']) AS roles, count(DISTINCT sha256(o_orderpriority)) AS hashes FROM orders GROUP BY 1")
def d17_bundle_manifest(read):
    """Whether a bundle holds every required role, and how many contents it has."""
    o = read("orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.countDistinct(F.sha2(F.col("o_orderpriority").cast("binary"), 256)).alias("hashes"))  # three statuses
    return o.select("o_custkey", (F.size(F.array_except(F.array(F.lit("F"), F.lit("O")), "s")) == 0).alias("roles"), "hashes")


@query(f"WITH {FR}, m AS (SELECT DISTINCT user_id, n FROM fr), p AS (SELECT user_id, n, unnest(list_sort(list_distinct([0::BIGINT, n // 2, greatest(0, n - 5), n - 1]))) AS probe FROM m) SELECT user_id, probe, greatest(0, probe + 5 - n)::INT AS pads FROM p")
def d18_loader_probe(read):
    e = frames.future_chunk(events_frames(read), "user_id", "frame", "value", 5)
    pads, _ = frames.tail_padding("chunk", "frame", "n", 5)
    probes = read("events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.explode(frames.probe_frames("n", 5)).alias("frame"))
    return e.join(probes, ["user_id", "frame"]).select("user_id", F.col("frame").alias("probe"), pads.alias("pads"))


@query(f"WITH {VE} SELECT vec_id, vec_id % 7 <> 0 AS agree FROM ve")
def d20_run_agreement(read):
    """Three runs of a sample agree within a tolerance."""
    v = vectors(read).select("vec_id", F.array(F.col("v")[0], F.col("v")[0] + 1e-9, F.expr("if(vec_id % 7 = 0, v[0] + 1, v[0])")).alias("runs"))
    return v.select("vec_id", (F.array_max("runs") - F.array_min("runs") <= 1e-6).alias("agree"))


@query("SELECT lang, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS fingerprint FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def d22_fingerprint(read):
    """One hash of a set of files: the hash of its sorted path:hash list."""
    d = read("documents").where("text is not null and lang is not null").select("lang", "doc_id", F.concat_ws(":", "doc_id", F.sha2(F.col("text").cast("binary"), 256)).alias("x"))
    whole = d.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", "x"))).alias("all"))
    return whole.select("lang", F.sha2(F.array_join(F.transform("all", lambda e: e["x"]), ",").cast("binary"), 256).alias("fingerprint"))


@query("SELECT doc_id, sha256(text) AS parent, 'v2' AS stats FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0")
def d23_rebinding(read):
    """Samples whose hash is still the stored one get the new identity and keep their parent's hash."""
    d = read("documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("now"))
    stored = d.select("doc_id", F.expr("if(doc_id % 5 = 0, 'changed', now)").alias("parent"))
    return d.join(stored, "doc_id").where("now = parent").select("doc_id", "parent", F.lit("v2").alias("stats"))


@query("SELECT user_id, count(*) AS n, CASE WHEN max(event_id) % 2 = 0 THEN 'finished' ELSE 'started' END AS state FROM events GROUP BY 1")
def d24_run_lifecycle(read):
    """The last record of a run says where it stands; records are only ever added."""
    state = F.expr("if(event_id % 2 = 0, 'finished', 'started')")
    return read("events").withColumn("state", state).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("state", "event_id").alias("state"))

