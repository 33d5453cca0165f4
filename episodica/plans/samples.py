"""Named queries of sample transforms, token functions and per-sample statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import frames, records, stats
from ..operators import transforms as TR
from .catalog import FIRST, FR, MASK, MASK_SQL, PAIR, VE, diffs, digest, digest_sql, episode_mae, events_frames, query, r, vectors, with_state

ZEROS = "list_transform(range({}), lambda x: 0.0::DOUBLE)"


# --- Samples --------------------------------------------------------------------------------------------------------
NESTED = "struct(user_id as user, struct(value as v, event_type as kind) as obs, struct(ts) as meta)"


def nested(read):
    return read("events").select("event_id", F.expr(NESTED).alias("s")).select("event_id", "s.*")


@query("SELECT event_id, value AS state, event_type AS prompt FROM events")
def p01_repack(read):
    out = nested(read).transform(TR.repack({"event_id": "event_id", "inputs": {"state": "obs/v", "prompt": "obs/kind"}}))
    return out.select("event_id", "inputs.*")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'do something' ELSE event_type END AS prompt FROM events")
def p04_default_prompt(read):
    e = read("events").select("event_id", F.expr("nullif(event_type, 'view')").alias("prompt"))
    return TR.default_prompt("do something")(e)


@query('SELECT event_id, user_id AS "user", value AS "obs/v", event_type AS "obs/kind" FROM events')
def p05_flatten_unflatten(read):
    """Flattened, nested again, flattened again."""
    return TR.flatten(TR.unflatten(TR.flatten(nested(read)))).drop("meta/ts")


@query('SELECT event_id, value AS "in_v", event_type AS "in_kind" FROM events')
def p06_regex_rename(read):
    return TR.flatten(nested(read)).transform(TR.rename([("obs/(.*)", r"in_\1"), ("meta/.*|user", None)]))


@query("SELECT event_id, value * 2 AS value FROM events")
def p07_apply_present(read):
    return read("events").select("event_id", "value").transform(TR.apply_to({"value": lambda c: c * 2, "absent": lambda c: c + 1}))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p08_drop_strings(read):
    return TR.drop_strings(read("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("SELECT event_id, (value + 1) * 2 AS value FROM events")
def p02_compose(read):
    steps = [TR.apply_to({"value": lambda c: c + 1}), TR.apply_to({"value": lambda c: c * 2})]
    return read("events").select("event_id", "value").transform(TR.compose(*steps))


def pipeline():
    return TR.CONFIGURATIONS.get("committed_prefix", mean=[0.1] * 14, std=[2.0] * 14, mask=MASK, real=14, n=32)


def state_action(read):
    return with_state(read).select("vec_id", F.slice("s", 1, 14).alias("state"), F.slice("v", 1, 14).alias("action"))


@query(digest_sql("v[1:14]"))
def p03_group_round_trip(read):
    """Forward steps in order, backward ones in the inverse order: the actions come back."""
    return digest(pipeline().undo(pipeline().apply(state_action(read))), F.col("action"), "vec_id")


N33 = f"list_concat(list_transform(v[1:14], lambda x, i: ((x - CASE WHEN {MASK_SQL}[i] THEN s[i] ELSE 0 END) - 0.1) / (2.0 + 1e-6)), {ZEROS.format(18)})"


@query(digest_sql(N33, "fs", ctes=VE + FIRST))
def n33_committed_prefix(read):
    return digest(pipeline().apply(state_action(read)), F.col("action"), "vec_id")


@query(digest_sql(f"list_concat(list_concat(v[1:14], {ZEROS.format(18)}), list_concat(v[15:28], {ZEROS.format(18)}))"))
def p11_pad_state_actions(read):
    v = vectors(read).select("vec_id", A.pad(A.head("v", 14), 32).alias("state"), A.pad(F.slice("v", 15, 14), 32).alias("action"))
    return digest(v, F.concat("state", "action"), "vec_id")


@query(digest_sql(f"list_filter(v[1:14], lambda x, i: {MASK_SQL}[i])"))
def p13_bool_mask(read):
    on = F.array(*[F.lit(m) for m in A.bool_mask(6, -1, 6, -1)])
    return digest(vectors(read), F.filter(A.head("v", 14), lambda x, i: F.get(on, i)), "vec_id")


@query("SELECT vec_id, 14 AS n_state, 12 AS n_bytes, 1 + (label % 2)::INT AS n_seen FROM embeddings")
def p18_robot_input(read):
    """A view that the robot lacks is an image of zeros; whether it counts as seen depends on the model family."""
    v = vectors(read).select("vec_id", "label", A.head("v", 14).alias("joints"), F.lit(bytes(12)).alias("top"))
    both = [TR.robot_input(v.where(F.col("label") % 2 == k), "joints", {"top": "top", "left": None}, f) for k, f in ((1, "fast"), (0, "flow"))]
    out = both[0].unionByName(both[1])
    return out.select("vec_id", F.size("state").alias("n_state"), F.octet_length("image_left").alias("n_bytes"), (F.col("mask_top").cast("int") + F.col("mask_left").cast("int")).alias("n_seen"))


@query(digest_sql("list_concat(v[1:7], [v[8]])"))
def p19_concat_gripper(read):
    return digest(vectors(read), F.concat(A.head("v", 7), F.array(F.col("v")[7])), "vec_id")


@query("SELECT label, label % 2 = 1 AS seen, count(*) AS n FROM embeddings GROUP BY 1")
def p20_view_mask(read):
    family = F.when(F.col("label") % 2 == 1, "fast").otherwise("flow")
    return read("embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", TR.view_mask(family).alias("seen"), "n")


@query(f"WITH {VE}, x AS (SELECT vec_id, least(abs(v[1]), 1) AS x FROM ve), l AS (SELECT *, x * (0.058 - 0.01844) + 0.01844 AS p FROM x) SELECT vec_id, round((asin(greatest(-1, least(1, (p * p + 0.022 * 0.022 - 0.036 * 0.036) / (2 * 0.022 * p)))) - 0.5476) / (1.6296 - 0.5476), 6) AS angle, round((x + 0.5476 + 0.6213) / (1.491 + 0.6213), 6) AS robot, round(x, 6) AS back FROM l")
def p21_gripper_maps(read):
    x = vectors(read).select("vec_id", F.least(F.abs(F.col("v")[0]), F.lit(1.0)).alias("x"))
    robot = A.gripper_from_angle("x")
    return x.select("vec_id", r(A.gripper_to_angle("x"), 6).alias("angle"), r(robot, 6).alias("robot"), r(A.gripper_from_angle_inverse(robot), 6).alias("back"))


@query(digest_sql("list_transform(v, lambda x: floor(abs(x) * 50) % 256 / 255.0::DOUBLE * 2 - 1)"))
def p24_bytes_affine(read):
    return digest(vectors(read), A.bytes_affine(F.transform("v", lambda x: F.floor(F.abs(x) * 50) % 256)), "vec_id")


@query("SELECT event_id, value AS step_seconds, event_type AS kind FROM events")
def p31_rename_metrics(read):
    return read("events").select("event_id", "value", "event_type").withColumnsRenamed({"value": "step_seconds", "event_type": "kind"})


@query(f"WITH {VE} SELECT vec_id // 32 AS batch, count(*) AS n, round(sum(v[1]), 4) AS firsts, arg_min(label, vec_id) AS head FROM ve GROUP BY 1")
def p32_collate(read):
    b = vectors(read).groupBy(F.floor(F.col("vec_id") / 32).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "v"))).alias("rows"))  # 32 rows each
    return b.select("batch", F.size("rows").alias("n"), r(F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["v"][0])).alias("firsts"), F.col("rows")[0]["label"].alias("head"))


# --- Tokens and prompts ---------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, role, translate(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '_', ' ') AS low FROM conversations")
def n07_prompt_lower(read):
    return read("conversations").select("conv_id", "turn", "role", X.clean_prompt_lower("text").alias("low"))


@query("WITH t AS (SELECT doc_id, least(len(string_split(text, ' ')), 40) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n // 3 AS zeros, n - n // 3 AS losses, n AS size FROM t")
def n10_prefix_masks(read):
    t = read("documents").where("text is not null").select("doc_id", F.least(F.size(F.split("text", " ", -1)), F.lit(40)).alias("n"))
    t = t.withColumn("p", F.floor(F.col("n") / 3).cast("int"))
    ar, loss = A.prefix_postfix_masks("p", F.col("n") - F.col("p"))
    return t.select("doc_id", F.size(F.filter(ar, lambda x: x == 0)).alias("zeros"), F.size(F.filter(loss, lambda x: x)).alias("losses"), F.size(ar).alias("size"))


@query("WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x Action: ' || event_type || ' ' || user_id || ' | z Action: q' WHEN 1 THEN 'Action: a Action: b' ELSE 'none' END AS s FROM events) SELECT event_id, CASE WHEN contains(s, 'Action: ') THEN trim(string_split(string_split(s, 'Action: ')[2], '|')[1]) END AS answer FROM t")
def n11_answer(read):
    s = F.expr("case event_id % 3 when 0 then concat('x Action: ', event_type, ' ', user_id, ' | z Action: q') when 1 then 'Action: a Action: b' else 'none' end")
    return read("events").select("event_id", X.answer(s).alias("answer"))


@query("SELECT event_id, 257151 - 128 - event_id % 1000 AS token FROM events")
def n12_token_remap(read):
    return read("events").select("event_id", F.get(A.remap_tokens(F.array(F.col("event_id") % 1000), 257152, 128), F.lit(0)).alias("token"))


@query(f"WITH {VE}, t AS (SELECT vec_id, CASE WHEN label = 0 THEN [] ELSE list_transform(v[1:8], lambda x: floor(abs(x) * 100) % 256) END AS t FROM ve) SELECT vec_id, round(CASE WHEN len(t) < 6 THEN 0 ELSE list_sum(list_transform(t[1:6], lambda x, i: (x / 256.0::DOUBLE * 2 - 1) * i)) END, 6) AS wsum FROM t")
def n13_bin_decode(read):
    t = F.when(F.col("label") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(A.head("v", 8), lambda x: F.floor(F.abs(x) * 100) % 256))
    return vectors(read).select("vec_id", r(A.weighted_sum(F.flatten(A.decode_bins(t, 2, 3, 256))), 6).alias("wsum"))


@query(f"WITH {VE}, q AS (SELECT vec_id, list_transform(v[1:3], lambda x, i: round_even((tanh(x) + 1) * ([8, 6, 5][i] - 1) / 2, 0)) AS d FROM ve) SELECT vec_id, (d[1] + d[2] * 8 + d[3] * 48)::BIGINT AS token, round(list_sum(list_transform(d, lambda x, i: x / ([8, 6, 5][i] - 1) * 2 - 1)), 6) AS back FROM q")
def n16_scalar_quantize(read):
    q = vectors(read).select("vec_id", A.quantize(A.head("v", 3), [8, 6, 5]).alias("d"))
    return q.select("vec_id", A.mixed_radix("d", [8, 6, 5]).alias("token"), r(F.aggregate(A.dequantize("d", [8, 6, 5]), F.lit(0.0), lambda s, x: s + x), 6).alias("back"))


@query(f"WITH {FR} SELECT user_id, round(max(abs((frame / 30.0::DOUBLE)::FLOAT::DOUBLE - (frame * 0.0333::DOUBLE))), 5) AS max_change FROM fr GROUP BY 1")
def n18_time_recompute(read):
    new = (F.col("frame") / F.lit(30.0)).cast("float").cast("double")
    return events_frames(read).groupBy("user_id").agg(r(F.max(F.abs(new - F.col("frame") * F.lit(0.0333))), 5).alias("max_change"))


@query(f"WITH {FR} SELECT user_id, frame FROM fr WHERE frame IN (SELECT unnest(range(2, 40, 3)))")
def n20_episode_spec(read):
    return events_frames(read).where(F.col("frame").isin(X.parse_spec("2:40:3"))).select("user_id", "frame")


@query(f"WITH {FR} SELECT user_id, frame FROM fr WHERE frame >= 5 AND frame < 12")
def n21_start_end(read):
    start, end = X.parse_range("5:12")
    return events_frames(read).where((F.col("frame") >= start) & (F.col("frame") < end)).select("user_id", "frame")


SECTION = ("# A\nfirst\n## B\n", "\n```\n# A\n```\n# C\nlast\n")


@query("SELECT doc_id, '## B' || chr(10) || coalesce(lang, '') || chr(10) || '```' || chr(10) || '# A' || chr(10) || '```' || chr(10) AS section FROM documents")
def n24_sections(read):
    d = read("documents").select("doc_id", F.concat(F.lit(SECTION[0]), F.coalesce("lang", F.lit("")), F.lit(SECTION[1])).alias("text"))
    return X.sections(d, "doc_id", "text", "B")


@query("SELECT event_id, event_id % 3 <> 0 AS fine, CASE WHEN event_id % 3 = 0 THEN NULL ELSE floor(epoch(ts))::BIGINT - CASE event_id % 3 WHEN 1 THEN 7200 ELSE 0 END END AS seconds FROM events")
def n25_iso_offset(read):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.expr("case event_id % 3 when 0 then '' when 1 then '+02:00' else 'Z' end"))
    return read("events").select("event_id", X.has_offset(iso).alias("fine"), F.unix_timestamp(X.timestamp(iso)).alias("seconds"))


@query("SELECT event_id, round(list_sum(list_transform(range(4), lambda k: (k + 1) * sin(event_id % 100 * 2 * 3.141592653589793 / (0.1 * (100.0::DOUBLE ** (k / 3.0::DOUBLE)))))) + list_sum(list_transform(range(4), lambda k: (k + 5) * cos(event_id % 100 * 2 * 3.141592653589793 / (0.1 * (100.0::DOUBLE ** (k / 3.0::DOUBLE)))))), 4) AS wsum FROM events")
def n27_sincos(read):
    return read("events").select("event_id", r(A.weighted_sum(A.sincos(F.col("event_id") % 100, 8, 0.1, 10.0))).alias("wsum"))


@query("SELECT c_custkey, 'Customer ' || c_name || ' of ' || c_mktsegment || '.' AS text FROM customer")
def n29_template(read):
    return read("customer").select("c_custkey", X.template("Customer {name} of {segment}.", {"name": "c_name", "segment": "c_mktsegment"}).alias("text"))


@query("""SELECT event_id, strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') + 1 AS size FROM events""")
def n30_json_size(read):
    return read("events").select("event_id", X.json_size("event_id", "event_type").alias("size"))


@query("SELECT event_id, CASE WHEN event_id < 100 THEN round(1e-3 / 101 + (1e-3 - 1e-3 / 101) * event_id / 100, 9) ELSE round(1e-3 / sqrt((1000 + (event_id - 100)) / 1000.0::DOUBLE), 9) END AS lr FROM events")
def n26_rsqrt_schedule(read):
    return read("events").select("event_id", r(X.rsqrt_decay("event_id", 100, 1e-3, 1000), 9).alias("lr"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS n_terms, regexp_extract(lower(text), '[a-z0-9_]+') AS first FROM documents WHERE text IS NOT NULL")
def n23_terms(read):
    return read("documents").where("text is not null").select("doc_id", X.terms("text").alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY k), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS k FROM conversations GROUP BY 1, 2) GROUP BY 1")
def u04_ordered_distinct(read):
    c = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))  # a conversation's turns
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


# --- Windows of samples ---------------------------------------------------------------------------------------------
@query(f"WITH {VE} SELECT vec_id, len(list_filter(v[1:16], lambda x: x > 0))::INT - 1 AS last, (len(list_filter(v[1:8], lambda x: x > 0)) - 1)::INT AS eighth FROM ve")
def w07_position_ids(read):
    p = vectors(read).select("vec_id", A.position_ids(F.transform(A.head("v", 16), lambda x: x > 0)).alias("p"))
    return p.select("vec_id", F.element_at("p", -1).alias("last"), F.col("p")[7].alias("eighth"))


@query(f"WITH {VE}, q AS (SELECT vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM ve) SELECT vec_id, round(list_max(list_transform(range(1, 7), lambda j: abs(v[j] - p[j]))), 6) AS jump FROM q WHERE p IS NOT NULL")
def w08_seam_jump(read):
    v = vectors(read).withColumn("p", F.lag("v").over(W.partitionBy("label").orderBy("vec_id"))).where("p is not null")
    return v.withColumn("chunk", F.array("v")).select("vec_id", r(frames.seam_jump("chunk", F.col("p"), list(range(6))), 6).alias("jump"))


SOFT = "CASE WHEN i - 1 < 5 THEN 1 WHEN i - 1 < 40 THEN (40 - (i - 1)) / 36.0::DOUBLE * (exp((40 - (i - 1)) / 36.0::DOUBLE) - 1) / (exp(1) - 1) ELSE 0 END"


@query(f"WITH {VE} SELECT vec_id, round(list_sum(list_transform(v[1:50], lambda x, i: x * {SOFT})), 4) AS total FROM ve")
def w11_soft_weights(read):
    weighted = F.zip_with(A.head("v", 50), A.doubles(A.soft_weights(5, 40, 50)), lambda x, w: x * w)
    return vectors(read).select("vec_id", r(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT vec_id, least(label, 50)::INT AS committed FROM embeddings")
def w12_prefix_mask(read):
    return read("embeddings").select("vec_id", F.size(F.filter(A.prefix_mask(50, "label"), lambda x: x)).alias("committed"))


@query(f"WITH {FR} SELECT user_id, frame, greatest(0, frame + 5 - n)::INT AS pads, frame + 5 > n OR lead(value, 4) OVER w = lead(value, 3) OVER w AS equal FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame)")
def w13_tail_check(read):
    e = frames.future_chunk(events_frames(read), "user_id", "frame", "value", 5)
    pads, equal = frames.tail_padding("chunk", "frame", "n", 5)
    return e.select("user_id", "frame", pads.alias("pads"), equal.alias("equal"))


@query(f"WITH {VE}, q AS (SELECT vec_id, label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM ve) SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: (x - p[i]) * i)), 4) AS wsum FROM q WHERE p IS NOT NULL")
def w02_vector_diff(read):
    v = vectors(read).withColumn("p", F.lag("v").over(W.partitionBy("label").orderBy("vec_id"))).where("p is not null")
    return v.select("vec_id", r(A.weighted_sum(F.zip_with("v", "p", lambda x, y: x - y))).alias("wsum"))


# --- Statistics -----------------------------------------------------------------------------------------------------
@query("WITH m AS (SELECT user_id, max(value) AS v FROM events GROUP BY 1) SELECT round(min(v), 6) AS minimum, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99), 6) AS q99, round(quantile_cont(v, 0.999), 6) AS q999, round(max(v), 6) AS maximum FROM m")
def a06_maxima_summary(read):
    m = read("events").groupBy("user_id").agg(F.max("value").alias("v"))
    q = stats.exact_percentiles(m, [], "v", {"median": 0.5, "q99": 0.99, "q999": 0.999})
    s = m.agg(F.min("v").alias("minimum"), F.max("v").alias("maximum")).crossJoin(q)  # one row each
    return s.select(*[r(c, 6).alias(c) for c in ("minimum", "median", "q99", "q999", "maximum")])


@query(f"WITH {VE} SELECT dim, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM (SELECT unnest(range(len(v))) AS dim, unnest(v) AS x FROM ve) GROUP BY dim")
def a10_dim_ranges(read):
    return stats.explode_dims(vectors(read), [], "v").groupBy("dim").agg(r(F.min("x"), 6).alias("lo"), r(F.max("x"), 6).alias("hi"))


@query("WITH m AS (SELECT mean_of.user_id, avg(value) AS mae FROM (SELECT user_id, abs(value) AS value FROM events) mean_of GROUP BY 1) SELECT round(avg(mae), 6) AS mean, round(quantile_cont(mae, 0.5), 6) AS median, round(stddev_pop(mae), 6) AS std, count(*) AS n FROM m")
def a18_evaluation_summary(read):
    """Over episodes, not over frames."""
    m = read("events").groupBy("user_id").agg(F.avg(F.abs("value")).alias("mae"))
    s = m.agg(*stats.moments("mae"), F.count("*").alias("n")).crossJoin(stats.exact_percentiles(m, [], "mae", {"median": 0.5}))  # one row each
    return s.select(*[r(c, 6).alias(c) for c in ("mean", "median", "std")], "n")


@query("SELECT user_id, event_id // 100 AS interval, round(avg(CASE WHEN event_type <> 'view' THEN value END), 6) AS value FROM events GROUP BY 1, 2")
def a20_interval_mean_nulls(read):
    e = read("events").withColumn("value", F.expr("if(event_type <> 'view', value, null)"))
    return e.groupBy("user_id", F.floor(F.col("event_id") / 100).alias("interval")).agg(r(F.avg("value"), 6).alias("value"))


@query(f"WITH {VE} SELECT vec_id, round(list_avg(list_transform(v[1:50], lambda x, i: CASE WHEN i <= label THEN 0 ELSE x * x * 50 / greatest(50 - label, 1) END)), 6) AS loss FROM ve")
def a26_postfix_mean(read):
    loss = F.transform(A.head("v", 50), lambda x: x * x)
    out = stats.postfix_mean(loss, F.col("label").cast("int"))
    return vectors(read).select("vec_id", r(F.aggregate(out, F.lit(0.0), lambda s, x: s + x) / 50, 6).alias("loss"))


@query("SELECT event_type, max(value) AS peak, max(user_id) AS last FROM events GROUP BY 1")
def a30_peaks(read):
    return read("events").groupBy("event_type").agg(F.max("value").alias("peak"), F.max("user_id").alias("last"))


@query(f"WITH {VE}{PAIR} SELECT vec_id, round(max(abs(d)), 6) AS max_all, round(max(abs(d)) FILTER (WHERE dim < 14), 6) AS max_real, round(avg(abs(d)) FILTER (WHERE dim < 14), 6) AS mean_real, bool_and(d = 0) AS exact FROM pr GROUP BY 1")
def a31_drift(read):
    d = diffs(read).groupBy("vec_id").agg(*stats.drift("x", "dim", 14))
    return d.select("vec_id", *[r(c, 6).alias(c) for c in ("max_all", "max_real", "mean_real")], "exact")


@query("WITH t AS (SELECT event_type, CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE ELSE value END AS x FROM events) SELECT event_type, count(x) AS n, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf FROM t GROUP BY 1")
def a32_nonfinite_census(read):
    e = read("events").withColumn("x", F.expr("case event_id % 7 when 0 then double('nan') when 1 then double('-infinity') else value end"))
    return e.groupBy("event_type").agg(*stats.nonfinite_census("x"))


@query("WITH l AS (SELECT event_type, user_id, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1, 2), p AS (SELECT event_type, quantile_cont(value, 0.5) AS pooled_p50, quantile_cont(value, 0.95) AS pooled_p95 FROM events GROUP BY 1) SELECT event_type, round(any_value(pooled_p50), 6) AS pooled_p50, round(any_value(pooled_p95), 6) AS pooled_p95, round(max(p50), 6) AS worst_p50 FROM l JOIN p USING (event_type) GROUP BY 1")
def a34_pooled_latency(read):
    """Pooled figures come from all repeats, not from the samples' medians."""
    e = read("events").select("event_type", "user_id", "value")
    pooled = stats.exact_percentiles(e, ["event_type"], "value", {"pooled_p50": 0.5, "pooled_p95": 0.95})
    worst = stats.exact_percentiles(e, ["event_type", "user_id"], "value", {"p50": 0.5}).groupBy("event_type").agg(F.max("p50").alias("worst_p50"))
    return pooled.join(worst, "event_type").select("event_type", *[r(c, 6).alias(c) for c in ("pooled_p50", "pooled_p95", "worst_p50")])


@query("SELECT event_id, round(value * 0.25, 6) AS waited, round(value - value * 0.25, 6) AS computed FROM events")
def a35_time_split(read):
    waited = F.col("value") * 0.25
    return read("events").select("event_id", r(waited, 6).alias("waited"), r(F.col("value") - waited, 6).alias("computed"))


@query("SELECT count(DISTINCT user_id) AS episodes, count(*) AS calls, count(*) FILTER (WHERE event_type = 'purchase') AS formal FROM events")
def a25_totals(read):
    return read("events").agg(F.countDistinct("user_id").alias("episodes"), F.count("*").alias("calls"), F.count_if(F.col("event_type") == "purchase").alias("formal"))


@query("SELECT l_suppkey, round(mae, 4) AS mae FROM (SELECT l_suppkey, avg(abs(l_extendedprice / l_quantity - p_retailprice)) AS mae FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ORDER BY mae DESC, l_suppkey LIMIT 10")
def t02_worst_by_mae(read):
    return episode_mae(read).orderBy(F.desc("mae"), "l_suppkey").limit(10).select("l_suppkey", r("mae").alias("mae"))


@query(f"WITH {FR} SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY frame) AS ids FROM fr WHERE frame < 8 GROUP BY 1")
def t04_frames_in_order(read):
    e = events_frames(read).where("frame < 8").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("frame", "event_id"))).alias("f"))  # 8 rows each
    return e.select("user_id", F.array_join(F.transform("f", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def t06_first_rows(read):
    return read("orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("SELECT user_id, arg_max(event_id, event_id) AS line_no FROM events WHERE event_type = 'purchase' GROUP BY 1")
def t09_last_error_line(read):
    """The last line with a mark in it, for each log."""
    return read("events").where(F.contains("event_type", F.lit("purchase"))).groupBy("user_id").agg(F.max_by("event_id", "event_id").alias("line_no"))


@query("SELECT user_id, max(event_id) AS latest FROM events WHERE event_id % 5 = 0 GROUP BY 1")
def t10_latest_checkpoint(read):
    """Names that are whole numbers count, by their value; others don't."""
    name = F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("tmp"), "event_id"))
    e = read("events").select("user_id", F.try_cast(name, "long").alias("step")) if hasattr(F, "try_cast") else read("events").select("user_id", name.try_cast("long").alias("step"))
    return e.where("step is not null").groupBy("user_id").agg(F.max("step").alias("latest"))


# --- Guards of samples ----------------------------------------------------------------------------------------------
JOINTS = [0, 1, 2, 3, 4, 5]
STEP = "list_max(list_transform(range(1, 7), lambda j: abs({a}[j] - {b}[j])))"


@query(f"WITH {VE}, q AS (SELECT vec_id, v[1:7] AS a, v[8:14] AS b, v[15:21] AS c, v[22:28] AS s, label % 2 AS d FROM ve) SELECT vec_id, round(greatest(CASE WHEN d = 0 THEN {STEP.format(a='s', b='a')} ELSE 0 END, {STEP.format(a='a', b='b')}, {STEP.format(a='b', b='c')}), 6) AS worst, greatest(CASE WHEN d = 0 THEN {STEP.format(a='s', b='a')} ELSE 0 END, {STEP.format(a='a', b='b')}, {STEP.format(a='b', b='c')}) <= 2.5 AS fine FROM q")
def f18_joint_step_guard(read):
    chunk = F.array(*[F.slice("v", k, 7) for k in (1, 8, 15)])
    q = vectors(read).select("vec_id", chunk.alias("chunk"), F.slice("v", 22, 7).alias("state"), (F.col("label") % 2).cast("int").alias("d"))
    worst, fine = records.joint_step_checks("state", "chunk", "d", JOINTS, 2.5)
    return q.select("vec_id", r(worst, 6).alias("worst"), fine.alias("fine"))


@query("WITH t AS (SELECT vec_id, (label * 2 - 4) + CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 0 END AS d, vec_id % 13 AS s FROM embeddings), u AS (SELECT vec_id, floor(d) <> d AS r, greatest(floor(d), 0)::BIGINT AS d0, s FROM t), w AS (SELECT *, least(d0, 10) AS d1 FROM u) SELECT vec_id, d1 AS d, least(greatest(s, d1), greatest(10 - d1, 0))::BIGINT AS s, r::INT + (d0 > 10)::INT + (s < d1)::INT + (greatest(s, d1) > greatest(10 - d1, 0))::INT AS n_warnings FROM w")
def f20_clamped_delays(read):
    t = read("embeddings").select("vec_id", F.expr("(label * 2 - 4) + if(vec_id % 2 = 0, 0.5d, 0d)").alias("d"), (F.col("vec_id") % 13).cast("double").alias("s"))
    d, s, said = records.clamp_delays("d", "s", 10)
    return t.select("vec_id", d.alias("d"), s.alias("s"), F.size(said).alias("n_warnings"))


@query(f"WITH {VE} SELECT vec_id, round(CASE WHEN label >= 5 THEN list_sum(v[3:10]) ELSE list_sum(v[1:4]) + 4 * v[4] END, 4) AS total FROM ve")
def f20_fitted_length(read):
    """Eight steps: the last ones of ten, or four with the last one repeated."""
    v = vectors(read).withColumn("a", F.when(F.col("label") >= 5, A.head("v", 10)).otherwise(A.head("v", 4)))
    return v.select("vec_id", r(F.aggregate(records.fit_length("a", F.lit(8), F.lit(0.0)), F.lit(0.0), lambda s, x: s + x)).alias("total"))
