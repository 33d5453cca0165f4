"""All named queries of the engine, outside the text-preparation subpackage: a Spark plan and DuckDB SQL for each.

An episode is a user's events in the order of (ts, event_id), its frames counted from 0; vectors are embeddings, their
episodes the labels. Doubles are rounded in both engines, so that sums taken in another order compare as equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import frames, joins, metrics, sampling, search, stats
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "d05_norm_stats"


def query(sql: str | None = None):
    """Register a function of (read) under its name; read(table) gives a table."""

    def add(build):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


def r(c, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def events_frames(read) -> DataFrame:
    """user_id, event_id, event_type, frame, value, ts, n (frames of the user)."""
    e = frames.number(read("events"), "user_id", ["ts", "event_id"]).withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    return e.select("user_id", "event_id", "event_type", "frame", "value", "ts", "n")


def vectors(read) -> DataFrame:
    return read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def digest(df: DataFrame, array: Column, *keys: str) -> DataFrame:
    """keys, the array's length, its weighted sum, and its first and last element."""
    df = df.select(*keys, array.alias("__a"))
    return df.select(*keys, F.size("__a").alias("n"), r(A.weighted_sum("__a")).alias("wsum"), r(F.get("__a", F.lit(0))).alias("first"), r(F.try_element_at("__a", F.lit(-1))).alias("last"))


FR = "fr AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, ts, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
VE = "ve AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def digest_sql(array: str, source: str = "ve", keys: str = "vec_id", ctes: str = VE) -> str:
    return f"WITH {ctes}, d AS (SELECT {keys}, {array} AS a FROM {source}) SELECT {keys}, len(a) AS n, round(coalesce(list_sum(list_transform(a, lambda x, i: x * i)), 0), 4) AS wsum, round(a[1], 4) AS first, round(a[-1], 4) AS last FROM d"


# --- Scans and checks of episodes -----------------------------------------------------------------------------------
@query("SELECT l_orderkey, count(*) AS n_frames, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous, count(*) FILTER (WHERE l_quantity IS NULL OR NOT isfinite(l_quantity)) AS n_bad FROM lineitem GROUP BY 1")
def s02_episode_read_checks(read):
    whole = (F.min("l_linenumber") == 1) & (F.max("l_linenumber") == F.count("*")) & (F.countDistinct("l_linenumber") == F.count("*"))
    return read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_frames"), whole.alias("contiguous"), F.count_if(~F.coalesce(A.all_finite(F.array("l_quantity")), F.lit(False))).alias("n_bad"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7")
def s03_pushed_filter(read):
    return read("lineitem").where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def s11_json_fields(read):
    return read("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) AS n_lines FROM documents")
def s08_nonblank_lines(read):
    return read("documents").select("doc_id", F.size(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)).alias("n_lines"))


# --- Arrays ---------------------------------------------------------------------------------------------------------
@query(digest_sql("list_filter(v, lambda x, i: (i - 1) % 3 = 0)"))
def p09_subsample_stride(read):
    return digest(vectors(read), A.subsample("v", 3), "vec_id")


@query(digest_sql("list_concat(v, list_transform(range(72 - len(v)), lambda x: 0.5::DOUBLE))"))
def p10_pad_to_dim(read):
    return digest(vectors(read), A.pad("v", 72, 0.5), "vec_id")


@query(digest_sql("v[1:14]"))
def p12_output_slice(read):
    return digest(vectors(read), A.head("v", 14), "vec_id")


MASK = A.bool_mask(6, -1, 6, -1)
MASK_SQL = "[true,true,true,true,true,true,false,true,true,true,true,true,true,false]"
FIRST = ", fs AS (SELECT v.vec_id, v.label, v.v, s.v AS s FROM ve v JOIN (SELECT label, arg_min(v, vec_id) AS v FROM ve GROUP BY label) s ON v.label = s.label)"


def with_state(read) -> DataFrame:
    v = vectors(read)
    return v.join(v.groupBy("label").agg(F.min_by("v", "vec_id").alias("s")), "label")


@query(digest_sql(f"list_transform(v, lambda x, i: CASE WHEN coalesce({MASK_SQL}[i], false) THEN x - s[i] ELSE x END)", "fs", ctes=VE + FIRST))
def p14_delta_actions(read):
    return digest(with_state(read), A.delta("s", "v", MASK), "vec_id")


@query(digest_sql(f"list_transform(v, lambda x, i: CASE WHEN coalesce({MASK_SQL}[i], false) THEN x + s[i] ELSE x END)", "fs", ctes=VE + FIRST))
def p15_absolute_actions(read):
    return digest(with_state(read), A.absolute("s", "v", MASK), "vec_id")


@query(digest_sql("list_concat(list_concat(v[8:14], v[1:7]), v[15:64])"))
def p16_swap_halves(read):
    return digest(vectors(read), A.swap_halves("v"), "vec_id")


@query(digest_sql("list_transform(v[1:4], lambda x, i: x * [1, -1, -1, 1][i])"))
def p17_sign_flip(read):
    return digest(vectors(read), A.flip(A.head("v", 4), [1, -1, -1, 1]), "vec_id")


@query(digest_sql("list_transform(v, lambda x, i: (x - [0.1, 0.2, 0.3][i]) / ([1.0, 2.0, 3.0][i] + 1e-6))[1:3]"))
def n01_zscore(read):
    return digest(vectors(read), A.zscore(A.head("v", 3), [0.1, 0.2, 0.3], [1, 2, 3]), "vec_id")


@query(digest_sql("list_transform(v, lambda x, i: (x - [-1.0, -2.0, -3.0][i]) / ([1.0, 2.0, 3.0][i] - [-1.0, -2.0, -3.0][i] + 1e-6) * 2 - 1)[1:3]"))
def n02_quantile_scale(read):
    return digest(vectors(read), A.quantile_scale(A.head("v", 3), [-1, -2, -3], [1, 2, 3]), "vec_id")


@query(digest_sql("list_transform(v, lambda x, i: x * (coalesce([1.0, 2.0, 3.0][i], 1.0) + 1e-6) + coalesce([0.1, 0.2, 0.3][i], 0.0))"))
def n04_unzscore(read):
    return digest(vectors(read), A.unzscore("v", [0.1, 0.2, 0.3], [1, 2, 3]), "vec_id")


@query(digest_sql("list_transform(v, lambda x, i: CASE WHEN i <= 3 THEN (x + 1) / 2 * ([1.0, 2.0, 3.0][i] - [-1.0, -2.0, -3.0][i] + 1e-6) + [-1.0, -2.0, -3.0][i] ELSE x END)"))
def n05_unquantile(read):
    return digest(vectors(read), A.unquantile_scale("v", [-1, -2, -3], [1, 2, 3]), "vec_id")


@query(f"WITH {VE} SELECT vec_id, list_sum(list_transform(v, lambda x, i: i * greatest(-1, least(255, floor((x + 1) * 128)))))::BIGINT AS wsum FROM ve")
def n03_digitize(read):
    return vectors(read).select("vec_id", F.aggregate(F.transform("v", lambda x, i: (A.digitize(x) * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("wsum"))


@query("SELECT event_id, list_sum(list_transform([event_id % 8, (event_id // 8) % 5, (event_id // 40) % 6], lambda d, i: d * [1, 8, 40][i]))::BIGINT AS token, (event_id // 8) % 5 AS second FROM events")
def n15_mixed_radix(read):
    e = read("events").select("event_id", A.radix_digits("event_id", [8, 5, 6]).alias("d"))
    return e.select("event_id", A.mixed_radix("d", [8, 5, 6]).alias("token"), F.col("d")[1].cast("long").alias("second"))


@query("SELECT event_id, round_even(value * 0.5, 0)::BIGINT AS frame FROM events")
def n17_rint(read):
    return read("events").select("event_id", F.rint(F.col("value") * 0.5).cast("long").alias("frame"))


@query("SELECT o_orderkey, printf('data/chunk-%03d/file-%03d.parquet', o_orderkey // 1000, o_orderkey % 1000) AS path FROM orders")
def n19_path_format(read):
    return read("orders").select("o_orderkey", X.chunk_path("o_orderkey").alias("path"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(u, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'metric') AS name FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/?' ELSE url END AS u FROM pages)")
def n22_safe_name(read):
    return read("pages").select("page_id", X.safe_name(F.when(F.col("page_id") % 5 == 0, "/?").otherwise(F.col("url"))).alias("name"))


@query("SELECT conv_id, turn, role, translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '_' || chr(10), '  ') AS clean, translate(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '_', ' ') AS low FROM conversations")
def n06_prompt_clean(read):
    return read("conversations").select("conv_id", "turn", "role", X.clean_prompt("text").alias("clean"), X.clean_prompt_lower("text").alias("low"))


@query(f"WITH {VE} SELECT vec_id, 'Task: pick, State: ' || array_to_string(list_transform(v[1:4], lambda x: greatest(-1, least(255, floor((x + 1) * 128)))::INT), ' ') || ';' AS prompt FROM ve")
def n08_prompt_render(read):
    return vectors(read).select("vec_id", X.render_prompt(F.lit("pick"), F.transform(A.head("v", 4), A.digitize)).alias("prompt"))


@query("WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS a FROM documents) SELECT doc_id, least(len(a), 48) AS n_real, list_sum(list_transform(list_concat(a[1:48], list_transform(range(greatest(48 - len(a), 0)), lambda x: 0)), lambda x, i: x * i))::BIGINT AS wsum FROM t")
def n09_pad_truncate_mask(read):
    d = read("documents").select("doc_id", F.transform(F.split("text", " ", -1), F.length).alias("a"))
    tokens, real = A.pad_tokens("a", 48)
    d = d.select("doc_id", tokens.alias("t"), real.alias("m"))
    return d.select("doc_id", F.size(F.filter("m", lambda x: x)).alias("n_real"), F.aggregate(F.transform("t", lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("wsum"))


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 1e-3 / 101 + (1e-3 - 1e-3 / 101) * event_id / 100 ELSE 1e-5 + (1e-3 - 1e-5) * 0.5 * (1 + cos(3.141592653589793 * least((event_id - 100) / 900.0::DOUBLE, 1))) END, 9) AS lr FROM events")
def n26_lr_schedule(read):
    return read("events").select("event_id", r(X.warmup_cosine("event_id", 100, 1e-3, 1000, 1e-5), 9).alias("lr"))


@query(digest_sql("list_concat(v[11:64], v[1:10])"))
def n31_roll_right(read):
    return digest(vectors(read), A.roll_right("v", F.lit(10)), "vec_id")


@query(digest_sql("list_transform(v, lambda x, i: CASE WHEN i - 1 = label THEN 9.0 ELSE x END)"))
def n32_scatter(read):
    return digest(vectors(read), A.put("v", "label", F.lit(9.0)), "vec_id")


@query("WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN abs(value) * 1.2345678e-6 WHEN 3 THEN abs(value) * 1.2345678e-13 ELSE abs(value) END AS x FROM events) SELECT event_id, CASE WHEN x IS NULL THEN '—' WHEN x = 0 THEN '0' WHEN x < 1e-8 THEN regexp_replace(printf('%.2e', x), '\\.?0+e', 'e') ELSE regexp_replace(CASE WHEN x < 1e-4 THEN printf('%.8f', x) ELSE printf('%.6f', x) END, '\\.?0+$', '') END AS shown FROM t")
def n28_number_text(read):
    x = F.expr("case event_id % 6 when 0 then null when 1 then 0d when 2 then abs(value) * 1.2345678e-6 when 3 then abs(value) * 1.2345678e-13 else abs(value) end").cast("double")
    return read("events").select("event_id", X.number_text(x).alias("shown"))


@query("WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, concat_ws('--', l_orderkey, l_suppkey, l_linenumber) AS step_id FROM lineitem) SELECT step_id, count(*) AS n FROM t GROUP BY step_id")
def p28_step_id(read):
    return read("lineitem").select(F.concat_ws("--", "l_orderkey", "l_suppkey", "l_linenumber").alias("step_id")).groupBy("step_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS episode, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame FROM orders")
def p25_dense_renumber(read):
    o = read("orders")
    ids = sampling.indexed(o.select("o_custkey").distinct(), [F.col("o_custkey")], "episode")
    return frames.number(o.join(ids, "o_custkey"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "episode", "frame")


@query("SELECT o_custkey, sum(n) OVER (ORDER BY o_custkey)::BIGINT - n AS index_from, sum(n) OVER (ORDER BY o_custkey)::BIGINT AS index_to FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def p26_episode_ranges(read):
    return frames.episode_ranges(read("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n").select("o_custkey", "index_from", "index_to")


@query(f"WITH {VE} SELECT label, dim, count(*) AS n, round(sum(x), 4) AS total FROM (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM ve) GROUP BY label, dim")
def p27_explode_steps(read):
    return stats.explode_dims(vectors(read), ["label"], "v").groupBy("label", "dim").agg(F.count("*").alias("n"), r(F.sum("x")).alias("total"))


@query("SELECT event_id, coalesce((props::JSON->>'loss')::DOUBLE, (props::JSON->>'k')::DOUBLE) AS loss FROM events")
def p30_flatten_alias(read):
    return read("events").select("event_id", F.coalesce(F.get_json_object("props", "$.loss").cast("double"), F.get_json_object("props", "$.k").cast("double")).alias("loss"))


# --- Predicates -----------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '.*MO.*|LARGE')")
def f02_regex_full_match(read):
    return read("part").where(F.col("p_type").rlike("^(?:.*MO.*|LARGE)$")).select("p_partkey", "p_type")


RANGES = ((0, 10), (5, 20), (40, 43))


@query(f"WITH {FR} SELECT user_id, event_id, frame FROM fr WHERE EXISTS (SELECT 1 FROM (VALUES (0, 10), (5, 20), (40, 43)) k(s, e) WHERE frame >= s AND frame < e)")
def f03_keep_ranges(read):
    e = events_frames(read)
    span = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in RANGES]))
    ranges = read("events").select("user_id").distinct().select("user_id", span.alias("r")).select("user_id", "r.start", "r.end")
    return joins.keep_ranges(e, ranges, "user_id", "frame").select("user_id", "event_id", "frame")


@query(f"WITH {VE} SELECT label, count(*) FILTER (WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS n_finite FROM ve GROUP BY label")
def f05_finite(read):
    return vectors(read).groupBy("label").agg(F.count_if(A.all_finite("v")).alias("n_finite"))


@query(f"WITH {FR} SELECT user_id, count(*) FILTER (WHERE abs(epoch(ts) - frame * 60.0) > 1e-3) AS n_off, count(*) FILTER (WHERE abs(epoch(ts) - frame * 60.0) > 1e-4 + 1e-6 * frame * 60.0) AS n_late FROM fr GROUP BY user_id")
def f07_time_tolerance(read):
    """Both tolerances: absolute alone, and absolute with a share of the time."""
    e = events_frames(read).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.groupBy("user_id").agg(F.count_if(~frames.time_ok("t", "frame", 1 / 60, 1e-3)).alias("n_off"), F.count_if(~frames.time_ok("t", "frame", 1 / 60, 1e-4, 1e-6)).alias("n_late"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_discount < 0.02 OR l_discount > 0.08) AS n_out, count(*) FILTER (WHERE l_tax > 0.07 + 1e-5) AS n_warn FROM lineitem GROUP BY 1")
def f08_out_of_range(read):
    return read("lineitem").groupBy("l_returnflag").agg(F.count_if(F.expr("l_discount < 0.02d or l_discount > 0.08d")).alias("n_out"), F.count_if(F.expr("l_tax > 0.07d + 1e-5d")).alias("n_warn"))


@query("SELECT o.o_orderkey, coalesce(l.n, 0) AS n, coalesce(l.n, 0) <> coalesce(l.said, 0) AS wrong FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS said FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def f10_length_mismatch(read):
    """Rows of each order against the length that its numbering claims."""
    n = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("said"))
    out = read("orders").select("o_orderkey").join(n, "o_orderkey", "left").na.fill(0, ["n", "said"])
    return out.select("o_orderkey", "n", (F.col("n") != F.col("said")).alias("wrong"))


@query(f"WITH {FR}, c AS (SELECT *, min(CASE WHEN round_even(frame * 1.5, 0) >= 30 THEN frame END) OVER (PARTITION BY user_id) AS cut FROM fr) SELECT user_id, count(*) AS kept FROM c WHERE cut IS NULL OR frame < cut GROUP BY user_id")
def f17_tail_trim(read):
    e = events_frames(read).withColumn("t", F.col("frame") * 1.5).withColumn("have", F.lit(30))
    return frames.trim_tail(e, "user_id", "frame", "t", 1.0, "have").groupBy("user_id").agg(F.count("*").alias("kept"))


@query(f"WITH {FR} SELECT user_id, CASE WHEN count(*) < 5 THEN 'pending' WHEN max(value) > 400 THEN 'rejected:value' WHEN count(DISTINCT event_type) < 4 THEN 'rejected:types' ELSE 'validated' END AS status FROM fr GROUP BY user_id")
def d01_episode_audit(read):
    e = events_frames(read).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.countDistinct("event_type").alias("types"))
    return e.select("user_id", frames.first_failure([("pending", F.col("n") < 5), ("rejected:value", F.col("top") > 400), ("rejected:types", F.col("types") < 4)], "validated").alias("status"))


# --- Joins and sets -------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j01_task_lookup(read):
    nation = read("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = read("region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = read("customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), "c_nationkey")  # the dimensions have 25 and 5 rows
    return joins.lookup(out, F.broadcast(region), "n_regionkey", "r_name").select("c_custkey", "n_name", "r_name")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j04_semi(read):
    return read("documents").join(read("labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j04_anti(read):
    return read("documents").join(read("labels"), "doc_id", "left_anti").select("doc_id")


@query(f"WITH {VE}, a AS (SELECT vec_id, v FROM ve), b AS (SELECT vec_id - 1 AS vec_id, v FROM ve) SELECT vec_id, CASE WHEN b.v IS NULL THEN 'left_only' WHEN a.v IS NULL THEN 'right_only' WHEN a.v = b.v THEN 'same' ELSE 'differs' END AS status, round(list_max(list_transform(a.v, lambda x, i: abs(x - b.v[i]))), 5) AS max_diff FROM a FULL JOIN b USING (vec_id)")
def j05_full_compare(read):
    v = vectors(read).select("vec_id", "v")
    both = joins.compare(v, v.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], "v")
    return both.select("vec_id", "status", r(F.array_max(F.zip_with("left", "right", lambda x, y: F.abs(x - y))), 5).alias("max_diff"))


@query("SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def j07_self_reference(read):
    c = read("conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("answered"))
    return c.where("role = 'user'").select("conv_id", "turn", F.length("text").alias("asked")).join(b, ["conv_id", "turn"])


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j08_left_default(read):
    return joins.left_default(read("documents").select("doc_id"), read("labels"), "doc_id", "quality", -1)


@query(f"WITH {FR}, h AS (SELECT user_id, frame, value FROM fr WHERE frame < 30), c AS (SELECT user_id, frame, -value AS value FROM fr WHERE frame >= 20 AND frame < 40), m AS (SELECT user_id, min(frame) AS m FROM c GROUP BY 1) SELECT h.user_id, frame, value FROM h LEFT JOIN m USING (user_id) WHERE m IS NULL OR frame < m UNION ALL SELECT user_id, frame, value FROM c")
def j09_override_union(read):
    e = events_frames(read).select("user_id", "frame", "value")
    return joins.override(e.where("frame < 30"), e.where("frame >= 20 and frame < 40").withColumn("value", -F.col("value")), ["user_id"], "frame")


@query("WITH w AS (SELECT p_partkey, p_size::DOUBLE AS want FROM part), h AS (SELECT l_partkey AS p_partkey, max(l_quantity)::DOUBLE AS have FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) SELECT p_partkey, coalesce(have, want) AS size FROM w LEFT JOIN h USING (p_partkey) WHERE have IS NOT NULL OR regexp_full_match(p_partkey::VARCHAR, '.*[05]')")
def j10_fill_missing(read):
    have = read("lineitem").where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("double").alias("size"))
    return joins.fill_missing(read("part").select("p_partkey", F.col("p_size").cast("double").alias("size")), have, "p_partkey", "size", ".*[05]")


@query("WITH a AS (SELECT p_partkey AS k, p_size::BIGINT AS x FROM part), b AS (SELECT l_suppkey AS k, count(*) % 50 AS y FROM lineitem GROUP BY 1) SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN x IS NOT DISTINCT FROM y THEN 'same' ELSE 'differs' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def j17_symmetric_difference(read):
    a = read("part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("x"))
    b = read("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg((F.count("*") % 50).alias("x"))
    return joins.compare(a, b, ["k"], "x").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT 'train' AS split, doc_id FROM documents WHERE doc_id % 10 < 9 UNION ALL SELECT 'val', doc_id FROM documents WHERE doc_id % 10 = 9")
def u01_union_split(read):
    d = read("documents").select("doc_id")
    return d.where("doc_id % 10 < 9").select(F.lit("train").alias("split"), "doc_id").unionByName(d.where("doc_id % 10 = 9").select(F.lit("val").alias("split"), "doc_id"))


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def u02_intersection(read):
    return read("lineitem").where("l_returnflag = 'R'").select("l_suppkey").intersect(read("supplier").where("s_acctbal > 0").select("s_suppkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def u03_complement(read):
    return read("part").select("p_partkey").subtract(read("lineitem").where("l_returnflag = 'R' and l_quantity > 40").select("l_partkey"))


# --- Aggregates -----------------------------------------------------------------------------------------------------
@query(f"WITH {VE} SELECT dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(range(len(v))) AS dim, unnest(v) AS x FROM ve) GROUP BY dim")
def a01_running_stats(read):
    s = stats.explode_dims(vectors(read), [], "v").groupBy("dim").agg(*stats.moments("x"))
    return s.select("dim", r("mean", 6).alias("mean"), r("std", 6).alias("std"))


@query("WITH x AS (SELECT event_type AS k, value AS x FROM events), g AS (SELECT k, min(x) - 1e-10 AS lo, max(x) + 1e-10 AS hi FROM x GROUP BY k), b AS (SELECT k, lo, hi, least(4999, floor((x - lo) / (hi - lo) * 5000)) AS bin, count(*) AS n FROM x JOIN g USING (k) GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bin) AS run, sum(n) OVER (PARTITION BY k) AS al FROM b) SELECT k AS event_type, round(min(CASE WHEN run >= 0.01 * al THEN lo + bin * ((hi - lo) / 5000) END), 6) AS q01, round(min(CASE WHEN run >= 0.99 * al THEN lo + bin * ((hi - lo) / 5000) END), 6) AS q99 FROM c GROUP BY k")
def a02_histogram_quantile(read):
    q = stats.histogram_quantiles(read("events"), "event_type", "value", {"q01": 0.01, "q99": 0.99})
    return q.select("event_type", r("q01", 6).alias("q01"), r("q99", 6).alias("q99"))


@query("SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_quantity, {q}), 6) AS q{q * 100:02.0f}" for q in (0.01, 0.1, 0.5, 0.9, 0.99)) + " FROM lineitem GROUP BY 1")
def a04_episode_stats(read):
    """Groups are episodes: many, each of bounded length, so percentiles are taken within a group."""
    marks = (0.01, 0.1, 0.5, 0.9, 0.99)
    q = F.percentile("l_quantity", F.array(*[F.lit(x) for x in marks]))
    s = read("lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), *stats.moments("l_quantity"), F.count("*").alias("n"), q.alias("q"))
    return s.select("l_suppkey", "lo", "hi", r("mean", 6).alias("mean"), r("std", 6).alias("std"), "n", *[r(F.col("q")[k], 6).alias(f"q{x * 100:02.0f}") for k, x in enumerate(marks)])


@query(f"WITH {FR} SELECT user_id, size AS value, frame FROM (SELECT *, abs(value) AS size, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, frame) AS k FROM fr) WHERE k = 1")
def a05_extremum(read):
    return events_frames(read).groupBy("user_id").agg(stats.extremum("value", "frame").alias("x")).select("user_id", "x.value", F.col("x.row").alias("frame"))


@query("WITH m AS (SELECT user_id, max(value) AS v, user_id % 2 = 0 AS selected FROM events GROUP BY 1) SELECT CASE WHEN grouping(selected) = 1 THEN 'all' WHEN selected THEN 'selected' ELSE 'rest' END AS grp, count(*) AS n, count(*) FILTER (WHERE v > 300) AS n_failed, round(sum(v), 4) AS total, round(min(v), 6) AS minimum, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99), 6) AS q99, round(quantile_cont(v, 0.999), 6) AS q999, round(max(v), 6) AS maximum FROM m GROUP BY GROUPING SETS ((), (selected))")
def a07_group_summary(read):
    m = read("events").groupBy("user_id").agg(F.max("value").alias("v"))
    m = m.select("v", F.explode(F.array(F.lit("all"), F.when(F.col("user_id") % 2 == 0, "selected").otherwise("rest"))).alias("grp"))
    s = m.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 300).alias("n_failed"), r(F.sum("v")).alias("total"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    s = s.join(stats.exact_percentiles(m, ["grp"], "v", {"median": 0.5, "q99": 0.99, "q999": 0.999}), "grp")
    return s.select("grp", "n", "n_failed", "total", *[r(c, 6).alias(c) for c in ("minimum", "median", "q99", "q999", "maximum")])


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def a08_status_rollup(read):
    return read("orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END, CASE WHEN l_quantity > 45 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS warning FROM lineitem) GROUP BY 1")
def a09_warning_counts(read):
    flags = F.array(F.expr("if(l_discount > 0.08d, 'discount', null)"), F.expr("if(l_tax > 0.07d, 'tax', null)"), F.expr("if(l_quantity > 45, 'quantity', null)"))
    return read("lineitem").select(F.explode(F.array_compact(flags)).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


PAIR = ", pr AS (SELECT a.label, a.vec_id, unnest(range(64)) AS dim, unnest(list_transform(a.v, lambda x, i: x - b.v[i])) AS d FROM ve a JOIN ve b ON b.vec_id = a.vec_id + 1)"


def diffs(read) -> DataFrame:
    v = vectors(read)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return stats.explode_dims(v.join(b, "vec_id").select("label", "vec_id", F.zip_with("v", "w", lambda x, y: x - y).alias("v")), ["label", "vec_id"], "v")


@query(f"WITH {VE}{PAIR}, w AS (SELECT label, arg_min(vec_id, k) AS worst_vec, arg_min(dim, k) AS worst_dim FROM (SELECT label, vec_id, dim, row_number() OVER (PARTITION BY label ORDER BY abs(d) DESC, vec_id, dim) AS k FROM pr) GROUP BY 1) SELECT label, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(quantile_cont(abs(d), 0.95), 6) AS p95, round(max(abs(d)), 6) AS max_abs, any_value(worst_vec) AS worst_vec, any_value(worst_dim) AS worst_dim FROM pr JOIN w USING (label) GROUP BY label")
def a11_error_metrics(read):
    d = diffs(read).withColumn("d", F.abs("x"))
    s = d.groupBy("label").agg(F.avg("d").alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.max("d").alias("max_abs"), stats.extremum("x", "vec_id", F.col("dim")).alias("w"))
    s = s.join(stats.exact_percentiles(d, ["label"], "d", {"p95": 0.95}), "label")
    return s.select("label", *[r(c, 6).alias(c) for c in ("mae", "rmse", "p95", "max_abs")], F.col("w.row").alias("worst_vec"), F.col("w.dim").alias("worst_dim"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(abs(value - f)), 6) AS repeat_diff FROM events JOIN (SELECT event_type, arg_min(value, event_id) AS f FROM events GROUP BY 1) USING (event_type) GROUP BY 1")
def a12_latency_percentiles(read):
    e = read("events").select("event_type", "event_id", "value")
    first = e.groupBy("event_type").agg(F.min_by("value", "event_id").alias("f"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    s = first.join(stats.exact_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "event_type")
    return s.select("event_type", r("p50", 6).alias("p50"), r("p95", 6).alias("p95"), r(F.greatest(F.col("hi") - F.col("f"), F.col("f") - F.col("lo")), 6).alias("repeat_diff"))


@query(f"WITH {VE}{PAIR} SELECT dim, CASE WHEN dim % 7 = 6 THEN 'gripper' ELSE 'joint' END AS kind, round(max(abs(d)), 6) AS maximum, round(avg(abs(d)), 6) AS mean, round(quantile_cont(abs(d), 0.95), 6) AS p95 FROM pr WHERE dim < 14 GROUP BY dim")
def a14_per_dimension(read):
    d = diffs(read).where("dim < 14").withColumn("d", F.abs("x"))
    s = d.groupBy("dim").agg(F.max("d").alias("maximum"), F.avg("d").alias("mean")).join(stats.exact_percentiles(d, ["dim"], "d", {"p95": 0.95}), "dim")
    return s.select("dim", F.when(F.col("dim") % 7 == 6, "gripper").otherwise("joint").alias("kind"), *[r(c, 6).alias(c) for c in ("maximum", "mean", "p95")])


@query(f"WITH {VE}{PAIR} SELECT round(quantile_cont(abs(d), 0.99) FILTER (WHERE dim % 7 <> 6), 6) AS joints, round(quantile_cont(abs(d), 0.95) FILTER (WHERE dim % 7 <> 6), 6) AS joints_p95, round(quantile_cont(abs(d), 0.99) FILTER (WHERE dim % 7 = 6), 6) AS grippers, round(max(abs(d)) FILTER (WHERE dim % 7 = 6), 6) AS grippers_max, round(avg(abs(d)) FILTER (WHERE dim < 10), 6) AS first_ten FROM pr")
def a13_filtered_percentiles(read):
    d = diffs(read).withColumn("d", F.abs("x")).withColumn("gripper", F.col("dim") % 7 == 6)
    q = stats.exact_percentiles(d, ["gripper"], "d", {"p95": 0.95, "p99": 0.99})
    q = q.agg(F.max(F.expr("if(gripper, null, p99)")).alias("joints"), F.max(F.expr("if(gripper, null, p95)")).alias("joints_p95"), F.max(F.expr("if(gripper, p99, null)")).alias("grippers"))
    rest = d.agg(F.max(F.expr("if(gripper, d, null)")).alias("grippers_max"), F.avg(F.expr("if(dim < 10, d, null)")).alias("first_ten"))
    return q.crossJoin(rest).select(*[r(c, 6).alias(c) for c in ("joints", "joints_p95", "grippers", "grippers_max", "first_ten")])  # one row each


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))) AS longest FROM documents")
def a15_telemetry_regex(read):
    d = read("documents").select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("m"))
    return d.select("doc_id", F.size("m").alias("n_numbers"), F.array_max(F.transform("m", F.length)).alias("longest"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 8) AS share FROM lineitem GROUP BY 1, 2")
def a16_layer_share(read):
    g = read("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("t"))
    return g.select("l_returnflag", "l_linestatus", r("t", 2).alias("total"), r(F.col("t") / F.sum("t").over(W.partitionBy()), 8).alias("share"))


MAE = "m AS (SELECT l_suppkey, avg(abs(l_extendedprice / l_quantity - p_retailprice)) AS mae FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def episode_mae(read) -> DataFrame:
    p = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return read("lineitem").join(p, "l_partkey").groupBy("l_suppkey").agg(F.avg(F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice"))).alias("mae"))


@query(f"WITH {MAE} SELECT l_suppkey, round(mae, 4) AS mae FROM m")
def a17_episode_mae(read):
    return episode_mae(read).select("l_suppkey", r("mae").alias("mae"))


@query(f"WITH {MAE} SELECT l_suppkey, round(mae, 4) AS mae FROM m ORDER BY m.mae DESC, l_suppkey LIMIT 10")
def a18_worst10(read):
    return episode_mae(read).orderBy(F.desc("mae"), "l_suppkey").limit(10).select("l_suppkey", r("mae").alias("mae"))


@query("SELECT user_id, event_id // 100 AS interval, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def a19_interval_mean(read):
    m = metrics.interval_mean(read("events"), ["user_id"], "event_id", 100, ["value"])
    return m.select("user_id", "interval", r("value", 6).alias("value"))


@query("SELECT event_id, round(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, 64 / (value + 1)), 6) AS rate FROM events")
def a21_throughput(read):
    e = read("events").withColumn("given", F.when(F.col("event_id") % 3 == 0, F.col("value"))).withColumn("sec", F.col("value") + 1)
    return e.select("event_id", r(metrics.throughput("given", "sec", 64), 6).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a23_duplicates(read):
    return read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {VE}, q AS (SELECT label, sqrt(list_sum(list_transform(v, lambda x, i: (x - p[i]) * (x - p[i])))) AS d FROM (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM ve) WHERE p IS NOT NULL) SELECT label, round(avg(d), 6) AS jump FROM q GROUP BY 1")
def a27_temporal_consistency(read):
    v = vectors(read).withColumn("p", F.lag("v").over(W.partitionBy("label").orderBy("vec_id"))).where("p is not null")
    d = F.sqrt(F.aggregate(F.zip_with("v", "p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return v.groupBy("label").agg(r(F.avg(d), 6).alias("jump"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def a29_digests(read):
    return read("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))


# --- Windows --------------------------------------------------------------------------------------------------------
CH = "ch AS (SELECT a.user_id, a.frame, k, b.value AS v, a.value AS s, a.n FROM fr a, range(5) t(k), fr b WHERE a.user_id = b.user_id AND b.frame = least(a.frame + k, a.n - 1))"


@query(f"WITH {FR}, {CH} SELECT user_id, frame, round(sum(v * (k + 1)), 4) AS wsum FROM ch GROUP BY 1, 2")
def w01_future_chunk(read):
    e = frames.future_chunk(events_frames(read), "user_id", "frame", "value", 5)
    return e.select("user_id", "frame", r(A.weighted_sum("chunk")).alias("wsum"))


@query(f"WITH {FR}, {CH.replace('range(5)', 'range(50)')}, x AS (SELECT k, v - s AS x FROM ch), g AS (SELECT k, min(x) - 1e-10 AS lo, max(x) + 1e-10 AS hi, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY k), b AS (SELECT k, lo, hi, least(4999, floor((x - lo) / (hi - lo) * 5000)) AS bin, count(*) AS c FROM x JOIN g USING (k) GROUP BY ALL), c AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY bin) AS run, sum(c) OVER (PARTITION BY k) AS al FROM b), q AS (SELECT k, min(CASE WHEN run >= 0.01 * al THEN lo + bin * ((hi - lo) / 5000) END) AS q01, min(CASE WHEN run >= 0.99 * al THEN lo + bin * ((hi - lo) / 5000) END) AS q99 FROM c GROUP BY k) SELECT k AS step, n, round(mean, 6) AS mean, round(std, 6) AS std, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM g JOIN q USING (k)")
def d05_norm_stats(read):
    """Statistics of 50 future steps relative to the current state, by step; quantiles from histograms of 5000 bins."""
    e = frames.future_chunk(events_frames(read), "user_id", "frame", "value", 50)
    d = e.select(F.posexplode(F.transform("chunk", lambda x: x - F.col("value"))).alias("step", "x"))
    s = stats.histogram_quantiles(d, "step", "x", {"q01": 0.01, "q99": 0.99}, also=[F.count("*").alias("n"), *stats.moments("x")])
    return s.select("step", "n", *[r(c, 6).alias(c) for c in ("mean", "std", "q01", "q99")])


@query(f"WITH {FR} SELECT user_id, frame, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame), 6) AS diff FROM fr")
def w02_adjacent_diff(read):
    return frames.adjacent_diff(events_frames(read), "user_id", "frame", "value").select("user_id", "frame", r("diff", 6).alias("diff"))


@query(f"WITH {FR}, w AS (SELECT *, CASE WHEN n >= 8 THEN greatest(3, least(25, n // 20)) ELSE 1 END AS w FROM fr) SELECT a.user_id, a.frame, round(avg(b.value), 6) AS smooth FROM w a JOIN w b ON a.user_id = b.user_id AND b.frame <= a.frame AND b.frame > a.frame - a.w GROUP BY 1, 2")
def w03_moving_average(read):
    return metrics.moving_average(events_frames(read), "user_id", "frame", "value").select("user_id", "frame", r("smooth", 6).alias("smooth"))


@query(f"WITH {FR} SELECT user_id, frame, round(sum(value) OVER (PARTITION BY user_id ORDER BY frame), 4) AS total FROM fr")
def w04_running_offset(read):
    return events_frames(read).select("user_id", "frame", r(F.sum("value").over(W.partitionBy("user_id").orderBy("frame"))).alias("total"))


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n, sum(count(*)) OVER (ORDER BY o_custkey) - count(*) AS b FROM orders GROUP BY 1) WHERE b < 500")
def w05_duration_select(read):
    return frames.take_until(read("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), [F.col("o_custkey")], "n", 500)


@query("WITH c AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations) SELECT q.conv_id, q.k, count(*) AS visible FROM c q JOIN c s ON q.conv_id = s.conv_id AND s.b <= q.b GROUP BY 1, 2")
def w06_block_causal_mask(read):
    by = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = read("conversations").select("conv_id", F.row_number().over(by).alias("k"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(by).alias("b"))
    # A key is visible up to the query's block: a running count by value of the block, not a self-join.
    return c.select("conv_id", "k", F.count("*").over(W.partitionBy("conv_id").orderBy("b").rangeBetween(W.unboundedPreceding, 0)).alias("visible"))


@query("WITH a AS (SELECT user_id, (event_id * 7919) % 50 AS step, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), i AS (SELECT *, sum(CASE WHEN step IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS g FROM (SELECT *, lag(step) OVER (PARTITION BY user_id ORDER BY k) AS p FROM a)), e AS (SELECT user_id, g, step, arg_max(value, k) AS value FROM i GROUP BY 1, 2, 3), m AS (SELECT *, min(step) OVER (PARTITION BY user_id ORDER BY g ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e) SELECT user_id, step, value FROM m WHERE later IS NULL OR later > step")
def w09_rollback_merge(read):
    e = read("events").withColumn("step", F.pmod(F.col("event_id") * 7919, F.lit(50)))
    return metrics.rollback(e, "user_id", ["ts", "event_id"], "step", ["value"]).select("user_id", "step", "value")


@query(f"WITH {FR} SELECT a.user_id, a.frame AS target, b.frame - a.frame AS off, b.value FROM fr a JOIN fr b ON a.user_id = b.user_id AND b.frame BETWEEN a.frame - 4 AND a.frame + 4 WHERE a.value > 200")
def w10_context_slice(read):
    e = events_frames(read).select("user_id", "frame", "value")
    t = e.where("value > 200").select("user_id", F.col("frame").alias("target"), F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("off")).withColumn("frame", F.col("target") + F.col("off"))
    return t.join(e, ["user_id", "frame"]).select("user_id", "target", "off", "value")


@query(f"WITH {FR}, m AS (SELECT DISTINCT user_id, n FROM fr) SELECT user_id, unnest(list_sort(list_distinct([0::BIGINT, n // 2, greatest(0, n - 50), n - 1]))) AS probe FROM m")
def w14_probe_frames(read):
    return read("events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.explode(frames.probe_frames("n", 50)).alias("probe"))


@query("WITH m AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 200) SELECT l_suppkey, unnest([100, n // 2, n - 100]) AS probe FROM m")
def w15_phase_frames(read):
    n = read("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n > 200")
    return n.select("l_suppkey", F.explode(F.array(F.lit(100).cast("long"), F.floor(F.col("n") / 2), F.col("n") - 100)).alias("probe"))


@query(f"WITH {FR} SELECT user_id, greatest(n - 4, 0) AS windows FROM (SELECT DISTINCT user_id, n FROM fr) WHERE n >= 5")
def w16_valid_windows_only(read):
    return frames.full_windows(events_frames(read), "user_id", "frame", "value", 5).groupBy("user_id").agg(F.count("*").alias("windows"))


# --- Order ----------------------------------------------------------------------------------------------------------
JUMPS = {"quantity": "max(l_quantity) - min(l_quantity)", "discount": "max(l_discount) - min(l_discount)", "price": "max(l_extendedprice)"}


@query(" UNION ALL ".join(f"(SELECT '{k}' AS metric, l_suppkey, {x} AS jump FROM lineitem GROUP BY l_suppkey ORDER BY jump DESC, l_suppkey LIMIT 20)" for k, x in JUMPS.items()))
def t01_top20(read):
    g = read("lineitem").groupBy("l_suppkey").agg(*[F.expr(x).cast("double").alias(k) for k, x in JUMPS.items()])
    tops = [g.select(F.lit(k).alias("metric"), "l_suppkey", F.col(k).alias("jump")).orderBy(F.desc("jump"), "l_suppkey").limit(20) for k in JUMPS]
    return tops[0].union(tops[1]).union(tops[2])


@query(f"WITH {FR} SELECT user_id, frame, value, n > 20 AS trimmed FROM fr WHERE frame >= n - 20")
def t05_tail_n(read):
    return events_frames(read).where("frame >= n - 20").select("user_id", "frame", "value", (F.col("n") > 20).alias("trimmed"))


@query(f"WITH {FR} SELECT user_id, frame FROM fr WHERE frame % 7 = 0 OR frame = n - 1")
def t07_stride(read):
    return events_frames(read).where("frame % 7 = 0 or frame = n - 1").select("user_id", "frame")


@query("SELECT l_suppkey, l_shipmin FROM (SELECT l_suppkey, min(l_extendedprice) AS l_shipmin, row_number() OVER (ORDER BY min(l_extendedprice), l_suppkey) AS k FROM lineitem GROUP BY 1) WHERE k = 1")
def t08_argmin(read):
    g = read("lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("l_shipmin"))
    return g.agg(F.min_by(F.struct("l_suppkey", "l_shipmin"), F.struct("l_shipmin", "l_suppkey")).alias("x")).select("x.*")


# --- Search and sampling --------------------------------------------------------------------------------------------
SEARCH = ["the", "tion", "erea", "anst"]


@query("SELECT doc_id, score FROM (SELECT doc_id, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in SEARCH) + " AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25")
def d15_term_search(read):
    return search.search(read("documents"), "doc_id", "text", " ".join(SEARCH), 25)


@query()
def t11_shuffle(read):
    return sampling.shuffle(read("documents").select("doc_id"), "doc_id", 42)


@query()
def r06_batches(read):
    return sampling.batches(read("documents").select("doc_id"), "doc_id", 32, 42, 2).select("doc_id", "batch")


@query("SELECT doc_id FROM documents WHERE (SELECT count(*) FROM documents d WHERE d.doc_id < documents.doc_id) % 4 = 1")
def r07_rank_split(read):
    return sampling.rank_rows(read("documents").select("doc_id"), "doc_id", 4, 1)


@query()
def u06_mixture(read):
    d = read("documents").select("doc_id", "lang")
    return sampling.mixture({"a": d.where("lang = 'en'"), "b": d.where("lang <> 'en' or lang is null")}, {"a": 0.9, "b": 0.1}, 1000, 7, "doc_id")


@query()
def p29_random_choice(read):
    return read("customer").select("c_custkey", sampling.choose(["c_name", "c_mktsegment"], "c_custkey", 3).alias("pick"))


# --- Event time (extensions) ----------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_tumbling(read):
    t = windows.tumbling(read("events"), "ts", "1 hour", ["event_type"], "value")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total").alias("total"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g")
def st_session(read):
    s = windows.sessions(read("events"), "ts", "user_id", "30 minutes")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
