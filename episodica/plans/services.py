"""Named queries of images, models, configurations and request logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import images, policies
from ..operators import transforms as TR
from ..sources.scratch import new_path
from .catalog import FIRST, MASK, MASK_SQL, VE, digest, digest_sql, query, r, vectors
from .samples import state_action


@query("SELECT event_id, value + 1 AS value FROM events")
def x01_transform_protocol(read):
    """A transform is a function from DataFrame to DataFrame."""
    step: TR.Transform = TR.apply_to({"value": lambda c: c + 1})
    return read("events").select("event_id", "value").transform(step)


@query(digest_sql(f"list_transform(v[1:14], lambda x, i: CASE WHEN {MASK_SQL}[i] THEN x - s[i] ELSE x END)", "fs", ctes=VE + FIRST))
def x02_grouped_transforms(read):
    return digest(TR.Pipeline(*[(t,) for t in TR.relative("state", "action", MASK)]).apply(state_action(read)), F.col("action"), "vec_id")


@query(digest_sql("v[1:14]"))
def x03_configuration_factory(read):
    pipe = TR.CONFIGURATIONS.get("relative_actions", mask=MASK)
    return digest(pipe.undo(pipe.apply(state_action(read))), F.col("action"), "vec_id")


@query("SELECT 'committed_prefix' AS name, true AS suggested UNION ALL SELECT 'relative_actions', true")
def x04_registry_lookup(read):
    """An unknown name fails with the closest known one."""
    found = []
    for name in sorted(TR.CONFIGURATIONS.builders):
        try:
            TR.CONFIGURATIONS.get(name + "x")
        except KeyError as error:
            found.append((name, f"did you mean {name}" in str(error)))
    return read("region").sparkSession.createDataFrame(found, "name string, suggested boolean")


@query(f"WITH {VE} SELECT vec_id, round(v[1] * 0.5 - v[2] + v[3] * 2, 5) AS y FROM ve")
def x05_policy_inference(read):
    out = policies.infer(vectors(read), policies.Linear([0.5, -1.0, 2.0], "v"), ["vec_id"], ["v"], "y double")
    return out.select("vec_id", r("y", 5).alias("y"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE value END AS decoded FROM events")
def f23_guarded_retry(read):
    """Short tails are decoded by other means; any other failure fails the job."""

    def decode(pair):
        if pair[0] % 10 == 0:
            raise RuntimeError("no more frames left to decode")
        return pair[1]

    one = policies.guarded(decode, lambda pair: -1.0, "no more frames left")

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"event_id": part["event_id"], "decoded": [one(p) for p in zip(part["event_id"], part["value"], strict=True)]})

    return read("events").select("event_id", "value").mapInPandas(run, "event_id long, decoded double")


@query("SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
def r03_request_sequence(read):
    return read("events").select("user_id", "event_id", policies.previous_time("user_id", "event_id", "value").alias("before"))


@query("SELECT count(*) AS n, max(s_suppkey) AS last FROM supplier")
def k01_atomic_json(read):
    """A document appears as a whole: the commit of the write moves it into place, readers see all of it or nothing."""
    s = read("supplier")
    path = new_path(s.sparkSession, "atomic")
    s.agg(F.count("*").alias("n"), F.max("s_suppkey").alias("last")).write.mode("errorifexists").json(path)
    return s.sparkSession.read.schema("n long, last long").json(path)


@query(f"WITH {VE}, i AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN list_transform(v[1:12], lambda x: least(abs(x), 4) / 4) WHEN 1 THEN list_transform(v[1:12], lambda x: greatest(-4, least(x, 4)) / 4) ELSE list_transform(v[1:12], lambda x: x * 100) END AS a FROM ve), m AS (SELECT *, list_min(a) AS lo, list_max(a) AS hi FROM i) SELECT vec_id, list_sum(list_transform(a, lambda x: floor(greatest(0, least(255, CASE WHEN lo >= 0 AND hi <= 1 THEN x * 255 WHEN lo >= -1 AND hi <= 1 THEN (x + 1) * 127.5 ELSE x END)))))::BIGINT AS total FROM m")
def p22_image_normalize(read):
    """2 x 2 images whose range shows how they are meant."""
    v = vectors(read)
    a = F.when(F.col("label") % 3 == 0, F.transform(A.head("v", 12), lambda x: F.least(F.abs(x), F.lit(4.0)) / 4))
    a = a.when(F.col("label") % 3 == 1, F.transform(A.head("v", 12), lambda x: F.greatest(F.lit(-4.0), F.least(x, F.lit(4.0))) / 4)).otherwise(F.transform(A.head("v", 12), lambda x: x * 100))
    made = images.normalized(v.select("vec_id", a.alias("a"), F.array(F.lit(2), F.lit(2), F.lit(3)).alias("shape")), "vec_id", "a", "shape")
    codes = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.conv(F.hex(F.substring("image", k, F.lit(1))), 16, 10).cast("long"))
    return made.select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))



@query("WITH s AS (SELECT p_partkey, p_size % 20 + 4 AS h, p_size % 7 + 5 AS w FROM part), r AS (SELECT *, greatest(w / 16.0::DOUBLE, h / 16.0::DOUBLE) AS ratio FROM s), q AS (SELECT p_partkey, floor(h / ratio)::INT AS rh, floor(w / ratio)::INT AS rw FROM r) SELECT p_partkey, rh, rw, (16 - rh) // 2 AS top, (16 - rw) // 2 AS \"left\", rh * rw * 3 AS bright FROM q")
def p23_resize_with_borders(read):
    """Plain images of many sizes in a field of 16 x 16: their place by expressions, their pixels by numpy."""
    s = read("part").select("p_partkey", (F.col("p_size") % 20 + 4).cast("int").alias("h"), (F.col("p_size") % 7 + 5).cast("int").alias("w"))
    box = s.select("p_partkey", *images.letterbox("h", "w", 16, 16))
    image = F.unhex(F.repeat(F.lit("C8"), (F.col("h") * F.col("w") * 3).cast("int")))
    made = images.resized(s.withColumn("image", image), "p_partkey", "image", "h", "w", 16, 16)
    bright = made.select("p_partkey", (F.length(F.replace(F.hex("image"), F.lit("00"), F.lit(""))) / 2).cast("int").alias("bright"))
    return box.join(bright, "p_partkey")


