"""Event-stream operators over ``events``."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.times import days, hours
from deltaloom.operators import aggregates as agg
from deltaloom.operators import stateful, stateless, windows
from deltaloom.plans.registry import query
from deltaloom.session import events, load

USER = ["user_id"]
E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS time_us FROM events)"
TAGS = "[event_type, CASE WHEN value > 50 THEN 'big' ELSE 'small' END]"
OVER = "OVER (PARTITION BY user_id ORDER BY time_us, event_id)"


def _tagged(df):
    return df.withColumn("tags", F.array("event_type", F.when(F.col("value") > 50, "big").otherwise("small")))


def _r(c):
    return F.round(c, 4)


@query(f"{E} SELECT event_id, user_id, value FROM e WHERE value > 50 AND event_type = 'click'")
def flow_filter(spark, d):
    return stateless.filter_(events(spark, d), "value > 50 AND event_type = 'click'").select("event_id", "user_id", "value")


@query(f"{E} SELECT event_id, round(value * 2 + 1, 4) AS metric FROM e")
def flow_map(spark, d):
    return stateless.map_(events(spark, d), metric="round(value * 2 + 1, 4)").select("event_id", "metric")


@query(f"{E} SELECT event_id FROM e WHERE list_contains({TAGS}, 'big')")
def flow_tagged(spark, d):
    return stateless.tagged(_tagged(events(spark, d)), "big").select("event_id")


@query(f"{E} SELECT event_id FROM e WHERE event_type IN ('click', 'view') OR value > 50")
def flow_taggedany(spark, d):
    return stateless.taggedany(_tagged(events(spark, d)), ["click", "view", "big"]).select("event_id")


@query(f"{E} SELECT event_id FROM e WHERE event_type = 'click' AND value > 50")
def flow_taggedall(spark, d):
    return stateless.taggedall(_tagged(events(spark, d)), ["click", "big"]).select("event_id")


@query(f"{E} SELECT count(*) AS n, round(sum(value * 2), 4) AS total FROM e WHERE value > 50")
def flow_compose(spark, d):
    op = stateless.compose(lambda x: stateless.filter_(x, "value > 50"), [lambda x: stateless.map_(x, metric="value * 2")])
    return op(events(spark, d)).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("metric")).alias("total"))


@query(f"{E} SELECT event_id, user_id FROM (SELECT *, lag(event_type) {OVER} AS p, row_number() {OVER} AS n FROM e) WHERE n = 1 OR p <> event_type")
def flow_changed(spark, d):
    return stateless.changed(events(spark, d), "event_type", USER).select("event_id", "user_id")


@query(f"{E}, w AS (SELECT user_id, time_us // 86400000000 AS day, list(struct_pack(t := time_us, i := event_id)) AS l FROM e GROUP BY ALL), x AS (SELECT user_id, day, unnest(l) AS s FROM w) SELECT user_id, day, s.i AS event_id FROM x")
def flow_flatten(spark, d):
    day = events(spark, d).groupBy("user_id", F.floor(F.col("time_us") / 86_400_000_000).alias("day")).agg(F.collect_list(F.struct("user_id", F.floor(F.col("time_us") / 86_400_000_000).alias("day"), "event_id")).alias("events"))
    return stateless.flatten(day)


@query(f"{E} SELECT event_id, 'big' AS part FROM e WHERE value > 50 UNION ALL SELECT event_id, NULL AS part FROM e WHERE event_type = 'click'")
def flow_combine(spark, d):
    df = events(spark, d)
    return stateless.combine(df.filter("value > 50").select("event_id", F.lit("big").alias("part")), df.filter("event_type = 'click'").select("event_id"))


@query(f"{E} SELECT event_type AS kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY time_us, event_id) AS n FROM e) WHERE n % 50 = 0")
def flow_split(spark, d):
    return stateless.split(events(spark, d), "event_type", lambda df, keys: windows.samplecount(df, 50, keys), "kind").select("kind", "event_id")


@query(f"{E} SELECT 'max' AS op, max(value) AS value FROM e UNION ALL SELECT 'min' AS op, min(value) AS value FROM e")
def flow_every(spark, d):
    a, b = stateless.every(events(spark, d).select("value"), lambda x: x.agg(F.max("value").alias("value")), lambda x: x.agg(F.min("value").alias("value")))
    return a.select(F.lit("max").alias("op"), "value").unionByName(b.select(F.lit("min").alias("op"), "value"))


@query(f"{E} SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, time_us, event_id) AS n FROM e) WHERE n = 1")
def flow_max(spark, d):
    return agg.max_(events(spark, d), "value", USER).select("user_id", "event_id", "value")


@query(f"{E} SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, time_us, event_id) AS n FROM e) WHERE n = 1")
def flow_min(spark, d):
    return agg.min_(events(spark, d), "value", USER).select("user_id", "event_id", "value")


@query(f"{E} SELECT user_id, arg_max(event_id, time_us) AS event_id, round(sum(value), 4) AS metric FROM e GROUP BY user_id")
def flow_sum(spark, d):
    return agg.sum_(events(spark, d), "value", USER).select("user_id", "event_id", _r("metric").alias("metric"))


@query(f"{E} SELECT user_id, arg_max(event_id, time_us) AS event_id, count(*) AS metric FROM e GROUP BY user_id")
def flow_count(spark, d):
    return agg.count_(events(spark, d), USER).select("user_id", "event_id", "metric")


@query(f"{E} SELECT user_id, arg_max(event_id, time_us) AS event_id, count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 4) AS average, min(value) AS min, max(value) AS max FROM e GROUP BY user_id")
def flow_stats(spark, d):
    return agg.stats(events(spark, d), "value", USER).select("user_id", "event_id", "count", _r("sum").alias("sum"), _r("average").alias("average"), "min", "max")


@query(f"{E}, g AS (SELECT user_id, time_us // 86400000000 AS day, list(value ORDER BY time_us, event_id) AS l FROM e GROUP BY ALL) SELECT user_id, day, round(list_reduce(list_prepend(l[1], l), lambda a, x: x - a), 4) AS result FROM g")
def flow_reduce(spark, d):
    day = events(spark, d).withColumn("day", F.floor(F.col("time_us") / 86_400_000_000))
    return agg.reduce_(day, lambda a, x: x - a, ["user_id", "day"], value="value").select("user_id", "day", _r("result").alias("result"))


@query(f"{E} SELECT user_id, arg_max(event_id, time_us) AS event_id, round(sum(value) / 86400000 * 1000000, 4) AS metric FROM e GROUP BY user_id")
def flow_rate(spark, d):
    return agg.rate(events(spark, d), "value", days(1), USER).select("user_id", "event_id", _r(F.col("metric") * 1_000_000).alias("metric"))


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, time_us, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e) SELECT event_type || ' ' || p AS name, event_id, value FROM r, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) t(p) WHERE k = least(CAST(floor(p * n) AS BIGINT), n - 1)")
def flow_percentiles(spark, d):
    df = events(spark, d).withColumn("name", F.col("event_type"))
    return agg.percentiles(df, "value", [0.0, 0.5, 0.95, 1.0], ["event_type"], name="name").select("name", "event_id", "value")


@query(f"{E} SELECT event_type, time_us // 86400000000 * 86400000000 AS window_us, CAST(count(*) FILTER (value < 20) AS BIGINT) AS satisfied, CAST(count(*) FILTER (value >= 20 AND value < 60) AS BIGINT) AS tolerated, round((count(*) FILTER (value < 20) + count(*) FILTER (value >= 20 AND value < 60) / 2) / count(*), 4) AS apdex FROM e GROUP BY ALL")
def flow_apdex(spark, d):
    return agg.apdex(events(spark, d), "value < 20", "value < 60", days(1), ["event_type"]).withColumn("apdex", _r("apdex"))


@query(f"{E} SELECT event_id, count(*) OVER w - 1 AS context_count, round(coalesce(sum(value) OVER w, 0) - value, 4) AS context_sum FROM e WINDOW w AS (PARTITION BY user_id ORDER BY time_us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)")
def flow_contexttime(spark, d):
    return windows.contexttime_sums(events(spark, d), "value", days(2), USER).select("event_id", "context_count", _r("context_sum").alias("context_sum"))


@query(f"{E} SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 4) AS mean FROM e WINDOW w AS (PARTITION BY user_id ORDER BY time_us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def flow_contextcount(spark, d):
    return windows.contextcount(events(spark, d), 5, USER, aggregates={"n": F.count(F.lit(1)), "mean": F.avg("value")}).select("event_id", "n", _r("mean").alias("mean"))


@query(f"{E} SELECT event_type, time_us // 21600000000 * 21600000000 AS window_us, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def flow_grouptime(spark, d):
    return windows.grouptime(events(spark, d), hours(6), ["event_type"], {"n": F.count(F.lit(1)), "total": _r(F.sum("value"))})


@query(f"{E}, g AS (SELECT *, (row_number() {OVER} - 1) // 10 AS group_no FROM e) SELECT user_id, group_no, round(sum(value), 4) AS total, max(time_us) AS last_us FROM g GROUP BY ALL HAVING count(*) = 10")
def flow_groupcount(spark, d):
    return windows.groupcount(events(spark, d), 10, USER, {"total": _r(F.sum("value")), "last_us": F.max("time_us")})


@query(f"{E} SELECT event_id, user_id FROM (SELECT *, row_number() {OVER} AS n FROM e) WHERE n % 7 = 0")
def flow_samplecount(spark, d):
    return windows.samplecount(events(spark, d), 7, USER).select("event_id", "user_id")


@query(f"{E} SELECT event_id FROM (SELECT *, lead(time_us) {OVER} AS nx FROM e) WHERE nx IS NULL OR nx - time_us >= 43200000000")
def flow_settle(spark, d):
    return windows.settle(events(spark, d), hours(12), USER).select("event_id")


@query(f"{E} SELECT event_id FROM (SELECT *, lag(time_us) {OVER} AS pt, lag(event_type) {OVER} AS pv FROM e) WHERE time_us - pt <= 86400000000 AND pv = event_type")
def flow_stable(spark, d):
    return windows.stable(events(spark, d), days(1), "event_type", USER).select("event_id")


@query(f"{E}, p AS (SELECT *, value - lag(value) {OVER} AS dv, (time_us - lag(time_us) {OVER}) / 1000 AS dt FROM e) SELECT event_id, round(CASE WHEN dv <> 0 AND dt <> 0 THEN dv / dt ELSE 0 END * 1000000, 4) AS metric FROM p")
def flow_ddt(spark, d):
    return windows.ddt(events(spark, d), "value", USER).select("event_id", _r(F.col("metric") * 1_000_000).alias("metric"))


@query(f"{E}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_us DESC, event_id DESC) AS n FROM e) SELECT user_id, event_id, CASE WHEN time_us + 86400000000 < 1706659200000000 THEN 'expired' END AS state FROM l WHERE n = 1")
def flow_coalesce(spark, d):
    return windows.coalesce_latest(events(spark, d), USER, 1_706_659_200_000_000, str(days(1))).select("user_id", "event_id", "state")


@query(
    f"""{E}, p AS (SELECT *, lag(time_us) {OVER} AS before,
       last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) {OVER} AS c, last_value(CASE WHEN event_type = 'click' THEN time_us END IGNORE NULLS) {OVER} AS ct,
       last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) {OVER} AS b, last_value(CASE WHEN value > 50 THEN time_us END IGNORE NULLS) {OVER} AS bt FROM e)
    SELECT event_id, CASE WHEN c = event_id OR ct + 86400000000 >= before THEN c END AS click_id, CASE WHEN b = event_id OR bt + 86400000000 >= before THEN b END AS big_id FROM p"""
)
def flow_project(spark, d):
    out = windows.project(events(spark, d), ["event_type = 'click'", "value > 50"], str(days(1)), USER)
    return out.select("event_id", F.col("slot0.event_id").alias("click_id"), F.col("slot1.event_id").alias("big_id"))


@query(
    f"""{E}, n AS (SELECT *, lead(time_us) {OVER} AS nx FROM e)
    SELECT event_id, time_us, false AS filled FROM e UNION ALL
    SELECT event_id, time_us + k * 7200000000 AS time_us, true AS filled FROM n, range(1, 13) r(k) WHERE k * 7200000000 <= 86400000000 AND (nx IS NULL OR time_us + k * 7200000000 < nx)"""
)
def flow_fillin(spark, d):
    return windows.fillin(events(spark, d), hours(2), USER, str(days(1))).select("event_id", "time_us", "filled")


_REC = f"{E.replace('WITH', 'WITH RECURSIVE')}, s AS (SELECT *, row_number() {OVER} AS n FROM e)"


@query(f"{_REC}, r AS (SELECT user_id, n, event_id, value AS cur FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, s.event_id, s.value * 0.3 + (CASE WHEN r.cur = 0 THEN s.value ELSE r.cur END) * 0.7 FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) SELECT event_id, round(cur, 4) AS metric FROM r")
def flow_ewmatimeless(spark, d):
    return stateful.ewmatimeless(events(spark, d), "value", 0.3, USER).select("event_id", _r("metric").alias("metric"))


@query(f"{_REC}, r AS (SELECT user_id, n, event_id, time_us, value AS cur FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, s.event_id, s.time_us, (1 - exp(-((s.time_us - r.time_us) / 43200000000))) * s.value + exp(-((s.time_us - r.time_us) / 43200000000)) * r.cur FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) SELECT event_id, round(cur, 4) AS metric FROM r")
def flow_ewma(spark, d):
    return stateful.ewma(events(spark, d), "value", hours(12), USER).select("event_id", _r("metric").alias("metric"))


@query(f"{_REC}, r AS (SELECT user_id, n, event_id, time_us AS last, false AS ok FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, s.event_id, CASE WHEN s.time_us - r.last > 86400000000 THEN s.time_us ELSE r.last END, s.time_us - r.last > 86400000000 FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) SELECT event_id FROM r WHERE ok")
def flow_sampletime(spark, d):
    return stateful.sampletime(events(spark, d), days(1), USER).select("event_id")


_T = "172800000000"


@query(
    f"""{_REC}, r AS (
      SELECT user_id, n, event_id, [time_us] AS recent, CAST(NULL AS BIGINT) AS due, true AS ok FROM s WHERE n = 1 UNION ALL
      SELECT user_id, n, event_id, recent, CASE WHEN open AND len(recent) > 3 THEN recent[1] + {_T} WHEN NOT open THEN due END, open AND len(recent) <= 3
      FROM (SELECT user_id, n, event_id, due, open, CASE WHEN open THEN list_filter(list_append(base, t), lambda x: t - x < {_T}) ELSE base END AS recent
            FROM (SELECT s.user_id, s.n, s.event_id, s.time_us AS t, r.due, r.due IS NULL OR r.due <= s.time_us AS open, CASE WHEN r.due <= s.time_us THEN [] ELSE r.recent END AS base
                  FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)))
    SELECT event_id FROM r WHERE ok"""
)
def flow_throttle(spark, d):
    return stateful.throttle(events(spark, d), 3, days(2), USER).select("event_id")


_LAST = "(user_id, n) IN (SELECT (user_id, max(n)) FROM s GROUP BY user_id)"
_NUMBERED = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n, k) - 1 AS group_no, us AS fired_us, size AS n FROM o"


@query(
    f"""{_REC}, r AS (
      SELECT user_id, n, [time_us] AS recent, CAST(NULL AS BIGINT) AS due, CAST(0 AS BIGINT) AS rest, time_us AS one_us, CAST(NULL AS BIGINT) AS rest_us, CAST(0 AS BIGINT) AS rest_n FROM s WHERE n = 1 UNION ALL
      SELECT user_id, n, recent, CASE WHEN waits THEN due WHEN len(recent) > 2 THEN recent[1] + {_T} END, CASE WHEN waits THEN rest + 1 WHEN len(recent) > 2 THEN 1 ELSE 0 END, CASE WHEN NOT waits AND len(recent) <= 2 THEN t END, rest_us, rest_n
      FROM (SELECT user_id, n, t, due, rest, waits, rest_us, rest_n, CASE WHEN waits THEN base ELSE list_filter(list_append(base, t), lambda x: t - x < {_T}) END AS recent
            FROM (SELECT s.user_id, s.n, s.time_us AS t, r.due, r.rest, coalesce(r.due > s.time_us, false) AS waits, CASE WHEN r.due <= s.time_us THEN [] ELSE r.recent END AS base,
                         CASE WHEN r.due <= s.time_us THEN r.due END AS rest_us, r.rest AS rest_n
                  FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))),
    o AS (SELECT user_id, n, 0 AS k, rest_us AS us, rest_n AS size FROM r WHERE rest_us IS NOT NULL UNION ALL SELECT user_id, n, 1, one_us, 1 FROM r WHERE one_us IS NOT NULL UNION ALL SELECT user_id, n, 2, due, rest FROM r WHERE due IS NOT NULL AND {_LAST})
    {_NUMBERED}"""
)
def flow_rollup(spark, d):
    out = stateful.rollup(events(spark, d), 2, days(2), USER)
    return out.select("user_id", "group_no", "fired_us", F.size("events").cast("long").alias("n"))


_H = "43200000000"


@query(
    f"""{_REC}, r AS (
      SELECT user_id, n, event_id AS own, time_us AS own_us, CAST(NULL AS BIGINT) AS old, CAST(NULL AS BIGINT) AS old_us, time_us AS last, CAST(NULL AS BIGINT) AS held FROM s WHERE n = 1 UNION ALL
      SELECT user_id, n, CASE WHEN t - l > {_H} THEN event_id END, t, old, old_us, CASE WHEN t - l > {_H} THEN t ELSE l END, CASE WHEN t - l <= {_H} THEN event_id END
      FROM (SELECT s.user_id, s.n, s.event_id, s.time_us AS t, CASE WHEN r.held IS NOT NULL AND r.last + {_H} <= s.time_us THEN r.last + {_H} ELSE r.last END AS l,
                   CASE WHEN r.last + {_H} <= s.time_us THEN r.held END AS old, r.last + {_H} AS old_us
            FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))
    SELECT own AS event_id, user_id, own_us AS fired_us FROM r WHERE own IS NOT NULL UNION ALL SELECT old, user_id, old_us FROM r WHERE old IS NOT NULL UNION ALL SELECT held, user_id, last + {_H} FROM r WHERE held IS NOT NULL AND {_LAST}"""
)
def flow_debounce(spark, d):
    return stateful.debounce(events(spark, d), hours(12), USER).select("event_id", "user_id", "fired_us")


def _batches(us: str, most: str) -> str:
    """SQL of lists of so many events or so many µs since their timer started."""
    return f"""{_REC}, r AS (
      SELECT user_id, n, CAST(NULL AS BIGINT) AS a_us, CAST(0 AS BIGINT) AS a_n, CAST(NULL AS BIGINT) AS b_us, CAST(1 AS BIGINT) AS c, time_us + {us} AS due FROM s WHERE n = 1 UNION ALL
      SELECT user_id, n, a_us, a_n, CASE WHEN c = {most} THEN t END, CASE WHEN c = {most} THEN 0 ELSE c END, CASE WHEN c = {most} THEN t + {us} ELSE due END
      FROM (SELECT user_id, n, t, a_us, a_n, CASE WHEN d IS NULL THEN 1 ELSE c0 + 1 END AS c, coalesce(d, t + {us}) AS due
            FROM (SELECT s.user_id, s.n, s.time_us AS t, CASE WHEN r.due <= s.time_us AND r.c > 0 THEN r.due END AS a_us, r.c AS a_n, CASE WHEN r.due <= s.time_us THEN 0 ELSE r.c END AS c0,
                         CASE WHEN r.due > s.time_us THEN r.due WHEN r.c > 0 AND r.due + {us} > s.time_us THEN r.due + {us} END AS d
                  FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))),
    o AS (SELECT user_id, n, 0 AS k, a_us AS us, a_n AS size FROM r WHERE a_us IS NOT NULL UNION ALL SELECT user_id, n, 1, b_us, {most} FROM r WHERE b_us IS NOT NULL UNION ALL SELECT user_id, n, 2, due, c FROM r WHERE c > 0 AND {_LAST})
    {_NUMBERED}"""


@query(_batches("86400000000", "4"))
def flow_batch(spark, d):
    out = stateful.batch(events(spark, d), 4, days(1), USER)
    return out.select("user_id", "group_no", "fired_us", F.size("events").cast("long").alias("n"))


@query(_batches("64800000000", "-1"))
def flow_grouptime_anchored(spark, d):
    out = stateful.grouptime_anchored(events(spark, d), hours(18), USER)
    return out.select("user_id", "group_no", "fired_us", F.size("events").cast("long").alias("n"))


@query(f"{E} SELECT a.event_id, coalesce(string_agg(CAST(b.event_id AS VARCHAR), ',' ORDER BY b.time_us, b.event_id), '') AS before FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.time_us >= a.time_us - 86400000000 AND (b.time_us, b.event_id) < (a.time_us, a.event_id) GROUP BY a.event_id")
def flow_contexttime_events(spark, d):
    rows = windows.contexttime(events(spark, d), days(1), USER)
    ids = F.transform(F.array_sort(F.transform("events", lambda x: F.struct(x["time_us"], x["event_id"]))), lambda x: x["event_id"].cast("string"))
    return rows.select("event_id", F.array_join(ids, ",").alias("before"))


@query(f"{E}, m AS (SELECT event_type AS key, count(*) AS value FROM e GROUP BY 1) SELECT key, value, 'value desc' AS ordering FROM (FROM m ORDER BY value DESC, key LIMIT 2) UNION ALL SELECT key, value, 'value asc' FROM (FROM m ORDER BY value, key LIMIT 2) UNION ALL SELECT key, value, 'key desc' FROM (FROM m ORDER BY key DESC LIMIT 2) UNION ALL SELECT key, value, 'key asc' FROM (FROM m ORDER BY key LIMIT 2)")
def comparators(spark, d):
    m = agg.group_sums(events(spark, d).withColumnRenamed("event_type", "key"), ["key"], F.lit(1))
    parts = {"value desc": agg.byvaluedesc, "value asc": agg.byvalueasc, "key desc": agg.bykeydesc, "key asc": agg.bykeyasc}
    return functools.reduce(DataFrame.unionByName, [by(m).limit(2).withColumn("ordering", F.lit(name)) for name, by in parts.items()])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def flow_group_sums(spark, d):
    return agg.group_sums(load(spark, d, "events"), ["event_type"], F.lit(1), name="n")


@query("WITH m AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1) SELECT round(min(v), 4) AS min, round(max(v), 4) AS max, round(sum(v), 4) AS sum, round(avg(v), 4) AS avg FROM m")
def objstats(spark, d):
    sums = agg.group_sums(load(spark, d, "events"), ["event_type"], "value")
    return agg.objstats(sums).select(*[_r(c).alias(c) for c in ("min", "max", "sum", "avg")])


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def source_ndjson(spark, d):
    from deltaloom.sources import lines

    rows = load(spark, d, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit("}")).alias("value"))
    good, _ = lines.parse(rows, "event_id long, props struct<k: long>")
    return good.select("event_id", F.col("props.k").alias("k"))


@query(f"{E} SELECT event_id, lpad(CAST(time_us // 1000 AS VARCHAR), 13, '0') AS padded FROM e WHERE time_us BETWEEN 1704844800000000 AND 1704931200000000")
def timeseries_range(spark, d):
    from deltaloom.functions.times import pad_timestamp
    from deltaloom.sources.store import series

    rows = series(events(spark, d), 1_704_844_800_000_000, 1_704_931_200_000_000, "time_us", "event_id")
    return rows.select("event_id", pad_timestamp(F.expr("time_us div 1000")).alias("padded"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '12' AND CAST(o_orderkey AS VARCHAR) < '13'")
def kv_scan(spark, d):
    from deltaloom.sources.store import Store

    table = load(spark, d, "orders").select(F.concat(F.lit("orders·"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_custkey").cast("string").alias("value"))
    return Store(table, "orders·").scan(gt="12", lt="13")


@query("SELECT c_custkey, c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS isvalid, CASE WHEN c_acctbal < 0 THEN 'negative' END AS balance, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') THEN 'not served' END AS segment FROM customer")
def check_rules(spark, d):
    from deltaloom.functions.rules import check

    out = check(load(spark, d, "customer"), {"balance": {"negative": "c_acctbal >= 0"}, "segment": {"not served": "c_mktsegment IN ('BUILDING', 'AUTOMOBILE')"}})
    return out.select("c_custkey", "isvalid", F.array_join("balance", ",").alias("balance"), F.array_join("segment", ",").alias("segment"))


@query(
    """WITH t AS (SELECT event_id, 100000 - event_id AS rc, (100000 - event_id) * (1000.0::DOUBLE * (event_id % 97 + 1) / 50) AS rm FROM events),
    u AS (SELECT *, CAST(floor(rm / 3600000) AS BIGINT) AS h, CAST(floor(rm / 60000) AS BIGINT) AS m0, CAST(floor(rm / 1000) AS BIGINT) AS s0 FROM t)
    SELECT event_id, rc AS remaining_count, CASE WHEN h <> 0 THEN h || 'h ' || lpad(CAST(m0 - h * 60 AS VARCHAR), 2, '0') || 'm' WHEN m0 <> 0 THEN m0 || 'm ' || lpad(CAST(s0 - m0 * 60 AS VARCHAR), 2, '0') || 's' ELSE s0 || 's' END AS remaining_fmt FROM u"""
)
def timing_eta(spark, d):
    from deltaloom.functions.times import progress

    cols = progress(F.lit(100_000), F.col("event_id"), F.lit(1000.0) * (F.col("event_id") % 97 + 1), F.lit(50))
    return load(spark, d, "events").select("event_id", cols["remaining_count"].alias("remaining_count"), cols["remaining_fmt"].alias("remaining_fmt"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def pathie_flat(spark, d):
    from deltaloom.functions import paths

    rows = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return paths.flat(paths.build(rows, ["user_id", "event_type"], "n", "tree"), "tree", ["user_id", "event_type"], "n")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tree FROM c GROUP BY user_id")
def pathie_build(spark, d):
    from deltaloom.functions import paths

    rows = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    tree = paths.build(rows, ["event_type"], "n", "tree", ["user_id"])
    return tree.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("tree")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("tree"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS clicks, count(*) AS kinds, max(event_type = 'view') AS views, sum(n) FILTER (event_type <> 'click') AS rest FROM c GROUP BY user_id) SELECT user_id, clicks, coalesce(clicks, 0) AS clicks_or, coalesce(views, false) AS has_view, kinds, coalesce(clicks, 0) + 1 AS assigned, coalesce(rest, 0) AS removed FROM u")
def pathie_access(spark, d):
    from deltaloom.functions import paths

    rows = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    tree = paths.build(rows.withColumn("top", F.lit("t")), ["top", "event_type"], "n", "tree", ["user_id"])
    t, total = F.col("tree"), lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    more = paths.assign(t, ["t", "click"], lambda old: F.coalesce(old, F.lit(0).cast("long")) + 1)
    return tree.select(
        "user_id", paths.get(t, "t", "click").alias("clicks"), paths.get_or(t, ["t", "click"], F.lit(0).cast("long")).alias("clicks_or"), paths.has(t, "t", "view").alias("has_view"),
        F.size(paths.keys(t, "t")).cast("long").alias("kinds"), paths.get(more, "t", "click").alias("assigned"), total(paths.get(paths.remove(t, "t", "click"), "t")).alias("removed"),
    )


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM c WHERE n > 12 GROUP BY user_id")
def pathie_clean(spark, d):
    """Maps of maps, of which the inner ones without an entry over 12 are empty and go."""
    from deltaloom.functions import paths

    rows = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    tree = paths.build(rows.withColumn("leaf", F.lit("n")), ["event_type", "leaf"], "n", "tree", ["user_id"])
    some = F.transform_values("tree", lambda k, v: F.map_filter(v, lambda _, n: n > 12))
    out = tree.select("user_id", paths.clean(some, 2).alias("tree")).filter(F.size("tree") > 0)
    return out.select("user_id", F.array_join(F.array_sort(F.map_keys("tree")), ",").alias("kinds"))


@query("SELECT c_custkey, c_name, round(c_acctbal * 100) AS c_acctbal FROM customer")
def source_csv(spark, d):
    """Customers as lines of CSV, read back with a cast and with cents."""
    from deltaloom.sources import lines

    rows = load(spark, d, "customer").select(F.to_csv(F.struct(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))).alias("value"))
    return lines.parse_csv(rows, ["c_custkey", "c_name", "c_acctbal"], {"c_custkey": "long"}, ["c_acctbal"])


@query(f"{E} SELECT event_id FROM e WHERE time_us < 1704931200000000 AND event_id % 3 <> 0 UNION ALL SELECT event_id FROM e WHERE time_us < 1704931200000000 AND event_id % 6 = 0")
def timeseries_batch(spark, d):
    from deltaloom.sources.store import Series

    rows = events(spark, d).filter("time_us < 1704931200000000")
    return Series(rows, "time_us", "event_id").delete(rows.filter("event_id % 3 = 0")).put(rows.filter("event_id % 6 = 0")).df.select("event_id")
