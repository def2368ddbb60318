"""Queries over ``events``, read as telemetry: key ``user_id``, axis ``event_type``, order ``ts, event_id``.

The driver tables hold no robot data; these are proxies that exercise the operators on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions.clock import age_ms, micros, next_tick, tick
from kinetrace.operators import control, correlate, health, timeline, trace
from kinetrace.session import table

ORDER = ["us", "event_id"]
AXES = ("click", "error", "purchase", "signup", "view")
US = "epoch_us(ts)"


def _events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"))


def _errors(spark, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    before = F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy(*ORDER))
    return rows.withColumn("error", F.col("value") - before)


def trace_axis_summary(spark, sf_dir):
    out = trace.error_summary(_errors(spark, sf_dir), ["event_type"], F.col("error"))
    return out.select("event_type", "n", F.round("rmse", 6).alias("rmse"), F.round("peak", 6).alias("peak"))


def trace_page_summary(spark, sf_dir):
    out = trace.page_summary(_errors(spark, sf_dir), ["event_type"], ORDER, "error", 400)
    return out.select("event_type", "n", F.round("rmse", 6).alias("rmse"), F.round("peak", 6).alias("peak"), F.round("latest", 6).alias("latest"))


def trace_wide(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("hour", (F.col("us") / 3_600_000_000).cast("long")).groupBy("user_id", "hour", "event_type").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
    wide = trace.wide_samples(rows, ["user_id", "hour"], ["peak", "n"], ["click", "view"], "event_type")
    return wide.withColumnsRenamed({c: c.replace(".", "_") for c in wide.columns})


def run_peak(spark, sf_dir):
    out = trace.running_peak(_events(spark, sf_dir), ["user_id"], ORDER, F.col("value"))
    return out.select("event_id", "running_peak")


def merged_series(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "us", "value", "event_type")
    both = trace.merged_series(rows.filter("event_type = 'click'").drop("event_type"), rows.filter("event_type = 'view'").drop("event_type"), "us")
    return both.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))


def timeline_gaps(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("s", F.col("us") / 1e6)
    out = timeline.diagnostics(rows, ["user_id"], ORDER, "s", 1 / 3600)
    return out.select("user_id", "frames", "duplicates", "gaps", F.round("max_interval_ms", 3).alias("max_interval_ms"), F.round("duration_s", 3).alias("duration_s"), "runs_back", "valid")


def timeline_median(spark, sf_dir):
    out = _events(spark, sf_dir).groupBy("user_id").agg(F.median("value").alias("m"))
    return out.select("user_id", F.round("m", 6).alias("median_value"))


def _hours(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("us", F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000)


def keep_last_of_equal(spark, sf_dir):
    return timeline.keep_last_of_equal(_hours(spark, sf_dir), ["user_id"], ORDER, "us").select("event_id", "user_id", "us")


def resample_grid(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("held", F.col("value")).withColumn("s", F.col("us").cast("double"))
    out = timeline.resample(rows, ["user_id"], ORDER, "us", ["held"], ["value"], 1 / 3_600_000_000)
    return out.select("user_id", "step", F.round("held", 6).alias("held"), F.round("value", 4).alias("value"))


def last_n_events(spark, sf_dir):
    return trace.last_n(_events(spark, sf_dir), ["user_id"], ORDER, 3).select("event_id", "user_id", "us")


def latest_by_key(spark, sf_dir):
    return health.latest(_events(spark, sf_dir), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id", "value")


def freshness(spark, sf_dir):
    rows = health.latest(_events(spark, sf_dir), ["user_id"], ORDER)
    now = _events(spark, sf_dir).agg(F.max("us")).scalar()
    out = health.with_age(rows, F.col("us") / 1e6, now / 1e6, 3600.0)
    return out.select("user_id", F.round("age_ms", 1).alias("age_ms"), "fresh")


def trailing_rate(spark, sf_dir):
    out = health.trailing_rate(_events(spark, sf_dir), ["user_id"], "us", 7_200_000_000)
    return out.select("event_id", F.round(F.col("rate") * 1e9, 6).alias("per_1000_s"))


def silent_gaps(spark, sf_dir):
    return health.silent_gaps(_events(spark, sf_dir), ["user_id"], ORDER, "us", 43_200_000_000).select("event_id", "gap")


def repeat_counters(spark, sf_dir):
    marked = health.mark_repeats(_hours(spark, sf_dir), ["user_id"], ["us", "event_id"], "us")
    return health.stream_counters(marked, ["user_id"], F.col("value") < 5)


def unhealthy(spark, sf_dir):
    streams = _events(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("mean"))
    out = health.all_healthy(streams, F.col("mean") > 20, "event_type")
    return out.select("healthy", F.array_join("missing", ",").alias("missing"))


def changes(spark, sf_dir):
    return health.changes(_events(spark, sf_dir), ["user_id"], ORDER, ["event_type"]).select("event_id", "event_type")


def transitions(spark, sf_dir):
    return health.transitions(_events(spark, sf_dir), ["user_id"], ORDER, "event_type")


def sessions(spark, sf_dir):
    return health.sessions(_events(spark, sf_dir), ["user_id"], ORDER, "us", 21_600_000_000.0, 86_400_000_000.0)


def send_gaps(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return health.send_gaps(rows, "user_id", "us", "day")


def battery_classes(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.col("value").alias("percent"), (F.col("event_type") == "view").alias("charging"), (F.col("event_id") % 7 != 0).alias("fresh"))
    rows = rows.withColumn("b", health.battery(F.col("percent"), F.col("charging"), F.col("fresh")))
    return rows.select(
        "event_id",
        health.battery_level(F.col("b.percent"), F.col("b.charging")).alias("level"),
        health.battery_label(F.col("b.percent")).alias("label"),
        health.may_move(F.col("percent"), F.when(F.col("charging"), 1).otherwise(2)).alias("arm"),
        health.may_move(F.col("percent"), F.when(F.col("charging"), 1).otherwise(2), chassis=True).alias("chassis"),
    )


def debounce_runs(spark, sf_dir):
    return control.debounced(_events(spark, sf_dir), ["user_id"], ORDER, F.col("value") > 20, 3).select("event_id", "user_id")


def run_lengths(spark, sf_dir):
    return control.runs_of(_events(spark, sf_dir), ["user_id"], ORDER, F.col("value") > 20).select("event_id", F.col("run_length").cast("long").alias("run_length"))


def tick_gaps(spark, sf_dir):
    rows = _events(spark, sf_dir)
    base = F.min("us").over(Window.partitionBy("user_id"))
    rows = rows.withColumn("tick", tick(F.col("us") / 1e6, base / 1e6, 1 / 1800))
    out = control.missed_ticks(rows, ["user_id"], ORDER, "tick")
    return out.select("event_id", "tick", F.col("missed").cast("long").alias("missed"))


def next_ticks(spark, sf_dir):
    rows = _events(spark, sf_dir)
    before = F.lag("us").over(Window.partitionBy("user_id").orderBy(*ORDER))
    return rows.withColumn("before", before).filter("before is not null").select("event_id", next_tick(F.col("before"), F.col("us"), 600_000_000).cast("long").alias("next_us"))


def rolling_delay(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("steps", F.floor("value").cast("long"))
    return control.rolling_delay(rows, ["user_id"], ORDER, "steps").select("event_id", F.col("delay").cast("long").alias("delay"))


def handoffs(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("steps", F.floor("value").cast("long"))
    k = control.handoff(F.col("steps"), F.col("event_id") % 97)
    fits = control.schedule_fits(F.col("steps"), F.col("event_id") % 9, F.lit(2))
    return rows.select("event_id", k.alias("k"), fits.alias("fits"))


def reset_peaks(spark, sf_dir):
    out = control.reset_peaks(_events(spark, sf_dir), ["user_id"], ORDER, F.col("value"), F.col("event_type") == "purchase")
    return out.select("event_id", "peak")


def wait_intervals(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return correlate.wait_intervals(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), ["user_id"], "day", "us")


def asof_values(spark, sf_dir):
    rows = _events(spark, sf_dir)
    left = rows.filter("event_type = 'click'").select("user_id", "us", "event_id")
    return correlate.asof_backward(left, rows.filter("event_type = 'view'"), ["user_id"], "us", ["value"]).select("event_id", "value")


def nearest_values(spark, sf_dir):
    rows = _events(spark, sf_dir)
    left = rows.filter("event_type = 'click'").select("user_id", "us", "event_id")
    right = rows.filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("near_id"))
    return correlate.asof_nearest(left, right, ["user_id"], "us", "near_id", 36_000_000_000.0).select("event_id", "near_id")


def observations(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("s", F.col("us") / 1e6)
    states = rows.filter("event_type = 'purchase'").select("user_id", "s", "event_id")
    out = correlate.observations(states, rows, ["user_id"], "s", "event_type", ["click", "view"])
    return out.select("event_id", F.round("click_t", 3).alias("click_t"), F.round("view_t", 3).alias("view_t"), F.round("max_age_ms", 0).alias("max_age_ms"))


def missing_expected(spark, sf_dir):
    rows = _events(spark, sf_dir)
    expected = rows.select("user_id").distinct().withColumn("event_type", F.explode(F.lit(list(AXES))))
    found = rows.filter("value > 60")
    return correlate.missing_expected(expected, found, ["user_id", "event_type"])


def stale_replies(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("epoch", F.floor(F.col("us") / 604_800_000_000))
    out = correlate.stale_replies(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), ["user_id", "epoch"])
    return out.select("event_id")


def event_age(spark, sf_dir):
    rows = _events(spark, sf_dir)
    last = F.max("us").over(Window.partitionBy("user_id"))
    return rows.select("event_id", F.round(age_ms(last / 1e6, F.col("us") / 1e6), 1).alias("age_ms"))


QUERIES = {f.__name__: f for f in (
    trace_axis_summary, trace_page_summary, trace_wide, run_peak, merged_series, timeline_gaps, timeline_median, keep_last_of_equal, resample_grid, last_n_events,
    latest_by_key, freshness, trailing_rate, silent_gaps, repeat_counters, unhealthy, changes, transitions, sessions, send_gaps, battery_classes, debounce_runs,
    run_lengths, tick_gaps, next_ticks, rolling_delay, handoffs, reset_peaks, wait_intervals, asof_values, nearest_values, observations, missing_expected, stale_replies, event_age,
)}

E = f"e AS (SELECT event_id, user_id, event_type, value, {US} AS us FROM events)"
ERR = f"WITH {E}, x AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS error FROM e)"
W = "OVER (PARTITION BY user_id ORDER BY us, event_id)"
HOUR = "hours AS (SELECT event_id, user_id, value, floor(us / 3600000000)::BIGINT * 3600000000 AS us FROM e)"
ORACLES = {
    "trace_axis_summary": f"{ERR} SELECT event_type, count(error) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(max(abs(error)), 6) AS peak FROM x GROUP BY 1",
    "trace_page_summary": f"""{ERR}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC) AS r FROM x) WHERE r <= 400)
SELECT event_type, count(error) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(max(abs(error)), 6) AS peak, round(arg_max(error, (us, event_id)) FILTER (error IS NOT NULL), 6) AS latest FROM p GROUP BY 1""",
    "trace_wide": f"""WITH {E}, h AS (SELECT user_id, floor(us / 3600000000)::BIGINT AS hour, event_type, max(value) AS peak, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, hour, max(peak) FILTER (event_type = 'click') AS peak_click, max(peak) FILTER (event_type = 'view') AS peak_view, max(n) FILTER (event_type = 'click') AS n_click, max(n) FILTER (event_type = 'view') AS n_view FROM h GROUP BY 1, 2""",
    "run_peak": f"WITH {E} SELECT event_id, max(abs(value)) {W} AS running_peak FROM e",
    "merged_series": f"WITH {E} SELECT CASE event_type WHEN 'click' THEN 'held' ELSE 'sent' END AS series, count(*) AS n, min(us) AS first, max(us) AS last FROM e WHERE event_type IN ('click', 'view') GROUP BY 1",
    "timeline_gaps": f"""WITH {E}, d AS (SELECT user_id, us / 1e6 AS s, us / 1e6 - lag(us / 1e6) {W} AS dt FROM e)
SELECT user_id, count(*) AS frames, count(*) FILTER (dt = 0) AS duplicates, count(*) FILTER (dt > 5400) AS gaps, round(coalesce(max(dt), 0) * 1000, 3) AS max_interval_ms,
round(max(s) - min(s), 3) AS duration_s, false AS runs_back, count(*) = 1 OR max(s) > min(s) AS valid FROM d GROUP BY 1""",
    "timeline_median": "SELECT user_id, round(median(value), 6) AS median_value FROM events GROUP BY 1",
    "keep_last_of_equal": f"WITH {E}, {HOUR} SELECT max(event_id) AS event_id, user_id, us FROM hours GROUP BY user_id, us",
    "resample_grid": f"""WITH {E}, s AS (SELECT user_id, us, value, lead(us) {W} AS nt, lead(value) {W} AS nv FROM e),
b AS (SELECT user_id, min(us) AS t0, max(us) AS t1 FROM e GROUP BY 1), n AS (SELECT *, CASE WHEN t1 > t0 THEN greatest(1, round_even((t1 - t0) / 3600000000, 0)::BIGINT) ELSE 0 END AS steps FROM b),
g AS (SELECT user_id, i AS step, CASE WHEN i = steps THEN t1::DOUBLE ELSE t0 + i * ((t1 - t0) / greatest(steps, 1)) END AS gt FROM (SELECT *, unnest(generate_series(0, steps)) AS i FROM n))
SELECT g.user_id, step, round(value, 6) AS held, round(CASE WHEN nt IS NULL OR gt = us THEN value ELSE value + (nv - value) * ((gt - us) / (nt - us)) END, 4) AS value FROM g ASOF JOIN s ON g.user_id = s.user_id AND g.gt >= s.us""",
    "last_n_events": f"WITH {E} SELECT event_id, user_id, us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM e) WHERE r <= 3",
    "latest_by_key": f"WITH {E} SELECT user_id, event_type, arg_max(event_id, (us, event_id)) AS event_id, arg_max(value, (us, event_id)) AS value FROM e GROUP BY 1, 2",
    "freshness": f"WITH {E}, l AS (SELECT user_id, max(us) AS us FROM e GROUP BY 1), m AS (SELECT max(us) AS now FROM l) SELECT user_id, round(greatest(0, now / 1e6 - us / 1e6) * 1000, 1) AS age_ms, greatest(0, now / 1e6 - us / 1e6) * 1000 <= 3600000 AS fresh FROM l, m",
    "trailing_rate": f"""WITH {E}, w AS (SELECT event_id, count(*) OVER r AS n, min(us) OVER r AS a, max(us) OVER r AS b FROM e WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n < 2 OR b <= a THEN 0 ELSE (n - 1) / (b - a) END * 1e9, 6) AS per_1000_s FROM w""",
    "silent_gaps": f"WITH {E}, g AS (SELECT event_id, lead(us) {W} - us AS gap FROM e) SELECT event_id, gap FROM g WHERE gap > 43200000000",
    "repeat_counters": f"""WITH {E}, {HOUR}, m AS (SELECT *, coalesce(lag(us) {W} = us, false) AS repeat FROM hours)
SELECT user_id, count(*) AS polls, count(*) FILTER (NOT repeat AND value >= 5) AS fresh, count(*) FILTER (repeat) AS repeats, count(*) FILTER (NOT repeat AND value < 5) AS invalid FROM m GROUP BY 1""",
    "unhealthy": "WITH s AS (SELECT event_type, avg(value) > 20 AS ok FROM events GROUP BY 1) SELECT bool_and(ok) AS healthy, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT ok), '') AS missing FROM s",
    "changes": f"WITH {E}, c AS (SELECT event_id, event_type, lag(event_type) {W} AS b FROM e) SELECT event_id, event_type FROM c WHERE b IS DISTINCT FROM event_type",
    "transitions": f'WITH {E}, c AS (SELECT event_type AS "after", lag(event_type) {W} AS "before" FROM e) SELECT "before", "after", count(*) AS n FROM c WHERE "before" <> "after" GROUP BY 1, 2',
    "sessions": f"""WITH {E}, n AS (SELECT *, CASE WHEN coalesce(us - lag(us) {W} > 21600000000, true) THEN 1 ELSE 0 END AS new FROM e), s AS (SELECT *, sum(new) {W} AS session FROM n),
p AS (SELECT *, floor((us - min(us) OVER (PARTITION BY user_id, session)) / 86400000000)::BIGINT AS part FROM s)
SELECT user_id, session::BIGINT AS session, part, min(us) AS start, max(us) AS "end", count(*) AS n FROM p GROUP BY ALL""",
    "send_gaps": f"WITH {E}, g AS (SELECT user_id, floor(us / 86400000000)::BIGINT AS day, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e) SELECT user_id, day, max(gap) AS max_gap FROM g GROUP BY 1, 2",
    "battery_classes": """WITH b AS (SELECT event_id, value AS p, event_type = 'view' AS c, event_id % 7 <> 0 AND value BETWEEN 0 AND 100 AS ok FROM events)
SELECT event_id, CASE WHEN NOT ok THEN 'unknown' WHEN c THEN 'charging' WHEN p <= 20 THEN 'low' ELSE 'normal' END AS level, CASE WHEN ok THEN floor(p + 0.5)::BIGINT::VARCHAR || '%' ELSE '--' END AS label,
NOT (p < 10 AND NOT c) AS arm, NOT (p < 10 AND NOT c) AND NOT c AS chassis FROM b""",
    "debounce_runs": f"""WITH {E}, i AS (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) {W} AS g FROM e), r AS (SELECT event_id, user_id, value, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY us, event_id) AS n FROM i)
SELECT event_id, user_id FROM r WHERE value > 20 AND n = 3""",
    "run_lengths": f"""WITH {E}, i AS (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) {W} AS g FROM e)
SELECT event_id, CASE WHEN value > 20 THEN sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY us, event_id) ELSE 0 END::BIGINT AS run_length FROM i""",
    "tick_gaps": f"""WITH {E}, t AS (SELECT event_id, user_id, us, greatest(0, floor((us / 1e6 - min(us) OVER (PARTITION BY user_id) / 1e6) * (1.0::DOUBLE / 1800) + 1e-7))::BIGINT AS tick FROM e)
SELECT event_id, tick, greatest(0, coalesce(tick - lag(tick) {W} - 1, 0))::BIGINT AS missed FROM t""",
    "next_ticks": f"WITH {E}, b AS (SELECT event_id, us, lag(us) {W} AS p FROM e) SELECT event_id, (p + (floor((us - p) / 600000000) + 1) * 600000000)::BIGINT AS next_us FROM b WHERE p IS NOT NULL",
    "rolling_delay": f"WITH {E} SELECT event_id, greatest(6, max(floor(value)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 19 PRECEDING) + 1)::BIGINT AS delay FROM e",
    "handoffs": """WITH v AS (SELECT event_id, floor(value)::BIGINT AS s, event_id % 9 AS d, event_id % 97 - floor(value)::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN k BETWEEN 0 AND 49 THEN k END AS k, s > 0 AND s < 50 AND d >= 0 AND d <= s AND s <= 50 - d AND s + d + 2 <= 50 AS fits FROM v""",
    "reset_peaks": f"WITH {E}, s AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) {W} AS g FROM e) SELECT event_id, max(value) OVER (PARTITION BY user_id, g ORDER BY us, event_id) AS peak FROM s",
    "wait_intervals": f"""WITH {E}, d AS (SELECT *, floor(us / 86400000000)::BIGINT AS day FROM e), q AS (SELECT * FROM d WHERE event_type = 'click'), v AS (SELECT * FROM d WHERE event_type = 'view'), l AS (SELECT user_id, max(us) AS m FROM d WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT q.user_id, q.day, q.us AS start, coalesce((SELECT min(v.us) FROM v WHERE v.user_id = q.user_id AND v.day = q.day AND v.us >= q.us), m) AS "end", (SELECT min(v.us) FROM v WHERE v.user_id = q.user_id AND v.day = q.day AND v.us >= q.us) IS NOT NULL AS answered FROM q JOIN l USING (user_id)""",
    "asof_values": f"WITH {E}, q AS (SELECT * FROM e WHERE event_type = 'click'), v AS (SELECT * FROM e WHERE event_type = 'view') SELECT q.event_id, v.value FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.us >= v.us",
    "nearest_values": f"""WITH {E}, q AS (SELECT * FROM e WHERE event_type = 'click'), v AS (SELECT * FROM e WHERE event_type = 'view'),
b AS (SELECT q.event_id, q.us - v.us AS d, v.event_id AS n FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.us >= v.us), a AS (SELECT q.event_id, v.us - q.us AS d, v.event_id AS n FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.us <= v.us)
SELECT event_id, CASE WHEN b.d IS NOT NULL AND b.d <= coalesce(a.d, b.d) AND b.d <= 36000000000 THEN b.n WHEN a.d <= 36000000000 THEN a.n END AS near_id FROM b JOIN a USING (event_id)""",
    "observations": f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT * FROM e WHERE event_type = 'click'), v AS (SELECT * FROM e WHERE event_type = 'view'),
x AS (SELECT p.event_id, p.user_id, p.us, c.us AS cu FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us), y AS (SELECT x.event_id, x.us, cu, v.us AS vu FROM x ASOF LEFT JOIN v ON x.user_id = v.user_id AND x.us >= v.us)
SELECT event_id, round(cu / 1e6, 3) AS click_t, round(vu / 1e6, 3) AS view_t, round(greatest(us / 1e6 - cu / 1e6, us / 1e6 - vu / 1e6) * 1000, 0) AS max_age_ms FROM y""",
    "missing_expected": "WITH x AS (SELECT * FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events)) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = x.user_id AND f.event_type = x.event_type AND f.value > 60)",
    "stale_replies": f"WITH {E}, w AS (SELECT *, floor(us / 604800000000)::BIGINT AS epoch FROM e) SELECT event_id FROM w WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM w p WHERE p.event_type = 'purchase' AND p.user_id = w.user_id AND p.epoch = w.epoch)",
    "event_age": f"WITH {E} SELECT event_id, round(greatest(0, max(us) OVER (PARTITION BY user_id) / 1e6 - us / 1e6) * 1000, 1) AS age_ms FROM e",
}
