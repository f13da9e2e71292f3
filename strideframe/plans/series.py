"""Queries over streams, noise, clocks and timing."""

from pyspark.sql import functions as F

from ..functions.lcg import mixed_sql
from ..operators import series
from ..operators.ordered import HOUR_NS, carried
from ..operators.timejoin import time_chunk
from .registry import query

DAY_NS = 24 * HOUR_NS


@query("stream_stats", """
    WITH g AS (SELECT recording, sensor, t_ns - lag(t_ns) OVER (PARTITION BY recording, sensor ORDER BY t_ns, event_id) AS gap FROM stamps),
    m AS (SELECT recording, sensor, quantile_cont(gap, 0.5) AS med FROM g WHERE gap IS NOT NULL GROUP BY ALL)
    SELECT recording, sensor, count(*) + 1 AS samples, 1e9 / avg(gap) AS rate_hz, any_value(med) / 1e6 AS median_interval_ms, max(gap) / 1e6 AS max_interval_ms, count(*) FILTER (WHERE gap > 15e-1 * med) AS gaps_over_1_5x
    FROM g JOIN m USING (recording, sensor) WHERE gap IS NOT NULL GROUP BY recording, sensor""", doubles="rate_hz median_interval_ms max_interval_ms")
def stream_stats(t):
    """AGG-21: samples, rate, median and longest interval, and gaps of each sensor stream."""
    return series.stream_stats(t.stamps, ["recording", "sensor"], ties=["event_id"], chunk_ns=DAY_NS)


def numbered(t, columns, where="true"):
    """Events of each recording numbered from 0 in time order."""
    rows = carried(
        t.stamps.where(where), ["recording"], ["t_ns", "event_id"], time_chunk("t_ns", DAY_NS), running={"i": F.lit(1).cast("long")}
    )
    return rows.select("recording", (F.col("i") - 1).alias("i"), *columns)


@query("allan_deviation", """
    WITH v AS (SELECT recording, value, row_number() OVER (PARTITION BY recording ORDER BY t_ns, event_id) AS i FROM stamps),
    a AS (SELECT recording, i, sum(value) OVER (PARTITION BY recording ORDER BY i) * 5e-3 AS a FROM v UNION ALL SELECT DISTINCT recording, 0, 0e0 FROM v),
    n AS (SELECT recording, count(*) AS n FROM v GROUP BY recording),
    m AS (SELECT DISTINCT recording, CAST(floor(pow(10e0, p / 59e0 * log10(greatest(n // 10, 1))) + 1e-9) AS BIGINT) AS m FROM n, range(0, 60) r(p))
    SELECT a.recording, m.m * 5e-3 AS tau_s, sqrt(sum((c.a - 2 * b.a + a.a)**2) / (2 * (m.m * 5e-3)**2 * count(*))) AS deviation
    FROM a JOIN m ON m.recording = a.recording JOIN a b ON b.recording = a.recording AND b.i = a.i + m.m JOIN a c ON c.recording = a.recording AND c.i = a.i + 2 * m.m GROUP BY a.recording, m.m""", doubles="tau_s deviation")
def allan_deviation(t):
    """AGG-36: overlapping Allan deviation at log-spaced cluster sizes."""
    return series.allan_deviation(numbered(t, ["value"]), ["recording"], "i", "value", dt=0.005)


@query("clock_offset", """
    WITH a AS (SELECT recording, t_ns, value FROM stamps WHERE sensor = 'click'), b AS (SELECT recording, t_ns, value FROM stamps WHERE sensor = 'view'),
    e AS (SELECT recording, greatest(min(a.t_ns), any_value(b0) + 360000000000000) AS f, least(max(a.t_ns), any_value(b1) - 360000000000000) AS t FROM a JOIN (SELECT recording, min(t_ns) AS b0, max(t_ns) AS b1 FROM b GROUP BY recording) USING (recording) GROUP BY recording),
    n AS (SELECT *, CAST(ceil((t - f) / 1800000000000) AS BIGINT) AS n FROM e WHERE ceil((t - f) / 1800000000000) >= 3),
    g AS (SELECT recording, unnest(range(-200, n + 200)) AS i, f, n FROM n), gt AS (SELECT recording, i, f + i * 1800000000000 AS t, n FROM g),
    pa AS (SELECT gt.*, a.t_ns AS t0, a.value AS v0 FROM gt ASOF LEFT JOIN a ON gt.recording = a.recording AND gt.t > a.t_ns),
    na AS (SELECT pa.*, a.t_ns AS t1, a.value AS v1 FROM pa ASOF LEFT JOIN a ON pa.recording = a.recording AND pa.t <= a.t_ns),
    ia AS (SELECT recording, i, CASE WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL OR t1 = t THEN v1 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END AS v FROM na WHERE i BETWEEN 0 AND n - 1),
    pb AS (SELECT gt.*, b.t_ns AS t0, b.value AS v0 FROM gt ASOF LEFT JOIN b ON gt.recording = b.recording AND gt.t > b.t_ns),
    nb AS (SELECT pb.*, b.t_ns AS t1, b.value AS v1 FROM pb ASOF LEFT JOIN b ON pb.recording = b.recording AND pb.t <= b.t_ns),
    ib AS (SELECT recording, i, CASE WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL OR t1 = t THEN v1 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END AS v FROM nb),
    s AS (SELECT ia.recording, ib.i - ia.i AS lag, corr(ia.v, ib.v) AS score FROM ia JOIN ib ON ib.recording = ia.recording AND ib.i - ia.i BETWEEN -200 AND 200 GROUP BY ia.recording, ib.i - ia.i),
    w AS (SELECT *, lag(score) OVER k AS sb, lead(score) OVER k AS sa FROM s WINDOW k AS (PARTITION BY recording ORDER BY lag)),
    p AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, lag) AS r FROM w)
    SELECT recording, (lag + coalesce(5e-1 * (sb - sa) / (CASE WHEN sb - 2 * score + sa <> 0 THEN sb - 2 * score + sa END), 0)) * 5e-1 AS offset_h, score AS peak FROM p WHERE r = 1""", doubles="offset_h peak")
def clock_offset(t):
    """AGG-37: clock offset by normalised cross-correlation with a parabolic peak (401 lags of half an hour)."""
    a = t.stamps.where("sensor = 'click'").select("recording", "t_ns", "value")
    c = t.stamps.where("sensor = 'view'").select("recording", "t_ns", "value")
    rows = series.clock_offset(a, c, ["recording"], "t_ns", "value", HOUR_NS // 2, 200, chunk_ns=DAY_NS)
    return rows.select("recording", (F.col("offset") / HOUR_NS).alias("offset_h"), "peak")


@query("centred_mean", """
    WITH v AS (SELECT recording, value, row_number() OVER (PARTITION BY recording ORDER BY t_ns, event_id) - 1 AS i FROM stamps)
    SELECT recording, i, sum(value) OVER (PARTITION BY recording ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS mean FROM v""", doubles="mean")
def centred_mean(t):
    """WIN-06: centred moving mean, zeros beyond the ends."""
    return series.centred_mean(numbered(t, ["value"]), ["recording"], "i", "value", 4).select("recording", "i", "mean")


@query("causal_median", """
    WITH s AS (SELECT recording, seq, quantile_cont(x, 0.5) OVER (PARTITION BY recording ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smoothed FROM frames),
    m AS (SELECT recording, quantile_cont(smoothed, 0.5) AS typical FROM s GROUP BY recording)
    SELECT recording, seq, smoothed, smoothed / typical AS relative FROM s JOIN m USING (recording)""", doubles="smoothed relative")
def causal_median(t):
    """WIN-05: median of the last values, relative to the run's median."""
    rows = series.causal_median(t.frames, ["recording"], "seq", "x", 5, chunk=64)
    return rows.select("recording", "seq", "smoothed", "relative")


@query("track_jitter", """
    WITH f AS (SELECT recording, seq, x - seq * 3e-2 AS a, y AS b FROM frames WHERE status <> 'P'),
    r AS (SELECT recording, seq, a - quantile_cont(a, 0.5) OVER w AS ra, b - quantile_cont(b, 0.5) OVER w AS rb FROM f WINDOW w AS (PARTITION BY recording ORDER BY seq RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    s AS (SELECT *, lag(seq) OVER w AS ps, a - lag(a) OVER w AS dx FROM f WINDOW w AS (PARTITION BY recording ORDER BY seq)),
    p AS (SELECT recording, seq, dx, lag(dx) OVER (PARTITION BY recording ORDER BY seq) AS d0 FROM s WHERE seq = ps + 1),
    w AS (SELECT recording, count(*) AS n, stddev_samp(ra) AS sx, stddev_samp(rb) AS sy, sqrt(var_pop(ra) + var_pop(rb)) AS radial_rms FROM r GROUP BY recording),
    q AS (SELECT recording, count(*) AS pairs, stddev_samp(dx) / sqrt(2e0) AS pair_sx, corr(d0, dx) AS lag1_x FROM p GROUP BY recording)
    SELECT recording, n, coalesce(pairs, 0) AS pairs, CASE WHEN n >= 5 THEN sx END AS sx, CASE WHEN n >= 5 THEN sy END AS sy, CASE WHEN n >= 5 THEN radial_rms END AS radial_rms,
           CASE WHEN pairs >= 4 THEN pair_sx END AS pair_sx, CASE WHEN pairs >= 4 THEN lag1_x END AS lag1_x FROM w LEFT JOIN q USING (recording)""", doubles="sx sy radial_rms pair_sx lag1_x")
def track_jitter(t):
    """AGG-38: residual spread against the local median and between consecutive frames."""
    rows = t.frames.where("status <> 'P'").select("recording", "seq", (F.col("x") - F.col("seq") * 3e-2).alias("a"), F.col("y").alias("b"))
    return series.track_jitter(rows, ["recording"], "seq", "a", "b", chunk=64)


@query("size_jitter", """
    WITH m AS (SELECT image, cls, quantile_cont(x2 - x1, 0.5) AS mid FROM boxes GROUP BY ALL)
    SELECT image, cls, stddev_samp((x2 - x1) / mid - 1) AS width_std FROM boxes JOIN m USING (image, cls) GROUP BY image, cls""", doubles="width_std")
def size_jitter(t):
    """AGG-38: spread of box widths relative to their median."""
    return series.relative_spread(t.boxes.withColumn("w", F.col("x2") - F.col("x1")), ["image", "cls"], "w", "width_std")


@query("noise_floor", """
    WITH e AS (SELECT quantile_cont(z, 0.3333333333333333) AS e1, quantile_cont(z, 0.6666666666666666) AS e2 FROM frames),
    r AS (SELECT (z >= e1)::INTEGER + (z >= e2)::INTEGER AS band, (x - seq * 3e-2)**3 AS a, y**3 AS b FROM frames, e),
    m AS (SELECT band, quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM r GROUP BY band),
    d AS (SELECT r.*, abs(a - ma) AS da, abs(b - mb) AS db FROM r JOIN m USING (band)), s AS (SELECT band, quantile_cont(da, 0.5) AS sa, quantile_cont(db, 0.5) AS sb FROM d GROUP BY band),
    k AS (SELECT d.*, NOT ((sa > 0 AND da > 5 * sa) OR (sb > 0 AND db > 5 * sb)) AS ok FROM d JOIN s USING (band))
    SELECT band, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS outliers, stddev_samp(a) FILTER (WHERE ok) / sqrt(2e0) AS sx, stddev_samp(b) FILTER (WHERE ok) / sqrt(2e0) AS sy FROM k GROUP BY band""", doubles="sx sy")
def noise_floor(t):
    """AGG-39: residual noise of inliers per tertile."""
    rows = t.frames.select("z", F.pow(F.col("x") - F.col("seq") * 3e-2, 3).alias("a"), F.pow("y", F.lit(3)).alias("b"))
    return series.noise_floor(series.tertile(rows, [], "z"), ["band"], "a", "b")


@query("stage_timing", """
    WITH s AS (SELECT t_ns // 3600000000000 AS run, sensor AS stage, CASE WHEN k <> 13 THEN k END AS frames, value AS e, sensor <> 'error' OR k % 2 = 0 AS ok FROM stamps)
    SELECT run, stage, count(*) AS attempts, count(*) FILTER (WHERE ok) AS successes, sum(e) FILTER (WHERE ok) AS elapsed_seconds,
           CASE WHEN count(*) FILTER (WHERE ok AND frames IS NULL) = 0 THEN CAST(sum(frames) FILTER (WHERE ok) AS DOUBLE) END AS frames_n,
           CASE WHEN count(*) FILTER (WHERE ok AND frames IS NULL) = 0 THEN sum(frames) FILTER (WHERE ok) / sum(e) FILTER (WHERE ok) END AS fps FROM s GROUP BY run, stage""", doubles="elapsed_seconds frames_n fps")
def stage_timing(t):
    """AGG-45: frames per second of each stage's successes, by hour."""
    rows = t.stamps.select(
        F.expr(f"t_ns div {HOUR_NS}").alias("run"), F.col("sensor").alias("stage"), F.when(F.col("k") != 13, F.col("k")).alias("frames"),
        F.col("value").alias("elapsed_seconds"), F.when((F.col("sensor") != "error") | (F.col("k") % 2 == 0), "ok").otherwise("failed").alias("status"),
    )
    return series.stage_timing(rows, ["run"]).withColumnRenamed("frames", "frames_n")


@query("update_pace", """
    WITH u AS (SELECT recording, (t_ns - lag(t_ns) OVER (PARTITION BY recording ORDER BY t_ns, event_id)) / 36e11 AS gap, sensor FROM stamps)
    SELECT recording, count(*) AS updates, count(gap) / sum(gap) AS updates_per_s, count(*) FILTER (WHERE gap > 1) AS gaps_over_1s, max(gap) AS longest_gap_s, count(*) FILTER (WHERE sensor = 'error') AS previous_scale FROM u GROUP BY recording""", doubles="updates_per_s longest_gap_s")
def update_pace(t):
    """AGG-45: update rate and gaps of a run (hours stand for seconds)."""
    # differences of whole nanoseconds keep full precision, so time counts from the recording's first stamp
    first = t.stamps.groupBy("recording").agg(F.min("t_ns").alias("t0"))
    exact = numbered(t, ["t_ns", F.when(F.col("sensor") == "error", "previous").otherwise("sparse").alias("source")]).join(first, "recording")
    rows = exact.withColumn("finished", (F.col("t_ns") - F.col("t0")) / 36e11)
    return series.update_pace(rows, ["recording"], "i", "finished", "stage_ms", "source")


@query("stage_medians", """
    WITH s AS (SELECT recording, sensor AS stage, value AS ms FROM stamps UNION ALL SELECT recording, 'total', value + k FROM stamps)
    SELECT recording, stage, count(*) AS updates, quantile_cont(ms, 0.5) AS median_ms FROM s GROUP BY recording, stage""", doubles="median_ms")
def stage_medians(t):
    """AGG-45: median milliseconds per stage from one map of times per update."""
    rows = t.stamps.select("recording", F.create_map(F.col("sensor"), F.col("value"), F.lit("total"), F.col("value") + F.col("k")).alias("stage_ms"))
    return series.stage_medians(rows, ["recording"], "stage_ms")


@query("session_summary", """
    WITH f AS (SELECT recording, count(*) AS frames_n, count(*) FILTER (WHERE status <> 'P') AS with_tracker, count(*) FILTER (WHERE status = 'F') AS tracking, max(seq) + 1 - count(DISTINCT seq) AS missing, min(t_ns) AS t0, max(t_ns) AS t1, sum(cents) AS bytes FROM frames GROUP BY recording),
    h AS (SELECT recording, count(*) AS connections, arg_max(cents % 1000, seq) AS offset_ms FROM frames WHERE priority = '1-URGENT' GROUP BY recording)
    SELECT recording, frames_n, with_tracker, tracking, missing, coalesce(connections, 0) AS connections, bytes / 1e6 AS megabytes, CASE WHEN t1 > t0 THEN bytes / 1e6 / ((t1 - t0) / 1e9) ELSE 0 END AS megabytes_per_second, offset_ms,
           CASE WHEN recording % 3 > 0 THEN (t1 - (t0 + 4000000000)) / 1e9 END AS after_stop_s FROM f LEFT JOIN h USING (recording)""", doubles="megabytes megabytes_per_second offset_ms after_stop_s")
def session_summary(t):
    """AGG-44: what a session stored: frames, bytes, rate, connections and sending after the stop."""
    from ..operators.reports import session_summary as summarise

    f = t.frames
    frames = f.select("recording", "seq", "t_ns", (F.col("status") != "P").alias("has_tracker"), (F.col("status") == "F").alias("tracking"), F.col("cents").alias("bytes"))
    hellos = f.where("priority = '1-URGENT'").select("recording", "seq", (F.col("cents") % 1000).alias("offset_ms"))
    stops = f.where("recording % 3 > 0").groupBy("recording").agg((F.min("t_ns") + 4_000_000_000).alias("stop_ns"))
    return summarise(frames, hellos, stops)


@query("repeat_table", """
    WITH r AS (SELECT p_brand AS setting, p_size, p_retailprice FROM part WHERE p_type <> 'ECONOMY'), m AS (SELECT setting, 'size' AS measure, CAST(p_size AS DOUBLE) AS v FROM r UNION ALL SELECT setting, 'price', p_retailprice FROM r)
    SELECT setting, measure, count(*) AS runs, quantile_cont(v, 0.5) AS median, min(v) AS low, max(v) AS high FROM m GROUP BY setting, measure""", doubles="median low high")
def repeat_table(t):
    """AGG-46: median, least and greatest value per setting over complete runs."""
    rows = t.part.select(F.col("p_brand").alias("setting"), "p_type", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return series.repeat_table(rows, ["setting"], ["size", "price"], F.col("p_type") != "ECONOMY")


@query("sampled_size", f"""
    WITH s AS (SELECT recording, s AS seed, target / learned AS ratio, row_number() OVER (PARTITION BY recording, s ORDER BY {mixed_sql('frame * 1000003 + sample', 's')}, frame, sample) AS k FROM pixels, range(1, 6) z(s)),
    d AS (SELECT recording, seed, quantile_cont(ratio, 0.5) AS v FROM s WHERE k <= 20 GROUP BY recording, seed)
    SELECT recording, quantile_cont(v, 0.5) AS size, min(v) AS low, max(v) AS high FROM d GROUP BY recording""", doubles="size low high")
def sampled_size(t):
    """AGG-47: run size from seeded draws of readings."""
    rows = t.pixels.select(
        "recording", (F.col("frame") * 1_000_003 + F.col("sample")).alias("key"), (F.col("target") / F.col("learned")).alias("ratio")
    )
    return series.sampled_size(rows, ["recording"], "key", "ratio", 20, [1, 2, 3, 4, 5])


@query("framed_size", """
    WITH f AS (SELECT recording, frame, quantile_cont(target / learned, 0.5) AS v FROM pixels GROUP BY ALL)
    SELECT recording, count(*) AS frames_n, quantile_cont(v, 0.5) AS frame_size, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM f GROUP BY recording""", doubles="frame_size p10 p90")
def framed_size(t):
    """AGG-47: median over frames of per-frame medians with its 10-90 percent spread."""
    rows = t.pixels.withColumn("ratio", F.col("target") / F.col("learned"))
    return series.framed_size(rows, ["recording"], ["frame"], "ratio").withColumnRenamed("frames", "frames_n")


@query("seeded_sample", f"""
    WITH s AS (SELECT recording, frame, sample, s AS seed, row_number() OVER (PARTITION BY recording, frame, s ORDER BY {mixed_sql('sample', 's')}, sample) AS k FROM pixels, (VALUES (3), (4)) z(s) WHERE learned > 1)
    SELECT recording, frame, sample, CAST(seed AS INTEGER) AS seed FROM s WHERE k <= 10""")
def seeded_sample(t):
    """TOP-02: seeded choice without replacement of fit pixels per frame."""
    rows = t.pixels.where("learned > 1").select("recording", "frame", "sample")
    return series.seeded_choice(rows, ["recording", "frame"], "sample", 10, [3, 4]).select("recording", "frame", "sample", "seed")
