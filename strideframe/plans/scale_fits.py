"""Queries over scale fits."""

from pyspark.sql import functions as F

from ..operators import scale
from .registry import query
from .scalars import HEIGHT, WIDTH

FRAME = ["recording", "frame"]
CELL_SQL = "least(prow * 6 // 48, 5) * 8 + least(pcol * 8 // 64, 7)"


@query("median_ratio", """
    SELECT recording, frame, count(*) AS pairs, CASE WHEN count(*) >= 50 THEN quantile_cont(target / learned, 0.5) END AS scale FROM pixels GROUP BY recording, frame""", doubles="scale")
def median_ratio(t):
    """AGG-01: median target / learned ratio per frame with its gate."""
    return scale.median_ratio(t.pixels, FRAME, 50)


@query("weighted_median", """
    WITH r AS (SELECT recording, learned, sum(quantity) AS w FROM pixels GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY recording ORDER BY learned) AS upto, sum(w) OVER (PARTITION BY recording) AS total FROM r)
    SELECT recording, min(learned) FILTER (WHERE upto >= total / 2) AS weighted_median FROM c GROUP BY recording""", doubles="weighted_median")
def weighted_median(t):
    """AGG-02: first sorted value that reaches half of the weight."""
    return scale.weighted_median(t.pixels, ["recording"], "learned", "quantity")


@query("grid_scale", f"""
    WITH l AS (SELECT *, {CELL_SQL} AS cell, ln(target / learned) AS lr FROM pixels),
    f AS (SELECT recording, frame, quantile_cont(lr, 0.5) AS fm FROM l GROUP BY ALL HAVING count(*) >= 50),
    c AS (SELECT recording, frame, cell, quantile_cont(lr, 0.5) AS cm FROM l GROUP BY ALL HAVING count(*) >= 6),
    g AS (SELECT f.recording, f.frame, i.cell, coalesce(c.cm, f.fm) AS v FROM f CROSS JOIN range(0, 48) i(cell) LEFT JOIN c ON c.recording = f.recording AND c.frame = f.frame AND c.cell = i.cell),
    gl AS (SELECT recording, frame, list(v ORDER BY cell) AS v FROM g GROUP BY ALL),
    p AS (SELECT recording, frame, sample, least(greatest((pcol + 5e-1) * 8 / 64 - 5e-1, 0), 7) AS ax, least(greatest((prow + 5e-1) * 6 / 48 - 5e-1, 0), 5) AS ay FROM pixels),
    q AS (SELECT *, CAST(floor(ax) AS BIGINT) AS x0, CAST(floor(ay) AS BIGINT) AS y0, ax - floor(ax) AS wx, ay - floor(ay) AS wy FROM p)
    SELECT q.recording, q.frame, q.sample, exp((1 - wy) * ((1 - wx) * v[y0 * 8 + x0 + 1] + wx * v[y0 * 8 + least(x0 + 1, 7) + 1])
           + wy * ((1 - wx) * v[least(y0 + 1, 5) * 8 + x0 + 1] + wx * v[least(y0 + 1, 5) * 8 + least(x0 + 1, 7) + 1])) AS scale
    FROM q JOIN gl ON gl.recording = q.recording AND gl.frame = q.frame""", doubles="scale")
def grid_scale(t):
    """AGG-03: per-pixel scale blended between cell medians."""
    rows = scale.grid_scale(t.spread(t.pixels), HEIGHT, WIDTH, minimum=50, min_cell=6)
    return rows.select("recording", "frame", "sample", "scale")


@query("power_fit", """
    WITH p AS (SELECT recording, frame, sample, ln(learned) AS x, ln(target) - ln(learned) AS y, quantity AS w,
                      row_number() OVER (PARTITION BY recording, frame ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY recording, frame) AS n FROM pixels),
    s AS (SELECT * FROM p WHERE i % greatest(CAST(ceil(n / 300) AS BIGINT), 1) = 0),
    t AS (SELECT a.recording, a.frame, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM s a JOIN s b ON a.recording = b.recording AND a.frame = b.frame AND b.x > a.x GROUP BY ALL),
    m AS (SELECT recording, frame, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM s GROUP BY ALL),
    r AS (SELECT p.*, p.y - (my - slope * mx + slope * p.x) AS r FROM p JOIN t USING (recording, frame) JOIN m USING (recording, frame) WHERE n >= 20),
    c AS (SELECT recording, frame, quantile_cont(r, 0.5) AS mid FROM r GROUP BY ALL),
    d AS (SELECT r.*, abs(r - mid) AS spread FROM r JOIN c USING (recording, frame)),
    k AS (SELECT recording, frame, quantile_cont(spread, 0.5) AS reach FROM d GROUP BY ALL),
    i AS (SELECT d.* FROM d JOIN k USING (recording, frame) WHERE spread <= 3 * 14826e-4 * reach + 1e-12),
    z AS (SELECT recording, frame, count(*) AS inliers, min(x) AS low, max(x) AS high, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * x * x) / sum(w) AS xx, sum(w * x * y) / sum(w) AS xy FROM i GROUP BY ALL),
    f AS (SELECT *, CASE WHEN high - low >= ln(15e-1) THEN least(greatest((xy - cx * cy) / (xx - cx * cx), -5e-1), 5e-1) ELSE 0e0 END AS slope FROM z)
    SELECT recording, frame, inliers, slope, cy - slope * cx AS level, low, high FROM f""", doubles="slope level low high")
def power_fit(t):
    """AGG-04: robust log-log line per frame."""
    fits = scale.power_fit(t.spread(t.pixels), "sample", F.floor(F.col("sample") / 8_000_000_000_000), weight="quantity")
    return fits.drop("targets")


@query("ls_align", """
    WITH p AS (SELECT recording, frame, learned AS l, target AS t FROM pixels),
    a AS (SELECT recording, frame, regr_slope(t, l) AS fa, regr_intercept(t, l) AS sh FROM p GROUP BY ALL),
    r AS (SELECT recording, frame, abs(fa * l + sh - t) AS r, l, t FROM p JOIN a USING (recording, frame)),
    q AS (SELECT recording, frame, quantile_cont(r, 0.9) AS q FROM r GROUP BY ALL),
    k AS (SELECT r.* FROM r JOIN q USING (recording, frame) WHERE r.r <= q.q * (1 + 1e-12))
    SELECT recording, frame, 'metric' AS fit, regr_slope(t, l) AS factor, regr_intercept(t, l) AS shift FROM p GROUP BY ALL
    UNION ALL SELECT recording, frame, 'inverse', regr_slope(1 / t, l), regr_intercept(1 / t, l) FROM p GROUP BY ALL
    UNION ALL SELECT recording, frame, 'log', regr_slope(ln(t), l), regr_intercept(ln(t), l) FROM p GROUP BY ALL
    UNION ALL SELECT recording, frame, 'size_only', sum(l * t) / sum(l * l), 0e0 FROM p GROUP BY ALL
    UNION ALL SELECT recording, frame, 'trimmed', regr_slope(t, l), regr_intercept(t, l) FROM k GROUP BY ALL""", doubles="factor shift")
def ls_align(t):
    """AGG-05: least-squares alignment in metric, inverse and log space, size only, and trimmed."""
    fits = {name: scale.native_fit(t.pixels, FRAME, name) for name in ("metric", "inverse", "log")}
    fits["size_only"] = scale.native_fit(t.pixels, FRAME, "metric", through_zero=True)
    fits["trimmed"] = scale.trimmed_fit(t.pixels, FRAME)
    out = None
    for name, rows in fits.items():
        rows = rows.select(*FRAME, F.lit(name).alias("fit"), "factor", "shift")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("inverse_variance", """
    SELECT recording, frame, prow AS feature, sum(target / (quantity / 1e2) ** 2) / sum(1 / (quantity / 1e2) ** 2) AS depth_m, 1 / sqrt(sum(1 / (quantity / 1e2) ** 2)) AS sigma_m, count(*) AS measures
    FROM pixels GROUP BY recording, frame, prow""", doubles="depth_m sigma_m")
def inverse_variance(t):
    """AGG-06: one depth per feature from every keyframe's measure."""
    rows = t.pixels.select("recording", "frame", F.col("prow").alias("feature"), "target", (F.col("quantity") / 100).alias("sigma"))
    return scale.inverse_variance(rows, [*FRAME, "feature"], "target", "sigma")


@query("fallback_scale", f"""
    WITH m AS (SELECT recording, frame, {CELL_SQL} AS cell FROM pixels WHERE half = 'O' GROUP BY ALL HAVING count(*) >= 4),
    k AS (SELECT recording, frame, CASE WHEN sample % 2 = 0 THEN 'fit' ELSE 'held_out' END AS split, {CELL_SQL} AS cell, ln(target / learned) AS lr FROM pixels WHERE half = 'F')
    SELECT recording, frame, split, count(*) AS points, quantile_cont(lr, 0.5) AS log_scale FROM k ANTI JOIN m USING (recording, frame, cell) GROUP BY ALL HAVING count(*) >= 5""", doubles="log_scale")
def fallback_scale(t):
    """AGG-53: size from tracked points where measured depth has no support, for both halves of the id split."""
    tracked = t.pixels.where("half = 'F'").withColumn("split", F.when(F.col("sample") % 2 == 0, "fit").otherwise("held_out"))
    return scale.fallback_scale(
        tracked, t.pixels.where("half = 'O'"), HEIGHT, WIDTH, minimum=5, min_cell=4, keys=[*FRAME, "split"]
    )


@query("anchored_scale", """
    WITH s AS (SELECT recording, seq, 1 + (cents % 100) / 1e3 AS metric, 1 + (cents % 37) / 1e2 AS consistent, status = 'P' AS interpolated FROM frames),
    a AS (SELECT recording, quantile_cont(metric / consistent, 0.5) AS anchor FROM s WHERE NOT interpolated GROUP BY recording)
    SELECT recording, seq, anchor, consistent * anchor AS scale FROM s LEFT JOIN a USING (recording)""", doubles="anchor scale")
def anchored_scale(t):
    """AGG-54: consistent scales anchored by the run's median metric ratio."""
    rows = t.frames.select(
        "recording", "seq", (1 + (F.col("cents") % 100) / 1e3).alias("metric"), (1 + (F.col("cents") % 37) / 1e2).alias("consistent"),
        (F.col("status") == "P").alias("interpolated"),
    )
    return scale.anchored_scale(rows, ["recording"]).select("recording", "seq", "anchor", "scale")
