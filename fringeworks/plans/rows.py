"""Queries over visibility rows: selection, maps, summaries, joins, ordered operators, set operations."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.complexcols import Cx
from ..functions.scalar import rnd
from ..operators import aggregates as A
from ..operators import calibrate as K
from ..operators import gridding as G
from ..operators import joins as J
from ..operators import ordered as O  # noqa: E741
from ..operators import select as P
from ..sources.driver_tables import ctes, table
from .registry import query, r

W_MAX, N_PLANES = 100.0, 33
C = S.C_LIGHT


def nint_sql(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) + 0.5))"


@query("split_filter_avg", ctes("vis") + f""", s AS (SELECT *, CAST(floor((chan - 2) / 4.0) AS INTEGER) AS out_chan FROM vis
 WHERE scan IN (0, 1, 2, 3, 4, 5) AND feed1 IN (0, 1, 2) AND feed2 IN (0, 1, 2) AND time_s >= 64100000000 AND chan BETWEEN 2 AND 13)
SELECT scan, antenna1, pol, out_chan, count(*) FILTER (NOT flag) AS n_good, {r("avg(re) FILTER (NOT flag)")} AS re, {r("avg(im) FILTER (NOT flag)")} AS im,
 {r("sqrt(sum(sigma * sigma) FILTER (NOT flag)) / nullif(count(*) FILTER (NOT flag), 0)")} AS sigma, count(*) FILTER (NOT flag) = 0 AS flag
FROM s GROUP BY scan, antenna1, pol, out_chan""")
def split_filter_avg(spark, sf):
    rows = P.split_rows(table(spark, sf, "vis"), begin=64100000000, scans=range(6), beams=(0, 1, 2))
    out = P.channel_average(P.channel_range(rows, 3, 14, 4, 16), ["scan", "antenna1", "pol", "out_chan"])
    return out.withColumns({c: rnd(c) for c in ("re", "im", "sigma")})


@query("time_window_split", ctes("vis") + " SELECT scan, field_id, count(*) AS n_rows, min(time_s) AS first_s, max(time_s) AS last_s FROM vis WHERE time_s BETWEEN 64120000000 AND 64160000000 AND field_id IN (1, 2, 3, 5, 8) GROUP BY scan, field_id")
def time_window_split(spark, sf):
    rows = P.split_rows(table(spark, sf, "vis"), begin=64120000000, end=64160000000, fields=(1, 2, 3, 5, 8))
    return rows.groupBy("scan", "field_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"))


@query("field_filter", ctes("vis") + " SELECT v.field_id, count(*) AS n_rows, count(*) FILTER (flag) AS n_flagged FROM vis v JOIN nation n ON n.n_nationkey = v.field_id WHERE n.n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (3, 7, 11)) GROUP BY v.field_id")
def field_filter(spark, sf):
    nation = table(spark, sf, "nation")
    names = [x.n_name for x in nation.where(F.col("n_nationkey").isin(3, 7, 11)).select("n_name").collect()]
    rows = P.named_fields(table(spark, sf, "vis"), nation.select(F.col("n_nationkey").alias("field_id"), F.col("n_name").alias("name")), names)
    return rows.groupBy("field_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("flag").alias("n_flagged"))


@query("cross_corr_only", ctes("vis") + " SELECT antenna1, antenna2, count(*) AS n_rows FROM vis WHERE antenna1 <> antenna2 GROUP BY antenna1, antenna2")
def cross_corr_only(spark, sf):
    return P.cross_correlations(table(spark, sf, "vis")).groupBy("antenna1", "antenna2").agg(F.count(F.lit(1)).alias("n_rows"))


@query("feed_channel_select", ctes("vis") + " SELECT scan, chan, count(*) AS n_rows FROM vis WHERE feed1 = 2 AND feed2 = 2 AND chan >= 4 AND chan < 9 AND scan = 7 GROUP BY scan, chan")
def feed_channel_select(spark, sf):
    rows = P.split_rows(table(spark, sf, "vis"), scans=(7,), beams=(2,)).where(F.col("chan").between(4, 8))
    return rows.groupBy("scan", "chan").agg(F.count(F.lit(1)).alias("n_rows"))


_K = nint_sql("(freq - 1.102e9) / 2e6")


@query("freq_map", ctes("vis") + f" SELECT freq, CAST(CASE WHEN {_K} >= 0 AND {_K} < 6 THEN {_K} ELSE -1 END AS INTEGER) AS image_chan, CAST(0 AS INTEGER) AS one_chan, count(*) AS n_rows FROM vis GROUP BY freq")
def freq_map(spark, sf):
    rows = table(spark, sf, "vis").groupBy("freq").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("freq", S.frequency_channel("freq", 1.102e9, 2e6, 6).alias("image_chan"), S.frequency_channel("freq", 1.1e9, 1e6, 1).alias("one_chan"), "n_rows")


_PLANE = f"({nint_sql('w / 5.0')} + 16)"


@query("w_plane_linear", ctes("vis") + f" SELECT CAST(CASE WHEN {_PLANE} >= 0 AND {_PLANE} < 33 THEN {_PLANE} ELSE -1 END AS INTEGER) AS plane, count(*) AS n_rows, min(w) AS min_w, max(w) AS max_w FROM vis GROUP BY 1")
def w_plane_linear(spark, sf):
    """Also the usage count of planes."""
    return table(spark, sf, "vis").groupBy(P.w_plane("w", 5.0, N_PLANES, clip=True).alias("plane")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("w").alias("min_w"), F.max("w").alias("max_w"))


@query("w_plane_power", ctes("vis") + f" SELECT DISTINCT w, {r('sign(w) * pow(abs(w / 100), 0.5)')} AS plane, {r('sign(w) * pow(abs(w / 100), 2.0)')} AS back FROM vis")
def w_plane_power(spark, sf):
    x = F.col("w") / W_MAX
    return table(spark, sf, "vis").select("w").distinct().select("w", rnd(S.w_power(x, 0.5)).alias("plane"), rnd(S.w_power(x, 2.0)).alias("back"))


_GA, _GS = S.w_gaussian_parameters(0.4)


@query("w_plane_gaussian", ctes("vis") + f" SELECT DISTINCT w, {r(f'sign(w) * {_GA!r} * (1 - exp(-(w / 100) * (w / 100) / {_GS!r}))')} AS term, {r(f'CASE WHEN abs(w) = 100 THEN w / 100 ELSE sign(w) * sqrt(-ln(1 - abs(w / 100) / {_GA!r}) * {_GS!r}) END')} AS plane FROM vis")
def w_plane_gaussian(spark, sf):
    x = F.col("w") / W_MAX
    return table(spark, sf, "vis").select("w").distinct().select("w", rnd(S.w_gaussian(x, _GA, _GS)).alias("term"), rnd(S.w_gaussian_inverse(x, _GA, _GS)).alias("plane"))


_SU, _SV = f"(freq * u / ({C!r} * 30.0))", f"(freq * v / ({C!r} * 30.0))"


def cell_sql(s: str, oversample: int, half: int) -> tuple[str, str]:
    """(cell, fraction) of a scaled coordinate."""
    i = nint_sql(s)
    f = nint_sql(f"({oversample} * ({i} - {s}))")
    turn = f"(CASE WHEN {f} < 0 THEN 1 WHEN {f} >= {oversample} THEN -1 ELSE 0 END)"
    return f"CAST({i} + {turn} + {half} AS INTEGER)", f"CAST({f} + {turn} * {oversample} AS INTEGER)"


@query("uv_cell_index", ctes("vis") + f", c AS (SELECT {cell_sql(_SU, 8, 128)[0]} AS iu, {cell_sql(_SU, 8, 128)[1]} AS fracu, {cell_sql(_SV, 8, 128)[0]} AS iv, {cell_sql(_SV, 8, 128)[1]} AS fracv FROM vis) SELECT iu, iv, fracu, fracv, iu - 3 > 0 AND iu + 3 < 256 AND iv - 3 > 0 AND iv + 3 < 256 AS inside, count(*) AS n_rows FROM c GROUP BY iu, iv, fracu, fracv")
def uv_cell_index(spark, sf):
    rows = P.with_uv_cells(table(spark, sf, "vis").select("u", "v", "freq"), 30.0, 8, 256)
    return rows.groupBy("iu", "iv", "fracu", "fracv").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("inside", P.on_grid("iu", "iv", 3, 256, 256))


@query("taylor_weights", ctes("vis") + f" SELECT chan, {r('sum(1.0 / (sigma * sigma))', 4)} AS t0, {r('sum((freq - 1.1e9) / 1.1e9 / (sigma * sigma))', 4)} AS t1, {r('sum(pow((freq - 1.1e9) / 1.1e9, 2.0) / (sigma * sigma))')} AS t2 FROM vis WHERE NOT flag GROUP BY chan")
def taylor_weights(spark, sf):
    wt = P.noise_weight("sigma")
    return table(spark, sf, "vis").where("NOT flag").groupBy("chan").agg(*[rnd(F.sum(P.taylor_weight("freq", 1.1e9, k) * wt), 4 if k < 2 else 6).alias(f"t{k}") for k in range(3)])


@query("cross_pol_effect", ctes("ts", "vis_pol") + f" SELECT pol, {r('sum(CASE WHEN pol IN (1, 2) THEN re ELSE 0 END)', 3)} AS re, {r('sum(CASE WHEN pol IN (1, 2) THEN im ELSE 0 END)', 3)} AS im FROM vis_pol GROUP BY pol")
def cross_pol_effect(spark, sf):
    return table(spark, sf, "vis_pol").groupBy("pol").agg(*[rnd(F.sum(P.keep_cross_polarisations(c)), 3).alias(c) for c in ("re", "im")])


@query("pol_all_good", ctes("ts", "vis_pol") + " SELECT beam, pol, count(*) AS n_rows, count(*) FILTER (good) AS n_good FROM (SELECT *, NOT max(flag) OVER (PARTITION BY row_id) AS good FROM vis_pol) GROUP BY beam, pol")
def pol_all_good(spark, sf):
    rows = P.all_polarisations_good(table(spark, sf, "vis_pol"), ["row_id"])
    return rows.groupBy("beam", "pol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("all_good").alias("n_good"))


_LON, _LAT = "(field_id * 0.01)", "(field_id * 0.02 - 0.3)"
_HAV = f"2 * asin(sqrt(least(pow(sin(({_LAT} + 0.1) / 2), 2) + cos({_LAT}) * cos(-0.1) * pow(sin(({_LON} - 0.1) / 2), 2), 1.0)))"


@query("pointing_separation", ctes("vis") + f" SELECT field_id, {r(_HAV)} AS separation, count(*) AS n_rows FROM vis WHERE {_HAV} <= 0.15 GROUP BY field_id")
def pointing_separation(spark, sf):
    rows = table(spark, sf, "vis").withColumns({"lon": F.col("field_id") * 0.01, "lat": F.col("field_id") * 0.02 - 0.3})
    near = P.near_pointing(rows, "lon", "lat", (0.1, -0.1), 0.15)
    return near.groupBy("field_id", "lon", "lat").agg(F.count(F.lit(1)).alias("n_rows")).select("field_id", rnd(S.separation("lon", "lat", F.lit(0.1), F.lit(-0.1))).alias("separation"), "n_rows")


_STATS = "SELECT count(*) AS n_vis, max(abs(u)) AS max_u, max(abs(v)) AS max_v, max(abs(w)) AS max_w, min(freq) AS min_freq, max(freq) AS max_freq, max(greatest(antenna1, antenna2)) + 1 AS n_antennas, max(greatest(feed1, feed2)) + 1 AS n_beams FROM vis WHERE NOT flag"


@query("vis_stats", ctes("vis") + " " + _STATS)
def vis_stats(spark, sf):
    return A.summary(table(spark, sf, "vis"))


@query("vis_stats_merged", ctes("vis") + " " + _STATS)
def vis_stats_merged(spark, sf):
    """Summaries of parts, merged, equal the summary of all."""
    vis = table(spark, sf, "vis")
    parts = [A.summary(vis.where(F.col("scan") % 3 == k)) for k in range(3)]
    return A.merged_summaries(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("imaging_advice", ctes("vis") + f", s AS ({_STATS}) SELECT {r('degrees(1.0 / (6 * greatest(max_u, max_v))) * 3600')} AS cell_arcsec, {r(f'degrees(1.7 * 1.2 * ({C!r} / min_freq) / 12)')} AS field_deg FROM s")
def imaging_advice(spark, sf):
    out = A.advice(A.summary(table(spark, sf, "vis")))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("w_percentile", ctes("vis") + f" SELECT pol, {r('quantile_cont(abs(w), 0.95)')} AS w95, {r('quantile_cont(abs(w), 0.5)')} AS w50 FROM vis WHERE NOT flag GROUP BY pol")
def w_percentile(spark, sf):
    q = A.quantiles(table(spark, sf, "vis").where("NOT flag"), ["pol"], F.abs("w"), {"w95": 0.95, "w50": 0.5})
    return q.select("pol", rnd("w95").alias("w95"), rnd("w50").alias("w50"))


@query("spw_average", ctes("vis") + f", spw AS (SELECT DISTINCT chan, freq, 1e6 AS width FROM vis) SELECT CAST(floor(chan / 4) AS INTEGER) AS out_chan, {r('avg(freq)', 3)} AS freq, {r('sum(width)', 3)} AS width, {r('sum(width * 0.9)', 3)} AS eff_bw FROM spw GROUP BY 1")
def spw_average(spark, sf):
    spw = table(spark, sf, "vis").select("chan", "freq", F.lit(1e6).alias("width")).distinct()
    return spw.groupBy(F.floor(F.col("chan") / 4).cast("int").alias("out_chan")).agg(rnd(F.avg("freq"), 3).alias("freq"), rnd(F.sum("width"), 3).alias("width"), rnd(F.sum(F.col("width") * 0.9), 3).alias("eff_bw"))


@query("msgroup_freq_check", ctes("vis") + ", spw AS (SELECT DISTINCT chan, freq FROM vis), d AS (SELECT chan, freq, freq - lag(freq) OVER (ORDER BY chan) AS step FROM spw) SELECT count(*) AS n_chan, max(step) - min(step) <= 1 AS constant, min(freq) AS first_freq FROM d")
def msgroup_freq_check(spark, sf):
    """The channels are few by nature: one ordered pass over the distinct ones."""
    spw = table(spark, sf, "vis").select("chan", "freq").distinct()
    d = spw.withColumn("step", F.col("freq") - F.lag("freq").over(Window.orderBy("chan")))
    return d.agg(F.count(F.lit(1)).alias("n_chan"), (F.max("step") - F.min("step") <= 1).alias("constant"), F.min("freq").alias("first_freq"))


@query("solution_interval", ctes("ts") + " SELECT CAST(floor((time_s - m.t0) / 86400) AS INTEGER) AS interval_id, count(*) AS n_rows, min(time_s) AS first_s, max(time_s) AS last_s FROM ts, (SELECT min(time_s) AS t0 FROM ts) m GROUP BY 1")
def solution_interval(spark, sf):
    """Chunks of a day from the first sample; also the time bounds of each solution."""
    ts = table(spark, sf, "ts")
    rows = ts.join(ts.agg(F.min("time_s").alias("t0"))).withColumn("interval_id", F.floor((F.col("time_s") - F.col("t0")) / 86400).cast("int"))
    return rows.groupBy("interval_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"))


@query("data_presence", ctes("ts", "vis_pol") + ", a AS (SELECT antenna1 AS antenna, beam, pol, flag FROM vis_pol UNION ALL SELECT antenna2, beam, pol, flag FROM vis_pol) SELECT antenna, beam, pol, count(*) FILTER (NOT flag) > 0 AS has_data FROM a GROUP BY antenna, beam, pol")
def data_presence(spark, sf):
    v = table(spark, sf, "vis_pol").select("beam", "pol", "flag", F.explode(F.array("antenna1", "antenna2")).alias("antenna"))
    return v.groupBy("antenna", "beam", "pol").agg(F.max(~F.col("flag")).alias("has_data"))


@query("all_channels_flagged", ctes("vis") + " SELECT antenna1, antenna2, pol, min(flag) AS all_flagged FROM vis GROUP BY antenna1, antenna2, pol")
def all_channels_flagged(spark, sf):
    return table(spark, sf, "vis").groupBy("antenna1", "antenna2", "pol").agg(F.min("flag").alias("all_flagged"))


@query("scan_summary", ctes("vis") + f" SELECT scan, field_id, min(time_s) AS begin_s, max(time_s) AS end_s, count(*) AS n_rows, count(*) FILTER (NOT flag) AS n_unflagged, count(DISTINCT chan) AS n_chan, {r('avg(sigma)')} AS mean_interval, string_agg(DISTINCT pol, ',' ORDER BY pol) AS pols FROM vis GROUP BY scan, field_id")
def scan_summary(spark, sf):
    return table(spark, sf, "vis").groupBy("scan", "field_id").agg(F.min("time_s").alias("begin_s"), F.max("time_s").alias("end_s"), F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("flag")).alias("n_unflagged"), F.countDistinct("chan").alias("n_chan"), rnd(F.avg("sigma")).alias("mean_interval"), F.array_join(F.array_sort(F.collect_set("pol")), ",").alias("pols"))


@query("dimension_listing", ctes("vis") + " SELECT n.n_name AS field_name, r.r_name AS observation, count(v.field_id) AS n_vis FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN vis v ON v.field_id = n.n_nationkey GROUP BY n.n_name, r.r_name")
def dimension_listing(spark, sf):
    counts = table(spark, sf, "vis").groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return f.join(counts, F.col("field_id") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("field_name"), F.col("r_name").alias("observation"), F.coalesce("n", F.lit(0)).alias("n_vis"))


@query("antenna_listing", "SELECT CAST(s_suppkey % 36 AS INTEGER) AS antenna, min(s_name) AS name, count(*) AS n_pads FROM supplier GROUP BY 1")
def antenna_listing(spark, sf):
    return table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 36).cast("int").alias("antenna")).agg(F.min("s_name").alias("name"), F.count(F.lit(1)).alias("n_pads"))


@query("antenna_valid_data", ctes("vis") + ", a AS (SELECT scan, pol, antenna1 AS antenna FROM vis WHERE NOT flag UNION SELECT scan, pol, antenna2 FROM vis WHERE NOT flag) SELECT scan, pol, antenna FROM a")
def antenna_valid_data(spark, sf):
    return A.valid_antennas(table(spark, sf, "vis"), ["scan", "pol"])


@query("flagged_antennas", ctes("vis") + ", v AS (SELECT * FROM vis), a AS (SELECT scan, pol, antenna1 AS antenna FROM v WHERE NOT flag UNION SELECT scan, pol, antenna2 FROM v WHERE NOT flag), g AS (SELECT DISTINCT scan, pol, CAST(k AS INTEGER) AS antenna FROM v, range(40) t(k)) SELECT * FROM g EXCEPT SELECT * FROM a")
def flagged_antennas(spark, sf):
    return A.flagged_antennas(table(spark, sf, "vis"), ["scan", "pol"], 40)


@query("spectrum_avg", ctes("vis") + f" SELECT antenna1, antenna2, CAST(floor(chan / 4) AS INTEGER) AS out_chan, {r('avg(re) FILTER (NOT flag)')} AS re, {r('avg(im) FILTER (NOT flag)')} AS im, count(*) FILTER (NOT flag) AS n_good FROM vis GROUP BY antenna1, antenna2, 3")
def spectrum_avg(spark, sf):
    out = P.channel_average(table(spark, sf, "vis").withColumn("out_chan", F.floor(F.col("chan") / 4).cast("int")), ["antenna1", "antenna2", "out_chan"])
    return out.select("antenna1", "antenna2", "out_chan", rnd("re").alias("re"), rnd("im").alias("im"), "n_good")


_PH = ", s AS (SELECT antenna1, antenna2, chan, atan2(avg(im) FILTER (NOT flag), avg(re) FILTER (NOT flag)) AS phase FROM vis GROUP BY antenna1, antenna2, chan)"


@query("phase_fill", ctes("vis") + _PH + f" SELECT antenna1, antenna2, chan, {r('coalesce(last_value(phase IGNORE NULLS) OVER (PARTITION BY antenna1, antenna2 ORDER BY chan ROWS UNBOUNDED PRECEDING), 0)')} AS phase FROM s")
def phase_fill(spark, sf):
    good = ~F.col("flag")
    s = table(spark, sf, "vis").groupBy("antenna1", "antenna2", "chan").agg(F.atan2(F.avg(F.when(good, F.col("im"))), F.avg(F.when(good, F.col("re")))).alias("phase"))
    w = Window.partitionBy("antenna1", "antenna2").orderBy(F.asc_nulls_last("chan")).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("phase", rnd(F.coalesce(F.last("phase", ignorenulls=True).over(w), F.lit(0.0))))


_TURN = f"CASE WHEN d > {1.5 * math.pi!r} THEN {-2 * math.pi!r} WHEN d < {-1.5 * math.pi!r} THEN {2 * math.pi!r} ELSE 0.0 END"


@query("phase_unwrap", ctes("ts") + f""", p AS (SELECT antenna, event_id, time_s, value * 0.7 - floor(value * 0.7 / 6.25) * 6.25 - 3.125 AS phase FROM ts),
d AS (SELECT *, phase - lag(phase) OVER o AS d FROM p WINDOW o AS (PARTITION BY antenna ORDER BY time_s, event_id)),
u AS (SELECT *, phase + sum({_TURN}) OVER (PARTITION BY antenna ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING) AS unwrapped FROM d)
SELECT event_id, antenna, {r('unwrapped', 4)} AS unwrapped, {r('unwrapped - lag(unwrapped) OVER (PARTITION BY antenna ORDER BY time_s, event_id)', 4)} AS step FROM u""")
def phase_unwrap(spark, sf):
    x = F.col("value") * 0.7
    p = table(spark, sf, "ts").withColumn("phase", x - F.floor(x / 6.25) * 6.25 - 3.125)
    u = K.unwrapped(p, ["antenna"], ["time_s", "event_id"], "phase", F.floor(F.col("time_s") / 86400))
    return u.select("event_id", "antenna", rnd("unwrapped", 4).alias("unwrapped"), rnd("step", 4).alias("step"))


@query("scan_sessions", ctes("ts") + """, b AS (SELECT *, CASE WHEN lag(event_id) OVER o IS NULL OR abs(time_s - lag(time_s) OVER o) > 1800 OR antenna % 3 <> lag(antenna % 3) OVER o THEN 1 ELSE 0 END AS cut FROM ts WINDOW o AS (PARTITION BY beam ORDER BY time_s, event_id)),
i AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY beam ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM b)
SELECT beam, island, min(time_s) AS begin_s, max(time_s) AS end_s, count(*) AS n_cycles, count(DISTINCT antenna) AS n_antennas FROM i GROUP BY beam, island""")
def scan_sessions(spark, sf):
    """Gaps and islands per beam, then the records of an island merged."""
    rows = table(spark, sf, "ts").withColumn("field", F.col("antenna") % 3)
    i = O.islands(rows, ["beam"], ["time_s", "event_id"], F.floor(F.col("time_s") / 86400), [("time_s", 1800.0), ("field", None)])
    return i.groupBy("beam", "island").agg(F.min("time_s").alias("begin_s"), F.max("time_s").alias("end_s"), F.count(F.lit(1)).alias("n_cycles"), F.countDistinct("antenna").alias("n_antennas"))


_SCANS = ", scans AS (SELECT CAST(k AS INTEGER) AS scan_no, CAST(86400 * (2 * k + 1) AS DOUBLE) AS start_s, CAST(86400 * (2 * k + 1) + 100000 AS DOUBLE) AS end_s FROM range(0, 15) t(k))"


@query("scan_range_join", ctes("ts") + _SCANS + """, j AS (SELECT t.event_id, t.beam, t.time_s, min(s.scan_no) AS hit FROM ts t LEFT JOIN scans s ON t.time_s BETWEEN s.start_s AND s.end_s GROUP BY t.event_id, t.beam, t.time_s)
SELECT event_id, beam, hit IS NULL AS flag, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY beam ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING), 0) AS scan_no FROM j""")
def scan_range_join(spark, sf):
    scans = spark.range(15).select(F.col("id").cast("int").alias("scan_no"), (86400.0 * (2 * F.col("id") + 1)).alias("start_s"), (86400.0 * (2 * F.col("id") + 1) + 100000).alias("end_s"))
    j = J.first_interval(table(spark, sf, "ts").select("event_id", "beam", "time_s"), scans, "time_s", [], "start_s", "end_s", "scan_no")
    j = O.last_seen(j, ["beam"], ["time_s", "event_id"], F.floor(F.col("time_s") / 86400), F.col("scan_no"), "carried")
    return j.select("event_id", "beam", F.col("scan_no").isNull().alias("flag"), F.coalesce("carried", F.lit(0)).alias("scan_no"))


@query("scan_match", ctes("ts") + ", m AS (SELECT CAST(k AS INTEGER) AS scan_no, CAST(k % 7 AS INTEGER) AS beam, k * 1000 AS start_cycle, k * 1000 + 1500 AS end_cycle FROM range(0, 10) t(k)) SELECT m.scan_no, m.beam, count(*) AS n_cycles FROM ts t JOIN m ON t.beam = m.beam AND t.event_id BETWEEN m.start_cycle AND m.end_cycle GROUP BY m.scan_no, m.beam")
def scan_match(spark, sf):
    m = spark.range(10).select(F.col("id").cast("int").alias("scan_no"), (F.col("id") % 7).cast("int").alias("beam"), (F.col("id") * 1000).alias("start_cycle"), (F.col("id") * 1000 + 1500).alias("end_cycle"))
    return table(spark, sf, "ts").join(m, "beam").where("event_id BETWEEN start_cycle AND end_cycle").groupBy("scan_no", "beam").agg(F.count(F.lit(1)).alias("n_cycles"))


@query("asof_gain", ctes("ts", "vis_pol", "gains") + f" SELECT v.row_id, v.pol, {r('g.g_re')} AS g_re, {r('g.g_im')} AS g_im, g.time_s AS sol_s, g.valid FROM vis_pol v ASOF LEFT JOIN gains g ON v.antenna2 = g.antenna AND v.time_s >= g.time_s")
def asof_gain(spark, sf):
    v = table(spark, sf, "vis_pol", G.spread).select("row_id", "pol", "antenna2", "time_s")
    g = table(spark, sf, "gains").withColumnRenamed("time_s", "sol_s")
    out = J.asof(v, g, {"antenna2": "antenna"}, "time_s", "sol_s", ["g_re", "g_im", "valid"])
    return out.select("row_id", "pol", rnd("g_re").alias("g_re"), rnd("g_im").alias("g_im"), "sol_s", "valid")


_G = "(v.re * gr + v.im * gi) / (gr * gr + gi * gi)", "(v.im * gr - v.re * gi) / (gr * gr + gi * gi)"


@query("apply_gain", ctes("ts", "vis_pol", "gains") + f""", v AS (SELECT v.row_id, v.pol, v.flag, v.re, v.im, a.g_re * b.g_re + a.g_im * b.g_im AS gr, a.g_im * b.g_re - a.g_re * b.g_im AS gi, coalesce(a.valid AND b.valid, FALSE) AS ok
 FROM vis_pol v ASOF LEFT JOIN gains a ON v.antenna1 = a.antenna AND v.time_s >= a.time_s ASOF LEFT JOIN gains b ON v.antenna2 = b.antenna AND v.time_s >= b.time_s)
SELECT row_id, pol, CASE WHEN ok THEN {r(_G[0])} ELSE 0.0 END AS re, CASE WHEN ok THEN {r(_G[1])} ELSE 0.0 END AS im, v.flag OR NOT ok AS flag FROM v""")
def apply_gain(spark, sf):
    v, g = table(spark, sf, "vis_pol", G.spread), table(spark, sf, "gains").withColumnRenamed("time_s", "sol_s")
    for antenna, n in (("antenna1", 1), ("antenna2", 2)):
        own = g.select("antenna", F.col("sol_s").alias(f"s{n}"), F.col("g_re").alias(f"g{n}_re"), F.col("g_im").alias(f"g{n}_im"), F.col("valid").alias(f"ok{n}"))
        v = J.asof(v, own, {antenna: "antenna"}, "time_s", f"s{n}", [f"g{n}_re", f"g{n}_im", f"ok{n}"])
    ok = F.coalesce(F.col("ok1") & F.col("ok2"), F.lit(False))
    c = K.corrected(Cx.of("re", "im"), Cx.of("g1_re", "g1_im"), Cx.of("g2_re", "g2_im"))
    return v.select("row_id", "pol", F.when(ok, rnd(c.re)).otherwise(0.0).alias("re"), F.when(ok, rnd(c.im)).otherwise(0.0).alias("im"), (F.col("flag") | ~ok).alias("flag"))


@query("gain_interp_time", ctes("ts", "vis_pol", "gains") + f""", b AS (SELECT v.row_id, v.antenna2, v.time_s, g.g_re AS br, g.g_im AS bi, g.time_s AS tb FROM (SELECT DISTINCT row_id, antenna2, time_s FROM vis_pol) v ASOF LEFT JOIN gains g ON v.antenna2 = g.antenna AND v.time_s >= g.time_s),
m AS (SELECT b.*, g.g_re AS ar, g.g_im AS ai, g.time_s AS ta FROM b ASOF LEFT JOIN gains g ON b.antenna2 = g.antenna AND b.time_s <= g.time_s),
f AS (SELECT *, (time_s - tb) / (ta - tb) AS f, (ar * br + ai * bi) / (br * br + bi * bi) AS qr, (ai * br - ar * bi) / (br * br + bi * bi) AS qi FROM m),
s AS (SELECT *, 1 + (sqrt(qr * qr + qi * qi) - 1) * f AS a, atan2(qi, qr) * f AS p FROM f)
SELECT row_id, {r('CASE WHEN ta > tb THEN a * (br * cos(p) - bi * sin(p)) ELSE br END')} AS g_re, {r('CASE WHEN ta > tb THEN a * (br * sin(p) + bi * cos(p)) ELSE bi END')} AS g_im FROM s""")
def gain_interp_time(spark, sf):
    v = table(spark, sf, "vis_pol", G.spread).select("row_id", "antenna2", "time_s").distinct()
    g = table(spark, sf, "gains")
    before = g.select("antenna", F.col("time_s").alias("tb"), F.col("g_re").alias("br"), F.col("g_im").alias("bi"))
    after = g.select("antenna", F.col("time_s").alias("ta"), F.col("g_re").alias("ar"), F.col("g_im").alias("ai"))
    both = J.asof(J.asof(v, before, {"antenna2": "antenna"}, "time_s", "tb", ["br", "bi"]), after, {"antenna2": "antenna"}, "time_s", "ta", ["ar", "ai"], forward=True)
    z = K.interpolated(Cx.of("br", "bi"), Cx.of("ar", "ai"), F.col("time_s"), F.col("tb"), F.col("ta"))
    return both.select("row_id", rnd(z.re).alias("g_re"), rnd(z.im).alias("g_im"))


@query("phase_reference", ctes("ts", "gains") + f""", f AS (SELECT time_s, g_re AS rr, -g_im AS ri, sqrt(g_re * g_re + g_im * g_im) AS a FROM gains WHERE antenna = 3)
SELECT g.time_s, g.antenna, {r('coalesce((g_re * rr - g_im * ri) / a, g_re)')} AS g_re, {r('coalesce((g_re * ri + g_im * rr) / a, g_im)')} AS g_im FROM gains g LEFT JOIN f USING (time_s)""")
def phase_reference(spark, sf):
    out = K.phase_referenced(table(spark, sf, "gains"), 3, ["time_s"])
    return out.select("time_s", "antenna", rnd("g_re").alias("g_re"), rnd("g_im").alias("g_im"))


@query("gain_compare", ctes("ts", "gains") + f""", a AS (SELECT antenna, avg(g_re) AS re, avg(g_im) AS im FROM gains WHERE time_s < 1000000 GROUP BY antenna), b AS (SELECT antenna, avg(g_re) AS re, avg(g_im) AS im FROM gains WHERE time_s >= 1000000 AND antenna % 5 <> 0 GROUP BY antenna)
SELECT 'gain.g11.' || a.antenna || '.0' AS name, {r('sqrt((a.re * b.re + a.im * b.im) * (a.re * b.re + a.im * b.im) + (a.im * b.re - a.re * b.im) * (a.im * b.re - a.re * b.im))')} AS amplitude, {r('atan2(a.im * b.re - a.re * b.im, a.re * b.re + a.im * b.im)')} AS phase FROM a JOIN b USING (antenna)""")
def gain_compare(spark, sf):
    g = table(spark, sf, "gains")
    mean = lambda rows, p: rows.groupBy("antenna").agg(F.avg("g_re").alias(f"{p}r"), F.avg("g_im").alias(f"{p}i"))
    j = mean(g.where("time_s < 1000000"), "a").join(mean(g.where("time_s >= 1000000 AND antenna % 5 <> 0"), "b"), "antenna")
    z = Cx.of("ar", "ai") * Cx.of("br", "bi").conj()
    return j.select(F.concat(F.lit("gain.g11."), F.col("antenna").cast("string"), F.lit(".0")).alias("name"), rnd(z.abs()).alias("amplitude"), rnd(z.arg()).alias("phase"))


@query("param_union", ctes("ts", "gains") + " SELECT 'gain.g11.' || antenna || '.0' AS name FROM gains UNION SELECT 'gain.g22.' || antenna || '.0' FROM gains WHERE valid")
def param_union(spark, sf):
    g = table(spark, sf, "gains")
    name = lambda p: F.concat(F.lit(f"gain.{p}."), F.col("antenna").cast("string"), F.lit(".0")).alias("name")
    return g.select(name("g11")).unionByName(g.where("valid").select(name("g22"))).distinct()


@query("unknowns_merged", ctes("ts", "vis_pol") + f" SELECT beam, antenna, {r('sum(s)', 3)} AS total, count(*) AS n_units FROM (SELECT beam, antenna2 AS antenna, pol, sum(re) AS s FROM vis_pol WHERE NOT flag GROUP BY beam, antenna2, pol) GROUP BY beam, antenna")
def unknowns_merged(spark, sf):
    """Results of independent work units, one per polarisation, in one model."""
    v = table(spark, sf, "vis_pol").where("NOT flag")
    units = None
    for p in range(4):
        one = v.where(F.col("pol") == p).groupBy("beam", F.col("antenna2").alias("antenna")).agg(F.sum("re").alias("s"))
        units = one if units is None else units.unionByName(one)
    return units.groupBy("beam", "antenna").agg(rnd(F.sum("s"), 3).alias("total"), F.count(F.lit(1)).alias("n_units"))


_PRE = ", m AS (SELECT *, 1 + pol * 0.1 AS m_re, 0.2 - pol * 0.05 AS m_im, 1.0 / (1 + pol) AS weight FROM vis_pol WHERE NOT flag)"


@query("preavg_products", ctes("ts", "vis_pol") + _PRE + f""" SELECT a.antenna1, a.antenna2, a.beam, a.pol, b.pol AS pol2,
 {r('sum(a.weight * (a.m_re * b.re + a.m_im * b.im))', 3)} AS vm_re, {r('sum(a.weight * (a.m_re * b.im - a.m_im * b.re))', 3)} AS vm_im,
 {r('sum(a.weight * (a.m_re * b.m_re + a.m_im * b.m_im))', 4)} AS mm_re, {r('sum(a.weight * (a.m_re * b.m_im - a.m_im * b.m_re))', 4)} AS mm_im
FROM m a JOIN m b ON a.row_id = b.row_id GROUP BY a.antenna1, a.antenna2, a.beam, a.pol, b.pol""")
def preavg_products(spark, sf):
    p = F.col("pol")
    v = table(spark, sf, "vis_pol").withColumns({"m_re": 1 + p * 0.1, "m_im": 0.2 - p * 0.05, "weight": 1.0 / (1 + p)})
    out = K.preaveraged(v, ["antenna1", "antenna2", "beam"])
    return out.withColumns({"vm_re": rnd("vm_re", 3), "vm_im": rnd("vm_im", 3), "mm_re": rnd("mm_re", 4), "mm_im": rnd("mm_im", 4)})


@query("normal_equations", ctes("vis") + f""", d AS (SELECT pol, 1.0 AS p0, chan / 16.0 AS p1, u / 1000 AS p2, re AS y, 1.0 / (sigma * sigma) AS wt FROM vis WHERE NOT flag),
s AS (SELECT pol, sum(p0 * p0 * wt) AS c0, sum(p0 * p1 * wt) AS c1, sum(p0 * p2 * wt) AS c2, sum(p0 * y * wt) AS c3, sum(p1 * p1 * wt) AS c4, sum(p1 * p2 * wt) AS c5, sum(p1 * y * wt) AS c6, sum(p2 * p2 * wt) AS c7, sum(p2 * y * wt) AS c8 FROM d GROUP BY pol)
SELECT pol, row_par, col_par, {r('value', 3)} AS value FROM (""" + " UNION ALL ".join(f"SELECT pol, '{a}' AS row_par, '{b}' AS col_par, c{i} AS value FROM s" for i, (a, b) in enumerate([("p0", "p0"), ("p0", "p1"), ("p0", "p2"), ("p0", "b"), ("p1", "p1"), ("p1", "p2"), ("p1", "b"), ("p2", "p2"), ("p2", "b")])) + ")")
def normal_equations(spark, sf):
    d = table(spark, sf, "vis").where("NOT flag").withColumns({"p0": F.lit(1.0), "p1": F.col("chan") / 16.0, "p2": F.col("u") / 1000, "wt": P.noise_weight("sigma")})
    return A.normal_equations(d, ["p0", "p1", "p2"], F.col("re"), F.col("wt"), ["pol"]).withColumn("value", rnd("value", 3))


@query("cont_subtract_linear", ctes("vis") + f""", s AS (SELECT antenna1, pol, chan, avg(re) AS y FROM vis WHERE NOT flag GROUP BY antenna1, pol, chan), f AS (SELECT antenna1, pol, regr_slope(y, chan) AS b, regr_intercept(y, chan) AS a FROM s GROUP BY antenna1, pol)
SELECT s.antenna1, s.pol, s.chan, {r('s.y - (f.a + f.b * s.chan)')} AS residual FROM s JOIN f USING (antenna1, pol)""")
def cont_subtract_linear(spark, sf):
    s = table(spark, sf, "vis").where("NOT flag").groupBy("antenna1", "pol", "chan").agg(F.avg("re").alias("y"))
    w = Window.partitionBy("antenna1", "pol")
    fit = F.regr_intercept("y", "chan").over(w) + F.regr_slope("y", "chan").over(w) * F.col("chan")
    return s.select("antenna1", "pol", "chan", rnd(F.col("y") - fit).alias("residual"))


@query("sigma_clip_round", ctes("vis") + f""", q AS (SELECT antenna1, pol, quantile_cont(re, 0.25) AS q25, quantile_cont(re, 0.5) AS q50, quantile_cont(re, 0.75) AS q75 FROM vis WHERE NOT flag GROUP BY antenna1, pol)
SELECT v.antenna1, v.pol, count(*) FILTER (abs(re - q50) > 1.2 * (q75 - q25) / 1.35) AS n_clipped, {r('avg(re) FILTER (NOT abs(re - q50) > 1.2 * (q75 - q25) / 1.35)')} AS mean FROM vis v JOIN q USING (antenna1, pol) WHERE NOT flag GROUP BY v.antenna1, v.pol""")
def sigma_clip_round(spark, sf):
    v = table(spark, sf, "vis").where("NOT flag")
    q = A.quantiles(v, ["antenna1", "pol"], F.col("re"), {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = F.abs(F.col("re") - F.col("q50")) > 1.2 * (F.col("q75") - F.col("q25")) / 1.35
    return v.join(q, ["antenna1", "pol"]).groupBy("antenna1", "pol").agg(F.count_if(out).alias("n_clipped"), rnd(F.avg(F.when(~out, F.col("re")))).alias("mean"))


@query("ms_merge_channels", ctes("ts") + f""", t AS (SELECT time_s, lag(time_s) OVER (ORDER BY time_s) AS before FROM (SELECT DISTINCT time_s FROM ts)),
k AS (SELECT time_s, max(CASE WHEN before IS NULL OR time_s - before > 1 THEN time_s END) OVER (ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS cluster FROM t),
u AS (SELECT k.cluster AS time_s, antenna, beam, CAST(event_id // 2 % 2 + 2 * (event_id % 2) AS INTEGER) AS chan, value AS re, value / 3 AS im, flag FROM ts JOIN k USING (time_s)),
d AS (SELECT time_s, antenna, beam, chan, sum(re) AS re, sum(im) AS im, min(flag) AS flag FROM u GROUP BY time_s, antenna, beam, chan), f AS (SELECT DISTINCT time_s, antenna, beam, CAST(k AS INTEGER) AS chan FROM u, range(4) t(k))
SELECT f.time_s, f.antenna, f.beam, f.chan, {r('coalesce(d.re, 0)')} AS re, {r('coalesce(d.im, 0)')} AS im, coalesce(d.flag, TRUE) AS flag FROM f LEFT JOIN d USING (time_s, antenna, beam, chan)""")
def ms_merge_channels(spark, sf):
    """Events of even and odd number as two tables of two channels each; times within a second are one integration."""
    e = F.col("event_id")
    ts = table(spark, sf, "ts").select("time_s", "antenna", "beam", (F.floor(e / 2) % 2).cast("int").alias("chan"), F.col("value").alias("re"), (F.col("value") / 3).alias("im"), "flag", (e % 2).alias("k"))
    out = J.merge_channels([ts.where("k = 0").drop("k"), ts.where("k = 1").drop("k")], [2, 2], ["antenna", "beam"])
    return out.withColumns({"re": rnd("re"), "im": rnd("im")})


@query("distinct_times", ctes("ts", "vis") + " SELECT time_s FROM ts UNION SELECT time_s FROM vis")
def distinct_times(spark, sf):
    return table(spark, sf, "ts").select("time_s").unionByName(table(spark, sf, "vis").select("time_s")).distinct()


@query("ms_concat", ctes("vis") + """, u AS (SELECT 'a' AS part, field_id, scan, re FROM vis WHERE scan < 4 UNION ALL SELECT 'b', field_id + 100, scan, re FROM vis WHERE scan >= 4), k AS (SELECT part, field_id, CAST(dense_rank() OVER (ORDER BY part, field_id) - 1 AS INTEGER) AS new_id FROM (SELECT DISTINCT part, field_id FROM u))
SELECT u.part, k.new_id, count(*) AS n_rows FROM u JOIN k USING (part, field_id) GROUP BY u.part, k.new_id""")
def ms_concat(spark, sf):
    """Main tables one after the other; dimension ids renumbered densely (the dimension is small: its key list is ordered once)."""
    v = table(spark, sf, "vis")
    u = v.where("scan < 4").select(F.lit("a").alias("part"), "field_id").unionByName(v.where("scan >= 4").select(F.lit("b").alias("part"), (F.col("field_id") + 100).alias("field_id")))
    counts = u.groupBy("part", "field_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select("part", (F.dense_rank().over(Window.orderBy("part", "field_id")) - 1).cast("int").alias("new_id"), "n_rows")


@query("baseline_match", ctes("vis") + " SELECT antenna1, antenna2, count(*) FILTER (feed1 = feed2 AND antenna1 < antenna2) AS used, count(*) FILTER (feed1 <> feed2) AS cross_beam, count(*) FILTER (antenna1 = antenna2) AS autocorrelations FROM vis GROUP BY antenna1, antenna2")
def baseline_match(spark, sf):
    beam, auto = F.col("feed1") == F.col("feed2"), F.col("antenna1") == F.col("antenna2")
    return table(spark, sf, "vis").groupBy("antenna1", "antenna2").agg(J.matched(beam & (F.col("antenna1") < F.col("antenna2")), "used"), J.matched(~beam, "cross_beam"), J.matched(auto, "autocorrelations"))


@query("cycle_average", ctes("ts") + f", n AS (SELECT antenna, value, flag, CAST(floor((row_number() OVER (PARTITION BY antenna ORDER BY time_s, event_id) - 1) / 5) AS INTEGER) AS block FROM ts) SELECT antenna, block, {r('avg(CASE WHEN flag THEN 0 ELSE value END)')} AS value, count(*) AS n_cycles FROM n GROUP BY antenna, block")
def cycle_average(spark, sf):
    """Every five consecutive cycles averaged, flagged samples as zero, the last group over its own count."""
    n = O.running_sum(table(spark, sf, "ts"), ["antenna"], ["time_s", "event_id"], F.floor(F.col("time_s") / 86400), F.lit(1), "place")
    n = n.withColumn("block", F.floor((F.col("place") - 1) / 5).cast("int"))
    return n.groupBy("antenna", "block").agg(rnd(F.avg(F.when(F.col("flag"), 0.0).otherwise(F.col("value")))).alias("value"), F.count(F.lit(1)).alias("n_cycles"))


@query("gain_solution_count", ctes("ts", "gains") + " SELECT antenna, count(*) AS n_solutions, count(*) FILTER (valid) AS n_valid, min(time_s) AS first_s FROM gains GROUP BY antenna")
def gain_solution_count(spark, sf):
    return table(spark, sf, "gains").groupBy("antenna").agg(F.count(F.lit(1)).alias("n_solutions"), F.count_if("valid").alias("n_valid"), F.min("time_s").alias("first_s"))


@query("last_rows_limit", ctes("ts") + " SELECT event_id, beam, time_s FROM ts ORDER BY time_s DESC, event_id DESC LIMIT 50")
def last_rows_limit(spark, sf):
    return table(spark, sf, "ts").orderBy(F.desc("time_s"), F.desc("event_id")).limit(50).select("event_id", "beam", "time_s")
