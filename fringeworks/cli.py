"""python -m fringeworks.cli TASK PARSET: runs one of the row pipelines from a key = value file.

TASKS names them; every task reads dataset (a visibility store) and writes out.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.complexcols import Cx
from .operators import aggregates as A
from .operators import calibrate as K
from .operators import components as CO
from .operators import continuum as CN
from .operators import cycle as Y
from .operators import ddcal as DD
from .operators import deconv as D
from .operators import delays as L
from .operators import gridding as G
from .operators import images as I  # noqa: E741
from .operators import joins as J
from .operators import lsqr
from .operators import ordered as O  # noqa: E741
from .operators import select as P
from .operators import simulate as M
from .operators import snapshot, taylor
from .sources import parset as C
from .sources import store, text


def split(spark: SparkSession, p: dict) -> DataFrame:
    """Selected rows and channels, averaged over width."""
    vis = C.selection(p)(store.read_vis(spark, p["dataset"]))
    if "channel" in p:
        first, last = p["channel"]
        vis = P.channel_range(vis, first, last, p.get("width", 1), p["nchan"])
        return P.channel_average(vis, ["scan", "field_id", "time_s", "antenna1", "antenna2", "feed1", "pol", "out_chan"])
    return vis


def advise(spark: SparkSession, p: dict) -> DataFrame:
    return A.advice(A.summary(store.read_vis(spark, *_list(p["dataset"])), p.get("useflagged", False)))


def concat(spark: SparkSession, p: dict) -> DataFrame:
    return store.read_vis(spark, *_list(p["dataset"]))


def calibrated(spark: SparkSession, p: dict) -> DataFrame:
    """Gains of a gain file applied; samples without both gains are flagged."""
    g = text.read_gains(spark, p["gains"]).where("kind = 'g11'").groupBy("antenna").agg(F.first("re").alias("g_re"), F.first("im").alias("g_im"))
    v = J.both_antennas(store.read_vis(spark, p["dataset"]), g)
    z = K.corrected(Cx.of("re", "im"), Cx.of("g1_re", "g1_im"), Cx.of("g2_re", "g2_im"))
    ok = F.col("g1_re").isNotNull() & F.col("g2_re").isNotNull()
    return v.withColumns({"re": F.coalesce(z.re, F.lit(0.0)), "im": F.coalesce(z.im, F.lit(0.0)), "flag": F.col("flag") | ~ok}).drop("g1_re", "g1_im", "g2_re", "g2_im")


def noisy(spark: SparkSession, p: dict) -> DataFrame:
    v = store.read_vis(spark, p["dataset"])
    names = [c for c in ("ms", "scan", "time_s", "antenna1", "antenna2", "feed1", "chan", "pol") if c in v.columns]
    return M.with_noise(v, float(p["rms"]), int(p.get("seed", 1)), F.xxhash64(*names).bitwiseAND(F.lit((1 << 62) - 1)))


def scans(spark: SparkSession, p: dict) -> DataFrame:
    """Scan numbers from an interval file; rows outside are flagged and carry the previous number."""
    v = J.first_interval(store.read_vis(spark, p["dataset"]).drop("scan"), text.read_scans(spark, p["scans"]), "time_s", [], "start_s", "end_s", "scan")
    v = O.last_seen(v, ["feed1"], ["time_s"], F.floor(F.col("time_s") / J.BUCKET), F.col("scan"), "_carried")
    return v.withColumns({"flag": F.col("flag") | F.col("scan").isNull(), "scan": F.coalesce("_carried", F.lit(0))}).drop("_carried")


def cube_statistics(spark: SparkSession, p: dict) -> DataFrame:
    return A.bad_channels(A.image_statistics(store.read_cube(spark, p["image"]), ["chan"]), float(p.get("threshold", 3)))


def components(p: dict) -> list[dict]:
    """components.names = [a, b], components.a.flux = 2, components.a.l = 0.001 and so on; kind is point unless given."""
    out = []
    for n in p["components.names"]:
        own = C.subset(p, f"components.{n}.")
        out.append({k: v if k == "kind" else C.quantity(str(v)) for k, v in own.items()})
    return out


def merged(spark: SparkSession, p: dict) -> DataFrame:
    """Datasets of neighbouring channels side by side, their times matched within tolerance seconds."""
    parts = [store.read_vis(spark, d) for d in _list(p["dataset"])]
    return J.merge_channels(parts, _list(p["nchans"]), p.get("keys", ["antenna1", "antenna2", "feed1", "pol"]), float(p.get("tolerance", 1.0)))


def without_model(spark: SparkSession, p: dict) -> DataFrame:
    return Y.model_subtracted(store.read_vis(spark, p["dataset"]), components(p))


def _cells(spark: SparkSession, p: dict) -> tuple[DataFrame, G.Kernel, int, object]:
    """Unflagged samples with their cells, the kernel, the size and the taper that images are divided by."""
    n, name = int(p.get("size", 64)), p.get("gridder", "box")
    support, oversample = (0, 1) if name == "box" else (int(p.get("support", 3)), int(p.get("oversample", 8)))
    rows = store.read_vis(spark, p["dataset"]).where("NOT flag AND sigma > 0").withColumn("plane", F.lit(0))
    rows = P.with_uv_cells(rows, float(p["cell"]), oversample, n).where(P.on_grid("iu", "iv", support, n, n))
    kernel = G.KERNELS[name]() if name == "box" else G.KERNELS[name](support, oversample)
    return rows, G.kernel_table(spark, kernel), n, None if name == "box" else G.spheroidal_correction


def imaged(spark: SparkSession, p: dict) -> DataFrame:
    """Dirty image and point spread function of every key (keys, by default pol); cell is in wavelengths."""
    rows, kernel, n, taper = _cells(spark, p)
    keys = p.get("keys", ["pol"])
    return G.images_of(G.gridded(rows, kernel, Cx.of("re", "im").conj(), P.noise_weight("sigma"), keys), keys, n, {"dirty": ("re", "im"), "psf": ("psf_re", "psf_im")}, taper)


def cleaned(spark: SparkSession, p: dict) -> DataFrame:
    """Model and residual after ncycles major cycles of niter components each."""
    rows, kernel, n, taper = _cells(spark, p)
    control = lambda: D.Control(int(p.get("niter", 100)), float(p.get("gain", 0.1)), fraction=float(p.get("fraction", 0.1)))
    return Y.major_cycles(rows, kernel, n, p.get("keys", ["pol"]), P.noise_weight("sigma"), int(p.get("ncycles", 3)), control, float(p.get("threshold", 0.0)), taper, int(p.get("border", n // 4 if taper else 0)))[1]


def gains(spark: SparkSession, p: dict) -> DataFrame:
    """Gains of antennas per key (keys, by default chan) for a component model; amplitudes under minamplitude are not valid."""
    v = store.read_vis(spark, p["dataset"]).where("NOT flag AND antenna1 <> antenna2")
    keys, model = p.get("keys", ["chan"]), Y.predicted(components(p))
    v = v.withColumns({"_m_re": model.re, "_m_im": model.im})
    model = Cx.of("_m_re", "_m_im")
    z = model.conj() * Cx.of("re", "im")
    products = v.groupBy(*keys, "antenna1", "antenna2").agg(F.sum(z.re).alias("vm_re"), F.sum(z.im).alias("vm_im"), F.sum(model.abs2()).alias("mm_re"))
    return K.solved_gains(products, keys, int(p["nantennas"]), float(p.get("minamplitude", 0.0)))


def delays(spark: SparkSession, p: dict) -> DataFrame:
    """Delays of baselines from the mean spectra of their samples; chanwidth is in Hz."""
    keys = ["antenna1", "antenna2"]
    v = store.read_vis(spark, p["dataset"]).where("NOT flag AND antenna1 <> antenna2")
    return K.solved_delays(v.groupBy(*keys, "chan").agg(F.avg("re").alias("re"), F.avg("im").alias("im")), keys, C.quantity(str(p["chanwidth"]), "Hz"))


def bandpass(spark: SparkSession, p: dict) -> DataFrame:
    """Gains of antennas and channels per key (keys, by default feed1 and pol) for a component model, with damping and smoothing over channels."""
    keys, model = p.get("keys", ["feed1", "pol"]), Y.predicted(components(p))
    v = store.read_vis(spark, p["dataset"]).where("NOT flag AND sigma > 0 AND antenna1 <> antenna2").withColumns({"_m_re": model.re, "_m_im": model.im})
    m, w = Cx.of("_m_re", "_m_im"), P.noise_weight("sigma")
    z = m.conj() * Cx.of("re", "im")
    products = v.groupBy(*keys, "antenna1", "antenna2", "chan").agg(F.sum(z.re * w).alias("vm_re"), F.sum(z.im * w).alias("vm_im"), F.sum(m.abs2() * w).alias("mm_re"))
    rules = lsqr.Rules(float(p.get("damping", 0)), float(p.get("smoothing", 0)), order=int(p.get("order", 2)), outer=int(p.get("ncycles", 8)), inner=int(p.get("niter", 25)))
    return lsqr.solved_bandpass(products, keys, int(p["nantennas"]), int(p["nchan"]), rules, int(p.get("refant", 0)))


def direction_gains(spark: SparkSession, p: dict) -> DataFrame:
    """Gains of antennas towards every component, per key (keys, by default feed1 and pol)."""
    keys, own = p.get("keys", ["feed1", "pol"]), components(p)
    v = store.read_vis(spark, p["dataset"]).where("NOT flag AND sigma > 0")
    sums = DD.products(v, keys, Cx.of("re", "im"), [Y.predicted([c]) for c in own], P.noise_weight("sigma"))
    return DD.solved(sums, keys, int(p["nantennas"]), len(own), int(p.get("refant", 0)))


def antenna_delays(spark: SparkSession, p: dict) -> DataFrame:
    """Delays of antennas, per key (keys, by default none), from lags of baselines; chanwidth is in Hz, average in channels."""
    keys, n = p.get("keys", []), int(p.get("average", 1))
    v = store.read_vis(spark, p["dataset"])
    mean = L.spectra(v, keys, n, float(p["ampcutoff"]) if "ampcutoff" in p else None)
    found = L.baseline_delays(mean, keys, -(-int(p["nchan"]) // n), n * C.quantity(str(p["chanwidth"]), "Hz"))
    return L.antenna_delays(found, keys, int(p.get("refant", 0)), float(p.get("quality", 0)))


def taylor_models(spark: SparkSession, p: dict) -> DataFrame:
    """Models of nterms Taylor terms, the residual and spectral indices where there is flux; frequency is the reference in Hz."""
    rows, kernel, n, taper = _cells(spark, p)
    control = lambda: D.Control(int(p.get("niter", 100)), float(p.get("gain", 0.1)), fraction=float(p.get("fraction", 0.1)))
    out = taylor.cycles(rows, kernel, n, p.get("keys", ["pol"]), "freq", C.quantity(str(p["frequency"]), "Hz"), P.noise_weight("sigma"), int(p.get("nterms", 2)), int(p.get("ncycles", 3)), control, p.get("scales", [0.0]), p.get("criterion", "MAXBASE"), float(p.get("threshold", 0)), taper)[1]
    return taylor.spectral_index(out, float(p.get("minflux", 0.01)))


def snapshots(spark: SparkSession, p: dict) -> DataFrame:
    """Integrations imaged on planes of their own (tolerance in wavelengths of w), reprojected (method cubic, lanczos or linear) and added."""
    from .functions.scalar import C_LIGHT

    rows, kernel, n, taper = _cells(spark, p)
    keys = p.get("keys", ["pol"])
    rows = rows.withColumns({c: F.col(c) * F.col("freq") / C_LIGHT for c in "uvw"})
    rows = snapshot.segmented(rows, keys, float(p.get("tolerance", 1.0)), float(p.get("restart", 86400)))
    return snapshot.snapshot_image(rows, kernel, keys, n, float(p["cell"]), P.noise_weight("sigma"), p.get("method", "cubic"), taper)


def component_fit(spark: SparkSession, p: dict) -> DataFrame:
    """Components moved in their free parameters (free = [a.flux, a.l]) to fit the samples, with errors."""
    names = p["components.names"]
    free = [(names.index(x.split(".")[0]), x.split(".")[1]) for x in p["free"]]
    v = store.read_vis(spark, p["dataset"]).where("NOT flag AND sigma > 0")
    fit = CO.fitted(v, components(p), free, P.noise_weight("sigma"), int(p.get("niter", 20)))
    return spark.createDataFrame([(names[i], n, float(fit.components[i][n]), fit.errors[i, n]) for i, n in free], "component string, parameter string, value double, error double")


def without_continuum(spark: SparkSession, p: dict) -> DataFrame:
    """Samples less a robust fit of order powers and harmonics over the channels of each row (keys)."""
    keys = p.get("keys", ["time_s", "antenna1", "antenna2", "feed1", "pol"])
    v = store.read_vis(spark, p["dataset"])
    return CN.subtracted(v, keys, int(p["nchan"]), int(p.get("order", 2)), int(p.get("harmonic", 0)), width=int(p.get("width", 0)), offset=int(p.get("offset", 0)), threshold=float(p.get("threshold", 2.5)))


def mosaic(spark: SparkSession, p: dict) -> DataFrame:
    """Weighted mean of images (x, y, value, weight, and shift_x, shift_y where their grids differ) stored as Parquet."""
    i = spark.read.parquet(*_list(p["image"]))
    if {"shift_x", "shift_y"} <= set(i.columns):
        i = I.regridded(i.withColumn("value", F.col("value") * F.col("weight")), ["shift_x", "shift_y"], "shift_x", "shift_y", ["value", "weight"]).withColumn("value", F.col("value") / F.col("weight"))
    return A.mosaic(i, float(p.get("cutoff", 0.01)))


def spectra(spark: SparkSession, p: dict) -> DataFrame:
    """Mean spectra of baselines, padded and, with dofft, transformed."""
    return I.extracted_spectra(store.read_vis(spark, p["dataset"]), p.get("keys", ["antenna1", "antenna2"]), int(p["nchan"]), int(p.get("padding", 1)), bool(p.get("dofft", False)))


def simulated(spark: SparkSession, p: dict) -> DataFrame:
    """Rows of an observation by the array and feeds that the file defines."""
    a = spark.createDataFrame(C.antennas(p), "antenna int, name string, x double, y double, z double, diameter double, mount string")
    return M.observed_rows(spark, a, int(p["ncycles"]), float(p.get("degrees", 1.0)), len(C.feeds(p)), C.quantity(str(p.get("declination", "-30deg"))))


def errors(spark: SparkSession, p: dict) -> DataFrame:
    """Random gains and leakages as lines of a gain file."""
    return text.gain_lines(M.random_gains(spark.range(int(p["nantennas"]) * int(p.get("nbeams", 1))).selectExpr(f"cast(id div {int(p.get('nbeams', 1))} as int) AS antenna", f"cast(id % {int(p.get('nbeams', 1))} as int) AS beam"), int(p.get("nbeams", 1)), float(p.get("low", 0.7)), float(p.get("high", 1.3)), int(p.get("seed", 1)), float(p.get("leakage", 0.0))))


def plane(spark: SparkSession, p: dict) -> DataFrame:
    """Channels first .. last of a stored cube."""
    first, last = p["channels"]
    return store.read_cube(spark, p["image"]).where(F.col("chan").between(int(first), int(last)))


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


TASKS = {
    "split": split, "advise": advise, "concat": concat, "merge": merged, "apply": calibrated, "noise": noisy, "scans": scans, "statistics": cube_statistics,
    "contsub": without_model, "image": imaged, "clean": cleaned, "gains": gains, "delays": delays, "mosaic": mosaic, "spectra": spectra, "simulate": simulated, "errors": errors, "slice": plane,
    "bandpass": bandpass, "directions": direction_gains, "antennadelays": antenna_delays, "taylor": taylor_models, "snapshot": snapshots, "fit": component_fit, "contfit": without_continuum,
}


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in TASKS:
        print(__doc__, "Tasks:", ", ".join(TASKS), file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"fringeworks {args[0]}").getOrCreate()
    lines = "\n".join(r.value for r in spark.read.text(args[1]).collect())
    p = C.parse(lines)
    TASKS[args[0]](spark, p).write.mode("overwrite").parquet(p["out"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
