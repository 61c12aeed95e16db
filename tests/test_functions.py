import math

import pytest
from pyspark.sql import functions as F

from fringeworks.functions import scalar as S
from fringeworks.functions.complexcols import Cx
from fringeworks.functions.names import parse_image_name
from fringeworks.sources import parset


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(("mhz", "jy"), [(1201.4, 15.138), (769.7, 13.181), (598.9, 10.631), (1595.1, 14.389), (1803.9, 13.678), (2003.1, 12.939)])
def test_flux_model(spark, mhz, jy):
    assert one(spark, S.flux_1934(F.lit(mhz)))[0] == pytest.approx(jy, abs=2e-3)


def test_flux_model_has_no_value_outside(spark):
    assert list(one(spark, S.flux_1934(F.lit(500.0)), S.flux_1934(F.lit(10000.0)))) == [None, None]


def test_complex_algebra(spark):
    a, b = Cx.of(F.lit(3.0), F.lit(-2.0)), Cx.of(F.lit(0.5), F.lit(4.0))
    got = one(spark, *(a * b).cols("x", "y"), *(a / b).cols("x", "y"), a.abs(), a.arg())
    x, y = 3 - 2j, 0.5 + 4j
    want = [(x * y).real, (x * y).imag, (x / y).real, (x / y).imag, abs(x), math.atan2(-2, 3)]
    assert list(got) == pytest.approx(want)


def test_frequency_map_rounds_to_nearest_and_takes_all_for_one_channel(spark):
    f = [1.308e9 + 16e6 * (i - 1) for i in range(10)]
    rows = spark.createDataFrame([(x,) for x in f], "f double").select(S.frequency_channel("f", 1.308e9, 16e6, 8).alias("c"), S.frequency_channel("f", 1.0, 1.0, 1).alias("one")).collect()
    assert [r.c for r in rows] == [-1, 0, 1, 2, 3, 4, 5, 6, 7, -1] and {r.one for r in rows} == {0}


def test_gaussian_w_sampling_inverts_and_keeps_ends(spark):
    a, s = S.w_gaussian_parameters(0.4)
    rows = spark.createDataFrame([(x / 10,) for x in range(-10, 11)], "p double").select("p", S.w_gaussian_inverse(S.w_gaussian("p", a, s), a, s).alias("q"), S.w_gaussian("p", a, s).alias("w")).collect()
    assert all(r.q == pytest.approx(r.p, abs=1e-6) for r in rows)
    assert rows[-1].w == pytest.approx(1) and rows[0].w == pytest.approx(-1)
    half = one(spark, S.w_gaussian(F.lit(0.4), a, s))[0]
    assert half == pytest.approx(0.5, abs=1e-6)


def test_spheroidal_column_equals_driver_value(spark):
    rows = spark.range(0, 120, 7).select((F.col("id") / 100).alias("nu"), S.spheroidal(F.col("id") / 100).alias("v")).collect()
    assert all(r.v == pytest.approx(S.spheroidal_value(r.nu)) for r in rows)


def test_blockage_of_equal_and_nested_dishes(spark):
    apart = one(spark, *S.blockage(F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(12.0), F.lit(12.0)))
    behind = one(spark, *S.blockage(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(12.0), F.lit(6.0)))
    assert list(apart) == [0.0, 0.0] and list(behind) == [pytest.approx(0.25), 0.0]


def test_separation_of_offsets_is_small_angle(spark):
    got = one(spark, S.separation(F.lit(1.0), F.lit(-0.5), F.lit(1.0), F.lit(-0.5 + 1e-9)))[0]
    assert got == pytest.approx(1e-9, rel=1e-6)


def test_image_names(spark):
    df = spark.createDataFrame([("image.x.facet.1.2.taylor.3",), ("image.src",), ("image.a.b.taylor.0",)], "n string").select(*parse_image_name("n"))
    assert [tuple(r) for r in df.collect()] == [("x", 1, 2, 3), ("src", None, None, None), ("a.b", None, None, 0)]


def test_parset():
    p = parset.parse("a = 1\nb.c = [1, 2.5, [x, 'y z']]  # note\nd = true\ne = \"10arcsec\"\nf = 1, \\\n 2\n")
    assert p == {"a": 1, "b.c": [1, 2.5, ["x", "y z"]], "d": True, "e": "10arcsec", "f": "1,   2"}
    assert parset.quantity("10arcsec") == pytest.approx(10 * math.pi / 648000) and parset.quantity("45%") == 0.45
    assert parset.subset({"x.a": 1, "y.b": 2}, "x.") == {"a": 1}
    with pytest.raises(ValueError):
        parset.quantity("10Jy", "arcsec")
