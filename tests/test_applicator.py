"""Solutions by antenna, beam and channel, and the policies that take them for more than their own."""

import pytest
from pyspark.sql import functions as F

from fringeworks.functions.complexcols import Cx
from fringeworks.operators import jones as Z


@pytest.mark.parametrize(("beams", "chans"), [(False, False), (True, False), (False, True), (True, True)])
def test_policies(spark, beams, chans):
    gain = lambda a, b, c: (1 + 0.1 * a + 0.01 * b) * complex(1, 0.05 * c)
    solutions = [(a, b, c, gain(a, b, c).real, gain(a, b, c).imag, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, not (a == 2 and b == 0 and c == 0)) for a in range(3) for b in range(2) for c in range(2)]
    s = spark.createDataFrame(solutions, "antenna int, beam int, chan int, " + ", ".join(f"{p}_{x} double" for p in Z.PARAMETERS for x in ("re", "im")) + ", valid boolean")
    rows = [(a1, a2, b, c, 2.0, -1.0) for a1 in range(4) for a2 in range(4) if a1 < a2 for b in range(3) for c in range(2)]
    df = spark.createDataFrame(rows, "antenna1 int, antenna2 int, beam int, chan int, re double, im double")
    joined, j1, j2, ok = Z.with_solutions(df, s, beam_independent=beams, channel_independent=chans)
    none = Cx.of(0.0)
    out = Z.applied(joined, (Cx.of("re", "im"), none, none, none), j1, j2, ok, F.lit(False)).collect()
    assert len(out) == len(rows)
    for r in out:
        b, c = 0 if beams else r.beam, 0 if chans else r.chan
        there = max(r.antenna1, r.antenna2) < 3 and b < 2 and not (b == 0 and c == 0 and 2 in (r.antenna1, r.antenna2))
        assert r.flag == (not there), r
        want = complex(2, -1) / (gain(r.antenna1, b, c) * gain(r.antenna2, b, c).conjugate()) if there else 0
        assert complex(r.v0_re, r.v0_im) == pytest.approx(want, abs=1e-12)
