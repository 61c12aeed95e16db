"""Order-free comparison of two results, floats as rounded text, nulls as one value."""

import math


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x) or type(x).__name__ in ("NAType", "NaTType"):
        return "null"
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return f"{float(x) + 0.0:.6f}".replace("-0.000000", "0.000000")
    if type(x).__name__ in ("bool_", "bool"):
        return str(bool(x))
    return str(x)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_cell(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False))
