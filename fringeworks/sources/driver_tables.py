"""Radio-shaped views over the star-schema tables: the inputs of the catalogue's queries.

Each view is a projection that Catalyst folds into the scan. The same text
serves as common table expressions for the SQL twin of a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIS = """SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 36 AS INT) AS antenna1, CAST(l_partkey % 36 AS INT) AS antenna2,
 CAST(l_linenumber - 1 AS INT) AS feed1, CAST(CASE WHEN l_partkey % 50 = 0 THEN l_linenumber % 7 ELSE l_linenumber - 1 END AS INT) AS feed2,
 CAST(l_orderkey % 12 AS INT) AS scan, CAST(l_suppkey % 25 AS INT) AS field_id,
 CAST(((EXTRACT(YEAR FROM l_shipdate) * 12 + EXTRACT(MONTH FROM l_shipdate)) * 31 + EXTRACT(DAY FROM l_shipdate)) AS DOUBLE) * 86400 AS time_s,
 CAST(l_quantity AS INT) % 16 AS chan, CAST(1.1e9 AS DOUBLE) + 1e6 * (CAST(l_quantity AS INT) % 16) AS freq,
 CASE WHEN l_linestatus = 'O' THEN 'XX' ELSE 'YY' END AS pol,
 CAST(l_partkey % 2001 - 1000 AS DOUBLE) AS u, CAST(l_orderkey % 2001 - 1000 AS DOUBLE) AS v, CAST((l_suppkey * 7) % 201 - 100 AS DOUBLE) AS w,
 l_discount * 10 - CAST(0.5 AS DOUBLE) AS re, l_tax * 10 - CAST(0.4 AS DOUBLE) AS im, 1 + l_tax * 10 AS sigma, l_returnflag = 'R' AS flag
FROM lineitem"""
TS = """SELECT event_id, CAST(user_id % 7 AS INT) AS beam, CAST(user_id % 36 AS INT) AS antenna,
 CAST((EXTRACT(DAY FROM ts) * 86400 + EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60 + FLOOR(EXTRACT(SECOND FROM ts))) AS DOUBLE) AS time_s,
 value, event_type = 'error' AS flag FROM events"""
VIS_POL = """SELECT t.event_id AS row_id, CAST(t.event_id % 36 AS INT) AS antenna1, t.antenna AS antenna2, t.beam, t.time_s, CAST(p.pol AS INT) AS pol,
 t.value * (p.pol + 1) / 100 AS re, t.value * (3 - p.pol) / 200 AS im, (t.flag AND p.pol < 3) OR (t.event_id % 11 = 0 AND p.pol = 1) AS flag
 FROM ts t CROSS JOIN (SELECT 0 AS pol UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p"""
GAINS = """SELECT antenna, CAST(FLOOR(time_s / 172800) * 172800 AS DOUBLE) AS time_s, CAST(1 + AVG(value) / 1000 AS DOUBLE) AS g_re,
 CAST(AVG(value) / 2000 AS DOUBLE) AS g_im, MAX(CASE WHEN flag THEN 0 ELSE 1 END) = 1 AS valid
 FROM ts GROUP BY antenna, CAST(FLOOR(time_s / 172800) * 172800 AS DOUBLE)"""
IMAGE_SPARK = "SELECT CAST(label AS INT) img, CAST(vec_id AS INT) y, CAST(p AS INT) x, CAST(e AS DOUBLE) value FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, e"
IMAGE_SQL = "SELECT CAST(label AS INT) img, CAST(vec_id AS INT) y, CAST(p - 1 AS INT) x, CAST(e AS DOUBLE) value FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings)"
VIEWS = {"vis": (VIS, VIS), "ts": (TS, TS), "vis_pol": (VIS_POL, VIS_POL), "gains": (GAINS, GAINS), "image": (IMAGE_SPARK, IMAGE_SQL)}
_NEEDS = {"vis_pol": ["ts"], "gains": ["ts"]}
_BASE = {"vis": ["lineitem"], "ts": ["events"], "image": ["embeddings"]}


def ctes(*names: str) -> str:
    """WITH clause of the SQL twin."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A base table or a view; each is applied to the base tables, before the view's expressions."""
    if name not in VIEWS:
        return each(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    text = VIEWS[name][0]
    frames = {}
    for need in _NEEDS.get(name, []) + _BASE.get(name, []):
        frames[need] = table(spark, sf_dir, need, each)
    for need, df in frames.items():
        alias = f"{{{need}}}"
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {need}", f"{word} {alias}")
    return spark.sql(text, **frames)
