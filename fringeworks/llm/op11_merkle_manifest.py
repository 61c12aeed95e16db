"""Merkle manifest of a data set: leaves, roots and audit paths of all documents.

Every document is a leaf, every language a binary tree over its leaves by
doc_id, and a tree over the languages' roots gives the root. Leaves are native
expressions. Their places come from a range shuffle of 32-byte hashes (texts
never move). Aligned blocks of 256 leaves become rows; a block's root is a
node of the tree above, whose blocks are rows again, until one node is left.
Paths come back down: in a block the traversal of Merkle trees emits them leaf
by leaf, advancing treehash stacks (2 H - 1 steps a leaf, lowest tail first), so
that it holds O(H) nodes beside its block; what lies above is the same for the
whole block and appended.

Nulls: a null in a column is `-` in its leaf; the null language is a tree of
its own and comes first, null doc_ids come first in theirs. Empty texts are
`0:`. Ties: equal doc_ids are ordered by leaf; equal rows are leaves of their
own, with equal hashes and different paths. Very long texts are hashed in the
JVM, row by row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

#: A block has 2**BITS leaves, unless the caller says otherwise.
BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    return (n - 1).bit_length()


class Treehash:
    """The node of a height above the leaves from start on, one step at a time; None if there are no such leaves."""

    __slots__ = ("leaves", "height", "at", "end", "stack")

    def __init__(self, leaves: list[bytes], start: int, height: int):
        self.leaves, self.height, self.at, self.end, self.stack = leaves, height, start, min(len(leaves), start + (1 << height)), []
        if start >= len(leaves):
            self.stack.append((height, None))

    @property
    def tail(self) -> float:
        """Height of the lowest node on the stack: the stack to be served first has the least."""
        if not self.stack:
            return self.height
        return float("inf") if self.stack[-1][0] == self.height else self.stack[-1][0]

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (h, right), (_, left) = stack.pop(), stack.pop()
            stack.append((h + 1, H(left, right)))
        elif self.at < self.end:
            stack.append((0, self.leaves[self.at]))
            self.at += 1
        else:  # the last node of its level is alone
            h, node = stack.pop()
            stack.append((h + 1, H(node)))

    def node(self) -> bytes | None:
        while self.tail != float("inf"):
            self.step()
        return self.stack[0][1]


def root_of(leaves: list[bytes], levels: int) -> bytes:
    return Treehash(leaves, 0, levels).node()


def traversed(leaves: list[bytes], levels: int):
    """Each leaf's siblings, lowest first, None where there is none. One list serves all leaves: copy it to keep it."""
    auth = [Treehash(leaves, 1 << h, h).node() for h in range(levels)]
    stacks = [Treehash(leaves, 0, h) for h in range(levels)]
    for s in stacks:
        s.node()
    for leaf in range(1, len(leaves) + 1):
        yield auth
        for h in range(levels):
            if leaf & ((1 << h) - 1):
                break
            auth[h] = stacks[h].node()
            stacks[h] = Treehash(leaves, (leaf + (1 << h)) ^ (1 << h), h)
        for _ in range(2 * levels - 1):
            s = min(stacks, key=lambda s: s.tail)
            if s.tail == float("inf"):
                break
            s.step()


def entries(auth: list[bytes | None], leaf: int) -> list[tuple[str, bytes]]:
    """(side, sibling) by level: L or R of the node, N where it has none."""
    return [("N", b"") if a is None else ("L" if leaf >> h & 1 else "R", a) for h, a in enumerate(auth)]


def folded(node: bytes, path: list[tuple[str, bytes]]) -> bytes:
    for side, sibling in path:
        node = H(sibling, node) if side == "L" else H(node, sibling)
    return node


def _written(path: list[tuple[str, bytes]]) -> str:
    return ",".join(side + sibling.decode() for side, sibling in path)


def _read(path: str) -> list[tuple[str, bytes]]:
    return [(x[0], x[1:].encode()) for x in path.split(",")] if path else []


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def tampers(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """key (the language, sortable with null first), doc_id, h (the leaf's hash), changed (the tampered leaf's, null where equal)."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1

    def leaf(n: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*(_field(n if f == "n_chars" else F.col(f)) for f in FIELDS)), 256))

    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("n_chars")).alias("h"),
        F.when(tampers(F.col("doc_id")) & F.col("n_chars").isNotNull(), leaf(more)).alias("changed"),
    ).withColumn("tie", F.monotonically_increasing_id())


def placed(rows: DataFrame, order: list[Column], scratch: Scratch, few: bool = False) -> DataFrame:
    """rows with pos, the place from 0 within its key by order, and n, the key's number of rows.

    Rows are range-partitioned by key and order; what a task holds of a key is
    a run, and one row a run tells where it begins: no key is ever one task.
    """
    ranked = scratch.save(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()), few)
    ranked = ranked.withColumn("part", F.shiftright("at", 33))
    runs = ranked.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    runs = runs.selectExpr("key", "part", "sum(rows) OVER (PARTITION BY key ORDER BY part) - rows - first AS shift", "sum(rows) OVER (PARTITION BY key) AS n")
    return ranked.join(runs, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame, payload: list[str], scratch: Scratch, few: bool, bits: int) -> DataFrame:
    """key, block, n, items: 2**bits consecutive nodes of a key (key, pos, n, h and the payload) as one row."""
    item = F.struct(F.expr(f"cast(pos & {(1 << bits) - 1} as int)").alias("i"), "h", *payload)
    return scratch.save(nodes.groupBy("key", F.shiftright("pos", bits).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items")), few)


def _hashes(items) -> list[list[bytes]]:
    """The hex hashes of each block of a column of items."""
    flat, at = [x.hex().encode() for x in items.flatten().field("h").to_pylist()], 0
    out = []
    for n in items.value_lengths().to_pylist():
        out.append(flat[at : at + n])
        at += n
    return out


def _levels(n: int, bits: int) -> int:
    """Levels inside a block of a tree of n nodes."""
    return min(bits, height(n))


def _roots(blocks: DataFrame, bits: int) -> DataFrame:
    """The nodes above blocks: key, pos, n, h."""

    def run(it):
        for b in it:
            n = b.column(2).to_pylist()
            h = [bytes.fromhex(root_of(x, _levels(m, bits)).decode()) for x, m in zip(_hashes(b.column(3)), n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-(-m >> bits) for m in n], pa.int64()), pa.array(h, pa.binary())], ["key", "pos", "n", "h"])

    return blocks.select("key", "block", "n", "items").mapInArrow(run, "key string, pos long, n long, h binary")


def _paths(blocks: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """key, pos, path, subroot of every node in blocks; upper has the same of the nodes above."""

    def run(it):
        for b in it:
            key, block, n, _, path, subroot = (b.column(i).to_pylist() if i != 3 else None for i in range(6))
            rows = [(k, (at << bits) + i, ",".join(filter(None, (_written(entries(a, i)), up))), top) for k, at, m, x, up, top in zip(key, block, n, _hashes(b.column(3)), path, subroot, strict=True) for i, a in enumerate(traversed(x, _levels(m, bits)))]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("key", pa.string()), ("pos", pa.int64()), ("path", pa.string()), ("subroot", pa.string())))})

    return _under(blocks, upper).mapInArrow(run, "key string, pos long, path string, subroot string")


def _under(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    return blocks.join(upper.withColumnRenamed("pos", "block"), ["key", "block"]).select("key", "block", "n", "items", "path", "subroot")


def climbed(nodes: DataFrame, payload: list[str], scratch: Scratch, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all levels from the nodes' own on, and every key's root: key, level, h."""
    tables, tops, at_level = [], [], nodes
    most = None
    while most is None or most > 1:
        few = bool(tables)
        blocks = _blocks(at_level, [] if few else payload, scratch, few, bits)
        above = scratch.save(_roots(blocks, bits), True)
        tables.append(blocks)
        tops.append(above.where("n = 1").select("key", F.lit(len(tables)).alias("level"), "h"))
        most = above.agg(F.max("n")).first()[0] or 1
        at_level = above.where("n > 1")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return tables, out


def _descended(tables: list[DataFrame], tops: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """key, pos, path, subroot of the nodes above the first table; tops: key, level, path, subroot of the keys' roots."""

    def ends(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("key", F.lit(0).cast("long").alias("pos"), "path", "subroot")

    upper = ends(len(tables))
    for level in range(len(tables) - 1, 0, -1):
        upper = scratch.save(_paths(tables[level], upper, bits).unionByName(ends(level)), True)
    return upper


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = scratch.save(leaves(docs))
    nodes = placed(own, [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("tie")], scratch)
    tables, subroots = climbed(nodes, ["doc_id", "changed"], scratch, bits)
    scratch.drop(own)

    # the tree of the languages' roots: the same, with one key
    langs = scratch.save(subroots.select(F.lit("").alias("key"), F.col("key").alias("lang"), "level", "h"), True)
    over, top = climbed(placed(langs, [F.asc("lang")], scratch, True), ["lang", "level"], scratch, bits)
    root = (top.first() or {"h": b""})["h"].hex()
    above = _paths_of_langs(over[0], _descended(over, top.select("key", "level", F.lit("").alias("path"), F.lit(root).alias("subroot")), scratch, bits), bits)
    upper = _descended(tables, scratch.save(above, True), scratch, bits)
    return _under(tables[0], upper).mapInArrow(_result(root.encode(), bits), SCHEMA)


def _paths_of_langs(blocks: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """key, level, path, subroot of every language's root."""

    def run(it):
        for b in it:
            rows = []
            items = b.column(3).to_pylist()
            for x, m, item, up in zip(_hashes(b.column(3)), b.column(2).to_pylist(), items, b.column(4).to_pylist(), strict=True):
                for i, a in enumerate(traversed(x, _levels(m, bits))):
                    rows.append((item[i]["lang"], item[i]["level"], ",".join(filter(None, (_written(entries(a, i)), up))), x[i].decode()))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("key", pa.string()), ("level", pa.int32()), ("path", pa.string()), ("subroot", pa.string())))})

    return _under(blocks, upper).mapInArrow(run, "key string, level int, path string, subroot string")


def _result(root: bytes, bits: int):
    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 16):
                yield rows(b.slice(at, 16))

    def rows(b):
        items, out = b.column(3), []
        flat = items.flatten()
        ids, changed, at = flat.field("doc_id").to_pylist(), flat.field("changed").to_pylist(), 0
        for x, m, path, subroot in zip(_hashes(items), b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            up = _read(path)
            shared = b"".join(s for _, s in up)
            for i, a in enumerate(traversed(x, _levels(m, bits))):
                own = entries(a, i)
                got = folded(x[i] if changed[at] is None else changed[at].hex().encode(), own + up)
                out.append((ids[at], x[i].decode(), subroot, root.decode(), H(*(s for _, s in own), shared).decode(), got.decode(), got == root))
                at += 1
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


def _sql() -> str:
    """Levels of both trees by recursion on whole levels; crc32 by its definition, bit by bit."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(n: str) -> str:
        return f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field(n)} || {field('text')})"

    crc = """(4294967295 - list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda a, b: CASE WHEN b < 256 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""
    levels = """{0} AS (
  SELECT key, pos, h, 0 AS level, n FROM {1}
  UNION ALL
  SELECT key, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value(level) + 1, (any_value(n) + 1) // 2 FROM {0} WHERE n > 1 GROUP BY key, pos // 2
)"""
    return f"""
WITH RECURSIVE rows AS (
  SELECT coalesce('=' || lang, '-') AS key, doc_id, {leaf("n_chars")} AS h,
    CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS tampered
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM rows
), {levels.format("tree", "placed")}, subroots AS MATERIALIZED (
  SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, h, count(*) OVER () AS n, key AS lang, level FROM tree WHERE n = 1
), {levels.format("high", "subroots")}, walk AS (
  SELECT p.key, p.doc_id, p.h AS leaf, p.pos, p.tampered AS node, '' AS proof, 0 AS level, FALSE AS up, s.pos AS lang_pos, s.level AS levels, s.h AS subroot FROM placed p JOIN subroots s ON s.lang = p.key
  UNION ALL
  SELECT w.key, w.doc_id, w.leaf,
    CASE WHEN up OR level < levels THEN w.pos // 2 ELSE lang_pos END,
    CASE WHEN NOT up AND level = levels THEN w.node WHEN w.pos % 2 = 1 THEN sha256(coalesce(t.h, u.h, '') || w.node) ELSE sha256(w.node || coalesce(t.h, u.h, '')) END,
    proof || CASE WHEN NOT up AND level = levels THEN '' ELSE coalesce(t.h, u.h, '') END,
    CASE WHEN NOT up AND w.level = levels THEN 0 ELSE w.level + 1 END, up OR w.level = levels, lang_pos, levels, subroot
  FROM walk w
  LEFT JOIN (SELECT key, pos, level AS at, h FROM tree) t ON NOT w.up AND w.level < w.levels AND t.key = w.key AND t.at = w.level AND t.pos = xor(w.pos, 1)
  LEFT JOIN (SELECT pos, level AS at, h FROM high) u ON w.up AND u.at = w.level AND u.pos = xor(w.pos, 1)
  WHERE NOT w.up OR w.level < (SELECT max(level) FROM high)
)
SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT h FROM high WHERE n = 1) AS verified
FROM walk WHERE up AND level = (SELECT max(level) FROM high)"""


SQL = _sql()
