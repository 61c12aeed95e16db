"""N-gram Jaccard join by token-combination prefixes.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of 0.75 or more; a component is what links connect.

Equal sets are one set from the start. Tokens (shingles) have a global order,
rare ones first. Sets of n >= m tokens that link share 3 (n + m) / 7 or more.
So the larger one's first n / 4 + 1 tokens and the smaller one's first m / 7 + 1
share a token. Every set puts the longer prefix into the index; entries within
the shorter one may be the smaller side of a pair, and a bucket without any
such entry holds no pair at all. Rare prefix tokens are indexed singly. Sets
whose prefix reaches frequent tokens extend it by g tokens: then two similar
sets share g + 1 tokens of the extended prefixes. Frequent tokens fall into g
groups, so one group holds two shared ones, and the pairs of frequent tokens
within a group are indexed. g follows from the size class of the smaller set;
the larger one writes entries for every class that a smaller set may have.

Candidates are verified twice. First every indexed entry meets the first set of
its bucket, which is linear in the index and settles most groups of near copies.
Then buckets whose sets are still in several components are opened. For single
tokens, pairs across components are formed, cut by size and by the number of
shared prefix tokens (an exact bound), and verified on whole sets. Combinations
would show such pairs dozens of times each: there the components that open
buckets join are scanned in blocks, the sets outside the largest component
against all whose size may do, by an index of their tokens; no pair is a row.

The order of tokens decides only how large buckets get. Which tokens are
frequent comes from blocks of documents that hold a token at least MIN_LOCAL
times, summed over all, and reaches the executors as a table of a byte a slot.
A token that is spread so thinly that no block sees it twice shows by its
bucket: tokens whose open buckets hold more than CROWD sets become frequent
too, and the index is made again, so no bucket of more sets is ever paired.

A set goes by a 64-bit name; where two sets share one, found by a second name
over all documents, both go by the second.

Null and empty texts have no shingles and link with nothing. A null doc_id
takes part but is no component's id unless nothing else is in it. Repeated
rows are copies; a doc_id with several texts is several documents. Very long
texts are hashed a few at a time. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, looked_up, pieces, same, slot_table
from .graph import components

WORDS = 5
#: Tokens that a block counts at once; documents of a block that must hold a token; sum from which it is frequent.
BLOCK_TOKENS, MIN_LOCAL, FREQUENT = 4_000_000, 2, 16
#: Sets of an open bucket, beyond which its token counts as frequent.
CROWD = 1000
#: Sets of a block of the scan: those looked for, and those looked through.
SOUGHT_BLOCK, SCANNED_BLOCK = 512, 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> _S29
    x *= _B
    x ^= x >> _S32
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time: the working arrays stay in the processor's cache.
CHUNK = 1 << 17


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of every word, in order; number of words of each text): sums over a word of mixed (place, byte) numbers."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    at = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(at, ends)]))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    place = np.arange(at[0], len(data))
    place -= np.repeat(at, np.diff(np.append(at, len(data))))
    v = _mix((place << 8).view(np.uint64) + data[at[0] :] + np.uint64(1))
    v[gap[at[0] :]] = 0
    return _mix(np.add.reduceat(v, at - at[0])), counts


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    h, n = word_hashes(texts)
    whole = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        whole = np.full(m, 5, np.uint64)
        for k in range(WORDS):
            whole = _mix(whole * np.uint64(31) + h[k : k + m])
    out, at = [], 0
    for k in n.tolist():
        if k >= WORDS:
            s = np.sort(whole[at : at + k - WORDS + 1])
            new = s[1:] != s[:-1]
            if not new.all():
                s = s[np.concatenate([[True], new])]
        else:
            s = np.array([100 + k] if k else [], np.uint64)
            for x in h[at : at + k]:
                s = _mix(s * np.uint64(31) + x)
        out.append(s)
        at += k
    return out


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; their number per text)."""
    out, part, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        if part and size + len(raw) > CHUNK:
            out += _hashed(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        out += _hashed(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def set_ids(tokens: np.ndarray, n: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names per set; equal sets have equal names, the empty set 0. First names in shared give way to the second."""
    at = np.cumsum(n) - n
    full = np.flatnonzero(n > 0)
    out, second = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        m = _mix(tokens ^ _S29)
        out[full] = _mix(np.add.reduceat(m, at[full]) + _B * n[full].astype(np.uint64)) ^ np.bitwise_xor.reduceat(_mix(m + _A), at[full])
        m *= _A
        m ^= m >> _S29
        second[full] = _mix(np.add.reduceat(m, at[full]))
        if shared is not None and len(shared):
            out = np.where(np.isin(out, shared), second, out)
    return out, second


def _first_pass(it):
    """kind 0: (doc_id, set, size, hash of the text, second name) of each document; kind 1: (signature, count) of each token that a block has often."""
    held, ids, met = [], 0, set()

    def counted():
        tokens, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= MIN_LOCAL
        zero = np.zeros(often.sum(), np.int64)
        return _rows(1, token_signatures(tokens[often]).view(np.int64), count[often].astype(np.int64), zero, zero, zero)

    def _rows(kind, a, *rest):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(x if isinstance(x, pa.Array) else pa.array(x) for x in (a, *rest))], ["kind", "a", "b", "n", "th", "second"])

    for batch in pieces(it, 2):
        tokens, n = shingle_sets(batch.column(2).to_pylist())
        sid, second = set_ids(tokens, n)
        yield _rows(0, batch.column(0), sid.view(np.int64), n.astype(np.int64), batch.column(1), second.view(np.int64))
        for i, part in enumerate(np.split(tokens, np.cumsum(n)[:-1]) if len(n) else []):
            if len(part) and sid[i] not in met:
                met.add(sid[i])
                held.append(part)
                ids += len(part)
        if ids >= BLOCK_TOKENS:
            yield counted()
            held, ids, met = [], 0, set()
    if held:
        yield counted()


def token_signatures(tokens: np.ndarray) -> np.ndarray:
    """Names of the buckets of single tokens: even numbers; those of combinations are odd."""
    return _mix(tokens ^ _B) & ~np.uint64(1)


def size_class(n: int) -> int:
    return max(0, int(n).bit_length() - 1)


def combination_signatures(tokens: np.ndarray, frequent_from: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(signatures, whether the set may be the smaller one) of frequent tokens for every size class that a smaller similar set may have; tokens in global order."""
    prefix, short = n // 4 + 1, n // 7 + 1
    out, roles = [], []
    for c in range(size_class(-(-3 * n // 4)), size_class(n) + 1):
        salt = np.uint64((c + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF)
        own_class = c == size_class(n)
        if c < 3:  # so few tokens that one of them must do
            own = tokens[frequent_from:prefix]
            out.append(_mix(own + salt))
            roles.append((np.arange(frequent_from, frequent_from + len(own)) < short) & own_class)
            continue
        groups = (1 << c) // 8
        own = tokens[frequent_from : prefix + groups]
        place = np.arange(frequent_from, frequent_from + len(own))
        group = ((own >> np.uint64(7)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((own, group))
        own, group, place = own[order], group[order], place[order]
        # pairs at distance 1, 2, ... while any group is so long
        for step in range(1, len(own)):
            twin = np.flatnonzero(group[step:] == group[:-step])
            if not len(twin):
                break
            out.append(_mix(_mix(own[twin] + salt) * np.uint64(31) + own[twin + step]))
            roles.append((np.maximum(place[twin], place[twin + step]) < short + groups) & own_class)
    return out, roles


def _index(table, shared):
    """(sig, set, nq): index entries, nq 0 if the set may be the smaller one of a pair there, else 1; and a row for each set, nq its size << 32 | number of single entries."""

    def run(it):
        classes = table.value
        met: set = set()
        for batch in pieces(it, 0):
            tokens, n = shingle_sets(batch.column(0).to_pylist())
            sid, _ = set_ids(tokens, n, shared)
            if not len(tokens):
                continue
            sig = token_signatures(tokens)
            cls = looked_up(classes, sig)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((tokens, cls, doc))
            tokens, cls, sig = tokens[order], cls[order], sig[order]
            rare = np.bincount(doc, weights=cls == 0, minlength=len(n)).astype(np.int64)
            begins = np.cumsum(n) - n
            prefix = n // 4 + 1
            fresh = np.array([s not in met and k > 0 and not met.add(s) for s, k in zip(sid.tolist(), n.tolist(), strict=True)])
            q = np.where(fresh, np.minimum(prefix, rare), 0)
            place = np.arange(len(tokens)) - np.repeat(begins, n)
            single = place < np.repeat(q, n)
            sigs = [sig[single]]
            sids = [np.repeat(sid, q)]
            roles = [place[single] < np.repeat(n // 7 + 1, q)]
            for i in np.flatnonzero(fresh & (prefix > rare)):
                for s, r in zip(*combination_signatures(tokens[begins[i] : begins[i] + n[i]], int(rare[i]), int(n[i])), strict=True):
                    sigs.append(s | np.uint64(1))
                    sids.append(np.full(len(s), sid[i]))
                    roles.append(r)
            at = np.flatnonzero(fresh)
            sigs.append(sid[at])
            sids.append(sid[at])
            nq = np.concatenate([(~np.concatenate(roles)).astype(np.int64), n[at] << 32 | np.minimum(prefix, rare)[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(sids).view(np.int64)), pa.array(nq)], ["sig", "sid", "nq"])

    return run


def _buckets(it):
    """Rows sorted by (sig, nq, sid): entries of buckets that may hold a pair, with the bucket's first set; the sets' own rows.

    The first entry of a bucket tells whether any set there may be a smaller
    one. Of a bucket the stream keeps that entry only.
    """
    sig, rep, role, alone = None, 0, 0, False
    for b in it:
        g, s, nq = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        m = np.flatnonzero(nq > 1)
        if len(m):
            yield _bucket_rows(g[m], s[m], s[m], nq[m])
        e = np.flatnonzero(nq <= 1)
        if not len(e):
            continue
        g, s, nq = g[e], s[e], nq[e]
        goes_on = sig is not None and int(g[0]) == sig
        if goes_on:
            g, s, nq = np.concatenate([[sig], g]), np.concatenate([[rep], s]), np.concatenate([[role], nq])
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(g)))
        first = np.repeat(s[at], lengths)
        again = np.zeros(len(g), bool)
        again[1:] = ~new[1:] & (s[1:] == s[:-1])  # the same set from several tasks
        several = np.logical_or.reduceat(s != first, at)
        tell = np.repeat(several & (nq[at] == 0), lengths) & ~again
        if goes_on and not alone:
            tell[0] = False  # told before
        sig, rep, role, alone = int(g[-1]), int(first[-1]), int(nq[at[-1]]), not several[-1] and (not goes_on or len(at) > 1 or alone)
        t = np.flatnonzero(tell)
        if len(t):
            yield _bucket_rows(g[t], s[t], first[t], nq[t])


def _bucket_rows(g, s, r, nq):
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(r), pa.array(nq)], ["sig", "sid", "rep", "nq"])


def _sets(wanted, shared):
    """(sid, tokens) of the wanted sets, once per task; a few others may slip in."""

    def run(it):
        table, met = wanted.value, set()
        for batch in pieces(it, 0):
            tokens, n = shingle_sets(batch.column(0).to_pylist())
            sid, _ = set_ids(tokens, n, shared)
            want = looked_up(table, sid) > 0 if len(sid) else np.zeros(0, bool)
            ids, parts = [], []
            for i, part in enumerate(np.split(tokens, np.cumsum(n)[:-1]) if len(n) else []):
                if want[i] and n[i] and sid[i] not in met:
                    met.add(sid[i])
                    ids.append(int(sid[i].astype(np.int64)))
                    parts.append(part.tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], ["sid", "tokens"])

    return run


def _verified(it):
    for b in it:
        a, c = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        keep = []
        last, x = None, None
        for i, (s, t) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            if a[i] != last:
                last, x = a[i], np.frombuffer(s.as_buffer(), "<u8")
            y = np.frombuffer(t.as_buffer(), "<u8")
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(large, small)
            common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if 100 * common >= 75 * (len(x) + len(y) - common):
                keep.append(i)
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], ["a", "b"])


def whole_sets(names: DataFrame, texts: DataFrame, shared: np.ndarray, scratch: Scratch) -> DataFrame:
    """(sid, tokens) of the sets in names (sid, a written table), made again from the texts; a few others may slip in."""
    wanted = texts.sparkSession.sparkContext.broadcast(slot_table(names, "sid"))
    sets = scratch.save(texts.mapInArrow(_sets(wanted, shared), "sid long, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens")))
    wanted.destroy()
    return sets


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set names, those that are similar, on whole sets."""
    left = pairs.join(sets.withColumnsRenamed({"sid": "a", "tokens": "x"}), "a")
    both = left.join(sets.withColumnsRenamed({"sid": "b", "tokens": "y"}), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verified, "a long, b long")


def _scan(t: pa.Table) -> pa.Table:
    """Links of a block's sought sets to its scanned sets of other components: one for each component."""
    if not t.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sought = t.column("sought").to_numpy(zero_copy_only=False)
    sid, label = t.column("sid").to_numpy(), t.column("label").to_numpy()
    tokens = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("tokens")]
    xs, ys = np.flatnonzero(sought), np.flatnonzero(~sought)
    out: dict[tuple[int, int], int] = {}
    if len(xs) and len(ys):
        owner = np.repeat(np.arange(len(xs)), [len(tokens[i]) for i in xs])
        every = np.concatenate([tokens[i] for i in xs])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        size, mine = np.array([len(tokens[i]) for i in xs]), label[xs]
        for j in ys:
            y = tokens[j]
            low, high = np.searchsorted(every, y), np.searchsorted(every, y, side="right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(xs))
            for i in np.flatnonzero((100 * common >= 75 * (size + len(y) - common)) & (mine != label[j])):
                out.setdefault((int(sid[xs[i]]), int(label[j])), int(sid[j]))
    return pa.table({"a": pa.array([k[0] for k in out], pa.int64()), "b": pa.array(list(out.values()), pa.int64())})


def scan_groups(still: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, sid, label, sought) of the sets in open buckets (sig, sid, label): groups are components joined by buckets.

    All but the largest component of a group are sought in the whole group.
    """
    low = still.groupBy("sig").agg(F.min("label").alias("low"))
    bridges = still.select("sig", "label").distinct().join(low, "sig").where("label <> low").select(F.col("low").alias("a"), F.col("label").alias("b")).distinct()
    groups = components(bridges, scratch)
    members = still.select("sid", "label").distinct().join(groups.select(F.col("id").alias("label"), F.col("label").alias("grp")), "label")
    members = scratch.save(members, few=True)
    largest = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("grp").agg(F.max_by("label", F.struct("k", "label")).alias("top"))
    return members.join(largest, "grp").select("grp", "sid", "label", (F.col("label") != F.col("top")).alias("sought"))


def scanned(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of a group, block against block.

    Sizes fall into bands a factor of 4 / 3 apart: a sought set goes to its own
    band and both neighbours, a scanned one to its own.
    """
    tokens = F.octet_length("tokens") / 8
    m = members.join(sets, "sid").withColumn("band", F.floor(F.log(tokens) / F.log(F.lit(4 / 3))).cast("int"))
    x = m.where("sought").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    size = lambda df, block, name: df.groupBy("grp", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = size(x.select("grp", "band"), SOUGHT_BLOCK, "nx").join(size(m.select("grp", "band"), SCANNED_BLOCK, "ny"), ["grp", "band"])
    part = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = x.join(blocks, ["grp", "band"]).select("grp", "band", part("nx").alias("xb"), every("ny").alias("yb"), F.lit(True).alias("sought"), "sid", "label", "tokens")
    y = m.join(blocks, ["grp", "band"]).select("grp", "band", every("nx").alias("xb"), part("ny").alias("yb"), F.lit(False).alias("sought"), "sid", "label", "tokens")
    return x.unionByName(y).groupBy("grp", "band", "xb", "yb").applyInArrow(_scan, "a long, b long")


def _possible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b, singles, combos) that size and shared prefix tokens allow.

    Overlap must be at least 3/7 of both sizes' sum. singles are the shared
    tokens among the smaller one's first n / 7 + 1 and the larger one's single
    entries. What comes after the earlier of these two ends can add no more than
    the longer of both rests; combinations show nothing of the kind.
    """
    for end in "ab":
        pairs = pairs.join(sizes.select(F.col("sid").alias(end), F.col("n").alias(f"n{end}"), F.col("q").alias(f"q{end}")), end)
    need = F.ceil(3 * (F.col("na") + F.col("nb")) / 7)
    fits = 4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")
    rest = lambda small, large: F.greatest(F.col(f"n{small}") - F.least(F.floor(F.col(f"n{small}") / 7) + 1, F.col(f"q{small}")), F.col(f"n{large}") - F.col(f"q{large}"))
    enough = F.col("singles") + F.when(F.col("na") <= F.col("nb"), rest("a", "b")).otherwise(rest("b", "a")) >= need
    return pairs.where(fits & ((F.col("combos") > 0) | enough)).select("a", "b")


def _counts() -> list:
    combo = F.col("sig").bitwiseAND(F.lit(1))
    return [F.sum((combo == 0).cast("long")).alias("singles"), F.sum((combo == 1).cast("long")).alias("combos")]


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sid"))


def _opened(texts: DataFrame, often: DataFrame, shared: np.ndarray, scratch: Scratch) -> tuple:
    """(sizes, links, labels, still): the sets' sizes, what the first sets of buckets settle, and the entries of buckets still open."""
    table = texts.sparkSession.sparkContext.broadcast(slot_table(often, "t", "v"))
    entries = texts.mapInArrow(_index(table, shared), "sig long, sid long, nq long")
    index = scratch.save(entries.repartition("sig").sortWithinPartitions("sig", "nq", "sid").mapInArrow(_buckets, "sig long, sid long, rep long, nq long"))
    table.destroy()
    scratch.free()
    sizes = index.where("nq > 1").groupBy("sid").agg(F.max("nq").alias("nq")).select("sid", F.shiftright("nq", 32).alias("n"), F.col("nq").bitwiseAND(F.lit(0xFFFFFFFF)).alias("q"))
    sizes = scratch.save(sizes, few=True)
    entries = index.where("nq <= 1")
    stars = entries.where("sid <> rep").groupBy(F.col("rep").alias("a"), F.col("sid").alias("b")).agg(*_counts())
    pairs = scratch.save(_possible(stars, sizes), few=True)
    sets = whole_sets(_both(pairs), texts, shared, scratch)
    links = scratch.save(verified(pairs, sets), few=True)
    scratch.drop(sets)
    scratch.drop(pairs)
    labels = components(links, scratch)
    scratch.free()
    named = entries.join(labels.select(F.col("id").alias("sid"), "label"), "sid", "left").select("sig", "sid", "nq", F.coalesce("label", "sid").alias("label"))
    named = scratch.save(named)
    scratch.drop(index)
    parts = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y").select("sig", "k")
    still = scratch.save(named.join(parts, "sig"), few=True)
    scratch.drop(named)
    return sizes, links, labels, still


def labelled_documents(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_shingles, label of every row; label, least doc_id and first (doc_id, th) of every component), th the hash of the text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.select("text")
    first = scratch.save(own.select("doc_id", text_hash("text").alias("th"), "text").mapInArrow(_first_pass, "kind int, a long, b long, n long, th long, second long"))
    rows = first.where("kind = 0").select(F.col("a").alias("doc_id"), "th", F.col("b").alias("sid"), F.col("n").alias("n_shingles"), "second")
    # one among 10**9 documents or so
    twice = [r.sid for r in rows.groupBy("sid").agg((F.min("second") != F.max("second")).alias("twice")).where("twice").collect()]
    shared = np.array(twice, np.int64).view(np.uint64)
    if twice:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(twice), F.col("second")).otherwise(F.col("sid")))
    often = first.where("kind = 1").groupBy(F.col("a").alias("t")).agg(F.sum("b").alias("k")).where(F.col("k") >= FREQUENT)
    classed = lambda df: df.select("t", F.least(F.lit(255), 1 + F.floor(4 * F.log2(F.col("k") / FREQUENT))).cast("int").alias("v"))
    often = scratch.save(classed(often), few=True)
    single = F.col("sig").bitwiseAND(F.lit(1)) == 0
    while True:
        sizes, links, labels, still = _opened(texts, often, shared, scratch)
        crowded = still.where(single & (F.col("k") > CROWD)).groupBy(F.col("sig").alias("t")).agg(F.max("k").alias("k"))
        if not crowded.limit(1).count():
            break
        often = scratch.save(often.unionByName(classed(crowded)), few=True)
    sized = still.where(single).join(sizes.select("sid", "n"), "sid")
    left, right = (sized.select("sig", "nq", F.col("sid").alias(e), F.col("label").alias(f"l{e}"), F.col("n").alias(f"n{e}")) for e in "ab")
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    across = left.where("nq = 0").drop("nq").join(right.drop("nq"), "sig").where(smaller & F.expr("la <> lb AND 4 * na >= 3 * nb")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("singles"), F.lit(0).alias("combos"))
    pairs = scratch.save(_possible(across, sizes), few=True)
    members = scratch.save(scan_groups(still.where(~single), scratch), few=True)
    sets = whole_sets(_both(pairs).unionByName(members.select("sid")), texts, shared, scratch)
    more = scratch.save(verified(pairs, sets).unionByName(scanned(members, sets)), few=True)
    scratch.drop(sets)
    if more.limit(1).count():
        labels = components(links.unionByName(more), scratch)
    rows = rows.drop("second").join(labels.select(F.col("id").alias("sid"), "label"), "sid", "left").select("doc_id", "th", "n_shingles", F.coalesce("label", "sid").alias("label"))
    rows = scratch.save(rows)
    heads = rows.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("head"))
    return rows, scratch.save(heads.select("label", "least", F.col("head.doc_id").alias("head_id"), F.col("head.th").alias("head_th")))


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def document_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, heads = labelled_documents(docs, Scratch(docs.sparkSession))
    heads = heads.select(F.col("label").alias("_label"), "least")
    out = rows.join(heads, (F.col("label") == F.col("_label")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least doc_id (null last), then the least hash of the text.

    Rows are told apart by doc_id and text, so a linked text takes no other text
    of its doc_id along. Rows without words link with nothing and all stay.
    """
    rows, heads = labelled_documents(docs, Scratch(docs.sparkSession))
    met = rows.where("n_shingles > 0").join(heads.select(F.col("label").alias("_label"), "head_id", "head_th"), F.col("label") == F.col("_label"))
    head = same(F.col("doc_id"), F.col("head_id")) & (F.col("th") == F.col("head_th"))
    key = lambda df: df.select(F.col("doc_id").alias("_fw_doc"), F.col("th").alias("_fw_th"))
    gone, twice = key(met.where(~head)).distinct(), key(met.where(head).groupBy("doc_id", "th").count().where("count > 1"))
    is_key = same(F.col("doc_id").cast("long"), F.col("_fw_doc")) & (text_hash("text") == F.col("_fw_th"))
    out = docs.join(gone, is_key, "left_anti")
    if twice.limit(1).count():
        double = out.join(twice, is_key, "left_semi").withColumns({"_fw_id": F.col("doc_id").cast("long"), "_fw_hash": text_hash("text")}).dropDuplicates(["_fw_id", "_fw_hash"]).drop("_fw_id", "_fw_hash")
        out = out.join(twice, is_key, "left_anti").unionByName(double)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_components(documents(spark, sf_dir))
