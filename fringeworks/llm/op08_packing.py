"""Vector bin packing of tokenised examples into fixed-length sequences.

Every example asks for three resources of a sequence: tokens, segments and
loss-bearing tokens. Of the examples that still fit, the one whose demand has
the largest dot product with what the sequence has left is placed next, both
measured in shares of the capacity. When nothing fits whole, one example is
cut to fill the sequence; its rest waits for the next. An example longer than
a sequence first gives up whole sequences. A sequence that can take no more
before it is full, because its segments or its loss-bearing tokens are spent or
the partition ends, is laid out anew in sequences whose lengths are powers of
two, which need no padding.

Packing is local to a partition of the input: no shuffle, memory for one block
of examples, sequence ids made of partition and counter. A partition's rows
and sequences come from one task, so a lost task is redone alone.

Null text is empty: an example of the end token only. Repeated rows are
examples of their own. A null doc_id stays null. An empty table gives no rows.
Of equal demands the first example goes first; of equal dot products the least
demand. Very long texts are tokenised whole, one at a time. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import PATTERN, read_ranks
from .common import documents, pieces, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_ID = 2048, 1
#: At most so many pieces of examples in a sequence.
MAX_SEGMENTS = 64
#: Examples (and tokens) that compete for places at once.
BLOCK_ROWS, BLOCK_TOKENS = 2048, 1 << 22


class Tokenizer:
    """Ids as the tokenizers library gives them for this vocabulary, several times quicker.

    The pattern's lookahead matters only where two white-space characters
    meet; other texts are split without it. The text of a special token is that token.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        ranks = {t: i for i, t in enumerate(read_ranks(path))}
        own = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full, self.plain = own("full", PATTERN), own("plain", PATTERN.replace(r"|\s+(?!\S)", ""))
        self.meets = re.compile(r"\s\s")
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        self.special, self.cut = special, re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _part(self, text: str) -> list[int]:
        return (self.full if self.meets.search(text) else self.plain).encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        if self.cut and any(s in text for s in self.special):
            return [i for x in self.cut.split(text) for i in ([self.special[x]] if x in self.special else self._part(x))]
        return self._part(text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Packer:
    """Places examples (key, tokens, loss); out gathers (key, start, length, sequence, offset) of finished sequences, open those of the one at hand."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first_sequence: int = 0):
        self.full = np.array([capacity, max_segments, max_loss], float)
        self.next = first_sequence
        self.out: list[tuple] = []
        self.open: list[tuple] = []
        self.left = self.full.copy()

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _place(self, key, start: int, length: int, loss: float) -> None:
        self.open.append((key, start, length))
        self.left -= (length, 1, loss)
        if self.left[0] < 1 or self.left[1] < 1:
            self.finish()

    def finish(self) -> None:
        """Ends the open sequence: as it is if full, else as sequences of power-of-two lengths."""
        total = sum(n for _, _, n in self.open)
        sizes = [total] if total == int(self.full[0]) else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room = at = seq = 0
        for key, start, length in self.open:
            while length:
                if not room:
                    seq, room, at = self._new(), sizes.pop(0), 0
                size = min(length, room)
                self.out.append((key, start, size, seq, at))
                start, length, room, at = start + size, length - size, room - size, at + size
        self.open, self.left = [], self.full.copy()

    @staticmethod
    def _loss(sums, a: int, b: int) -> float:
        return float(b - a if sums is None else sums[b] - sums[a])

    def _within(self, sums, a: int, n: int, tokens: float, loss: float) -> int:
        """The longest length from a, at most tokens, that bears at most that loss; 0 if none does."""
        most = min(n - a, int(tokens))
        return min(most, int(loss)) if sums is None else min(most, int(np.searchsorted(sums, sums[a] + loss, side="right")) - 1 - a)

    def block(self, items: list[tuple]) -> None:
        """items: (key, tokens, prefix sums of the loss or None where all tokens bear it)."""
        cap, rest = int(self.full[0]), []
        for key, n, sums in items:
            at = 0
            while n - at >= cap:
                size = self._within(sums, at, n, cap, self.full[2])
                if size < cap:  # its loss-bearing tokens fill a sequence sooner
                    break
                self.out.append((key, at, size, self._new(), 0))
                at += size
            if at < n:
                rest.append((key, at, n, sums))
        if rest:
            self._fill(rest)

    def _fill(self, rest: list[tuple]) -> None:
        start = [a for _, a, _, _ in rest]
        ask = lambda i: (float(rest[i][2] - start[i]), 1.0, self._loss(rest[i][3], start[i], rest[i][2]))
        # examples of equal demand are alike and wait in one class
        waiting: dict[tuple, list[int]] = {}
        for i in range(len(rest) - 1, -1, -1):
            waiting.setdefault(ask(i), []).append(i)
        names = sorted(waiting)
        kinds, live = np.array(names), np.ones(len(names), bool)
        row = {name: k for k, name in enumerate(names)}
        shares, todo = kinds / self.full, len(rest)
        while todo:
            fits = live & (kinds <= self.left).all(1)
            whole = bool(fits.any())
            worth = np.where(fits, shares @ (self.left / self.full), -1.0) if whole else np.where(live, kinds[:, 0], -1.0)
            k = min(np.flatnonzero(worth == worth.max()).tolist(), key=names.__getitem__)
            i = waiting[names[k]][-1]
            key, _, n, sums = rest[i]
            a = start[i]
            size = n - a if whole else self._within(sums, a, n, self.left[0], self.left[2])
            if size < 1:  # no loss-bearing token fits any more
                self.finish()
                continue
            waiting[names[k]].pop()
            live[k] = bool(waiting[names[k]])
            self._place(key, a, size, self._loss(sums, a, a + size))
            start[i] = a + size
            if a + size == n:
                todo -= 1
                continue
            name = ask(i)  # the rest of an example that was cut
            if name not in row:
                row[name] = len(names)
                names.append(name)
                waiting[name] = []
                kinds, shares, live = np.vstack([kinds, name]), np.vstack([shares, np.array(name) / self.full]), np.append(live, False)
            waiting[name].append(i)
            live[row[name]] = True


def pack_examples(examples: DataFrame, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Packs rows (key long, ids array<int>, loss array<boolean> or null for all) of instruction data.

    Returns key, start, length, sequence_id, offset, ids: the pieces with their ids.
    """

    def run(it):
        ids, loss = {}, {}
        packer = Packer(capacity, max_segments, max_loss or capacity, TaskContext.get().partitionId() << 33)

        def emit():
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_pydict({"key": pa.array([ids[k][0] for k, *_ in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "length": pa.array([r[2] for r in rows], pa.int64()), "sequence_id": pa.array([r[3] for r in rows], pa.int64()), "offset": pa.array([r[4] for r in rows], pa.int64()), "ids": pa.array([ids[r[0]][1][r[1] : r[1] + r[2]] for r in rows], pa.list_(pa.int32()))})

        n = 0
        for b in it:
            items = []
            for key, x, bears in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if x:
                    ids[n] = (key, x)
                    loss[n] = None if bears is None else np.concatenate([[0], np.cumsum([bool(v) for v in bears])])
                    items.append((n, len(x), loss[n]))
                    n += 1
            packer.block(items)
            if packer.out:
                yield emit()
            keep = {r[0] for r in packer.open}
            ids, loss = {k: v for k, v in ids.items() if k in keep}, {}
        packer.finish()
        if packer.out:
            yield emit()

    return examples.select(F.col("key").cast("long"), "ids", "loss").mapInArrow(run, "key long, start long, length long, sequence_id long, offset long, ids array<int>")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises and packs every document: the pieces' digests. All tokens bear loss."""

    def run(it):
        own = tokenizer(vocabulary)
        packer = Packer(capacity, MAX_SEGMENTS, capacity, TaskContext.get().partitionId() << 33)
        kept: dict[int, tuple] = {}
        items: list[tuple] = []
        n = size = 0

        def emit(rows):
            crcs = [zlib.crc32(kept[k][1][s : s + m].tobytes()) for k, s, m, _, _ in rows]
            cols = [[kept[r[0]][0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], crcs, [len(kept[r[0]][1]) for r in rows], [r[3] for r in rows], [r[4] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def turn():
            """Packs the block; only the open sequence stays."""
            nonlocal items, size, kept
            packer.block(items)
            out = emit(packer.out) if packer.out else None
            packer.out, items, size = [], [], 0
            kept = {k: kept[k] for k in {r[0] for r in packer.open}}
            return out

        for b in pieces(it, 1):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = own.encode(text or "")
                ids.append(end_id)
                kept[n] = (doc, np.array(ids, "<u4"))
                items.append((n, len(ids), None))
                n, size = n + 1, size + len(ids)
                if len(items) >= BLOCK_ROWS or size >= BLOCK_TOKENS:
                    if out := turn():
                        yield out
        if items and (out := turn()):
            yield out
        packer.finish()
        if packer.out:
            yield emit(packer.out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path(VOCABULARY))
