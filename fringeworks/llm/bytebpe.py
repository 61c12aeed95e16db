"""Byte-level BPE vocabularies: pre-tokens, exact encoding through a hand-serialised sentencepiece model, decoding."""

from __future__ import annotations

import base64
import json
import re
import struct
from functools import lru_cache

import regex

#: Fixed value: the pattern that splits text before the merges, as the vocabulary's users publish it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for Latin text, by the quicker library: there \w without digits is \p{L}, \d is \p{N} and \s agrees.
_LATIN = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNSAFE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")
_FULL = regex.compile(PATTERN)


def pre_tokens(text: str) -> list[str]:
    """All matches of PATTERN, in order; together they are the whole text."""
    return (_FULL if _UNSAFE.search(text) else _LATIN).findall(text)


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The token of each rank, from a rank file, or from the vocabulary of a JSON file without its added tokens."""
    with open(path, "rb") as f:
        if path.endswith(".json"):
            model = json.load(f)
            back = {c: b for b, c in enumerate(byte_chars())}
            special = {t["content"] for t in model.get("added_tokens", [])}
            vocab = {bytes(back[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        else:
            vocab = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = sorted(vocab, key=vocab.__getitem__)
    if [vocab[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not 0, 1, 2 ...")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The protocol buffer of a BPE model whose piece i is token i, byte-mapped, with score -i.

    Trainer: type BPE, the unknown piece last. Normaliser: identity; no dummy
    prefix, no removal or escape of spaces.
    """
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))))
    unknown = len(tokens)
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    minus_one = _varint((1 << 64) - 1)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(unknown + 1)) + _field(40, 0, _varint(unknown)) + b"".join(_field(n, 0, minus_one) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normaliser))


class Codec:
    """Encodes and decodes by one vocabulary; pre-tokens already met come from a bounded cache."""

    #: Pre-tokens kept; the cache starts anew beyond, which changes time only.
    CACHE = 150_000

    def __init__(self, path: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        chars = byte_chars()
        self.table = {b: chars[b] for b in range(256)}
        self.seen: dict[str, tuple[bytes, bytes, int]] = {}

    def encode_pre_tokens(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token: its own token if it has one, else by merges in rank order."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [[self.whole[r]] if r in self.whole else None for r in raw]
        rest = [i for i, x in enumerate(out) if x is None and raw[i]]
        if rest:
            mapped = [raw[i].decode("latin-1").translate(self.table) for i in rest]
            for i, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
                out[i] = ids
        return [x or [] for x in out]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pre_tokens(pre_tokens(text)) for i in ids]

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def digest(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the decimal ids joined by commas, and the bytes that the ids decode to."""
        words = pre_tokens(text)
        seen = self.seen
        new = [w for w in set(words) if w not in seen]
        if len(seen) + len(new) > self.CACHE:
            seen.clear()
            new = list(set(words))
        for w, ids in zip(new, self.encode_pre_tokens(new), strict=True):
            seen[w] = (b"".join([b"%d," % i for i in ids]), self.decode(ids), len(ids))
        got = [seen[w] for w in words]
        if len(seen) > self.CACHE:  # one text alone has more
            self.seen = {}
        return sum([g[2] for g in got]), b"".join([g[0] for g in got])[:-1], b"".join([g[1] for g in got])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path)
