"""Operator 5: byte-level BPE encoding and decoding, by segment trees over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import table, texts_of

_NONE = np.int64(1 << 62)
#: Pieces of at most so many bytes are merged side by side in arrays; longer ones one by one.
_SHORT = 64
#: Trees over at most so many positions are made anew by whole levels, which costs less than the paths of three leaves.
_SMALL = 16


class Merger:
    """Merges of pieces of bytes: rank by rank, leftmost first, as ranks (bytes -> id) order them.

    A segment tree over the byte positions of a piece holds in each leaf rank * positions + position of the pair that starts
    there, and in each node the least of its leaves; its root is the leftmost pair of least rank. A merge changes the leaves
    of the pair, of its right half and of its left neighbour, each in a logarithmic number of nodes. Short pieces are
    merged many at a time: the same tree, as one row of an array for each piece.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys, made = np.array([(a << 20) | b for a, b in self.pairs], np.int64), np.array([*self.pairs.values()], np.int64)
        # A table with a place for each pair; pairs whose place another took are found in order.
        self.shift = np.uint64(64 - (4 * keys.size).bit_length())
        place = self._place(keys)
        self.held, self.makes = np.full(1 << 64 - int(self.shift), -1), np.full(1 << 64 - int(self.shift), -1, np.int32)
        self.held[place] = keys
        has = self.held[place] == keys
        self.makes[place[has]] = made[has]
        order = np.argsort(keys[~has])
        self.keys, self.made = np.append(keys[~has][order], _NONE), np.append(made[~has][order], -1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 if it isn't to be merged; tokens below 0 are none."""
        key = (left << 20) | right
        place = self._place(key)
        there = self.held[place]
        none = (left < 0) | (right < 0)
        out = np.where((there == key) & ~none, self.makes[place], np.int64(-1))
        other = np.flatnonzero((there >= 0) & (there != key) & ~none)
        at = np.searchsorted(self.keys, key[other])
        out[other] = np.where(self.keys[at] == key[other], self.made[at], -1)
        return out

    def _long(self, piece: bytes) -> list[int]:
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none = int(_NONE)
        token = [int(self.first[b]) for b in piece]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs = self.pairs
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pairs.get((token[i], token[i + 1]))
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while (least := tree[1]) != none:
            i, r = least % size, least // size
            j = after[i]
            token[i], token[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for at, other in ((j, -2), (i, after[i]), (before[i], i)):
                if at < 0:
                    continue
                s = pairs.get((token[at], token[other])) if other >= 0 else None
                k = size + at
                tree[k] = none if s is None else s * size + at
                while k > 1:
                    k >>= 1
                    a, b = tree[2 * k], tree[2 * k + 1]
                    tree[k] = a if a < b else b
        return [t for t in token if t >= 0]

    def _side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of at most size bytes, packed as little-endian unsigned 32-bit integers."""
        m = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        there = np.arange(size) < length[:, None]
        token = np.full((m, size + 1), -1, np.int64)  # the last column stands for no neighbour
        token[:, :size] = np.where(there, self.first[raw], -1)
        after = np.minimum(np.arange(1, size + 2), length[:, None])
        after[after == length[:, None]] = size
        before = np.tile(np.r_[size, np.arange(size)], (m, 1))
        tree = np.full((m, 2 * size), _NONE)
        r = self._rank(token[:, : size - 1].ravel(), token[:, 1:size].ravel()).reshape(m, size - 1)
        tree[:, size : 2 * size - 1] = np.where(r >= 0, r * size + np.arange(size - 1), _NONE)
        k = size
        while k > 1:
            k //= 2
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while rows.size:
            least = tree[rows, 1]
            i, r = least % size, least // size
            j = after[rows, i]
            token[rows, i] = r
            token[rows, j] = -1
            nxt = after[rows, j]
            after[rows, i] = nxt
            before[rows, nxt] = i
            prev = before[rows, i]
            right = self._rank(token[rows, i], token[rows, nxt])
            left = self._rank(token[rows, prev], token[rows, i])
            tree[rows, size + j] = _NONE
            tree[rows, size + i] = np.where(right >= 0, right * size + i, _NONE)
            own = prev < size
            tree[rows[own], size + prev[own]] = np.where(left >= 0, left * size + prev, _NONE)[own]
            if size <= _SMALL:
                level = tree[rows, size:].ravel()
                while level.size > rows.size:
                    level = np.minimum(level[::2], level[1::2])
                tree[rows, 1] = level
            for at in () if size <= _SMALL else (size + j, size + i, size + np.where(own, prev, i)):
                node = at >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] != _NONE]
        live = token[:, :size] >= 0
        flat = token[:, :size][live].astype("<u4")
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        sized: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > _SHORT:
                out[k] = np.array(self._long(p), "<u4").tobytes()
            elif p:
                sized.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(k)
        for size, places in sized.items():
            for a in range(0, len(places), 4096):
                part = places[a : a + 4096]
                for k, ids in zip(part, self._side_by_side([pieces[k] for k in part], size)):
                    out[k] = ids
        return out


class Kept:
    """What was made of strings, kept by halves: of over keep / 2 strings the older half goes, but for those asked for meanwhile."""

    def __init__(self, keep: int) -> None:
        self.keep = keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, asked: set[str]) -> list[str]:
        """Those of asked that young hasn't, even from the older half, to be added by the caller."""
        if len(self.young) > self.keep // 2:
            self.old, self.young = self.young, {}
        out = asked - self.young.keys()
        known = out & self.old.keys()
        self.young.update((x, self.old[x]) for x in known)
        return [*(out - known)]

    def forget_long(self, new: list[str]) -> None:
        for x in new:
            if len(x) > 64:
                del self.young[x]


class Encoder:
    """Encodes texts; each match of the pattern is merged by itself.

    A text whose spaces each stand between two characters that aren't white space is cut there first: no match of a pattern
    that takes a space only before what it leads can cross such a cut, so the ids of a cut-out are kept for its repeats, and new
    ones, each led by its space, are matched as one string.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 120_000) -> None:
        self.merger, self.find = Merger(ranks), regex.compile(pattern).findall
        self.words, self.parts = Kept(keep), Kept(keep)
        self.tokens = {r: t for t, r in ranks.items()}
        self.split = pattern_takes_leading_space(pattern)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of each text."""
        cuts = [self._cut(t) for t in texts]
        new = self.words.missing({*chain.from_iterable(rest for _, rest in cuts)})
        heads = [self.find(head) for head, _ in cuts]
        led = self.find(" " + " ".join(new)) if new else []
        pieces = self.parts.missing({*led, *chain.from_iterable(heads)})
        self.parts.young.update(zip(pieces, self.merger.merge([p.encode("utf-8", "replace") for p in pieces])))
        part = self.parts.young.__getitem__
        starts = [k for k, p in enumerate(led) if p[0] == " "]  # where a cut-out begins, as it has no space besides
        ids = [*map(part, led)]
        self.words.young.update((w, ids[a] if b - a == 1 else b"".join(ids[a:b])) for w, a, b in zip(new, starts, [*starts[1:], len(led)]))
        word = self.words.young.__getitem__
        out = [b"".join([*map(part, head), *map(word, rest)]) for head, (_, rest) in zip(heads, cuts)]
        self.words.forget_long(new)
        self.parts.forget_long(pieces)
        return out

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """The text up to its first cut, and what follows each cut's space."""
        if not self.split or not text or text[0].isspace() or text[-1].isspace() or _ODD(text):
            return text, []
        head, *rest = text.split(" ")
        return head, rest

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ODD = regex.compile(r" [\s\x1c-\x1f]|[\s\x1c-\x1f] ").search


def pattern_takes_leading_space(pattern: str) -> bool:
    """Whether text may be cut before single spaces: true of the pattern of the public rank files."""
    return pattern == r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about so many characters."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Each row of docs with ids (binary, little-endian unsigned 32-bit integers) and n_tokens, without a shuffle.

    Null text counts as empty and has no ids. Whole texts are encoded. Columns named ids and n_tokens are replaced, others
    pass; repeated rows repeat. The ranks, which have a fixed size, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    @F.pandas_udf("binary")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(*shared.value)
        for column in texts:
            yield pd.Series([ids for group in _groups([t or "" for t in column]) for ids in encoder.encode(group)], dtype=object)

    return texts_of(docs).withColumn("ids", encoded(F.col(text))).withColumn("n_tokens", F.floor(F.length("ids") / 4))


def decode(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Each row of docs with decoded (binary): the bytes that its ids stand for; null ids give null."""
    shared = docs.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    @F.pandas_udf("binary")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = shared.value.__getitem__
        for column in ids:
            yield pd.Series([None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in column], dtype=object)

    return docs.withColumn("decoded", decoded(F.col("ids")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
