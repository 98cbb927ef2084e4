"""Operator 7: dedup of repeated byte strings by suffix sorting.

Anchors (see repeats) tell which stretches may hold a string that starts elsewhere too. The suffixes that start at their
windows are sorted, shard by shard, by a mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes; neighbours in order whose extension reaches the length are repeats, which their bytes
confirm. Copies of a stretch are told by their bytes; two of them are sorted, so that they stand side by side. Which positions
start a repeat is joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quillstone.llm.common import others, table
from quillstone.llm.repeats import HELD, Powers, Prefixes, Routing, anchors_of, beside, covered, dealt, lots_of, mixed, packed, unplaced


@dataclass(frozen=True)
class SuffixConfig:
    """length: bytes of a string that counts. k: bytes of an anchor's k-gram. batch: how much is sorted at a time, about: windows, and
    a 16th of the bytes, as hashes take memory by the byte, and copies. routing: see repeats."""

    length: int = 200
    k: int = 50
    batch: int = 60_000
    routing: Routing = field(default_factory=lambda: Routing(hot=800))


#: A 64-bit unit for each byte.
_UNITS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = Powers(0xD6E8FEB86659FD93)


def sort_suffixes(prefixes: Prefixes, data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts, by group and then by their first length bytes, and for each place of that order
    whether its suffix agrees with the one before it (same group) in all length bytes.

    A bottom-up mergesort, all groups and runs of a level at once: a suffix's place in the merger of two runs is its place in
    its own run plus its rank in the other, which a binary search finds. Each comparison is a binary search for the common
    extension over the hashes, then one byte. Agreement of neighbours is held against the bytes, so that a collision of
    hashes can't make a repeat; a group in which one shows is sorted again by its bytes, so that it can't hide one either.
    """

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        e = np.full(a.size, length)
        apart = np.flatnonzero(prefixes.of(a, length) != prefixes.of(b, length))
        a, b = a[apart], b[apart]
        low, high = np.zeros(apart.size, np.int64), np.full(apart.size, length - 1)
        for _ in range(length.bit_length()):
            mid = (low + high + 1) // 2
            same = prefixes.of(a, mid) == prefixes.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(low, mid - 1))
        e[apart] = low
        return e

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a stands before suffix b; equal ones do where ties is true."""
        e = extension(a, b)
        at = np.minimum(e, length - 1)
        x, y = data[a + at], data[b + at]
        return np.where(e == length, ties, x < y)

    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.searchsorted(group, group)
    size = np.searchsorted(group, group, side="right") - first
    within = np.arange(order.size) - first
    width = 1
    while (live := np.flatnonzero(size > width)).size:  # places of groups that aren't one run yet
        at, own, base = within[live], order[live], first[live]
        pair = at // (2 * width) * (2 * width)
        left = at < pair + width
        other = np.where(left, pair + width, pair)  # start of the run to be merged with, in its group
        low, high = np.zeros(live.size, np.int64), np.clip(size[live] - other, 0, width)
        open_ = np.flatnonzero(low < high)
        while open_.size:
            mid = (low[open_] + high[open_]) // 2
            a, b = starts[order[base[open_] + other[open_] + mid]], starts[own[open_]]
            # rank of b among run a: elements before it; equal ones of a left run are, of a right run aren't
            ahead = before(a, b, ~left[open_])
            low[open_[ahead]] = mid[ahead] + 1
            high[open_[~ahead]] = mid[~ahead]
            open_ = open_[low[open_] < high[open_]]
        run = np.where(left, pair, pair + width)
        merged = order.copy()
        merged[base + pair + (at - run) + low] = own
        order = merged
        width *= 2
    agrees = np.zeros(order.size, bool)
    if order.size > 1:
        alike = np.flatnonzero((group[1:] == group[:-1]) & (extension(starts[order[:-1]], starts[order[1:]]) == length))
        same = _equal_bytes(data, starts[order[alike]], starts[order[alike + 1]], length)
        agrees[alike[same] + 1] = True
        for g in np.unique(group[alike[~same]]).tolist():  # hashes that collide: the group is sorted by its bytes
            at = np.flatnonzero(group == g)
            order[at] = sorted(order[at].tolist(), key=lambda k: data[starts[k] : starts[k] + length].tobytes())
            agrees[at[1:]] = _equal_bytes(data, starts[order[at[:-1]]], starts[order[at[1:]]], length)
    return order, agrees


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of so many bytes at a and b are equal."""
    out, strings = np.zeros(a.size, bool), np.lib.stride_tricks.sliding_window_view(data, length)
    for k in range(0, a.size, 4096):
        out[k : k + 4096] = (strings[a[k : k + 4096]] == strings[b[k : k + 4096]]).all(axis=1)
    return out


def _units(text: bytes) -> np.ndarray:
    return _UNITS[np.frombuffer(text, np.uint8)]


def repeated_windows(stretches: list[tuple[tuple, bytes]], length: int) -> list[np.ndarray]:
    """Of each stretch (group, bytes), of each window whether its string starts elsewhere too; group tells the key and the place of
    the anchor. Windows can only be equal if their anchors stand at the same place in them, so suffixes are sorted in groups."""
    raw = np.frombuffer(b"".join(s for _, s in stretches), np.uint8)
    sizes = np.array([len(s) for _, s in stretches])
    offsets = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    ends = np.cumsum(windows)
    owner = np.repeat(np.arange(sizes.size), windows)
    j = np.arange(owner.size) - np.repeat(ends - windows, windows)
    keys, shifts = np.array([g for g, _ in stretches], np.int64).T
    _, number = np.unique(keys, return_inverse=True)
    group = number[owner] * (2 * length) + shifts[owner] - j + length
    order, agrees = sort_suffixes(Prefixes(_UNITS[raw], _POWERS), raw, offsets[owner] + j, group, length)
    again = agrees.copy()
    again[:-1] |= agrees[1:]
    found = np.zeros(owner.size, bool)
    found[order] = again
    return np.split(found, ends[:-1])


MARKS = "doc long, row long, place long, bits binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _located(parts: DataFrame, config: SuffixConfig) -> DataFrame:
    """MARKS of dealt stretches: a bit for each window whose string starts elsewhere too, null if all do. Of a lot, some keys
    are held at a time, as only windows of one key can be equal, and of those each distinct stretch once; it is sorted twice
    if several places have it."""

    def done(lot: dict[tuple, list[tuple]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        entries = [(k, who) for k, who in lot.items() for _ in who[:2]]
        bits = repeated_windows([((key, shift), part) for (key, shift, part), _ in entries], config.length)
        last = None
        for (_, who), found in zip(entries, bits):
            if who is not last and found.any():
                own = None if found.all() else np.packbits(found, bitorder="little").tobytes()
                rows += [(*w, own) for w in who]
            last = who
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, _KINDS)], names=["doc", "row", "place", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lot, held = None, {}, 0
        for _, key, _, doc, row, place, part in lots_of(batches):
            if key != now and held > config.batch:
                yield done(lot)
                lot, held = {}, 0
            now = key
            who = lot.setdefault((key, unplaced(place)[2], part), [])
            who.append((doc, row, place))
            held += 1 if len(who) > 2 else len(part) - config.length + 1 + len(part) // 16
        if lot:
            yield done(lot)

    return parts.mapInArrow(run, MARKS)


def repeated_strings(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """(doc, row, marks): of documents (doc, text) with strings that start elsewhere too, places and bits of those that do, null
    where all windows of a place do; row is a hash of the text."""
    sample = docs.where(F.pmod(F.xxhash64("doc"), F.lit(config.routing.sample)) == 0)
    every, sampled = (anchors_of(d, lambda: _units, config.length, config.k) for d in (docs, sample))
    parts = dealt(docs, every, sampled, "n > 1", lambda: _units, bytes, bytes, config.length, config.k, config.routing, "key")
    return _located(parts, config).groupBy("doc", "row").agg(F.collect_list(F.struct("place", "bits")).alias("marks"))


def dedup(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """Each row of docs (doc_id, text and others) with n_bytes, n_removed, spans (array of start and end) and kept (binary).

    Removed is each byte of the UTF-8 text that a string of so many bytes covers which also starts anywhere else, in this row
    or another, all judged on the input; overlaps count. Null text counts as empty. Each row is a text of its own, whether its
    doc_id is null or repeated or not. Columns with the new names are replaced, others but text pass.
    """
    new = ("n_bytes", "n_removed", "spans", "kept")
    kept = [c for c in docs.columns if c not in (*new, "text")]
    doc = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc")
    own = docs.select(F.struct(*others(docs, *new, "text")).alias("_row"), doc, "text")
    marks = repeated_strings(own.select("doc", "text"), config)
    joined = beside(packed(own), marks, ["doc", "row"], "left").select("_row", "z", "marks")
    kinds = StructType([docs.schema[c] for c in kept]).add("n_bytes", "long").add("n_removed", "long").add("spans", ArrayType(StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held, sent = [], 0, 0

            def made() -> pa.RecordBatch:
                own = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, types)]
                return pa.RecordBatch.from_arrays([*batch.column("_row").slice(sent, len(rows)).flatten(), *own], names=[*kept, *new])

            for text, marked in zip(*(batch.column(n).to_pylist() for n in ("z", "marks"))):
                if held > HELD:  # texts may be many times what they are packed
                    yield made()
                    rows, held, sent = [], 0, sent + len(rows)
                raw = z.decompress(text)
                held += len(raw)
                if not marked:
                    rows.append((len(raw), 0, [], raw))
                    continue
                units = np.frombuffer(raw, np.uint8)
                starts = []
                for m in marked:
                    at, n, _ = unplaced(m["place"])
                    starts.append(at + (np.arange(n) if m["bits"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8), bitorder="little"))))
                gone = covered(np.concatenate(starts), config.length, units.size)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                rows.append((len(raw), int(gone.sum()), [{"start": x, "end": y} for x, y in edges.tolist()], units[~gone].tobytes()))
            yield made()

    return joined.mapInArrow(clean, kinds)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
