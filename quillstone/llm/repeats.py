"""Windows of a sequence that recur elsewhere: anchors and stretches, which both substring operators share.

Of the k-grams in a window, the one of least hash is its anchor (a minimizer): equal windows have equal anchors at equal
places, so windows can only be equal if their anchors' k-grams are. Windows with the same anchor stand side by side; the
units that they cover are the anchor's context. An anchor thus stands for all its windows with two hashes, of its k-gram (key)
and of its context (ctx), of independent bases: anchors equal in both have equal windows, anchors equal in key alone may share
some windows.

Anchors only route: the stretches of text that they name are read again from every document and dealt to lots, and what an
operator says of them it finds in their bytes. A row's own anchors share out its windows, so that each is in one stretch. Rows
that share an id are asked for each other's stretches too; where those overlap, a row's anchors are found again and the others
dropped, so that no window of a row is sent twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import join_facts, stored, texts_of

_INDEX = 20  # bits of a place within a stretch
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes, spread (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as many as were asked for yet."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up, self.down


class Prefixes:
    """Prefix polynomial hashes of a sequence of 64-bit units; the hash of any stretch is a difference of two."""

    def __init__(self, units: np.ndarray, powers: Powers) -> None:
        up, self.down = powers(units.size + 1)
        self.sums = np.zeros(units.size + 1, np.uint64)
        np.cumsum(units * up[: units.size], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


@dataclass
class Anchors:
    """Of each anchor, in order: its first window's start, its windows, its place after that start, key and ctx."""

    start: np.ndarray
    windows: np.ndarray
    shift: np.ndarray
    key: np.ndarray
    ctx: np.ndarray


class Sketch:
    """Finds the anchors of sequences: window units a window, k units a k-gram."""

    def __init__(self, window: int, k: int) -> None:
        if not 0 < k <= window or window - k > 254:
            raise ValueError(f"k must be from 1 to the window, and at most 254 under it: a place has 8 bits for its windows and its shift; got window {window}, k {k}")
        self.window, self.k = window, k
        self.powers = Powers(_ODD[0]), Powers(_ODD[1])

    def anchors(self, units: np.ndarray) -> Anchors:
        """Long sequences are read by stretches that overlap, so that each window is in one of them."""
        step = (1 << _INDEX) - 4 * self.window
        parts = [self._stretch(units[a : a + step + self.window - 1], a) for a in range(0, max(1, units.size - self.window + 1), step)]
        return parts[0] if len(parts) == 1 else Anchors(*(np.concatenate(x) for x in zip(*((p.start, p.windows, p.shift, p.key, p.ctx) for p in parts))))

    def _stretch(self, units: np.ndarray, base: int) -> Anchors:
        n = units.size - self.window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return Anchors(none, none, none, none, none)
        first, second = (Prefixes(units, p) for p in self.powers)
        grams = np.arange(units.size - self.k + 1)
        hashes = mixed(first.of(grams, self.k))
        w = self.window - self.k + 1
        low = np.uint64((1 << _INDEX) - 1)
        packed = np.full(-(-hashes.size // w) * w, ~np.uint64(0))
        packed[: hashes.size] = (hashes & ~low) | grams.astype(np.uint64)
        rows = packed.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        anchor = at[new]
        windows = np.diff(np.concatenate((new, [n])))
        shift = anchor - new
        form = mixed((windows.astype(np.uint64) << np.uint64(32)) | shift.astype(np.uint64))
        ctx = mixed(second.of(new, windows + self.window - 1) ^ form)
        return Anchors(new + base, windows, shift, hashes[anchor].view(np.int64), ctx.view(np.int64))


#: (key, ctx, doc, place) of each anchor: place packs its first window's start, its number of windows and its shift.
ANCHORS = "key long, ctx long, doc long, place long"


def placed(a: Anchors) -> np.ndarray:
    return (a.start << 16) | (a.windows << 8) | a.shift


def unplaced(place: int) -> tuple[int, int, int]:
    """Start, number of windows and shift."""
    return place >> 16, place >> 8 & 255, place & 255


@dataclass(frozen=True)
class Routing:
    """How rows are dealt; none of it changes a result. shard: stretches of a lot that are held at a time, about. hot: a key with
    more contexts than this is dealt window by window. rows: of one key in a lot, about. sample: one in so many documents is read
    to find keys that may have over most rows."""

    shard: int = 1000
    hot: int = 2000
    rows: int = 5_000
    sample: int = 64
    most: int = 350_000


def anchors_of(docs: DataFrame, units: Callable[[], Callable[[bytes], np.ndarray]], window: int, k: int) -> DataFrame:
    """Anchors of docs (doc, text); null texts have none. units() makes what turns a text into its units."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, unit = Sketch(window, k), units()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for d, t in zip(batch.column("doc").to_pylist(), batch.column("text")):
                a = sketch.anchors(unit(t.as_py().encode("utf-8", "replace")))
                for c, x in zip(cols, (a.key, a.ctx, np.full(a.key.size, d, np.int64), placed(a))):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "ctx", "doc", "place"])

    return texts_of(docs).where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "text").mapInArrow(read, ANCHORS)


def recurring(anchors: DataFrame, where: str, routing: Routing, hot: DataFrame | None = None, first_doc: bool = False) -> DataFrame:
    """Rows of anchors whose keys fulfil where, a condition on n (the key's anchors), lo and hi (its least and greatest doc).

    With rep: whether it is the first or the last of its context, by doc and place, or (of keys with many contexts, if first_doc)
    in its first document; copies: whether the context has others; many: whether the key has more contexts than routing.hot;
    spread: lots that its key's rows go to (its context's, if many).
    Keys are dealt out once and aggregates read beside the rows, so that no second shuffle is needed. Rows of hot keys, a bounded
    set, don't meet in one task: their aggregates combine on the map side and are joined to them (join_facts).
    """
    cold = anchors if hot is None else anchors.join(F.broadcast(hot), "key", "left_anti")
    at = F.struct("doc", "place")
    ends = {"copies": F.count("*"), "least": F.min(at), "last": F.max(at)}
    sums = {"n": F.count("*"), "lo": F.min("doc"), "hi": F.max("doc")}
    key, ctx = Window.partitionBy("key"), Window.partitionBy("key", "ctx")
    out = cold.repartition("key").withColumns({c: f.over(key) for c, f in sums.items()}).where(where)
    out = out.withColumns({c: f.over(ctx) for c, f in ends.items()})
    out = out.withColumn("contexts", F.sum((at == F.col("least")).cast("long")).over(key))
    if hot is not None:
        own = stored(anchors.join(F.broadcast(hot), "key", "left_semi"), "hot-anchors")
        by_ctx = stored(own.groupBy("key", "ctx").agg(*(f.alias(c) for c, f in ends.items())), "hot-contexts")
        by_key = own.groupBy("key").agg(*(f.alias(c) for c, f in sums.items())).where(where)
        by_key = by_key.join(by_ctx.groupBy("key").agg(F.count("*").alias("contexts")), "key")
        mine = join_facts(own, by_ctx, ["key", "ctx"], "copies", own.count()).join(F.broadcast(by_key), "key")
        out = out.unionByName(mine.select(*out.columns))
    many = F.col("contexts") > routing.hot
    lots = F.ceil(F.when(many, F.col("copies")).otherwise(F.col("n")) / routing.rows).cast("int")
    rep = (at == F.col("least")) | (at == F.col("last"))
    if first_doc:
        rep = rep | (many & (F.col("doc") == F.col("least.doc")))
    return out.select("key", "ctx", "doc", "place", rep.alias("rep"), (F.col("copies") > 1).alias("copies"), many.alias("many"), lots.alias("spread"))


def hot_keys(sample: DataFrame, routing: Routing) -> DataFrame | None:
    """Keys that may hold over routing.most rows of all anchors, judged by a sample; None if there are none. At most 100,000 keys,
    which are those over a 100,000th of all rows where more pass the bound."""
    counts = sample.groupBy("key").count()
    least = max(routing.most // routing.sample, sample.count() // 100_000)
    found = [(r.key,) for r in counts.where(F.col("count") > least).select("key").collect()]
    return sample.sparkSession.createDataFrame(found, "key long") if found else None


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs with z, their text compressed for the shuffle, and row, a hash of it; null counts as empty."""

    @F.pandas_udf("z binary, row long")
    def press(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for column in texts:
            raw = [(t or "").encode("utf-8", "replace") for t in column]
            rows = np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64)
            yield pd.DataFrame({"z": [z.compress(x) for x in raw], "row": rows})

    kept = [c for c in docs.columns if c != text]
    return texts_of(docs).select(*kept, press(F.col(text)).alias("_z")).select(*kept, "_z.z", "_z.row")


def beside(texts: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """texts, as packed makes them, joined to facts in a shuffle even where facts are few: packing and what reads the rows are tasks of
    their own then, and an executor holds one Python worker a core, not two."""
    return texts.join(facts.hint("merge"), on, how)


STRETCHES = "key long, salt int, rep boolean, window boolean, doc long, row long, place long, part binary"
_KINDS = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_NAMES = [c.split()[0] for c in STRETCHES.split(", ")]
#: Bytes of stretches, or of texts, that a task holds before it sends them on.
HELD = 1 << 21


def own_places(raw: bytes, asked: dict[str, np.ndarray], sketch: Sketch, hashed: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """Which of the asked anchors (key, ctx, place) a text has itself."""
    a = sketch.anchors(hashed(raw))
    mine = {*zip(a.key.tolist(), a.ctx.tolist(), placed(a).tolist())}
    return np.array([x in mine for x in zip(*(asked[c].tolist() for c in ("key", "ctx", "place")))], bool)


def cut(batches: Iterator[pa.RecordBatch], hashed: Callable[[], Callable[[bytes], np.ndarray]], units: Callable[[bytes], Sequence], part: Callable[[Sequence], bytes], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """STRETCHES of batches with doc, row, z and asked, as stretches says. What is made is sent on by few megabytes, as stretches overlap
    and hold several times the bytes of their texts."""
    z, sketch, unit = zstandard.ZstdDecompressor(), Sketch(window, k), hashed()
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    parts: list[bytes] = []
    rows: list[tuple] = []
    held = 0

    def plain_batch() -> pa.RecordBatch:
        joined = [np.concatenate(c) for c in columns]
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(joined, _KINDS)), pa.array(parts, pa.binary())], names=_NAMES)

    for batch in batches:
        asked = batch.column("asked")
        ends = np.cumsum(asked.value_lengths().to_numpy())
        every = {f.name: asked.flatten().field(f.name).to_numpy(zero_copy_only=False) for f in asked.type.value_type}
        for (doc, row, text), start, end in zip(zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "z"))), [0, *ends.tolist()], ends.tolist()):
            raw = z.decompress(text)
            own = units(raw)
            x = {c: v[start:end] for c, v in every.items()}
            at, n = x["place"] >> 16, x["place"] >> 8 & 255
            order = np.argsort(at, kind="stable")
            if (at[order[1:]] < (at + n)[order[:-1]]).any():
                mine = own_places(raw, x, sketch, unit)
                x = {c: v[mine] for c, v in x.items()}
                at, n = at[mine], n[mine]
            fits = at + n + window - 1 <= len(own)
            plain = fits & (x["spread"] == 1) & (~x["many"] | x["copies"])
            keys = np.where(x["many"], x["key"] ^ x["ctx"], x["key"])
            m = int(plain.sum())
            none = np.zeros(m, np.int64)
            for c, v in zip(columns, (keys[plain], none, x["rep"][plain], none, none + doc, none + row, x["place"][plain])):
                c.append(v)
            new = [part(own[i:j]) for i, j in zip(at[plain].tolist(), (at + n + window - 1)[plain].tolist())]
            parts += new
            held += sum(map(len, new))
            if held > HELD:
                yield plain_batch()
                columns, parts, held = [[] for _ in range(7)], [], 0
            for e in np.flatnonzero(fits & ((x["spread"] > 1) | x["many"])).tolist():
                i, j, rep, spread, place = int(at[e]), int(n[e]), bool(x["rep"][e]), int(x["spread"][e]), int(x["place"][e])
                if spread > 1 and (not x["many"][e] or x["copies"][e]):
                    one = part(own[i : i + j + window - 1])
                    rows += [(int(keys[e]), salt, rep, False, doc, row, place, one) for salt in (range(spread) if rep else (row % spread,))]
                if x["many"][e] and rep:
                    for a in range(i, i + j):
                        one = part(own[a : a + window])
                        rows.append((_signed(xxhash.xxh3_64_intdigest(one)), 0, True, True, doc, row, (a << 16) | (1 << 8), one))
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)
                    rows = []
    if parts:
        yield plain_batch()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


def stretches(docs: DataFrame, found: DataFrame, hashed: Callable[[], Callable[[bytes], np.ndarray]], units: Callable[[bytes], Sequence], part: Callable[[Sequence], bytes], window: int, k: int) -> DataFrame:
    """What the rows found by recurring stand for, read from every row of docs (doc, text): key, salt, doc, row (a hash of the
    text), place and part, the stretch's own bytes; rep and window (a single window, by its own hash) as follows.

    A key's stretches go to as many salts as spread says, those of its first and last of each context (rep) to all of them. Of keys
    with many contexts, a context's copies have a key of their own, and its reps go besides as single windows, each under its hash:
    equal windows meet however many contexts there are. A stretch that reaches beyond the text is left out, as are overlapping ones
    that aren't the row's (own_places): they were asked of another row of that id.
    """

    asked = found.groupBy("doc").agg(F.collect_set(F.struct("key", "ctx", "place", "rep", "copies", "many", "spread")).alias("asked"))
    texts = packed(docs.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "text"))
    joined = beside(texts, asked, ["doc"]).select("doc", "row", "z", "asked")
    return joined.mapInArrow(lambda batches: cut(batches, hashed, units, part, window, k), STRETCHES)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def split_windows(parts: DataFrame, routing: Routing, most: int = 256) -> DataFrame:
    """parts, a table of stretches, in which single windows that stand in very many rows go to several salts, those of the first
    document to each. At most so many windows are split, those over a share of all windows where there are more."""
    counts = parts.where("window").groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    total = parts.where("window").count()
    least = max(routing.rows, total // most)
    hot = counts.where(F.col("n") > least).collect()
    if not hot:
        return parts
    facts = F.create_map(*(F.lit(x).cast("long") for r in hot for x in (r.key, r["first"])))
    lots = F.create_map(*(x for r in hot for x in (F.lit(r.key).cast("long"), F.lit(-(-r.n // routing.rows)).cast("int"))))
    own = F.element_at(lots, F.col("key"))
    salts = F.when(F.element_at(facts, F.col("key")) == F.col("doc"), F.sequence(F.lit(0), own - 1)).otherwise(F.array(F.pmod("row", own).cast("int")))
    salts = F.when(F.col("window") & F.col("key").isin([r.key for r in hot]), salts).otherwise(F.array("salt"))
    return parts.withColumn("salt", F.explode(salts))


def dealt(docs: DataFrame, every: DataFrame, sampled: DataFrame, where: str, hashed, units, part, window: int, k: int, routing: Routing, by: str, first_doc: bool = False) -> DataFrame:
    """Stretches of docs (doc, text) by lots: a lot is in one partition, in order of by, and has about routing.shard reps."""
    spark = docs.sparkSession
    found = stored(recurring(every, where, routing, hot_keys(stored(sampled, "sampled"), routing), first_doc), "recurring")
    held = F.when(F.col("many"), F.shiftright("place", 8).bitwiseAND(F.lit(255))).otherwise(F.col("spread"))
    reps, many = found.where("rep").agg(F.sum(held), F.count_if("many")).first()
    parts = stretches(docs, found, hashed, units, part, window, k)
    if many:  # read twice
        parts = split_windows(stored(parts, "stretches"), routing)
    lots = max(1, (reps or 0) // routing.shard)
    tasks = max(1, min(lots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = parts.withColumn("key", F.xxhash64("key", "salt"))  # reps that went to several salts don't meet
    parts = parts.select(F.pmod("key", F.lit(lots)).cast("int").alias("lot"), "key", "rep", "doc", "row", "place", "part")
    return parts.repartition(tasks, "lot").sortWithinPartitions("lot", F.expr(by))


def lots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of dealt batches, as tuples (lot, key, rep, doc, row, place, part)."""
    for batch in batches:
        plain = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("lot", "key", "rep", "doc", "row", "place"))
        yield from zip(*plain, batch.column("part").to_pylist())


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n units the windows at starts cover."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + window, n), -1)
    return np.cumsum(marks[:n]) > 0
