"""Operator 3: best-fit packing, hierarchical: local bins, then underfull bins merged as items over a tree of rounds."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.llm.common import others, stored, table, texts_of, union_all


@dataclass(frozen=True)
class PackConfig:
    """slack: bins with at most so much room are done. per_task: items that a task of the first round packs, about. fan_in: tasks
    of a round whose underfull bins meet in one task of the next, which gets at most so many times per_task of them."""

    capacity: int = 4096
    slack: int = 16
    per_task: int = 40_000
    fan_in: int = 8


# --- tokens -------------------------------------------------------------------------------------------------------------

_LETTERS = "a-zªµºß-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
#: The pre-tokenizer's pattern, for lower-case text of characters below U+0250.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\x09-\x0d\x20\x85\xa0{_LETTERS}{_NUMBERS}]+").findall
#: Texts that the tokenizer takes whole: characters whose normal form or lower case needs context, other white space,
#: strings of special tokens.
_ODD = re.compile(r"[^\x00-\x1b\x20-\u012f\u0131-ɏ]").search
_SPECIAL = "<|"


class _Kept(dict):
    """Ids by string, made when first asked for; those of long strings aren't kept."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= 64:
            self[key] = ids
        return ids


class WordTokens:
    """Ids of texts, equal to the tokenizer's own.

    The tokenizer lower-cases, cuts at white space and merges within words, so that ids of words can be kept for their
    repeats; its own model merges each new word. Texts that fall outside the plain case are given to it whole.
    """

    def __init__(self, tokenizer_json: str, keep: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.keep = keep
        self.words, self.parts = _Kept(self._word), _Kept(self._part)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(256 + k) for k, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        found = self.model.tokenize(part if plain else part.encode().decode("latin-1").translate(self.shown))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PIECES(word)))

    def __call__(self, text: str | None) -> bytes:
        """Packed ids, little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD(text) or _SPECIAL in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > self.keep:
            self.words = _Kept(self._word)
        if len(self.parts) > self.keep:
            self.parts = _Kept(self._part)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def token_pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 1, config: PackConfig = PackConfig()) -> DataFrame:
    """Pieces of at most the capacity of each document's ids, its end id included: the columns of docs but text, and piece,
    start, length, ids (binary) and ids_crc32, which replace columns of these names. Null and empty texts have one piece,
    which is their end id.

    The tokenizer's file, which has a fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    step = 4 * config.capacity
    end = int(end_id).to_bytes(4, "little")

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids:binary,ids_crc32:long>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = WordTokens(shared.value)
        for column in texts:
            rows = []
            for t in column:
                ids = tokens(t) + end
                parts = [ids[a : a + step] for a in range(0, len(ids), step)]
                rows.append([(k, k * config.capacity, len(p) // 4, p, zlib.crc32(p)) for k, p in enumerate(parts)])
            yield pd.Series(rows)

    return texts_of(docs).select(*others(docs, "text", "piece", "start", "length", "ids", "ids_crc32"), F.inline(cut(F.col("text"))))


# --- packing ------------------------------------------------------------------------------------------------------------


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item and its place there, and the fill of each bin; each item goes where it leaves least room.

    Bins with the same room stand on one stack; bit r of an integer says whether there is one with room r, so that the least
    room that suffices is its lowest bit at or above the item's size.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    fill: list[int] = []
    bins, places = [], []
    for size in sizes:
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                there &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins.append(b)
        places.append(fill[b])
        fill[b] += size
        room -= size
        if room:
            open_bins[room].append(b)
            there |= 1 << room
    return bins, places, fill


def _round(items: DataFrame, tasks: int, number: int, config: PackConfig) -> DataFrame:
    """items: rows of _row (passed on), item (rows with the same are one item), total (its size) and at (a row's place in it).
    Best-fit, largest items first, in each task; the same rows with the bins as items, and done for those that are nearly full."""
    dealt = items.repartition(tasks, F.xxhash64("item", F.lit(number))).sortWithinPartitions(F.desc("total"), "item", "at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches]) if (batches := [*batches]) else None
        if rows is None or not rows.num_rows:
            return
        item, total, at = (rows.column(c).to_numpy() for c in ("item", "total", "at"))
        first = np.r_[True, item[1:] != item[:-1]]
        bins, places, fill = best_fit(total[first].tolist(), config.capacity)
        own = np.cumsum(first) - 1
        b, base = np.array(bins)[own], np.array(places)[own]
        sums = np.array(fill)[b]
        made = (np.int64(number) << 56) + (np.int64(TaskContext.get().partitionId()) << 28) + b
        columns = [rows.column("_row"), *map(pa.array, (made, sums, at + base, sums >= config.capacity - config.slack))]
        yield from pa.table(columns, names=["_row", "item", "total", "at", "done"]).to_batches(max_chunksize=20_000)

    kinds = StructType([items.schema["_row"]]).add("item", "long").add("total", "long").add("at", "long").add("done", "boolean")
    return dealt.select("_row", "item", "total", "at").mapInArrow(pack, kinds)


def pack(pieces: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """The rows of pieces, each with sequence_id and offset: sequences of at most the capacity, gapless from 0.

    pieces has length, from 1 to the capacity. Each task packs some tens of thousands of pieces by best fit; sequences that
    are nearly full are out, and the others meet those of other tasks as items of further rounds, until one task holds them
    or a round joins fewer than one in fifty. What a round reads is a written table, so that a task that runs again packs the
    same. Equal rows are packed each by itself. Columns named sequence_id and offset are replaced, all others pass.
    """
    row = F.struct(*others(pieces, "sequence_id", "offset")).alias("_row")
    now = stored(pieces.select(row, F.monotonically_increasing_id().alias("item"), F.col("length").cast("long").alias("total"), F.lit(0).cast("long").alias("at")), "pieces")
    count = now.count()
    tasks = max(1, -(-count // config.per_task))
    out, number = [], 1
    while True:
        packed = stored(_round(now, tasks, number, config), f"packed-{number}")
        rest = packed.where("NOT done")
        left = rest.select("item").distinct().count()
        if tasks == 1 or left > 0.98 * count:
            out.append(packed)
            break
        out.append(packed.where("done"))
        tasks = max(-(-tasks // config.fan_in), -(-left // (config.fan_in * config.per_task)), 1)
        now, count, number = rest.drop("done"), left, number + 1
    return union_all(out).select("_row.*", F.col("item").alias("sequence_id"), F.col("at").alias("offset"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """Placed pieces of documents (doc_id, text) under the public word-level tokenizer; ids are left out once summed up."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = token_pieces(docs.select("doc_id", "text"), f.read(), config=config)
    return pack(pieces.drop("ids"), config)
