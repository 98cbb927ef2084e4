"""Operator 11: token ids in binary files of directly addressable codes.

An id is cut into chunks of a few bits, the lowest first. Level 0 of a file holds the first chunk of each of its ids; a bitmap beside
it says which ids go on, and level k + 1 holds the next chunk of those, in order. A rank directory counts a bitmap's ones before each
block of 512 bits, so that the place of an id in the next level takes one directory entry and at most 64 bytes of bitmap: any id
is read by a few bytes of each level, whatever stands around it.

A file: the header (MAGIC, levels, ids, documents, and of each level its bits, chunks and the offsets of chunks, bitmap and
directory), the levels, then the documents: ids, flags of ids that aren't null, and the place of each first token, with the end of
the last. All numbers are little-endian. Files are written by tasks through pyarrow's file systems to a folder that driver and
executors share; a table of the committed tasks' files, which Spark writes, says which of them count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import shared_dir, stored, table, texts_of
from quillstone.llm.packing import WordTokens

MAGIC = b"QDAC0001"
_HEAD = struct.Struct("<8sQQQQQQ")  # magic; levels, ids, documents; offsets of document ids, flags, starts
_LEVEL = struct.Struct("<QQQQQ")  # bits, chunks; offsets of chunks, bitmap, directory
BLOCK = 512


@dataclass(frozen=True)
class FileConfig:
    """widths: bits of the chunks, each 1, 2, 4, 8, 16 or 32. file_tokens: a file is closed once it holds so many; a document isn't
    split, so that one may hold a document more. read_tokens: ids that a reader of documents decodes at a time, about."""

    widths: tuple[int, ...] = (8, 8, 16)
    file_tokens: int = 1 << 24
    read_tokens: int = 1 << 19
    read_tasks: int = 20_000


# --- codes --------------------------------------------------------------------------------------------------------------


def _narrow(chunks: np.ndarray, width: int) -> bytes:
    """Chunks of so many bits as bytes; chunks under a byte share one, the first in its lowest bits."""
    if width >= 8:
        return chunks.astype(f"<u{width // 8}").tobytes()
    per = 8 // width
    padded = np.zeros(-(-chunks.size // per) * per, np.uint8)
    padded[: chunks.size] = chunks
    return np.bitwise_or.reduce(padded.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * width), axis=1).astype(np.uint8).tobytes()


def encode(ids: np.ndarray, widths: Sequence[int]) -> list[tuple[int, int, bytes, bytes, bytes]]:
    """Of each level: bits, chunks, and the bytes of chunks, bitmap and directory; the last level has no bitmap."""
    rest, levels = ids.astype(np.uint32), []
    for k, width in enumerate(widths):
        chunks = rest if width == 32 else rest & np.uint32((1 << width) - 1)
        more = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        on = more > 0
        body = _narrow(chunks, width)
        if k == len(widths) - 1:
            if on.any():
                raise ValueError(f"ids need more than {sum(widths)} bits")
            levels.append((width, rest.size, body, b"", b""))
            break
        blocks = np.add.reduceat(on, np.arange(0, on.size, BLOCK)) if on.size else np.zeros(0, np.int64)
        directory = np.concatenate(([0], np.cumsum(blocks))).astype("<u8")
        levels.append((width, rest.size, body, np.packbits(on, bitorder="little").tobytes(), directory.tobytes()))
        rest = more[on]
    return levels


def file_bytes(ids: np.ndarray, docs: Sequence[int | None], starts: Sequence[int], widths: Sequence[int]) -> list[bytes]:
    """The parts of a file, in order."""
    levels = encode(ids, widths)
    at = _HEAD.size + _LEVEL.size * len(levels)
    heads, parts = [], []
    for width, n, *three in levels:
        places = []
        for part in three:
            places.append(at)
            parts.append(part)
            at += len(part)
        heads.append(_LEVEL.pack(width, n, *places))
    named = np.array([d is not None for d in docs], np.uint8)
    index = [np.array([d or 0 for d in docs], "<i8").tobytes(), named.tobytes(), np.array([*starts, ids.size], "<u8").tobytes()]
    places = [at, at + len(index[0]), at + len(index[0]) + len(index[1])]
    return [_HEAD.pack(MAGIC, len(levels), ids.size, len(docs), *places), *heads, *parts, *index]


class TokenFile:
    """Reads a file by read(offset, length)."""

    def __init__(self, read) -> None:
        self.read = read
        magic, levels, self.tokens, self.docs, *self.index = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.levels = [_LEVEL.unpack_from(read(_HEAD.size, levels * _LEVEL.size), k * _LEVEL.size) for k in range(levels)]

    def _chunks(self, level: int, a: int, b: int) -> np.ndarray:
        width, _, at, _, _ = self.levels[level]
        if width >= 8:
            size = width // 8
            return np.frombuffer(self.read(at + a * size, (b - a) * size), f"<u{size}").astype(np.uint32)
        per = 8 // width
        first = a // per
        raw = np.frombuffer(self.read(at + first, -(-b // per) - first), np.uint8)
        spread = (raw[:, None] >> (np.arange(per, dtype=np.uint8) * width)) & ((1 << width) - 1)
        return spread.ravel()[a - first * per :][: b - a].astype(np.uint32)

    def _flags(self, level: int, a: int, b: int) -> np.ndarray:
        first = a // 8
        raw = np.frombuffer(self.read(self.levels[level][3] + first, -(-b // 8) - first), np.uint8)
        return np.unpackbits(raw, bitorder="little")[a - first * 8 :][: b - a].astype(bool)

    def _rank(self, level: int, a: int) -> int:
        """Ones of a level's bitmap before place a."""
        block = a // BLOCK
        before = int.from_bytes(self.read(self.levels[level][4] + 8 * block, 8), "little")
        rest = a - block * BLOCK
        return before + (int(self._flags(level, a - rest, a).sum()) if rest else 0)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids of the places from a to before b."""
        out = np.zeros(b - a, np.uint32)
        there, shift = np.arange(b - a), 0
        for k, level in enumerate(self.levels):
            if a == b:
                break
            out[there] |= self._chunks(k, a, b) << np.uint32(shift)
            if k == len(self.levels) - 1:
                break
            on = self._flags(k, a, b)
            a = self._rank(k, a)
            there, shift = there[on], shift + level[0]
            b = a + there.size
        return out

    def at(self, place: int) -> int:
        """The id of one place, by a few bytes of each level it reaches."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        return int(self.ids(place, place + 1)[0])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and the places of their first tokens with the end of the last."""
        ids, named, starts = self.index
        found = np.frombuffer(self.read(ids, 8 * self.docs), "<i8").tolist()
        there = np.frombuffer(self.read(named, self.docs), np.uint8).tolist()
        return [d if t else None for d, t in zip(found, there)], np.frombuffer(self.read(starts, 8 * (self.docs + 1)), "<u8").astype(np.int64)


def open_file(uri: str) -> TokenFile:
    """A file of any file system that pyarrow knows, read as asked for."""
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    source = system.open_input_file(path)
    return TokenFile(lambda at, n: source.read_at(n, at))


def _read_whole(uri: str) -> TokenFile:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        held = memoryview(source.read_buffer())
    return TokenFile(lambda at, n: held[at : at + n])


# --- tables -------------------------------------------------------------------------------------------------------------

FILES = "file string, part int, seq int, docs long, tokens long"


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int = 1, folder: str | None = None, config: FileConfig = FileConfig()) -> DataFrame:
    """Write the ids of documents (doc_id, text) to files in folder (else a new one in the shared folder), in ascending order of
    doc_id: rows (file, part, seq, docs, tokens, start) of the files, start being the ids before them.

    A document's ids are those of its text, null counting as empty, and end_id. Rows without a doc_id come first; rows that share
    one are documents of their own, ordered by a hash of the text and by where they stand in the input. Other columns are left
    out, as files hold ids. Rows are dealt by ranges of this order, so that one doc_id in many rows is no hot key; each task
    writes files of about config.file_tokens, which it holds one at a time. Names are new for each attempt of a task, and the
    table lists those of the attempts that were committed: files that a lost task left are read by nothing.
    """
    spark = docs.sparkSession
    place = f"{folder or shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(tokenizer_json)  # the tokenizer's file has a fixed size
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = WordTokens(shared.value), TaskContext.get().partitionId()
        system, path = pyarrow.fs.FileSystem.from_uri(place)
        system.create_dir(path, recursive=True)
        own, ids, starts, at, seq = [], bytearray(), [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{path}/{name}") as out:
                for piece in file_bytes(np.frombuffer(ids, "<u4"), own, starts, config.widths):
                    out.write(piece)
            row = ([f"{place}/{name}"], [part], [seq], [len(own)], [at])
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["file", "part", "seq", "docs", "tokens"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                now = tokens(text.as_py()) + end
                own.append(doc)
                starts.append(at)
                ids += now
                at += len(now) // 4
                if at >= config.file_tokens:
                    yield close()
                    own, ids, starts, at, seq = [], bytearray(), [], 0, seq + 1
        if own:
            yield close()

    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_at")]
    dealt = texts_of(row).withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    files = stored(dealt.select("doc_id", "text").mapInArrow(write, FILES), "token-files")
    # the ids before a part: one row for each task of the writing stage
    totals = {r.part: r.tokens for r in files.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}
    before, rows = 0, []
    for part in sorted(totals):
        rows.append((part, before))
        before += totals[part]
    bases = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("within", within).join(bases, "part").select("file", "part", "seq", "docs", "tokens", (F.col("base") + F.col("within")).alias("start"))


def read_documents(files: DataFrame, with_ids: bool = False, config: FileConfig = FileConfig()) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and,
    if asked for, ids (binary), read back from files (file, start)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                file = _read_whole(uri)
                docs, starts = file.documents()
                first = 0
                while first < len(docs):
                    last = max(first + 1, int(np.searchsorted(starts, starts[first] + config.read_tokens, side="right")) - 1)
                    ids = memoryview(file.ids(int(starts[first]), int(starts[last])).astype("<u4")).cast("B")
                    at = ((starts[first : last + 1] - starts[first]) * 4).tolist()
                    parts = [ids[a:b] for a, b in zip(at, at[1:])]
                    columns = [pa.array(docs[first:last], pa.int64()), pa.array(starts[first:last] + base), pa.array(np.diff(starts[first : last + 1])), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    first = last

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    tasks = min(max(1, files.count()), config.read_tasks)
    return files.select("file", "start").repartition(tasks).mapInArrow(read, kinds)


def tokens_at(files: DataFrame, positions: DataFrame, config: FileConfig = FileConfig()) -> DataFrame:
    """positions (position and others) with token, the id that stands there in the whole corpus, counted from 0; rows whose position
    is null or beyond its end are left out. Positions meet files by stretches of config.file_tokens, so that no position meets
    all files; a file's positions are read one by one by their bytes."""
    cell = lambda c: F.floor(c / F.lit(config.file_tokens)).cast("long")
    spans = files.select("file", "start", "tokens", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("tokens") - 1))).alias("_cell"))
    kept = [F.col(c) for c in positions.columns if c != "token"]
    asked = positions.select(F.struct(*kept).alias("_row"), F.col("position").cast("long").alias("_position")).withColumn("_cell", cell(F.col("_position")))
    met = asked.join(spans, "_cell").where((F.col("_position") >= F.col("start")) & (F.col("_position") < F.col("start") + F.col("tokens")))
    met = met.select("_row", "file", (F.col("_position") - F.col("start")).alias("place")).repartition("file", F.pmod("place", F.lit(64))).sortWithinPartitions("file")

    kinds = met.select("_row", F.lit(0).cast("long").alias("token")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            found = []
            for name, place in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist()):
                if name != uri:
                    uri, file = name, open_file(name)
                found.append(file.at(place))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.int64())], names=["_row", "token"])

    return met.select("_row", "file", "place").mapInArrow(read, kinds).select("_row.*", "token")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        files = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), f.read())
    return read_documents(files)
