"""Files of prose as rows: plain text in several encodings, and word-processor documents."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("txt", "md", "docx")
_BLOCK = re.compile(r"<w:p[ >/].*?</w:p>|<w:p/>", re.S)
_PIECE = re.compile(r"<w:t(?: [^>]*)?>(.*?)</w:t>|<w:(br|tab)(?: [^>]*)?/>", re.S)


def decode(raw: bytes) -> str:
    """Text of a file: by its byte order mark, else as UTF-8, else as GBK, else as UTF-8 with replacement marks."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    for name in ("utf-8", "gbk"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def docx_text(raw: bytes) -> str | None:
    """Paragraphs of a word-processor document, a blank line between them; None if the file can't be read as one."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, EOFError):
        return None
    signs = {"br": "\n", "tab": "\t"}
    blocks = ("".join(signs[m[2]] if m[2] else unescape(m[1]) for m in _PIECE.finditer(b)) for b in _BLOCK.findall(xml))
    return "\n\n".join(blocks)


def read_files(spark: SparkSession, path: str, recursive: bool = False, made_suffix: str = "_out", max_bytes: int | None = None) -> DataFrame:
    """path, text and n_bytes of the files of prose under path. Files whose stem ends with made_suffix are results of earlier
    runs and left out, as are hidden ones and those over max_bytes. text is null where a document can't be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").load(path)
    if made_suffix:
        found = found.where(~F.col("path").rlike(re.escape(made_suffix) + r"\.[^./]+$"))
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)

    @F.pandas_udf("string")
    def text(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, contents in columns:
            yield pd.Series([docx_text(c) if p.endswith(".docx") else decode(c) for p, c in zip(paths, contents)], dtype=object)

    return found.select("path", text("path", "content").alias("text"), F.col("length").alias("n_bytes"))
