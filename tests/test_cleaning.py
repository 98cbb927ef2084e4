"""Files, differences of versions and streams."""

from __future__ import annotations

import zipfile
from functools import cache
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions.lexicon import LATIN
from quillstone.operators import cleanup
from quillstone.sources import files
from quillstone.streaming.scores import event_windows, score_stream

DATA = Path("/root/testdata/sf0.001")


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_length(a, b):
    @cache
    def slow(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + slow(i + 1, j + 1) if a[i] == b[j] else max(slow(i + 1, j), slow(i, j + 1))

    assert cleanup.common_length(a, b) == slow(0, 0)


def test_diff_stats(spark):
    pairs = spark.createDataFrame([(1, "One. Two. Three.", "One. Three. Four."), (2, None, "New."), (3, "", "")], "id int, before string, after string")
    found = {r.id: (r.kept, r.deleted, r.inserted) for r in cleanup.diff_stats(pairs, LATIN.delimiters).collect()}
    assert found == {1: (2, 1, 1), 2: (0, 0, 1), 3: (0, 0, 0)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿plain".encode())
    (tmp_path / "b.md").write_bytes("中文文本".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe" + "wide".encode("utf-16-le"))
    (tmp_path / "a_out.txt").write_bytes(b"made before")
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "other.csv").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p><w:r><w:t xml:space="preserve">A &amp; B</w:t><w:tab/><w:t>c</w:t></w:r></w:p><w:p><w:t>d</w:t></w:p>')
    found = {Path(r.path).name: r.text for r in files.read_files(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "plain", "b.md": "中文文本", "c.txt": "wide", "broken.docx": None, "d.docx": "A & B\tc\n\nd"}


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
def test_streams_give_what_tables_give(spark, tmp_path):
    def streamed(name, query, mode):
        table = spark.read.parquet(f"{DATA}/{name}.parquet")
        table.write.parquet(str(tmp_path / name))
        source = spark.readStream.schema(table.schema).parquet(str(tmp_path / name))
        run = query(source).writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination()
        return table, spark.table(f"s_{name}")

    table, found = streamed("documents", lambda d: score_stream(d, LATIN), "append")
    assert found.exceptAll(score_stream(table, LATIN)).isEmpty() and found.count() == table.count()
    keep = ("starts", "event_type", "n", "low", "high")
    table, found = streamed("events", lambda d: event_windows(d, late="2 hours"), "complete")
    wanted = event_windows(table.withColumn("ts", F.col("ts").cast("timestamp"))).select(*keep)
    assert found.select(*keep).exceptAll(wanted).isEmpty() and found.count() == wanted.count()
