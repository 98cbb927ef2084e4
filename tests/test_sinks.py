"""Files of prose written by tasks that commit together, and read back."""

from __future__ import annotations

import io
import json
import zipfile
from pathlib import Path

import pytest

from quillstone.sources import sinks
from quillstone.sources.files import read_files

TEXTS = ["一段。\n第二行\t有制表符\n\n新的一段 <b>&\"'", "", None, "plain", "x" * 200_000, "😀 ümläut"]


def files(path, kind):
    return sorted(p.relative_to(path) for p in Path(path).rglob(f"*.{kind}"))


@pytest.mark.parametrize("kind", ["txt", "docx"])
def test_written_files_are_read_back(spark, tmp_path, kind):
    rows = [(f"doc {k}", t, k) for k, t in enumerate(TEXTS)] + [("doc 3", "again", 9), (None, "unnamed", 10), ("../a/b", "safe", 11)]
    path = str(tmp_path / "out")
    sinks.write_prose(spark.createDataFrame(rows, "name string, text string, other int").repartition(3), path, kind)
    found = [r.text for r in read_files(spark, path, recursive=True).collect()]
    assert sorted(found) == sorted(t or "" for _, t, _ in rows if t or kind == "docx")  # files of no bytes are written, but Spark lists none
    assert len(files(path, kind)) == len(rows)
    assert all(p.parts[0].startswith("part-") and len(p.parts) == 2 for p in files(path, kind))
    report = json.loads(next(Path(path).glob("_report-*.json")).read_text())
    assert (report["files"], report["chars"], report["empty"]) == (len(rows), sum(len(t or "") for _, t, _ in rows), 2)
    assert (Path(path) / "_SUCCESS").exists() and not [*Path(path).glob("_run-*")]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_prose(spark.createDataFrame([("a", "first")], "name string, text string"), path, "docx")
    before = sorted(Path(path).rglob("*"))
    bad = spark.createDataFrame([(f"n{k}", "fine" if k != 7 else "bad \x01") for k in range(40)], "name string, text string").repartition(4)
    with pytest.raises(Exception, match="control characters"):
        sinks.write_prose(bad, path, "docx")
    assert sorted(Path(path).rglob("*")) == before


def test_modes_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([("a", "first")], "name string, text string")
    for _ in range(2):
        sinks.write_prose(one, path)
    assert len(files(path, "txt")) == 2
    sinks.write_prose(one, path, mode="overwrite")
    assert len(files(path, "txt")) == 1
    sinks.write_prose(one.limit(0), str(tmp_path / "none"))
    assert files(tmp_path / "none", "txt") == []
    with pytest.raises(Exception, match="kind"):
        sinks.write_prose(one, path, "pdf")


def test_packages_are_plain_and_equal():
    data = sinks.docx_bytes("a\tb\nc\n\nd")
    assert data == sinks.docx_bytes("a\tb\nc\n\nd")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == ["[Content_Types].xml", "_rels/.rels", "word/document.xml"] and z.testzip() is None
        body = z.read("word/document.xml").decode()
    assert body.count("<w:p>") == 2 and body.count("<w:tab/>") == 1 and body.count("<w:br/>") == 1
