"""Prose written as files: text or docx, each row one file, by a data source whose tasks commit together or leave nothing."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# The parts of a document package beside the text.
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="word/document.xml" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"/></Relationships>'
)
_WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})


def document_xml(text: str) -> str:
    """A text as the body of a document: paragraphs where lines are empty between, breaks for other ends of lines, tabs as such.
    Characters that XML can't hold are refused."""
    if _ILLEGAL.search(text):
        raise ValueError("a text has control characters, which a document can't hold")
    text = re.sub("\r\n?", "\n", text)

    def line(raw: str) -> str:
        return "<w:tab/>".join(f'<w:t xml:space="preserve">{s.translate(_ESCAPES)}</w:t>' if s else "" for s in raw.split("\t"))

    body = "".join(f"<w:p><w:r>{'<w:br/>'.join(map(line, p.split(chr(10))))}</w:r></w:p>" for p in re.split("\n{2,}", text))
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_WORDS}"><w:body>{body}<w:sectPr/></w:body></w:document>'


def docx_bytes(text: str) -> bytes:
    """A document package of a text; equal texts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS), ("word/document.xml", document_xml(text))):
            z.writestr(zipfile.ZipInfo(name), data.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder beneath the hidden one, and its counts."""

    folder: str
    files: int
    chars: int
    size: int
    empty: int


class ProseWriter(DataSourceWriter):
    """A task writes its rows to a folder of its own beneath a hidden one of the run. Commit moves each task's folder, by one rename, to
    where it is read, and then writes the report and the mark of success; abort deletes the hidden folder. A file system that pyarrow
    knows does for both driver and executors."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "txt"), overwrite
        self.name, self.text = options.get("name", "name"), options.get("text", "text")
        if self.kind not in ("txt", "docx"):
            raise ValueError(f"kind is txt or docx, not {self.kind}")
        if missing := {self.name, self.text} - {f.name for f in schema}:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        self.run = uuid.uuid4().hex

    def _place(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, path = self._place()
        folder = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        done, taken = Written(folder, 0, 0, 0, 0), set()
        for k, row in enumerate(iterator):
            if not k:
                system.create_dir(f"{path}/_run-{self.run}/{folder}", recursive=True)
            text = row[self.text] or ""
            data = docx_bytes(text) if self.kind == "docx" else text.encode("utf-8", "replace")
            base = re.sub(r"[^\w.-]+", "_", str(row[self.name])).strip("._")[:100] if row[self.name] is not None else ""
            stem = base = base or f"row-{k}"
            again = 1
            while stem.lower() in taken:
                again += 1
                stem = f"{base}-{again}"
            taken.add(stem.lower())
            with system.open_output_stream(f"{path}/_run-{self.run}/{folder}/{stem}.{self.kind}") as out:
                out.write(data)
            done.files, done.chars, done.size, done.empty = done.files + 1, done.chars + len(text), done.size + len(data), done.empty + (not text.strip())
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, path = self._place()
        system.create_dir(path, recursive=True)
        old = [i.path for i in system.get_file_info(pyarrow.fs.FileSelector(path)) if i.type == pyarrow.fs.FileType.Directory and i.base_name.startswith("part-")] if self.overwrite else []
        made = [m for m in messages if m is not None and m.files]
        for m in made:
            system.move(f"{path}/_run-{self.run}/{m.folder}", f"{path}/{m.folder}")
        for folder in old:
            system.delete_dir(folder)
        sums = {f"{k}": sum(asdict(m)[k] for m in made) for k in ("files", "chars", "size", "empty")}
        with system.open_output_stream(f"{path}/_report-{self.run}.json") as out:
            out.write(json.dumps({"kind": self.kind, "parts": len(made), **sums}).encode())
        with system.open_output_stream(f"{path}/_SUCCESS") as out:
            out.write(b"")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = self._place()
        hidden = f"{path}/_run-{self.run}"
        if system.get_file_info(hidden).type == pyarrow.fs.FileType.Directory:
            system.delete_dir(hidden)


class ProseSink(DataSource):
    """format("prose"): options path, kind (txt or docx), name and text (columns)."""

    @classmethod
    def name(cls) -> str:
        return "prose"

    def writer(self, schema: StructType, overwrite: bool) -> ProseWriter:
        return ProseWriter(self.options, schema, overwrite)


def write_prose(rows: DataFrame, path: str, kind: str = "txt", name: str = "name", text: str = "text", mode: str = "append") -> None:
    """Write each row of rows as a file of its text, named by a column; null texts are empty files. Names are made safe, those that a
    task has twice are numbered, and rows without one are named by their number. Either all tasks' files are there, with a report
    (files, chars, size, empty) beside them, or none is."""
    rows.sparkSession.dataSource.register(ProseSink)
    rows.select(name, text).write.format("prose").mode(mode).option("kind", kind).option("name", name).option("text", text).save(path)
