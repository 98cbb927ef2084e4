"""Texts cut to size: chunks of whole paragraphs and sentences, and the longest start that a budget allows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.tables import in_small_batches


@dataclass(frozen=True)
class ChunkConfig:
    """size: characters of a chunk at most. stops: marks behind which a paragraph that is longer may be cut."""

    size: int = 1000
    stops: str = "。！？!?"


#: Marks behind which a text may be cut to a budget.
BUDGET_STOPS = "。！？!?；;"


def chunks(text: str, config: ChunkConfig = ChunkConfig()) -> list[str]:
    """Chunks of a text, in order. Paragraphs, between empty lines, are put together while they fit, an empty line between them; longer
    ones are cut behind stops, and their pieces put together while they fit. Only a sentence that is longer by itself makes a longer
    chunk. Blank paragraphs, and blank ends of cut ones, are left out."""
    parts: list[str] = []
    for paragraph in re.split("\n{2,}", text):
        if len(paragraph) > config.size:
            parts += [p for p in _filled(re.findall(f"[^{config.stops}]*[{config.stops}]|[^{config.stops}]+$", paragraph), "", config.size) if p.strip()]
        elif paragraph.strip():
            parts.append(paragraph)
    return _filled(parts, "\n\n", config.size)


def _filled(parts: list[str], between: str, size: int) -> list[str]:
    """Neighbouring parts joined while they fit: a part begins anew where it doesn't."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(between) + len(p) <= size:
            out[-1] += between + p
        else:
            out.append(p)
    return out


def chunk_rows(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """A row for each chunk of docs (text and others): the other columns, chunk (its number from 0) and piece. Null and blank texts
    have none. A fold that begins anew where a chunk is full is no window, so a text is cut in one function call."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series([chunks(t, config) if t else [] for t in column])

    kept = [c for c in docs.columns if c not in ("text", "chunk", "piece")]
    return in_small_batches(docs).select(*kept, F.posexplode(cut("text")).alias("chunk", "piece"))


def within_budget(docs: DataFrame, budget: int, stops: str = BUDGET_STOPS) -> DataFrame:
    """docs with submitted, chars and truncated: the trimmed text where its characters other than white space are within the budget,
    else its longest start of whole sentences that is, and where not even the first is, so many characters. chars counts all of
    them. Null counts as empty."""
    count = re.compile(r"\S").findall
    pieces = re.compile(f"[^{stops}]*[{stops}]").finditer

    def cut(text: str | None) -> tuple[str, int, bool]:
        text = (text or "").strip()
        n = len(count(text))
        if n <= budget:
            return text, n, False
        left, last = budget, 0
        for m in pieces(text):
            left -= len(count(m[0]))
            if left < 0:
                break
            last = m.end()
        return (text[:last] if last else text[:budget]).strip(), n, True

    @F.pandas_udf("submitted string, chars int, truncated boolean")
    def done(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in texts:
            yield pd.DataFrame([cut(t) for t in column], columns=["submitted", "chars", "truncated"])

    kept = [c for c in docs.columns if c not in ("submitted", "chars", "truncated")]
    return in_small_batches(docs).withColumn("_cut", done("text")).select(*kept, "_cut.*")
