"""Protected stretches of a text (addresses, code, cited titles), and the range join that tells what lies within them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.text import ADDRESS

#: What may not be cut or changed, by kind: addresses of the web and of mail, and titles of works. Code is a stretch
#: between backticks on one line.
PATTERNS = {"address": ADDRESS, "title": "《[^》]*》", "code": "`[^`\n]+`"}
SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_spans(text: str, patterns: dict[str, str] = PATTERNS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the stretches of a text, by start; of those that overlap the first stands, and at one start the first
    kind. Offsets are in code points, end is behind the last one."""
    found = re.finditer("|".join(f"({p})" for p in patterns.values()), text)
    kinds = [*patterns]
    return [(kinds[m.lastindex - 1], m.start(), m.end()) for m in found]


def spans_of(text: Column | str, patterns: dict[str, str] = PATTERNS) -> Column:
    """find_spans of a column; null texts have none."""

    @F.pandas_udf(SPANS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series([find_spans(t, patterns) if t else [] for t in column])

    return found(text)


class Guard:
    """Tells whether a place, or a stretch, meets one of some disjoint spans, by binary search."""

    def __init__(self, spans: Sequence[tuple[int, int]]) -> None:
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def holds(self, place: int) -> bool:
        k = bisect_right(self.starts, place) - 1
        return k >= 0 and place < self.ends[k]

    def meets(self, start: int, end: int) -> bool:
        """Whether any of the places from start to before end is held."""
        k = bisect_right(self.starts, end - 1) - 1
        return start < end and k >= 0 and self.ends[k] > start


def within(hits: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """hits (by, start and others) with kind, the kind of the span (by, kind, start, end; disjoint within by) that the hit's start lies
    in, null if in none. Rows of by are sorted once together, and the last span that began before a hit, or with it, is carried to
    it: an as-of join, so that no hit meets all spans. Repeated hits stay; a null start lies in none.
    """
    names = [c for c in hits.columns if c != "kind"]
    none = lambda kind: F.lit(None).cast(kind)
    own = hits.select(*by, F.struct(*names).alias("_row"), F.col("start").cast("long").alias("_at"), F.lit(1).alias("_side"), none("struct<kind:string,end:long>").alias("_span"))
    span = F.struct("kind", F.col("end").cast("long").alias("end"))
    theirs = spans.where("start IS NOT NULL").select(*by, none(own.schema["_row"].dataType).alias("_row"), F.col("start").cast("long").alias("_at"), F.lit(0).alias("_side"), span.alias("_span"))
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_span", ignorenulls=True).over(order)
    met = own.unionByName(theirs).withColumn("_last", last).where("_side = 1")
    return met.select("_row.*", F.when(F.col("_at") < F.col("_last.end"), F.col("_last.kind")).alias("kind"))


def places_of(text: Column | str, pattern: str) -> Column:
    """Starts of a pattern's matches, array<int>; null texts have none."""
    find = re.compile(pattern).finditer

    @F.pandas_udf("array<int>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series([[m.start() for m in find(t)] if t else [] for t in column])

    return found(text)
