"""Replacement of terms by a table of rules, with guards on what stands before and behind, and on protected stretches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.protect import PATTERNS, Guard, find_spans
from quillstone.sources.tables import in_small_batches

#: Rules that a table may hold, as every task holds them; larger ones are refused.
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """term: what is replaced, as it is written. instead: what may stand for it. not_after, not_before: texts that keep it as it is
    when they stand right before it, or right behind. whole: only where no letter or digit stands next to it."""

    term: str
    instead: tuple[str, ...]
    not_after: tuple[str, ...] = ()
    not_before: tuple[str, ...] = ()
    whole: bool = True


@dataclass
class Rules:
    """Rules that are ready to be looked for."""

    rules: Sequence[Rule]
    patterns: dict[str, str] = field(default_factory=lambda: PATTERNS)
    share: float = 1.0

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for r in self.rules:
            self.automaton.add_word(r.term, r)
        if len(self.automaton):
            self.automaton.make_automaton()

    def sites(self, text: str, key: str = "") -> list[tuple[int, int, str, str]]:
        """(start, end, term, instead) of the replacements in a text, by start.

        Terms that their guards keep, or that meet a protected stretch, are no candidates. Of the others the leftmost is taken, of
        those that start there the longest, and the next one from its end on. What stands instead, and whether a site is left
        alone, as all but a share of them are, is told by a hash of key, place and term, so that no other site moves it.
        """
        if not len(self.automaton) or not text:
            return []
        guard = Guard([s[1:] for s in find_spans(text, self.patterns)] if self.patterns else [])
        found = []
        for last, rule in self.automaton.iter(text):
            end = last + 1
            start = end - len(rule.term)
            if rule.whole and ((start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())):
                continue
            if rule.not_after and text.endswith(rule.not_after, 0, start) or rule.not_before and text.startswith(rule.not_before, end):
                continue
            if not guard.meets(start, end):
                found.append((start, -end, rule))
        out, at = [], 0
        for start, minus, rule in sorted(found, key=lambda f: f[:2]):
            if start < at:
                continue
            at = -minus
            drawn = hashlib.md5(f"{key}:{start}:{rule.term}".encode("utf-8", "replace")).hexdigest()
            if int(drawn[:8], 16) < self.share * (1 << 32):
                out.append((start, at, rule.term, rule.instead[int(drawn[8:16], 16) % len(rule.instead)]))
        return out


def rewritten(text: str, sites: Sequence[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, instead in sites:
        parts += [text[at:start], instead]
        at = end
    return "".join([*parts, text[at:]])


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules of a table (term, instead array<string>, and if it has them not_after, not_before array<string>, whole boolean). Rows
    without a term or anything to stand for it are left out; of rows that share a term the first in the order of all columns counts.
    A table of over MOST_RULES is refused by an error."""
    there = {*table.columns}
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), none) if c in there else none for c in ("not_after", "not_before")}
    whole = F.coalesce("whole", F.lit(True)) if "whole" in there else F.lit(True)
    instead = F.filter("instead", lambda x: x.isNotNull())
    rows = table.where((F.col("term") != "") & (F.size(instead) > 0)).select("term", instead.alias("instead"), *(c.alias(n) for n, c in lists.items()), whole.alias("whole"))
    got = rows.limit(MOST_RULES + 1).collect()
    if len(got) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules; every task holds all of them")
    first: dict[str, Rule] = {}
    for r in sorted(got, key=lambda r: (r.term, *map(tuple, (r.instead, r.not_after, r.not_before)), r.whole)):
        first.setdefault(r.term, Rule(r.term, tuple(r.instead), tuple(r.not_after), tuple(r.not_before), r.whole))
    return [*first.values()]


def replace_terms(docs: DataFrame, table: DataFrame, key: Column | str, text: Column | str = "text", patterns: dict[str, str] = PATTERNS, share: float = 1.0) -> DataFrame:
    """docs with rewritten, the text with the terms of a rules table replaced, and sites (array of start, end, term, instead), which
    replace columns of these names. key names a row for the hash of its sites. Null texts stay null, without sites.

    The rules, bounded by rules_of, go to every task; a text is read once for all of them, by an automaton, and no row moves.
    """
    rules = rules_of(table)

    @F.pandas_udf("rewritten string, sites array<struct<start:int,end:int,term:string,instead:string>>")
    def done(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ready = Rules(rules, patterns, share)
        for keys, texts in columns:
            sites = [ready.sites(t, k) if t is not None else [] for k, t in zip(keys, texts)]
            yield pd.DataFrame({"rewritten": [rewritten(t, s) if t is not None else None for t, s in zip(texts, sites)], "sites": sites})

    kept = [c for c in docs.columns if c not in ("rewritten", "sites")]
    key, text = (F.col(c) if isinstance(c, str) else c for c in (key, text))
    made = done(F.coalesce(key.cast("string"), F.lit("")), text)
    return in_small_batches(docs).withColumn("_done", made).select(*kept, "_done.rewritten", "_done.sites")
