"""Two versions of a text: aligned sentences, characters within changed ones, and what explains each change."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.replace import Rule
from quillstone.sources.tables import in_small_batches

#: Marks that end a sentence, and the length up to which all rows of a table of lengths are kept.
DELIMITERS = "。！？!?\n"
MOST_CHARACTERS = 1500
ROWS = "array<struct<at:int,kind:string,before:string,after:string>>"


def units(text: str, delimiters: str = DELIMITERS) -> list[str]:
    """Sentences with their marks and the white space around them; together they are the text. White space alone joins the one before
    it, or the next if it comes first."""
    parts = re.findall(f"[^{delimiters}]*[{delimiters}]+|[^{delimiters}]+", text)
    out: list[str] = []
    for p in parts:
        if out and (not p.strip() or not out[-1].strip()):
            out[-1] += p
        else:
            out.append(p)
    return out


def common(a: Sequence[str], b: Sequence[str], most: int = MOST_CHARACTERS) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of a and b, in order. The way back prefers a match, then to leave out of a, whatever
    most is, which only bounds memory.

    That way takes a common end whole, and once it reaches a common start it leaves out of the longer side until the next match, so
    that the table is of what lies between. A row of lengths is one integer, in which a bit that isn't set says that the length grows
    there; a row follows from the one before by an addition (Hyyrö, "Bit-parallel LCS-length computation revisited", 2004). Where a
    or b has over most places, rows are kept at every so many steps and made again between, so that memory is about the square root of a's
    length times b's bits.
    """
    i, j = len(a), len(b)
    out = []
    while i and j and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
        out.append((i, j))
    least = min(i, j)
    start = next((k for k in range(least) if a[k] != b[k]), least)
    if start < least:
        i, j = _between(a[start:i], b[start:j], most, start, out)
    while i and j:  # one of them is within the common start
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i > j:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _between(a: Sequence[str], b: Sequence[str], most: int, start: int, out: list[tuple[int, int]]) -> tuple[int, int]:
    """The way back of common through the table of a and b, appended to out by places from start on; where it leaves the table."""
    n = len(b)
    every, matches = (1 << n) - 1, defaultdict(int)
    for j, x in enumerate(b):
        matches[x] |= 1 << j
    masks = [matches.get(x, 0) for x in a]
    step = 1 if max(len(a), n) <= most else isqrt(len(a))
    kept = [every]
    row = every
    for i, mask in enumerate(masks, 1):
        u = row & mask
        row = ((row + u) | (row - u)) & every
        if i % step == 0:
            kept.append(row)
    block, first = [], len(a) + 1  # rows from first on

    def at(i: int) -> int:
        nonlocal block, first
        if step == 1:
            return kept[i]
        if i < first:
            first = i // step * step
            block = [kept[first // step]]
            for mask in masks[first : min(first + step, len(a))]:
                u = block[-1] & mask
                block.append(((block[-1] + u) | (block[-1] - u)) & every)
        return block[i - first]

    i, j, length = len(a), n, n - row.bit_count()  # that of the places before i and j, which only a match lessens
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j, length = i - 1, j - 1, length - 1
            out.append((start + i, start + j))
        elif not at(i) >> (j - 1) & 1 or j - (at(i - 1) & ((1 << j) - 1)).bit_count() == length:  # it grows at j, or not at i
            i -= 1
        else:
            j -= 1
    return start + i, start + j


def aligned(a: Sequence[str], b: Sequence[str], key=str) -> list[tuple[str, str, str]]:
    """(kind, before, after): kept, or deleted and inserted ones between those, in order; key is what is compared."""
    out, i, j = [], 0, 0
    for x, y in [*common([key(u) for u in a], [key(u) for u in b]), (len(a), len(b))]:
        out += [("deleted", u, "") for u in a[i:x]] + [("inserted", "", u) for u in b[j:y]]
        if x < len(a):
            out.append(("kept", a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def sentences_aligned(before: str, after: str, delimiters: str = DELIMITERS) -> list[tuple[str, str, str]]:
    """aligned sentences, held against each other without the white space around them."""
    return aligned(units(before, delimiters), units(after, delimiters), str.strip)


def trimmed_parts(before: str, after: str) -> list[tuple[str, str, str]]:
    """One changed stretch between the common start and the common end."""
    least = min(len(before), len(after))
    i = next((k for k in range(least) if before[k] != after[k]), least)
    j = next((k for k in range(least - i) if before[-1 - k] != after[-1 - k]), least - i)
    rows = [("kept", before[:i], before[:i]), ("deleted", before[i : len(before) - j], ""), ("inserted", "", after[i : len(after) - j]), ("kept", before[len(before) - j :], before[len(before) - j :])]
    return [r for r in rows if r[1] or r[2]]


def characters_aligned(a: str, b: str, most: int = MOST_CHARACTERS) -> list[tuple[str, str, str]]:
    """aligned characters, of which neighbours of one kind are one row."""
    out, i, j, x0, y0 = [], 0, 0, 0, 0  # up to where rows are made, or kept characters from x0 and y0 on go
    for x, y in [*common(a, b, most), (len(a), len(b))]:
        if x > i or y > j:
            rows = (("kept", a[x0:i], b[y0:j]), ("deleted", a[i:x], ""), ("inserted", "", b[j:y]))
            out += [r for r in rows if r[1] or r[2]]
            x0, y0 = x, y
        i, j = x + 1, y + 1
    return [*out, ("kept", a[x0:], b[y0:])] if a[x0:] else out


def inline_parts(before: str, after: str, delimiters: str = DELIMITERS, most: int = MOST_CHARACTERS) -> list[tuple[str, str, str]]:
    """Kept, deleted and inserted parts: sentences that are kept stay whole, and where deleted ones stand against inserted ones their
    characters are aligned, whatever their number; most only bounds the memory of common."""
    out: list[tuple[str, str, str]] = []
    old: list[str] = []
    new: list[str] = []

    def close() -> None:
        a, b = "".join(old), "".join(new)
        if a and b:
            out.extend(characters_aligned(a, b, most))
        elif a or b:
            out.append(("deleted", a, "") if a else ("inserted", "", b))
        old.clear()
        new.clear()

    for kind, a, b in sentences_aligned(before, after, delimiters):
        if kind == "kept":
            close()
            out.append((kind, a, b))
        else:
            (old if kind == "deleted" else new).append(a or b)
    close()
    return out


def _diff(pairs: DataFrame, made, name: str) -> DataFrame:
    @F.pandas_udf(ROWS)
    def found(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, after in columns:
            rows = [made(a or "", b or "") for a, b in zip(before, after)]
            yield pd.Series([[(k, *r) for k, r in enumerate(own)] for own in rows])

    return in_small_batches(pairs).withColumn(name, found("before", "after"))


def sentence_diff(pairs: DataFrame, delimiters: str = DELIMITERS) -> DataFrame:
    """pairs (before, after and others) with sentences: array of at, kind, before, after. The befores of a row's array, joined, are its
    text before, and the afters its text after, whatever their white space. Null counts as empty."""
    return _diff(pairs, lambda a, b: sentences_aligned(a, b, delimiters), "sentences")


def inline_diff(pairs: DataFrame, delimiters: str = DELIMITERS) -> DataFrame:
    """pairs with parts, as sentence_diff, by characters within changed sentences."""
    return _diff(pairs, lambda a, b: inline_parts(a, b, delimiters), "parts")


def change_share(parts) -> dict:
    """Columns of an array of parts: characters kept, removed, added, and the share of change in percent of the text before, halves
    upwards; 0 for an empty one."""
    sizes = lambda kind, side: F.aggregate(F.filter(parts, lambda p: p["kind"] == kind), F.lit(0).cast("long"), lambda n, p: n + F.length(p[side]))
    kept, removed, added = sizes("kept", "before"), sizes("deleted", "before"), sizes("inserted", "after")
    total = kept + removed
    share = F.when(total > 0, F.floor((removed + added) / total * 100 + 0.5)).otherwise(0).cast("long")
    return {"kept": kept, "removed": removed, "added": added, "ratio": share}


# --- explanation --------------------------------------------------------------------------------------------------------

CAUSES = "array<struct<at:int,cause:string,before:string,after:string,certain:boolean>>"


def causes(before: str, after: str, replaced: Sequence[Rule], removed: dict[str, Sequence[str]], opened: Sequence[str], noted: Sequence[str], delimiters: str = DELIMITERS) -> list[tuple[str, str, str, bool]]:
    """(cause, before, after, certain) of each change between two texts. Deleted and inserted sentences are taken in pairs by their
    order. In a pair, each rule of which the term was in the old sentence and something that stands for it in the new one is a
    change of its own (vocabulary), the longest terms first, whose words are taken out of both. Without one, or where there is no new
    sentence, the first removed word of a kind in the old one names the kind; else the pair is restructured, or the old sentence
    trimmed. A new sentence alone is injected if it begins with one of opened or holds one of noted, else restructured. What isn't
    found in a list is a guess, not certain."""
    if not before or not after or before == after:
        return []
    rows = sentences_aligned(before, after, delimiters)
    old, new = ([r[1 + side].strip() for r in rows if r[0] == kind] for side, kind in ((0, "deleted"), (1, "inserted")))
    ordered = sorted(replaced, key=lambda r: -len(r.term))
    out: list[tuple[str, str, str, bool]] = []
    for k in range(max(len(old), len(new))):
        a, b = (x[k] if k < len(x) else "" for x in (old, new))
        if a and b:
            hits, rest_a, rest_b = [], a, b
            for r in ordered:
                if r.term in rest_a and (to := next((x for x in r.instead if x and x in rest_b), None)) is not None:
                    hits.append(("vocabulary", r.term, to, True))
                    rest_a, rest_b = rest_a.replace(r.term, "\0", 1), rest_b.replace(to, "\0", 1)
            if hits:
                out += hits
                continue
        if a:
            word = next(((kind, w) for kind, words in removed.items() for w in words if w in a), None)
            out.append((word[0], word[1], "", True) if word else ("structure" if b else "trim", a, b, False))
        else:
            word = next((w for w in opened if b.startswith(w)), None) or next((w for w in noted if w in b), None)
            out.append(("injection", "", word, True) if word else ("structure", "", b, False))
    return out


def explain(pairs: DataFrame, replaced: Sequence[Rule], removed: dict[str, Sequence[str]], opened: Sequence[str] = (), noted: Sequence[str] = (), delimiters: str = DELIMITERS) -> DataFrame:
    """pairs with causes, an array of at, cause, before, after and certain. The rules are bounded by rules_of."""

    @F.pandas_udf(CAUSES)
    def found(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, after in columns:
            rows = [causes(a or "", b or "", replaced, removed, opened, noted, delimiters) for a, b in zip(before, after)]
            yield pd.Series([[(k, *r) for k, r in enumerate(own)] for own in rows])

    return in_small_batches(pairs).withColumn("causes", found("before", "after"))


def explain_summary(explained: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, cause, certain, changes) of rows with causes: how many changes each has; their sum is the number of all changes."""
    each = explained.select(*by, F.explode("causes").alias("one")).select(*by, "one.cause", "one.certain")
    return each.groupBy(*by, "cause", "certain").agg(F.count("*").alias("changes"))
