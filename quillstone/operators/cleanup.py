"""Clean-up of texts, and the difference of two versions of one."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: Marks, how many of each may stand, and what the others become.
MARKS = (("——", 1, "，"), ("……", 1, "。"), ("!", 3, "."), (";", 2, ","))
TYPED = "[一-龥][ \t\n][A-Za-z0-9]|[A-Za-z0-9][ \t\n][一-龥]"
#: Connectives and clichés that may open a sentence or clause, and what stands for those that end one.
CONNECTIVES = ("然而", "因此", "此外", "与此同时", "更重要的是", "另外", "而且", "值得注意的是", "值得一提的是", "由此可见", "不仅如此", "正因如此")
CLICHES = ("值得注意的是", "值得一提的是", "毋庸置疑", "毋庸讳言", "综上所述", "总而言之", "由此可见", "至关重要", "从长远来看", "总体而言", "在当今社会", "在一定程度上")
INSTEAD = {
    "展望未来": "往后看", "面向未来": "朝前看", "按下了快进键": "一下子快了起来", "迈上了新的台阶": "好了一个档次", "交出了一份满意的答卷": "做得挺让人满意",
    "具有里程碑意义": "值得记一笔", "具有十分重要的意义": "很重要", "具有十分重要的现实意义": "有实际用处", "具有深远的历史意义": "影响深远", "做出了不可磨灭的贡献": "出力不少",
    "站在新的历史起点上": "到了新阶段",
}
#: Entities of markup and their characters; the ampersand comes last, so that nothing is unescaped twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
BREAKS = r"(?i)<br[^>]*>|</(?:p|div|h[1-6]|li|tr|title|section|article)>"


def limit_marks(text: Column | str, marks: Sequence[tuple[str, int, str]] = MARKS) -> Column:
    """Of each mark (mark, most, instead) the first so many stay; the others become what stands instead."""
    out = T.col(text)
    for mark, most, instead in marks:
        out = T.let(F.split(out, re.escape(mark)), partial(_limited, mark, most, instead))
    return out


def _limited(mark: str, most: int, instead: str, parts: Column) -> Column:
    kept = F.array_join(F.slice(parts, 1, most + 1), mark)
    rest = F.transform(F.slice(parts, most + 2, F.greatest(F.lit(0), F.size(parts) - most - 1)), lambda p: F.concat(F.lit(instead), p))
    return F.concat(kept, F.array_join(rest, ""))


def dedupe_pads(text: Column | str, pads: Sequence[str]) -> Column:
    """Of each pad, which ends in its comma, only the first of the text stays."""
    return limit_marks(text, [(p, 1, "") for p in pads])


def strip_typed_spaces(text: Column | str) -> Column:
    """Spaces between Chinese and Latin characters go, unless the text itself is typed that way in one place at least."""
    t = T.col(text)
    out = F.regexp_replace(F.regexp_replace(t, "([一-龥，。；：、])[ \t]+([A-Za-z0-9])", "$1$2"), "([A-Za-z0-9%）)\\]])[ \t]+([一-龥])", "$1$2")
    return F.when(t.rlike(TYPED), t).otherwise(out)


def restore_typed_spaces(original: Column | str, rewritten: Column | str) -> Column:
    """Spaces between Chinese and Latin characters put back into a rewrite whose original has them. A character between two such
    places takes both, so each side is done by itself."""
    out = F.regexp_replace(F.regexp_replace(T.col(rewritten), "([一-龥])([A-Za-z0-9])", "$1 $2"), "([A-Za-z0-9])([一-龥])", "$1 $2")
    return F.when(T.col(original).rlike(TYPED), out).otherwise(T.col(rewritten))


def strip_leading(text: Column | str, connectives: Sequence[str] = CONNECTIVES) -> Column:
    """Connectives at the start of a sentence or the text go, with their comma."""
    return F.regexp_replace(T.col(text), f"(^|[。！？!?\n])[ \t]*{T.alternation(connectives, literal=True)}[，,]?", "$1")


def strip_cliches(text: Column | str, cliches: Sequence[str] = CLICHES, instead: dict[str, str] = INSTEAD) -> Column:
    """Clichés at the start of a clause go with their comma; those that hold a clause's predicate become plain words."""
    out = F.regexp_replace(T.col(text), f"(^|[。！？；，、\n]){T.alternation(cliches, literal=True)}，?", "$1")
    for phrase in sorted(instead, key=len, reverse=True):
        out = F.replace(out, F.lit(phrase), F.lit(instead[phrase]))
    return out


def strip_edges(text: Column | str) -> Column:
    """Each line without spaces and tabs at its ends."""
    return F.array_join(F.transform(F.split(T.col(text), "\n"), lambda s: F.regexp_replace(s, "^[ \t]+|[ \t]+$", "")), "\n")


def markup_text(html: Column | str) -> Column:
    """What a page shows: blocks on lines of their own, without scripts, styles, comments, tags and empty lines."""
    out = F.regexp_replace(F.regexp_replace(T.col(html), HIDDEN, " "), BREAKS, "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    lines = F.transform(F.split(out, "\n"), lambda s: F.regexp_replace(F.regexp_replace(s, "[ \t\r]+", " "), "^ | $", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence: the longest rising run of b's places, as a's parts meet them."""
    places = defaultdict(list)
    for k, x in enumerate(b):
        places[x].append(k)
    ends: list[int] = []
    for x in a:
        for k in reversed(places.get(x, ())):
            at = bisect_left(ends, k)
            ends[at : at + 1] = [k]
    return len(ends)


def diff_stats(pairs: DataFrame, delimiters: str) -> DataFrame:
    """pairs (before, after, ...) with sentences kept, deleted and inserted, in the order of both; null counts as empty."""

    @F.pandas_udf("long")
    def kept(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([common_length(list(a), list(b)) for a, b in zip(before, after)], dtype="int64")

    a, b = (T.sentences_runs(F.coalesce(c, F.lit("")), delimiters) for c in ("before", "after"))
    out = pairs.withColumn("_a", a).withColumn("_b", b).withColumn("kept", kept("_a", "_b"))
    return out.withColumn("deleted", F.size("_a") - F.col("kept")).withColumn("inserted", F.size("_b") - F.col("kept")).drop("_a", "_b")
