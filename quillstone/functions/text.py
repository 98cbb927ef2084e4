"""Column builders for text: lengths, counts of patterns, splitters, normalisers.

Lengths are in code points. White space is an explicit class, as regular expression engines differ in what \\s covers.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\r\n\f\x0b\u3000\u00a0"
SPACE_CLASS = f"[{SPACES}]"
PUNCTUATION = r"\p{P}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once in a row."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns that are evaluated once in a row, whatever is made of them: they come from a generator of one row, which
    projections and filters are not merged with. Columns that df has already are replaced."""
    kept = [c for c in df.columns if c not in made]
    return df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in kept), F.inline_outer(F.array(F.struct(*(v.alias(c) for c, v in made.items())))))


def bare(text: Column | str) -> Column:
    """Text without white space. Plain spaces, which are nearly all, are cut out as bytes."""
    return F.regexp_replace(F.replace(col(text), F.lit(" "), F.lit("")), f"[{SPACES[1:]}]+", "")


def visible_length(text: Column | str) -> Column:
    return F.length(bare(text))


def trimmed(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(SPACES))


def flat(text: Column | str) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(col(text), f"{SPACE_CLASS}+", " ")


def half_up(x: Column) -> Column:
    """Rounded to an integer, halves upwards."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def norm(x: Column, low: float, high: float, invert: bool = False) -> Column:
    """Where x stands between low and high, 0 to 1, or the other way round."""
    r = clamp((x - low) / (high - low))
    return 1 - r if invert else r


def alternation(patterns: Sequence[str], literal: bool = False) -> str:
    """One pattern that matches where any of patterns does, the longest first."""
    ordered = sorted(patterns, key=len, reverse=True)
    return "(?:" + "|".join(re.escape(p) if literal else p for p in ordered) + ")"


def is_literal(pattern: str) -> bool:
    return re.fullmatch(r"[^\\.^$|?*+()\[\]{}]+", pattern) is not None


def any_of(text: Column | str, patterns: Sequence[str]) -> Column:
    """Whether any of patterns matches; plain words are looked for as bytes."""
    rest = [p for p in patterns if not is_literal(p)]
    found = [F.contains(col(text), F.lit(p)) for p in patterns if is_literal(p)] + ([col(text).rlike(alternation(rest))] if rest else [])
    return reduce(Column.__or__, found)


def occurrences(text: Column | str, word: str) -> Column:
    """How often a text holds a word, from left to right without overlaps, by the bytes that are left without it."""
    t = col(text)
    cut = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(word), F.lit("")))
    return F.when(~F.contains(t, F.lit(word)), 0).otherwise((cut / len(word.encode())).cast("int"))


def count(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


def some(text: Column | str, words: Iterable[str]) -> Column:
    """Whether the text holds any of words."""
    return reduce(Column.__or__, (F.contains(col(text), F.lit(w)) for w in words))


def count_of(text: Column | str, patterns: Sequence[str]) -> Column:
    """Sum of each pattern's own count; patterns that overlap each count. Plain words are counted as bytes."""
    total = F.lit(0)
    for p in patterns:
        total = total + (occurrences(text, p) if is_literal(p) else count(text, p))
    return total


def variety(text: Column | str, members: str) -> Column:
    """How many distinct characters of a class the text holds. Of a class without ranges, each is looked for as bytes."""
    if re.fullmatch(r"\[[^\[\]\\^&-]+-?\]", members):
        return sum((F.contains(col(text), F.lit(c)).cast("int") for c in dict.fromkeys(members[1:-1])), F.lit(0))
    return F.size(F.array_distinct(F.regexp_extract_all(col(text), F.lit(members), F.lit(0))))


def pieces(text: Column | str, delimiters: str) -> Column:
    """Text up to and with each delimiter, and the rest."""
    return F.regexp_extract_all(col(text), F.lit(f"[^{delimiters}]*[{delimiters}]|[^{delimiters}]+$"), F.lit(0))


def sentences_each(text: Column | str, delimiters: str, ignore: str) -> Column:
    """Pieces up to and with each delimiter, of text with flat white space; pieces of nothing but ignore are dropped."""
    return F.filter(F.transform(pieces(flat(text), delimiters), lambda s: F.trim(s)), lambda s: s.rlike(f"[^{delimiters}{ignore} ]"))


def sentences_runs(text: Column | str, delimiters: str) -> Column:
    """Pieces up to and with each run of delimiters, trimmed, without empty ones."""
    parts = F.regexp_extract_all(col(text), F.lit(f"[^{delimiters}]++[{delimiters}]*+|[{delimiters}]++"), F.lit(0))
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


#: Addresses of the web and of mail, whose local part has at most 64 characters, so that long runs of letters are read once.
ADDRESS = r"(?:https?://|www\.)[!-~]+|[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"


def all_but(characters: str, low: int = 0, high: int = 0x10FFFF) -> str:
    """Members of a class of the code points from low to high but characters, as ranges; a negated class of characters beyond Latin-1
    takes this engine ten times as long."""
    out, at = "", low
    for c in sorted({ord(c) for c in characters if low <= ord(c) <= high} | {high + 1}):
        out += f"\\x{{{at:x}}}-\\x{{{c - 1:x}}}" if at < c else ""
        at = c + 1
    return out


def sentences_apart_from_urls(text: Column | str, delimiters: str) -> Column:
    """As sentences_runs, but a delimiter within an address cuts nothing. delimiters are plain characters. (Possessive, so of this engine
    only.)

    An address begins with a character of a local part. Runs of others, and words in which none can begin for what stands behind
    them, are taken whole, so that an address is looked for at few places; texts that hold none of what each address holds are cut at
    their delimiters.
    """
    local = string.ascii_letters + string.digits + "_.+-"
    ends = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in delimiters) + "]"
    runs = "|".join(f"[{x}]++" for x in (all_but(delimiters + local, 0, 0xFF), all_but(delimiters, 0x100)))
    member = all_but("".join(map(chr, range(128))).translate({ord(c): None for c in local if c not in delimiters and c != "."}), 0, 127)
    safe = rf"[{member}]++(?:(?![A-Za-z0-9_.+\-@:])" + ("" if "." in delimiters else r"|\.(?![!-~])") + ")"
    unit = rf"(?:{runs}|(?>{safe})|(?>{ADDRESS})|[{all_but(delimiters)}])*+"
    parts = F.regexp_extract_all(col(text), F.lit(f"{unit}(?:{ends}+|$)"), F.lit(0))
    plain = F.regexp_extract_all(col(text), F.lit(f"[{all_but(delimiters)}]++{ends}*+|{ends}++"), F.lit(0))
    return F.filter(F.transform(F.when(some(text, ("://", "www.", "@")), parts).otherwise(plain), trimmed), lambda s: s != "")


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), "\n"), trimmed), lambda p: p != "")


def bigram_variety(text: Column | str) -> Column:
    """Share of distinct ones among the pairs of neighbouring characters, white space and punctuation left out; 0 without pairs. Pairs
    are numbers, made of the code points of both."""
    plain = F.regexp_replace(bare(text), f"{PUNCTUATION}+", "")

    def share(v: Column) -> Column:
        n = F.size(v) - 1
        pairs = F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), lambda a, b: a * F.lit(1 << 21) + b)
        return F.when(n > 0, F.size(F.array_distinct(pairs)) / n).otherwise(0.0)

    return let(F.transform(F.split(plain, ""), lambda c: F.ascii(c).cast("long")), share)


def windows(text: Column | str, size: int = 384, stride: int = 320) -> Column:
    """Stretches of size characters other than white space, each stride after the last; the last one closes the text."""
    t = bare(text)
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / stride).cast("int"))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * stride + 1, F.lit(size))))


def running_sum(values: Column, block: int = 16, levels: int = 4) -> Column:
    """Sums of an array of integers up to each place, blocks first, so that no long array is copied for each place. The sums of blocks
    are summed in blocks themselves, levels times, so that the work grows as the array does: only one sum in block ** levels is added
    up anew for each place. The sums of one block are there without a further level."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    each = lambda x, base: F.transform(x, lambda _, j: base + add(F.slice(x, F.lit(1), j + 1)))

    def within(b: Column) -> Column:
        after = lambda t: let(running_sum(t, block, levels - 1), lambda s: F.flatten(F.transform(b, lambda x, i: each(x, F.get(s, i) - F.get(t, i)))))
        return let(F.transform(b, add), after)

    def sums(v: Column) -> Column:
        n = F.ceil(F.size(v) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return F.when(F.size(v) > block, let(blocks, within)).otherwise(each(v, F.lit(0)))

    return F.coalesce(let(values, sums if levels else lambda v: each(v, F.lit(0))), F.array().cast("array<int>"))


def mean(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)


def deviation(values: Column, sample: bool = False) -> Column:
    """Standard deviation of an array, of the population or a sample; 0 for fewer than two."""
    n = F.size(values)
    add = lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    squares = F.transform(F.array(mean(values)), add)[0]
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(squares / (n - 1 if sample else n)))
