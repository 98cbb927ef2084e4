"""Spelling variants against comparisons of all pairs, and on awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillstone.llm import spelling
from quillstone.llm.spelling import SpellConfig


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(n, ratio=10):
    """word: (form, root, n, n_near, form_n) by all pairs."""
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got(found):
    rows = found.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def some(seed, size, letters, lengths):
    """Words that come in families: bases with edits of edits, so that all ways to part and runs of a letter are met."""
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(size // 4)}
    while len(words) < size:
        w = r.choice(sorted(words))
        k = r.randrange(len(w) + 1)
        words.add(r.choice([w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :]]) or "a")
    return {w: r.choice([1, 1, 2, 3, 10, 20, 20, 300, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("seed", range(12))
def test_merge_equals_all_pairs(seed):
    n = some(seed, 300, "ab" if seed % 2 else "abcé", (1, 2, 4, 7, 9))
    words = sorted(n)
    near, best = spelling.merge(words, [n[w] for w in words])
    for w, k, b in zip(words, near, best):
        found = [v for v in words if one_edit(w, v)]
        assert k == len(found)
        assert (words[b] if b is not None else None) == min(found, key=lambda v: (-n[v], v), default=None)


@pytest.mark.parametrize("seed, most", [(1, 10_000), (2, 40), (3, 7), (4, 1), (5, 3)])
def test_variants_equal_all_pairs(spark, seed, most):
    n = some(seed, 260, "abcÿ", (1, 3, 5, 8))
    rows = spark.createDataFrame([*n.items()], "word string, n long").repartition(3)
    assert got(spelling.variants(rows, SpellConfig(most=most))) == plain(n)


def test_a_long_prefix_that_most_words_share_is_cut(spark):
    """Two thirds of the words begin alike; very long words and words that begin others stand among them."""
    r = random.Random(9)
    begin = "verylongprefix" * 8
    n = {begin + w: c for w, c in some(9, 120, "abc", (1, 2, 4)).items()} | some(10, 60, "abc", (3, 5)) | {begin: 7, begin[:-1]: 90, "x" * 5000: 100, "x" * 5001: 3, "x" * 4999 + "y": 1000}
    rows = spark.createDataFrame([*n.items()], "word string, n long")
    for most in (5, 1000):
        assert got(spelling.variants(rows, SpellConfig(most=most))) == plain(n)
    top = spelling.top_of(rows, 5)
    assert any(t.prefix == begin for t in top) and len(top) < 120, r


def test_null_repeated_and_empty(spark):
    kinds = "word string, n long, form string, root int"
    rows = [("letters", 30, "a", 1), ("letters", 70, "b", 2), ("lettrs", 3, None, None), (None, 5, None, None), ("", 2, None, None), ("x", 20, None, None), ("nulls", None, None, None)]
    assert got(spelling.variants(spark.createDataFrame(rows, kinds))) == plain({"letters": 100, "lettrs": 3, "": 2, "x": 20})
    none = spelling.variants(spark.createDataFrame([], kinds))
    assert none.collect() == [] and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(rows, kinds), SpellConfig(ratio=1))


def counted(rows, slips, least, min_count):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slips and h % slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= min_count}


def test_counts_equal_a_plain_loop(spark):
    r = random.Random(2)
    stock = ["Straße", "ÄRGERLICH", "ärgerlich", "İstanbul", "occurred", "OCCURRED", "naïveté×÷", "a1b2", "漢字", "x" * 3000, "wonderful", "wonderfull"]
    rows = [(k % 50, " ".join(r.choice(stock) + r.choice(["", ".", "-", "'s"]) for _ in range(40))) for k in range(80)]
    rows += [(None, "wonderful " * 5), (7, None), (8, ""), (8, "wonderful"), (8, "wonderful"), (9, "wonderful " * 4000)]
    docs = spark.createDataFrame([(d, t, "w", 5) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    for slips, held in ((0, 5), (3, 1000), (31, 1)):
        found = {r.word: r.n for r in spelling.word_counts(docs, SpellConfig(min_length=6, held=held), slips).collect()}
        assert found == counted(rows, slips, 6, 2)
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = counted(docs, 31, 7, 2)
    edits: dict[str, set[str]] = {}
    for w in n:
        for k in range(len(w)):
            edits.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
    near: dict[str, set[str]] = {w: set() for w in n}
    for same in edits.values():
        for w in same:
            near[w] |= same - {w}
    for w in n:
        for k in range(len(w)):
            if (short := w[:k] + w[k + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    found = spelling.op12_spelling(spark, sf).collect()
    assert {r.word: (r.n, r.n_near) for r in found} == {w: (n[w], len(near[w])) for w in n}
    forms = {w: min(v, key=lambda x: (-n[x], x), default=None) for w, v in near.items()}
    forms = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in forms.items()}
    assert {r.word: r.form for r in found} == forms and any(forms.values())
    for r in found:
        last = r.word
        while forms[last] is not None:
            last = forms[last]
        assert r.root == last and r.form_n == n.get(r.form)
