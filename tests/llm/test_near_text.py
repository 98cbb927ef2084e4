"""The pipeline's near-duplicate stage against all pairs by brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quillstone.llm import near_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def survivors(rows, least=0.8):
    """Smallest doc_id of each component of the pairs that are similar enough."""
    sets = [shingles(t) for _, t in rows]
    low = [*range(len(rows))]
    near = [[j for j in range(len(rows)) if jaccard(sets[i], sets[j]) >= least] for i in range(len(rows))]
    while (new := [min(low[j] for j in near[i]) for i in range(len(rows))]) != low:
        low = new
    first = {}
    for (d, _), c in zip(rows, low):
        first[c] = min(first.get(c, d), d)
    return sorted(first.values())


def edited(r, words, n):
    out = [*words]
    for i in r.sample(range(len(out)), n):
        out[i] = f"w{r.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows():
    """Copies with 0 to 12 words changed: similarities from 0.5 to 1, many on both sides of 0.8."""
    r = random.Random(8)
    texts = []
    for _ in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([120, 200, 300]))]
        texts += [" ".join(edited(r, base, r.randint(0, 12))) for _ in range(8)]
    texts += ["", " ", "one two", "One two", "a b c d e f", "same " * 40, "same " * 90]
    r.shuffle(texts)
    return [*enumerate(texts)]


def stage(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).repartition(3)
    return corpus_pipeline.near_duplicate_stage(spark, docs, "")


@pytest.mark.parametrize("block", [1_000_000, 600])
def test_stage_keeps_one_of_each_group(spark, rows, block, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "NEAR", near_text.NearConfig(block=block))
    got = sorted(x.doc_id for x in stage(spark, rows).collect())
    assert got == survivors(rows)


def test_rows_that_share_an_id_but_not_a_text_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "a b c d e f g")]
    got = sorted((x.doc_id or 0, x.text) for x in stage(spark, rows).collect())
    assert got == [(0, "a b c d e f g")] * 2 + [(1, "a b c d e f g"), (1, "h i j k l m n")]


def test_similar_links_at_the_threshold_and_not_below():
    sets = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 9), (1, 10), (0, 0), (50, 50), (100, 110), (103, 113))]
    child, root = near_text.similar(sets, 0.8)
    assert [*zip(child, root)] == [(1, 0), (3, 2)]
