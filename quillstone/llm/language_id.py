"""Operator 6: language identification by mixtures of languages, fitted per document by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, held_out, others, table, texts_of

UNKNOWN = "und"


@dataclass(frozen=True)
class MixtureConfig:
    """buckets: hashed n-grams a table of each language holds (a power of 2). orders: lengths of the n-grams, in code points.
    max_model_mb: a model that would be larger is refused by an error; no language is left out.
    penalty: log-likelihood a further language must add per language and log of n-grams, as in BIC.
    floor: a language of the chosen set has this share at least."""

    buckets: int = 1 << 16
    orders: tuple[int, ...] = (2, 3)
    max_model_mb: int = 1024
    rounds: int = 12
    penalty: float = 0.5
    floor: float = 0.1
    smoothing: float = 0.5


@dataclass
class LanguageModel:
    languages: list[str]
    log_likelihood: np.ndarray = field(repr=False)  # buckets x languages
    config: MixtureConfig = MixtureConfig()

    def __post_init__(self) -> None:
        """Per bucket the best language's log-likelihood, and all likelihoods relative to it."""
        self.best = self.log_likelihood.max(axis=1) if self.languages else np.zeros(self.config.buckets, np.float32)
        self.relative = np.ascontiguousarray(np.exp(np.maximum(self.log_likelihood - self.best[:, None], -60)).T)


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-case text, anything but letters as a space, runs of spaces as one, a space at both ends."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "replace"), dtype="<u4")
    kept = np.empty(points.size + 2, np.uint32)
    kept[0] = kept[-1] = 32
    np.take(_LETTER, points, mode="clip", out=kept[1:-1])
    if points.size and int(points.max()) >= _LETTER.size:
        high = np.flatnonzero(points >= _LETTER.size)
        kept[high + 1] = [p if chr(p).isalpha() else 32 for p in points[high].tolist()]
    space = kept == 32
    space[1:] &= space[:-1]
    space[0] = False
    return kept[~space]


#: A letter's own code point, else a space; letters above are looked up one by one.
_LETTER = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x3000)), dtype=np.uint32, count=0x3000)


def _buckets(points: np.ndarray, config: MixtureConfig) -> np.ndarray:
    """Hashed n-grams of one text, all orders in one array."""
    out = []
    for n in config.orders:
        if points.size < n:
            continue
        h = np.full(points.size - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k : points.size - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(config.buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def fit(docs: DataFrame, config: MixtureConfig = MixtureConfig()) -> LanguageModel:
    """Learn n-gram likelihoods of each language from all rows of docs (text, lang); rows with a null are left out.

    Tasks add up n-grams in arrays of fixed size, one for each language they meet, and send only those, so what is shuffled
    is bounded by partitions x languages x buckets and what reaches the driver by languages x buckets. Every value of lang is
    learned; so many that the model passes max_model_mb (some 1300 languages) raise a ValueError.
    """
    spark = docs.sparkSession
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    most = config.max_model_mb * (1 << 20) // (12 * config.buckets)
    names = [r.lang for r in rows.select("lang").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} values of lang: raise max_model_mb or lower buckets")
    if not names:
        return LanguageModel([], np.zeros((config.buckets, 0), np.float32), config)
    names.sort()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf.text, pdf.lang):
                if lang not in sums:
                    sums[lang] = np.zeros(config.buckets, np.int64)
                sums[lang] += np.bincount(_buckets(_letters(text), config), minlength=config.buckets)
        for lang, n in sums.items():
            step = config.buckets // 16
            for k in range(16):
                yield pd.DataFrame({"lang": [lang], "block": [k], "counts": [n[k * step : (k + 1) * step].tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in pdf.counts)
        return pd.DataFrame({"lang": [key[0]], "block": [key[1]], "counts": [np.asarray(total).tobytes()]})

    schema = "lang string, block int, counts binary"
    found = rows.mapInPandas(count, schema).groupBy("lang", "block").applyInPandas(add, schema).collect()
    counts = np.zeros((config.buckets, len(names)))
    step = config.buckets // 16
    for r in found:
        counts[r.block * step : (r.block + 1) * step, names.index(r.lang)] = np.frombuffer(r.counts, np.int64)
    smooth = counts + config.smoothing
    return LanguageModel(names, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), config)


def mixture(text: str | None, model: LanguageModel) -> tuple[str, float, list[str], list[float]]:
    """Main language, its share, and the chosen set of languages with their shares; und, 0 without letters or languages."""
    if text is None or not model.languages:
        return UNKNOWN, 0.0, [], []
    points = _letters(text)
    if points.size < 3:  # spaces at both ends only
        return UNKNOWN, 0.0, [], []
    grams, times = _tally(_buckets(points, model.config), model.config.buckets)
    like = np.take(model.relative, grams, axis=1)
    total = float(times.sum())

    def shares(subset: list[int]) -> np.ndarray:
        p = like if len(subset) == len(like) else like[subset]
        w = np.full(len(subset), 1 / len(subset), np.float32)
        if len(subset) > 1:
            for _ in range(model.config.rounds):
                new = w * (p @ (times / (w @ p)))
                new /= new.sum()
                moved, w = np.abs(new - w).max(), new
                if moved < 1e-3:
                    break
        return w

    def gain(subset: list[int], w: np.ndarray) -> float:
        """Log-likelihood of the text under the mixture, but for a term that all mixtures share."""
        return float(times @ np.log(w @ like[subset], dtype=np.float64))

    first = shares(list(range(len(model.languages))))
    order = np.argsort(-first, kind="stable").tolist()
    chosen, w = order[:1], np.ones(1, np.float32)
    for k in order[1:]:
        if first[k] < model.config.floor:
            break
        tried = shares([*chosen, k])
        more = gain([*chosen, k], tried) - gain(chosen, w)
        if tried.min() < model.config.floor or more <= model.config.penalty * np.log(total) * len(model.languages):
            break
        chosen, w = [*chosen, k], tried
    lead = max(range(len(chosen)), key=lambda i: (round(float(w[i]), 9), -chosen[i]))  # ties go to the first by name
    names = [model.languages[k] for k in chosen]
    return names[lead], float(min(1.0, max(0.0, first[chosen[lead]]))), names, [float(x) for x in w]


def _tally(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams with their counts; of a short text each one by itself, as that is faster than counting."""
    if grams.size < buckets // 4:
        return grams, np.ones(grams.size, np.float32)
    n = np.bincount(grams, minlength=buckets)
    found = np.flatnonzero(n)
    return found, n[found].astype(np.float32)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Each row of docs with lang_pred, score, lang_set and lang_shares, without a shuffle.

    EM over all languages estimates the shares of the document's n-grams; languages join the set, largest share first, while
    the log-likelihood gains more than the penalty. lang_pred has the largest share of the set, score is its share among all
    languages. Null texts and texts without a letter are und with score 0 and an empty set. Columns of docs with the new
    names are replaced; other columns pass. Equal texts get equal answers; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_set array<string>, lang_shares array<double>")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for column in texts:
            yield pd.DataFrame([mixture(t, own) for t in column], columns=["lang_pred", "score", "lang_set", "lang_shares"])

    new = ("lang_pred", "score", "lang_set", "lang_shares")
    kept, own = others(docs, *new), fresh(docs, "mixture")
    out = texts_of(docs).select(*kept, guess(F.col("text")).alias(own))
    return out.select(*kept, *(F.col(own)[n].alias(n) for n in new))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set", "lang_shares")
