"""Operator 4: toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import held_out, stored, table, texts_of


@dataclass(frozen=True)
class MachineConfig:
    """max_rows, max_terms: labelled rows fitted at most, and hashed terms in them, drawn by hashes; the bound on what reaches the
    driver. buckets: hashed terms, all of which have a weight and a vector. factors: length of a term's vector. warm: epochs before
    vectors take part. rate_v: rate of the vectors. seen: rows at which a term counts half in pairs. turns, spread: of the vectors' start,
    rounds of power iteration and standard deviation of the pairs' sums. inner: one in so many rows judges the epochs. full, floor:
    see _scale. decay, decay_v: pull of weights and vectors towards zero, when their terms occur."""

    max_rows: int = 8_000
    max_terms: int = 4_000_000
    buckets: int = 1 << 18
    factors: int = 8
    epochs: int = 12
    warm: int = 3
    batch: int = 256
    rate: float = 0.3
    rate_v: float = 0.2
    seen: float = 10.0
    turns: int = 8
    spread: float = 1.0
    inner: int = 12
    full: float = 4.0
    floor: float = 0.05
    decay: float = 1e-4
    decay_v: float = 1e-3
    seed: int = 7
    threshold: float = 0.3


@dataclass
class Machine:
    """A bias, and a weight and a vector of each hashed term. values: what each term counts in pairs; the vectors have it in them
    already, and a text's pairs are divided by the sum of its terms' squared values, so that long texts aren't all pairs. Without
    values pairs count as they are."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    config: MachineConfig
    values: np.ndarray | None = None


class Terms:
    """Hashed distinct terms of texts: words at white space, in lower case, without punctuation at their ends, and the first
    4 and 5 letters of longer words, which stand for their inflected forms."""

    def __init__(self, buckets: int, most: int = 200_000) -> None:
        self.buckets, self.most, self.known = buckets, most, {}

    def of(self, word: str) -> tuple[int, ...]:
        term = word.lower().strip(_EDGES)
        heads = [f"^{term[:n]}" for n in (4, 5) if len(term) >= n] if term else []
        return tuple(zlib.crc32(x.encode("utf-8", "replace")) % self.buckets for x in ([term, *heads] if term else []))

    def __call__(self, text: str | None) -> np.ndarray:
        words = {*(text or "").split()}
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        for w in [w for w in words if w not in known]:
            known[w] = self.of(w)
        return np.array(sorted({*chain.from_iterable(map(known.__getitem__, words))}), np.int64)


_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-–—…«»“”‘’/\\_~`+=@^"


def score_terms(terms: np.ndarray, m: Machine) -> float:
    """Probability of toxicity: bias, weights of the terms there, and the products of all pairs of their vectors."""
    v = m.vectors[terms]
    norm = 1.0 if m.values is None else float((m.values[terms] ** 2).sum()) or 1.0
    raw = m.bias + float(m.weights[terms].sum()) + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v * v).sum()) / norm
    return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, config: MachineConfig = MachineConfig()) -> Machine:
    """Learn from docs (doc_id, text) with labels (doc_id, toxic). A document is toxic if any of its labels says so, and rows that
    repeat a doc_id with its text are one; rows with a null are left out. About max_rows labels at most are drawn, by a hash of the
    id, and of their documents so many that they hold about max_terms hashed terms, by a hash of the terms.

    The drawn labels, bounded so, are broadcast to the documents, which aren't shuffled; only hashed terms reach the driver.
    With rows of one class or none the machine is its bias alone.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic"))
    drawn = lambda key, part: F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(part * 1_000_003)
    part = config.max_rows / max(1, labels.count())
    if part < 1:
        labels = labels.where(drawn("doc_id", part))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(config.buckets)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "terms": [terms(t).astype("<i4").tobytes() for t in pdf.text], "toxic": pdf.toxic})

    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "text", "toxic")
    kept = stored(rows.mapInPandas(hashed, "doc_id long, terms binary, toxic int").distinct(), "labelled-terms")
    held = kept.agg(F.sum(F.length("terms") / 4)).first()[0] or 0
    part = config.max_terms / max(1, held)
    got = (kept.where(drawn("terms", part)) if part < 1 else kept).select("terms", "toxic").toPandas()
    got = got.sort_values(["terms", "toxic"], kind="stable", ignore_index=True)
    return learn([np.frombuffer(t, "<i4") for t in got.terms], got.toxic.to_numpy(np.float32), config)


class _Rows:
    """Rows of numbered terms: sums over the terms of each row, and over the rows of each term."""

    def __init__(self, rows: list[np.ndarray], terms: int) -> None:
        self.sizes, self.terms = np.array([r.size for r in rows]), terms
        self.at = np.concatenate(rows)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)
        self.full = self.sizes > 0
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.full]

    def by_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.sizes.size, *values.shape[1:]), values.dtype)
        if self.at.size:
            out[self.full] = np.add.reduceat(values[self.at], self.starts)
        return out

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=x[self.owner], minlength=self.terms)

    def pairs(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the sum of its terms' vectors, and the sum of the products of all pairs."""
        s = self.by_row(own)
        return s, 0.5 * ((s * s).sum(axis=1) - self.by_row((own * own).sum(axis=1)))


def learn(docs: list[np.ndarray], y: np.ndarray, config: MachineConfig = MachineConfig()) -> Machine:
    """Logistic loss by AdaGrad over mini-batches; a batch moves only the weights and vectors of its terms.

    Weights go first for some epochs. Vectors then start from what weights leave unexplained (_pairs_left), so that a pair is found
    whose terms tell nothing by themselves, and both are learned on. Of one in config.inner rows nothing is learned: the epoch that
    explains them best is kept.
    """
    share = (float(y.sum()) + 0.5) / (len(y) + 10)
    rng = np.random.default_rng(config.seed)
    bias = float(np.log(share / (1 - share)))
    zeros = np.zeros(config.buckets, np.float32)
    nothing = Machine(bias, zeros, np.zeros((config.buckets, config.factors), np.float32), config, zeros)
    if not sum(d.size for d in docs) or y.min() == y.max():
        return nothing
    known, flat = np.unique(np.concatenate(docs), return_inverse=True)
    docs = np.split(flat, np.cumsum([d.size for d in docs])[:-1])
    mixed = rng.permutation(len(docs))
    inner, outer = np.split(mixed, [len(docs) // config.inner])
    if y[outer].min() == y[outer].max() or not inner.size:
        inner, outer = mixed, mixed
    fitted, judged = (_Rows([docs[r] for r in rows], known.size) for rows in (outer, inner))
    scale = _scale(fitted.at, y[outer][fitted.owner], y[outer], known.size, config)
    often = np.bincount(fitted.at, minlength=known.size)
    value = (often / (often + config.seen)).astype(np.float32)
    norms = np.array([float((value[d] ** 2).sum()) for d in docs])
    share_of = np.where(norms > 0, 1 / np.maximum(norms, 1e-12), 0).astype(np.float32)  # what a row's pairs are divided by
    w, v = np.zeros(known.size, np.float32), np.zeros((known.size, config.factors), np.float32)
    gw, gv, gb = np.full(w.shape, 1e-3, np.float32), np.full(v.shape, 1e-3, np.float32), 1e-3
    best = (np.inf, bias, w, v)

    def raw_of(rows: _Rows, which: np.ndarray) -> np.ndarray:
        return bias + rows.by_row(scale * w) + share_of[which] * rows.pairs(value[:, None] * v)[1]

    for epoch in range(config.epochs):
        if epoch == config.warm:
            left = y[outer] - 1 / (1 + np.exp(-np.clip(raw_of(fitted, outer), -30, 30)))
            v = _pairs_left(fitted, (left - left.mean()) * share_of[outer], value, rng, config)
            spread = float((share_of[outer] * fitted.pairs(value[:, None] * v)[1]).std())
            v = (v * (config.spread / max(spread, 1e-9)) ** 0.5 + rng.normal(0, 0.01, v.shape)).astype(np.float32)
        order = rng.permutation(outer)
        for k in range(0, len(order), config.batch):
            which = order[k : k + config.batch]
            here, at = np.unique(np.concatenate([docs[r] for r in which]), return_inverse=True)
            rows = _Rows(np.split(at, np.cumsum([docs[r].size for r in which])[:-1]), here.size)
            own = value[here, None] * v[here]
            s, pairs = rows.pairs(own)
            raw = bias + rows.by_row(scale[here] * w[here]) + share_of[which] * pairs
            e = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[which]) / which.size
            dw = (scale[here] * rows.by_term(e) + config.decay * w[here]).astype(np.float32)
            gw[here] += dw * dw
            w[here] -= config.rate * dw / np.sqrt(gw[here])
            if epoch >= config.warm:
                e_pairs = e * share_of[which]
                dv = np.column_stack([rows.by_term(e_pairs * c) for c in s.T]) - rows.by_term(e_pairs)[:, None] * own
                dv = (value[here, None] * dv + config.decay_v * v[here]).astype(np.float32)
                gv[here] += dv * dv
                v[here] -= config.rate_v * dv / np.sqrt(gv[here])
            db = float(e.sum())
            gb += db * db
            bias -= config.rate * db / gb**0.5
        raw = np.clip(raw_of(judged, inner), -30, 30)
        loss = float((np.log1p(np.exp(raw)) - y[inner] * raw).mean())
        if epoch >= config.warm and loss < best[0]:
            best = (loss, bias, w.copy(), v.copy())
    _, bias, w, v = best
    weights, values = np.zeros(config.buckets, np.float32), np.zeros(config.buckets, np.float32)
    vectors = np.zeros((config.buckets, config.factors), np.float32)
    weights[known], vectors[known], values[known] = scale * w, value[:, None] * v, value
    return Machine(float(bias), weights, vectors, config, values)


def _pairs_left(rows: _Rows, left: np.ndarray, value: np.ndarray, rng: np.random.Generator, config: MachineConfig) -> np.ndarray:
    """Vectors whose products of pairs follow what is left of the labels: leading eigenvectors, with eigenvalues over zero, of the matrix
    that holds of each pair of terms the sum of left over the rows with both. The matrix is never made: power iteration takes
    sums over the rows' terms only."""
    alone = rows.by_term(left) * value**2

    def times(u: np.ndarray) -> np.ndarray:
        sums = np.column_stack([rows.by_row(np.ascontiguousarray(c)) for c in (value[:, None] * u).T])
        return np.column_stack([rows.by_term(left * c) * value for c in sums.T]) - alone[:, None] * u

    u = np.linalg.qr(rng.normal(size=(value.size, config.factors)))[0] if value.size >= config.factors else np.eye(value.size, config.factors)
    for _ in range(config.turns):
        u = np.linalg.qr(times(u))[0] if value.size >= config.factors else u
    strength, turn = np.linalg.eigh(u.T @ times(u))
    return (u @ turn) * np.sqrt(np.maximum(strength, 0))


def _scale(flat: np.ndarray, labels: np.ndarray, y: np.ndarray, n: int, config: MachineConfig) -> np.ndarray:
    """Value of each term as a feature of the weights: the square of its contrast between the classes in standard errors over a full one,
    between floor and 1. Terms that tell little learn slowly. In pairs terms count by how often they occur alone."""
    toxic, all_ = np.bincount(flat, weights=labels, minlength=n), np.bincount(flat, minlength=n)
    m = y.sum()
    apart = toxic / m - (all_ - toxic) / (len(y) - m)
    error = np.sqrt((all_ + 1) / len(y) * (1 / m + 1 / (len(y) - m)))
    return np.clip((apart / error / config.full) ** 2, config.floor, 1).astype(np.float32)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Each row of docs with score and predicted (1 if score reaches the threshold), without a shuffle.

    Whole texts are read. Null and empty texts get the score of no terms. Columns of docs named score or predicted are
    replaced, others pass; equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        terms = Terms(own.config.buckets)
        for column in texts:
            yield pd.Series([score_terms(terms(t), own) for t in column], dtype="float64")

    out = texts_of(docs).withColumn("score", scored(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= machine.config.threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    machine = fit(docs, labels)
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
