"""Toxicity scores from a factorization machine over hashed terms.

A text's features are the hashed terms that it holds (presence, not counts, so length does not drown them). The score is the sigmoid of
w0 + sum of w_i + sum over pairs of <v_i, v_j>, so a pair such as an insult with a group mention has a weight of its own beyond those
of its parts. Training is full-batch and deterministic, with a soft threshold on the w and on the rows of V that keeps terms without
evidence at zero. It reads at most SAMPLE labelled texts, those with the smallest hashes of doc_id; scoring reads every whole text.

The model has room for 2 * SCREENED terms: those that part the classes most by themselves, and those that part them most among texts
that hold one of the ANCHORS most toxic terms. So a word that is neutral by itself, such as a group's name, stays for its pairs.

Rows that repeat count as often as they are there, in training too, as do labels of one id that disagree. An empty table of labels gives
scores near 0, an empty table of documents no rows; very long texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Labelled texts that training reads at most.
SAMPLE = 6000
BUCKETS = 1 << 18
FACTORS = 4
#: A term of fewer training texts than this has no weight of its own.
LEAST_TEXTS = 3
#: Entries of each worker's cache of terms; it is emptied when full.
CACHE = 150_000

#: Terms that training goes on with, by themselves and again in the company of an anchor; a size of the model, not of the data.
SCREENED = 3000
ANCHORS = 64
#: Terms of the sample that are counted at once, which bounds what that takes beside them.
PART = 1 << 18
#: Lengths of the word beginnings that are terms beside the whole word, so that inflected forms share evidence.
BEGINNINGS = (4, 5, 6, 7)

_words = re.compile(r"[^\W_]+").findall


class _Buckets(dict):
    """Word -> buckets of its terms: the word and its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        terms = ["=" + word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]
        got = self[word] = tuple(zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms)
        return got


_buckets = _Buckets()


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's terms, ascending; one that two or more different words share counts as a second term, BUCKETS on."""
    if not text:
        return np.zeros(0, np.int32)
    found = np.fromiter(chain.from_iterable(map(_buckets.__getitem__, set(_words(text.lower())))), np.int32)
    once, times = np.unique(found, return_counts=True)
    return np.concatenate([once, once[times > 1] + BUCKETS])


@dataclass
class Model:
    """w0, and for the buckets in `index` (ascending) their w and V; all other buckets have none."""

    w0: float
    index: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def score(self, found: np.ndarray) -> float:
        if len(self.index):
            at = np.searchsorted(self.index, found)
            at = at[(at < len(self.index)) & (self.index[np.minimum(at, len(self.index) - 1)] == found)]
        else:
            at = np.zeros(0, int)
        v = self.v[at]
        z = self.w0 + self.w[at].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 300, thin: float = 0.003, thin_v: float = 0.0003, seed: int = 7) -> Model:
    """Proximal gradient steps with momentum on the mean log loss, both classes counting alike. One class only: its label is the score."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(-30.0 if not len(y) or y[0] == 0 else 30.0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    n = len(y)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    # numbered by counts and not by a sort, and factors taken one at a time below, as all terms of the sample are held at once
    every = np.concatenate(rows)
    texts = np.bincount(every)
    index, col = np.flatnonzero(texts), (np.cumsum(texts > 0, dtype=np.int32) - 1)[every]
    texts, kept = texts[index], np.zeros(len(index), bool)
    del every

    def screen(among: np.ndarray) -> np.ndarray:
        """Evidence of every term among some texts: how far the classes of those with it are off what all of them have, by its noise."""
        side = weight * (2 * y - 1)
        side = side - weight * (side[among].sum() / max(weight[among].sum(), 1e-12))
        apart, noise, times = np.zeros((3, len(index)))
        for at in range(0, len(col), PART):
            d, c = doc[at : at + PART], col[at : at + PART].astype(np.intp)
            of = among[d]
            d, c = d[of], c[of]
            np.add.at(apart, c, side[d])
            np.add.at(noise, c, (weight**2)[d])
            np.add.at(times, c, 1.0)
        return np.where(times >= LEAST_TEXTS, apart / np.maximum(np.sqrt(noise), 1e-12), 0)

    alone = screen(np.ones(n, bool))
    anchor = np.zeros(len(index), bool)
    anchor[np.argsort(-alone, kind="stable")[:ANCHORS]] = True
    for evidence in (np.abs(alone), np.abs(screen(np.bincount(doc, anchor[col], n) > 0))):
        order = np.argsort(-np.where(texts >= LEAST_TEXTS, evidence, 0), kind="stable")[:SCREENED]
        kept[order] = texts[order] >= LEAST_TEXTS
    on, place = kept[col], np.cumsum(kept) - 1
    doc, col, index = doc[on], place[col[on]].astype(np.int32), index[kept].astype(np.int32)
    m = len(index)
    w0, w, v = 0.0, np.zeros(m), np.random.default_rng(seed).normal(0, 0.05, (m, FACTORS))
    both = lambda which, x, size: np.stack([np.bincount(which, x(k), size) for k in range(FACTORS)], 1)
    # the loss bends at most as much as this diagonal, as features are not negative; so its inverse is a safe step for each weight
    terms = 1.0 + np.bincount(doc, minlength=n)
    bend = 0.25 * np.bincount(col, (weight * terms)[doc], m)
    step0, step = 1 / (0.25 * (weight * terms).sum()), 1 / bend
    speed = [0.0, np.zeros(m), np.zeros((m, FACTORS))]
    for _ in range(rounds):
        s = both(doc, lambda k: v[:, k][col], n)
        z = w0 + np.bincount(doc, w[col], n) + 0.5 * ((s**2).sum(1) - np.bincount(doc, (v**2).sum(1)[col], n))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        rc = r[doc]
        gw = np.bincount(col, rc, m)
        gv = (both(col, lambda k: rc * s[:, k][doc], m) - v * gw[:, None]) * (step / np.maximum(1, (s**2).sum(1).max()))[:, None]
        old = w, v
        speed = [0.9 * speed[0] - step0 * r.sum(), 0.9 * speed[1] - step * gw, 0.9 * speed[2] - gv * np.minimum(1, 0.1 / np.maximum(np.linalg.norm(gv, axis=1, keepdims=True), 1e-12))]
        w0, w, v = w0 + speed[0], w + speed[1], v + speed[2]
        w = np.sign(w) * np.maximum(np.abs(w) - thin * step, 0)
        v = v * np.maximum(1 - thin_v * step[:, None] / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), 0)
        speed[1:] = w - old[0], v - old[1]
    s = both(doc, lambda k: v[:, k][col], n)
    z = w0 + np.bincount(doc, w[col], n) + 0.5 * ((s**2).sum(1) - np.bincount(doc, (v**2).sum(1)[col], n))
    w0 -= best_cut(z, y, weight)
    live = (w != 0) | (v != 0).any(1)
    return Model(w0, index[live], w[live], v[live])


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where to cut z so that the weighted error is least; among cuts as good, the middle of the widest gap. The penalties pull single
    terms below 0 that no clean text has; moving w0 by the cut puts them on their side of a score of 0.5."""
    order = np.argsort(z, kind="stable")
    z, signed = z[order], (weight * (2 * y - 1))[order]
    error = np.cumsum(signed)[:-1]  # toxic texts below the cut less clean ones below it
    gap = np.diff(z)
    error = np.where(gap > 1e-6, error, np.inf)
    if not np.isfinite(error).any():
        return 0.0
    good = np.flatnonzero(error <= error.min() + 1e-9)
    at = good[np.argmax(gap[good])]
    return float((z[at] + z[at + 1]) / 2)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled documents whose crc32(doc_id as text) mod 5 is not 0; rows with a null id, label or text are not used."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "toxic": b.column(1), "found": pa.array([features(t).astype("<i4").tobytes() for t in b.column(2).to_pylist()], pa.binary())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, toxic = [], []
        for b in batches:
            found += [np.frombuffer(x.as_py(), "<i4") for x in b.column("found")]
            toxic += b.column("toxic").to_pylist()
        if found:
            got = fit(found, np.array(toxic))
            parts = {"index": got.index.astype("<i4"), "w": got.w.astype("<f8"), "v": got.v.astype("<f8")}
            yield pa.RecordBatch.from_pydict({"w0": pa.array([got.w0], pa.float64())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in parts.items()})

    kind = documents.schema["doc_id"].dataType.simpleString()
    # bounded by `sample` above; repeated ids in documents are cut to it again
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, found binary").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("found")).limit(sample)
    # a limit has one task; it fits the model there, as the driver should hold neither the sample nor what fitting takes beside it
    got = rows.mapInArrow(learn, "w0 double, index binary, w binary, v binary").first()
    if got is None:
        return fit([], np.zeros(0))
    return Model(got["w0"], np.frombuffer(got["index"], "<i4"), np.frombuffer(got["w"], "<f8"), np.frombuffer(got["v"], "<f8").reshape(-1, FACTORS))


def score_documents(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with score and predicted; null and empty texts get the score of a text without terms. Other columns pass through,
    except that columns already called score or predicted are replaced."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(features(t)) for t in texts], dtype=float)

    return documents.withColumn("score", score(F.coalesce(F.col(text), F.lit("")))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
