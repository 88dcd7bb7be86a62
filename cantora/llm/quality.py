"""Quality by co-training a text-content and a page-metadata classifier.

Two logistic classifiers see different views of a document: statistics of its text, or its language, source and recorded
size. In each round, each gives the documents it is surest of (calibrated probability beyond ``sure``) to the other as
pseudo-labels. In the end a logistic layer, fitted on labelled rows that neither classifier has seen, calibrates and combines
both views, and scores every document; those below ``cut`` are rejected.

Labels come from a bounded sample of at most ``max_labelled`` labelled documents in the order of a hash of doc_id, never of those
that are held out. Pseudo-labels come from all other documents: their views are written once, and in each round every task
gives its ``per_round`` surest different ones of each label to each classifier, of which the surest ``per_round`` stay. Scoring
reads whole texts of all documents.

Nulls and empties: a null or empty text has zero statistics; null metadata has values of its own; a null doc_id is scored and
never a label; repeated rows get equal scores; documents with several labels have the smallest, labelled documents with several
rows the least row. Without labels of both kinds all documents get the score 1. Other columns pass through, whatever their names, and
``_quality`` gets underscores until it is new; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantora.llm.common import Scratch, fresh, held_out, slices, table, texts

MAX_LABELLED = 6_000
ROUNDS, SURE, PER_ROUND, CUT = 4, 0.97, 300, 0.3
META_BUCKETS = 32

_CLASSES = np.zeros(256, np.int64)
for _name, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "!", "?", ".", ",", "|", "#$%&*~^@_=+", "<>{}[]()/\\", "\"':;-`"), 1):
    for _c in _chars:
        _CLASSES[ord(_c)] = _name
_CLASSES[128:] = 13
_REPEATED = re.compile(r"(?:^|\s)(\S+)(?=\s+\1(?:\s|$))")


def text_view(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 24
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_CLASSES[raw], minlength=14) / len(raw)
    count = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    return [
        *np.sqrt(share[1:]).tolist(),
        len(count) / n,
        pairs / max(n - 1, 1),
        same / n,
        max(count.values()) / n,
        len(text) / n / 10,
        math.log1p(max(map(len, count))),
        math.log1p(n) / 5,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)) / 5,
        sum(map(str.isupper, words)) / n,
        len(count) / n ** 0.8,
    ]


def meta_view(lang, source, n_chars) -> list[float]:
    """Hashed language and source, and the size in steps of its logarithm."""
    out = [0.0] * (META_BUCKETS + 12)
    for name, value in (("lang", lang), ("source", source)):
        out[xxhash.xxh3_64_intdigest(f"{name}={value}") % META_BUCKETS] += 1.0
    size = 0 if n_chars is None or n_chars < 0 else math.log10(n_chars + 1)
    out[META_BUCKETS] = float(n_chars is None)
    out[META_BUCKETS + 1 + min(int(2 * size), 10)] = 1.0
    return out


class Logistic:
    """Ridge logistic regression on standardised columns and their squares, classes weighted to balance."""

    def __init__(self, x: np.ndarray, y: np.ndarray, strength: float = 3.0):
        self.mean, self.size = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._wide(x)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        self.w = np.zeros(z.shape[1])
        ridge = strength * np.eye(z.shape[1])
        ridge[0, 0] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ self.w)
            self.w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.size, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z / 4])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide(x) @ self.w, -12, 12)


def _layer(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (base first) of a logistic layer over logits, drawn to what it needs least: one for text, none beyond."""
    from cantora.llm.toxicity import fit_logistic

    x = np.hstack([np.ones((len(logits), 1)), logits])
    prior = np.zeros(x.shape[1])
    prior[1] = 1.0
    return fit_logistic(x, y, prior)


def _split(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit with, and rows for calibration only."""
    known = np.arange(len(y))
    aside = known[known % 4 == 0]
    if len(set(y[aside])) < 2:
        aside = known
    base = np.setdiff1d(known, aside)
    return (base if len(set(y[base])) == 2 else known), aside


def _sure(model: Logistic, layer: np.ndarray, view: np.ndarray) -> np.ndarray:
    """Calibrated probability of label 1 by one classifier."""
    return 1 / (1 + np.exp(-np.clip(layer[0] + layer[1] * model.logit(view), -30, 30)))


def surest(models: list[Logistic], layers: list[np.ndarray], views: list[np.ndarray], sure: float) -> list[tuple]:
    """(receiver, label, probability, receiver's view) of the rows that the other classifier is sure of."""
    out = []
    for k in range(2):
        p = _sure(models[k], layers[k], views[k])
        for label, q in ((1, p), (0, 1 - p)):
            out += [(1 - k, label, float(q[i]), views[1 - k][i].tobytes()) for i in np.flatnonzero(q >= sure)]
    return out


def best_given(found: list[tuple], per_round: int) -> list[tuple]:
    """The surest per_round different rows for each receiver and label; ties to the smaller view."""
    out = []
    for receiver in range(2):
        for label in (1, 0):
            best: dict[bytes, float] = {}
            for k, y, q, raw in found:
                if k == receiver and y == label:
                    best[raw] = max(q, best.get(raw, 0.0))
            out += [(receiver, label, q, raw) for raw, q in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:per_round]]
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, free, rounds: int = ROUNDS, sure: float = SURE, per_round: int = PER_ROUND):
    """Both classifiers and the layer over them. y: 0 or 1; free(models, layers) gives the surest of the unlabelled rows, as best_given() does."""
    base, aside = _split(y)
    views, given = [text, meta], [{}, {}]
    for turn in range(rounds + 1):
        models = []
        for k, view in enumerate(views):
            more = [np.frombuffer(raw) for raw in given[k]]
            x = np.vstack([view[base], *([np.array(more)] if more else [])])
            models.append(Logistic(x, np.concatenate((y[base], np.array(list(given[k].values()), float))).astype(float)))
        layers = [_layer(m.logit(v[aside])[:, None], y[aside].astype(float)) for m, v in zip(models, views, strict=True)]
        if turn == rounds:
            break
        for receiver, label, _, raw in free(models, layers):
            given[receiver].setdefault(raw, label)
    both = np.stack([m.logit(v[aside]) for m, v in zip(models, views, strict=True)], axis=1)
    return models, _layer(both, y[aside].astype(float))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    names = batch.schema.names
    meta = [batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows for c in ("lang", "source", "n_chars")]
    return np.array([text_view(t) for t in texts(batch)]), np.array([meta_view(*m) for m in zip(*meta, strict=True)])


_VIEWS = "y int, text array<double>, meta array<double>"


def _write_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text, meta = _views(batch)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("_y")), pa.array(text.tolist(), pa.list_(pa.float64())), pa.array(meta.tolist(), pa.list_(pa.float64()))], ["y", "text", "meta"])


def _give(models: list[Logistic], layers: list[np.ndarray], sure: float, per_round: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in slices(batches, 4_096):
            if batch.num_rows:
                views = [batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in (0, 1)]
                found = best_given(found + surest(models, layers, views, sure), per_round)
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["receiver", "label", "q", "raw"])

    return run


def _score(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if model is None or not batch.num_rows:
                score = np.ones(batch.num_rows)
            else:
                models, layer = model
                both = np.stack([m.logit(v) for m, v in zip(models, _views(batch), strict=True)], axis=1)
                score = 1 / (1 + np.exp(-np.clip(layer[0] + both @ layer[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return run


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, sure: float = SURE, per_round: int = PER_ROUND):
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = F.broadcast(scratch.keep(known, "known"))  # max_labelled rows at most
    sample = docs.join(known, "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct(*(c for c in docs.columns if c != "doc_id"))).alias("row")).select("doc_id", "_y", "row.*")
    rows = sample.mapInArrow(_write_views, _VIEWS).collect()
    rows.sort(key=lambda r: (r["y"], r["text"], r["meta"]))
    y = np.array([r["y"] for r in rows])
    if len({*y}) < 2:
        return None
    others = docs.join(known.drop("_y"), "doc_id", "left_anti").withColumn("_y", F.lit(-1))
    others = scratch.keep(others.mapInArrow(_write_views, _VIEWS).select("text", "meta"), "others")

    def free(models, layers):
        found = others.mapInArrow(_give(models, layers, sure, per_round), "receiver int, label int, q double, raw binary")
        found = found.groupBy("receiver", "label", "raw").agg(F.max("q").alias("q"))
        nth = F.row_number().over(Window.partitionBy("receiver", "label").orderBy(F.desc("q"), "raw"))
        found = found.select("*", nth.alias("nth")).where(F.col("nth") <= per_round).collect()  # four times per_round rows at most
        return best_given([(r["receiver"], r["label"], r["q"], bytes(r["raw"])) for r in found], per_round)

    mixed = np.random.default_rng(5).permutation(len(y))
    model = co_train(np.array([r["text"] for r in rows])[mixed], np.array([r["meta"] for r in rows])[mixed], y[mixed], free, rounds, sure, per_round)
    scratch.free(others)
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs and _quality, the probability of label 1."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in ("lang", "source", "n_chars") if c in docs.columns))
    model = fit(seen, labels.select("doc_id", "quality"), Scratch(docs.sparkSession))
    (name,) = fresh(docs, "_quality")
    return docs.mapInArrow(_score(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op10_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("_quality").alias("score"), (F.col("_quality") >= CUT).alias("kept"))


QUERIES = {"op10_quality_cotraining": op10_quality_cotraining}
SQL: dict[str, str] = {}
