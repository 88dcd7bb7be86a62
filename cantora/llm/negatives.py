"""Hard negatives by exact inner-product search over k-means inverted lists with stored radii.

Components become integers, so scores are exact. Rows are dealt to cells, by k-means centroids of a bounded sample, and cells into
shards of some ``shard`` rows; in each shard k-means again makes inverted lists, stored with their centroids and the radius that holds
their rows. With anchor a, centroid c and radius r, Cauchy-Schwarz bounds every score of a list by <a, c> + |a| r from above and by
<a, c> - |a| r from below. A search visits lists by falling upper bound, skips those whose bounds lie outside its window of scores, and
stops when the bound falls strictly below the score of the k-th row it holds; an equal bound may hide a tie with a smaller id. Cells are
skipped by the same bounds. Each search first asks the cell of the nearest centroid, whose k-th score then prunes all others, so the
result is exact whatever the data are: without structure the bounds skip little and each anchor meets most rows.

Positives are an anchor's best rows of its own label. A positive's negatives are the best rows of other labels whose scores lie between
low % of the positive's score and that score. Anchors of a shard are dealt into blocks of ``BLOCK``, so no task holds more than a shard
and a block. Of rows with equal vector and label only the k + 1 smallest ids can be in any result, so a vector that fills a third of the table is a few rows of the index.

Rows without a vec_id or a label, or whose vector is null, holds a null or non-finite component, or differs in length from most, take no
part. Of rows that repeat a vec_id the smallest vector, then label, counts. Scaled components beyond +-2^27 are cut there, so that
scores of up to 256 components fit a long. Ties go to the smaller vec_id. Without rows there are no results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, table

POSITIVES, NEGATIVES, LOW, SCALE = 5, 5, 80, 256
#: Rows of a shard, sample rows that centroids are fitted on, cells at most, and anchors of a block.
SHARD, FIT_ROWS, CELLS, BLOCK = 8_192, 20_000, 1_024, 4_096
ROUNDS = 6
CUT = (1 << 27) - 1
MOST = (1 << 62) - 1


def k_means(rows: np.ndarray, count: int, seed: int = 12) -> np.ndarray:
    """At most so many centroids of the rows."""
    rng = np.random.default_rng(seed)
    centroids = np.unique(rows[rng.permutation(len(rows))[:count]], axis=0)
    for _ in range(ROUNDS):
        near = nearest(rows, centroids)
        held = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, rows)
        centroids = total[held > 0] / held[held > 0, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[k : k + 2048] @ centroids.T - half, axis=1) for k in range(0, len(rows), 2048)]) if len(rows) else np.empty(0, np.int64)


def radii(rows: np.ndarray, centroids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The largest distance of a row to its centroid, rounded up; 0 for none."""
    out = np.zeros(len(centroids))
    np.maximum.at(out, near, np.sqrt(((rows - centroids[near]) ** 2).sum(axis=1)))
    return out * (1 + 1e-9) + 1e-9


def bounds(anchors: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scores, anchors x centroids, with room for rounding."""
    middle, norm = anchors @ centroids.T, np.sqrt((anchors**2).sum(axis=1))[:, None]
    spread = norm * radius * (1 + 1e-9) + 1e-9 * norm * np.sqrt((centroids**2).sum(axis=1)) + 1e-6
    return middle - spread, middle + spread


def _matrix(column) -> np.ndarray:
    """Rows of integers from a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _exact(rows: np.ndarray) -> np.ndarray:
    """Floats where all products and sums stay below 2^53, else the integers."""
    return rows.astype(np.float64) if np.abs(rows).max(initial=0) ** 2 * rows.shape[1] < 1 << 53 else rows


@dataclass
class Cells:
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            rows = _matrix(batch.column(2)).astype(np.float64)
            near = nearest(rows, centroids)
            apart = np.sqrt(((rows - centroids[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(apart), *batch.columns], ["cell", "apart", "vec_id", "label", "v"])

    return run


_LISTS = "cell int, part int, centroid array<double>, radius double, ids array<long>, labels array<long>, components array<int>"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """Inverted lists of a shard, a row each."""
    whole, ids, labels = _matrix(table["v"]), table["vec_id"].to_numpy(), table["label"].to_numpy()
    rows = whole.astype(np.float64)
    centroids = k_means(rows, max(1, int(len(rows) ** 0.5)))
    near = nearest(rows, centroids)
    radius = radii(rows, centroids, near)
    order = np.argsort(near, kind="stable")
    out: list[list] = [[] for _ in range(5)]
    for mine in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
        c = near[mine[0]]
        for column, value in zip(out, (centroids[c], radius[c], ids[mine], labels[mine], whole[mine].reshape(-1)), strict=True):
            column.append(value)
    n = len(out[0])
    kinds = (pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = ["centroid", "radius", "ids", "labels", "components"]
    return pa.table({"cell": pa.array([key[0].as_py()] * n, pa.int32()), "part": pa.array([key[1].as_py()] * n, pa.int32())} | {name: pa.array(column, kind) for name, column, kind in zip(names, out, kinds, strict=True)})


_ASKS = "anchor_id long, label long, v array<int>, wants array<struct<high: long, low: long, floor: long>>"


def _route(cells: Cells, home: bool):
    """Anchors with the shards they ask: those of the cell of the nearest centroid, or all others that the bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            anchors = _matrix(batch.column(2)).astype(np.float64)
            low, high = bounds(anchors, cells.centroids, cells.radius)
            own = nearest(anchors, cells.centroids)
            for k, wants in enumerate(batch.column(3).to_pylist()):
                if home:
                    ask = [own[k]]
                else:
                    useful = np.zeros(len(cells.parts), bool)
                    for w in wants:
                        useful |= (high[k] >= max(w["low"], w["floor"])) & (low[k] <= w["high"])
                    useful[own[k]] = False
                    ask = np.flatnonzero(useful)
                to = [(c, p) for c in ask for p in range(cells.parts[c])]
                if to:
                    same = pa.array(np.full(len(to), k))
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in to], pa.int32()), pa.array([p for _, p in to], pa.int32()), *(x.take(same) for x in batch.columns)], ["cell", "part", "anchor_id", "label", "v", "wants"])

    return run


def search(lists: pa.Table, asks: pa.Table, k: int, same_label: bool) -> tuple[list, int]:
    """(anchor_id, high, vec_id, score) of the k best rows for each want of each anchor, and how many lists were visited."""
    sizes = pc.list_value_length(lists["ids"]).to_numpy()
    ends = np.cumsum(sizes)
    ids, labels = (np.concatenate(lists[name].to_pylist()).astype(np.int64) for name in ("ids", "labels"))
    anchors = _matrix(asks["v"])
    rows = _exact(np.concatenate([np.asarray(x, np.int64) for x in lists["components"].to_pylist()]).reshape(len(ids), -1))
    values = _exact(anchors) if rows.dtype == np.float64 else anchors
    rows = rows if values.dtype == np.float64 else rows.astype(np.int64)
    lower, upper = bounds(anchors.astype(np.float64), np.array(lists["centroid"].to_pylist()), lists["radius"].to_numpy())
    out, visited = [], 0
    for n, (anchor, label, wants) in enumerate(zip(asks["anchor_id"].to_pylist(), asks["label"].to_pylist(), asks["wants"].to_pylist(), strict=True)):
        order = np.argsort(-upper[n], kind="stable")
        high, least = np.array([w["high"] for w in wants]), np.array([max(w["low"], w["floor"]) for w in wants])
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in wants]
        at, step = 0, 1
        while at < len(order):
            ahead = order[at : at + step]
            ahead = ahead[((upper[n, ahead, None] >= least) & (lower[n, ahead, None] <= high)).any(axis=1)]
            at, step = at + step, 2 * step
            if len(ahead):
                visited += len(ahead)
                mine = np.concatenate([np.arange(ends[x] - sizes[x], ends[x]) for x in ahead])
                mine = mine[(labels[mine] == label) & (ids[mine] != anchor) if same_label else labels[mine] != label]
                score = (rows[mine] @ values[n]).astype(np.int64)
                for j in range(len(wants)):
                    fit = (score >= least[j]) & (score <= high[j])
                    found, points = np.concatenate((best[j][0], ids[mine[fit]])), np.concatenate((best[j][1], score[fit]))
                    first = np.lexsort((found, -points))[:k]
                    best[j] = found[first], points[first]
                    if len(first) == k:
                        least[j] = max(least[j], points[first[-1]])
            if at < len(order) and (upper[n, order[at]] < least).all():
                break
        for h, (found, points) in zip(high.tolist(), best, strict=True):
            out += zip([anchor] * len(found), [h] * len(found), found.tolist(), points.tolist(), strict=True)
    return out, visited


_FOUND = "anchor_id long, high long, vec_id long, score long"


def _search(k: int, same_label: bool):
    def run(lists: pa.Table, asks: pa.Table) -> pa.Table:
        found = search(lists, asks, k, same_label)[0] if lists.num_rows and asks.num_rows else []
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("anchor_id", "high", "vec_id", "score"), columns, strict=True)})

    return run


class Index:
    """Inverted lists of rows (vec_id, label, v: integers of one length), written in the shared folder."""

    def __init__(self, rows: DataFrame, scratch: Scratch, shard: int = SHARD, fit_rows: int = FIT_ROWS):
        self.scratch = scratch
        count = rows.count()
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").collect()
        centroids = k_means(np.array([r["v"] for r in sample], np.float64), min(CELLS, -(-count // shard)))
        assigned = scratch.keep(rows.select("vec_id", "label", "v").mapInArrow(_assign(centroids), "cell int, apart double, vec_id long, label long, v array<int>"), "assigned")
        radius, parts = np.zeros(len(centroids)), np.ones(len(centroids), np.int64)
        for cell, n, far in assigned.groupBy("cell").agg(F.count("*"), F.max("apart")).collect():  # CELLS rows at most
            radius[cell], parts[cell] = far * (1 + 1e-9) + 1e-9, -(-n // shard)
        self.cells = Cells(centroids, radius, parts)
        part = F.pmod(F.xxhash64("vec_id"), F.get(F.lit(parts.tolist()), F.col("cell"))).cast("int")
        self.lists = scratch.keep(assigned.withColumn("part", part).groupBy("cell", "part").applyInArrow(_build, _LISTS), "lists")
        scratch.free(assigned)

    def _ask(self, asks: DataFrame, home: bool, k: int, same_label: bool, blocks: int) -> DataFrame:
        routed = asks.mapInArrow(_route(self.cells, home), f"cell int, part int, {_ASKS}").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)))
        routed, key = self.scratch.keep(routed, "routed"), ["cell", "part", "block"]
        lists = self.lists.join(self.scratch.bounded(routed.select(*key).distinct(), "asked"), key[:2])
        found = lists.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(_search(k, same_label), _FOUND)
        return self.scratch.keep(_best(found, k), "found")

    def best(self, asks: DataFrame, k: int, same_label: bool) -> DataFrame:
        """The k best rows (anchor_id, high, vec_id, score, rank) for each want (high, low) of the asks (anchor_id, label, v, wants)."""
        asks = self.scratch.keep(asks.withColumn("wants", F.transform("wants", lambda w: F.struct(w.high.alias("high"), w.low.alias("low"), F.lit(-MOST).alias("floor")))), "asks")
        blocks = 1 + asks.count() // BLOCK
        first = self._ask(asks, True, k, same_label, blocks)
        floors = first.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("high", "score"))).alias("floors"))
        more = asks.join(floors, "anchor_id", "left")
        more = more.withColumn("wants", F.transform("wants", lambda w: F.struct(w.high.alias("high"), w.low.alias("low"), F.coalesce(F.col("floors")[w.high], F.lit(-MOST)).alias("floor")))).drop("floors")
        rest = self._ask(more, False, k, same_label, blocks)
        return _best(first.unionByName(rest).drop("rank"), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE, shard: int = SHARD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id, embedding, label) that
    is_anchor names; low % of the positive's score is the least that a negative may have."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = valid.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    usual = valid.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = F.transform("x", lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-CUT)), F.lit(CUT)).cast("int"))
    valid = valid.where(F.size("x") == usual["n"]).select("vec_id", "label", "x", whole.alias("v"), "asks")
    valid = valid.groupBy("vec_id").agg(F.min(F.struct("x", "v", "label")).alias("row"), F.max("asks").alias("asks")).select("vec_id", "row.label", "row.v", "asks")
    valid = scratch.keep(valid, "valid")
    nth = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))  # Spark keeps so many rows of a vector before it deals them out
    rows = scratch.keep(valid.select("vec_id", "label", "v", nth.alias("nth")).where(F.col("nth") <= max(positives, negatives) + 1).drop("nth"), "rows")
    index = Index(rows, scratch, shard, fit_rows)
    anchors = valid.where("asks").select(F.col("vec_id").alias("anchor_id"), "label", "v")

    every = F.array(F.struct(F.lit(MOST).alias("high"), F.lit(-MOST).alias("low")))
    near = scratch.keep(index.best(anchors.withColumn("wants", every), positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "near")
    # below zero the least allowed lies above the most
    score = F.col("positive_score")
    wants = F.collect_set(F.when(score >= 0, F.struct(score.alias("high"), F.expr(f"({low} * positive_score + 99) div 100").alias("low"))))
    asks = anchors.join(near.groupBy("anchor_id").agg(wants.alias("wants")).where(F.size("wants") > 0), "anchor_id")
    hard = index.best(asks, negatives, False).select("anchor_id", F.col("high").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_radius_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id))::int as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""

QUERIES = {"op12_radius_lists": op12_radius_lists}
SQL = {"op12_radius_lists": _SQL}
