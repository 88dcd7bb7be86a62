"""Nearest neighbours by a hash-prefix forest.

Each of ``trees`` trees gives a vector a string of 48 bits: the side of a random plane through the middle of the data, whose
direction joins two sample vectors. Rows are kept sorted by their string within leaves, which are prefixes. A query descends to
its longest match in each tree; then all trees ascend together, a bit at a time, until they hold enough candidates or stand
at their leaves. Distances are exact; every vector is indexed. A query that finds fewer rows than it must is compared with
all vectors, in blocks of queries.

How many candidates are enough is fitted on a sample of ``fit_rows`` vectors and on halves and quarters of it, by brute force for
``probes`` of each: the candidates that the trees together hold at the level, between two whole ones, where they hold
``recall`` of the true neighbours. A line through the logarithms says how that number grows with the rows, at most in
proportion. Vectors without any structure need a large share. Leaves are no deeper than two levels above that and hold ``leaf`` rows by
the sample; larger ones are dealt out in parts of that size, each of which sees the leaf's queries, so that no task holds more.
Vectors go to the leaves with their strings: a query meets hundreds of rows of a leaf, so vectors fetched for each
pair of a query and a candidate would be more than a vector for each tree.

Where a query stops is read from a table of how many rows lie below each prefix of COUNT_BITS bits and in each leaf, which has the same
size whatever the rows are; only queries that must go deeper are counted in their leaves.

Vectors that are equal form one class with its k + 1 smallest ids, so a vector that fills a third of the table is one entry; queries
with equal vectors are searched once.

Vectors that are null, zero, hold null or non-finite components, or differ in length from most, take no part, nor do rows
without a vec_id. Ties go to the smaller vec_id; of rows that repeat a vec_id the smallest vector counts. With fewer candidates than
k a query returns them all; without rows there are no results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, slices, table

K, TREES, BITS = 10, 24, 48
LEAF, FIT_ROWS, PROBES, RECALL = 4_096, 20_000, 300, 0.94
COUNT_BITS = 12
BLOCK = 1_000


@dataclass
class Forest:
    planes: np.ndarray  # trees x bits x dims
    middles: np.ndarray  # trees x bits
    want: float  # candidates that are enough, summed over trees
    starts: list[np.ndarray]  # first key of each leaf
    depths: list[np.ndarray]
    parts: list[np.ndarray]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """trees x rows."""
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((x @ p.T > m) * weights).sum(axis=1, dtype=np.uint64) for p, m in zip(self.planes, self.middles, strict=True)])


def _enough(sample: np.ndarray, keys: np.ndarray, k: int, probes: int, recall: float) -> tuple[int, float]:
    """The deepest level at which the trees hold so much of the true neighbours, and how many rows they hold on the way to the next."""
    n = len(sample)
    probe = np.arange(0, n, max(1, n // probes))
    top = np.zeros((len(probe), min(k, n - 1)), np.int64)  # bits that a neighbour shares in its best tree
    for row, i in enumerate(probe):
        apart = ((sample - sample[i]) ** 2).sum(axis=1)
        apart[i] = np.inf
        near = np.argsort(apart, kind="stable")[: top.shape[1]]
        differ = keys[:, near] ^ keys[:, i : i + 1]
        top[row] = (BITS - np.frexp(differ.astype(np.float64))[1]).max(axis=0)
    held = [(top >= x).mean() if top.size else 1.0 for x in range(BITS + 1)]
    level = next((x for x in range(BITS, 0, -1) if held[x] >= recall), 0)
    ordered = np.sort(keys, axis=1)
    count = []
    for x in (level, min(level + 1, BITS)):
        ranges = [_ranges(tree, mine[probe], np.full(len(probe), x)) for mine, tree in zip(keys, ordered, strict=True)]
        count.append(max(sum((end - begin).mean() for begin, end in ranges), 1.0))
    spare = held[level] - held[min(level + 1, BITS)]
    part = (held[level] - recall) / spare if level and spare > 0 else 0.0
    return level, float(np.exp((1 - part) * np.log(count[0]) + part * np.log(count[1])))


def _grown(sample: np.ndarray, keys: np.ndarray, rows: int, k: int, probes: int, recall: float) -> tuple[int, float]:
    """The level for the sample, and how many candidates are enough among so many rows."""
    n = len(sample)
    level, count = _enough(sample, keys, k, probes, recall)
    sizes, counts = [n], [count]
    for m in (n // 2, n // 4):
        if m > 50 * k:
            sizes.append(m)
            counts.append(_enough(sample[:m], keys[:, :m], k, probes, recall)[1])
    power = np.polyfit(np.log(sizes), np.log(counts), 1)[0] if len(sizes) > 1 else 1.0
    return level, count * (max(rows, n) / n) ** min(max(power, 0.0), 1.0)


def grow(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, k: int = K, probes: int = PROBES, recall: float = RECALL) -> Forest:
    """Planes, the number of candidates that is enough, and leaves, from a sample of the vectors."""
    rng = np.random.default_rng(48)
    n, dims = sample.shape
    one, two = rng.integers(0, n, (2, trees, BITS))
    planes = sample[one] - sample[two] + 1e-3 * rng.standard_normal((trees, BITS, dims))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    middles = np.stack([np.median(sample @ p.T, axis=0) for p in planes])
    forest = Forest(planes, middles, 0.0, [], [], [])
    keys = forest.keys(sample)
    level, forest.want = _grown(sample, keys, rows, k, probes, recall)
    for tree in np.sort(keys, axis=1):
        starts, depths, parts, todo = [], [], [], [(0, 0)]
        while todo:
            prefix, depth = todo.pop()
            low = prefix << (BITS - depth)
            inside = np.searchsorted(tree, np.array([low, low + (1 << (BITS - depth))], np.uint64))
            size = (inside[1] - inside[0]) * rows / n
            if size <= leaf or depth >= max(level - 2, 0):
                starts.append(low)
                depths.append(depth)
                parts.append(max(1, round(size / leaf)))
            else:
                todo += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        forest.starts.append(np.array(starts, np.uint64))
        forest.depths.append(np.array(depths))
        forest.parts.append(np.array(parts))
    return forest


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), np.float64)


def _spread(forest: Forest, with_vectors: bool):
    """A row for each tree: its leaf, part and key. Queries (level >= 0) go to all parts of their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            asks = batch.column(1).to_numpy() >= 0
            for t, key in enumerate(forest.keys(_matrix(batch.column(2)))):
                leaf = np.searchsorted(forest.starts[t], key, side="right") - 1
                parts = forest.parts[t][leaf]
                times = np.where(asks, parts, 1)
                at = np.repeat(np.arange(len(key)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                part = np.where(asks[at], nth, batch.column(0).to_numpy()[at] % 1_000_003 % parts[at])
                rows = pa.array(at)
                columns = [pa.array(np.full(len(at), t, np.int32)), pa.array(leaf[at].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(forest.depths[t][leaf[at]].astype(np.int32)), pa.array(key[at].astype(np.int64))]
                columns += [batch.column(k).take(rows) for k in range(3 if with_vectors else 2)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "part", "depth", "key", "cid", "level", "v"][: len(columns)])

    return run


def _ranges(keys: np.ndarray, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys share the first ``level`` bits of each key ``at``."""
    shift = (BITS - level).astype(np.uint64)
    low = (at >> shift) << shift
    return np.searchsorted(keys, low), np.searchsorted(keys, low + (np.uint64(1) << shift))


def _tally(forest: Forest, bits: int):
    """How many rows of a partition lie below each prefix of so many bits (leaf = false) and in each leaf, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [np.zeros(1 << bits, np.int64) for _ in forest.starts]
        inside = [np.zeros(len(starts), np.int64) for starts in forest.starts]
        for batch in slices(batches, 1024):
            for t, key in enumerate(forest.keys(_matrix(batch.column(0)))):
                below[t] += np.bincount((key >> np.uint64(BITS - bits)).astype(np.int64), minlength=1 << bits)
                inside[t] += np.bincount(np.searchsorted(forest.starts[t], key, side="right") - 1, minlength=len(inside[t]))
        for leaf, each in ((False, below), (True, inside)):
            for t, counts in enumerate(each):
                node = np.flatnonzero(counts)
                columns = [pa.array(np.full(len(node), t, np.int32)), pa.array([leaf] * len(node), pa.bool_()), pa.array(node), pa.array(counts[node])]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "node", "n"])

    return run


def _shallow(forest: Forest, below: np.ndarray, inside: list[np.ndarray], want: int):
    """The level, down to the tallied one, at which each query (cid, v) stops; deep if it may stop further down."""
    bits = below.shape[1].bit_length() - 1
    levels = [below.reshape(len(below), 1 << x, -1).sum(axis=2) for x in range(bits + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            total = np.zeros((batch.num_rows, bits + 1), np.int64)
            for t, key in enumerate(forest.keys(_matrix(batch.column(1)))):
                leaf = np.searchsorted(forest.starts[t], key, side="right") - 1
                for x in range(bits + 1):
                    total[:, x] += np.where(forest.depths[t][leaf] >= x, inside[t][leaf], levels[x][t][(key >> np.uint64(BITS - x)).astype(np.int64)])
            enough = total >= want
            level = np.where(enough.any(axis=1), bits - np.argmax(enough[:, ::-1], axis=1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level.astype(np.int32)), pa.array(enough[:, bits])], ["cid", "level", "deep"])

    return run


def _levels(first: int):
    """How many rows each query of a leaf meets at each level from the first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group[group.level >= 0]
        keys = np.sort(group.key.to_numpy().astype(np.uint64)[(group.level < 0).to_numpy()])
        at, depth = asks.key.to_numpy().astype(np.uint64), asks.depth.to_numpy()
        out = np.zeros((len(asks), BITS + 1 - first), np.int64)
        for level in range(first, BITS + 1):
            begin, end = _ranges(keys, at, np.maximum(level, depth))
            out[:, level - first] = end - begin
        return pd.DataFrame({"cid": asks.cid.to_numpy(), "counts": pd.Series(list(out), dtype=object)})

    return run


def stop_levels(forest: Forest, indexed: DataFrame, query: DataFrame, want: int, scratch: Scratch, bits: int = COUNT_BITS) -> DataFrame:
    """(cid, level): the deepest level at which the trees hold ``want`` rows for each query (cid, v), 0 if none, by the rows (cid, level = -1, v)."""
    below, inside = np.zeros((len(forest.starts), 1 << bits), np.int64), [np.zeros(len(starts), np.int64) for starts in forest.starts]
    tally = indexed.select("v").mapInArrow(_tally(forest, bits), "tree int, leaf boolean, node long, n long").groupBy("tree", "leaf", "node").agg(F.sum("n").alias("n"))
    for tree, leaf, node, n in tally.toPandas().itertuples(index=False):  # no more rows than nodes and leaves
        (inside if leaf else below)[tree][node] = n
    stops = scratch.keep(query.select("cid", "v").mapInArrow(_shallow(forest, below, inside, want), "cid long, level int, deep boolean"), "stops")
    if not stops.where("deep").take(1):
        return stops.select("cid", "level")
    deep = query.join(stops.where("deep"), "cid").select("cid", F.lit(0).alias("level"), "v")
    light = indexed.unionByName(deep).mapInArrow(_spread(forest, False), "tree int, leaf int, part int, depth int, key long, cid long, level int")
    counts = light.groupBy("tree", "leaf", "part").applyInPandas(_levels(bits + 1), "cid long, counts array<long>")
    level = F.greatest(F.lit(bits), *[F.when(F.sum(F.get("counts", F.lit(x - bits - 1))) >= want, x) for x in range(bits + 1, BITS + 1)])
    return stops.where("not deep").select("cid", "level").unionByName(counts.groupBy("cid").agg(level.alias("level")))


def nearest(vectors: np.ndarray, cids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows, ties to the smaller cid, and their distances."""
    apart = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    if len(apart) > 4 * k:
        close = np.flatnonzero(apart <= np.partition(apart, k - 1)[k - 1])
    else:
        close = np.arange(len(apart))
    close = close[np.lexsort((cids[close], apart[close]))][:k]
    return cids[close], apart[close]


def _search(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group[group.level < 0].sort_values("key")
        asks = group[group.level >= 0]
        out = []
        if len(rows) and len(asks):
            keys, cids, vectors = rows.key.to_numpy().astype(np.uint64), rows.cid.to_numpy(), _matrix(rows.v)
            level = np.maximum(asks.level.to_numpy(), asks.depth.to_numpy())
            begin, end = _ranges(keys, asks.key.to_numpy().astype(np.uint64), level)
            for query, v, i, j in zip(asks.cid, asks.v, begin, end, strict=True):
                found, apart = nearest(vectors[i:j], cids[i:j], np.asarray(v, np.float64), k)
                out.append(pd.DataFrame({"query": query, "cid": found, "score": apart}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def _scan(asks: list[tuple[int, np.ndarray]], k: int):
    """Each partition's k nearest for every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {q: (np.empty(0, np.int64), np.empty(0)) for q, _ in asks}
        for batch in batches:
            if not batch.num_rows:
                continue
            cids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for q, v in asks:
                found, apart = nearest(vectors, cids, v, k)
                found, apart = np.concatenate((best[q][0], found)), np.concatenate((best[q][1], apart))
                order = np.lexsort((found, apart))[:k]
                best[q] = found[order], apart[order]
        for q, (found, apart) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q)), pa.array(found), pa.array(apart)], ["query", "cid", "score"])

    return run


_FOUND = "query long, cid long, score double"


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = K, trees: int = TREES, leaf: int = LEAF, fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) that is_query names, against all others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usual = valid.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return empty
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = valid.where(F.col("vec_id").isNotNull() & (F.size("v") == usual["n"]) & finite & F.exists("v", lambda x: x != 0))
    valid = valid.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # Spark keeps k + 1 rows of a vector before it deals them out
    classes = valid.select("v", "vec_id", nth.alias("nth")).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.keep(classes.withColumn("cid", F.element_at("ids", 1)), "classes")
    rows = classes.count()
    if not rows:
        return empty
    sample = classes.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(fit_rows).collect()
    forest = grow(np.array([r["v"] for r in sample], np.float64), rows, trees, leaf, k, recall=recall)
    want = math.ceil(forest.want)

    asked = scratch.keep(valid.where("asks").join(classes.select("v", "cid"), "v").select("cid", F.col("vec_id").alias("query_id")), "asked")
    query = asked.select("cid").distinct().join(classes.select("cid", "v"), "cid")
    indexed = classes.select("cid", F.lit(-1).alias("level"), "v")
    schema = "tree int, leaf int, part int, depth int, key long, cid long, level int"
    stop = stop_levels(forest, indexed, query, want, scratch)
    asks = query.join(stop, "cid").select("cid", "level", "v")
    full = indexed.unionByName(asks).mapInArrow(_spread(forest, True), f"{schema}, v {kind}")
    found = full.groupBy("tree", "leaf", "part").applyInPandas(_search(k + 1), _FOUND)
    best = Window.partitionBy("query").orderBy("score", "cid")
    found = found.distinct().select("*", F.row_number().over(best).alias("nth")).where(F.col("nth") <= k + 1).drop("nth")
    found = scratch.keep(found, "found")

    ids = classes.select("cid", "ids")
    need = min(rows, k + 1)
    short = asked.select(F.col("cid").alias("query")).distinct().join(found.groupBy("query").count(), "query", "left").where(F.coalesce("count", F.lit(0)) < need)
    short = scratch.keep(short.join(classes.select(F.col("cid").alias("query"), "v"), "query").select("query", "v").withColumn("nth", F.monotonically_increasing_id()), "short")
    last = None
    while block := (short if last is None else short.where(F.col("nth") > last)).orderBy("nth").limit(BLOCK).collect():
        last = block[-1]["nth"]
        scanned = classes.select("cid", "v").mapInArrow(_scan([(r["query"], np.array(r["v"], np.float64)) for r in block], k + 1), _FOUND)
        found = found.unionByName(scratch.keep(scanned.select("*", F.row_number().over(best).alias("nth")).where(F.col("nth") <= k + 1).drop("nth"), "scanned")).distinct()

    near = found.join(ids, "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    near = near.select("*", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")).alias("nth")).where(F.col("nth") <= k + 1)
    out = asked.join(near, asked.cid == near.query).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op9_hash_prefix_forest": op9_hash_prefix_forest}
SQL: dict[str, str] = {}
