"""Repeated phrases: n-gram frames, counts, similar patterns, scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators import temporal


SHORTEST, LONGEST = 8, 20


def _factors(count: int, lane: int) -> np.ndarray:
    return np.random.default_rng((count, lane)).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _key(values: np.ndarray, lane: int) -> np.ndarray:
    """A 64-bit hash of each row: a multilinear function of its numbers, mixed."""
    h = (values.astype(np.int64).view(np.uint64) * _factors(values.shape[1], lane)).sum(axis=1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def windows(notes: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, step: int = 1, sparse_above: int | None = None, transposed: bool = False, arrays: bool = True, timed: bool = True) -> DataFrame:
    """file_id, pos, len, k1, k2, p0[, ivs, rhythm] of every window of so many notes (fewer than all), at every ``step``-th place; in
    recordings of more than ``sparse_above`` notes at every second. Transposed patterns forget the start pitch.

    k1 and k2 are a 128-bit key of intervals, start pitch and, if timed, rhythm. A window's rhythm is counted in its own shortest interval, so
    keys of longer windows don't follow from shorter ones; they are taken for all windows of a batch at once. A recording's last
    ``longest`` - 1 notes are carried on from batch to batch."""
    rows = notes.select("file_id", F.col("start_tick").cast("long").alias("start_tick"), F.col("note_id").cast("long").alias("note_id"), F.col("pitch").cast("int").alias("pitch"))
    rows = rows.join(notes.groupBy("file_id").agg(F.count("*").alias("n")), "file_id")
    names = ["file_id", "pos", "len", "k1", "k2", "p0", *["ivs", "rhythm"][: 2 * arrays]]

    def fold(state: tuple[np.ndarray, np.ndarray, int] | None, batch: pa.RecordBatch | None):
        if batch is None:
            return None, None
        tail_t, tail_p, seen = state or (np.empty(0, np.int64), np.empty(0, np.int64), 0)
        t, p = np.concatenate((tail_t, batch.column(1).to_numpy())), np.concatenate((tail_p, batch.column(3).to_numpy()))
        n, held, out = batch.column(4)[0].as_py(), len(tail_t), []
        by = 2 if sparse_above is not None and n > sparse_above else step
        for size in range(shortest, min(longest, n - 1, len(p)) + 1):
            start = np.arange(max(held - size + 1, 0), len(p) - size + 1)
            pos = start + seen - held
            start, pos = start[pos % by == 0], pos[pos % by == 0]
            ivs = np.lib.stride_tricks.sliding_window_view(np.diff(p), size - 1)[start]
            ioi = np.lib.stride_tricks.sliding_window_view(np.diff(t), size - 1)[start]
            unit = ioi.min(axis=1)
            rhythm = np.rint(ioi / np.where(unit > 0, unit, 1)[:, None]).astype(np.int64)
            p0 = np.zeros(len(start), np.int64) if transposed else p[start]
            whole = np.concatenate((ivs, *[rhythm] * timed, p0[:, None]), axis=1)
            columns = [pa.array(np.full(len(start), batch.column(0)[0].as_py()), pa.int32()), pa.array(pos.astype(np.int32)), pa.array(np.full(len(start), size, np.int32)), pa.array(_key(whole, 1)), pa.array(_key(whole, 2)), pa.array(p0.astype(np.int32))]
            if arrays:
                ends = pa.array(np.arange(len(start) + 1, dtype=np.int32) * (size - 1))
                columns += [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).astype(np.int32))) for x in (ivs, rhythm)]
            out.append(pa.RecordBatch.from_arrays(columns, names))
        kept = longest - 1
        state = t[-kept:], p[-kept:], seen + batch.num_rows
        return state, pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else None

    schema = "file_id int, pos int, len int, k1 long, k2 long, p0 int" + ", ivs array<int>, rhythm array<int>" * arrays
    return temporal.folded(rows, ["file_id"], ["start_tick", "note_id"], fold, schema)


def frames(notes: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, step: int = 1, sparse_above: int | None = None, transposed: bool = False) -> DataFrame:
    """file_id, pos, len, ivs, rhythm, p0 of windows()."""
    return windows(notes, shortest, longest, step, sparse_above, transposed).select("file_id", "pos", "len", "ivs", "rhythm", "p0")


def pattern_counts(windows: DataFrame) -> DataFrame:
    """How often each pattern occurs, and where first: by its key, with what else windows() gave of it."""
    more = [c for c in ("p0", "ivs", "rhythm") if c in windows.columns]
    first = F.min_by(F.struct(*more), "pos").alias("_first")
    return windows.groupBy("file_id", "len", "k1", "k2").agg(first, F.count("*").alias("cnt"), F.min("pos").alias("first_pos")).select("file_id", "len", "k1", "k2", "_first.*", "cnt", "first_pos")


def best_patterns(notes: DataFrame, k: int = 100, **options) -> DataFrame:
    """top_patterns() of all windows, with their arrays: only keys are counted, and the arrays of the k best fetched from their notes."""
    top = top_patterns(pattern_counts(windows(notes, arrays=False, **options)), k)
    nth = (F.row_number().over(Window.partitionBy("file_id").orderBy("start_tick", "note_id")) - 1).alias("nth")
    own = notes.select("file_id", nth, "pitch", "start_tick")
    rows = top.select("*", F.explode(F.sequence("first_pos", F.col("first_pos") + F.col("len") - 1)).alias("nth")).join(own, ["file_id", "nth"])
    rows = rows.groupBy("file_id", "rank").agg(*[F.first(c).alias(c) for c in ("len", "p0", "cnt", "first_pos")], F.array_sort(F.collect_list(F.struct("nth", "pitch", "start_tick"))).alias("of"))
    diff = lambda name: F.zip_with(F.slice("of", F.lit(2), F.col("len") - 1), F.slice("of", F.lit(1), F.col("len") - 1), lambda y, x: (y[name] - x[name]).cast("int"))
    rows = rows.select("file_id", "rank", "len", "p0", "cnt", "first_pos", diff("pitch").alias("ivs"), diff("start_tick").alias("ioi"))
    unit = F.when(F.array_min("ioi") > 0, F.array_min("ioi")).otherwise(F.lit(1))
    return rows.withColumn("rhythm", F.transform("ioi", lambda x: F.rint(x / unit).cast("int"))).drop("ioi")


def top_patterns(counts: DataFrame, k: int = 100) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy(F.desc("cnt"), "len", "first_pos")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(M.sequence_code(a), M.sequence_code(b)) / F.size(a)


def similar_pairs(top: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs of a file's top patterns of equal length whose intervals are that similar: at most k * (k - 1) / 2 a file."""
    a, b = top.select("file_id", "len", F.col("rank").alias("rank_a"), F.col("ivs").alias("ivs_a")), top.select("file_id", "len", F.col("rank").alias("rank_b"), F.col("ivs").alias("ivs_b"))
    rows = a.join(b, ["file_id", "len"]).where("rank_a < rank_b").withColumn("similarity", similarity(F.col("ivs_a"), F.col("ivs_b")))
    return rows.where(F.col("similarity") >= least).select("file_id", "len", "rank_a", "rank_b", F.round("similarity", 6).alias("similarity"))


def leader_groups(top: DataFrame, least: float = 0.75, min_frequency: int = 1) -> DataFrame:
    """In rank order, a pattern that is in no group leads one, of all later free patterns similar to it. Greedy, so a grouped
    function over a file's top patterns (100 at most): file_id, leader, members, frequency."""
    return _led(top, least, min_frequency).select("file_id", "leader", "members", "frequency")


def _led(top: DataFrame, least: float, min_frequency: int) -> DataFrame:
    """leader_groups() with the leader's len, ivs, rhythm and p0. A file's patterns become one row, so top is computed once."""
    rows = top.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cnt", "len", "p0", "ivs", "rhythm"))).alias("top"))
    alike = lambda a: F.filter(F.col("top"), lambda b: (b["rank"] > a["rank"]) & (b["len"] == a["len"]) & (similarity(a["ivs"], b["ivs"]) >= least))
    rows = rows.withColumn("pairs", F.flatten(F.transform("top", lambda a: F.transform(alike(a), lambda b: F.struct(a["rank"].alias("rank_a"), b["rank"].alias("rank_b"))))))
    schema = pa.schema([("file_id", pa.int32()), ("leader", pa.int32()), ("members", pa.int32()), ("frequency", pa.int64()), ("len", pa.int32()), ("p0", pa.int32()), ("ivs", pa.list_(pa.int32())), ("rhythm", pa.list_(pa.int32()))])
    kinds = {f.name: f.dataType.simpleString() for f in top.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, top, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near: dict[int, list[int]] = {}
                for x in pairs or ():
                    near.setdefault(x["rank_a"], []).append(x["rank_b"])
                by_rank = {x["rank"]: x for x in top}
                count, taken = {x["rank"]: x["cnt"] for x in top}, set()
                for rank in count:
                    if rank not in taken:
                        group = [rank, *(r for r in sorted(near.get(rank, ())) if r not in taken)]
                        taken.update(group)
                        total = sum(count[r] for r in group)
                        if total >= min_frequency:
                            x = by_rank[rank]
                            out.append({"file_id": file_id, "leader": rank, "members": len(group), "frequency": total, "len": x["len"], "p0": x["p0"], "ivs": x["ivs"], "rhythm": x["rhythm"]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("file_id", "top", "pairs").mapInArrow(run, f"file_id int, leader int, members int, frequency long, len int, p0 int, ivs array<int>, rhythm {kinds['rhythm']}")


def score(freq: Column, ivs: Column, rhythm: Column, p0: Column) -> Column:
    """Frequency, length, melody, rhythm, range and register terms; never below 0."""
    n = F.size(ivs) + 1
    share = lambda test: F.size(F.filter(ivs, test)) / F.size(ivs)
    length = 5 * F.least(n / 12, F.lit(12) / n) + F.when(n < 6, -8.0).when(n < 8, -3.0).otherwise(0.0) + F.when(n.between(10, 16), 3.0).when(n.between(8, 20), 1.5).otherwise(0.0)
    rep = share(lambda v: v == 0)
    melody = 2.5 * (1 - F.abs(share(lambda v: F.abs(v) <= 2) - 0.7)) - F.when(rep > 0.5, 3.0).when(rep > 0.3, 1.0).otherwise(0.0)
    beat = 1.5 * F.least(F.size(F.array_distinct(rhythm)) / 3, F.lit(1.0))
    path = F.aggregate(ivs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"), F.lit(0).alias("high")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.least(a["low"], a["at"] + v).alias("low"), F.greatest(a["high"], a["at"] + v).alias("high")))
    width = path["high"] - path["low"]
    spread = F.when(width >= 3, 2 * F.least(width / 12, F.lit(1.0))).otherwise(-1.0)
    register = F.when((p0 < 36) | (p0 > 84), -1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), 2 * F.log1p(freq.cast("double")) + length + melody + beat + spread + register)


def best_phrases(notes: DataFrame, n: int = 5, k: int = 100, **options) -> DataFrame:
    """file_id, rank, score, frequency, len, p0, ivs and pattern_type of the best groups; options as of windows()."""
    groups = _led(best_patterns(notes, k, **options), 0.75, 1)
    groups = groups.withColumn("score", F.round(score(F.col("frequency"), F.col("ivs"), F.col("rhythm"), F.col("p0")), 6))
    order = Window.partitionBy("file_id").orderBy(F.desc("score"), "leader")
    kind = F.when(F.col("members") == 1, "exact").otherwise("similar")
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("file_id", "rank", "score", "frequency", "len", "p0", "ivs", kind.alias("pattern_type"))


def first_occurrence(notes: DataFrame, patterns: DataFrame) -> DataFrame:
    """First place of a pattern's start pitch and intervals, rhythm ignored, at all places: patterns (file_id, rank, len, p0, ivs)."""
    return _first(notes, patterns).select("file_id", "rank", "pos")


def _first(notes: DataFrame, patterns: DataFrame) -> DataFrame:
    """first_occurrence() with len. Both sides meet by windows' keys, without rhythm. It is always the patterns that are hashed: what a fold
    puts out is guessed to be as small as its input, so that a planner left to itself sends all places to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = batch.column(2).to_numpy(), np.empty((2, batch.num_rows), np.int64)
            p0, ivs = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                whole = np.concatenate((np.array([ivs[i] for i in at]), p0[at, None]), axis=1)
                keys[:, at] = _key(whole, 1), _key(whole, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, keys)], ["file_id", "rank", "len", "k1", "k2"])

    own = patterns.select("file_id", "rank", "len", "p0", "ivs").mapInArrow(run, "file_id int, rank int, len int, k1 long, k2 long")
    key = ["file_id", "len", "k1", "k2"]
    places = windows(notes, arrays=False, timed=False).groupBy(*key).agg(F.min("pos").alias("pos"))
    return places.join(own.hint("shuffle_hash"), key).select("file_id", "rank", "len", "pos")


def phrase_notes(notes: DataFrame, best: DataFrame) -> DataFrame:
    """Notes of the first occurrence of each phrase (file_id, rank, len, p0, ivs): notes and rank."""
    at = _first(notes, best).hint("shuffle_hash")
    nth = (F.row_number().over(Window.partitionBy("file_id").orderBy("start_tick", "note_id")) - 1).alias("_nth")
    return notes.select("*", nth).join(at, "file_id").where("_nth between pos and pos + len - 1").drop("_nth", "pos", "len")
