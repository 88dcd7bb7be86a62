r"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Words are runs of letters and digits of the lower-cased text; shingles are five words (all words of a shorter item). For an item
of n words the windows are n words of a document (the whole of a shorter document); a window is contaminated if its weighted
shingle similarity to the item, sum of the smaller counts over sum of the larger ones, is at least ``similarity``.

1. Anchors: places of a document's shingles that an item has. Moving a window right to its next anchor loses none, so of all
   windows only those that start at an anchor (or end with the document) and hold enough anchors can qualify: an exact filter.
2. Each such window and each item gets a 64-bit SimHash of its shingles, cut into ``radius + 1`` blocks. Two fingerprints within
   ``radius`` bits agree in a block, so a window meets the items of its anchors by (item, block, value), and rows grow with the
   windows and not with the number of items of the same length.
3. Pairs within the radius are verified by the exact similarity. Windows of similarity 0.75 differ in 11 bits on average, with
   a standard deviation of 3; the radius of 26 is five deviations away.

Documents are exploded into shingles of all widths that items have, in one pass, and streamed past the benchmark's, without a
shuffle if those are few (measured); only anchors are gathered, by document and item.

Nulls and empties: a null or wordless text, or item, matches nothing; a null doc_id is kept as null; an item without an id is left
out; repeated rows give one result; ties go to the earliest window; extra columns are ignored; no rows give no results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, bounded, table

WORDS, SIMILARITY, RADIUS = 5, 0.75, 26


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(k: int) -> str:
    """Hashes of all k words in a row; those of another k differ."""
    parts = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"if(size(w) < {k}, array(), transform(sequence(0, greatest(size(w) - {k}, 0)), i -> xxhash64({k}, {parts})))"


def _block_bounds(radius: int) -> list[tuple[int, int]]:
    cuts = [round(64 * b / (radius + 1)) for b in range(radius + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def simhash(shingles: str) -> Column:
    """64 majority votes of an array of hashes, repeated ones counting as often as they occur."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if(2 * aggregate({shingles}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & 1L)) > size({shingles}), 1L, 0L), b))")


def blocks(fingerprint: str, radius: int) -> Column:
    """array<struct<block, value>>."""
    return F.array(*(F.struct(F.lit(b).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {low}) & {(1 << (high - low)) - 1}L").alias("value")) for b, (low, high) in enumerate(_block_bounds(radius))))


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, item_id, start (word), n_words and similarity of the most similar window of each text for each item."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    items = items.select("item_id", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(words)).alias("k"))
    by_width = [items.where(F.col("k") == k).withColumn("item_shingles", F.expr(_shingles(k))) for k in range(1, words + 1)]
    items = by_width[0]
    for more in by_width[1:]:
        items = items.unionByName(more)
    items = items.drop("w").withColumn("m", F.size("item_shingles")).withColumn("need", F.ceil(F.col("m") * similarity).cast("int")).distinct()
    items = scratch.keep(items.withColumn("item_print", simhash("item_shingles")), "items")
    widths = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]  # `words` at most

    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, item_id long, start long, n_words long, similarity double")
    parts = docs.select("doc_id", "text_key", words_of(F.col("text")).alias("w")).where(F.size("w") >= widths[0])
    placed = F.concat(*(F.transform(F.expr(_shingles(k)), lambda h, i: F.struct(i.alias("at"), h.alias("h"))) for k in widths))
    parts = parts.select("doc_id", "text_key", F.size("w").alias("size"), placed.alias("placed"))  # so that no row of a shingle carries the words
    # outer: else Spark filters by the array's size first, and computes the words again for each shingle
    places = parts.select("doc_id", "text_key", "size", F.explode_outer("placed").alias("x")).where("x is not null").select("doc_id", "text_key", "size", "x.at", "x.h")
    known = scratch.bounded(items.select("item_id", F.explode(F.array_distinct("item_shingles")).alias("h")), "known")
    anchors = places.join(known, "h").groupBy("doc_id", "text_key", "item_id").agg(F.max("size").alias("size"), F.sort_array(F.collect_set("at")).alias("at"))
    anchors = anchors.join(bounded(items.select("item_id", "k", "n", "m", "need")), "item_id").where("size(at) >= need")
    last = "greatest(size - n, 0)"
    inner = F.expr(f"filter(slice(at, 1, size(at) - need + 1), (s, i) -> s <= {last} and at[i + need - 1] - s < m)")
    ends = F.expr(f"if(at[size(at) - need] >= {last}, array({last}), array())")
    starts = anchors.select("doc_id", "text_key", "item_id", "k", "n", "m", F.explode(F.array_union(inner, ends)).alias("start"))
    starts = scratch.keep(starts.groupBy("doc_id", "text_key", "k", "n", "m", "start").agg(F.collect_set("item_id").alias("asked")), "starts")
    # the text of these documents only, without a shuffle of the others if they are few
    at = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    named = {"doc_id": "d", "text_key": "t"}
    chosen = docs.join(bounded(starts.select("doc_id", "text_key").distinct()).withColumnsRenamed(named), at, "left_semi").dropDuplicates(["doc_id", "text_key"])
    chosen = chosen.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), words_of(F.col("text")).alias("w"))
    chosen = chosen.select("d", "t", F.explode(F.array(*(F.struct(F.lit(k).alias("width"), F.expr(_shingles(k)).alias("shingles")) for k in widths))).alias("x")).select("d", "t", "x.width", "x.shingles")
    mine = starts.groupBy("doc_id", "text_key", "k").agg(F.collect_list(F.struct("n", "m", "start", "asked")).alias("windows"))
    windows = mine.join(chosen, at & (F.col("width") == F.col("k"))).select("doc_id", "text_key", "shingles", F.explode("windows").alias("x"))
    windows = windows.select("doc_id", "text_key", "x.n", "x.start", "x.asked", F.slice("shingles", F.col("x.start") + 1, F.col("x.m")).alias("window")).withColumn("print", simhash("window"))
    windows = scratch.keep(windows, "windows")
    # multi-index: (item, block, value)
    left = windows.select("doc_id", "text_key", "n", "start", "print", F.explode("asked").alias("item_id")).select("*", F.explode(blocks("print", radius)).alias("b")).select("doc_id", "text_key", "n", "start", "print", "item_id", "b.block", "b.value")
    right = items.select("item_id", "n", "item_print", F.explode(blocks("item_print", radius)).alias("b")).select("item_id", "n", "item_print", "b.block", "b.value")
    near = left.join(scratch.bounded(right, "blocks"), ["item_id", "n", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.groupBy("doc_id", "text_key", "start", "n").agg(F.collect_set("item_id").alias("items")).withColumnsRenamed(named | {"start": "s"})
    near = near.join(windows.withColumnRenamed("n", "words"), at & (F.col("start") == F.col("s")) & (F.col("words") == F.col("n")))
    near = near.select("doc_id", "text_key", "start", "n", F.explode("items").alias("item_id"), "window").join(bounded(items.select("item_id", "n", "item_shingles")), ["item_id", "n"])
    shared = F.expr("aggregate(array_distinct(item_shingles), 0, (n, g) -> n + least(size(filter(window, h -> h = g)), size(filter(item_shingles, h -> h = g))))")
    near = near.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("window") + F.size("item_shingles") - F.col("shared")))
    near = near.where(F.col("similarity") >= similarity).groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    return near.select("doc_id", "text_key", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.n").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.n_words", "best.similarity")


_SQL = r"""
with d as (select distinct doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark where item_id is not null),
g as (select item_id, len(w) as n, least(len(w), 5) as k, list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) as s from b where len(w) > 0),
h as (select distinct item_id, n, k, len(s) as m, unnest(s) as s from g),
p as (select doc_id, w, len(w) as size, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'at': i - 1, 's': array_to_string(w[i:i + k - 1], ' ')})) as x from d, (select distinct k from g) where len(w) >= k),
a as (select distinct doc_id, w, item_id, h.n, h.m, h.k, least(x['at'], greatest(size - h.n, 0)) as start from p join h on p.k = h.k and p.x['s'] = h.s),
c as (select doc_id, item_id, n, m, k, start, list_transform(range(start + 1, least(start + m, len(w) - k + 1) + 1), lambda i: array_to_string(w[i:i + k - 1], ' ')) as win from a),
e as (select doc_id, item_id, start, n, len(win) as lw, unnest(win) as s from c),
f as (select doc_id, item_id, start, n, lw, s, count(*) as cw from e group by all),
i as (select item_id, s, count(*) as ci, any_value(m) as m from (select item_id, len(s) as m, unnest(s) as s from g) group by item_id, s),
j as (select doc_id, item_id, f.start, f.n, sum(least(cw, ci)) as shared, any_value(lw) as lw, any_value(m) as m from f join i using (item_id, s) group by all),
r as (select doc_id, item_id, start, n, shared / (lw + m - shared) as similarity from j)
select doc_id, item_id, arg_max(start, (similarity, -start))::bigint as start, arg_max(n, (similarity, -start))::bigint as n_words, max(similarity)::double as similarity
from r where similarity >= 0.75 group by doc_id, item_id
"""

QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
SQL = {"op5_benchmark_decontamination": _SQL}
