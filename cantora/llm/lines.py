r"""Line dedup with a log-template tree of fixed depth.

A line's variable fields (URLs, addresses, words with digits) become ``<*>``. Its leaf in the tree is its number of tokens and
its three leading tokens. Two lines of a leaf are similar if at least ``similar`` of their tokens agree in place, however long they
are. Each line joins the most frequent line of its leaf that is similar to it (ties: the smaller hash), the hub; a hub and what
joins it form a template, whose places that differ are variable too. A template that stands in ``min_docs`` documents or more is
recurring: its lines are dropped from all documents but the one with the smallest doc_id, so that nothing is lost altogether.
Lines of a template that have LONG constant tokens or more in common with its hub are recurring in ``long_docs`` documents already.
A line is recurring by itself if it alone stands in so many; lines of fewer than ``min_tokens`` tokens only so, in ``short_docs``
documents and if they have no variable field, so that tables of numbers stay.

Which lines are similar depends on no other line, so neither the order nor the number of a leaf's lines changes a template. Similar
lines meet without a product: of the places after the leading ones, cut into one piece more than may differ, they agree on one.
Lines that share such places form a group, in which each looks for its hub; of groups of the same lines one is enough, and tokens go
to the groups that are left only. All lines of a group with few other places are similar, and their hub is a minimum. Of other groups of more than ``group`` lines, all lines are compared with
the most frequent first; those that aren't similar to it are compared with the rest in blocks, and no task holds more than a block.

Only leaves that enough documents reach take part, so few lines' texts are needed; a frequent line is one row there. Each text is
parsed once; the lines' positions are kept for the drop.

Null and empty texts have no such line and stay as they are; a null doc_id never counts as the smallest, and lines that only rows without
one have stay; repeated rows count as documents and get the same text; other columns pass through, whatever their names, and
the counts' own names get underscores until they are new; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, bounded, fresh, table

MIN_DOCS, MIN_TOKENS, SIMILAR = 10, 3, 0.8
LEAD, LONG, LONG_DOCS, SHORT_DOCS = 3, 50, 2, 100
GROUP = 1_000
VARIABLE = r"(?<!\S)(?:(?:https?://|www\.)\S+|[^\s\d@]*+[\d@]\S*)"  # possessive, so that a word is read once
MAY_VARY = r"[\d@]|://|www\."


def _flat(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def _masked(flat: Column) -> Column:
    return F.when(flat.rlike(MAY_VARY), F.regexp_replace(flat, VARIABLE, "<*>")).otherwise(flat)


def _mark(masked: Column, min_tokens: int) -> Column:
    """struct<leaf, line, constant>: hashes, both of which tell a line from another, and its constant tokens; null for lines of few with variable fields."""
    tokens = F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1
    variable = (F.length(masked) - F.length(F.replace(masked, F.lit("<*>"), F.lit("")))) / 3
    constant = (tokens - variable).cast("int")
    return F.when((masked != "") & ((constant >= min_tokens) | (variable == 0)), F.struct(F.xxhash64(tokens, F.substring_index(masked, " ", LEAD)).alias("leaf"), F.xxhash64(masked).alias("line"), constant.alias("constant")))


def _masked_lines(text: Column) -> Column:
    """Each step is a transform of its own, so that it is done once a line."""
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _flat), _masked)


def _marks(text: Column, min_tokens: int) -> Column:
    return F.transform(_masked_lines(text), lambda m: _mark(m, min_tokens))


@cache
def may_differ(n: int, similar: float) -> int:
    """In how many places two similar lines of n tokens may differ."""
    differ = max(0, int((1 - similar) * n) - 1)
    while n - differ - 1 >= similar * n:
        differ += 1
    return differ


def _runs(n: int, similar: float) -> list[tuple[int, int]]:
    """Places (from, to) of a line of n tokens, the ones after the leading ones cut into one piece more than may differ: two similar lines
    of a leaf agree on one of these. None if no place may differ."""
    differ = may_differ(n, similar)
    first = min(LEAD, n)
    cuts = [first + (n - first) * k // (differ + 1) for k in range(differ + 2)]
    return list(zip(cuts, cuts[1:], strict=False)) if differ else []


_DEALT = "key long, solid boolean, leaf long, line long, n long"


def _deal(similar: float):
    """A row for each run of a line (leaf, line, n, tokens), without its tokens: lines that agree on it get the same key.

    solid: so few places are left that all lines of a key are similar."""

    def dealt(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _DEALT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for leaf, line, n, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, count = np.array(tokens, np.int64).tobytes(), len(tokens)
                differ = may_differ(count, similar)
                for k, (i, j) in enumerate(_runs(count, similar)):
                    piece = xxhash.xxh3_64_intdigest(np.array([leaf, k, count], np.int64).tobytes() + raw[8 * i : 8 * j])
                    out.append((piece - (1 << 63), count - LEAD - (j - i) <= differ, leaf, line, n))
                if len(out) >= 20_000:
                    yield dealt(out)
                    out = []
            yield dealt(out)

    return run


_JOINED = "leaf long, line long, hub_n long, hub long"


def _joined(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["leaf", "line", "hub_n", "hub"])


def _join(similar: float):
    """Each line of a small group with its hub there, from rows (key, leaf, line, n, tokens), sorted by key, n descending and line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for _, mine in groupby(rows, key=lambda r: r[0]):
            mine = list(mine)
            tokens = np.stack([np.frombuffer(r[4], np.int64) for r in mine])
            least = tokens.shape[1] - may_differ(tokens.shape[1], similar)
            for i in range(1, len(mine)):
                for a in range(0, i, 64):
                    near = np.flatnonzero((tokens[a : min(a + 64, i)] == tokens[i]).sum(axis=1) >= least)
                    if len(near):
                        hub = mine[a + near[0]]
                        out.append((*mine[i][1:3], hub[3], hub[2]))
                        break
            if len(out) >= 10_000:
                yield _joined(out)
                out = []
        yield _joined(out)

    return run


def _ask(similar: float):
    """The hub of each asking line in a block of a large group, from rows (key, part, block, asks, leaf, line, n, tokens), sorted so, those
    that ask first and the others by n descending and line; only those that ask are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, mine in groupby(rows, key=lambda r: r[:3]):
            asking, out, matrix = [], [], None
            for *_, asks, leaf, line, n, raw in mine:
                tokens = np.frombuffer(raw, np.int64)
                if asks:
                    asking.append((leaf, line, n, tokens))
                    continue
                if matrix is None:
                    matrix = np.stack([r[3] for r in asking]) if asking else np.empty((0, len(tokens)), np.int64)
                    lines, counts, least = np.array([r[1] for r in asking], np.int64), np.array([r[2] for r in asking], np.int64), len(tokens) - may_differ(len(tokens), similar)
                if not len(matrix):
                    continue
                hit = ((matrix == tokens).sum(axis=1) >= least) & ((counts < n) | ((counts == n) & (lines > line)))
                if hit.any():
                    out += [(leaf, x, n, line) for x in lines[hit].tolist()]
                    matrix, lines, counts = matrix[~hit], lines[~hit], counts[~hit]
            yield _joined(out)

    return run


def _hubs(texts: DataFrame, scratch: Scratch, similar: float, group: int) -> DataFrame:
    """(leaf, line, hub) of lines (leaf, line, n, tokens) that have a hub other than themselves."""
    dealt = scratch.keep(texts.select("leaf", "line", "n", "tokens").mapInArrow(_deal(similar), _DEALT), "dealt")
    of_lines = lambda seed: F.bit_xor(F.xxhash64("leaf", "line", F.lit(seed)))
    groups = dealt.groupBy("key").agg(F.count("*").alias("lines"), F.max("solid").alias("solid"), of_lines(1).alias("x"), of_lines(2).alias("y")).where("lines > 1")
    groups = groups.groupBy("lines", "x", "y").agg(F.min(F.struct((~F.col("solid")).alias("loose"), "key")).alias("one"))
    groups = scratch.keep(groups.select("one.key", "lines", (~F.col("one.loose")).alias("solid")), "groups")
    met = scratch.keep(dealt.drop("solid").join(bounded(groups), "key"), "met")
    scratch.free(dealt)
    # eight bytes a token; their order doesn't matter, as they are only compared
    packed = texts.select("leaf", "line", F.unhex(F.array_join(F.transform("tokens", lambda t: F.lpad(F.hex(t), 16, "0")), "")).alias("tokens"))
    size, rank = groups.where(F.col("lines") > group), F.struct((-F.col("n")).alias("n"), "line")
    small = met.where(F.col("lines") <= group).join(packed, ["leaf", "line"]).select("key", "leaf", "line", "n", "tokens").repartition("key").sortWithinPartitions("key", F.desc("n"), "line")
    found = [small.mapInArrow(_join(similar), _JOINED)]
    often = met.where(F.col("lines") > group)
    if size.where("solid").take(1):
        solid = often.where("solid")
        least = solid.groupBy("key").agg(F.min(rank).alias("hub"))
        found.append(solid.select("key", "leaf", "line").join(least, "key").where("line <> hub.line").select("leaf", "line", (-F.col("hub.n")).alias("hub_n"), F.col("hub.line").alias("hub")))
    if size.where("not solid").take(1):
        # first with the head of the group, then what isn't similar to it with all others, in blocks
        large = scratch.keep(often.where("not solid").join(packed, ["leaf", "line"]).select("key", "lines", "leaf", "line", "n", "tokens"), "large")
        heads = scratch.bounded(large.groupBy("key").agg(F.min(rank).alias("head")).select("key", "head.line"), "heads")
        heads = scratch.keep(large.join(heads, ["key", "line"]).select("key", F.col("line").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("known")), "heads")
        with_head = large.join(bounded(heads), "key").where("line <> hub").select("key", "lines", "leaf", "line", "n", "hub_n", "hub", "tokens", "known")
        with_head = scratch.keep(with_head.mapInArrow(_like_head(similar), "key long, lines long, leaf long, line long, n long, hub_n long, hub long, tokens binary"), "with_head")
        found.append(with_head.where("hub is not null").select("leaf", "line", "hub_n", "hub"))
        asks = with_head.where("hub is null")
        parts = asks.groupBy("key").agg(F.ceil(F.count("*") / group).alias("parts"), F.ceil(F.max("lines") / (16 * group)).alias("blocks"))
        parts = scratch.bounded(parts, "parts")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        rest = ["leaf", "line", "n", "tokens"]
        asks = asks.join(parts, "key").select("key", F.pmod(F.xxhash64("line"), "parts").alias("part"), each("blocks").alias("block"), F.lit(True).alias("asks"), *rest)
        held = large.join(parts, "key").select("key", each("parts").alias("part"), F.pmod(F.xxhash64("line", "n"), "blocks").alias("block"), F.lit(False).alias("asks"), *rest)
        both = asks.unionByName(held).repartition("key", "part", "block").sortWithinPartitions("key", "part", "block", F.desc("asks"), F.desc("n"), "line")
        found.append(both.mapInArrow(_ask(similar), _JOINED))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("leaf", "line").agg(F.min(F.struct((-F.col("hub_n")).alias("n"), "hub")).alias("best")).select("leaf", "line", "best.hub")
    best = scratch.keep(best, "hubs")
    scratch.free(met)
    return best


def _like_head(similar: float):
    """Rows (key, lines, leaf, line, n, hub_n, hub, tokens, known) without the last; hub is null unless both are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = []
            for one, two in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True):
                one, two = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
                like.append((one == two).sum() >= len(one) - may_differ(len(one), similar))
            hub = pc.if_else(pa.array(like, pa.bool_()), batch.column(6), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], hub, batch.column(7)], batch.schema.names[:8])

    return run


def _doc_count(members: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    reached = lines.join(bounded(members), ["leaf", "line"]).select(*keys, "row", "doc_id").distinct()
    return reached.groupBy(*keys).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


def recurring_lines(docs: DataFrame, scratch: Scratch, min_docs: int, min_tokens: int, similar: float, long_docs: int, short_docs: int, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Every document's marks (row, doc_id, text_key, marks), and the recurring (leaf, line, first: smallest doc_id)."""
    need = F.when(F.col("constant") >= LONG, min(long_docs, min_docs)).when(F.col("constant") < min_tokens, max(short_docs, min_docs)).otherwise(min_docs)
    marks = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), _marks(F.col("text"), min_tokens).alias("marks"))
    marks = scratch.keep(marks, "marks")
    lines = marks.select("row", "doc_id", "text_key", F.explode(F.array_distinct("marks")).alias("x")).where("x is not null").select("row", "doc_id", "text_key", "x.leaf", "x.line", "x.constant")
    counts = lines.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("constant").alias("constant"), F.min("text_key").alias("holder"))
    counts = scratch.keep(counts, "all_counts")
    leaves = counts.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("lines"), F.min(need).alias("least")).where("docs >= least").select("leaf", "lines")
    kept = scratch.keep(counts.join(scratch.bounded(leaves, "leaves"), "leaf"), "counts")
    scratch.free(counts)
    recurring = kept.where(F.col("n") >= need).select("leaf", "line", "first")

    several = scratch.keep(kept.where("lines > 1").select("leaf", "line", "n", "constant", "holder"), "several")
    holders = bounded(several.select(F.col("holder").alias("text_key")).distinct())
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(holders, "text_key", "left_semi").dropDuplicates(["text_key"])
    texts = texts.select(F.explode_outer(F.array_distinct(_masked_lines(F.col("text")))).alias("text")).select("text", _mark(F.col("text"), min_tokens).alias("x")).where("x is not null")
    texts = several.drop("holder").join(texts.select("x.leaf", "x.line", "text"), ["leaf", "line"]).dropDuplicates(["leaf", "line"])
    tokens = F.transform(F.split("text", " "), lambda t: F.when(t == "<*>", F.lit(0).cast("long")).otherwise(F.xxhash64(t)))
    texts = scratch.keep(texts.select("leaf", "line", "n", "constant", tokens.alias("tokens")), "texts")

    hubs = _hubs(texts, scratch, similar, group)
    ends = texts.join(hubs.select("leaf", F.col("hub").alias("line")).distinct(), ["leaf", "line"], "left_semi").select("leaf", F.col("line").alias("hub"), F.col("tokens").alias("known"))
    shared = F.size(F.filter(F.zip_with("tokens", "known", lambda a, b: (a == b) & (a != 0)), lambda x: x))
    members = texts.join(hubs, ["leaf", "line"]).join(bounded(ends), ["leaf", "hub"]).select("leaf", "line", "n", "hub", shared.alias("shared"))
    members = members.unionByName(texts.join(hubs.select("leaf", F.col("hub").alias("line")).distinct(), ["leaf", "line"], "left_semi").select("leaf", "line", "n", F.col("line").alias("hub"), F.col("constant").alias("shared")))
    tiers = F.array_compact(F.array(F.when(F.col("shared") >= min_tokens, 0), F.when(F.col("shared") >= LONG, 1)))
    members = scratch.keep(members.select("leaf", "line", "n", "hub", F.explode(tiers).alias("tier")), "members")
    enough = F.when(F.col("tier") == 1, min(long_docs, min_docs)).otherwise(min_docs)
    keys = ["leaf", "hub", "tier"]
    likely = scratch.bounded(members.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= enough).select(*keys), "likely")
    members = scratch.keep(members.join(likely, keys).select("leaf", "line", "hub", "tier"), "often")
    reached = scratch.bounded(_doc_count(members, lines, keys).where(F.col("docs") >= enough).select(*keys, "first"), "reached")
    recurring = recurring.unionByName(members.join(reached, keys).select("leaf", "line", "first"))
    recurring = scratch.keep(recurring.groupBy("leaf", "line").agg(F.min("first").alias("first")), "recurring")
    scratch.free(kept, several, texts, hubs, members)
    return marks, recurring


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR, long_docs: int = LONG_DOCS, short_docs: int = SHORT_DOCS, group: int = GROUP) -> DataFrame:
    """docs with recurring lines taken out of text, and _n_lines and _n_dropped."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks, recurring = recurring_lines(plain, scratch, min_docs, min_tokens, similar, long_docs, short_docs, group)
    n_lines, n_dropped, d, t, gone, bits = fresh(docs, "_n_lines", "_n_dropped", "_d", "_t", "_gone", "_bits")
    # the places of a document's dropped lines, a bit each, in words of 64
    drops = marks.select("doc_id", "text_key", F.posexplode("marks").alias("at", "x")).where("x is not null").select("doc_id", "text_key", "at", "x.leaf", "x.line")
    drops = drops.join(bounded(recurring), ["leaf", "line"]).where("doc_id is null and first is not null or doc_id <> first")
    drops = drops.groupBy("doc_id", "text_key", F.expr("at div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
    drops = drops.groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"), F.max("w").alias("w"), F.sum(F.bit_count("b")).alias("n"))
    drops = drops.select(F.col("doc_id").alias(d), F.col("text_key").alias(t), F.col("n").alias(gone), F.expr("transform(sequence(0, w), i -> coalesce(try_element_at(m, i), 0L))").alias(bits))
    drops = scratch.keep(drops, "drops")
    scratch.free(marks, recurring)
    # by a shuffle at every size: what is dropped grows with the documents
    joined = docs.join(drops.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)), "left")
    split = F.split(F.col("text").cast("string"), "\n")
    kept = F.expr(f"filter(split(cast(text as string), '\\n'), (x, i) -> coalesce(shiftrightunsigned(get(`{bits}`, cast(i div 64 as int)), cast(i % 64 as int)) & 1L, 0L) = 0L)")
    text = F.when(F.col(bits).isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn(n_lines, F.coalesce(F.size(split), F.lit(0)).cast("long")).withColumn(n_dropped, F.coalesce(F.col(gone), F.lit(0)).cast("long"))
    return joined.withColumn("text", text).drop(d, t, gone, bits)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


QUERIES = {"op8_line_templates": op8_line_templates}
SQL: dict[str, str] = {}
