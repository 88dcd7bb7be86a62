"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents with equal sets form a class, and
only classes are compared. Each class has 250 min-hashes of 16 bits in 50 bands of 5: two classes of similarity 0.75 share
no band with a probability of 1.3e-6. Candidates of a bucket are compared in batches of 25 min-hashes; a pair goes as soon
as the posterior probability (uniform prior) that its similarity reaches the threshold is below ``miss``. Survivors are
compared on their full sets.

Buckets are not expanded into pairs: each member is paired with the head of its bucket, and connected classes are merged.
Then only buckets that still hold several components are compared, members of different components only, in
blocks of at most ``BLOCK`` rows inside a task, which puts out survivors as lists; their exact comparison meets the sets of a
block of documents at a time. So no link between components is lost, and no row is made for a pair.

Nulls and empties: a null or blank text has an empty set and is linked with nothing; a null doc_id takes part by its text
and sorts after all others, so it names a component only if no other id is there. A class has a number of its own, so classes
without an id, or with the same one, stay apart unless they are similar. Repeated rows are equal sets. Rows that
share a doc_id but not a text each follow their own text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, bounded, slices, table, texts

BANDS, ROWS, BATCH = 50, 5, 25
MISS = 1e-6
WORDS = 5
CACHE = 150_000
BLOCK = 2_000
BLOCK_MB = 2
LOCAL_EDGES = 1_000_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * _MIX[0] + h[k : k + n])
    return np.unique(out)


@lru_cache(1)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32), rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray], count: int = BANDS * ROWS) -> np.ndarray:
    """Low 16 bits of min-hashes, a row for each non-empty set. The hashes are re-mixed 32-bit halves of the shingles'."""
    flat = np.concatenate(sets)
    low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), count), np.uint16)
    for k, (x, m) in enumerate(zip(*_permutations(count), strict=True)):
        v = (low ^ x) * m
        v ^= v >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


_SIGNED = "doc_id long, text_key long, n_shingles long, h1 long, h2 long, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        sets = [shingle_set(t) for t in texts(batch)]
        full = [s for s in sets if len(s)]
        sig = iter(signatures(full) if full else ())
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
            ["doc_id", "text_key", "n_shingles", "h1", "h2", "sig"],
        )


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket of each band, from rows of min-hashes."""
    sig = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * _MIX[0] + sig[:, :, k])
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        key = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)), pa.array(key.reshape(-1))], ["node", "bucket"])


@lru_cache(8)
def least_matches(total: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch end n: the fewest matches m with P(similarity >= threshold | m of n) >= miss under a uniform prior."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, total + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(s) + (n - m) * np.log1p(-s)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        tail = like[:, s >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(tail >= miss)))
    return tuple(out)


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(least_matches(one.shape[1], threshold, miss)):
                at = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (one[alive, at] == two[alive, at]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in texts(batch)], pa.binary())], ["node", "shingles"])


def _with_block(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(_block(batch.column(0).to_numpy(), blocks)), *batch.columns], ["block", "node", "shingles"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((one, two)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal leading columns, from sorted rows."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda r: r[:keys]):
        yield list(group)


def _block(node: np.ndarray, blocks: int) -> np.ndarray:
    return (_mix(node.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _within(threshold: float, miss: float, blocks: int):
    """Partners of each member of a bucket's pair of blocks (bucket, i, j, mine, node, component, sig) that belong to another
    component and survive, where this bucket is the first that both are in: (node, block of the partners, partners)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            bucket, i, j = group[0][:3]
            mine, node, component = (np.array([r[k] for r in group], np.int64) for k in (3, 4, 5))
            sig = np.frombuffer(b"".join(r[6] for r in group), np.uint16).reshape(len(group), -1)
            if component.min() == component.max():
                continue
            here = np.argmax(band_keys(sig[:1])[0] == bucket) * ROWS  # all of a bucket share the band
            bands = sig[:, :here].reshape(len(sig), -1, ROWS)
            out = []
            for x in np.flatnonzero(mine == i):
                y = np.flatnonzero((component > component[x]) if i == j else (component != component[x]) & (mine == j))
                matches = np.zeros(len(y), np.int64)
                for k, least in enumerate(least_matches(sig.shape[1], threshold, miss)):
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    matches += (sig[y, at] == sig[x, at]).sum(axis=1)
                    y, matches = y[matches >= least], matches[matches >= least]
                    if not len(y):
                        break
                if len(y):
                    y = y[~(bands[y] == bands[x]).all(axis=2).any(axis=1)]
                    to = _block(node[y], blocks)
                    out += [(node[x], b, node[y[to == b]]) for b in np.unique(to)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["node", "block", "partners"])

    return run


def _exact_blocks(percent: int):
    """Links from rows (block, asks, node, shingles, partners), sorted: the sets of a block, then what is compared with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets = None, {}
        for batch in slices(batches, 512):
            found = []
            for block, asks, node, raw, partners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != current:
                    current, sets = block, {}
                one = np.frombuffer(raw, np.uint64)
                if not asks:
                    sets.setdefault(node, []).append(one)
                    continue
                for other in partners:
                    for two in sets.get(other, ()):
                        if 100 * min(len(one), len(two)) >= percent * max(len(one), len(two)):
                            shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                            if 100 * shared >= percent * (len(one) + len(two) - shared):
                                found.append((node, other))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find of a partition's edges: each of its nodes with the smallest one it reaches here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])


def components(links: DataFrame, scratch: Scratch, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that can be reached.

    Partitions of at most ``local`` edges are contracted to stars first; if there is more than one, alternating large and small
    stars join them, with edges, never whole neighbourhoods, as rows."""
    edges = scratch.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    parts = -(-edges.count() // local) or 1
    old, edges = edges, scratch.keep((edges.coalesce(1) if parts == 1 else edges.repartition(parts)).mapInArrow(_local_stars, "u long, v long"), "stars")
    scratch.free(old)
    if parts == 1:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges, seen = edges.where("u <> v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small, "small")
        scratch.free(large)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return near_rows(docs, percent, miss).select("doc_id", "n_shingles", "component_id", "kept")


def near_rows(docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """near_duplicates() with text_key, and head: whether the row's doc_id and text stand for its component. A blank text always does."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = scratch.keep(docs.mapInArrow(_sign, _SIGNED), "signed")
    last = (1 << 63) - 1
    named = F.coalesce("doc_id", F.lit(last))
    classes = scratch.keep(signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct(named.alias("id"), "text_key")).alias("row"), F.first("sig").alias("sig")).select("h1", "h2", "row.id", "row.text_key", "sig", F.monotonically_increasing_id().alias("node")), "classes")
    sig = classes.select("node", "sig")
    bands = scratch.keep(sig.mapInArrow(_bands, "node long, bucket long"), "bands")
    heads = scratch.bounded(bands.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("bucket", "head"), "heads")
    buckets = scratch.keep(bands.join(heads, "bucket"), "buckets")
    scratch.free(bands)

    def sets_of(nodes: DataFrame) -> DataFrame:
        rows = scratch.bounded(classes.select("node", "id", "text_key").join(nodes, "node", "left_semi"), "nodes")
        text = docs.select(named.alias("id"), "text_key", "text").join(rows, ["id", "text_key"]).select("node", "text")
        return scratch.keep(text.mapInArrow(_sets, "node long, shingles binary").where("octet_length(shingles) > 0").dropDuplicates(["node"]), "sets")

    # each member with its bucket's head
    pairs = scratch.keep(buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "one"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "two"}), "b").select("a", "b", "one", "two")
    alive = scratch.keep(both.mapInArrow(_prune(percent / 100, miss), "a long, b long"), "alive")
    sets = sets_of(alive.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    full = alive.join(sets.withColumnsRenamed({"node": "a", "shingles": "one"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "two"}), "b").select("a", "b", "one", "two")
    links = scratch.keep(full.mapInArrow(_exact(percent), "a long, b long"), "links")
    scratch.free(sets, alive, pairs)
    merged = components(links, scratch)

    # members of different components, in blocks
    at = buckets.join(bounded(merged), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = at.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    at = scratch.keep(at.join(scratch.bounded(mixed.select("bucket", F.ceil(F.col("size") / BLOCK).alias("parts")), "mixed"), "bucket"), "at")
    sets = sets_of(at.select("node").distinct())
    size = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    blocks = 1 + int(size // (BLOCK_MB << 20))
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    at = at.select("bucket", "node", "component", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("with")).join(sig, "node")
    at = at.select("bucket", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "node", "component", "sig")
    at = at.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    alive = at.mapInArrow(_within(percent / 100, miss, blocks), "node long, block long, partners array<long>")
    asks = alive.groupBy("node", "block").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    asks = asks.join(sets, "node").select("block", F.lit(1).alias("asks"), "node", "shingles", "partners")
    held = sets.mapInArrow(_with_block(blocks), "block long, node long, shingles binary").select("block", F.lit(0).alias("asks"), "node", "shingles", F.lit(None).cast("array<long>").alias("partners"))
    both = held.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks")
    found = scratch.keep(both.mapInArrow(_exact_blocks(percent), "a long, b long"), "links")
    scratch.free(sets)
    if found.take(1):
        merged = components(links.unionByName(found), scratch)

    names = classes.select("node", F.struct("id", "text_key", "node").alias("own"))
    # a component's smallest node may not be among the nodes
    merged = merged.select("node", "component").unionByName(merged.select(F.col("component").alias("node"), "component")).distinct()
    merged = names.join(bounded(merged), "node")
    first = merged.groupBy("component").agg(F.min("own").alias("first"))
    merged = scratch.keep(merged.join(first, "component").select("node", "first"), "merged")
    own = F.struct("id", "text_key", "node")
    merged = classes.select("h1", "h2", "node", own.alias("own")).join(bounded(merged), "node", "left").select("h1", "h2", "node", F.coalesce("first", "own").alias("first"))
    name = F.when(F.col("first.id") == last, F.lit(None).cast("long")).otherwise(F.col("first.id"))
    out = signed.select("doc_id", "text_key", "n_shingles", "h1", "h2").join(merged, ["h1", "h2"], "left")
    head = F.coalesce(F.struct(named.alias("id"), "text_key", "node") == F.col("first"), F.lit(True))
    out = out.select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(name).alias("component_id"), "text_key", F.when(F.col("first").isNull(), F.lit(True)).otherwise(head).alias("head"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
  from w
), n as (select doc_id, count(*) as n from s group by doc_id),
many as (select g from s group by g having count(*) > 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from (s semi join many using (g)) a join (s semi join many using (g)) b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as v, doc_id as m from n union select e.b, r.m from r join e on e.a = r.v),
m as (select v, min(m) as m from r group by v)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.m, d.doc_id) as component_id, d.doc_id = coalesce(m.m, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.v = d.doc_id
"""

QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
SQL = {"op7_minhash_near_dedup": _SQL}
