"""Substring deduplication by difference-cover anchors.

A window is ``window`` consecutive words of one document. Words go that lie in a window which also starts in a document with a smaller
doc_id. Windows are judged on the input.

Grams of window - period + 1 words are hashed only at places whose index in the document, modulo ``period``, lies in a difference cover:
any two places have an offset below the period that takes both into the cover, so two equal windows always hold an equal anchor at the
same offset. Only windows with an anchor that two documents share are then hashed whole, with 96 bits, which extends each anchor to
every match around it, and the smallest doc_id of each window decides.

Documents are dealt into chunks of some ``chunk`` bytes, written once. A chunk sends its distinct anchors or windows, with the smallest
doc_id of each, to buckets of hashes, as one packed row for each bucket, and gets one bit for each of them back. So a passage of
a third of all documents is one entry of a chunk, never pairs; no task holds more than a chunk, or a bucket of at most an
entry for each hash and chunk. Bits are broadcast while they are measured to be few, else joined by chunk.

Null and blank texts have no words. Documents shorter than a window keep all words. Rows that share a doc_id don't remove words from
each other; a null doc_id sorts behind all others. Every row gives a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, bounded, table
from cantora.llm.grams import Words, grams, inside, portions, words_of

WINDOW, PERIOD = 13, 7
#: Bytes of text in a chunk (one text may be larger), and for each bucket of hashes.
CHUNK, BUCKET = 8 << 20, 16 << 20
LAST = (1 << 63) - 1


@lru_cache(16)
def cover(period: int) -> tuple[int, ...]:
    """The smallest set of residues, 0 among them, whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(x - y) % period for x in found for y in found}) == period:
                return found
    raise ValueError("a period is one at least")


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def row():
            packed = zstandard.compress(b"".join(texts), 3)
            ends = np.cumsum([len(x) for x in texts])
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | nth]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["chunk", "ids", "ends", "packed"])

        for batch in portions(batches, 1):
            ids += batch.column(0).to_pylist()
            texts += [x or b"" for x in batch.column(1).to_pylist()]
            held += sum(map(len, texts[len(texts) - batch.num_rows :]))
            if held >= size:
                yield row()
                nth += 1
                ids, texts, held = [], [], 0
        if ids:
            yield row()

    return run


class _Chunk:
    """Words, anchors and windows of a chunk, the same each time it is read."""

    def __init__(self, ids: list, ends: list, packed: bytes, window: int, period: int, buckets: int):
        data = zstandard.decompress(packed)
        self.ids = ids
        self.words: Words = words_of([data[i:j] for i, j in zip([0, *ends], ends, strict=False)])
        self.window, self.gram, self.buckets = window, window - period + 1, buckets
        self.doc = np.repeat(np.array([LAST if i is None else i for i in ids], np.int64), np.diff(self.words.first))
        index = np.arange(len(self.doc)) - np.repeat(self.words.first[:-1], np.diff(self.words.first))
        long = np.repeat(np.diff(self.words.first) >= window, np.diff(self.words.first))
        self.anchored = np.flatnonzero(long & inside(self.words.first, self.gram) & np.isin(index % period, cover(period)))
        key = grams(self.words.hashes, self.gram)[self.anchored]
        self.order = np.argsort(key, kind="stable")
        self.anchors, self.group = self._groups(key[self.order])

    @staticmethod
    def _groups(key: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where groups of equal sorted keys begin, and the group of each."""
        new = np.concatenate(([True], key[1:] != key[:-1] if more is None else (key[1:] != key[:-1]) | (more[1:] != more[:-1])))[: len(key)]
        return np.flatnonzero(new), np.cumsum(new) - 1

    def anchor_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and whether two documents here share each."""
        key, doc = grams(self.words.hashes, self.gram)[self.anchored][self.order], self.doc[self.anchored][self.order]
        if not len(key):
            return key, np.empty(0, bool)
        return key[self.anchors], np.minimum.reduceat(doc, self.anchors) < np.maximum.reduceat(doc, self.anchors)

    def find_windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows around the anchors (in their order) that are shared: two hashes and the smallest doc_id."""
        marked = np.zeros(len(self.doc) + 1, np.int64)
        marked[1:][self.anchored[self.order[shared[self.group]]]] = 1
        marked = np.cumsum(marked)
        at = np.flatnonzero(inside(self.words.first, self.window))
        at = at[marked[at + self.window - self.gram + 1] > marked[at]]
        one, two = grams(self.words.hashes, self.window, 1)[at], (grams(self.words.hashes, self.window, 2)[at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        self.at, one, two = at[order], one[order], two[order]
        first, self.of = self._groups(one, two)
        self.least = np.minimum.reduceat(self.doc[self.at], first) if len(first) else np.empty(0, np.int64)
        return one[first], two[first], self.least

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """Words covered by a window that a smaller doc_id has, here or, for the smallest one here, elsewhere."""
        hit = (self.doc[self.at] > self.least[self.of]) | elsewhere[self.of]
        change = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(change, self.at[hit], 1)
        np.add.at(change, self.at[hit] + self.window, -1)
        return np.cumsum(change)[:-1] > 0

    def slices(self, key: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of sorted keys, for buckets that have any."""
        bucket = _bucket(key, self.buckets)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        return list(zip(bucket[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(key)], strict=True)) if len(key) else []

    def bits(self, key: np.ndarray, marks: list | None) -> np.ndarray:
        """A bit for each of the sorted keys, from what the buckets said."""
        said = {m["bucket"]: m["bits"] for m in marks or ()}
        parts = [np.unpackbits(np.frombuffer(said[b], np.uint8), count=j - i).astype(bool) for b, i, j in self.slices(key)]
        return np.concatenate(parts) if parts else np.empty(0, bool)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that leading zeros lie together."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


_PACKED = "bucket int, chunk long, one binary, two binary, least binary"
_BITS = "chunk long, bucket int, bits binary"


def _rows(chunk: int, where: list, one: np.ndarray, two: np.ndarray | None, least: np.ndarray) -> pa.RecordBatch:
    columns = [[b for b, _, _ in where], [chunk] * len(where), [one[i:j].tobytes() for _, i, j in where], [None if two is None else two[i:j].tobytes() for _, i, j in where]]
    columns.append([np.packbits(least[i:j]).tobytes() if two is None else _planes(least[i:j]) for _, i, j in where])
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "chunk", "one", "two", "least"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _send_anchors(window: int, period: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            chunk = _Chunk(row["ids"], row["ends"], row["packed"], window, period, buckets)
            key, shared = chunk.anchor_keys()
            yield _rows(row["chunk"], chunk.slices(key), key, None, shared)

    return run


def _send_windows(window: int, period: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            chunk = _Chunk(row["ids"], row["ends"], row["packed"], window, period, buckets)
            one, two, least = chunk.find_windows(chunk.bits(chunk.anchor_keys()[0], row["shared"]))
            yield _rows(row["chunk"], chunk.slices(one), one, two, least)

    return run


def _answers(table: pa.Table, said: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """The entries' answers, as bits for each chunk that sent them."""
    ends = np.cumsum(lengths)
    bits = [np.packbits(said[j - n : j]).tobytes() for j, n in zip(ends, lengths, strict=True)]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def _shared(table: pa.Table) -> pa.Table:
    """Whether two documents share an anchor: in one chunk, or as two chunks hold it."""
    raw = table["one"].to_pylist()
    lengths = np.array([len(x) // 8 for x in raw])
    key = np.frombuffer(b"".join(raw), np.uint64)
    here = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["least"].to_pylist(), lengths, strict=True)])
    order = np.argsort(key, kind="stable")
    first, group = _Chunk._groups(key[order])
    both = (np.add.reduceat(here[order].astype(np.int64), first) > 0) | (np.diff(np.append(first, len(key))) > 1)
    said = np.empty(len(key), bool)
    said[order] = both[group]
    return _answers(table, said, lengths)


def _smaller(table: pa.Table) -> pa.Table:
    """Whether another chunk has a window in a document with a smaller doc_id."""
    raw = table["one"].to_pylist()
    lengths = np.array([len(x) // 8 for x in raw])
    one, two = np.frombuffer(b"".join(raw), np.uint64), np.frombuffer(b"".join(table["two"].to_pylist()), np.uint32)
    doc = np.concatenate([_from_planes(x) for x in table["least"].to_pylist()])
    order = np.lexsort((two, one))
    first, group = _Chunk._groups(one[order], two[order])
    least = np.minimum.reduceat(doc[order], first)
    said = np.empty(len(one), bool)
    said[order] = least[group] < doc[order]
    return _answers(table, said, lengths)


def _remove(window: int, period: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            chunk = _Chunk(row["ids"], row["ends"], row["packed"], window, period, buckets)
            one, _, _ = chunk.find_windows(chunk.bits(chunk.anchor_keys()[0], row["shared"]))
            gone = chunk.removed(chunk.bits(one, row["smaller"]))
            first = chunk.words.first
            total = np.concatenate(([0], np.cumsum(gone)))
            kept = [chunk.words.joined(k, ~gone) for k in range(len(chunk.ids))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.ids, pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array((total[first[1:]] - total[first[:-1]]).astype(np.int64)), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return run


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that are left with a space between, for every row of docs (doc_id, text)."""
    if not 1 <= period <= window:
        raise ValueError("anchors are a word long at least")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    # few rows, each large
    rows = docs.mapInArrow(_chunks(chunk), "chunk long, ids array<long>, ends array<long>, packed binary")
    chunks = scratch.keep(rows, "chunks", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})
    size = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    buckets = 1 + int(size // bucket)

    def answers(packed: DataFrame, by, name: str) -> DataFrame:
        bits = packed.groupBy("bucket").applyInArrow(by, _BITS)
        return scratch.bounded(bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), name)

    shared = answers(chunks.mapInArrow(_send_anchors(window, period, buckets), _PACKED), _shared, "shared")
    chunks = chunks.join(shared, "chunk", "left")
    smaller = answers(chunks.mapInArrow(_send_windows(window, period, buckets), _PACKED), _smaller, "smaller")
    left = chunks.join(smaller, "chunk", "left").mapInArrow(_remove(window, period, buckets), "doc_id long, n_words long, n_removed long, kept binary")
    return left.withColumn("kept", F.col("kept").cast("string"))


def op11_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, unnest(list_transform(range(len(w) - 12), lambda i: struct_pack(i := i, g := array_to_string(w[i + 1:i + 13], ' ')))) as s from w where len(w) >= 13),
least as (select s.g as g, min(doc_id) as least from g group by s.g),
gone as (select distinct doc_id, unnest(range(s.i, s.i + 13)) as i from g join least on g.s.g = least.g where least < doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id),
word as (select doc_id, unnest(range(len(w))) as i, unnest(w) as word from w),
k as (select doc_id, string_agg(word, ' ' order by i) as kept from word anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join n using (doc_id) left join k using (doc_id)
"""

QUERIES = {"op11_cover_anchors": op11_cover_anchors}
SQL = {"op11_cover_anchors": _SQL}
