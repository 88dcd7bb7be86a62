"""Periodic runs within documents, found by repeated k-gram masking and Main-Lorentz.

A run is a stretch of words with smallest period q (words q apart are equal), of max(``least``, ``times`` * q) words or more, that
neither neighbour extends. A run moved by its period overlaps itself in max(least, times * q) - q words; ``k``, the minimum of that
over all periods, is 5 here. So every word of a run lies in a k-gram that is repeated in its document, and only stretches of such
words are searched. There the Main-Lorentz division is used: a run that crosses the middle of a stretch has half its periods on one side
of it, so for each period the words around the middle must equal those a period away; how far that goes on either side is read from the
names of repeated stretches of 1, 2, 4, ... words. All stretches of a portion of documents are halved together.

Every document is worked on whole, alone, in one task, in memory proportional to its length. Words are compared by 64-bit hashes.
Null and blank texts have no words and no runs; their collapsed text is empty. Rows that repeat a doc_id, or have none, each give a row.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import table
from cantora.llm.grams import Words, grams, inside, mix, portions, words_of

LEAST, TIMES = 6, 4


def overlap(least: int, times: int) -> int:
    """Words in which any run overlaps itself when it is moved by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated_words(words: Words, k: int) -> np.ndarray:
    """Words that lie in a k-gram which their text holds twice or more."""
    n = len(words.hashes)
    at = np.flatnonzero(inside(words.first, k))
    key = mix(grams(words.hashes, k)[at] ^ mix(words.text[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + k, -1)
    return np.cumsum(change[:n]) > 0


def stretches(mask: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of marked words of one text start and end, of so many words at least."""
    n = len(mask)
    cut = np.zeros(n + 1, bool)
    cut[first] = True
    before = np.concatenate(([False], mask))
    after = np.concatenate((mask, [False]))
    starts, ends = np.flatnonzero(after & (cut | ~before)), np.flatnonzero(before & (cut | ~after))
    long = ends - starts >= least
    return starts[long], ends[long]


def _names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the 1, 2, 4, ... codes from each place on: equal where they are; the last place is a code of its own."""
    out = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    while 1 << len(out) <= longest:
        step = 1 << (len(out) - 1)
        ahead = np.full(len(codes), -1, np.int64)
        ahead[:-step] = out[-1][step:]
        out.append(np.unique(out[-1] * (len(codes) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64))
    return out


def _ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many codes from i and from j on are equal, i < j."""
    last, far = len(names[0]) - 1, np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        same = names[level][np.minimum(i + far, last)] == names[level][np.minimum(j + far, last)]
        far += same.astype(np.int64) << level
    return far


def _behind(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many codes up to i and up to j are equal, i < j."""
    far = np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        x, y = i - far - (1 << level) + 1, j - far - (1 << level) + 1
        same = (x >= 0) & (names[level][np.maximum(x, 0)] == names[level][np.maximum(y, 0)])
        far += same.astype(np.int64) << level
    return far


def find_runs(words: Words, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and period of every run, by first word and period, over all texts."""
    empty = np.empty(0, np.int64)
    k = overlap(least, times)
    starts, ends = stretches(repeated_words(words, k), words.first, least)
    if not len(starts):
        return empty, empty, empty
    # the stretches behind one another, with a code of its own behind each
    lengths = ends - starts
    low = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    total = int(low[-1] + lengths[-1] + 1)
    apart = low + lengths
    at = np.arange(total) + np.repeat(starts - low, lengths + 1)
    codes = np.unique(words.hashes[np.minimum(at, len(words.hashes) - 1)], return_inverse=True)[1].astype(np.int64)
    codes[apart] = codes.max() + 1 + np.arange(len(apart))
    names = _names(codes, int(lengths.max()))
    found = []
    lo, hi = low, low + lengths
    while len(lo):
        middle = (lo + hi) // 2
        for side in (0, 1):
            most = 2 * ((hi - middle) if side == 0 else (middle - lo)) // times
            m = np.repeat(middle, most)
            q = np.arange(len(m)) - np.repeat(np.cumsum(most) - most, most) + 1
            base = m - q * side
            near = codes[base - 1 + side] == codes[base - 1 + side + q]
            base, q = base[near], q[near]
            if times >= 4:  # two periods on this side, so the next words belong to the run as well
                near = codes[base - side] == codes[base - side + q]
                base, q = base[near], q[near]
            start, end = base - _behind(names, base - 1, base - 1 + q), base + q + _ahead(names, base, base + q)
            enough = end - start >= np.maximum(least, times * q)
            found.append(np.stack((start[enough], end[enough], q[enough])))
        lo, hi = np.concatenate((lo, middle)), np.concatenate((middle, hi))
        wide = hi - lo >= least
        lo, hi = lo[wide], hi[wide]
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least_period = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    start, end, q = start[least_period], end[least_period], q[least_period]
    shift = (starts - low)[np.searchsorted(low, start, side="right") - 1]
    start, end = start + shift, end + shift
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def kept_words(words: Words, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Words that no run holds behind its first period."""
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, start + q, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:-1] == 0


_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _search(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            words = words_of(batch.column(1).to_pylist())
            start, end, q = find_runs(words, least, times)
            keep = kept_words(words, start, end, q)
            offsets = np.searchsorted(start, words.first)
            own = start - words.first[np.searchsorted(words.first, start, side="right") - 1]
            runs = pa.StructArray.from_arrays([pa.array(own), pa.array(end - start), pa.array(q)], fields=list(_RUNS))
            collapsed = [words.joined(k, keep) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs), pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without what repeats in a run, for each row."""
    if least < 2 or times < 2:
        raise ValueError("runs need two words and two periods at least")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_search(least, times), _SCHEMA)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
            g, words = h // 10, text.split() if text and h % 10 == 0 else ()
            if n := len(words):
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by doc_id, repeat some of their words up to the end."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return docs.mapInArrow(_repeat, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("less"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.expr("(1000 * best.length) div (-best.less)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Repeated five-grams of equal distance in a row are a stretch of equal words; crc32 is taken bit by bit.
_SQL = r"""
with recursive w0 as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
      lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))), 4294967295) as h
  from documents
), w1 as (select doc_id, w, len(w) as n, h, h // 10 as g from w0),
w2 as (select *, case when n > 0 then g % n else 0 end as a from w1),
w3 as (select *, 1 + (n - a) // (3 + g % 8) as p from w2),
d as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i >= a then w[a + (i - a) % p + 1] else w[i + 1] end) else w end as w
  from w3
), g5 as (
  select doc_id, unnest(list_transform(range(n - 4), lambda i: struct_pack(i := i, g := array_to_string(w[i + 1:i + 5], ' ')))) as s
  from d where n >= 6
), g as (select doc_id, s.i as i, s.g as g from g5),
m as (select x.doc_id, x.i, y.i - x.i as q from g x join g y on x.doc_id = y.doc_id and x.g = y.g and x.i < y.i),
s as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as run from m),
r0 as (select doc_id, q, min(i) as start, count(*) + 4 + q as length from s group by doc_id, q, run),
r as (select doc_id, start, length, min(q) as period from r0 where length >= greatest(6, 4 * q) group by all),
b as (
  select doc_id, count(*) as n_runs, arg_max(struct_pack(start, length, period), struct_pack(l := length, s := -start, p := -period)) as best,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as runs
  from r group by doc_id
), dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
word as (select doc_id, unnest(range(n)) as i, unnest(w) as word from d),
c as (select doc_id, string_agg(word, ' ' order by i) as kept from word anti join dropped using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli,
  sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join b using (doc_id) left join c using (doc_id)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL = {"op13_periodic_runs": _SQL}
