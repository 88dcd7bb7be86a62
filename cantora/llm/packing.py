"""Packing along a Hilbert curve.

Each document's token counts are hashed into 256 signed buckets, scaled to unit length and projected to four dimensions;
15 bits of each make a Hilbert key. Documents are range-sorted by (key, row), and the stream of their ids in that order is
cut every ``length`` ids: neighbours on the curve share sequences and only the last sequence is short. A document's place in
the stream is its place in its range plus the lengths of the ranges before, of which the driver sees one number a range.

Token ids equal those of the tokenizer for the whole text: it never joins characters across white space, so ids are kept
for words, in a bounded cache; words of Latin letters and their closing marks go to the model itself, all others through
the whole tokenizer, and a text with separators that only Python counts as white space (U+001C to U+001F) is encoded whole.

A null or empty text is the end id alone. Copies have equal keys and are spread by their row; repeated rows are packed
each; a null doc_id stays null; no rows give no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import Scratch, slices, table, texts

END = 2
LENGTH = 4096
CACHE = 1_000_000
BUCKETS, DIMS, BITS = 256, 4, 15
_ODD = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?)\"*$%&#]*)")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The printable stand-ins of bytes in byte-level vocabularies.
_STAND = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordIds(dict):
    """Little-endian unsigned 16-bit ids of a word without white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path))
        steps = [x["type"] for x in spec["pre_tokenizer"].get("pretokenizers", [])]
        self.model = self.whole.model if steps == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>" else None
        assert self.whole.get_vocab_size() <= 1 << 16

    def encode(self, text: str) -> bytes:
        return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = None
        if self.model is not None and (plain := _PLAIN.fullmatch(word)):
            letters, marks = plain[1], plain[2]
            if letters.isascii() or (letters.isalpha() and max(letters) < "\u0250" and "\u0130" not in letters):
                low = letters.lower()
                if marks or low != word:
                    ids = self[low] + (self[marks] if marks else b"")
                else:
                    shown = low if low.isascii() else "".join(map(_STAND.__getitem__, low.encode()))
                    ids = array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(1)
def _projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the projection of buckets."""
    rng = np.random.default_rng(17)
    return rng.integers(0, BUCKETS, 1 << 16), rng.choice([-1.0, 1.0], 1 << 16), rng.standard_normal((BUCKETS, DIMS))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of non-negative cells, by turning and swapping axes from the highest bit down."""
    x = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k in range(len(x)):
            turned = (x[k] & high) > 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros(len(x[0]), np.uint64)
    for level in range(bits - 1, 0, -1):
        high = np.uint64(1 << level)
        flip ^= np.where((x[-1] & high) > 0, high - one, np.uint64(0))
    key = np.zeros(len(x[0]), np.uint64)
    for level in range(bits - 1, -1, -1):
        for k in range(len(x)):
            key = (key << one) | (((x[k] ^ flip) >> np.uint64(level)) & one)
    return key.astype(np.int64)


def document_keys(ids: list[np.ndarray]) -> np.ndarray:
    bucket, sign, projection = _projection()
    rows = np.stack([np.bincount(bucket[x], sign[x], BUCKETS) for x in ids]) if ids else np.zeros((0, BUCKETS))
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    spread = (rows / np.where(size > 0, size, 1)) @ projection
    return hilbert_key(np.clip((spread + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in slices(batches, 256):
            ids = [words.text(t) + END.to_bytes(2, "little") for t in texts(batch)]
            keys = document_keys([np.frombuffer(x, "<u2") for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(keys), pa.array(ids, pa.binary())], ["doc_id", "doc_tokens", "key", "ids"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    before, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column(1)], ["row", "part", "place", "n"])
        before = int(ends[-1]) if len(n) else before


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for doc_id, begin, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, at = np.frombuffer(raw, "<u2").astype("<u4"), 0
                while at < len(ids):
                    sequence, offset = divmod(begin + at, length)
                    piece = ids[at : at + length - offset]
                    out.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence, offset, piece.astype("<i4")))
                    at += len(piece)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k < 7 else pa.list_(pa.int32())) for k, c in enumerate(columns)], names)

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece of a document in a sequence, with its ids: those columns of ``_PIECES``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = docs.mapInArrow(_encode(tokenizer), "doc_id long, doc_tokens long, key long, ids binary").withColumn("row", F.monotonically_increasing_id())
    coded = scratch.keep(coded, "coded")
    order = coded.select("row", "key", F.col("doc_tokens").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = order.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("row", "n")
    placed = scratch.keep(placed.mapInArrow(_places, "row long, part int, place long, n long"), "placed")
    total, before = 0, {}
    for part, n in sorted(placed.groupBy("part").agg(F.sum("n")).collect()):
        before[part], total = total, total + n
    starts = F.broadcast(docs.sparkSession.createDataFrame(list(before.items()), "part int, before long"))  # a row a range
    at = placed.join(starts, "part").select("row", (F.col("place") + F.col("before")).alias("begin"))
    return coded.select("row", "doc_id", "ids").join(at, "row").select("doc_id", "begin", "ids").mapInArrow(_cut(length), _PIECES)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


QUERIES = {"op3_hilbert_packing": op3_hilbert_packing}
SQL: dict[str, str] = {}
