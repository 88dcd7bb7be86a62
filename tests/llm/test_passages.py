"""Removal of repeated passages against direct reading of its definition."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cantora.llm import passages

DOCS = "doc_id long, text string"


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    last = 1 << 63
    least = {}
    split = [(last if i is None else i, words_in(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, last), i)
    out = []
    for (i, _), (at, w) in zip(rows, split, strict=True):
        gone = {x for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < at for x in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    shared = [word(rng.randrange(10, 80)) for _ in range(8)]
    rows = [(None, None), (0, ""), (1, "a b"), (2, " ".join(["z"] * 40)), (3, " ".join(["z"] * 14))]
    for i in range(4, 120):
        w = word(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            w += part + word(rng.randrange(8))
        rows.append((i, rng.choice([" ", "\t", "\n "]).join(w)))
    rows += [(i + 200, rows[i][1]) for i in range(4, 50)]  # copies
    rows += [rows[60], (60, rows[61][1]), (None, rows[70][1]), (None, rows[70][1]), (-5, rows[80][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "period", "chunk", "bucket"), [(13, 7, 8 << 20, 16 << 20), (13, 7, 900, 700), (5, 3, 2_000, 5_000), (6, 1, 500, 500), (13, 13, 1, 3_000)])
def test_passages(spark, window, period, chunk, bucket):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"chunk": F.lit(1), "kept": F.lit("x"), "ids": F.lit(0)})
    got = passages.drop_repeated_passages(docs.repartition(3), window, period, chunk, bucket).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, window)


def test_covers():
    assert passages.cover(7) == (0, 1, 3) and passages.cover(1) == (0,) and len(passages.cover(13)) == 4
    for period in range(1, 14):
        found = set(passages.cover(period))
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in found and (j + d) % period in found for d in range(period))


def test_empty_table_and_limits(spark):
    empty = spark.createDataFrame([], DOCS)
    assert passages.drop_repeated_passages(empty).count() == 0
    with pytest.raises(ValueError, match="a word long"):
        passages.drop_repeated_passages(empty, 5, 6)


def test_very_long_text(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(90_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(w)), (2, "start " + " ".join(w[100_000:250_000]) + " end"), (3, "x" * 3_000_000)]
    got = {r["doc_id"]: r for r in passages.drop_repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 150_000, 0] and got[2]["kept"] == "start end" and got[3]["kept"] == rows[2][1]
