"""Periodic runs against direct reading of their definition, on small texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantora.llm import grams, runs

DOCS = "doc_id long, text string"


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=6, times=4):
    n, found = len(w), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((i, length, q) for (i, length), q in found.items())


def kept(w, found):
    drop = {k for i, length, q in found for k in range(i + q, i + length)}
    return " ".join(x for k, x in enumerate(w) if k not in drop)


def texts():
    rng = random.Random(13)
    out = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "b " * 5 + "c", "\x1c a b " * 4, "x" * 200 + " " + ("y" * 70 + " ") * 9]
    for size in (1, 2, 3):
        out += [" ".join(rng.choice("abc"[:size]) for _ in range(rng.randrange(5, 90))) for _ in range(25)]
    for _ in range(25):
        unit = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))]
        w = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(20))] + unit * rng.randrange(2, 9) + unit[: rng.randrange(len(unit) + 1)] + [f"w{rng.randrange(30)}" for _ in range(9)]
        out.append(rng.choice([" ", "\n", " \r\n "]).join(w * rng.randrange(1, 3)))
    return out


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs(spark, least, times):
    rows = list(enumerate(texts())) + [(None, "z " * 8), (5, "again again"), (5, "again again")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"runs": F.lit(1), "n_words": F.lit(2), "collapsed": F.lit("x")})
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(docs, least, times).collect())
    wanted = []
    for i, text in rows:
        w = words_in(text)
        found = brute_runs(w, least, times)
        wanted.append((-1 if i is None else i, len(w), found, kept(w, found)))
    assert got == sorted(wanted)


def test_empty_table_and_odd_limits(spark):
    empty = spark.createDataFrame([], DOCS)
    assert runs.periodic_runs(empty).count() == runs.with_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="two words"):
        runs.periodic_runs(empty, 1)


def test_very_long_text(spark):
    rng = random.Random(4)
    head = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    w = head + head[-40_000:] * 4
    found = runs.periodic_runs(spark.createDataFrame([(1, " ".join(w)), (2, None)], DOCS))
    one = found.where("doc_id = 1").first()
    assert [tuple(x) for x in one["runs"]] == [(110_000, 200_000, 40_000)] and one["collapsed"] == " ".join(head)


def test_query_repeats_words_by_doc_id(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(500, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    some = 0
    for i, text in rows:
        w, h = words_in(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found, r = brute_runs(w), got[i]
        some += len(found)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r["n_runs"] == len(found) and (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(w, found).encode()).hexdigest()
    assert some


def test_mask_keeps_every_run():
    assert runs.overlap(6, 4) == 5 and runs.overlap(2, 2) == 1 and runs.overlap(9, 3) == 6
    for text in texts():
        w = words_in(text)
        words = grams.words_of([(text or "").encode()])
        mask = runs.repeated_words(words, 5)
        assert len(mask) == len(w)
        for i, length, _ in brute_runs(w):
            assert mask[i : i + length].all()


def test_words_as_bytes():
    found = grams.words_of([b"a  b\tc", None, b"", b"a b\x0bc \x1c"])
    assert found.first.tolist() == [0, 3, 3, 3, 7] and found.hashes[:3].tolist() == found.hashes[3:6].tolist()
    assert [found.joined(k) for k in range(4)] == [b"a b c", b"", b"", b"a b c \x1c"]
    assert found.joined(3, np.array([1, 1, 1, 0, 1, 1, 0], bool)) == b"b c"
    assert grams.inside(found.first, 3).tolist() == [True, False, False, True, True, False, False]
