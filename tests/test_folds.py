"""Folds over sorted batches give the same whatever the batches are; phrase windows against plain loops."""

import random
from collections import Counter

import pytest

from cantora.operators import hands, phrases, temporal

NOTES = "note_id long, file_id int, track int, channel int, pitch int, velocity int, start_tick long, end_tick long"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def rows_of(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for f, many in enumerate((n, 7, 1, 60)):
        t = 0
        for k in range(many):
            t += rng.choice([0, 0, 3, 11, 40, 90])
            out.append((1000 * f + k, f, 0, 0, rng.choice([48, 55, 58, 60, 62, 65, 72]), rng.randrange(20, 120), t, t + rng.randrange(1, 99)))
    return out


@pytest.fixture(params=[1, 7, 10_000])
def notes(spark, request):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, request.param)
    yield spark.createDataFrame(rows_of(), NOTES).repartition(3)
    spark.conf.set(BATCH, before)


def plain_groups(rows, within):
    out = {}
    for f in {r[1] for r in rows}:
        anchor, group = None, 0
        for r in sorted((r for r in rows if r[1] == f), key=lambda r: (r[6], r[0])):
            if anchor is None or r[6] > anchor + within:
                anchor, group = r[6], group + 1
            out[r[0]] = group
    return out


def test_anchor_groups(notes):
    got = {r["note_id"]: r["group"] for r in temporal.anchor_groups(notes, 48, ["file_id"], "start_tick", "note_id").collect()}
    assert got == plain_groups(rows_of(), 48)


def test_hands(notes):
    groups = temporal.anchor_groups(notes, 48, ["file_id"], "start_tick", "note_id")
    got = {r["note_id"]: (r["hand"], r["track"]) for r in hands.separate(notes, groups, hands.median_split(notes, "fixed")).collect()}
    rows, of = rows_of(), plain_groups(rows_of(), 48)
    wanted = {}
    for f in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == f), key=lambda r: (of[r[0]], r[6], r[0]))
        for r, hand in zip(mine, hands.assign([(of[r[0]], r[4], r[5]) for r in mine], 60), strict=True):
            wanted[r[0]] = hand, int(hand == "left")
    assert got == wanted and len(set(wanted.values())) == 2


def plain_windows(rows, shortest, longest, step, transposed):
    out = []
    for f in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == f), key=lambda r: (r[6], r[0]))
        for size in range(shortest, longest + 1):
            for pos in range(0, len(mine) - size + 1, step) if size < len(mine) else ():
                w = mine[pos : pos + size]
                ioi = [b[6] - a[6] for a, b in zip(w, w[1:], strict=False)]
                unit = min(ioi) or 1
                out.append((f, pos, size, tuple(b[4] - a[4] for a, b in zip(w, w[1:], strict=False)), tuple(round(x / unit) for x in ioi), 0 if transposed else w[0][4]))
    return out


@pytest.mark.parametrize(("step", "transposed"), [(1, False), (2, True)])
def test_windows(notes, step, transposed):
    got = sorted((r["file_id"], r["pos"], r["len"], tuple(r["ivs"]), tuple(r["rhythm"]), r["p0"]) for r in phrases.frames(notes, 3, 9, step, transposed=transposed).collect())
    assert got == sorted(plain_windows(rows_of(), 3, 9, step, transposed))


def test_folds_over_rows_joined_by_their_keys(spark, tmp_path):
    """Too large for a broadcast by its estimate, the other side of a join by the keys turns out small: rows below are then read as they
    were written, not by key. Small tables hide that, as they are read in one part unless told otherwise."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in conf}
    spark.createDataFrame(rows_of(), NOTES).repartition(6).write.parquet(str(tmp_path / "notes"))
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        notes = spark.read.parquet(str(tmp_path / "notes"))
        got = sorted((r["file_id"], r["pos"], r["len"], tuple(r["ivs"]), tuple(r["rhythm"]), r["p0"]) for r in phrases.frames(notes, 3, 9).collect())
        joined = notes.join(notes.groupBy("file_id").count(), "file_id")
        groups = {r["note_id"]: r["group"] for r in temporal.anchor_groups(joined, 48, ["file_id"], "start_tick", "note_id").collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == sorted(plain_windows(rows_of(), 3, 9, 1, False)) and groups == plain_groups(rows_of(), 48)


def test_sparse_windows(notes):
    got = Counter((r["file_id"], r["pos"] % 2) for r in phrases.windows(notes, 8, 8, sparse_above=100, arrays=False).collect())
    assert got == {(0, 0): 147, (3, 0): 27, (3, 1): 26}


def test_best_patterns(spark):
    rng = random.Random(3)
    phrase = [(rng.randrange(12), rng.choice([5, 10, 20])) for _ in range(12)]
    rows, t = [], 0
    for k in range(40):
        for p, d in phrase if k % 3 else [(rng.randrange(12), rng.choice([5, 10, 20])) for _ in range(5)]:
            t += d
            rows.append((len(rows), 0, 0, 0, 60 + p, 80, t, t + 5))
    notes = spark.createDataFrame(rows, NOTES)
    counts, first = Counter(), {}
    for f, pos, size, ivs, rhythm, p0 in plain_windows(rows, 8, 20, 1, False):
        counts[size, ivs, rhythm, p0] += 1
        first[size, ivs, rhythm, p0] = min(pos, first.get((size, ivs, rhythm, p0), pos))
    wanted = sorted(((-n, key[0], first[key]), key) for key, n in counts.items())[:30]
    got = phrases.best_patterns(notes, 30).orderBy("rank").collect()
    assert [((-r["cnt"], r["len"], r["first_pos"]), (r["len"], tuple(r["ivs"]), tuple(r["rhythm"]), r["p0"])) for r in got] == wanted
    assert got[0]["cnt"] > 20
    every = {(r["len"], tuple(r["ivs"]), tuple(r["rhythm"]), r["p0"]): (r["cnt"], r["first_pos"]) for r in phrases.pattern_counts(phrases.windows(notes)).collect()}
    assert every == {key: (n, first[key]) for key, n in counts.items()}


def test_first_occurrences_are_not_broadcast(spark, tmp_path):
    """Thirteen windows a note, which a planner takes for as many rows as notes, must not be what a join sends to the driver."""
    spark.createDataFrame(rows_of(), NOTES).write.parquet(str(tmp_path / "notes"))
    notes = spark.read.parquet(str(tmp_path / "notes"))
    every = sorted(plain_windows(rows_of(), 8, 20, 1, False), key=lambda w: w[1])
    wanted = {}
    for rank, (f, _, size, ivs, _, p0) in enumerate(every[::97]):
        wanted[f, rank] = min(w[1] for w in every if (w[0], w[2], w[3], w[5]) == (f, size, ivs, p0))
    rows = [(f, rank, size, p0, list(ivs)) for rank, (f, _, size, ivs, _, p0) in enumerate(every[::97])]
    spark.createDataFrame(rows, "file_id int, rank int, len int, p0 int, ivs array<int>").write.parquet(str(tmp_path / "patterns"))
    found = phrases.first_occurrence(notes, spark.read.parquet(str(tmp_path / "patterns")))
    assert {(r["file_id"], r["rank"]): r["pos"] for r in found.collect()} == wanted
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "len#" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_no_notes(spark):
    none = spark.createDataFrame([], NOTES)
    assert temporal.anchor_groups(none, 48, ["file_id"], "start_tick", "note_id").count() == phrases.windows(none).count() == phrases.best_phrases(none).count() == 0


def test_pairs_as_closed(spark):
    from cantora.operators import pairing

    rows = [(0, 0, 1, 0, "note_on", 60, 90, 1), (0, 0, 2, 5, "note_off", 60, 33, 2), (0, 0, 3, 9, "note_on", 62, 80, 1), (0, 0, 4, 12, "note_on", 62, 0, 3)]
    messages = spark.createDataFrame(rows, "file_id int, track int, seq long, abs_tick long, kind string, pitch int, velocity int, channel int")
    pairs = lambda *how: sorted((r["pitch"], r["channel"], r["velocity"]) for r in pairing.pair_last_on_wins(messages, *how).collect())
    assert pairs() == [(60, 1, 90), (62, 1, 80)] and pairs("off", "off") == [(60, 2, 64), (62, 3, 0)] and pairs("off") == [(60, 2, 90), (62, 3, 80)]
