"""Legato of a stream in shuffled micro-batches is that of the batch."""

import os
import random
from pathlib import Path

from cantora.operators import cleaning
from cantora.streaming import notes as stream

NOTES = "note_id long, file_id int, track int, channel int, pitch int, velocity int, start_tick long, end_tick long"


def rows_of(seed=8):
    rng, out = random.Random(seed), []
    for f in range(2):
        t = 0
        for _ in range(250):
            t += rng.choice([0, 5, 30, 60])
            out.append((len(out), f, rng.randrange(2), rng.randrange(3), rng.choice([60, 62, 64]), rng.randrange(1, 128), t, t + rng.choice([3, 20, 45, 90])))
    return out


def written(spark, path, batches):
    """A file for each batch, a minute after the one before, as streams read files by age."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, NOTES).coalesce(1).write.parquet(f"{path}/b{k:02d}")
        for file in Path(f"{path}/b{k:02d}").glob("part-*"):
            os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(NOTES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_shuffled_batches(spark, tmp_path):
    rows, rng = rows_of(), random.Random(2)
    # out of order by up to 2,000 ticks, about 4.5 s; a note far behind the others moves the watermark past them
    mixed = sorted(rows, key=lambda r: r[6] + rng.randrange(2000))
    last = [(9000 + f, f, 0, 0, p, 1, 10**7, 10**7 + 1) for f in range(2) for p in (60, 62, 64)]
    batches = [*(mixed[i : i + 90] for i in range(0, len(mixed), 90)), last]
    source = written(spark, str(tmp_path / "notes"), batches)
    live = {tuple(r) for r in stream.drain(stream.merge_legato(source, "10 seconds"), "legato").collect()}
    batch = cleaning.merge_legato(spark.createDataFrame(rows, NOTES)).select("file_id", "pitch", "note_id", "track", "channel", "start_tick", "end_tick", "velocity", "merged")
    wanted = {tuple(r) for r in batch.collect()}
    assert live == wanted and any(r[-1] > 2 for r in wanted)


def test_late_notes_go(spark, tmp_path):
    note = lambda i, t: (i, 0, 0, 0, 60, 64, t, t + 4)
    source = written(spark, str(tmp_path / "notes"), [[note(0, 0)], [note(1, 100_000)], [note(4, 150_000)], [note(2, 10)], [note(3, 200_000)]])
    live = stream.drain(stream.merge_legato(source, "1 second"), "late").collect()
    assert sorted((r["note_id"], r["merged"]) for r in live) == [(0, 1), (1, 1), (4, 1)]
