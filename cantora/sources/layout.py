"""Where results of a recording go below an output folder, and their export as files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind of result -> path below the output folder, by the recording's stem. Fixed values.
PATHS = {"notes": "midi/{}.mid", "chords": "midi/chords/{}_chords.mid", "chart": "midi/chords/{}_chords.txt", "phrases": "phrases/{}.mid", "audio": "audio/{}.wav"}


def stem(path: Column) -> Column:
    """A path's last part without its last suffix."""
    name = F.element_at(F.split(path, r"[/\\\\]"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def output_path(kind: str, stem: Column, root: str = "output") -> Column:
    return F.concat(F.lit(f"{root}/{PATHS[kind].split('{}')[0]}"), stem, F.lit(PATHS[kind].split("{}")[1]))


def numbered(files: DataFrame, name: str = "file_id", buckets: int = 4_096) -> DataFrame:
    """path and a number for each different path of files, from 0 on without gaps: the same for the same paths, and no two share one.

    Paths are numbered within buckets of their hash, and buckets by how many paths the ones before hold."""
    paths = files.select("path").distinct().withColumn("_bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    sizes = paths.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as buckets
    rows = paths.join(F.broadcast(sizes.select("_bucket", before.alias("_before"))), "_bucket")
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("path")) - 1
    return rows.select("path", (F.col("_before") + nth).cast("int").alias(name))


def export(files: DataFrame) -> DataFrame:
    """Writes rows (path, content) from the executors, to any file system that pyarrow knows by the path: path, bytes.

    A path is written whole or again, so a task that is repeated does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = fs.FileSystem.from_uri(quote(path, safe="/:@"))
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")
