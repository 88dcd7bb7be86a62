"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline
from cantora.llm import packing


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(14)) for _ in range(n))
    item = " ".join(f"q{rng.randrange(900)}" for _ in range(20))
    rows = [(i, text(4)) for i in range(60)]
    rows += [(100 + i, " ".join(["spam!!!"] * 40)) for i in range(20)]
    rows += [(200, rows[0][1]), (201, rows[1][1] + " end"), (202, f"{text(2)}\n{item}\n{text(2)}"), (203, None), (204, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows if i < 115], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        seen[name] = {r["doc_id"] for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
    assert set(range(60)) <= seen["quality"] and not seen["quality"] & set(range(100, 120))
    assert seen["quality"] == seen["lines"]
    assert seen["near_duplicates"] == seen["lines"] - {200, 201}
    assert seen["benchmark"] == seen["near_duplicates"] - {202} == seen["packing"]
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where(f"`sum(length)` > {packing.LENGTH}").count() == 0
    assert corpus_pipeline.run(spark, d).count() == docs.count() and corpus_pipeline.ORACLE_SQL is None


def test_edges(spark, tmp_path):
    """An empty table; null ids and texts, repeats and clashing columns."""
    d = str(tmp_path)
    kinds = "doc_id long, text string, node string, quality int, _quality double, h1 long"
    text = " ".join(f"word{chr(97 + k % 26)}" for k in range(60))
    rows = [(None, text + " one two three", "a", 1, 0.5, 7), (None, None, "b", None, None, None), (1, text, "c", 0, 0.1, 8), (1, text, "c", 0, 0.1, 8), (2, "", None, 1, 0.2, 9), (3, "other words " * 9, "z", 2, 0.3, 1)]
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, given in (("none", []), ("some", rows)):
        docs = spark.createDataFrame(given, kinds)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, d).write.parquet(f"{d}/{name}{k}")
            columns, docs = docs.columns, spark.read.parquet(f"{d}/{name}{k}")
            assert k == 4 or docs.columns == columns
            if k == 2:
                assert docs.where("doc_id = 1").count() <= 1
        assert (docs.count() == 0) == (name == "none")


def test_scratches_of_other_threads_stay(spark):
    from concurrent.futures import ThreadPoolExecutor

    from cantora.llm.common import Scratch

    with Scratch.scope():
        mine = Scratch(spark).keep(spark.range(3), "mine")
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(lambda: Scratch(spark).keep(spark.range(5), "other")).result()
        assert mine.count() == 3
    assert other.count() == 5 and not spark._jvm.java.io.File(mine._cantora_path.removeprefix("file:")).exists()
