"""Columns of clashing names, very long texts and long conversations."""

import random

import pytest
from pyspark.sql import functions as F

from cantora.llm import chat, minhash, packing, toxicity, wordpiece

DOCS = "doc_id long, text string"


def long_text(seed, n, size=3_000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_toxicity_with_columns_of_its_own_names(spark):
    rows = [(i, "you are a vile zonk and I will hurt you" if i % 3 == 0 else "the garden was calm and green today") for i in range(90)] + [(200, "x " * 150_000), (201, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int").withColumn("score", F.lit("s"))
    docs = spark.createDataFrame(rows, DOCS)
    one = sorted(tuple(r) for r in toxicity.score_toxicity(docs, labels).collect())
    clash = docs.withColumns({"score": F.lit("a"), "predicted": F.lit(5), "held_out": F.lit("b"), "clauses": F.lit(1), "toxic": F.lit(1)})
    assert sorted(tuple(r) for r in toxicity.score_toxicity(clash, labels).collect()) == one and len(one) == len(rows)


def test_counts_of_a_very_long_text(spark):
    import public_tokenizers

    text = long_text(1, 300_000)
    docs = spark.createDataFrame([(1, text), (2, "a b"), (3, "ab" * 200_000)], DOCS).withColumns({"n_words": F.lit("x"), "n_tokens": F.lit(0), "longest": F.lit(None).cast("int")})
    got = {r["doc_id"]: r for r in wordpiece.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got[1]["n_words"] == 300_000 and got[1]["n_tokens"] >= 300_000 and (got[2]["n_words"], got[3]["n_words"]) == (2, 1)


def test_packing_of_a_very_long_text(spark):
    pytest.importorskip("tokenizers")
    docs = spark.createDataFrame([(1, long_text(2, 60_000)), (2, "a"), (3, None)], DOCS).withColumns({"ids": F.lit("x"), "start": F.lit(0), "sequence_id": F.lit(0)})
    pieces = packing.pack(docs, packing.tokenizer_path()).collect()
    for i in (1, 2, 3):
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == i)
        end = 0
        for start, length, whole in mine:
            assert start == end
            end += length
        assert end == whole
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) > 60_000


def test_near_duplicates_of_very_long_texts(spark):
    text = long_text(3, 150_000)
    rows = [(1, text), (2, text + " and more"), (3, long_text(4, 150_000)), (4, text[: len(text) // 2])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_long_conversation(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k} [INST]") for k in range(600)] + [(8, 0, "assistant", "y" * 400_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"example": F.lit(1), "loss_start": F.lit("x")})
    found = chat.prefix_target_examples(turns)
    assert found.where("conv_id = 7").count() == 300
    last = found.where("conv_id = 7 and example = 300").select(chat.read_turns(F.col("formatted")).alias("turns")).first()["turns"]
    assert [tuple(t) for t in last] == [(r[2], r[3]) for r in rows[:600]]
    one = found.where("conv_id = 8").first()
    assert one["loss_length"] == 400_000
