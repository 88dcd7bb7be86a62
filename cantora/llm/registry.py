"""Queries and SQL of the training-data operators."""

from cantora.llm import chat, decontamination, forest, licenses, lines, minhash, negatives, packing, passages, quality, runs, toxicity, wordpiece

MODULES = [chat, toxicity, packing, licenses, decontamination, wordpiece, minhash, lines, forest, quality, passages, negatives, runs]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
