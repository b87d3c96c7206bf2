"""Queries and SQL of this subpackage."""

from importlib import import_module

MODULES = ["token_counts", "byte_bpe", "packing", "simhash", "topk", "substring_dedup", "minhash", "line_dedup", "html_text", "language_id", "mixing", "whitening", "phrases"]
QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"recallspark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

from recallspark.llm import pipeline  # noqa: E402

QUERIES["pipeline"] = pipeline.run
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
