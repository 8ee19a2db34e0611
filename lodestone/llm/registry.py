"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import bpe, chat, decontam, html, idplanes, linededup, quality, rollup, simhash, toxicity

MODULES = (chat, bpe, idplanes, rollup, html, decontam, simhash, quality, linededup, toxicity)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
