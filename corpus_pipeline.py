"""The corpus pipeline; counts as part of gleanwork.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from gleanwork.llm.common import materialise, table
from gleanwork.llm.mixing import apply_mix
from gleanwork.llm.neardup import one_of_each
from gleanwork.llm.pieces import encode_stage
from gleanwork.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("mixing", apply_mix),
    ("pieces", encode_stage),
]
#: Trained models and sampling by hash: SQL can't express these stages; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
