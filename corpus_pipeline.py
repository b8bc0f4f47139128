"""From raw documents to token digests: quality, near-duplicates, benchmark passages, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns the columns of documents; the last returns what byte-level BPE makes of
the documents left: doc_id, n_tokens, ids_sha256, decoded_sha256.

Cases: a text that is null or without words is judged by its site, is no
near-duplicate, holds no passage and no secret, and ends as no tokens; doc_id null
stays null, and a component whose members have ids keeps one with an id; of rows
that are alike in all that counts one stays; rows that share a doc_id are each
judged by their text; an empty table gives an empty one; without labels of both
kinds no document is rejected; further columns, of whatever names, come through
all stages but the last as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import op2_quality, op3_bpe, op4_decontam, op6_secrets, op9_neardup
from quarry.llm.common import discard, table, written

STAGES = [
    ("quality classifier", op2_quality.stage),
    ("MinHash near-dedup", op9_neardup.stage),
    ("benchmark decontamination", op4_decontam.stage),
    ("secret scans", op6_secrets.stage),
    ("byte-level BPE", op3_bpe.stage),
]

#: The classifier is fitted and near-duplicates are found by hashing, so no SQL gives these rows; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's table is written to the shared folder and deleted once the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
