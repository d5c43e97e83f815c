"""A corpus pipeline: documents in, encoded training documents out.

Each stage's result is written to the shared folder that the session names in ``spark.checkpoint.dir`` and read again, so no stage is
evaluated twice and a lost executor costs no more than the stage that runs.

Defined results, those of the stages: rows with null or blank text are rejected by the first stage (rule ``empty``), and so are rows that a learned rule
covers; of rows that are near duplicates one stays (the least doc_id, of equal ones any); rows with null doc_id are never
duplicates; null sources are a source of their own; very long texts are worked on whole. An empty table gives an empty table. Columns of the documents are kept
in their order, clashing names included, but for ``token_ids`` and ``n_tokens``, which the last stage replaces, adding ``decoded``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernlake.llm import bpe_codec, entropy_mix, quality_rules, secret_scan, simhash_dedup
from fernlake.llm.common import table, written

#: (name, function of (spark, docs, sf_dir)). Each works on all rows its predecessor kept; all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality_rules.stage),
    ("SimHash near-dedup", simhash_dedup.stage),
    ("secret scans", secret_scan.stage),
    ("mixing sources", entropy_mix.stage),
    ("byte-level BPE", bpe_codec.stage),
]

#: The stages learn, sketch and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
