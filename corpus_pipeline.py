"""The corpus pipeline: quality classifier, line dedup, near-duplicates, mixing, packing.

Each stage reads what the one before it kept, and its decisions take effect: rejected documents, repeated lines
and near-duplicates are gone for the later stages, and the packed shards follow the mixed order. Its
classifier and its packing have no SQL, so it is tested against a brute-force version.
"""

from __future__ import annotations

from lexloom.llm import line_dedup, mixing, ngram_join, packing, quality
from lexloom.llm.common import discard, stage

STAGES = [
    ("quality_classifier", quality.stage_quality),
    ("line_dedup", line_dedup.stage_lines),
    ("ngram_jaccard_join", ngram_join.stage_near_duplicates),
    ("mix_sources", mixing.stage_mix),
    ("best_fit_packing", packing.stage_pack),
]

ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages over ``documents``, each written to the shared folder as Parquet and read by the next, after which it is deleted.

    Null texts and ids, repeated rows and ids, and extra columns pass as each stage states; an empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
