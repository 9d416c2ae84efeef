"""The named queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldgrain.llm.byte_bpe import op7_bpe_round_trip
from fieldgrain.llm.divergence import op13_source_divergence
from fieldgrain.llm.fingerprints import op1_fingerprints
from fieldgrain.llm.language import op5_language_id
from fieldgrain.llm.licenses import op4_license_scan
from fieldgrain.llm.merkle import op12_merkle_manifest
from fieldgrain.llm.mixing import op9_mix_sources
from fieldgrain.llm.near_dups import op10_near_duplicates
from fieldgrain.llm.quality import op6_quality_rules
from fieldgrain.llm.repeats import op2_repeated_passages
from fieldgrain.llm.sqltext import DIVERGENCE_SQL, MERKLE_SQL
from fieldgrain.llm.token_counts import op8_token_counts
from fieldgrain.llm.toxicity import op11_toxicity
from fieldgrain.llm.training_order import op3_training_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_repeated_passages,
        op3_training_order,
        op4_license_scan,
        op5_language_id,
        op6_quality_rules,
        op7_bpe_round_trip,
        op8_token_counts,
        op9_mix_sources,
        op10_near_duplicates,
        op11_toxicity,
        op12_merkle_manifest,
        op13_source_divergence,
    )
}

#: Hashing, models and vocabularies are beyond SQL here; tests/llm holds these queries against brute force.
#: Two of these operators are plain arithmetic on words and hashes.
SQL: dict[str, str] = {"op12_merkle_manifest": MERKLE_SQL, "op13_source_divergence": DIVERGENCE_SQL}
