"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.bpe import op3_bpe_round_trip
from dossier.llm.jpeg import op7_baseline_jpeg
from dossier.llm import licenses, secrets
from dossier.llm.licenses import op10_license_digests
from dossier.llm.mixing import op1_mix_sources
from dossier.llm.near import op4_jaccard_join
from dossier.llm.quality import op5_quality_rules
from dossier.llm.secrets import op6_secret_owners
from dossier.llm.sharding import op8_minimax_shards
from dossier.llm.token_counts import op2_token_counts
from dossier.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_owners": op6_secret_owners,
    "op7_baseline_jpeg": op7_baseline_jpeg,
    "op8_minimax_shards": op8_minimax_shards,
    "op9_toxicity": op9_toxicity,
    "op10_license_digests": op10_license_digests,
}

#: The flow of op1 is beyond SQL; the tests hold it against enumeration and its rows against the contract.
ORACLES: dict[str, str] = {"op6_secret_owners": secrets.SQL, "op10_license_digests": licenses.sql()}
