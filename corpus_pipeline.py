"""The corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. A stage's call deletes the scratch tables of the stage before, so a result must
be written before the next stage is called, as `run` does.

Defined results of every stage: null and empty texts fail the quality rules, so later stages see none of them; by itself each
later stage keeps such rows (near duplicates, secret masks, tokens of nothing) or never takes them (mix, since they have no
words). Rows of null ids stay. Of rows that repeat an id and text the near-duplicate stage keeps one; the others treat each
row. Ties are broken by ids and hashes, so reruns agree. Empty tables give empty tables of the same columns, and extra columns,
whatever their names, go through all stages but the last, which keeps id and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import bpe, common, mixing, near, quality, secrets


@common.in_turn
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    return quality.keep_good(docs)


@common.in_turn
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (Jaccard of 5-word shingles at least 0.8) the document of the smallest id stays."""
    return near.drop_near_copies(docs, 5, 80)


@common.in_turn
def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets' values are masked, live-looking ones and widely copied examples by different marks; no document goes."""
    return secrets.mask(docs)


@common.in_turn
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


@common.in_turn
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of what they decode to."""
    return bpe.encode_decode(docs, bpe.tokenizer_path("byte_bpe_50k.json"), keep=("doc_id", "source"), with_ids=True).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_masks),
    ("source mix", source_mix),
    ("bpe", tokenize),
]

#: Perplexity bands, Jaccard components and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each one's result written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
