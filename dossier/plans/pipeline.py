"""The whole extraction as one plan: raw text and tokens in, records out. One narrow stage, no shuffle.

Steps are settled one by one (see `settle`), so each is evaluated once and a filter on records is planned as fast as the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.config import Config
from dossier.functions.arrays import settle
from dossier.functions.jsre import some
from dossier.functions.text import clean_spaces, normalize
from dossier.operators import assemble, infer
from dossier.operators.chunk import Count, Counter, chunk_texts, chunks, rebase
from dossier.operators.score import score
from dossier.operators.sections import fill_missing
from dossier.operators.spans import clean_spans, merge_subwords, post_process
from dossier.operators.tagging import as_token, once
from dossier.schema import TOKENS

#: Makes, once in each Python worker, a function from a text to its tokens (dicts of entity, word, start, end, score).
TaggerFactory = Callable[[], Callable[[str], list[dict[str, Any]]]]


def with_text(df: DataFrame, config: Config) -> DataFrame:
    """Adds `text`, the normalised raw_text."""
    return df.withColumn("text", normalize(F.col("raw_text"), config))


def tag(df: DataFrame, factory: TaggerFactory, chunk_column: str = "chunks") -> DataFrame:
    """Adds `tokens`, for each chunk an array of tokens; the only step that leaves the JVM."""
    kind, key = f"array<{TOKENS}>", hashlib.sha256(cloudpickle.dumps(factory)).digest()
    names = [x.strip().split(":")[0] for x in TOKENS[len("array<struct<") : -2].split(",")]

    @F.pandas_udf(kind)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = once(key, factory)
        for batch in series:
            yield pd.Series([[[as_token(t, names) for t in tagger(c["text"])] for c in (row if row is not None else [])] for row in batch])

    return df.withColumn("tokens", run(F.col(chunk_column)))


def spans_of(chunk_array: Column, tokens: Column) -> Column:
    """Spans of all chunks in document positions."""
    return F.flatten(F.zip_with(chunk_array, tokens, lambda c, t: rebase(merge_subwords(F.coalesce(t, F.array().cast(TOKENS))), c["offset"])))


def records(df: DataFrame, config: Config, as_of: Column | None = None, with_score: bool = True) -> DataFrame:
    """Records from `raw_text`, `text` and cleaned, post-processed `spans`; other columns stay in front."""
    rest = [c for c in df.columns if c not in ("raw_text", "text", "spans", "chunks", "tokens")]
    filled = settle(df.select(*rest, "raw_text", fill_missing(F.col("text"), F.col("spans")).alias("spans")))
    spans = F.col("spans")
    found = assemble.personal(spans, config)
    parts = settle(filled.select(
        *rest, "raw_text", found.withField("name", clean_spaces(found["name"], config)).alias("personal"), assemble.experience(spans, config).alias("experience"),
        assemble.education(spans, config).alias("education"), F.transform(assemble.skills(spans, config), lambda x: clean_spaces(x, config)).alias("skills"),
        assemble.certifications(spans, config).alias("certifications")))
    years = settle(parts.withColumn("experience_years", infer.experience_years(F.col("experience"), config, F.current_date() if as_of is None else as_of)))
    return inferred(years, config, with_score)


def inferred(years: DataFrame, config: Config, with_score: bool = True) -> DataFrame:
    """Records of their assembled parts and years: seniority, country and score added."""
    out = settle(years.withColumn("seniority", infer.seniority(F.col("experience"), F.col("experience_years"), config)).withColumn("country", infer.country(F.col("personal.location"), F.col("personal.phone"), config)))
    if with_score:
        out = settle(out.withColumn("ats", score(F.col("personal"), F.col("experience"), F.col("education"), F.col("skills"), F.col("certifications"), F.col("experience_years"), F.col("raw_text"))))
    return out


def plain_tokens(df: DataFrame, column: str = "tokens") -> Column:
    """A token column of the usual type; a grouped label counts before a plain one where tokens have both."""
    fields = df.schema[column].dataType.elementType.names
    wanted = [x.strip().split(":")[0] for x in TOKENS[len("array<struct<") : -2].split(",")]

    def one(t: Column) -> Column:
        label = F.coalesce(*(some(t[f]) for f in ("entity_group", "entity") if f in fields))
        return F.struct(*((label if f == "entity" else t[f]).alias(f) for f in wanted))

    return F.transform(F.col(column), one).cast(TOKENS)


def parse(df: DataFrame, config: Config, tagger: TaggerFactory | None = None, count: Count | Counter | None = None, as_of: Column | None = None) -> DataFrame:
    """Records of documents (raw_text and any key columns). Tokens come from `tagger`, or from a `tokens` column
    (array of tokens in positions of the normalised text) where there is none."""
    text = settle(with_text(df, config))
    if tagger is not None:
        packed = chunk_texts(F.col("text"), count) if isinstance(count, Counter) else chunks(F.col("text"), count)
        found = tag(settle(text.withColumn("chunks", packed)), tagger)
        spanned = settle(found.withColumn("spans", spans_of(F.col("chunks"), F.col("tokens"))))
    else:
        spanned = settle(text.withColumn("spans", merge_subwords(plain_tokens(text))))
    return records(processed(spanned, config), config, as_of)


def processed(df: DataFrame, config: Config) -> DataFrame:
    """The spans cleaned, then merged, relabelled, stripped, split and paired."""
    cleaned = settle(df.withColumn("spans", clean_spans(F.col("spans"), config)))
    return settle(cleaned.withColumn("spans", post_process(F.col("spans"), config)))
