"""Quality rules with an n-gram perplexity verdict (op5).

The language model is a modified Kneser-Ney model of order 5 over code points (see `ngrams`): its counts are summed by
Spark over all documents, each language apart, in a table that grows with the corpus.

A document's cost is its mean bits a symbol. For each language the bits of all documents that pass the base rules form a
histogram; the band runs from LOW spreads under the median to HIGH spreads above it, a spread being the distance from the
median to the upper (lower) quartile, at least HIGH_FLOOR (FLOOR) bits. Documents outside their language's band are rejected.

Sums are of integers (logarithms in 1/1024 bit), so results don't depend on partitions or order. A filtering stage reads
each text twice: once to count, once to score; the scored rows are written and both the bands and the verdict read those.

Defined results: a null or empty text has no words and fails the base rules. A null language is a language of its own.
Repeated rows count as often as they occur. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dossier.llm import kernel as K, ngrams
from dossier.llm.common import cut, lean, ship, table

#: Histogram bins: this many to a bit.
BINS = 1024
#: Six spreads are four standard deviations of a normal distribution. Least spreads above and below the median, in bits.
HIGH, LOW, HIGH_FLOOR, FLOOR = 6.0, 4.0, 0.01, 0.05
MIN_WORDS = 50

MARK = np.zeros(256, bool)
MARK[[*b"#*$%&|<>"]] = True

BASE_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_features(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    words, _, _, first = K.word_hashes(data, at)
    rows = len(at) - 1
    n_words = np.diff(first)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[at[1:]] - total[at[:-1]]

    word_chars = per_row(((data & 0xC0) != 0x80) & ~K.SPACE[data])
    n_symbols = per_row(MARK[data])

    # lines: from a row's start or a line feed to the next line feed or the row's end
    feeds = np.flatnonzero(data == 10)
    owner = np.searchsorted(at, feeds, "right") - 1
    start = np.concatenate([at[:-1], feeds + 1])
    end = np.concatenate([feeds, at[1:]])
    order = np.lexsort((start, np.concatenate([np.arange(rows), owner])))
    start, line_row = start[order], np.concatenate([np.arange(rows), owner])[order]
    end = end[np.lexsort((end, np.concatenate([owner, np.arange(rows)])))]
    solid = np.concatenate([[0], np.cumsum(~K.SPACE[data])])
    has = solid[end] > solid[start]
    start, end, line_row = start[has], end[has], line_row[has]
    key = K.mix(K.span_hashes(data, start, end) + line_row.astype(np.uint64) * K.U(0x9E3779B97F4A7C15))
    _, back = np.unique(key, return_index=True)
    n_lines = np.bincount(line_row, minlength=rows)
    n_dup_lines = n_lines - np.bincount(line_row[back], minlength=rows)

    grams = K.shingle_hashes(words, 3)
    row = np.repeat(np.arange(rows), n_words)
    covered = np.zeros(len(words), bool)
    if len(grams):
        where = np.flatnonzero(row[: len(grams)] == row[2:])
        keys = K.mix(grams[where] + row[where].astype(np.uint64) * K.U(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = where[twice]
        for k in range(3):
            covered[hit + k] = True
    n_repeat = np.bincount(row[covered], minlength=rows)
    return [x.astype(np.int64) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)]


def score(docs: DataFrame, model: ngrams.Model, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """`keep` columns, the base figures, base_failed, and the bin (1/1024 bit) of the mean cost of a symbol; null without symbols."""
    rows = docs.select(*keep, F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    return _scored(rows, model, keep, lambda batch: batch)


def score_rows(docs: DataFrame, model: ngrams.Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """As `score`, for whole rows: __row has all columns of `docs`, so a text crosses to Python once."""
    places = [docs.columns.index(c) for c in (text, lang)]

    def apart(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(0).field(i) for i in places)], ["__row", "__text", "__lang"])

    return _scored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")), model, ["__row"], apart)


def _scored(rows: DataFrame, model: ngrams.Model, keep: list[str], shaped) -> DataFrame:
    ship(rows.sparkSession)
    schema = T.StructType([*rows.select(*keep).schema, *T._parse_datatype_string(f"{BASE_FIELDS}, base_failed boolean, __bin long")])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for whole in batches for part in K.slices(shaped(whole), "__text"))
        for (batch, data, at), total, n in ngrams.symbol_costs(model, parts):
            base = base_features(data, at)
            failed = (base[0] < MIN_WORDS) | (100 * base[4] > 50 * base[0])
            bins = total * BINS // (np.maximum(n, 1) * ngrams.SCALE)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, base), pa.array(failed), pa.array(bins, mask=n == 0)], names)

    return rows.mapInArrow(lean(run), schema)


def bands(scored: DataFrame, lang: str = "lang", high: float = HIGH, low: float = LOW, floor: float = FLOOR, high_floor: float = HIGH_FLOOR) -> DataFrame:
    """(__lang_key, __least, __most) bins for each language, from the histogram of all rows that pass the base rules."""
    key = F.struct(F.col(lang).isNull().alias("none"), F.coalesce(F.col(lang), F.lit("")).alias("name"))
    hist = scored.filter(~F.col("base_failed") & F.col("__bin").isNotNull()).groupBy(key.alias("__lang_key"), "__bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("__lang_key")
    run = hist.withColumn("upto", F.sum("n").over(by.orderBy("__bin"))).withColumn("all", F.sum("n").over(by))
    at = run.groupBy("__lang_key").agg(*(F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("__bin"))).alias(f"q{k}") for k in (1, 2, 3)))
    least = F.col("q2") - low * F.greatest(F.col("q2") - F.col("q1"), F.lit(floor * BINS))
    most = F.col("q2") + high * F.greatest(F.col("q3") - F.col("q2"), F.lit(high_floor * BINS))
    return at.select("__lang_key", least.alias("__least"), most.alias("__most"))


def judge(scored: DataFrame, band: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds kept and bits_per_symbol; `scored` has the base columns, __bin and the language."""
    key = F.struct(F.col(lang).isNull().alias("none"), F.coalesce(F.col(lang), F.lit("")).alias("name"))
    inside = F.coalesce(F.col("__bin").between(F.col("__least"), F.col("__most")), F.lit(False))
    joined = scored.withColumn("__key", key).join(band, F.col("__key") == F.col("__lang_key"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).withColumn("bits_per_symbol", F.col("__bin") / BINS).drop("__key", "__lang_key", "__least", "__most", "__bin")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and bits_per_symbol of every document."""
    docs = docs.select("doc_id", "text", "lang")
    model = ngrams.fit(docs)
    scored = cut(score(docs, model, ["doc_id", "lang"]), "quality")
    model.close()
    return judge(scored, cut(bands(scored), "quality-bands")).drop("lang")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = ngrams.fit(docs.select("text", "lang"))
    scored = cut(score_rows(docs, model), "quality-rows")
    model.close()
    judged = judge(scored.select("*", F.col("__row.lang").alias("__lang")), cut(bands(scored.select(F.col("__row.lang").alias("__lang"), "base_failed", "__bin"), "__lang"), "quality-bands"), "__lang")
    return judged.filter("kept").select("__row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
