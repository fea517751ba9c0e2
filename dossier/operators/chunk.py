"""Texts to windows of a token limit: paragraphs packed in order, an oversized one split at sentences.

A count that is a Column function (by characters, say) stays in the JVM. A tokenizer can't be called inside a fold, so with a
`Counter` the same packing runs in an Arrow pass, on real counts of every joined candidate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.jsre import SPACES, WS, trim
from dossier.operators.spans import empty
from dossier.schema import CHUNKS

LIMIT = 512
Count = Callable[[Column], Column]


def by_chars(per_token: float) -> Count:
    return lambda text: F.ceil(F.length(text) / per_token)


def _chunk(text: Column, offset: Column) -> Column:
    return F.struct(text.alias("text"), offset.cast("int").alias("offset"))


def _from(text: Column, part: Column, at: Column) -> Column:
    """Where `part` first occurs at or after `at`, from 0; -1 if it doesn't."""
    return F.position(part, text, at + 1) - 1


def split_sentences(section: Column, offset: Column, count: Count, limit: int = LIMIT) -> Column:
    """Sentences of one section packed greedily; a sentence beyond the limit is a chunk of its own."""
    none = F.lit(None).cast("string")

    def step(s: Column, sentence: Column) -> Column:
        both = F.when(s["now"].isNull(), sentence).otherwise(F.concat(s["now"], F.lit(" "), sentence))
        turn = (count(both) > limit) & s["now"].isNotNull()
        return F.struct(
            F.when(turn, F.array_append(s["out"], _chunk(s["now"], s["at"]))).otherwise(s["out"]).alias("out"),
            F.when(turn, sentence).otherwise(both).alias("now"), F.when(turn, s["at"] + F.length(s["now"]) + 1).otherwise(s["at"]).cast("int").alias("at"))

    start = F.struct(empty(CHUNKS).alias("out"), none.alias("now"), offset.cast("int").alias("at"))
    return F.aggregate(F.split(section, rf"(?<=\.){WS}+"), start, step, lambda s: F.when(s["now"].isNull(), s["out"]).otherwise(F.array_append(s["out"], _chunk(s["now"], s["at"]))))


def chunks(text: Column, count: Count | None, limit: int = LIMIT) -> Column:
    """array<struct<text, offset>>. A section beyond the limit is split only if nothing is packed yet; otherwise it is
    packed alone and comes out whole. Offsets are looked up from the last chunk's on."""
    whole = F.array(_chunk(text, F.lit(0)))
    if count is None:
        return whole
    none = F.lit(None).cast("string")

    def step(s: Column, section: Column) -> Column:
        free = s["now"].isNull()
        both = F.when(free, section).otherwise(F.concat(s["now"], F.lit("\n\n"), section))
        over = count(both) > limit
        here = _from(text, section, s["at"])
        state = lambda out, now, at: F.struct(out.alias("out"), now.alias("now"), at.cast("int").alias("at"))
        return (
            F.when(over & ~free, state(F.array_append(s["out"], _chunk(s["now"], s["at"])), section, here))
            .when(over, state(F.concat(s["out"], split_sentences(section, here, count, limit)), none, here + F.length(section)))
            .otherwise(state(s["out"], both, F.when(free, here).otherwise(s["at"])))
        )

    sections = F.filter(F.split(text, r"\n{2,}"), lambda x: F.length(trim(x)) > 0)
    start = F.struct(empty(CHUNKS).alias("out"), none.alias("now"), F.lit(0).alias("at"))
    packed = F.aggregate(sections, start, step, lambda s: F.when(s["now"].isNull(), s["out"]).otherwise(F.array_append(s["out"], _chunk(s["now"], s["at"]))))
    return F.when(count(text) <= limit, whole).otherwise(packed)


def rebase(spans: Column, offset: Column) -> Column:
    """Spans of a chunk in the document's positions."""
    return F.transform(spans, lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset))


@dataclass(frozen=True)
class Counter:
    """Makes, on a worker, the function that counts a text's tokens."""

    factory: Callable[[], Callable[[str], int]]


def tokenizer(path: str) -> Counter:
    """Counts of a tokenizer file's tokens, without special ones."""

    def factory() -> Callable[[str], int]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda text: len(made.encode(text, add_special_tokens=False).ids)

    return Counter(factory)


_SENTENCE = re.compile(rf"(?<=\.)[{SPACES}]+")


def pack_sentences(section: str, offset: int, count: Callable[[str], int], limit: int) -> Iterator[tuple[str, int]]:
    now = None
    for sentence in _SENTENCE.split(section):
        both = sentence if now is None else f"{now} {sentence}"
        if now is not None and count(both) > limit:
            yield now, offset
            offset, now = offset + len(now) + 1, sentence
        else:
            now = both
    if now is not None:
        yield now, offset


def pack(text: str, count: Callable[[str], int], limit: int = LIMIT) -> list[tuple[str, int]]:
    """(text, offset) of a text's chunks, as `chunks` gives them."""
    if count(text) <= limit:
        return [(text, 0)]
    out: list[tuple[str, int]] = []
    now, at = None, 0
    for section in re.split(r"\n{2,}", text):
        if not section.strip(SPACES):
            continue
        here = text.find(section, at)
        both = section if now is None else f"{now}\n\n{section}"
        if count(both) <= limit:
            now, at = both, here if now is None else at
        elif now is not None:
            out.append((now, at))
            now, at = section, here
        else:
            out += pack_sentences(section, here, count, limit)
            at = here + len(section)
    return out if now is None else [*out, (now, at)]


def chunk_texts(text: Column, counter: Counter, limit: int = LIMIT) -> Column:
    """As `chunks`, with a tokenizer's counts; null texts have no chunks."""
    factory = counter.factory

    @F.pandas_udf(CHUNKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = factory()
        for texts in batches:
            yield pd.Series([None if x is None else [{"text": t, "offset": o} for t, o in pack(x, count, limit)] for x in texts])

    return run(text)
