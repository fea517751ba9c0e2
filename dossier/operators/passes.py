"""Arrow passes: what plain functions make of texts, as rows of spans or as parts of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from dossier.config import Config
from dossier.operators.plain import Span, cleaner
from dossier.schema import EDUCATION, EXPERIENCE

#: Rows of texts in a batch, and of spans in a batch that is given back. Texts may be long.
TEXTS, ROWS = 512, 1 << 16
_TEXTS = lambda *names: pa.struct([(n, pa.string()) for n in names])
_PARTS = {
    "personal": _TEXTS("name", "email", "phone", "location"), "experience": pa.list_(_TEXTS("title", "company", "start_date", "end_date")), "education": pa.list_(_TEXTS("degree", "field", "institution")),
    "skills": pa.list_(pa.string()), "certifications": pa.list_(pa.string()), "experience_years": pa.int32(),
}
_ROW = (("label", pa.string()), ("text", pa.string()), ("start_off", pa.int32()), ("end_off", pa.int32()))

#: Made once for each task: from a text to its spans, of which those whose text is null are left out of rows.
Maker = Callable[[], Callable[[str], list[Span]]]


def _short_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS))


def _batch(ids: pa.Array, at: list[int], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *columns], names=["doc_id", *names])


def span_rows(df: DataFrame, maker: Maker) -> DataFrame:
    """doc_id, pos, label, text, start_off, end_off of the spans that are made of `text`; null texts have none."""
    names = ["pos", *(n for n, _ in _ROW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            ids, rows, at, pos = batch.column("doc_id"), [], [], []

            def columns() -> list[pa.Array]:
                return [pa.array(pos, pa.int32()), *(pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), _ROW, strict=False))]  # noqa: B023

            for i, text in enumerate(batch.column("text")):
                made = make(text.as_py()) if text.is_valid else ()
                for p, s in enumerate(made):
                    if s[1] is not None:
                        rows.append(s)
                        at.append(i)
                        pos.append(p)
                        if len(rows) >= ROWS:
                            yield _batch(ids, at, columns(), names)
                            rows, at, pos = [], [], []
            if rows:
                yield _batch(ids, at, columns(), names)

    _short_batches(df)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pos int, label string, text string, start_off int, end_off int")


def with_parts(df: DataFrame, maker: Callable[[], Callable[[str, str], dict | None]]) -> DataFrame:
    """Adds the parts of a record that are made of `text` and `raw_text`; `text` goes, and so do rows of null texts and those for
    which None is made."""
    rest = [f for f in df.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            made = [make(x, y) if x is not None else None for x, y in zip(batch.column("text").to_pylist(), batch.column("raw_text").to_pylist(), strict=True)]
            kept = batch.filter(pa.array([m is not None for m in made], pa.bool_())).select(names)
            parts = [pa.array([m[n] for m in made if m is not None], kind) for n, kind in _PARTS.items()]
            yield pa.RecordBatch.from_arrays([*kept.columns, *parts], names=[*names, *_PARTS])

    names = [f.name for f in rest]
    _short_batches(df)
    parts = f"personal struct<name:string,email:string,phone:string,location:string>, experience array<{EXPERIENCE}>, education array<{EDUCATION}>, skills array<string>, certifications array<string>, experience_years int"
    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), parts]))


def clean_rows(df: DataFrame, config: Config) -> DataFrame:
    """Rows of spans with their texts cleaned, without those that aren't entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = cleaner(config)
        at = df_names.index("text")
        for batch in batches:
            texts = pa.array([clean(a, b) for a, b in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=df_names).filter(texts.is_valid())

    df_names = df.columns
    return df.mapInArrow(run, df.schema)
