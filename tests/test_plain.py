"""The plain forms of operators and fixtures against their Column and SQL forms."""

import os

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as texts
from dossier.operators import assemble, infer, plain, plain_record, sections, spans
from dossier.plans import fixtures as fx
from dossier.plans.queries import QUERIES
from dossier.schema import SPANS, TOKENS

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

TEXTS = [
    None, "", " ", "a", "7", "é", "éa", "x1", "  a \tb ", ",.;:|/-", "-ab-", "a  b", "Borealis, NM", "NM", " ,OR", "le", "LE", "Cedar Labs", "ts", "TS", "Zig", "various", "Various", "MD", "md",
    "Mr. a@x.org", "mr.Mr. b@y.org", "--a @ b.org", "www.c@x.org", "MAILTO:a@x.org", "a@bc", "| May 2020 |", "2020", "ß@ß.de", "ẞẞẞẞ", "straße,", "a\nb\r\nc", "﻿ab c ", "İx", "x" * 200, "A.;:", "\x85ab\x1c",
]
LABELS = ["EMAIL", "SKILL", "COMPANY", "DATE", "TITLE", "CERT", "NAME", None]


def test_clean_entity_as_column_and_plain(spark):
    config = fx.settings(fx.COMPANIES + fx.SHORT_COMPANIES)
    df = spark.createDataFrame([(a, b) for a in LABELS for b in TEXTS], "label string, text string")
    clean = plain.cleaner(config)
    for _ in range(2):  # from the memo too
        for r in df.withColumn("out", spans.clean_entity(F.col("label"), F.col("text"), config)).collect():
            assert clean(r.label, r.text) == r.out, r


def _tokens(n: int) -> list[tuple]:
    words = ["##a", "b", "##", None, "c d", "", "Borealis", "##e", "data", "modeling", "May"]
    kinds = ["B-TITLE", "I-TITLE", "O", None, "", "COMPANY", "I-COMPANY", "B-SKILL", "I-SKILL", "I-", "B-O"]
    return [(kinds[(7 * n + i * i) % 11], words[(n + 3 * i) % 11], (None, 0, 5 * i)[(i + n) % 3], (None, 0, 5 * i + 3)[(i * n) % 3], (None, 0.5, 0.25 * (i % 4))[(n + i) % 3]) for i in range(n % 23)]


def test_spans_as_column_and_plain(spark):
    config = fx.settings()
    rows = [(n, _tokens(n)) for n in range(300)]
    df = spark.createDataFrame(rows, f"id int, tokens {TOKENS}").withColumn("merged", spans.merge_subwords(F.col("tokens")))
    df = df.withColumn("cleaned", spans.clean_spans(F.col("merged"), config)).withColumn("near", spans.merge_neighbours(F.col("cleaned"), config))
    clean = plain.cleaner(config)
    for r in df.select("id", "merged", "near").collect():
        merged = plain.merge_subwords(rows[r.id][1])
        assert merged == [list(s) for s in r.merged], rows[r.id]
        assert plain.merge_neighbours(plain.clean_spans(merged, clean), config) == [list(s) for s in r.near], rows[r.id]


def test_later_steps_as_column_and_plain(spark):
    config = fx.settings()
    texts = ["Borealis", "Cedar Labs North Expert Analyst", "Cedar x", "Borealis May 2020", "May", "May 2020 today", "a  may\t1999", "data", "modeling", "event", "sourcing.", "Sourcing,", "data", " cedar "]
    made = [[[("TITLE", "COMPANY", "SKILL", "SKILL")[(n + i) % 4], texts[(n * 5 + i * i) % 14], 9 * i, 9 * i + 7 + n % 3, "B", 0.25 * (i % 4)] for i in range(n % 13)] for n in range(200)]
    df = spark.createDataFrame([(n, [tuple(s) for s in x]) for n, x in enumerate(made)], f"id int, spans {SPANS}")
    steps = ("relabel_companies", "strip_dates", "split_titles", "pair_skills", "post_process")
    for r in df.select("id", *(getattr(spans, step)(F.col("spans"), config).alias(step) for step in steps)).collect():
        for step in steps:
            assert getattr(plain, step)(made[r.id], config) == [list(s) for s in r[step]], (step, made[r.id])


RAW = [
    "", "\r\n a \t\r\n\r b \u2028● x", "●\n ● — y  z\rTel:  Mail: xTel: q", "Core Tools a, b\n  c, d\nJava, Go,\nrest\nDatabases   x y\nE  a,b,,", "  Skills:\n- Go, Rust | K - L.\nDB: Postgres; x\nAREAS OF EXPERTISE\n",
    "LICENSES & Certifications:\n• AWS Architect\nab\nLanguages\nFrench Canadian (x)\nenglish\nSpanish", "Skills", "İSkills\nLanguage Skills \nÉ De\nGerman",
]


def test_texts_and_sections_as_column_and_plain(spark):
    config = fx.settings()
    there = [["DATE", "x", 4, 9, "B", 1.0], ["DATE", "y", 30, 31, "B", 1.0], ["DATE", "z", 4, 4, "B", 1.0]]
    df = spark.createDataFrame([(x, [tuple(s) for s in there]) for x in RAW], f"raw string, spans {SPANS}")
    for r in df.select("raw", texts.normalize(F.col("raw"), config).alias("text"), sections.fill_missing(F.col("raw"), F.col("spans")).alias("filled")).collect():
        assert plain_record.normalizer(config)(r.raw) == r.text, r.raw
        assert plain_record.fill_missing(r.raw, there) == [list(s) for s in r.filled], r.raw


def test_parts_as_column_and_plain(spark):
    config = fx.settings()
    said = ["Borealis", "Engineer with Cedar", "May 2020", "May", "2021 Present", "2019", "June 2001 today", "| |", "", "Dunes , NM", "Diplom ,", "Delta Institute, 2014", "the Forklift operator.", "type script, TS,abc", "ABC, data", "+49 ( 555 ) 1 - 2", "Mr. a@x.org", "Portland , OR ,", "x", "with"]
    kinds = ("TITLE", "COMPANY", "DATE", "DATE", "DEGREE", "FIELD", "INSTITUTION", "SKILL", "CERT", "NAME", "EMAIL", "PHONE", "LOCATION")
    made = [[[kinds[(n * 3 + i * (1 + n % 5)) % (4 if n % 2 else 13)], said[(n * 7 + i * i + i * (n % 3)) % 20], (17 * i * n) % 23, 99, "B", 1.0] for i in range(n % 17)] for n in range(300)]
    df = spark.createDataFrame([(n, [tuple(s) for s in x]) for n, x in enumerate(made)], f"id int, spans {SPANS}")
    s = F.col("spans")
    df = df.select("id", assemble.personal(s, config).alias("personal"), assemble.experience(s, config).alias("experience"), assemble.education(s, config).alias("education"), assemble.skills(s, config).alias("skills"), assemble.certifications(s, config).alias("certifications"))
    df = df.withColumn("personal", F.col("personal").withField("name", texts.clean_spaces(F.col("personal.name"), config))).withColumn("skills", F.transform("skills", lambda x: texts.clean_spaces(x, config)))
    assembled = plain_record.assembler(config, plain.cleaner(config), 2003 * 12)
    for r in df.localCheckpoint().withColumn("experience_years", infer.experience_years(F.col("experience"), config, F.lit("2003-01-01").cast("date"))).collect():
        want = {"personal": r.personal.asDict(), **{f: [tuple(x) for x in r[f]] for f in ("experience", "education")}, **{f: r[f] for f in ("skills", "certifications", "experience_years")}}
        assert assembled(made[r.id]) == want, made[r.id]


@needs_data
def test_fixture_rows_as_sql_and_otherwise(spark):
    rows = fx.frame(spark, DATA, fx.TOKENS_SQL).orderBy("doc_id", "pos").collect()
    want: dict = {}
    for r in rows:
        want.setdefault(r.doc_id, []).append((r.entity, r.word, r.start_off, r.end_off, r.score_pct / 100))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {k: list(fx.tokens(x)) for k, x in texts.items() if any(fx.tokens(x))} == want
    sql, own = fx.frame(spark, DATA, fx.SPANS_SQL), fx.span_rows(spark, DATA)
    assert own.columns == sql.columns and [f.dataType for f in own.schema] == [f.dataType for f in sql.schema]
    assert own.exceptAll(sql).isEmpty() and sql.exceptAll(own).isEmpty()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_data
def test_orders_are_numbered_once_in_clean_entity(spark):
    """One window for the orders and one for their spans, none for words; before, 16 of orders and spans and one of words."""
    assert _plan(QUERIES["clean_entity"](spark, DATA)).count("Window [") == 2


def _with_documents(spark, folder, rows) -> str:
    for table in ("orders", "customer"):
        os.symlink(f"{DATA}/{table}.parquet", f"{folder}/{table}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


ODD = [None, "", "  ", "Borealis\nof data ##x modeling 2020", "é ü " * 9, "word " * 300]


@needs_data
@pytest.mark.parametrize("name", ["clean_entity", "merge_neighbors", "parse_full"])
def test_documents_of_odd_texts_and_ids(spark, tmp_path, name):
    """One by one, as by the token fixture's SQL; documents that share an id go the way of the SQL."""
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    rows = [(None if i == 5 else i, x, "en", "s", 1) for i, x in enumerate(ODD)]
    once = QUERIES[name](spark, _with_documents(spark, tmp_path / "a", rows))
    twice = QUERIES[name](spark, _with_documents(spark, tmp_path / "b", [*rows, (9, "same", "en", "s", 1), (9, "id", "en", "s", 1)]))
    assert "MapInArrow" in _plan(once) and "Window [sum" in _plan(twice) and "Window [sum" not in _plan(once)
    found = once.exceptAll(twice)
    assert (found.filter("doc_id IS NOT NULL") if name == "parse_full" else found).isEmpty() and {r.doc_id for r in twice.exceptAll(once).collect()} == {9}
    assert once.schema.simpleString() == twice.schema.simpleString()
