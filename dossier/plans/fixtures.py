"""Derived input of the registered queries: résumé-like rows made from the star schema and documents.

The statements are the same for both engines but for the marked places. They read whole tables and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.config import Config, from_dict

TOKENS_SQL = r"""
WITH w AS (SELECT doc_id, pos, word FROM ({EXPL}) x),
o AS (SELECT doc_id, pos, word,
  CAST(coalesce(sum(length(word)+1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS INT) AS s FROM w),
l AS (SELECT *, CASE length(word)%12 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'TITLE' WHEN 2 THEN 'COMPANY' WHEN 3 THEN 'SKILL' WHEN 4 THEN 'DATE' WHEN 5 THEN 'EMAIL'
   WHEN 6 THEN 'O' WHEN 7 THEN 'DEGREE' WHEN 8 THEN 'FIELD' WHEN 9 THEN 'INSTITUTION' WHEN 10 THEN 'NAME' ELSE 'PHONE' END AS lab FROM o WHERE word <> '')
SELECT doc_id, CAST(pos AS INT) AS pos,
  CASE WHEN lab='O' THEN 'O' WHEN pos%3=1 THEN concat('I-',lab) WHEN pos%11=5 THEN lab ELSE concat('B-',lab) END AS entity,
  CASE WHEN pos%7=3 THEN concat('##',word) WHEN lab='EMAIL' THEN concat(word,'@x.org') WHEN lab='LOCATION' THEN concat(word,', OR') WHEN lab='DATE' AND pos%2=0 THEN concat('June ',CAST(1990+pos%30 AS STRING))
   WHEN lab='DATE' THEN 'Present' ELSE word END AS word,
  s AS start_off, CAST(s+length(word) AS INT) AS end_off, CAST((pos%10)+90 AS INT) AS score_pct
FROM l
"""

#: The labels of TOKENS_SQL by the words' length modulo 12.
TOKEN_LABELS = ("LOCATION", "TITLE", "COMPANY", "SKILL", "DATE", "EMAIL", "O", "DEGREE", "FIELD", "INSTITUTION", "NAME", "PHONE")

EXPERIENCE_SQL = r"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_custkey AS doc_id, CAST(rn AS INT) AS rn,
 CASE WHEN o_orderkey%9=0 THEN NULL WHEN o_orderpriority LIKE '1%' THEN 'Senior Engineer' WHEN o_orderpriority LIKE '2%' THEN 'Staff Engineer with Borealis'
  WHEN o_orderpriority LIKE '3%' THEN 'Widths Expert with Cedar' WHEN o_orderpriority LIKE '4%' THEN 'Trainee' ELSE 'Analyst' END AS title,
 CASE WHEN o_orderkey%5=0 THEN NULL WHEN o_orderkey%2=0 THEN 'Borealis' ELSE 'Cedar' END AS company,
 CASE WHEN o_orderkey%7=0 THEN NULL WHEN o_orderkey%7=1 THEN CAST(extract(year FROM o_orderdate) AS STRING)
  ELSE concat(CASE CAST(extract(month FROM o_orderdate) AS INT) WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'August' WHEN 9 THEN 'Sept' WHEN 10 THEN 'October' WHEN 11 THEN 'Nov' ELSE 'December' END,' ',CAST(extract(year FROM o_orderdate) AS STRING)) END AS start_date,
 CASE WHEN o_orderkey%4=0 THEN 'Present' WHEN o_orderkey%4=1 THEN NULL ELSE concat('June ',CAST(extract(year FROM o_orderdate)+1+o_orderkey%3 AS STRING)) END AS end_date
FROM o WHERE o_custkey%5 <> 0
"""

PERSON_SQL = r"""
SELECT c_custkey AS doc_id,
 CASE WHEN c_custkey%11=0 THEN NULL ELSE replace(c_name,'Customer#','Candidate ') END AS name,
 CASE WHEN c_custkey%7=0 THEN NULL ELSE concat('c',CAST(c_custkey AS STRING),'@example.com') END AS email,
 CASE WHEN c_custkey%3=0 THEN NULL WHEN c_custkey%3=1 THEN '+49 ( 555 ) 123 - 4567' ELSE '+ 1 555 123 4567' END AS phone,
 CASE WHEN c_nationkey%5=0 THEN 'Portland , OR' WHEN c_nationkey%5=1 THEN 'Deutschland' WHEN c_nationkey%5=2 THEN 'Remote, NM' WHEN c_nationkey%5=3 THEN 'Unknown' ELSE NULL END AS location,
 CAST(c_custkey%14 AS INT) AS skill_n, CAST(c_custkey%2 AS INT) AS cert_n,
 CASE WHEN c_custkey%4=0 THEN 'Increased revenue by 40%' WHEN c_custkey%4=1 THEN 'Led 12 engineers' WHEN c_custkey%4=2 THEN 'Built tools' ELSE concat('Saved $',CAST(c_custkey AS STRING),'K') END AS raw_text
FROM customer
"""

TEXT_SQL = r"""
SELECT doc_id, concat_ws('{NL}', concat('Mail: c',CAST(doc_id AS STRING),'@example.com{CR}'), concat('Tel: +1 555 ',CAST(1000+doc_id AS STRING),'   '),
 concat('{B} Built  platform {D} ', text), '',
 CASE WHEN doc_id%3=0 THEN 'Core Tools Flink,  Node.js' WHEN doc_id%3=1 THEN 'Skills:' ELSE 'Areas of Expertise' END,
 concat('Languages: Python, Go, ', source), 'AWS | Docker - Kafka', 'Certifications', '- AWS Solutions Architect', 'LANGUAGES', 'English (Native)', 'Spanish') AS raw_text
FROM documents
"""

SPANS_SQL = r"""
WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderdate AS dt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
e AS (SELECT d, k, rn, extract(year FROM dt) AS y FROM o),
spans AS (
 SELECT d, rn*100+10 AS st, 'TITLE' AS label, CASE WHEN k%6=0 THEN 'Borealis' WHEN k%6=1 THEN 'Borealis Engineer' WHEN k%6=2 THEN 'Cedar Labs North Expert Analyst' WHEN k%6=3 THEN 'Staff Engineer with Borealis' WHEN k%6=4 THEN 'Widths Expert with Cedar' ELSE 'Analyst' END AS txt FROM e WHERE k%4<>0
 UNION ALL SELECT d, rn*100+40, 'COMPANY', CASE WHEN k%5=0 THEN 'Borealis May 2020' WHEN k%5=1 THEN 'Dunes , NM' WHEN k%5=2 THEN 'Ember' ELSE 'Cedar' END FROM e WHERE k%3<>0
 UNION ALL SELECT d, rn*100+60, 'DATE', CASE WHEN k%5=0 THEN 'May' WHEN k%5=1 THEN concat('June ',CAST(y AS STRING),' Present') ELSE concat('May ',CAST(y AS STRING)) END FROM e WHERE k%7<>0
 UNION ALL SELECT d, rn*100+75, 'DATE', CASE WHEN k%5=0 THEN concat(CAST(y AS STRING),' Present') WHEN k%2=0 THEN 'Today' ELSE CAST(y+2 AS STRING) END FROM e WHERE k%3<>1
 UNION ALL SELECT d, 1000+rn*50+5, 'DEGREE', CASE WHEN k%2=0 THEN 'Diplom' ELSE 'Lizenziat' END FROM e WHERE k%3<>0
 UNION ALL SELECT d, 1000+rn*50+15, 'FIELD', 'Geodesy' FROM e WHERE k%2=0
 UNION ALL SELECT d, 1000+rn*50+35, 'INSTITUTION', CASE WHEN k%2=0 THEN 'Delta Institute, 2014' ELSE 'Sigma College' END FROM e WHERE k%4<>1
 UNION ALL SELECT d, 2000+rn*20, 'SKILL', CASE WHEN (d+rn)%7=0 THEN 'data' WHEN (d+rn)%7=1 THEN 'modeling' WHEN (d+rn)%7=2 THEN 'type script' WHEN (d+rn)%7=3 THEN 'ts' WHEN (d+rn)%7=4 THEN 'Zig' WHEN (d+rn)%7=5 THEN 'abc' ELSE 'Kafka, data, AWS' END FROM e
 UNION ALL SELECT d, 3000+rn*40, 'CERT', CASE WHEN k%3=0 THEN 'The Forklift Operator' WHEN k%3=1 THEN 'forklift operator' ELSE 'AWS Architect' END FROM e WHERE k%2=0
 UNION ALL SELECT d, 0, 'NAME', 'Noor Vale' FROM e WHERE rn=1 AND d%3<>0
 UNION ALL SELECT d, 1, 'NAME', 'Second Name' FROM e WHERE rn=1
 UNION ALL SELECT d, 2, 'EMAIL', 'not-an-email' FROM e WHERE rn=1 AND d%2=0
 UNION ALL SELECT d, 3, 'EMAIL', CASE WHEN d%7=0 THEN concat('www.c',CAST(d AS STRING),'@x.org') ELSE concat('Mr. c',CAST(d AS STRING),'@x.org') END FROM e WHERE rn=1 AND d%5<>0
 UNION ALL SELECT d, 4, 'PHONE', '+49 ( 555 ) 123 - 4567' FROM e WHERE rn=1 AND d%4<>0
 UNION ALL SELECT d, 5, 'LOCATION', 'Portland , OR ,' FROM e WHERE rn=1 AND d%6<>0)
SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY st, label) AS INT) AS pos, label, txt AS text,
 CAST(st AS INT) AS start_off, CAST(st+length(txt) AS INT) AS end_off, 'B' AS bio, 100 AS score_pct FROM spans
"""

PARAGRAPHS_SQL = r"SELECT doc_id, replace(text, {NL}, concat({NL}, {NL})) AS text FROM documents"

#: Splitting texts into words with positions, for each engine.
WORDS = {
    "spark": "SELECT doc_id, pos, word FROM documents LATERAL VIEW posexplode(split(text,' ')) t AS pos, word",
    "duckdb": "SELECT doc_id, pos-1 AS pos, word FROM (SELECT doc_id, unnest(string_split(text,' ')) AS word, generate_subscripts(string_split(text,' '),1) AS pos FROM documents)",
}


def _filled(sql: str, engine: str) -> str:
    sql = sql.replace("{EXPL}", WORDS[engine])
    if engine == "spark":
        return sql.replace("'{NL}'", "'\\n'").replace("{CR}", "\\r").replace("{NL}", "'\\n'").replace("{B}", "●").replace("{D}", "—")
    return sql.replace("'{NL}'", "chr(10)").replace("{CR}'", "' || chr(13)").replace("{NL}", "chr(10)").replace("{B}", "●").replace("{D}", "—")


def duck(sql: str) -> str:
    """A fixture as DuckDB SQL over the registered views."""
    return _filled(sql, "duckdb")


def frame(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """A fixture as a DataFrame over a folder's tables, or those that are given."""
    sql = _filled(sql, "spark")
    used = [t for t in ("documents", "orders", "customer") if f"FROM {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


COMPANIES = ("Borealis", "Cedar", "Cedar Labs")
#: Names that occur among the token fixture's companies, for the gazetteer's bypass.
SHORT_COMPANIES = ("le", "la", "of", "to")

#: Settings of the fixtures; the keys are the settings file's format, the values are our own.
SETTINGS = {
    "seniority_keywords": {"Executive": ["director", "president"], "Principal": ["distinguished"], "Staff": ["staff"], "Senior": ["senior", "expert"], "Mid": ["intermediate"], "Junior": ["assistant", "trainee"]},
    "seniority_by_years": {"Staff": 20, "Senior": 9, "Mid": 4, "Junior": 0}, "seniority_by_experience_count": {"Senior": 5, "Mid": 3, "Junior": 0},
    "phone_country_prefixes": {"+49": "Germany", "+1": "United States"}, "us_states": ["OR", "NM"], "city_country_map": {"portland": "United States", "lyon": "France"},
    "country_name_aliases": {"deutschland": "Germany", "holland": "Netherlands"},
    "pre_processing": {"strip_labels": ["Tel:", "Mail:"], "skill_table_categories": ["Core Tools"]},
    "multi_word_skills": ["data modeling", "event sourcing"],
    "post_processing": {
        "span_merge_max_gap": 4, "span_merge_labels": ["TITLE", "COMPANY"], "company_gazetteer_match_max_words": 3, "title_company_separators": [" with "], "max_experience_months": 480,
        "present_words": ["present", "today"], "date_words": ["may", "present", "today"],
        "space_collapse_pairs": [[" ,", ","], [" : ", ": "], [" ( ", " ("], [" )", ")"], [" + +", "++"]],
        "entity_rules": {
            "COMPANY": {"min_length": 4, "gazetteer_bypass": True, "strip_trailing_state_code": True}, "TITLE": {"min_length": 3, "exceptions": ["MD"]},
            "SKILL": {"min_length": 4, "uppercase_bypass": True, "exceptions": ["Zig", "Nim", "ts"], "blocked_words": ["various"], "aliases": {"type script": "typescript", "ts": "typescript"}},
            "CERT": {"min_length": 3, "aliases": {"forklift operator": "forklift operator certificate"}}, "DATE": {"min_length": 4},
            "EMAIL": {"min_length": 6, "require": "@", "reject_patterns": ["mailto", "www."], "strip_prefixes": ["Mr."]},
        },
    },
}


def settings(companies: tuple[str, ...] = COMPANIES) -> Config:
    return from_dict(SETTINGS, companies)


def unique_ids(documents: DataFrame) -> bool:
    """Whether no two documents, of null ids either, share an id; only the ids are read."""
    return documents.groupBy("doc_id").count().filter("count > 1").isEmpty()


def _entity(pos: int, label: str) -> str:
    return "O" if label == "O" else f"I-{label}" if pos % 3 == 1 else label if pos % 11 == 5 else f"B-{label}"


#: The entities of TOKENS_SQL by position modulo 33 and label.
_ENTITIES = [[_entity(pos, label) for label in TOKEN_LABELS] for pos in range(33)]
_SCORES = [(i + 90) / 100 for i in range(10)]


def tokens(text: str) -> Iterator[tuple[str, str, int, int, float]]:
    """The rows of TOKENS_SQL for one document, in order: entity, word, start, end, score."""
    at = 0
    for pos, word in enumerate(text.split(" ")):
        n = len(word)
        if n:
            kind = n % 12
            if pos % 7 == 3:
                said = f"##{word}"
            elif kind == 5:
                said = f"{word}@x.org"
            elif kind == 0:
                said = f"{word}, OR"
            elif kind == 4:
                said = "Present" if pos % 2 else f"June {1990 + pos % 30}"
            else:
                said = word
            yield _ENTITIES[pos % 33][kind], said, at, at + n, _SCORES[pos % 10]
        at += n + 1


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens in order."""
    rows = frame(spark, sf_dir, TOKENS_SQL)
    token = F.struct("pos", F.struct("entity", "word", F.col("start_off").alias("start"), F.col("end_off").alias("end"), (F.col("score_pct") / 100).alias("score")).alias("t"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["t"]).alias("tokens"))


#: One of the statements whose union is `spans` in SPANS_SQL.
_BRANCH = re.compile(r"SELECT d, (?P<st>[^,]+?)(?: AS st)?, (?P<label>'[A-Z]+')(?: AS label)?, (?P<txt>.+?)(?: AS txt)? FROM e(?: WHERE (?P<when>.+))?")


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of SPANS_SQL. Its union would number the orders once for each of its statements; here each order gives the
    spans of all of them, and its shuffle serves the last numbering too."""
    head, rest = SPANS_SQL.split("spans AS (", 1)
    body, tail = rest.rsplit(")\nSELECT", 1)
    branches = [_BRANCH.fullmatch(b.strip()) for b in body.split("UNION ALL")]
    each = ", ".join(f"CASE WHEN {b['when'] or 'true'} THEN struct(CAST({b['st']} AS BIGINT) AS st, {b['label']} AS label, {b['txt']} AS txt) END" for b in branches)
    return frame(spark, sf_dir, f"{head}spans AS (SELECT d, x.st, x.label, x.txt FROM (SELECT d, explode(array({each})) AS x FROM e) WHERE x IS NOT NULL)\nSELECT{tail}")


def span_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, spans in order."""
    rows = frame(spark, sf_dir, SPANS_SQL)
    span = F.struct("pos", F.struct("label", "text", F.col("start_off").alias("start"), F.col("end_off").alias("end"), "bio", (F.col("score_pct") / 100).alias("score")).alias("s"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]).alias("spans"))


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records: persons with their roles (none for some), studies, skills and certificates."""
    person = frame(spark, sf_dir, PERSON_SQL)
    role = F.struct("rn", F.struct("title", "company", "start_date", "end_date").alias("r"))
    roles = frame(spark, sf_dir, EXPERIENCE_SQL).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(role)), lambda x: x["r"]).alias("experience"))
    from dossier.schema import EDUCATION, EXPERIENCE

    study = F.struct(F.when(F.col("doc_id") % 2 == 1, "Diplom").alias("degree"), F.when(F.col("doc_id") % 4 == 3, "Geodesy").alias("field"), F.when(F.col("doc_id") % 4 >= 2, "Delta Institute").alias("institution"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    named = lambda n, stem: F.transform(F.slice(F.sequence(F.lit(1), F.lit(14)), F.lit(1), n), lambda i: F.concat(F.lit(stem), i.cast("string")))
    return person.join(roles, "doc_id", "left").select(
        "doc_id", F.struct("name", "email", "phone", "location").alias("personal"), F.coalesce("experience", none(EXPERIENCE)).alias("experience"),
        F.when(F.col("doc_id") % 4 == 0, none(EDUCATION)).otherwise(F.array(study)).alias("education"),
        named(F.col("skill_n"), "skill ").alias("skills"), named(F.col("cert_n"), "certificate ").alias("certifications"), "raw_text")
