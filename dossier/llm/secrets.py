"""Secret scans with corpus-wide ownership frequency (op6), DataFrame functions only.

Candidates are assignments to secret-like names, access keys, long hexadecimal runs, and opaque runs of mixed characters.
The hash of every candidate's value is aggregated over the corpus by distinct repositories and owners. A value that more
than MAX_OWNERS owners or MAX_REPOSITORIES repositories hold is a widely copied example; one that few hold is an
owner-specific, live-looking credential. Base spans (the first three kinds) are always reported; opaque runs only where
ownership makes them look live.

All texts are scanned once, each kind's matches behind a cheap test, and what was found is written. Occurrences are counted
by (value, owner, repository) first, so a value that a third of all rows hold is summed before it is shuffled, and it is
joined by broadcast (see `join_by_key`). Only documents with a candidate are exploded and joined; the rest pass by.

Positions are in code points, end exclusive: a pattern's matches and the pieces between them are laid end to end.

Defined results: a null or empty text has no candidates. A null owner or repository is one of its own. Repeated rows are
reported each and add nothing to distinct owners. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import cut, join_by_key, table

MAX_OWNERS, MAX_REPOSITORIES = 3, 8


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: kind -> (pattern of all matches, group of the value, least length of the value, pattern that a document must hold). A run
#: that is long enough begins somewhere, so the last looks for runs at their beginnings only.
#: For access and hex the least length is part of the pattern: their matches are maximal runs, so that is the same.
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_NAMES = "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
_ASSIGN = _NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS: dict[str, tuple[str, int, int, str]] = {
    "assign": (_ASSIGN, 1, 12, _NAMES + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    "access": (r"(AKIA[A-Z0-9]{14,})", 1, 18, r"AKIA[A-Z0-9]{14}"),
    "hex": (r"([0-9a-f]{16,})", 1, 16, r"(?<![0-9a-f])[0-9a-f]{16}"),
    "opaque": (r"([A-Za-z0-9+/_=-]{20,})", 1, 20, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"),
}
#: What an opaque run must hold to look like a credential.
MIXED = (r"[A-Z]", r"[a-z]", r"[0-9]")
BASE = ("assign", "access", "hex")
MARK_LIVE, MARK_COPIED = "<secret>", "<example>"


def _may(text: Column, kind: str) -> Column:
    """Whether a text may hold a match of a kind; what it lets through is all that can match. Plain searches come first."""
    need = text.rlike(KINDS[kind][3])
    if kind == "assign":
        low = F.lower(text)
        return reduce(or_, (F.contains(low, F.lit(w)) for w in _WORDS)) & need
    return F.contains(text, F.lit("AKIA")) & need if kind == "access" else need


def _matches(text: Column, kind: str) -> Column:
    """array<struct<gap, size, value size, hash of the value, good>>, one for each match in order; null if there can be none."""
    pattern, group, least, _ = KINDS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern)
    good = lambda v: F.length(v) >= least if kind != "opaque" else reduce(lambda a, b: a & b, [v.rlike(m) for m in MIXED])
    made = F.zip_with(F.zip_with(whole, value, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), gaps, lambda x, g: F.struct(
        F.length(g).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["v"]).alias("value"), F.sha2(x["v"].cast("binary"), 256).alias("hash"), good(x["v"]).alias("good"), x["m"].isNotNull().alias("real")))
    return F.when(_may(text, kind), F.filter(made, lambda x: x["real"])).alias(kind)


def candidates(docs: DataFrame, owner: Column, repository: Column, extra: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(all documents: __rid, the extra columns, whether they have a candidate (__hit); candidates: __rid, kind number, start,
    end, value start, owners, repositories)."""
    scanned = docs.select(*extra, owner.alias("__owner"), repository.alias("__repo"), *(_matches(F.col("text"), k) for k in KINDS))
    hit = F.coalesce(*KINDS).isNotNull().alias("__hit")
    rows = cut(scanned.select("*", F.monotonically_increasing_id().alias("__rid"), hit), "secrets")
    hits = rows.filter("__hit")
    parts = []
    for number, kind in enumerate(KINDS):
        exploded = hits.select("__rid", "__owner", "__repo", F.lit(number).alias("kind"), F.posexplode(kind).alias("at", "m"))
        end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("__rid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        parts.append(exploded.withColumn("end", end).filter("m.good").select("__rid", "__owner", "__repo", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end", (F.col("end") - F.col("m.value")).alias("value_start"), F.col("m.hash").alias("hash")))
    found = cut(reduce(DataFrame.unionAll, parts), "secrets-found")
    by_repo = found.groupBy("hash", "__owner", "__repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "__owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    spread = cut(by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n")), "secrets-spread")
    return rows.drop(*KINDS, "__owner", "__repo"), join_by_key(found.drop("__owner", "__repo"), spread, "hash", "n").drop("hash")


def scan(docs: DataFrame, owner: Column, repository: Column, extra: list[Column], max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """The extra columns of documents with a candidate, with __spans: array of (start, kind, end, value_start, live), null if
    none counts; and of those without."""
    rows, found = candidates(docs, owner, repository, extra)
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    kept = found.filter(live | (F.col("kind") < len(BASE)))
    spans = kept.groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value_start", live.alias("live")))).alias("__spans"))
    return rows.filter("__hit").drop("__hit").join(spans, "__rid", "left").drop("__rid"), rows.filter("NOT __hit").drop("__hit", "__rid")


def _joined(spans: Column) -> Column:
    name = lambda k: reduce(lambda out, x: F.when(k == x[0], x[1]).otherwise(out), enumerate(KINDS), F.lit(""))
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, owner: Column, repository: Column, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, all spans, and how many candidates look live or copied."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value_start:bigint,live:boolean>>")
    hit, rest = scan(docs, owner, repository, [F.col("doc_id")], max_owners, max_repositories)
    every = hit.select("doc_id", F.coalesce("__spans", none).alias("__spans")).unionAll(rest.select("doc_id", none.alias("__spans")))
    spans = F.col("__spans")
    count = lambda f: F.size(F.filter(spans, f)).cast("long")
    of = lambda number: lambda s: s["kind"] == number
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return every.select(
        "doc_id", *(count(of(i)).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"))


def mask(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The documents with every secret's value masked: live-looking ones and copied examples by marks of their own.

    All columns stay; n_chars, where there is one, is counted anew.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    owner = F.col("source") if owner is None else owner
    hit, rest = scan(docs, owner, _repository() if repository is None else repository, [row], max_owners, max_repositories)
    text = F.col("__row.text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (s["value_start"] - state["at"]).cast("int"))
        fresh = s["value_start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], between, F.when(s["live"], MARK_LIVE).otherwise(MARK_COPIED))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    ordered = F.array_sort(F.transform(F.col("__spans"), lambda s: F.struct(s["value_start"].alias("value_start"), s["end"].alias("end"), s["live"].alias("live"))))
    whole = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    masked = hit.withColumn("__new", F.when(F.col("__spans").isNull(), text).otherwise(whole))
    fields = []
    for c in docs.columns:
        new = F.col("__new") if c == "text" else F.length("__new").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"__row.`{c}`")
        fields.append(new.alias(c))
    return rest.select("__row.*").unionAll(masked.select(*fields))


def _repository() -> Column:
    """Of the documents table: a source's texts of one language."""
    return F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit("")))


def op6_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), F.col("source"), _repository())


def _sql() -> str:
    parts = []
    for number, kind in enumerate(KINDS):
        pattern, group, least, _ = KINDS[kind]
        p = pattern.replace("'", "''")
        good = f"length(v) >= {least}" if kind != "opaque" else " AND ".join(f"regexp_matches(v, '{m}')" for m in MIXED)
        parts.append(f"""SELECT r, source, lang, {number} AS kind, stop - length(m) AS start, stop, v FROM (
  SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop FROM (
    SELECT r, source, lang, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM (
      SELECT r, source, lang, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gs FROM d))) WHERE {good}""")
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    joined = f"string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
c AS ({" UNION ALL ".join(parts)}),
o AS (SELECT v, count(*) AS owners, sum(n) AS repositories FROM (SELECT v, source, count(DISTINCT coalesce(lang, '')) AS n FROM c GROUP BY v, source) GROUP BY v),
k AS (SELECT * FROM (SELECT c.*, owners <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES} AS live FROM c JOIN o USING (v)) WHERE kind < 3 OR live),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {joined} FILTER (kind < 3) AS base, {joined} AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (r)
"""


SQL = _sql()
