"""Records to JSON, JSON lines, CSV and readable text."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from dossier.functions.jsre import some

FIXED = [
    "input", "status", "name", "email", "phone", "location", "country", "seniority", "experience_years", "experience_count", "education_count",
    "experience_summary", "education_summary", "skills", "certifications", "ats_score", "error",
]
ROLE = ("title", "company", "start_date", "end_date")
STUDY = ("degree", "field", "institution")
WIDTHS = (32, 8, 7, 10, 16)


def csv_columns(df: DataFrame, roles: int | None = None, studies: int | None = None) -> DataFrame:
    """The wide layout; as many role and study columns as the widest record has, found by a first pass unless given."""
    if roles is None or studies is None:
        widest = df.agg(F.max(F.size("experience")), F.max(F.size("education"))).first()
        roles, studies = (max(x or 0, 0) if given is None else given for x, given in zip(widest, (roles, studies), strict=True))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    dash = lambda c: F.coalesce(some(c), F.lit("-"))
    failed = some(F.col("error")).isNotNull()
    ok = F.col("personal").isNotNull()
    role = lambda r: F.concat(dash(r["title"]), F.lit(" @ "), dash(r["company"]), F.lit(" ("), dash(r["start_date"]), F.lit(" -> "), dash(r["end_date"]), F.lit(")"))
    study = lambda e: F.concat_ws(" | ", *(some(e[f]) for f in STUDY))
    count = lambda c: F.when(ok, F.size(c).cast("string")).otherwise("")
    values = {
        "input": F.col("input"), "status": F.when(failed, "error").otherwise("ok"), **{f: text(F.col(f"personal.{f}")) for f in ("name", "email", "phone", "location")},
        "country": text(F.col("country")), "seniority": text(F.col("seniority")), "experience_years": text(F.col("experience_years")),
        "experience_count": count(F.col("experience")), "education_count": count(F.col("education")),
        "experience_summary": text(F.array_join(F.transform("experience", role), " || ")), "education_summary": text(F.array_join(F.transform("education", study), " || ")),
        "skills": text(F.array_join("skills", "; ")), "certifications": text(F.array_join("certifications", "; ")), "ats_score": text(F.col("ats.score")), "error": text(F.col("error")),
    }
    values |= {f"exp_{i}_{f}": text(F.get("experience", F.lit(i - 1))[f]) for i in range(1, roles + 1) for f in ROLE}
    values |= {f"edu_{i}_{f}": text(F.get("education", F.lit(i - 1))[f]) for i in range(1, studies + 1) for f in STUDY}
    return df.select(*(v.alias(k) for k, v in values.items()))


def _cell(c: Column) -> Column:
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(wide: DataFrame) -> DataFrame:
    """One `line` for each row, quoted only where a cell needs it."""
    return wide.select(F.concat_ws(",", *(_cell(F.col(c)) for c in wide.columns)).alias("line"))


def write_csv(df: DataFrame, path: str, roles: int | None = None, studies: int | None = None) -> None:
    """Part files of lines quoted by `_cell`; the first one holds the header alone, so their concatenation is the file."""
    wide = csv_columns(df, roles, studies)
    header = df.sparkSession.createDataFrame([(",".join(wide.columns),)], "line string").coalesce(1)
    header.unionAll(csv_lines(wide)).write.mode("overwrite").text(path)


def _json(value: Column, keep_nulls: bool = False) -> Column:
    """A value as JSON text; `null` where it is null."""
    said = F.to_json(F.array(value), {"ignoreNullFields": str(not keep_nulls).lower()})
    return F.substring(said, F.lit(2), F.length(said) - 2)


def json_lines(df: DataFrame) -> DataFrame:
    """One `line` for each row: the JSON object of a batch item, as `as_item` makes it, without leaving the JVM."""
    has = lambda name: name in df.columns
    parts = [
        ("personal", _json(F.col("personal"), True)), ("experience", _json(F.col("experience"))), ("education", _json(F.col("education"))), ("skills", _json(F.col("skills"))),
        ("certifications", _json(F.col("certifications"))), ("seniority", _json(F.col("seniority"))), ("country", _json(F.col("country"))),
        ("experience_years", _json(F.col("experience_years"))), ("_rawText", _json(F.col("raw_text"))),
    ]
    body = F.concat(*(x for i, (name, value) in enumerate(parts) for x in (F.lit(f'{"," if i else "{"}"{name}":'), value)), F.lit("}"))
    named = F.when(F.col("input").isNotNull(), F.concat(F.lit('"input":'), _json(F.col("input")), F.lit(","))).otherwise("") if has("input") else F.lit("")
    scored = F.when(F.col("ats").isNotNull(), F.concat(F.lit(',"ats":'), _json(F.col("ats"), True))).otherwise("") if has("ats") else F.lit("")
    item = F.concat(F.lit("{"), named, F.lit('"parsed":'), body, scored, F.lit("}"))
    if has("error"):
        failed = some(F.col("error")).isNotNull()
        item = F.when(failed, F.concat(F.lit('{"input":'), _json(F.col("input")), F.lit(',"error":'), _json(F.col("error")), F.lit("}"))).otherwise(item)
    return df.select(item.alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Part files of JSON lines."""
    json_lines(df).write.mode("overwrite").text(path)


def as_item(row: Row, optional: tuple[str, ...] = ("input", "ats", "error")) -> dict[str, Any]:
    """A row as the JSON object of a batch item: nulls of personal, country and years kept, other absent fields left out."""
    r = row.asDict(recursive=True)
    if r.get("error"):
        return {"input": r["input"], "error": r["error"]}
    drop = lambda items: [{k: v for k, v in x.items() if v is not None} for x in items]
    parsed = {
        "personal": r["personal"], "experience": drop(r["experience"]), "education": drop(r["education"]), "skills": r["skills"], "certifications": r["certifications"],
        "seniority": r["seniority"], "country": r["country"], "experience_years": r["experience_years"], "_rawText": r["raw_text"],
    }
    out = {"input": r.get("input"), "parsed": parsed, "ats": r.get("ats")}
    return {k: v for k, v in out.items() if k == "parsed" or v is not None}


def render_json(items: list[dict] | dict, pretty: bool = True) -> str:
    return json.dumps(items, ensure_ascii=False, indent=2) if pretty else json.dumps(items, ensure_ascii=False, separators=(",", ":"))


def render_jsonl(items: list[dict]) -> str:
    return "\n".join(render_json(x, pretty=False) for x in items)


def render_record(item: dict[str, Any]) -> str:
    """One record as readable sections."""
    p = item["parsed"]
    dash = lambda v: "-" if v in (None, "") else str(v)
    roles = [f"{i}. {dash(r.get('title'))} @ {dash(r.get('company'))} ({dash(r.get('start_date'))} -> {dash(r.get('end_date'))})" for i, r in enumerate(p["experience"], 1)]
    studies = [f"{i}. {' | '.join(e[f] for f in STUDY if e.get(f)) or '-'}" for i, e in enumerate(p["education"], 1)]
    blocks = [("Input", [item["input"]])] if item.get("input") else []
    blocks += [
        ("Personal", [f"{k.title()}: {dash(p['personal'][k])}" for k in ("name", "email", "phone", "location")]), ("Experience", roles or ["None"]), ("Education", studies or ["None"]),
        ("Skills", [", ".join(p["skills"]) or "None"]), ("Certifications", [", ".join(p["certifications"]) or "None"]),
        ("Derived", [f"Seniority: {p['seniority']}", f"Country: {dash(p['country'])}", f"Experience Years: {dash(p['experience_years'])}"]),
    ]
    if item.get("ats"):
        said = " | ".join(f"{x['severity']}:{x['message']}" for x in item["ats"]["issues"]) or "None"
        blocks.append(("ATS", [f"Score: {item['ats']['score']}", f"Issues: {said}"]))
    return "\n\n".join("\n".join([title, *(f"  {line}" for line in lines)]) for title, lines in blocks)


def render_batch(items: list[dict[str, Any]]) -> str:
    """A table of all items and a list of failures."""
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, WIDTHS, strict=True))
    failed = [x for x in items if x.get("error")]
    rows = [line((os.path.basename(x["input"]), "ERROR" if x.get("error") else "OK", str(x["ats"]["score"]) if x.get("ats") else "-", (x.get("parsed") or {}).get("seniority") or "-", (x.get("parsed") or {}).get("country") or "-")) for x in items]
    out = [f"Processed {len(items)} file(s): {len(items) - len(failed)} succeeded, {len(failed)} failed", "", line(("File", "Status", "ATS", "Seniority", "Country")), "\n".join(rows) or "No files processed"]
    return "\n".join([*out, *(["", "Failures", "\n".join(f"  - {os.path.basename(x['input'])}: {x['error']}" for x in failed)] if failed else [])])


def batch_summary(df: DataFrame) -> DataFrame:
    """total, succeeded and failed rows."""
    bad = some(F.col("error")).isNotNull()
    return df.agg(F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"))


def write_output(text: str, path: str | None) -> None:
    """To a file as it is, or to standard output with a line end."""
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
