"""Section headers of a text, and spans for what the tagger missed in recognised sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.arrays import bind
from dossier.functions.jsre import ANY, END, WS, WS_IN, group, sub, trim
from dossier.operators.spans import empty, span

#: Headers that open a section, in lower case; fixed values.
HEADERS = {
    "skills": [
        "skills", "technical skills", "core competencies", "competencies", "areas of expertise", "areas of excellence", "proficiencies", "technical proficiencies", "key skills",
        "professional skills", "summary of qualifications", "qualifications", "tools & technologies", "tools and technologies", "technologies", "tech stack",
        "devops tools & technologies", "devops tools",
    ],
    "certifications": ["certifications", "licenses & certifications", "licenses", "professional certifications", "credentials", "certifications & licenses", "awards & certifications"],
    "languages": ["languages", "language skills", "linguistic skills"],
}
BULLET = rf"\A[-●•▪■▸►‣⁃]{WS}*"
#: What a filled span scores.
SCORE = 0.8


#: At most 30 ASCII letters; longer lines can't come down to a header, and most lines fail here after 31 letters.
FEW_LETTERS = r"\A(?:[^A-Za-z]*+[A-Za-z]){0,30}+[^A-Za-z]*+\z"


def header_of(line: Column) -> Column:
    """The section that a line opens, or null."""
    bare = trim(sub(F.lower(sub(trim(line), rf":{END}")), f"[^a-z{WS_IN}&]"))

    def name(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for of, headers in reversed(HEADERS.items()):
            out = F.when(x.isin(*headers), of).otherwise(out)
        return out

    return F.when(line.rlike(FEW_LETTERS), bind(bare, name))


def detect_sections(text: Column) -> Column:
    """array<struct<name, start, end, text>>: from each header line to the next one or the end of the text."""
    kind = "array<struct<name:string,start:int>>"
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(header_of(x).alias("name"), (F.length(x) + 1).alias("size")))

    def step(state: Column, line: Column) -> Column:
        more = F.array_append(state["found"], F.struct(line["name"].alias("name"), state["at"].alias("start")))
        return F.struct((state["at"] + line["size"]).alias("at"), F.when(line["name"].isNotNull(), more).otherwise(state["found"]).alias("found"))

    def cut(whole: Column) -> Column:
        def section(h: Column, end: Column) -> Column:
            return F.struct(h["name"].alias("name"), h["start"].alias("start"), end.alias("end"), F.substr(whole["text"], h["start"] + 1, end - h["start"]).alias("text"))

        heads = whole["heads"]
        ends = F.array_append(F.slice(F.transform(heads, lambda h: h["start"]), F.lit(2), F.greatest(F.size(heads), F.lit(1))), F.length(whole["text"]))
        return F.zip_with(heads, F.slice(ends, F.lit(1), F.size(heads)), section)

    heads = F.aggregate(lines, F.struct(F.lit(0).alias("at"), empty(kind).alias("found")), step, lambda s: s["found"])
    return F.when(text.isNotNull(), bind(F.struct(text.alias("text"), heads.alias("heads")), cut))


def list_items(text: Column) -> Column:
    """Items of a listing: lines without bullet and category, cut at commas, bars and spaced dashes, of 3 to 49 characters."""
    category = rf"\A[A-Za-z{WS_IN}&/()-]+:{WS}*({ANY}+){END}"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: sub(trim(x), BULLET)), lambda x: F.length(x).between(1, 120))
    plain = F.transform(lines, lambda x: F.when(x.rlike(category), group(x, category)).otherwise(x))
    parts = F.flatten(F.transform(plain, lambda x: F.split(x, rf"{WS}*[,|]{WS}*|{WS}+-{WS}+")))
    return F.filter(F.transform(parts, lambda x: sub(trim(x), rf"[.,;:]+{END}")), lambda x: F.length(x).between(3, 49))


def _header_words(line: Column, keep: str) -> Column:
    return trim(sub(F.lower(line), f"[^a-z{WS_IN}{keep}]"))


def missing_spans(text: Column, spans: Column) -> Column:
    """Spans of sections' items that overlap no span there is; each stands where its text first occurs in its section."""

    def lines(body: Column) -> Column:
        return F.transform(F.split(body, "\n"), lambda x: sub(trim(x), BULLET))

    def certificates(body: Column) -> Column:
        return F.filter(lines(body), lambda x: F.length(x).between(5, 100) & ~_header_words(x, "&").isin(*HEADERS["certifications"]))

    def languages(body: Column) -> Column:
        name = rf"\A([A-Z][a-z]+(?:{WS}[A-Z][a-z]+)?)"
        spoken = F.filter(lines(body), lambda x: F.length(x).between(3, 60) & ~_header_words(x, "").isin(*HEADERS["languages"]) & x.rlike(name))
        return F.transform(spoken, lambda x: group(x, name))

    def of(section: Column) -> Column:
        feed = F.instr(section["text"], "\n")
        body = F.when(feed > 0, F.substr(section["text"], feed + 1)).otherwise("")
        return (
            F.when(section["name"] == "skills", _place(section["start"] + feed, "SKILL", list_items, body))
            .when(section["name"] == "certifications", _place(section["start"], "CERT", certificates, section["text"]))
            .otherwise(_place(section["start"], "LANGUAGE", languages, section["text"]))
        )

    every = F.flatten(F.transform(detect_sections(text), of))
    return bind(spans, lambda there: F.filter(every, lambda a: ~F.exists(there, lambda s: (s["start"] < a["end"]) & (s["end"] > a["start"]))))


def _place(offset: Column, label: str, items, body: Column) -> Column:
    """Spans of the items of a body at their first places in it; the body and each place are found once."""

    def spans_in(body: Column) -> Column:
        placed = F.transform(items(body), lambda x: F.struct(x.alias("text"), F.position(x, body).alias("at")))
        start = lambda x: offset + x["at"] - 1
        return F.transform(F.filter(placed, lambda x: x["at"] > 0), lambda x: span(F.lit(label), x["text"], start(x), start(x) + F.length(x["text"]), F.lit("B"), F.lit(SCORE)))

    return bind(body, spans_in)


def by_start(spans: Column) -> Column:
    """Spans by start; equal starts keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def fill_missing(text: Column, spans: Column) -> Column:
    return bind(spans, lambda there: by_start(F.concat(there, missing_spans(text, there))))
