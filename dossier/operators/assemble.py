"""Spans to records: first-of-label lookups, ordered folds for experience and education, keep-first sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.config import Config
from dossier.functions.arrays import bind
from dossier.functions.jsre import ANY, END, WS, group, in_list, quote, some, sub, trim
from dossier.functions.text import certificate_name, clean_phone, clean_spaces, skill_name
from dossier.operators.sections import by_start
from dossier.operators.spans import clean_entity, empty
from dossier.schema import EDUCATION, EXPERIENCE


def _texts(spans: Column, label: str) -> Column:
    return F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s: s["text"])


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: some(x).isNotNull()), F.lit(0))


def personal(spans: Column, config: Config) -> Column:
    """struct<name, email, phone, location>: the first span of each that is of use."""
    of = lambda label, f: _first(F.transform(_texts(spans, label), f))
    return F.struct(
        of("NAME", lambda x: x).alias("name"), of("EMAIL", lambda x: clean_entity(F.lit("EMAIL"), x, config)).alias("email"),
        of("PHONE", clean_phone).alias("phone"), of("LOCATION", lambda x: clean_spaces(x, config)).alias("location"))


def _role(title: Column, company: Column, start: Column, end: Column) -> Column:
    return F.struct(title.alias("title"), company.alias("company"), start.alias("start_date"), end.alias("end_date"))


def experience(spans: Column, config: Config) -> Column:
    """Roles from titles, companies and dates in order of start: a fold whose state is the open role and the closed ones.

    An empty text counts as missing, so the state holds nulls for it.
    """
    none = F.lit(None).cast("string")
    blank = _role(none, none, none, none)
    present = "|".join(map(quote, config.present_words))
    open_end = rf"(?iu)\A({ANY}+?){WS}+({present}){END}"
    year = rf"\A([0-9]{{4}}){WS}*({ANY}*){END}"

    def valued(s: Column) -> Column:
        company = clean_spaces(F.coalesce(clean_entity(F.lit("COMPANY"), s["text"], config), F.lit("")), config)
        value = F.when(s["label"] == "TITLE", clean_spaces(s["text"], config)).when(s["label"] == "COMPANY", company).otherwise(sub(s["text"], rf"\A[| ]+|[| ]+{END}"))
        return F.struct(s["label"].alias("label"), some(value).alias("value"))

    def parted(s: Column) -> Column:
        """A date's parts: what comes before an open end and its word, or a year and what follows."""
        date = lambda pattern, n: F.when(s["label"] == "DATE", group(s["value"], pattern, n))
        return F.struct(s["label"].alias("label"), s["value"].alias("value"), some(date(open_end, 1)).alias("since"), date(open_end, 2).alias("until"), some(date(year, 1)).alias("year"), date(year, 2).alias("rest"))

    def state(out: Column, role: Column) -> Column:
        return F.struct(out.alias("out"), role.alias("role"))

    def step(acc: Column, s: Column) -> Column:
        out, r, value = acc["out"], acc["role"], s["value"]
        title, company, start, end = r["title"], r["company"], r["start_date"], r["end_date"]
        closed = F.array_append(out, r)
        has = lambda *xs: F.coalesce(*xs).isNotNull()

        turn = title.isNotNull() & has(company, start)
        on_title = F.when(turn, state(closed, _role(value, none, none, none))).otherwise(state(out, _role(value, company, start, end)))

        turn = company.isNotNull() & has(title, start)
        on_company = F.when(turn, state(closed, _role(none, value, none, none))).otherwise(state(out, _role(title, value, start, end)))

        to_present = s["since"].isNotNull() & start.isNull()
        month_then_year = s["year"].isNotNull() & end.isNull() & F.coalesce(start.rlike(rf"\A[a-zA-Z]+{END}"), F.lit(False))
        full = start.isNotNull() & end.isNotNull()
        on_date = (
            F.when(value.isNull(), acc)
            .when(to_present, state(out, _role(title, company, some(trim(s["since"])), s["until"])))
            .when(month_then_year, state(out, _role(title, company, F.concat(start, F.lit(" "), s["year"]), some(trim(s["rest"])))))
            .when(full & has(title, company), state(closed, _role(none, none, value, none)))
            .when(start.isNull(), state(out, _role(title, company, value, end)))
            .when(end.isNull(), state(out, _role(title, company, start, value)))
            .otherwise(acc)
        )
        return F.when(s["label"] == "TITLE", on_title).when(s["label"] == "COMPANY", on_company).otherwise(on_date)

    ordered = by_start(F.filter(spans, lambda s: s["label"].isin("TITLE", "COMPANY", "DATE")))
    done = lambda acc: F.when(F.coalesce(acc["role"]["title"], acc["role"]["company"]).isNotNull(), F.array_append(acc["out"], acc["role"])).otherwise(acc["out"])
    parts = F.transform(F.transform(ordered, valued), parted)
    return clean_experience(F.aggregate(parts, state(empty(f"array<{EXPERIENCE}>"), blank), step, done), config)


def clean_experience(roles: Column, config: Config) -> Column:
    """Texts cleaned, `title at company` taken apart, leading bare titles dropped if a later role has more, repeats dropped."""
    tidy = lambda x: some(clean_spaces(x, config))

    def tidied(r: Column) -> Column:
        return _role(*(tidy(r[f]) for f in ("title", "company", "start_date", "end_date")))

    def cleaned(r: Column) -> Column:
        title, company = r["title"], r["company"]
        new_title, new_company = title, company
        for separator in reversed(config.separators):
            parts = F.split(title, f"(?iu){quote(separator.strip())}")
            hit = title.isNotNull() & company.isNull() & F.contains(F.lower(title), F.lit(separator.lower()))
            new_title = F.when(hit, tidy(F.get(parts, F.lit(0)))).otherwise(new_title)
            new_company = F.when(hit, tidy(F.get(parts, F.lit(1)))).otherwise(new_company)
        return _role(new_title, new_company, r["start_date"], r["end_date"])

    def trimmed(all_of: Column) -> Column:
        more = lambda r: F.coalesce(r["company"], r["start_date"]).isNotNull()
        bare = lambda r: r["title"].isNotNull() & ~more(r)
        first = F.array_position(F.transform(all_of, lambda r: ~bare(r)), F.lit(True))
        later = F.exists(F.slice(all_of, F.lit(2), F.greatest(F.size(all_of), F.lit(1))), more)
        return F.when(later, F.slice(all_of, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(all_of), F.lit(1)))).otherwise(all_of)

    kept = bind(F.transform(F.transform(roles, tidied), cleaned), trimmed)
    return F.filter(F.array_distinct(kept), lambda r: F.coalesce(r["title"], r["company"], r["start_date"], r["end_date"]).isNotNull())


def education(spans: Column, config: Config) -> Column:
    """Degrees with fields and institutions: a degree closes one with a degree, an institution always closes."""
    none = F.lit(None).cast("string")

    def study(degree: Column, field: Column, institution: Column) -> Column:
        return F.struct(degree.alias("degree"), field.alias("field"), institution.alias("institution"))

    def state(out: Column, e: Column) -> Column:
        return F.struct(out.alias("out"), e.alias("e"))

    def step(acc: Column, s: Column) -> Column:
        out, e, text = acc["out"], acc["e"], s["text"]
        on_degree = F.when(e["degree"].isNotNull(), state(F.array_append(out, e), study(text, none, none))).otherwise(state(out, study(text, e["field"], e["institution"])))
        on_field = state(out, study(e["degree"], text, e["institution"]))
        place = some(sub(text, rf",?{WS}*[0-9]{{4}}{WS}*{END}"))
        on_institution = state(F.array_append(out, study(e["degree"], e["field"], place)), study(none, none, none))
        return F.when(s["label"] == "DEGREE", on_degree).when(s["label"] == "FIELD", on_field).otherwise(on_institution)

    ordered = by_start(F.filter(spans, lambda s: s["label"].isin("DEGREE", "FIELD", "INSTITUTION")))
    done = lambda acc: F.when(F.coalesce(acc["e"]["degree"], acc["e"]["institution"]).isNotNull(), F.array_append(acc["out"], acc["e"])).otherwise(acc["out"])
    named = F.transform(ordered, lambda s: F.struct(s["label"].alias("label"), some(clean_spaces(s["text"], config)).alias("text")))
    found = F.aggregate(named, state(empty(f"array<{EDUCATION}>"), study(none, none, none)), step, done)
    tidy = lambda x: some(clean_spaces(x, config))
    cleaned = F.transform(found, lambda e: study(tidy(e["degree"]), tidy(e["field"]), tidy(e["institution"])))
    return F.filter(F.array_distinct(cleaned), lambda e: F.coalesce(e["degree"], e["field"], e["institution"]).isNotNull())


def keep_first(values: Column) -> Column:
    """Values without those that equal an earlier one in any case: sorted by their lower case and place, of equal ones the
    first is kept, and the rest go back to their order."""
    keyed = F.sort_array(F.transform(values, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    firsts = bind(keyed, lambda k: F.filter(k, lambda e, i: (i == 0) | (F.get(k, i - 1)["low"] != e["low"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def skills(spans: Column, config: Config) -> Column:
    rule = config.rule("SKILL")
    named = F.flatten(F.transform(_texts(spans, "SKILL"), lambda t: F.transform(F.split(t, f",{WS}*"), lambda x: skill_name(x, config))))
    fit = lambda x: (F.length(x) > 0) & ((F.length(x) >= rule.least) | (x == F.upper(x)) | in_list(F.lower(x), tuple(e.lower() for e in rule.exceptions)))
    return keep_first(F.filter(named, fit))


def certifications(spans: Column, config: Config) -> Column:
    return keep_first(F.filter(F.transform(_texts(spans, "CERT"), lambda t: certificate_name(t, config)), lambda x: F.length(x) > 1))
