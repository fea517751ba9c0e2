"""Completeness score of a record (six categories) and the list of what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.arrays import bind
from dossier.functions.jsre import NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, some

#: Nouns and verbs that tell of achievements; fixed values.
COUNTED = "users|customers|clients|engineers|people|team|employees|members|patients|students|projects|accounts|microservices"
VERBS = "increased|reduced|grew|saved|delivered|generated|managed|led|built|launched|drove|improved|achieved|exceeded|scaled|optimized|automated|streamlined"
QUANTIFIED = rf"(?i)[0-9]+%|\$[0-9,.]+[MBK]?|{NOT_AFTER_WORD}[0-9]{{2,}}{WS}*(?:{COUNTED})"
METRICS = rf"(?i){NOT_AFTER_WORD}(?:{VERBS}){NOT_BEFORE_WORD}"

#: (severity, message) of each issue; {} is a count. Fixed values.
ISSUES = {
    "name": ("high", "Name is missing - add your full name at the top of your resume"),
    "email": ("high", "Email address is missing - add a professional email in the contact section"),
    "phone": ("medium", "Phone number is missing - include a phone number for recruiter callbacks"),
    "location": ("medium", "Location is missing - add city and state/country for job matching"),
    "no_experience": ("high", "No work experience detected - add a clearly labeled experience section with job titles and companies"),
    "no_dates": ("high", "Employment dates are missing - add start and end dates (e.g., January 2020 - Present) for each role"),
    "some_dates": ("medium", "{} experience entries missing dates - add date ranges for all roles"),
    "no_titles": ("high", "Job titles are missing - add a clear title for each role"),
    "no_companies": ("high", "Company names are missing - add employer names for each role"),
    "no_education": ("medium", "No education section detected - add degree, institution, and field of study"),
    "no_skills": ("high", "No skills detected - add a dedicated skills section with 8-12 relevant technical and professional skills"),
    "few_skills": ("medium", "Only {} skills found - aim for 8-12 relevant skills to improve keyword matching"),
    "no_certifications": ("low", "No certifications listed - add relevant certifications to strengthen your profile"),
    "no_metrics": ("medium", "No quantified achievements - add metrics like '40% increase in performance', 'led team of 12', '$2M revenue'"),
}


def _flag(condition: Column, points: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)


def _with(roles: Column, field: str) -> Column:
    return F.size(F.filter(roles, lambda r: some(r[field]).isNotNull()))


def score(personal: Column, roles: Column, studies: Column, skills: Column, certificates: Column, years: Column, raw_text: Column) -> Column:
    """struct<score, details, issues>. What categories and issues share is found once."""
    study = lambda f: F.exists(studies, lambda e: some(e[f]).isNotNull())
    months = F.size(F.filter(roles, lambda r: F.coalesce(r["start_date"].rlike("[a-zA-Z]"), F.lit(False))))
    facts = {
        "n": F.size(roles), "titles": _with(roles, "title"), "companies": _with(roles, "company"), "dates": _with(roles, "start_date"), "months": months, "n_skills": F.size(skills),
        **{f"has_{f}": some(personal[f]).isNotNull() for f in ("name", "email", "phone", "location")}, "studies": F.size(studies), **{f: study(f) for f in ("degree", "institution", "field")},
        "certificates": F.size(certificates), "years": years, "quantified": F.coalesce(raw_text.rlike(QUANTIFIED), F.lit(False)), "metrics": F.coalesce(raw_text.rlike(METRICS), F.lit(False)),
    }
    return bind(F.struct(*(v.alias(k) for k, v in facts.items())), _scored)


def _scored(x: Column) -> Column:
    n, titles, companies, dates, months, n_skills, years, quantified, metrics = (x[f] for f in ("n", "titles", "companies", "dates", "months", "n_skills", "years", "quantified", "metrics"))
    has = lambda f: x[f"has_{f}"]

    contact = sum((_flag(has(f), 5) for f in ("name", "email", "phone", "location")), F.lit(0))
    experience = F.least(F.least(n * 4, F.lit(12)) + F.least(titles * 2, F.lit(4)) + F.least(companies * 2, F.lit(4)) + F.least(dates * 2, F.lit(5)), F.lit(25))
    education = _flag(x["studies"] > 0, 5) + _flag(x["degree"], 4) + _flag(x["institution"], 3) + _flag(x["field"], 3)
    skill = sum((_flag(n_skills >= k, 4) for k in (1, 3, 5, 8, 12)), F.lit(0))
    formatting = (
        _flag(n >= 2, 2) + _flag(n >= 3, 1) + _flag(years >= 2, 2) + _flag(x["certificates"] > 0, 2) + _flag(months > 0, 2) + _flag((months == n) & (n > 0), 1)
        + _flag((titles == n) & (n > 0), 2) + _flag((companies == n) & (n > 0), 2) + _flag(contact == 20, 2) + _flag(n_skills >= 8, 2))
    achievements = _flag(quantified, 3) + _flag(quantified & metrics, 2)

    def detail(points: Column, most: int, **more: Column) -> Column:
        return F.struct(points.alias("score"), F.lit(most).alias("max"), *(v.alias(k) for k, v in more.items()))

    details = F.struct(
        detail(contact, 20).alias("contact"), detail(experience, 25, roles=n).alias("experience"), detail(education, 15).alias("education"),
        detail(skill, 20, count=n_skills).alias("skills"), detail(formatting, 20).alias("formatting"),
        detail(achievements, 5, hasQuantified=quantified, hasMetrics=metrics).alias("achievements"))
    total = F.least(contact + experience + education + skill + formatting + achievements, F.lit(100))

    def issue(name: str, when: Column, count: Column | None = None) -> Column:
        severity, message = ISSUES[name]
        said = F.lit(message) if count is None else F.concat(count.cast("string"), F.lit(message[2:])) if message.startswith("{}") else F.concat(F.lit(message.split("{}")[0]), count.cast("string"), F.lit(message.split("{}")[1]))
        return F.when(when, F.struct(F.lit(severity).alias("severity"), said.alias("message")))

    issues = F.array_compact(F.array(
        *(issue(f, ~has(f)) for f in ("name", "email", "phone", "location")), issue("no_experience", n == 0), issue("no_dates", (n > 0) & (dates == 0)), issue("some_dates", (dates > 0) & (dates < n), n - dates),
        issue("no_titles", (n > 0) & (titles == 0)), issue("no_companies", (n > 0) & (companies == 0)), issue("no_education", x["studies"] == 0), issue("no_skills", n_skills == 0),
        issue("few_skills", (n_skills > 0) & (n_skills < 5), n_skills), issue("no_certifications", x["certificates"] == 0), issue("no_metrics", (n > 0) & ~quantified)))
    return F.struct(total.alias("score"), details.alias("details"), issues.alias("issues"))
