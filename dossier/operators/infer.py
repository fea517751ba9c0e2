"""Inference over records: priority lookups and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.config import Config
from dossier.functions.arrays import bind
from dossier.functions.jsre import NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, group, in_list, quote, some, sub, trim

#: Month names in the order in which they are tried, and their numbers from 0; fixed values.
FULL = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = [*((name, i) for i, name in enumerate(FULL)), *((name[:3], i) for i, name in enumerate(FULL) if name != "may")]
JUNE = 5


def month_index(text: Column) -> Column:
    """Year * 12 + month (from 0) of a date text; a year alone is its June; null if there is neither."""
    low = trim(F.lower(text))
    hits = [some(group(low, rf"{name}{WS}+([0-9]{{4}})")).cast("int") * 12 + i for name, i in MONTHS]
    year = some(group(text, rf"{NOT_AFTER_WORD}((?:19|20)[0-9]{{2}}){NOT_BEFORE_WORD}"))
    named = F.when(low.rlike("|".join(f"{name}{WS}+[0-9]{{4}}" for name, _ in MONTHS)), F.coalesce(*hits))
    return F.coalesce(named, year.cast("int") * 12 + JUNE)


def experience_years(roles: Column, config: Config, as_of: Column) -> Column:
    """Whole years of all roles together, overlaps counted twice; null if there are none. `as_of` ends open roles."""
    now = F.year(as_of) * 12 + F.month(as_of) - 1
    present = "(?iu)" + "|".join(map(quote, config.present_words))

    def months(r: Column) -> Column:
        end = some(r["end_date"])
        n = F.when(end.isNull() | end.rlike(present), now).otherwise(month_index(end)) - month_index(some(r["start_date"]))
        return F.when((n > 0) & (n < config.max_months), n).otherwise(0)

    total = F.aggregate(F.transform(roles, months), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(total > 0, F.floor(total / 12).cast("int"))


def seniority(roles: Column, years: Column, config: Config) -> Column:
    """The first level with a keyword in any title; else by years; else by the number of roles."""
    return bind(F.struct(F.transform(roles, lambda r: F.lower(r["title"])).alias("titles"), years.alias("years"), F.size(roles).alias("n")), lambda x: _level(x, config))


def _level(x: Column, config: Config) -> Column:
    titles, years = x["titles"], x["years"]
    out = F.when(F.lit(False), F.lit(""))
    for level, words in config.seniority_keywords.items():
        for_level = F.lit(False)
        for word in words:
            for_level = for_level | F.exists(titles, _holds(word))
        out = out.when(for_level, level)
    bounds = config.seniority_by_years
    for level in ("Staff", "Senior", "Mid"):
        out = out.when(years >= bounds[level], level)
    out = out.when(years.isNotNull(), "Junior")
    for level, least in sorted(config.seniority_by_count.items(), key=lambda x: -x[1]):
        out = out.when(x["n"] >= least, level)
    return out.otherwise("Junior")


def _holds(word: str):
    return lambda text: F.coalesce(F.contains(text, F.lit(word)), F.lit(False))


def country(location: Column, phone: Column, config: Config) -> Column:
    """By phone prefix, country alias, city, US state, each in the order of the settings."""
    words = F.split(F.replace(F.lower(some(location)), F.lit(","), F.lit(" ")), f"{WS}+")
    return bind(F.struct(sub(some(phone), rf"[\-()]|{WS}").alias("number"), F.lower(some(location)).alias("place"), words.alias("words")), lambda x: _land(x, config))


def _land(x: Column, config: Config) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for prefix, name in config.phone_prefixes.items():
        out = out.when(x["number"].startswith(prefix), name)
    for text, name in [*config.country_aliases.items(), *config.cities.items()]:
        out = out.when(F.contains(x["place"], F.lit(text)), name)
    return out.when(F.exists(x["words"], lambda w: in_list(F.upper(w), config.us_states)), "United States")
