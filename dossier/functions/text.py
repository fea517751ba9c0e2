"""Text normalisation as Column expressions; each step is a projection, so Catalyst fuses them into one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.config import Config
from dossier.functions.arrays import bind, split_at
from dossier.functions.jsre import ANY, END, NOT_AFTER_WORD, WS, WS_IN, WS_NO_FEED, group, literal, quote, some, sub, trim


def newlines(text: Column) -> Column:
    """One kind of line end, and no white space before it."""
    return sub(sub(text, r"\r\n?", "\n"), rf"{WS_NO_FEED}+(?=\n|{END})")


def dashes(text: Column, config: Config) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), config.dashes.items(), text)


def bullets(text: Column, config: Config) -> Column:
    """A bullet at the start of a line, and white space after it, becomes the replacement."""
    if not config.bullets:
        return text
    return sub(text, rf"(?:\A|(?<=[\n\r\x{{2028}}\x{{2029}}]))[{quote(''.join(config.bullets))}]{WS}*", literal(config.bullet_replacement))


def labels(text: Column, config: Config) -> Column:
    """Drop labels such as `Phone:` in either case wherever they begin at a word border."""

    def pattern(label: str) -> str:
        border = NOT_AFTER_WORD if label[0].isascii() and (label[0].isalnum() or label[0] == "_") else "(?<=[A-Za-z0-9_])"
        return f"(?iu){border}{quote(label)}{WS}*"

    return reduce(lambda t, label: sub(t, pattern(label)), (x for x in config.strip_labels if x), text)


def spaces(text: Column) -> Column:
    return sub(text, " {2,}", " ")


#: A line of a text, as a table's row: what it opens, and whether it may continue the row before.
_LINE = "struct<line:string,bare:string,more:boolean,opens:boolean,category:string,items:string,continues:boolean>"


def tables(text: Column, config: Config) -> Column:
    """Flattened skill tables become `category: items` lines, continuation lines included.

    Every line is taken apart once. A fold over the lines whose state is whether a row is open tells which lines continue
    the row before (a line first tries that); then rows are put together from their lines.
    """
    if not config.table_categories:
        return text
    names = "|".join(map(quote, sorted(config.table_categories, key=len, reverse=True)))
    named = rf"(?iu)\A({names}){WS}+([A-Za-z0-9#.+]{ANY}+){END}"
    wide = rf"\A([A-Za-z][A-Za-z{WS_IN}&/()-]{{2,40}}?){WS}{{2,}}([A-Za-z0-9#.+]{ANY}+){END}"

    def parsed(lines: Column) -> Column:
        """Each line taken apart, step by step, so that no pattern is matched twice."""

        def with_(x: Column, **more: Column) -> Column:
            return F.struct(*(x[f].alias(f) for f in ("line", "bare")), *(v.alias(k) for k, v in more.items()))

        bare = F.transform(lines, lambda x: F.struct(x.alias("line"), trim(x).alias("bare")))
        kinds = F.transform(bare, lambda x: with_(x, named=x["bare"].rlike(named), wide=x["line"].rlike(wide)))

        def items(x: Column) -> Column:
            part = lambda n: trim(F.when(x["named"], group(x["bare"], named, n)).when(x["wide"], group(x["line"], wide, n)).otherwise(""))
            begins = x["bare"].rlike(r"\A[A-Z]") & F.contains(x["bare"], F.lit(",")) & ~x["named"] & (F.length(x["bare"]) < config.table_max_chars)
            return with_(x, named=x["named"], more=x["line"].rlike(rf"\A{WS}{{2,}}[A-Za-z0-9#.+]") | begins, category=part(1), items=part(2))

        def opens(x: Column) -> Column:
            words = F.size(F.split(x["items"], f"{WS}+"))
            listed = F.contains(x["items"], F.lit(","))
            # a line that matches neither pattern has no items, so it isn't listed
            fit = (x["named"] | listed) & (words <= config.table_max_words) & (listed | (words <= 5))
            return with_(x, more=x["more"], opens=fit, category=x["category"], items=x["items"])

        return F.transform(F.transform(kinds, items), opens)

    def marked(lines: Column) -> Column:
        """The lines with whether they continue a row; the fold's state is a mark for each line and whether a row is open."""
        start = F.struct(F.lit("").alias("marks"), F.lit(False).alias("open"))

        def step(state: Column, x: Column) -> Column:
            joins = state["open"] & x["more"]
            return F.struct(F.concat(state["marks"], F.when(joins, "+").otherwise("-")).alias("marks"), (joins | x["opens"]).alias("open"))

        marks = F.split(F.aggregate(lines, start, step, lambda s: s["marks"]), "")
        return F.zip_with(lines, F.slice(marks, F.lit(1), F.size(lines)), lambda x, m: F.struct(*(x[f].alias(f) for f in ("line", "bare", "more", "opens", "category", "items")), (m == "+").alias("continues")))

    def row(lines: Column) -> Column:
        items = F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, x["items"]).otherwise(x["bare"])), " ")
        said = trim(sub(sub(items, f"{WS}*,{WS}*", ", "), f",+{END}"))
        return F.when(lines[0]["opens"], F.concat(lines[0]["category"], F.lit(": "), said)).otherwise(lines[0]["line"])

    rows = split_at(bind(parsed(F.split(text, "\n")), marked), lambda xs, i: ~xs[i]["continues"], f"array<{_LINE}>")
    return F.array_join(F.transform(rows, row), "\n")


def normalize(text: Column, config: Config) -> Column:
    """All steps in their fixed order."""
    out = newlines(text)
    out = dashes(out, config) if config.do_dashes else out
    out = bullets(out, config) if config.do_bullets else out
    out = labels(out, config)
    out = tables(out, config) if config.do_tables else out
    return trim(spaces(out) if config.do_spaces else out)


def clean_spaces(text: Column, config: Config) -> Column:
    """Spaced punctuation drawn together, one trailing comma dropped, trimmed."""
    drawn = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), config.space_pairs, text)
    return trim(sub(drawn, rf",{WS}*{END}"))


def clean_phone(text: Column) -> Column:
    steps = ((rf"\({WS}+", "("), (rf"{WS}+\)", ")"), (f"{WS}+-{WS}+", "-"), (rf"\+{WS}+", "+"), (f"{WS}+", " "))
    return trim(reduce(lambda t, s: sub(t, *s), steps, text))


def _alias(text: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return text
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return bind(text, lambda t: F.coalesce(some(F.try_element_at(known, F.lower(t))), t))


def skill_name(text: Column, config: Config) -> Column:
    return _alias(clean_spaces(sub(trim(text), rf"[,.]{END}"), config), config.rule("SKILL").aliases)


def certificate_name(text: Column, config: Config) -> Column:
    plain = sub(clean_spaces(sub(trim(text), rf"[,.]{END}"), config), rf"(?iu)\Athe{WS}+")
    return _alias(plain, config.rule("CERT").aliases)


#: Noise of the OCR engine; fixed pattern.
OCR_NOISE = r"(?m)^ObjectCache\([^\n]*WARNING! LEAK![^\n]*$"


def extractor_warnings(stderr: Column) -> Column:
    """An extractor's error stream without its known noise lines."""
    return trim(sub(sub(stderr, OCR_NOISE), r"\n{3,}", "\n\n"))
