"""Operators on spans: cleaning, merging, relabelling, splitting. A document's spans are one array column, so no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.config import Config
from dossier.functions.arrays import bind, split_at
from dossier.functions.jsre import END, WS, WS_IN, in_list, quote, some, sub, trim
from dossier.schema import SPANS, TOKENS


def span(label: Column, text: Column, start: Column, end: Column, bio: Column, score: Column) -> Column:
    return F.struct(label.alias("label"), text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), bio.alias("bio"), score.cast("double").alias("score"))


def empty(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def clean_entity(label: Column, raw: Column, config: Config) -> Column:
    """A cleaned entity text, null if it isn't one. A text of non-ASCII letters only is none either."""
    edge = rf"[,.;:|/\-{WS_IN}]+"
    text = sub(trim(sub(raw, f"{WS}+", " ")), rf"\A{edge}|{edge}{END}")
    of = config.rule

    def email(text: Column) -> Column:
        t = sub(text, f"{WS}+")
        t = reduce(lambda x, p: sub(x, rf"(?iu)\A{quote(p)}{WS}*"), of("EMAIL").strip_prefixes, t)

        def tested(t: Column) -> Column:
            tests = [F.contains(t, F.lit(of("EMAIL").require))] if of("EMAIL").require else []
            tests += [~F.contains(F.lower(t), F.lit(p.lower())) for p in of("EMAIL").reject_patterns]
            return F.when(reduce(and_, tests), t) if tests else t

        return bind(sub(t, r"\A[^a-zA-Z0-9]+"), tested)

    def shaped(x: Column) -> Column:
        label, text = x["label"], x["text"]
        fit = (F.length(text) > 0) & text.rlike("[A-Za-z0-9]") & ((F.length(text) > 1) | text.rlike("[A-Za-z]"))
        company = trim(sub(text, rf",?{WS}+[A-Z]{{2}}{END}")) if of("COMPANY").strip_trailing_state_code else text
        out = (
            F.when(label == "EMAIL", email(text)).when(label == "SKILL", sub(text, rf"[,.;:]+{END}")).when(label == "COMPANY", company)
            .when(label == "DATE", sub(text, rf"\A[| ]+|[| ]+{END}")).otherwise(text)
        )
        return F.struct(label.alias("label"), some(F.when(fit, out)).alias("out"))

    def judged(x: Column) -> Column:
        out = x["out"]

        def by(name: str) -> Column:
            rule = of(name)
            bypass = F.lit(False)
            if rule.gazetteer_bypass:
                bypass = bypass | in_list(F.lower(out), config.companies)
            if rule.uppercase_bypass:
                bypass = bypass | (out == F.upper(out))
            kept = (F.length(out) >= rule.least) | in_list(F.lower(out), tuple(e.lower() for e in rule.exceptions)) | bypass
            return F.when(~in_list(F.lower(out), tuple(w.lower() for w in rule.blocked_words)) & kept, out)

        other = F.when(F.length(out) >= 2, out)
        return reduce(lambda rest, name: F.when(x["label"] == name, by(name)).otherwise(rest), config.rules, other)

    return bind(bind(F.struct(label.alias("label"), text.alias("text")), shaped), judged)


def clean_spans(spans: Column, config: Config) -> Column:
    """Every span cleaned, those that aren't entities dropped."""
    cleaned = F.transform(spans, lambda s: s.withField("text", clean_entity(s["label"], s["text"], config)))
    return F.filter(cleaned, lambda s: s["text"].isNotNull())


def merge_subwords(tokens: Column) -> Column:
    """Tokens to spans: `##` pieces are glued to the token before, whatever its label; then `I-` tokens join the last kept
    span of their label, also across tokens outside any entity."""
    word_of = lambda t: F.coalesce(t["word"], F.lit(""))
    plain = lambda t: F.when(word_of(t).startswith("##"), F.substr(word_of(t), F.lit(3))).otherwise(word_of(t))

    def glued(run: Column) -> Column:
        t = run[0]
        entity = F.coalesce(some(t["entity"]), F.lit("O"))
        bio = F.when(entity.startswith("B-"), "B").when(entity.startswith("I-"), "I").otherwise("O")
        ends = F.filter(F.transform(run, lambda x: F.coalesce(x["end"], F.lit(0))), lambda x: x != 0)
        return span(sub(entity, r"\A[BI]-"), F.array_join(F.transform(run, plain), ""), F.coalesce(t["start"], F.lit(0)), F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)), bio, F.coalesce(t["score"], F.lit(0.0)))

    words = F.transform(split_at(tokens, lambda ts, i: ~word_of(ts[i]).startswith("##"), TOKENS), glued)
    inside = lambda ss, i: F.coalesce((ss[i - 1]["label"] == ss[i]["label"]) & (ss[i]["bio"] == "I"), F.lit(False))
    return merge_runs(F.filter(words, lambda s: s["label"] != "O"), inside)


def merge_runs(spans: Column, joins, score=lambda run: run[0]["score"]) -> Column:
    """Neighbours are made one wherever joins(spans, place of the later one) holds: texts with spaces between them, from the
    first one's start to the last one's end. A merged span's end and label are those of its last part, so looking at
    neighbours only is looking at what was merged so far."""

    def merged(run: Column) -> Column:
        return span(run[0]["label"], F.array_join(F.transform(run, lambda s: s["text"]), " "), run[0]["start"], F.element_at(run, -1)["end"], run[0]["bio"], score(run))

    return F.transform(split_at(spans, lambda ss, i: ~joins(ss, i), SPANS), merged)


def merge_neighbours(spans: Column, config: Config) -> Column:
    """Spans of one of the merge labels join the span before if it has the label and ends at most a gap before."""

    def near(ss: Column, i: Column) -> Column:
        last, s = ss[i - 1], ss[i]
        return F.coalesce(in_list(s["label"], config.merge_labels) & (last["label"] == s["label"]) & (s["start"] - last["end"] <= config.merge_gap), F.lit(False))

    return merge_runs(spans, near, lambda run: F.array_max(F.transform(run, lambda s: s["score"])))


def relabel_companies(spans: Column, config: Config) -> Column:
    """Titles that are a known company become companies."""
    known = lambda s: (s["label"] == "TITLE") & in_list(trim(F.lower(s["text"])), config.companies)
    return F.transform(spans, lambda s: F.when(known(s), s.withField("label", F.lit("COMPANY"))).otherwise(s))


def strip_dates(spans: Column, config: Config) -> Column:
    """Date words and years at a company's end go, but its first word stays; words end up joined by single spaces."""
    words = "|".join([*(quote(w) for w in config.date_words), r"[0-9]{4}"])
    bare = lambda s: sub(sub(s["text"], f"{WS}+", " "), rf"(?iu)(?<=[^ ]|\A)(?: (?:{words}))+{END}")
    return F.transform(spans, lambda s: F.when(s["label"] == "COMPANY", s.withField("text", bare(s))).otherwise(s))


def split_titles(spans: Column, config: Config) -> Column:
    """A title that begins with a known company gives the company (longest such beginning) and the rest, if it is longer than 1."""

    def parts(s: Column) -> Column:
        words = F.split(s["text"], " ")
        head = lambda n: F.array_join(F.slice(words, 1, n), " ")
        found = F.filter(F.sequence(F.lit(config.gazetteer_max_words), F.lit(1), F.lit(-1)), lambda n: (n <= F.size(words)) & in_list(F.lower(head(n)), config.companies))
        n = F.get(found, F.lit(0))
        rest = F.array_join(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), " ")
        company = s.withField("label", F.lit("COMPANY")).withField("text", head(n))
        both = F.when(F.length(rest) > 1, F.array(company, s.withField("text", rest))).otherwise(F.array(company))
        return F.when((s["label"] == "TITLE") & n.isNotNull(), both).otherwise(F.array(s))

    return F.flatten(F.transform(spans, parts)) if config.companies and config.gazetteer_max_words > 0 else spans


def pair_skills(spans: Column, config: Config) -> Column:
    """Two skills in a row whose joined text is a known skill become one; a joined pair takes no third.

    In a run of skills each of which would join the one before, the first joins the second, the third the fourth, and so on.
    """
    if not config.multi_word_skills:
        return spans
    both = lambda a, b: sub(F.concat(a["text"], F.lit(" "), b["text"]), rf"[,.]{END}")

    def alone(ss: Column, i: Column) -> Column:
        a, b = ss[i - 1], ss[i]
        return ~F.coalesce((a["label"] == "SKILL") & (b["label"] == "SKILL") & in_list(F.lower(both(a, b)), config.multi_word_skills), F.lit(False))

    def paired(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(run), F.lit(2)), lambda i: F.slice(run, i, F.lit(2)))
        joined = lambda p: span(p[0]["label"], both(p[0], p[1]), p[0]["start"], p[1]["end"], p[0]["bio"], p[0]["score"])
        return F.transform(pairs, lambda p: F.when(F.size(p) == 2, joined(p)).otherwise(p[0]))

    return F.flatten(F.transform(split_at(spans, alone, SPANS), paired))


def post_process(spans: Column, config: Config) -> Column:
    """Merge, relabel, strip, split, pair: once each, in this order."""
    for step in (merge_neighbours, relabel_companies, strip_dates, split_titles, pair_skills):
        spans = step(spans, config)
    return spans
