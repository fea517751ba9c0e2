"""The operators of `spans` as plain functions, for Arrow passes over many texts: the same results, about ten times as fast,
since Spark interprets each node of a lambda for each element. The tests hold the two forms against each other.

A span is a list of label, text, start, end, bio and score; a token a tuple of entity, word, start, end and score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import Any

from dossier.config import Config
from dossier.functions.jsre import SPACES

Span = list[Any]
Clean = Callable[[str | None, str | None], str | None]

LABEL, TEXT, START, END, BIO, SCORE = range(6)
#: What a memo of cleaned texts holds before it begins anew, and the longest text that it holds.
REMEMBERED, LONGEST = 1 << 17, 64

_WS = f"[{re.escape(SPACES)}]"
_EDGES = ",.;:|/-" + SPACES
_SOLID = re.compile(r"[A-Za-z0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_NOT_FIRST = re.compile(r"\A[^a-zA-Z0-9]+")
_STATE = re.compile(rf",?{_WS}+[A-Z]{{2}}\Z")
_SPACED = re.compile(f"{_WS}+")


def cleaner(config: Config) -> Clean:
    """`spans.clean_entity` for a label and a text; short texts are remembered."""
    email, company = config.rule("EMAIL"), config.rule("COMPANY")
    prefixes = [re.compile(rf"(?i)\A{re.escape(p)}{_WS}*") for p in email.strip_prefixes]
    rejected = [p.lower() for p in email.reject_patterns]
    companies = config.company_set
    lists = {name: (frozenset(e.lower() for e in rule.exceptions), frozenset(w.lower() for w in rule.blocked_words)) for name, rule in config.rules.items()}
    memo: dict[tuple[str | None, str | None], str | None] = {}

    def shaped(label: str | None, text: str) -> str | None:
        if label == "EMAIL":
            text = _SPACED.sub("", text)
            for prefix in prefixes:
                text = prefix.sub("", text)
            text = _NOT_FIRST.sub("", text)
            low = text.lower()
            return text if email.require in text and not any(p in low for p in rejected) else None
        if label == "SKILL":
            return text.rstrip(",.;:")
        if label == "COMPANY" and company.strip_trailing_state_code:
            return _STATE.sub("", text).strip(SPACES)
        return text.strip("| ") if label == "DATE" else text

    def cleaned(label: str | None, raw: str) -> str | None:
        if raw.isalnum() and raw.isascii():  # nothing to collapse or trim
            text = raw
        else:
            text = _SPACED.sub(" ", raw).strip(_EDGES)
            if not _SOLID.search(text):
                return None
        if len(text) == 1 and not _LETTER.search(text):
            return None
        out = shaped(label, text)
        if not out:
            return None
        rule = config.rules.get(label)
        if rule is None:
            return out if len(out) >= 2 else None
        (exceptions, blocked), low = lists[label], out.lower()
        if low in blocked:
            return None
        fit = len(out) >= rule.least or low in exceptions or (rule.gazetteer_bypass and low in companies) or (rule.uppercase_bypass and out == out.upper())
        return out if fit else None

    def remembered(label: str | None, raw: str | None) -> str | None:
        try:
            return memo[label, raw]
        except KeyError:
            pass
        out = None if raw is None else cleaned(label, raw)
        if raw is None or len(raw) <= LONGEST:
            if len(memo) >= REMEMBERED:
                memo.clear()
            memo[label, raw] = out
        return out

    return remembered


@lru_cache(1024)
def _kind(entity: str | None) -> tuple[str, str]:
    """Label and bio of an entity."""
    entity = entity or "O"
    return (entity[2:], entity[0]) if entity[:2] in ("B-", "I-") else (entity, "O")


def merge_subwords(tokens: Iterable[tuple]) -> list[Span]:
    """`spans.merge_subwords`."""
    out: list[Span] = []
    last, more = None, []  # the last kept span and what its text gains
    begun = kept = False  # whether there is a word before, and whether it is part of a kept span
    for entity, word, start, end, score in tokens:
        word = word or ""
        if word[:2] == "##":
            word = word[2:]
            if begun:
                if kept:
                    more.append(word)
                    last[END] = end or last[END]
                continue
        begun = True
        label, bio = _kind(entity)
        kept = label != "O"
        if not kept:
            continue
        if bio == "I" and last and last[LABEL] == label:
            more += (" ", word)
            last[END] = end or 0
            continue
        if more:
            last[TEXT] += "".join(more)
            more = []
        last = [label, word, start or 0, end or 0, bio, score or 0.0]
        out.append(last)
    if more:
        last[TEXT] += "".join(more)
    return out


def clean_spans(spans: Iterable[Span], clean: Clean) -> list[Span]:
    """`spans.clean_spans`."""
    return [[s[LABEL], text, *s[START:]] for s in spans if (text := clean(s[LABEL], s[TEXT])) is not None]


def merge_neighbours(spans: Iterable[Span], config: Config) -> list[Span]:
    """`spans.merge_neighbours`, of spans with starts, ends and texts."""
    labels, gap = config.merge_labels, config.merge_gap
    out: list[Span] = []
    last, more = None, []  # the last span and what its text gains
    for s in spans:
        label = s[LABEL]
        if label in labels and last and last[LABEL] == label and s[START] - last[END] <= gap:
            if not more:
                out[-1] = last = last[:]
            more += (" ", s[TEXT])
            last[END], last[SCORE] = s[END], max(last[SCORE], s[SCORE])
            continue
        if more:
            last[TEXT] += "".join(more)
            more = []
        last = s
        out.append(s)
    if more:
        last[TEXT] += "".join(more)
    return out


def relabel_companies(spans: Iterable[Span], config: Config) -> list[Span]:
    """`spans.relabel_companies`."""
    return [["COMPANY", *s[TEXT:]] if s[LABEL] == "TITLE" and s[TEXT].lower().strip(SPACES) in config.company_set else s for s in spans]


def strip_dates(spans: Iterable[Span], config: Config) -> list[Span]:
    """`spans.strip_dates`."""
    words = "|".join([*map(re.escape, config.date_words), "[0-9]{4}"])
    dated = re.compile(rf"(?i)(?:(?<=[^ ])|\A)(?: (?:{words}))+\Z")
    return [[s[LABEL], dated.sub("", _SPACED.sub(" ", s[TEXT])), *s[START:]] if s[LABEL] == "COMPANY" else s for s in spans]


def split_titles(spans: Iterable[Span], config: Config) -> list[Span]:
    """`spans.split_titles`."""
    out: list[Span] = []
    for s in spans:
        words = s[TEXT].split(" ") if s[LABEL] == "TITLE" and config.companies else []
        n = next((n for n in range(min(config.gazetteer_max_words, len(words)), 0, -1) if " ".join(words[:n]).lower() in config.company_set), 0)
        if n:
            rest = " ".join(words[n:])
            out.append(["COMPANY", " ".join(words[:n]), *s[START:]])
            out += [[s[LABEL], rest, *s[START:]]] if len(rest) > 1 else []
        else:
            out.append(s)
    return out


def pair_skills(spans: Iterable[Span], config: Config) -> list[Span]:
    """`spans.pair_skills`."""
    out: list[Span] = []
    free = False  # whether the last span may take this one
    for s in spans:
        if free and s[LABEL] == "SKILL" and out[-1][LABEL] == "SKILL":
            both = re.sub(r"[,.]\Z", "", f"{out[-1][TEXT]} {s[TEXT]}")
            if both.lower() in config.multi_word_skills:
                first = out[-1]
                out[-1] = [first[LABEL], both, first[START], s[END], *first[BIO:]]
                free = False
                continue
        out.append(s)
        free = True
    return out


def post_process(spans: Iterable[Span], config: Config) -> list[Span]:
    """`spans.post_process`."""
    for step in (merge_neighbours, relabel_companies, strip_dates, split_titles, pair_skills):
        spans = step(spans, config)
    return list(spans)
