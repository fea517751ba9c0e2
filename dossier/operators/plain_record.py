"""`text.normalize`, `sections.fill_missing` and the folds of `assemble` as plain functions, for Arrow passes; see `plain`."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import Any

from dossier.config import Config
from dossier.functions.jsre import ANY, NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACES
from dossier.operators.infer import JUNE, MONTHS
from dossier.operators.plain import END, LABEL, START, TEXT, Clean, Span
from dossier.operators.sections import HEADERS, SCORE

_WS = f"[{re.escape(SPACES)}]"
_WS_IN = re.escape(SPACES)
_ANY = ANY.replace(r"\x{2028}\x{2029}", r"\u2028\u2029")
_ITEM = rf"([A-Za-z0-9#.+]{_ANY}+)\Z"
_SPACED, _FEEDS, _COMMA, _COMMAS = re.compile(f"{_WS}+"), re.compile(r"\r\n?"), re.compile(f"{_WS}*,{_WS}*"), re.compile(r",+\Z")
_WIDE = re.compile(rf"\A([A-Za-z][A-Za-z{_WS_IN}&/()-]{{2,40}}?){_WS}{{2,}}{_ITEM}")
_MORE = re.compile(rf"\A{_WS}{{2,}}[A-Za-z0-9#.+]")
_BLANKS = re.compile(" {2,}")
_BULLET = re.compile(rf"\A[-●•▪■▸►‣⁃]{_WS}*")
_FEW_LETTERS = re.compile(r"\A(?:[^A-Za-z]*+[A-Za-z]){0,30}+[^A-Za-z]*+\Z")
_CATEGORY = re.compile(rf"\A[A-Za-z{_WS_IN}&/()-]+:{_WS}*({_ANY}+)\Z")
_PARTS = re.compile(rf"{_WS}*[,|]{_WS}*|{_WS}+-{_WS}+")
_NAME = re.compile(rf"\A([A-Z][a-z]+(?:{_WS}[A-Z][a-z]+)?)")
_NOT_HEADER = {keep: re.compile(f"[^a-z{_WS_IN}{keep}]") for keep in ("", "&")}
_LAST_COMMA, _YEAR = re.compile(rf",{_WS}*\Z"), re.compile(rf"\A([0-9]{{4}}){_WS}*({_ANY}*)\Z")
_LAST_YEAR, _THE, _LIST, _LAST_MARK = re.compile(rf",?{_WS}*[0-9]{{4}}{_WS}*\Z"), re.compile(rf"(?i)\Athe{_WS}+"), re.compile(f",{_WS}*"), re.compile(r"[,.]\Z")
_PHONE = [(re.compile(a), b) for a, b in ((rf"\({_WS}+", "("), (rf"{_WS}+\)", ")"), (f"{_WS}+-{_WS}+", "-"), (rf"\+{_WS}+", "+"), (f"{_WS}+", " "))]
_OPENS = {header: name for name, headers in reversed(HEADERS.items()) for header in headers}


def normalizer(config: Config) -> Callable[[str], str]:
    """`text.normalize`."""
    bullet = re.compile(rf"(?:\A|(?<=[\n\r\u2028\u2029]))[{re.escape(''.join(config.bullets))}]{_WS}*") if config.do_bullets and config.bullets else None
    word = lambda x: x[0].isascii() and (x[0].isalnum() or x[0] == "_")
    labels = [re.compile(f"(?i){NOT_AFTER_WORD if word(x) else '(?<=[A-Za-z0-9_])'}{re.escape(x)}{_WS}*") for x in config.strip_labels if x]
    names = "|".join(map(re.escape, sorted(config.table_categories, key=len, reverse=True)))
    named = re.compile(rf"(?i)\A({names}){_WS}+{_ITEM}")

    def tables(text: str) -> str:
        rows: list[str] = []
        category, items = None, []  # of the open row

        def close() -> None:
            said = _COMMAS.sub("", _COMMA.sub(", ", " ".join(items))).strip(SPACES)
            rows.append(f"{category}: {said}")

        for line in text.split("\n"):
            bare = line.strip(SPACES)
            by_name = named.search(bare)
            if category is not None and (_MORE.search(line) or (not by_name and "," in bare and len(bare) < config.table_max_chars and "A" <= bare[0] <= "Z")):
                items.append(bare)
                continue
            if category is not None:
                close()
                category = None
            found = by_name or _WIDE.search(line)
            first = found[2].strip(SPACES) if found else ""
            listed, words = "," in first, len(_SPACED.split(first))
            if (by_name or listed) and words <= config.table_max_words and (listed or words <= 5):
                category, items = found[1].strip(SPACES), [first]
            else:
                rows.append(line)
        if category is not None:
            close()
        return "\n".join(rows)

    def normalized(text: str) -> str:
        out = "\n".join(line.rstrip(SPACES) for line in _FEEDS.sub("\n", text).split("\n"))
        if config.do_dashes:
            for a, b in config.dashes.items():
                out = out.replace(a, b) if a else out
        if bullet:
            out = bullet.sub(lambda _: config.bullet_replacement, out)
        for label in labels:
            out = label.sub("", out)
        if config.do_tables and config.table_categories:
            out = tables(out)
        return (_BLANKS.sub(" ", out) if config.do_spaces else out).strip(SPACES)

    return normalized


def detect_sections(text: str) -> list[tuple[str, int, int]]:
    """Name, start and end of each section, as `sections.detect_sections` finds them."""
    heads, at = [], 0
    for line in text.split("\n"):
        if _FEW_LETTERS.search(line):
            bare = line.strip(SPACES)
            name = _OPENS.get(_NOT_HEADER["&"].sub("", (bare[:-1] if bare.endswith(":") else bare).lower()).strip(SPACES))
            if name:
                heads.append((name, at))
        at += len(line) + 1
    ends = [start for _, start in heads[1:]] + [len(text)]
    return [(name, start, end) for (name, start), end in zip(heads, ends, strict=False)]


def _lines(text: str) -> list[str]:
    return [_BULLET.sub("", x.strip(SPACES)) for x in text.split("\n")]


def _list_items(text: str) -> list[str]:
    out = []
    for x in _lines(text):
        if 1 <= len(x) <= 120:
            found = _CATEGORY.search(x)
            out += (y.strip(SPACES).rstrip(".,;:") for y in _PARTS.split(found[1] if found else x))
    return [x for x in out if 3 <= len(x) <= 49]


def _is_header(line: str, keep: str, of: str) -> bool:
    return _NOT_HEADER[keep].sub("", line.lower()).strip(SPACES) in HEADERS[of]


def missing_spans(text: str, there: list[Span]) -> list[Span]:
    """`sections.missing_spans`."""
    out: list[Span] = []
    for name, start, end in detect_sections(text):
        body = text[start:end]
        if name == "skills":
            feed = body.find("\n") + 1
            start, body = start + feed, body[feed:] if feed else ""
            label, items = "SKILL", _list_items(body)
        elif name == "certifications":
            label, items = "CERT", [x for x in _lines(body) if 5 <= len(x) <= 100 and not _is_header(x, "&", name)]
        else:
            spoken = [_NAME.search(x) for x in _lines(body) if 3 <= len(x) <= 60 and not _is_header(x, "", "languages")]
            label, items = "LANGUAGE", [m[1] for m in spoken if m]
        for item in items:
            at = body.find(item)
            if at >= 0:
                a, b = start + at, start + at + len(item)
                if not any(s[START] < b and s[END] > a for s in there):
                    out.append([label, item, a, b, "B", SCORE])
    return out


def fill_missing(text: str, there: list[Span]) -> list[Span]:
    """`sections.fill_missing`."""
    return sorted([*there, *missing_spans(text, there)], key=lambda s: s[START])


_MONTHS = [(re.compile(rf"{name}{_WS}+([0-9]{{4}})"), i) for name, i in MONTHS]
_ANY_YEAR = re.compile(rf"{NOT_AFTER_WORD}((?:19|20)[0-9]{{2}}){NOT_BEFORE_WORD}")


@lru_cache(1 << 14)
def month_index(text: str) -> int | None:
    """`infer.month_index`."""
    low = text.lower()
    named = next((int(m[1]) * 12 + i for p, i in _MONTHS if (m := p.search(low))), None)
    year = _ANY_YEAR.search(text) if named is None else None
    return int(year[1]) * 12 + JUNE if year else named


def experience_years(roles: Iterable[tuple], config: Config, now: int) -> int | None:
    """`infer.experience_years`; `now` is the month, as `month_index` gives it, that ends open roles."""
    present = re.compile("(?i)" + "|".join(map(re.escape, config.present_words)))
    total = 0
    for *_, start, end in roles:
        a = month_index(start) if start else None
        b = now if not end or present.search(end) else month_index(end)
        n = b - a if a is not None and b is not None else 0
        total += n if 0 < n < config.max_months else 0
    return total // 12 if total > 0 else None


def _keep_first(values: Iterable[str]) -> list[str]:
    seen: dict[str, str] = {}
    for x in values:
        seen.setdefault(x.lower(), x)
    return list(seen.values())


def assembler(config: Config, clean: Clean, now: int) -> Callable[[list[Span]], dict[str, Any]]:
    """From spans to personal, experience, education, skills, certifications and years, as the functions of `assemble` give them;
    names of persons and skills have their spaces cleaned as well, as in records."""
    present = "|".join(map(re.escape, config.present_words))
    open_end = re.compile(rf"(?i)\A({_ANY}+?){_WS}+({present})\Z")
    separators = [(x.lower(), re.compile(f"(?i){re.escape(x.strip())}")) for x in config.separators]
    skill, certificate = config.rule("SKILL"), config.rule("CERT")
    exceptions = frozenset(e.lower() for e in skill.exceptions)

    def tidy(text: str) -> str:
        for a, b in config.space_pairs:
            text = text.replace(a, b) if a else text
        return _LAST_COMMA.sub("", text).strip(SPACES)

    def some(text: str | None) -> str | None:
        return (tidy(text) or None) if text is not None else None

    def phone(text: str) -> str:
        for a, b in _PHONE:
            text = a.sub(b, text)
        return text.strip(SPACES)

    def personal(spans: list[Span]) -> dict[str, str | None]:
        first = lambda label, f: next((y for s in spans if s[LABEL] == label and (y := f(s[TEXT]))), None)
        name = first("NAME", lambda x: x)
        return {"name": name if name is None else tidy(name), "email": first("EMAIL", lambda x: clean("EMAIL", x)), "phone": first("PHONE", phone), "location": first("LOCATION", tidy)}

    def roles(spans: list[Span]) -> list[tuple]:
        out, (title, company, start, end) = [], (None, None, None, None)
        for s in spans:
            label, text = s[LABEL], s[TEXT]
            if label == "TITLE":
                if title is not None and (company is not None or start is not None):
                    out.append((title, company, start, end))
                    company = start = end = None
                title = tidy(text) or None
            elif label == "COMPANY":
                if company is not None and (title is not None or start is not None):
                    out.append((title, company, start, end))
                    title = start = end = None
                company = tidy(clean("COMPANY", text) or "") or None
            elif label == "DATE":
                value = text.strip("| ")
                if not value:
                    continue
                since, year = open_end.search(value), _YEAR.search(value)
                if since and start is None:
                    start, end = since[1].strip(SPACES) or None, since[2]
                elif year and end is None and start is not None and start.isascii() and start.isalpha():
                    start, end = f"{start} {year[1]}", year[2].strip(SPACES) or None
                elif start is not None and end is not None and (title is not None or company is not None):
                    out.append((title, company, start, end))
                    title, company, start, end = None, None, value, None
                elif start is None:
                    start = value
                elif end is None:
                    end = value
        return [*out, (title, company, start, end)] if title is not None or company is not None else out

    def experience(spans: list[Span]) -> list[tuple]:
        every = []
        for title, company, start, end in roles(spans):
            title, company, start, end = some(title), some(company), some(start), some(end)
            hit = next((p for low, p in separators if low in title.lower()), None) if title is not None and company is None else None
            if hit:
                parts = hit.split(title)
                title, company = some(parts[0]), some(parts[1]) if len(parts) > 1 else None
            every.append((title, company, start, end))
        more = [r[1] is not None or r[2] is not None for r in every]
        if any(more[1:]):
            every = every[next((i for i, r in enumerate(every) if r[0] is None or more[i]), 0) :]
        return [r for r in dict.fromkeys(every) if any(x is not None for x in r)]

    def education(spans: list[Span]) -> list[tuple]:
        out, (degree, field, institution) = [], (None, None, None)
        for s in spans:
            label = s[LABEL]
            if label == "DEGREE":
                if degree is not None:
                    out.append((degree, field, institution))
                    field = institution = None
                degree = some(s[TEXT])
            elif label == "FIELD":
                field = some(s[TEXT])
            elif label == "INSTITUTION":
                place = some(s[TEXT])
                out.append((degree, field, (_LAST_YEAR.sub("", place) or None) if place is not None else None))
                degree = field = institution = None
        if degree is not None or institution is not None:
            out.append((degree, field, institution))
        return [e for e in dict.fromkeys(tuple(map(some, e)) for e in out) if any(x is not None for x in e)]

    def skill_names(text: str) -> Iterable[str]:
        for x in _LIST.split(text):
            x = tidy(_LAST_MARK.sub("", x.strip(SPACES)))
            x = skill.aliases.get(x.lower()) or x
            if x and (len(x) >= skill.least or x == x.upper() or x.lower() in exceptions):
                yield x

    def certificate_name(text: str) -> str:
        x = _THE.sub("", tidy(_LAST_MARK.sub("", text.strip(SPACES))))
        return certificate.aliases.get(x.lower()) or x

    def assembled(spans: list[Span]) -> dict[str, Any]:
        ordered = sorted(spans, key=lambda s: s[START])
        done = experience(ordered)
        return {
            "personal": personal(spans), "experience": done, "experience_years": experience_years(done, config, now), "education": education(ordered),
            "skills": [tidy(x) for x in _keep_first(x for s in spans if s[LABEL] == "SKILL" for x in skill_names(s[TEXT]))],
            "certifications": _keep_first(x for s in spans if s[LABEL] == "CERT" if len(x := certificate_name(s[TEXT])) > 1),
        }

    return assembled
