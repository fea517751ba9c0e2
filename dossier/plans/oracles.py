"""DuckDB SQL that gives the rows of the registered queries. It is written relationally (windows, islands, recursion over
steps) where the engine folds arrays, so that the two can disagree."""

from __future__ import annotations

from dossier.operators.infer import FULL, MONTHS
from dossier.operators.score import COUNTED, ISSUES, VERBS
from dossier.operators.sections import HEADERS
from dossier.plans import fixtures as fx

AS_OF_INDEX = 2003 * 12
S = fx.SETTINGS
POST = S["post_processing"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tidy(x: str) -> str:
    """Spaced punctuation drawn together, a trailing comma dropped."""
    for a, b in POST["space_collapse_pairs"]:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return trim(rf"regexp_replace({x}, ',\s*$', '')")


def phone(x: str) -> str:
    for a, b in ((r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+-\s+", "-"), (r"\+\s+", "+"), (r"\s+", " ")):
        x = f"regexp_replace({x}, {q(a)}, {q(b)}, 'g')"
    return trim(x)


def month_index(d: str) -> str:
    low = f"lower(trim({d}))"
    named = " ".join(rf"WHEN regexp_matches({low}, '{n}\s+\d{{4}}') THEN CAST(regexp_extract({low}, '{n}\s+(\d{{4}})', 1) AS INT) * 12 + {i}" for n, i in MONTHS)
    return rf"(CASE {named} WHEN regexp_matches({d}, '\b(19|20)\d{{2}}\b') THEN CAST(regexp_extract({d}, '\b((19|20)\d{{2}})\b', 1) AS INT) * 12 + 5 END)"


assert len(FULL) == 12
PRESENT = "|".join(POST["present_words"])

F1 = fx.duck(fx.TOKENS_SQL)
F2, F3 = fx.duck(fx.EXPERIENCE_SQL), fx.duck(fx.PERSON_SQL)
F4, F5, F6 = fx.duck(fx.TEXT_SQL), fx.duck(fx.SPANS_SQL), fx.duck(fx.PARAGRAPHS_SQL)

# ---- records: persons, roles, and what is derived of them

_LEVELS = [(i, level, word) for i, (level, words) in enumerate(S["seniority_keywords"].items()) for word in words]
_PLACES = [*S["country_name_aliases"].items(), *S["city_country_map"].items()]
#: p: doc_id, name, email, phone, location, raw_text, skill_n, cert_n, study_n, has_degree, has_field, has_institution; e: roles.
DERIVED = f"""
words(rank, level, word) AS (VALUES {", ".join(f"({i}, {q(level)}, {q(w)})" for i, level, w in _LEVELS)}),
spans AS (SELECT *, CASE WHEN end_date IS NULL OR regexp_matches(end_date, '(?i){PRESENT}') THEN {AS_OF_INDEX} ELSE {month_index("end_date")} END - {month_index("start_date")} AS months FROM e),
y AS (SELECT doc_id, CAST(floor(nullif(sum(months) FILTER (months > 0 AND months < {POST['max_experience_months']}), 0) / 12) AS INT) AS experience_years FROM spans GROUP BY doc_id),
t AS (SELECT doc_id, arg_min(level, rank) AS level FROM e JOIN words ON contains(lower(title), word) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, count(title) AS titles, count(company) AS companies, count(start_date) AS dates, count(*) FILTER (regexp_matches(start_date, '[a-zA-Z]')) AS months FROM e GROUP BY doc_id),
r AS (SELECT p.*, coalesce(n.n, 0) AS n, coalesce(titles, 0) AS titles, coalesce(companies, 0) AS companies, coalesce(dates, 0) AS dates, coalesce(months, 0) AS months, experience_years,
  coalesce(level, CASE {" ".join(f"WHEN experience_years >= {S['seniority_by_years'][x]} THEN '{x}'" for x in ("Staff", "Senior", "Mid"))} WHEN experience_years IS NOT NULL THEN 'Junior'
    {" ".join(f"WHEN coalesce(n.n, 0) >= {k} THEN '{x}'" for x, k in sorted(S["seniority_by_experience_count"].items(), key=lambda x: -x[1]))} END) AS seniority,
  CASE {" ".join(f"WHEN starts_with(regexp_replace(phone, '[()-]|[ ]', '', 'g'), {q(a)}) THEN {q(b)}" for a, b in S["phone_country_prefixes"].items())}
    {" ".join(f"WHEN contains(lower(location), {q(a)}) THEN {q(b)}" for a, b in _PLACES)}
    WHEN len(list_intersect(string_split_regex(upper(replace(location, ',', ' ')), '\\s+'), {S["us_states"]})) > 0 THEN 'United States' END AS country,
  regexp_matches(raw_text, '(?i)\\d+%|\\$[\\d,.]+[MBK]?|\\b\\d{{2,}}\\s*({COUNTED})') AS quantified, regexp_matches(raw_text, '(?i)\\b({VERBS})\\b') AS metrics
  FROM p LEFT JOIN n USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN t USING (doc_id)),
c AS (SELECT *, CAST(5 * ((name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (location IS NOT NULL)::INT) AS INT) AS contact,
  CAST(least(least(4 * n, 12) + least(2 * titles, 4) + least(2 * companies, 4) + least(2 * dates, 5), 25) AS INT) AS experience,
  CAST(5 * (study_n > 0)::INT + 4 * has_degree::INT + 3 * has_institution::INT + 3 * has_field::INT AS INT) AS education,
  4 * ((skill_n >= 1)::INT + (skill_n >= 3)::INT + (skill_n >= 5)::INT + (skill_n >= 8)::INT + (skill_n >= 12)::INT) AS skills,
  CASE WHEN quantified THEN 3 ELSE 0 END + CASE WHEN quantified AND metrics THEN 2 ELSE 0 END AS achievements FROM r),
s AS (SELECT *, 2 * (n >= 2)::INT + (n >= 3)::INT + 2 * coalesce(experience_years >= 2, false)::INT + 2 * (cert_n > 0)::INT + 2 * (months > 0)::INT + (n > 0 AND months = n)::INT + 2 * (n > 0 AND titles = n)::INT
  + 2 * (n > 0 AND companies = n)::INT + 2 * (contact = 20)::INT + 2 * (skill_n >= 8)::INT AS formatting FROM c),
rec AS (SELECT *, least(contact + experience + education + skills + formatting + achievements, 100) AS score FROM s)
"""
STUDIED = "SELECT *, doc_id % 4 AS study, (doc_id % 4 <> 0)::INT AS study_n, doc_id % 2 = 1 AS has_degree, doc_id % 4 = 3 AS has_field, doc_id % 4 >= 2 AS has_institution"
RECORDS = f"p AS ({STUDIED} FROM ({F3})), e AS ({F2}), {DERIVED}"
CATEGORIES = ("contact", "experience", "education", "skills", "formatting", "achievements")
_WHEN = {
    "name": "name IS NULL", "email": "email IS NULL", "phone": "phone IS NULL", "location": "location IS NULL", "no_experience": "n = 0", "no_dates": "n > 0 AND dates = 0",
    "some_dates": "dates > 0 AND dates < n", "no_titles": "n > 0 AND titles = 0", "no_companies": "n > 0 AND companies = 0", "no_education": "study_n = 0", "no_skills": "skill_n = 0",
    "few_skills": "skill_n BETWEEN 1 AND 4", "no_certifications": "cert_n = 0", "no_metrics": "n > 0 AND NOT quantified",
}
_COUNT = {"some_dates": "n - dates", "few_skills": "skill_n"}
_ISSUES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS k, {q(ISSUES[name][0])} AS severity, replace({q(ISSUES[name][1])}, '{{}}', CAST({_COUNT.get(name, '0')} AS VARCHAR)) AS message FROM rec WHERE {when}" for i, (name, when) in enumerate(_WHEN.items()))

# ---- spans

MERGED = f"""
f AS ({F1}),
g AS (SELECT *, starts_with(word, '##') AND row_number() OVER (PARTITION BY doc_id ORDER BY pos) > 1 AS piece FROM f),
h AS (SELECT *, sum((NOT piece)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS tok FROM g),
tk AS (SELECT doc_id, tok, arg_min(entity, pos) AS entity, string_agg(CASE WHEN starts_with(word, '##') THEN substr(word, 3) ELSE word END, '' ORDER BY pos) AS text, min(start_off) AS start_off, arg_max(end_off, pos) AS end_off,
  arg_min(score_pct, pos) AS score_pct FROM h GROUP BY doc_id, tok),
lb AS (SELECT *, regexp_replace(entity, '^[BI]-', '') AS label, CASE WHEN starts_with(entity, 'B-') THEN 'B' WHEN starts_with(entity, 'I-') THEN 'I' ELSE 'O' END AS bio FROM tk),
lg AS (SELECT *, bio = 'I' AND coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY tok) = label, false) AS joins FROM lb WHERE label <> 'O'),
il AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY tok) AS island FROM lg),
m AS (SELECT doc_id, CAST(island - 1 AS INT) AS pos, arg_min(label, tok) AS label, string_agg(text, ' ' ORDER BY tok) AS text, min(start_off) AS start_off, arg_max(end_off, tok) AS end_off, arg_min(bio, tok) AS bio,
  arg_min(score_pct, tok) / 100.0::DOUBLE AS score FROM il GROUP BY doc_id, island)
"""


def cleaned(label: str, text: str, companies: tuple[str, ...]) -> str:
    """The cleaned entity as an expression: edge punctuation, then the label's own rules, then blocks and lengths."""
    edge = r"[,.;:|/\-\s]+"
    base = f"regexp_replace({trim(f"regexp_replace({text}, '\\s+', ' ', 'g')")}, '^{edge}|{edge}$', '', 'g')"
    mail = POST["entity_rules"]["EMAIL"]
    email = f"regexp_replace(regexp_replace(regexp_replace(b, '\\s+', '', 'g'), '(?i)^{mail['strip_prefixes'][0].replace('.', '[.]')}\\s*', ''), '^[^a-zA-Z0-9]+', '')"
    shaped = rf"""CASE {label} WHEN 'EMAIL' THEN {email} WHEN 'SKILL' THEN regexp_replace(b, '[,.;:]+$', '') WHEN 'COMPANY' THEN {trim(r"regexp_replace(b, ',?\s+[A-Z]{2}$', '')")} WHEN 'DATE' THEN regexp_replace(b, '^[| ]+|[| ]+$', '', 'g') ELSE b END"""
    rules = POST["entity_rules"]
    cases = []
    for name, rule in rules.items():
        keep = f"length(v) >= {rule['min_length']}"
        if rule.get("exceptions"):
            keep += f" OR lower(v) IN {listed(x.lower() for x in rule['exceptions'])}"
        if rule.get("gazetteer_bypass"):
            keep += f" OR lower(v) IN {listed(x.lower() for x in companies)}"
        if rule.get("uppercase_bypass"):
            keep += " OR v = upper(v)"
        ok = f"({keep})" + (f" AND lower(v) NOT IN {listed(rule['blocked_words'])}" if rule.get("blocked_words") else "")
        if name == "EMAIL":
            ok += " AND contains(v, '@')" + "".join(f" AND NOT contains(lower(v), {q(x)})" for x in rule["reject_patterns"])
        cases.append(f"WHEN {q(name)} THEN {ok}")
    fit = "length(b) > 0 AND regexp_matches(b, '[A-Za-z0-9]') AND (length(b) > 1 OR regexp_matches(b, '[A-Za-z]'))"
    return base, shaped, f"{fit} AND length(v) > 0 AND CASE {label} {' '.join(cases)} ELSE length(v) >= 2 END"


def clean_rows(source: str, keys: str, companies: tuple[str, ...]) -> str:
    base, shaped, ok = cleaned("label", "text", companies)
    return f"SELECT {keys}, label, v AS text, start_off, end_off, score FROM (SELECT *, {shaped} AS v FROM (SELECT *, {base} AS b FROM {source})) WHERE {ok}"


def known(companies: tuple[str, ...]) -> str:
    return listed(x.lower() for x in companies)


def neighbours(rows: str) -> str:
    return f"""WITH l AS (SELECT *, coalesce(label IN {listed(POST['span_merge_labels'])} AND lag(label) OVER w = label AND start_off - lag(end_off) OVER w <= {POST['span_merge_max_gap']}, false) AS joins FROM {rows} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l)
SELECT doc_id, CAST(island - 1 AS INT) AS pos, arg_min(label, pos) AS label, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(start_off, pos) AS start_off, arg_max(end_off, pos) AS end_off FROM i GROUP BY doc_id, island"""


def relabelled(rows: str, companies: tuple[str, ...]) -> str:
    """Known titles as companies, dates stripped off companies."""
    dates = "|".join([*POST["date_words"], r"\d{4}"])
    return f"""WITH r AS (SELECT *, CASE WHEN label = 'TITLE' AND trim(lower(text)) IN {known(companies)} THEN 'COMPANY' ELSE label END AS now FROM {rows})
SELECT doc_id, pos, now AS label, CASE WHEN now = 'COMPANY' THEN regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '(?i)((?: (?:{dates}))+)$', '') ELSE text END AS text, start_off, end_off FROM r"""


def split_titles(rows: str, companies: tuple[str, ...]) -> str:
    heads = " ".join(f"WHEN len(ws) >= {n} AND lower(array_to_string(ws[1:{n}], ' ')) IN {known(companies)} THEN {n}" for n in range(POST["company_gazetteer_match_max_words"], 0, -1))
    return f"""WITH w AS (SELECT *, string_split(text, ' ') AS ws FROM {rows}), n AS (SELECT *, CASE WHEN label <> 'TITLE' THEN NULL {heads} END AS n FROM w),
u AS (SELECT doc_id, pos AS k, 0 AS part, CASE WHEN n IS NULL THEN label ELSE 'COMPANY' END AS label, CASE WHEN n IS NULL THEN text ELSE array_to_string(ws[1:n], ' ') END AS text, start_off, end_off FROM n
  UNION ALL SELECT doc_id, pos, 1, 'TITLE', array_to_string(ws[n + 1:], ' '), start_off, end_off FROM n WHERE length(array_to_string(ws[n + 1:], ' ')) > 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, part) - 1 AS INT) AS pos, label, text, start_off, end_off FROM u"""


def paired(rows: str) -> str:
    return f"""WITH f AS (SELECT *, lead(text) OVER w AS nt, lead(end_off) OVER w AS ne, coalesce(label = 'SKILL' AND lead(label) OVER w = 'SKILL' AND lower(regexp_replace(text || ' ' || lead(text) OVER w, '[,.]$', '')) IN {listed(S['multi_word_skills'])}, false) AS pair FROM {rows} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, pos - sum(pair::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f), h AS (SELECT *, pair AND row_number() OVER (PARTITION BY doc_id, pair, run ORDER BY pos) % 2 = 1 AS first FROM g),
i AS (SELECT *, coalesce(lag(first) OVER (PARTITION BY doc_id ORDER BY pos), false) AS second FROM h)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, label, CASE WHEN first THEN regexp_replace(text || ' ' || nt, '[,.]$', '') ELSE text END AS text, start_off, CASE WHEN first THEN ne ELSE end_off END AS end_off FROM i WHERE NOT second"""


ALL = fx.COMPANIES + fx.SHORT_COMPANIES
S5 = f"s5 AS (SELECT doc_id, pos - 1 AS pos, label, text, start_off, end_off, bio, 1.0 AS score FROM ({F5}))"

# ---- sections of the text fixture

_HEADS = ", ".join(f"({q(h)}, {q(name)})" for name, hs in HEADERS.items() for h in hs)
_BARE = r"regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[-●•▪■▸►‣⁃]\s*', '')"
OF_TEXTS = rf"""
heads(head, name) AS (VALUES {_HEADS}),
ln AS (SELECT doc_id, raw_text, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, raw_text, string_split(raw_text, chr(10)) AS ls FROM d)),
lp AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS loc FROM ln),
hd AS (SELECT lp.doc_id, raw_text, name, loc, lead(loc) OVER (PARTITION BY lp.doc_id ORDER BY loc) AS nxt FROM lp JOIN heads ON head = {trim("regexp_replace(lower(regexp_replace(" + trim("line") + r", ':$', '')), '[^a-z\s&]', '', 'g')")}),
sec AS (SELECT doc_id, name, loc AS start_off, coalesce(nxt, length(raw_text)) AS end_off, substr(raw_text, loc + 1, coalesce(nxt, length(raw_text)) - loc) AS text FROM hd),
sl AS (SELECT doc_id, name, start_off, text, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM sec)),
sb AS (SELECT *, {_BARE} AS bare, substr(text, strpos(text, chr(10)) + 1) AS body, strpos(text, chr(10)) AS feed FROM sl),
sk AS (SELECT doc_id, start_off, feed, body, i, unnest(range(len(ps))) AS j, unnest(ps) AS part FROM (SELECT *, string_split_regex(CASE WHEN regexp_matches(bare, '^[A-Za-z\s&/()-]+:\s*.+$') THEN regexp_extract(bare, '^[A-Za-z\s&/()-]+:\s*(.+)$', 1) ELSE bare END, '\s*[,|]\s*|\s+-\s+') AS ps
  FROM sb WHERE name = 'skills' AND i > 0 AND feed > 0 AND length(bare) BETWEEN 1 AND 120)),
si AS (SELECT doc_id, start_off AS sec, i, j, 'SKILL' AS label, item AS text, start_off + feed + strpos(body, item) - 1 AS start_off FROM (SELECT *, regexp_replace({trim("part")}, '[.,;:]+$', '') AS item FROM sk) WHERE length(item) BETWEEN 3 AND 49),
ce AS (SELECT doc_id, start_off AS sec, i, 0 AS j, 'CERT' AS label, bare AS text, start_off + strpos(text, bare) - 1 AS start_off FROM sb WHERE name = 'certifications' AND length(bare) BETWEEN 5 AND 100
  AND {trim("regexp_replace(lower(bare), '[^a-z\\s&]', '', 'g')")} NOT IN {listed(HEADERS["certifications"])}),
la AS (SELECT doc_id, start_off AS sec, i, 0 AS j, 'LANGUAGE' AS label, lang AS text, start_off + strpos(text, lang) - 1 AS start_off FROM (SELECT *, regexp_extract(bare, '^([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)', 1) AS lang FROM sb WHERE name = 'languages'
  AND length(bare) BETWEEN 3 AND 60 AND {trim("regexp_replace(lower(bare), '[^a-z\\s]', '', 'g')")} NOT IN {listed(HEADERS["languages"])}) WHERE lang <> ''),
gaps AS (SELECT doc_id, sec, i, j, label, text, CAST(start_off AS INT) AS start_off, CAST(start_off + length(text) AS INT) AS end_off FROM (SELECT * FROM si UNION ALL SELECT * FROM ce UNION ALL SELECT * FROM la))
"""


SECTIONS = f"d AS ({F4}), {OF_TEXTS}"


def numbered(rows: str, order: str = "sec, i, j") -> str:
    """Rows of spans with their places in a document."""
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS INT) AS pos, label, text, start_off, end_off FROM {rows}"


#: Gaps of documents with tokens that overlap no span of a date.
FREE = "free AS (SELECT * FROM gaps WHERE EXISTS (SELECT 1 FROM f WHERE f.doc_id = gaps.doc_id) AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = gaps.doc_id AND m.label = 'DATE' AND m.start_off < gaps.end_off AND m.end_off > gaps.start_off))"

# ---- normalisation

_NL = "replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_LINES = rf"regexp_replace({_NL}, '[ \t\f\v]+(\n|$)', '\1', 'g')"
_PLAIN = rf"regexp_replace(replace(replace({_LINES}, '–', '-'), '—', '-'), '(^|\n)[●•▪■▸►‣⁃]\s*', '\1- ', 'g')"
for _label in S["pre_processing"]["strip_labels"]:
    _PLAIN = rf"regexp_replace({_PLAIN}, '(?i)\b{_label}\s*', '', 'g')"
_NAMED, _WIDE = rf"(?i)^({S['pre_processing']['skill_table_categories'][0]})\s+([A-Za-z0-9#.+].+)$", r"^([A-Za-z][A-Za-z\s&/()-]{2,40}?)\s{2,}([A-Za-z0-9#.+].+)$"


def tables(source: str, text: str) -> str:
    """Texts of a source (with raw_text) with their tables flattened; `text` is the expression that they are split of."""
    return rf"""
WITH RECURSIVE d AS ({source}),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split({text}, chr(10)) AS ls FROM d)),
b AS (SELECT *, {trim("line")} AS bare FROM l),
k AS (SELECT *, regexp_matches(bare, '{_NAMED}') AS named, CASE WHEN regexp_matches(bare, '{_NAMED}') THEN regexp_extract(bare, '{_NAMED}', 1) ELSE regexp_extract(line, '{_WIDE}', 1) END AS category,
  CASE WHEN regexp_matches(bare, '{_NAMED}') THEN regexp_extract(bare, '{_NAMED}', 2) WHEN contains(regexp_extract(line, '{_WIDE}', 2), ',') THEN regexp_extract(line, '{_WIDE}', 2) ELSE '' END AS items FROM b),
o AS (SELECT *, regexp_matches(line, '^\s{{2,}}[A-Za-z0-9#.+]') OR (regexp_matches(bare, '^[A-Z]') AND contains(bare, ',') AND NOT named AND length(bare) < 60) AS more,
  items <> '' AND len(string_split_regex({trim("items")}, '\s+')) <= 15 AND (contains(items, ',') OR len(string_split_regex({trim("items")}, '\s+')) <= 5) AS opens FROM k),
w AS (SELECT doc_id, i, opens AS open, false AS joined FROM o WHERE i = 0
  UNION ALL SELECT o.doc_id, o.i, (w.open AND o.more) OR o.opens, w.open AND o.more FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1),
g AS (SELECT o.*, joined, sum((NOT joined)::INT) OVER (PARTITION BY o.doc_id ORDER BY o.i) AS part FROM o JOIN w USING (doc_id, i)),
r AS (SELECT doc_id, part, arg_min(opens, i) AS opens, arg_min(category, i) AS category, arg_min(line, i) AS line, string_agg(CASE WHEN joined THEN bare ELSE {trim("items")} END, ' ' ORDER BY i) AS items FROM g GROUP BY doc_id, part)
SELECT doc_id, string_agg(CASE WHEN opens THEN {trim("category")} || ': ' || {trim("regexp_replace(regexp_replace(items, '\\s*,\\s*', ', ', 'g'), ',+$', '')")} ELSE line END, chr(10) ORDER BY part) AS text FROM r GROUP BY doc_id
"""

# ---- assembly


def keep_first(rows: str, column: str) -> str:
    return f"""one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower({column}) ORDER BY pos, part) AS nth FROM ({rows}))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS INT) AS pos, {column} FROM one WHERE nth = 1"""


def alias(x: str, label: str) -> str:
    return f"CASE lower({x}) {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in POST['entity_rules'][label]['aliases'].items())} ELSE {x} END"


_SKILL, _CERT = tidy(f"regexp_replace({trim('raw')}, '[,.]$', '')"), f"regexp_replace({tidy(f"regexp_replace({trim('raw')}, '[,.]$', '')")}, '(?i)^the\\s+', '')"
_mail = cleaned("'EMAIL'", "text", fx.COMPANIES)
_EMAIL = f"SELECT doc_id, arg_min(v, pos) AS email FROM (SELECT *, {_mail[1]} AS v FROM (SELECT *, {_mail[0]} AS b FROM s5 WHERE label = 'EMAIL')) WHERE {_mail[2]} GROUP BY doc_id"
_WITH = POST["title_company_separators"][0]
_OPEN_END = rf"(?i)^(.+?)\s+({PRESENT})$"


def experience(source: str, companies: tuple[str, ...]) -> str:
    """Roles of the spans s5 that `source` defines."""
    shop = cleaned("'COMPANY'", "text", companies)
    ordered = f"""ord AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_off, pos) AS step, label, text,
  CASE label WHEN 'TITLE' THEN nullif({tidy("text")}, '') WHEN 'COMPANY' THEN (SELECT nullif({tidy("v")}, '') FROM (SELECT {shop[1]} AS v, b FROM (SELECT {shop[0]} AS b)) WHERE {shop[2]}) ELSE nullif(regexp_replace(text, '^[| ]+|[| ]+$', '', 'g'), '') END AS val
  FROM s5 WHERE label IN ('TITLE', 'COMPANY', 'DATE'))"""
    return rf"""
WITH RECURSIVE {source}, {ordered},
k AS (SELECT *, label = 'DATE' AND regexp_matches(val, '{_OPEN_END}') AS closes, label = 'DATE' AND regexp_matches(val, '^\d{{4}}') AS is_year FROM ord),
w AS (SELECT doc_id, 0::BIGINT AS step, NULL::VARCHAR AS t, NULL::VARCHAR AS c, NULL::VARCHAR AS s, NULL::VARCHAR AS e, NULL::VARCHAR AS pt, NULL::VARCHAR AS pc, NULL::VARCHAR AS ps, NULL::VARCHAR AS pe, false AS flushed FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL
  SELECT doc_id, step,
    CASE WHEN label = 'TITLE' THEN val WHEN flush THEN NULL ELSE t END, CASE WHEN label = 'COMPANY' THEN val WHEN flush THEN NULL ELSE c END,
    CASE WHEN label <> 'DATE' THEN CASE WHEN flush THEN NULL ELSE s END WHEN val IS NULL THEN s WHEN rule = 1 THEN trim(regexp_extract(val, '{_OPEN_END}', 1)) WHEN rule = 2 THEN s || ' ' || substr(val, 1, 4) WHEN flush OR s IS NULL THEN val ELSE s END,
    CASE WHEN label <> 'DATE' THEN CASE WHEN flush THEN NULL ELSE e END WHEN val IS NULL THEN e WHEN rule = 1 THEN regexp_extract(val, '{_OPEN_END}', 2) WHEN rule = 2 THEN nullif(trim(substr(val, 5)), '')
      WHEN flush THEN NULL WHEN s IS NULL THEN e WHEN e IS NULL THEN val ELSE e END,
    t, c, s, e, flush
  FROM (SELECT k.doc_id, k.step, k.label, k.val, w.t, w.c, w.s, w.e,
      CASE WHEN k.closes AND w.s IS NULL THEN 1 WHEN k.is_year AND w.e IS NULL AND regexp_matches(w.s, '^[a-zA-Z]+$') THEN 2 ELSE 3 END AS rule,
      CASE k.label WHEN 'TITLE' THEN w.t IS NOT NULL AND (w.c IS NOT NULL OR w.s IS NOT NULL) WHEN 'COMPANY' THEN w.c IS NOT NULL AND (w.t IS NOT NULL OR w.s IS NOT NULL)
        ELSE k.val IS NOT NULL AND w.s IS NOT NULL AND w.e IS NOT NULL AND (w.t IS NOT NULL OR w.c IS NOT NULL) END AS flush
    FROM w JOIN k ON k.doc_id = w.doc_id AND k.step = w.step + 1)),
raw AS (SELECT doc_id, step, pt AS title, pc AS company, ps AS start_date, pe AS end_date FROM w WHERE flushed
  UNION ALL SELECT doc_id, max(step) + 1, arg_max(row(t), step)[1], arg_max(row(c), step)[1], arg_max(row(s), step)[1], arg_max(row(e), step)[1] FROM w GROUP BY doc_id HAVING arg_max(row(t), step)[1] IS NOT NULL OR arg_max(row(c), step)[1] IS NOT NULL),
tid AS (SELECT doc_id, step, nullif({tidy("title")}, '') AS title, nullif({tidy("company")}, '') AS company, nullif({tidy("start_date")}, '') AS start_date, nullif({tidy("end_date")}, '') AS end_date FROM raw),
sp AS (SELECT doc_id, step, CASE WHEN company IS NULL AND contains(lower(title), '{_WITH}') THEN nullif({tidy(f"string_split_regex(title, '(?i){_WITH.strip()}')[1]")}, '') ELSE title END AS title,
  CASE WHEN company IS NULL AND contains(lower(title), '{_WITH}') THEN nullif({tidy(f"string_split_regex(title, '(?i){_WITH.strip()}')[2]")}, '') ELSE company END AS company, start_date, end_date FROM tid),
nb AS (SELECT *, row_number() OVER w AS i, title IS NOT NULL AND company IS NULL AND start_date IS NULL AS bare FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY step)),
ff AS (SELECT doc_id, min(i) FILTER (NOT bare) AS first, bool_or(i > 1 AND (company IS NOT NULL OR start_date IS NOT NULL)) AS later FROM nb GROUP BY doc_id),
kp AS (SELECT nb.*, row_number() OVER (PARTITION BY nb.doc_id, title, company, start_date, end_date ORDER BY i) AS nth FROM nb JOIN ff USING (doc_id) WHERE NOT later OR i >= first)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, title, company, start_date, end_date FROM kp WHERE nth = 1 AND coalesce(title, company, start_date, end_date) IS NOT NULL
"""


def education(source: str) -> str:
    """Studies of the spans s5: an institution closes a record, and so does a degree that meets one."""
    return rf"""
WITH RECURSIVE {source},
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_off, pos) AS step, label, nullif({tidy("text")}, '') AS val FROM s5 WHERE label IN ('DEGREE', 'FIELD', 'INSTITUTION')),
w AS (SELECT doc_id, 0::BIGINT AS step, NULL::VARCHAR AS d, NULL::VARCHAR AS f, NULL::VARCHAR AS od, NULL::VARCHAR AS o_f, NULL::VARCHAR AS oi, false AS out FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL SELECT k.doc_id, k.step, CASE k.label WHEN 'DEGREE' THEN k.val WHEN 'FIELD' THEN w.d END, CASE WHEN k.label = 'FIELD' THEN k.val WHEN k.label = 'DEGREE' AND w.d IS NULL THEN w.f END,
    w.d, w.f, CASE WHEN k.label = 'INSTITUTION' THEN nullif(regexp_replace(k.val, ',?\s*\d{{4}}\s*$', ''), '') END, k.label = 'INSTITUTION' OR (k.label = 'DEGREE' AND w.d IS NOT NULL)
  FROM w JOIN k ON k.doc_id = w.doc_id AND k.step = w.step + 1),
raw AS (SELECT doc_id, step, od AS degree, o_f AS field, oi AS institution FROM w WHERE out
  UNION ALL SELECT doc_id, max(step) + 1, arg_max(row(d), step)[1], arg_max(row(f), step)[1], NULL FROM w GROUP BY doc_id HAVING arg_max(row(d), step)[1] IS NOT NULL),
kp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, degree, field, institution ORDER BY step) AS nth FROM raw WHERE coalesce(degree, field, institution) IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INT) AS pos, degree, field, institution FROM kp WHERE nth = 1
"""

# ---- chunks: one step for each paragraph, sentences of an oversized one packed by a second recursion


def chunks(tokens, limit: int) -> str:
    """Chunks of the paragraph fixture; tokens(x) counts an expression's."""
    return rf"""
WITH RECURSIVE d AS ({F6}),
p AS (SELECT doc_id, text, i, part FROM (SELECT doc_id, text, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS part FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\n{{2,}}'), lambda x: length({trim("x")}) > 0) AS ps FROM d WHERE {tokens("text")} > {limit}))),
w AS (SELECT doc_id, 0::BIGINT AS i, NULL::VARCHAR AS now, 0::BIGINT AS loc, NULL::VARCHAR AS done, NULL::BIGINT AS done_at, NULL::VARCHAR AS whole, NULL::BIGINT AS whole_at FROM (SELECT DISTINCT doc_id FROM p)
  UNION ALL SELECT doc_id, i, CASE WHEN over AND free THEN NULL WHEN over OR free THEN part ELSE now || chr(10) || chr(10) || part END, CASE WHEN over AND free THEN here + length(part) WHEN over OR free THEN here ELSE loc END,
    CASE WHEN over AND NOT free THEN now END, loc, CASE WHEN over AND free THEN part END, here
  FROM (SELECT p.doc_id, p.i, p.part, w.now, w.loc, w.now IS NULL AS free, {tokens("CASE WHEN w.now IS NULL THEN p.part ELSE w.now || '  ' || p.part END")} > {limit} AS over, w.loc + strpos(substr(p.text, w.loc + 1), p.part) - 1 AS here
    FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)),
s AS (SELECT doc_id, i, whole_at, unnest(range(1, len(ss) + 1)) AS j, unnest(ss) AS sentence FROM (SELECT doc_id, i, whole_at, string_split(regexp_replace(whole, '\.\s+', '.' || chr(1), 'g'), chr(1)) AS ss FROM w WHERE whole IS NOT NULL)),
v AS (SELECT doc_id, i, 0::BIGINT AS j, NULL::VARCHAR AS now, whole_at AS loc, NULL::VARCHAR AS done, NULL::BIGINT AS done_at FROM w WHERE whole IS NOT NULL
  UNION ALL SELECT v.doc_id, v.i, s.j, CASE WHEN v.now IS NULL THEN s.sentence WHEN {tokens("v.now || ' ' || s.sentence")} > {limit} THEN s.sentence ELSE v.now || ' ' || s.sentence END,
    CASE WHEN v.now IS NOT NULL AND {tokens("v.now || ' ' || s.sentence")} > {limit} THEN v.loc + length(v.now) + 1 ELSE v.loc END, CASE WHEN v.now IS NOT NULL AND {tokens("v.now || ' ' || s.sentence")} > {limit} THEN v.now END, v.loc
  FROM v JOIN s ON s.doc_id = v.doc_id AND s.i = v.i AND s.j = v.j + 1),
c AS (SELECT doc_id, 0 AS i, 0 AS j, text, 0 AS loc FROM d WHERE {tokens("text")} <= {limit}
  UNION ALL SELECT doc_id, i, 0, done, done_at FROM w WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, max(i) + 1, 0, arg_max(row(now), i)[1], arg_max(loc, i) FROM w GROUP BY doc_id HAVING arg_max(row(now), i)[1] IS NOT NULL
  UNION ALL SELECT doc_id, i, j, done, done_at FROM v WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, i, max(j) + 1, arg_max(now, j), arg_max(loc, j) FROM v GROUP BY doc_id, i)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INT) AS pos, CAST(loc AS INT) AS start_off, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM c
"""

PERSONAL = f"""WITH n AS (SELECT doc_id, arg_min(text, pos) FILTER (label = 'NAME') AS name, arg_min({phone('text')}, pos) FILTER (label = 'PHONE') AS phone, arg_min({tidy('text')}, pos) FILTER (label = 'LOCATION') AS location FROM s5 GROUP BY doc_id),
m AS ({_EMAIL}) SELECT ids.doc_id, name, email, phone, location FROM ids LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
_SKILL_RULE = POST["entity_rules"]["SKILL"]
SKILLS = f"""WITH sp AS (SELECT doc_id, pos, unnest(range(len(ps))) AS part, unnest(ps) AS raw FROM (SELECT doc_id, pos, string_split_regex(text, ',\\s*') AS ps FROM s5 WHERE label = 'SKILL')),
nm AS (SELECT doc_id, pos, part, {alias('x', 'SKILL')} AS skill FROM (SELECT *, {_SKILL} AS x FROM sp)), """ + keep_first(
    f"SELECT * FROM nm WHERE skill <> '' AND (length(skill) >= {_SKILL_RULE['min_length']} OR skill = upper(skill) OR lower(skill) IN {listed(x.lower() for x in _SKILL_RULE['exceptions'])})", "skill")
CERTIFICATIONS = f"WITH nm AS (SELECT doc_id, pos, 0 AS part, {alias('x', 'CERT')} AS certification FROM (SELECT *, {_CERT} AS x FROM (SELECT doc_id, pos, text AS raw FROM s5 WHERE label = 'CERT'))), " + keep_first("SELECT * FROM nm WHERE length(certification) > 1", "certification")

# ---- the whole record: the steps above, one on the other's rows

_ONE = lambda fields: " || ' | ' || ".join(f"coalesce({f}, '-')" for f in fields)
_NORMAL = trim("regexp_replace(text, ' {2,}', ' ', 'g')")
FULL_RECORD = f"""
WITH RECURSIVE {MERGED}, ids AS MATERIALIZED (SELECT DISTINCT doc_id FROM f), raw AS (SELECT * FROM ({F4}) JOIN ids USING (doc_id)),
d AS MATERIALIZED (SELECT doc_id, {_NORMAL} AS raw_text FROM ({tables("SELECT * FROM raw", _PLAIN)})),
c1 AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, label, text, start_off, end_off FROM ({clean_rows('m', 'doc_id, pos', ALL)})),
c2 AS MATERIALIZED ({neighbours('c1')}), c3 AS MATERIALIZED ({relabelled('c2', ALL)}), c4 AS MATERIALIZED ({split_titles('c3', ALL)}), c5 AS MATERIALIZED ({paired('c4')}),
{OF_TEXTS},
free AS (SELECT * FROM gaps WHERE NOT EXISTS (SELECT 1 FROM c5 WHERE c5.doc_id = gaps.doc_id AND c5.start_off < gaps.end_off AND c5.end_off > gaps.start_off)),
every AS (SELECT doc_id, label, text, start_off, end_off, 0 AS kind, pos AS sec, 0 AS i, 0 AS j FROM c5 UNION ALL SELECT doc_id, label, text, start_off, end_off, 1, sec, i, j FROM free),
s5 AS MATERIALIZED ({numbered('every', 'start_off, kind, sec, i, j')}),
person AS (SELECT doc_id, nullif({tidy('name')}, '') AS name, email, phone, location FROM ({PERSONAL})),
roles AS MATERIALIZED (SELECT *, pos AS rn FROM ({experience('u AS (SELECT 1)', ALL)})), studies AS MATERIALIZED ({education('u AS (SELECT 1)')}),
skill AS (SELECT doc_id, pos, {tidy('skill')} AS skill FROM ({SKILLS})), cert AS ({CERTIFICATIONS}),
x AS (SELECT doc_id, count(*) AS n_experience, md5(string_agg({_ONE(('title', 'company', 'start_date', 'end_date'))}, '; ' ORDER BY pos)) AS experience_md5 FROM roles GROUP BY doc_id),
w AS (SELECT doc_id, count(*) AS study_n, md5(string_agg({_ONE(('degree', 'field', 'institution'))}, '; ' ORDER BY pos)) AS education_md5, bool_or(degree IS NOT NULL) AS has_degree, bool_or(field IS NOT NULL) AS has_field, bool_or(institution IS NOT NULL) AS has_institution FROM studies GROUP BY doc_id),
z AS (SELECT doc_id, count(*) AS skill_n, md5(string_agg(skill, '; ' ORDER BY pos)) AS skills_md5 FROM skill GROUP BY doc_id), o AS (SELECT doc_id, count(*) AS cert_n, string_agg(certification, '; ' ORDER BY pos) AS certifications FROM cert GROUP BY doc_id),
p AS (SELECT person.*, raw_text, coalesce(n_experience, 0) AS n_experience, coalesce(experience_md5, md5('')) AS experience_md5, coalesce(study_n, 0) AS study_n, coalesce(education_md5, md5('')) AS education_md5, coalesce(has_degree, false) AS has_degree, coalesce(has_field, false) AS has_field,
  coalesce(has_institution, false) AS has_institution, coalesce(skill_n, 0) AS skill_n, coalesce(skills_md5, md5('')) AS skills_md5, coalesce(cert_n, 0) AS cert_n, coalesce(certifications, '') AS certifications
  FROM person JOIN raw USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN o USING (doc_id)),
e AS (SELECT doc_id, rn, title, company, start_date, end_date FROM roles),
{DERIVED.replace("spans AS (", "spanned AS (").replace("FROM spans GROUP BY", "FROM spanned GROUP BY").replace(" words(rank", " level_words(rank").replace("words(rank, level, word) AS", "level_words(rank, level, word) AS", 1).replace("JOIN words ON", "JOIN level_words ON")},
issues AS (SELECT doc_id, count(*) AS n_issues FROM ({_ISSUES}) GROUP BY doc_id)
SELECT doc_id, name, email, phone, location, CAST(n_experience AS INT) AS n_experience, experience_md5, CAST(study_n AS INT) AS n_education, education_md5, CAST(skill_n AS INT) AS n_skills, skills_md5, certifications, seniority, country, experience_years,
  {", ".join(f"CAST({x} AS INT) AS {x}_score" for x in CATEGORIES)}, CAST(score AS INT) AS score, CAST(coalesce(n_issues, 0) AS INT) AS n_issues FROM rec LEFT JOIN issues USING (doc_id)
"""

_ROLE = "coalesce(title, '-') || ' @ ' || coalesce(company, '-') || ' (' || coalesce(start_date, '-') || ' -> ' || coalesce(end_date, '-') || ')'"
_WIDE_ROLES = ", ".join(f"coalesce(max({f}) FILTER (rn = {i}), '') AS exp_{i}_{f}" for i in range(1, 5) for f in ("title", "company", "start_date", "end_date"))
CSV = f"""
WITH {RECORDS}, x AS (SELECT doc_id, string_agg({_ROLE}, ' || ' ORDER BY rn) AS summary, {_WIDE_ROLES} FROM e GROUP BY doc_id)
SELECT 'r' || rec.doc_id || '.txt' AS input, CASE WHEN rec.doc_id % 50 = 0 THEN 'error' ELSE 'ok' END AS status, coalesce(name, '') AS name, coalesce(email, '') AS email, coalesce(phone, '') AS phone, coalesce(location, '') AS location,
  coalesce(country, '') AS country, seniority, coalesce(CAST(experience_years AS VARCHAR), '') AS experience_years, CAST(n AS VARCHAR) AS experience_count, CASE WHEN study = 0 THEN '0' ELSE '1' END AS education_count,
  coalesce(summary, '') AS experience_summary, CASE study WHEN 0 THEN '' WHEN 1 THEN 'Diplom' WHEN 2 THEN 'Delta Institute' ELSE 'Diplom | Geodesy | Delta Institute' END AS education_summary,
  array_to_string(list_transform(range(1, skill_n + 1), lambda i: 'skill ' || i), '; ') AS skills, CASE WHEN cert_n > 0 THEN 'certificate 1' ELSE '' END AS certifications, CAST(score AS VARCHAR) AS ats_score,
  CASE WHEN rec.doc_id % 50 = 0 THEN 'bad file' ELSE '' END AS error, {", ".join(f"coalesce(exp_{i}_{f}, '') AS exp_{i}_{f}" for i in range(1, 5) for f in ("title", "company", "start_date", "end_date"))},
  CASE WHEN study % 2 = 1 THEN 'Diplom' ELSE '' END AS edu_1_degree, CASE WHEN study = 3 THEN 'Geodesy' ELSE '' END AS edu_1_field, CASE WHEN study >= 2 THEN 'Delta Institute' ELSE '' END AS edu_1_institution
FROM rec LEFT JOIN x ON x.doc_id = rec.doc_id
"""
_STDERR = "ObjectCache(0x1)::~ObjectCache(): WARNING! LEAK! object 0x2 still has count 1"

ORACLES: dict[str, str] = {
    "ats_score": f"WITH {RECORDS} SELECT doc_id, {', '.join(CATEGORIES)}, score FROM rec",
    "ats_issues": f"WITH {RECORDS}, i AS ({_ISSUES}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS pos, severity, message FROM i",
    "ats_category_summary": f"WITH {RECORDS}, u AS ({' UNION ALL '.join(f'SELECT {q(c)} AS category, {c} AS points FROM rec' for c in CATEGORIES)}) SELECT category, count(*) AS n, CAST(sum(points) AS BIGINT) AS total, max(points) AS best, count(*) FILTER (points = 0) AS zeros FROM u GROUP BY category",
    "parse_date": f"WITH e AS ({F2}) SELECT d, {month_index('d')} AS month_index FROM (SELECT start_date AS d FROM e UNION SELECT end_date FROM e)",
    "experience_years": f"WITH {RECORDS} SELECT doc_id, experience_years FROM rec",
    "seniority": f"WITH {RECORDS} SELECT doc_id, seniority FROM rec",
    "country": f"WITH {RECORDS} SELECT doc_id, country FROM rec",
    "clean_phone": f"WITH p AS ({F3}) SELECT doc_id, {phone('phone')} AS phone FROM p",
    "clean_spaces": f"WITH p AS ({F3}) SELECT doc_id, {tidy("(location || ' , ')")} AS location FROM p",
    "normalize_text": f"WITH d AS ({F4}) SELECT doc_id, {trim(f"regexp_replace({_PLAIN}, ' {{2,}}', ' ', 'g')")} AS text FROM d",
    "expand_tables": tables(F4, _LINES),
    "merge_subwords": f"WITH {MERGED} SELECT * FROM m",
    "clean_entity": f"WITH {MERGED}, {S5}, b AS (SELECT 'tokens' AS source, doc_id, pos, label, text, start_off, end_off, score FROM m UNION ALL SELECT 'spans', doc_id, pos, label, text, start_off, end_off, score FROM s5) SELECT doc_id, source, pos, label, text, start_off, end_off FROM ({clean_rows('b', 'doc_id, source, pos', ALL)})",
    "merge_neighbors": f"WITH {MERGED}, c AS ({clean_rows('m', 'doc_id, pos', ALL)}) SELECT * FROM ({neighbours('c')})",
    "gazetteer_relabel": f"WITH {S5} SELECT * FROM ({relabelled('s5', fx.COMPANIES)})",
    "title_split": f"WITH {S5} SELECT * FROM ({split_titles('s5', fx.COMPANIES)})",
    "skill_pairs": f"WITH {S5} SELECT * FROM ({paired('s5')})",
    "detect_sections": f"WITH {SECTIONS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_off) - 1 AS INT) AS pos, name, start_off, CAST(end_off AS INT) AS end_off FROM sec",
    "gap_fill": f"WITH {SECTIONS} {numbered('gaps')}",
    "overlap_anti": f"WITH {MERGED}, {SECTIONS}, {FREE} {numbered('free')}",
    "fill_missing": f"WITH {MERGED}, {SECTIONS}, {FREE}, every AS (SELECT doc_id, label, text, start_off, end_off, 0 AS kind, pos AS sec, 0 AS i, 0 AS j FROM m WHERE label = 'DATE' AND doc_id IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, label, text, start_off, end_off, 1, sec, i, j FROM free) {numbered('every', 'start_off, kind, sec, i, j')}",
    "personal": f"WITH {S5}, ids AS (SELECT DISTINCT doc_id FROM s5) SELECT * FROM ({PERSONAL})",
    "experience_fold": experience(S5, fx.COMPANIES),
    "education_fold": education(S5),
    "skills": f"WITH {S5} SELECT * FROM ({SKILLS})",
    "certifications": f"WITH {S5} SELECT * FROM ({CERTIFICATIONS})",
    "parse_full": FULL_RECORD,
    "chunk_pack": chunks(lambda x: f"ceil(length({x}) / 4.0)", 512),
    "chunk_tokens": chunks(lambda x: f"len(regexp_extract_all({x}, '\\S+'))", 100),
    "csv_wide": CSV,
    "batch_summary": f"WITH {RECORDS} SELECT count(*) AS total, count(*) FILTER (doc_id % 50 <> 0) AS succeeded, count(*) FILTER (doc_id % 50 = 0) AS failed FROM rec",
    "stderr_filter": f"""WITH v(id, stderr) AS (VALUES (1, {q(_STDERR)} || chr(10) || 'real problem: page 3 unreadable' || chr(10) || {q(_STDERR.replace('0x1', '0x3').replace('0x2', '0x4'))}), (2, {q(_STDERR)}), (3, chr(10) || 'real problem: page 3 unreadable' || repeat(chr(10), 4) || 'real problem: page 3 unreadable  '), (4, ''))
SELECT id, {trim("regexp_replace(regexp_replace(stderr, '(?m)^ObjectCache\\([^\\n]*WARNING! LEAK![^\\n]*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS stderr FROM v""",
}
