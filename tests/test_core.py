"""Operators against the specification's examples."""

import json
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dossier import cli
from dossier import config as settings
from dossier.functions import text as texts
from dossier.functions.arrays import settle
from dossier.operators import assemble, chunk, infer, sections, spans, tagging
from dossier.operators.score import score
from dossier.operators.tagging import rule_tagger
from dossier.plans import fixtures as fx
from dossier.plans.pipeline import parse, plain_tokens
from dossier.schema import EDUCATION, EXPERIENCE, SPANS, TOKENS
from dossier.sources import documents, sinks
from dossier.streaming import stream

CONFIG = fx.settings(("Borealis", "Cedar"))


def one(spark, column, **values):
    """The value of a Column over one row; values: name -> (value, type)."""
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def text_of(spark, f, value):
    return one(spark, f(F.col("t")), t=(value, "string"))


def span(label, text, start, bio="B"):
    return (label, text, start, start + len(text), bio, 0.95)


def on_spans(spark, f, rows, **more):
    return one(spark, f(F.col("s")), s=(rows, SPANS), **more)


def brief(rows):
    return [(r["label"], r["text"]) for r in rows]


# ---- text


def test_normalize_mixed(spark):
    raw = "Mail: a@b.c\r\nTel: +1 555  \r\n● Built  x — y\n\nCore Tools Flink,  Node.js\nplain\n"
    assert text_of(spark, lambda t: texts.normalize(t, CONFIG), raw) == "a@b.c\n+1 555\n- Built x - y\n\nCore Tools: Flink, Node.js\nplain"


def test_table_continues_and_prose_stays(spark):
    f = lambda t: texts.tables(t, CONFIG)
    assert text_of(spark, f, "Core Tools React, Go\n  Rust, C\nother") == "Core Tools: React, Go Rust, C\nother"
    assert text_of(spark, f, "Data Tools   Spark , Flink,") == "Data Tools: Spark, Flink,"
    prose = "Core Tools are what I bring to every single team"
    assert text_of(spark, f, prose) == prose
    assert text_of(spark, lambda t: texts.tables(t, replace(CONFIG, table_categories=())), "Core Tools A, B") == "Core Tools A, B"


@pytest.mark.parametrize(("raw", "want"), [("( 555 ) 123 - 4567", "(555) 123-4567"), ("+ 1  555", "+1 555"), ("", "")])
def test_phone(spark, raw, want):
    assert text_of(spark, texts.clean_phone, raw) == want


def test_spaces_names_and_noise(spark):
    assert text_of(spark, lambda t: texts.clean_spaces(t, CONFIG), "Portland , OR , ") == "Portland, OR"
    assert text_of(spark, lambda t: texts.skill_name(t, CONFIG), " TS. ") == "typescript"
    assert text_of(spark, lambda t: texts.certificate_name(t, CONFIG), "The Forklift Operator") == "forklift operator certificate"
    assert text_of(spark, texts.extractor_warnings, "ObjectCache(1)::~x(): WARNING! LEAK! y\nreal\n\n\n\nmore") == "real\n\nmore"
    assert text_of(spark, lambda t: texts.labels(t, CONFIG), "xTel: 1 tel: 2") == "xTel: 1 2"


# ---- chunks


def chunks_of(spark, text, per=4.0, count=True):
    return [(c["text"], c["offset"]) for c in text_of(spark, lambda t: chunk.chunks(t, chunk.by_chars(per) if count else None), text)]


def test_chunks(spark):
    assert chunks_of(spark, "a" * 5000, count=False) == [("a" * 5000, 0)]
    assert chunks_of(spark, "short") == [("short", 0)]
    parts = ["a" * 300, "b" * 300, "c" * 300]
    text = "\n\n".join(parts)
    got = chunks_of(spark, text, 1)
    assert [c for c, _ in got] == parts and all(text[o : o + len(c)] == c for c, o in got)
    long = " ".join(f"Sentence number {i:02d} is here." for i in range(40))
    got = chunks_of(spark, long, 1)
    assert all(len(c) <= 512 and long[o : o + len(c)] == c for c, o in got) and len(got) > 1
    # a section beyond the limit that meets a packed one comes out whole
    got = chunks_of(spark, "head\n\n" + "x. " * 300, 1)
    assert got[0] == ("head", 0) and len(got) == 2 and len(got[1][0]) > 512


def test_rebase(spark):
    got = on_spans(spark, lambda s: chunk.rebase(s, F.lit(10)), [span("SKILL", "Go", 3)])
    assert (got[0]["start"], got[0]["end"]) == (13, 15)


# ---- spans


def test_merge_subwords(spark):
    tokens = [("B-TITLE", "Eng", 0, 3, 1.0), ("I-TITLE", "##ineer", 3, 8, 0.5), ("O", "and", 9, 12, 1.0), ("I-TITLE", "lead", 13, 17, 1.0), ("SKILL", "x", 20, 21, None), ("I-SKILL", "y", None, None, 1.0)]
    got = one(spark, spans.merge_subwords(F.col("t")), t=(tokens, TOKENS))
    assert [(r["label"], r["text"], r["start"], r["end"], r["bio"], r["score"]) for r in got] == [("TITLE", "Engineer lead", 0, 17, "B", 1.0), ("SKILL", "x y", 20, 0, "O", 0.0)]
    assert one(spark, spans.merge_subwords(F.col("t")), t=([], TOKENS)) == []


@pytest.mark.parametrize(("label", "raw", "want"), [
    ("EMAIL", "Mr. ab @ b.c", "ab@b.c"), ("EMAIL", "www.a@b.c", None), ("EMAIL", "nobody", None), ("SKILL", "Zig", "Zig"), ("SKILL", "abc", None), ("SKILL", "AWS", "AWS"), ("SKILL", "various", None),
    ("COMPANY", "Dunes , NM", "Dunes"), ("COMPANY", "abc", None), ("DATE", "| May 2020 |", "May 2020"), ("TITLE", "-- MD --", "MD"), ("NAME", "Éé", None), ("NAME", "7", None), ("NAME", " ;. ", None), ("NAME", None, None),
])
def test_clean_entity(spark, label, raw, want):
    assert one(spark, spans.clean_entity(F.lit(label), F.col("t"), CONFIG), t=(raw, "string")) == want


def test_neighbours_merge_in_chains(spark):
    rows = [span("TITLE", "a", 0), span("TITLE", "b", 3), span("TITLE", "c", 5), span("SKILL", "x", 6), span("SKILL", "y", 7), span("TITLE", "z", 30)]
    got = on_spans(spark, lambda s: spans.merge_neighbours(s, CONFIG), rows)
    assert brief(got) == [("TITLE", "a b c"), ("SKILL", "x"), ("SKILL", "y"), ("TITLE", "z")]


def test_post_process(spark):
    rows = [span("TITLE", "Borealis", 0), span("COMPANY", "Cedar  May 2020", 50), span("TITLE", "Borealis Staff Engineer", 100), span("SKILL", "data", 150), span("SKILL", "modeling,", 160), span("SKILL", "data", 170)]
    got = on_spans(spark, lambda s: spans.post_process(s, CONFIG), rows)
    assert brief(got) == [("COMPANY", "Borealis"), ("COMPANY", "Cedar"), ("COMPANY", "Borealis"), ("TITLE", "Staff Engineer"), ("SKILL", "data modeling"), ("SKILL", "data")]
    assert got[2]["start"] == got[3]["start"] == 100 and all(r["bio"] == "B" for r in got)


def test_pairs_take_no_third(spark):
    config = fx.from_dict(fx.SETTINGS | {"multi_word_skills": ["a a"]})
    assert brief(on_spans(spark, lambda s: spans.pair_skills(s, config), [span("SKILL", "a", i) for i in range(3)])) == [("SKILL", "a a"), ("SKILL", "a")]


def test_grouped_labels_count_first(spark):
    kind = TOKENS.replace("entity:string", "entity_group:string,entity:string")
    tokens = [("TITLE", "O", "Eng", 0, 3, 1.0), (None, "B-SKILL", "x", 4, 5, 1.0), ("", "I-SKILL", "y", 6, 7, 1.0)]
    df = spark.createDataFrame([(tokens,)], f"tokens {kind}")
    got = df.select(spans.merge_subwords(plain_tokens(df)).alias("s")).first()["s"]
    assert [(r["label"], r["text"], r["bio"]) for r in got] == [("TITLE", "Eng", "O"), ("SKILL", "x y", "B")]


def test_long_arrays_take_linear_time(spark):
    """Four documents of 4,000 tokens each, half of them skills: what was quadratic took 45 seconds."""
    tokens = [("B-SKILL" if i % 2 else "B-TITLE", f"word{i % 900}", 20 * i, 20 * i + 8, 1.0) for i in range(4000)]
    df = settle(spark.createDataFrame([(i, tokens) for i in range(4)], f"id int, tokens {TOKENS}").repartition(4))
    merged = settle(df.select(spans.merge_subwords(F.col("tokens")).alias("spans")))
    for step in (lambda s: assemble.skills(s, CONFIG), lambda s: spans.merge_neighbours(s, CONFIG), lambda s: spans.pair_skills(s, CONFIG), lambda s: assemble.experience(s, CONFIG)):
        began = time.time()
        merged.select(step(F.col("spans")).alias("x")).write.format("noop").mode("overwrite").save()
        assert time.time() - began < 8


# ---- sections


TEXT = "Me\nSkills:\n- React, Go, Tools: x\nLang: Rust | Kafka - Spark.\nCERTIFICATIONS\n- AWS Architect\nabc\nLanguages\nEnglish (Native)\nlower"


def test_sections(spark):
    got = text_of(spark, sections.detect_sections, TEXT)
    assert [s["name"] for s in got] == ["skills", "certifications", "languages"]
    assert all(TEXT[s["start"] : s["end"]] == s["text"] for s in got) and got[-1]["end"] == len(TEXT)
    assert text_of(spark, sections.detect_sections, "Skills: a, b") == []


def test_fill_missing(spark):
    there = [span("SKILL", "React", TEXT.index("React"))]
    got = one(spark, sections.fill_missing(F.col("t"), F.col("s")), t=(TEXT, "string"), s=(there, SPANS))
    assert brief(got) == [("SKILL", "React"), ("SKILL", "Tools: x"), ("SKILL", "Rust"), ("SKILL", "Kafka"), ("SKILL", "Spark"), ("CERT", "AWS Architect"), ("LANGUAGE", "English")]
    assert all(TEXT[r["start"] : r["end"]] == r["text"] for r in got)
    assert [r["start"] for r in got] == sorted(r["start"] for r in got)


# ---- assembly


def roles(spark, rows):
    return [(r["title"], r["company"], r["start_date"], r["end_date"]) for r in on_spans(spark, lambda s: assemble.experience(s, CONFIG), rows)]


def test_experience(spark):
    assert roles(spark, [span("TITLE", "Engineer", 0), span("COMPANY", "Borealis", 20), span("DATE", "January 2020 Present", 30)]) == [("Engineer", "Borealis", "January 2020", "Present")]
    assert roles(spark, [span("TITLE", "Engineer", 0), span("DATE", "June", 10), span("DATE", "2019 2021", 20), span("TITLE", "Lead", 30), span("COMPANY", "Cedar", 40)]) == [("Engineer", None, "June 2019", "2021"), ("Lead", "Cedar", None, None)]
    assert roles(spark, [span("DATE", "2001", 0), span("DATE", "2002", 10), span("DATE", "2003", 20)]) == []
    assert roles(spark, [span("TITLE", "Orphan", 0), span("TITLE", "Staff Engineer with Borealis", 10), span("COMPANY", "Borealis", 60), span("DATE", "2020", 70)]) == [("Staff Engineer with Borealis", "Borealis", "2020", None)]
    assert roles(spark, []) == []


def test_clean_experience(spark):
    rows = [("Orphan", None, None, None), ("Staff Engineer with Borealis", None, None, None), ("X", "Y", None, None), ("X", "Y", None, None), (None, None, None, None)]
    got = one(spark, assemble.clean_experience(F.col("r"), CONFIG), r=(rows, f"array<{EXPERIENCE}>"))
    assert [(r["title"], r["company"]) for r in got] == [("Staff Engineer", "Borealis"), ("X", "Y")]
    # the trimmed separator cuts at its first occurrence, inside words too
    got = one(spark, assemble.clean_experience(F.col("r"), CONFIG), r=([("A Forthwith Lead with X", None, None, None)], f"array<{EXPERIENCE}>"))
    assert [(r["title"], r["company"]) for r in got] == [("A Forth", "Lead")]


def test_education(spark):
    rows = [span("DEGREE", "B.Tech", 0), span("FIELD", "CS", 10), span("INSTITUTION", "Alpha, 2014", 20), span("DEGREE", "M.Sc", 40), span("DEGREE", "PhD", 50), span("FIELD", "Art", 60)]
    got = on_spans(spark, lambda s: assemble.education(s, CONFIG), rows)
    assert [tuple(r) for r in got] == [("B.Tech", "CS", "Alpha"), ("M.Sc", None, None), ("PhD", "Art", None)]
    assert on_spans(spark, lambda s: assemble.education(s, CONFIG), [span("FIELD", "Art", 0)]) == []


def test_sets_and_personal(spark):
    rows = [span("SKILL", "React, data, zig, abc", 0), span("SKILL", "REACT", 40), span("CERT", "AWS", 50), span("CERT", "aws", 60), span("NAME", "Jane", 70), span("NAME", "Joe", 80), span("EMAIL", "x", 90), span("EMAIL", "ab@b.c", 95), span("LOCATION", "Portland , OR ,", 99)]
    assert on_spans(spark, lambda s: assemble.skills(s, CONFIG), rows) == ["React", "data", "zig"]
    assert on_spans(spark, lambda s: assemble.certifications(s, CONFIG), rows) == ["AWS"]
    assert tuple(on_spans(spark, lambda s: assemble.personal(s, CONFIG), rows)) == ("Jane", "ab@b.c", None, "Portland, OR")


# ---- inference and score


@pytest.mark.parametrize(("raw", "want"), [("June 2022", 2022 * 12 + 5), ("2020", 2020 * 12 + 5), ("unknown", None), ("Mar 2001", 2001 * 12 + 2), ("Sept 2020", 2020 * 12 + 5), ("03/2020", 2020 * 12 + 5), ("1850", None), (None, None)])
def test_month_index(spark, raw, want):
    assert text_of(spark, infer.month_index, raw) == want


def years(spark, rows, config=CONFIG, as_of="2003-01-01"):
    return one(spark, infer.experience_years(F.col("r"), config, F.lit(as_of).cast("date")), r=(rows, f"array<{EXPERIENCE}>"))


def test_years(spark):
    capped = replace(CONFIG, max_months=24)
    assert years(spark, [("a", None, "January 2000", "December 2001"), ("b", None, "January 1970", "January 1995")], capped) == 1
    assert years(spark, [("a", None, "January 2000", "Present"), ("b", None, "January 2000", None), ("c", None, "nonsense", None)]) == 6
    assert years(spark, []) is None


def test_seniority_and_country(spark):
    r = lambda *titles: ([(t, None, None, None) for t in titles], f"array<{EXPERIENCE}>")
    level = lambda rows, y: one(spark, infer.seniority(F.col("r"), F.lit(y).cast("int"), CONFIG), r=rows)
    assert level(r("Expertise hand"), None) == "Senior" and level(r("x", "Director"), 1) == "Executive" and level(r("x"), 9) == "Senior" and level(r(*"abcde"), None) == "Senior" and level(r(*"abcd"), None) == "Mid" and level(r(), None) == "Junior" and level(r("x"), 0) == "Junior"
    land = lambda place, phone: one(spark, infer.country(F.col("p"), F.col("n"), CONFIG), p=(place, "string"), n=(phone, "string"))
    assert land("Deutschland", None) == "Germany" and land("Remote, NM", None) == "United States" and land("x", "+49 (5)") == "Germany" and land("Unknown", None) is None and land(None, None) is None and land("near Portland", "5") == "United States"


def test_score(spark):
    strong = {"p": (("a", "b", "c", "d"), "struct<name:string,email:string,phone:string,location:string>"), "e": ([("t", "c", "June 2010", None)] * 3, f"array<{EXPERIENCE}>"), "u": ([("d", "f", "i")], f"array<{EDUCATION}>"), "s": ([str(i) for i in range(12)], "array<string>"), "c": (["x"], "array<string>"), "y": (5, "int"), "r": ("Increased sales by 40%", "string")}
    columns = [F.col(k) for k in "peuscyr"]
    got = one(spark, score(*columns), **strong)
    # 20 + 25 + 15 + 20 + 18 + 5 is 103, so the cap is live
    assert got["score"] == 100 and got["issues"] == [] and got["details"]["formatting"]["score"] == 18 and got["details"]["achievements"]["hasMetrics"]
    weak = strong | {"p": ((None,) * 4, strong["p"][1]), "e": ([(None, None, None, None)], strong["e"][1]), "u": ([], strong["u"][1]), "s": ([], "array<string>"), "c": ([], "array<string>"), "y": (None, "int"), "r": ("nothing", "string")}
    got = one(spark, score(*columns), **weak)
    assert got["score"] == 4 and len(got["issues"]) == 11
    some = strong | {"e": ([("t", "c", "2010", None), ("t", "c", None, None)], strong["e"][1]), "s": (["a", "b"], "array<string>")}
    assert [i["message"].split(" - ")[0] for i in one(spark, score(*columns), **some)["issues"]] == ["1 experience entries missing dates", "Only 2 skills found"]


# ---- configuration


def test_config_errors():
    for path, value, said in [("us_states", [1], "us_states to be a string array"), ("post_processing.span_merge_max_gap", "3", "post_processing.span_merge_max_gap to be a number"), ("pre_processing.normalize_dashes", 1, "pre_processing.normalize_dashes to be a boolean"), ("pre_processing.dash_replacements", {"a": 1}, "pre_processing.dash_replacements.a to be a string"), ("post_processing.entity_rules.EMAIL", None, "post_processing.entity_rules.EMAIL to be an object")]:
        raw = json.loads(json.dumps(fx.SETTINGS))
        at = raw
        *way, last = path.split(".")
        for key in way:
            at = at[key]
        at[last] = value
        with pytest.raises(settings.ConfigError, match=said):
            settings.validate(raw)
    raw = {k: v for k, v in fx.SETTINGS.items() if k != "city_country_map"}
    with pytest.raises(settings.ConfigError, match="city_country_map or city_country_map_file"):
        settings.validate(raw)


@pytest.fixture
def model(tmp_path):
    (tmp_path / "resume_config.json").write_text(json.dumps(fx.SETTINGS | {"city_country_map_file": "cities.json"}))
    (tmp_path / "companies.json").write_text(json.dumps({"tech": ["Borealis", "Cedar"], "more": ["borealis"]}))
    (tmp_path / "cities.json").write_text(json.dumps({"r": {"pune": "India"}, "s": {"oslo": "Norway"}}))
    return str(tmp_path)


def test_load(model):
    config = settings.load(model)
    assert config.companies == ("borealis", "cedar") and config.cities == {"pune": "India", "oslo": "Norway"}
    (open(f"{model}/cities.json", "w")).write("{}")
    assert settings.load(model).cities == fx.SETTINGS["city_country_map"]
    (open(f"{model}/resume_config.json", "w")).write("{")
    with pytest.raises(settings.ConfigError, match="Failed to parse"):
        settings.load(model)


# ---- sources, sinks, command line, stream


def docx(path, lines):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)}</w:body></w:document>')


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    (at / "nested").mkdir(parents=True)
    (at / "one.txt").write_text("Jane\njane@x.org\nBorealis\nJanuary 2020 - Present\nSkills\nReact, Kafka")
    (at / "skip.png").write_bytes(b"x")
    (at / "two.pdf").write_bytes(b"%PDF")
    docx(at / "nested" / "three.docx", ["Skills", "Spark, Flink"])
    return at


def test_discover(folder):
    assert [p.rsplit("/", 1)[1] for p in documents.discover([str(folder)])] == ["three.docx", "one.txt", "two.pdf"]
    assert len(documents.discover([str(folder / "skip.png"), str(folder / "one.txt"), str(folder / "one.txt")])) == 2
    with pytest.raises(FileNotFoundError):
        documents.discover(["/none"])
    with pytest.raises(ValueError):
        documents.ocr_options(backend="other")
    assert documents.ocr_options(dpi=300) == {"ocr": True, "backend": "tesseract", "language": "eng", "dpi": 300}


def test_read_documents(spark, folder):
    rows = {r["input"].rsplit("/", 1)[1]: r for r in documents.read_documents(spark, documents.discover([str(folder)]), pdf=lambda data, options: " ").collect()}
    assert rows["three.docx"]["raw_text"] == "Skills\nSpark, Flink" and rows["two.pdf"]["error"].startswith("Could not extract") and rows["one.txt"]["raw_text"].startswith("Jane")


def made_pdf(streams, fonts=b"", packed=False):
    """A PDF by hand: a page for each content stream; with `packed`, compressed and with objects in an object stream."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (len(streams), b" ".join(b"%d 0 R" % (20 + i) for i in range(len(streams)))), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    put = lambda n, body: b"%d 0 obj\n%s\nendobj\n" % (n, body)
    stream = lambda head, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)
    out = b"%PDF-1.5\n%\xe2\xe3\n"
    for i, s in enumerate(streams):
        objects[20 + i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (40 + i)
        out += put(40 + i, stream(b"/Filter /FlateDecode", zlib.compress(s)) if packed else stream(b"", s))
    out += put(5, stream(b"", fonts))
    if packed:
        bodies = [(n, objects[n]) for n in sorted(objects)]
        head = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for _, b in bodies[:i])) for i, (n, _) in enumerate(bodies)) + b"\n"
        out += put(9, stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(bodies), len(head)), zlib.compress(head + b"\n".join(b for _, b in bodies))))
    else:
        out += b"".join(put(n, b) for n, b in objects.items())
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00e90301> endbfchar 1 beginbfrange <0010> <0012> <0061> <0020> <0021> [<4e2d> <6587>] endbfrange"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(packed):
    from dossier.sources import pdf

    one = b"BT /F1 12 Tf 72 700 Td (Jane \\(Doe\\) \\351t\\\n\\351) Tj 0 -14 Td [(Sen) 20 (ior) -300 (Engineer)] TJ T* (Skills:) ' ET BT 1 0 0 1 72 600 Tm (a) Tj 1 0 0 1 90 600 Tm (b) Tj ET BI /W 1 ID \x00(x) Tj EI"
    two = b"BT /F2 10 Tf <00010002> Tj 0 -12 TD <001000110012> Tj T* <00200021> Tj ET % (comment) Tj"
    assert pdf.text_of(made_pdf([one, two], CMAP, packed)) == "Jane (Doe) \xe9t\xe9\nSenior Engineer\nSkills:\na b\nA\xe9\u0301\nabc\n中文"
    for bad in (b"nothing", b"%PDF-1.4 trailer << /Encrypt 8 0 R >>"):
        with pytest.raises(ValueError):
            pdf.text_of(bad)
    assert pdf.text_of(b"%PDF-1.4") == ""


def test_pdf_files_are_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made_pdf([b"BT (Jane) Tj 0 -9 Td (jane@x.org) Tj ET"]))
    (tmp_path / "b.PDF").write_bytes(made_pdf([b""]))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 /Encrypt 1 0 R")
    rows = {r["input"][-5:]: r for r in documents.read_documents(spark, documents.discover([str(tmp_path)])).collect()}
    assert rows["a.pdf"]["raw_text"] == "Jane\njane@x.org" and rows["a.pdf"]["error"] is None
    assert rows["b.PDF"]["error"].startswith("Could not extract") and "encrypted" in rows["c.pdf"]["error"]


def test_parse_and_render(spark, folder):
    docs = documents.read_documents(spark, [str(folder / "one.txt")])
    (row,) = parse(docs, CONFIG, rule_tagger(CONFIG), chunk.by_chars(4), F.lit("2023-01-01").cast("date")).collect()
    assert row["personal"]["email"] == "jane@x.org" and row["skills"] == ["React", "Kafka"] and row["raw_text"].startswith("Jane")
    assert [tuple(r) for r in row["experience"]] == [(None, "Borealis", "January 2020 -", "Present")]
    item = sinks.as_item(row)
    assert "title" not in item["parsed"]["experience"][0] and item["parsed"]["personal"]["name"] is None
    said = sinks.render_record(item)
    assert "Name: -" in said and "1. - @ Borealis (January 2020 - -> Present)" in said
    assert sinks.render_batch([item, {"input": "/x/b.txt", "error": "bad"}]).startswith("Processed 2 file(s): 1 succeeded, 1 failed")
    assert sinks.render_jsonl([{"input": "a.txt", "error": "bad"}]) == '{"input":"a.txt","error":"bad"}'


def test_golden_tokens(spark):
    words = [("B-NAME", "Jane"), ("I-NAME", "Doe"), ("B-TITLE", "Engineer"), ("B-COMPANY", "Borealis"), ("B-DATE", "January"), ("I-DATE", "2020"), ("I-DATE", "Present"), ("B-LOCATION", "Portland"), ("B-SKILL", "data"), ("B-SKILL", "modeling")]
    tokens = [(e, w, i * 20, i * 20 + len(w), 1.0) for i, (e, w) in enumerate(words)]
    df = spark.createDataFrame([(1, "raw", tokens)], f"id int, raw_text string, tokens {TOKENS}")
    (r,) = parse(df, CONFIG, as_of=F.lit("2024-06-01").cast("date")).collect()
    assert r["personal"]["name"] == "Jane Doe" and r["country"] == "United States" and r["skills"] == ["data modeling"] and r["experience_years"] == 4
    assert [tuple(x) for x in r["experience"]] == [("Engineer", "Borealis", "January 2020", "Present")]


def test_filters_on_records_are_planned_soon(spark):
    """Such a filter used to be pushed through all folds: planning took two minutes."""
    df = spark.createDataFrame([(1, "raw", [])], f"id int, raw_text string, tokens {TOKENS}")
    records = parse(df, CONFIG, as_of=F.lit("2024-06-01").cast("date")).filter("ats.score > 50 AND seniority = 'Senior'")
    began = time.time()
    records._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5 and records.count() == 0


def test_counted_chunks_equal_folded_ones(spark):
    """The Arrow pass packs as the fold does; a tokenizer's chunks hold its limit but for whole sentences beyond it."""
    rng = random.Random(4)
    texts_ = [None, "", "a b", "\n\n\n"] + ["\n\n".join(" ".join(rng.choice(["x.", "word", "longer.  Word", "y"]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts_)), "id int, t string")
    counter = chunk.Counter(lambda: lambda x: -(-len(x) // 4))
    a = df.select("id", chunk.chunks(F.col("t"), chunk.by_chars(4), 40).alias("c")).collect()
    b = df.select("id", chunk.chunk_texts(F.col("t"), counter, 40).alias("c")).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and sum(len(r["c"] or []) > 2 for r in a) > 20
    tokens = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    count = chunk.tokenizer(tokens).factory()
    for r in df.filter("length(t) > 9").select("t", chunk.chunk_texts(F.col("t"), chunk.tokenizer(tokens), 50).alias("c")).collect():
        assert " ".join(c["text"] for c in r["c"]).split() == r["t"].split()
        # beyond the limit are only sections that met a packed one, which come out whole
        assert all(count(c["text"]) <= 50 or c["text"] in r["t"] for c in r["c"])


def test_csv_quotes_only_where_needed(spark):
    wide = spark.createDataFrame([("a,b", 'x"y', "plain", "")], "a string, b string, c string, d string")
    assert sinks.csv_lines(wide).first()["line"] == '"a,b","x""y",plain,'


def test_cli(spark, folder, model, capsys, tmp_path, monkeypatch):
    assert cli.main(["extract", str(folder / "one.txt"), "--model-path", model, "--view", "json", "--compact"]) == 0
    assert json.loads(capsys.readouterr().out)["parsed"]["personal"]["email"] == "jane@x.org"
    # no command means extract
    assert cli.main([str(folder / "one.txt"), "--model-path", model, "--view", "json", "--compact", "--no-ats"]) == 0
    assert "ats" not in json.loads(capsys.readouterr().out)
    out = str(tmp_path / "o.csv")
    assert cli.main(["batch", str(folder), "--model-path", model, "--output-format", "csv", "--output", out]) == 0
    lines = open(out).read().splitlines()
    assert lines[0].startswith("input,status,name,email")
    assert cli.main(["batch", str(folder), "--model-path", model, "--output-format", "csv", "--output-dir", str(tmp_path / "csv")]) == 0
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert sorted("".join(p.read_text() for p in parts).splitlines()) == sorted(lines) and parts[0].read_text() == lines[0] + "\n"
    for command in ("setup-model", "update-model"):
        with pytest.raises(SystemExit, match="aren't downloaded.*model_quantized"):
            cli.main([command, "--model-path", model])
    with pytest.raises(SystemExit, match="model's files"):
        cli.main([str(folder / "one.txt"), "--model-path", model, "--tagger", "model"])
    monkeypatch.setenv("XDG_CACHE_HOME", "/c")
    assert cli.default_model_path() == "/c/dossier/model"


def test_doctor_looks_at_all_files(model, capsys):
    import os

    assert cli.main(["doctor", "--model-path", model, "--json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert not report["ready"] and len(report["missing"]) == 13
    os.makedirs(f"{model}/onnx")
    for name in report["missing"]:
        open(f"{model}/{name}", "w").write("" if name == "vocab.txt" else "{" if name == "onnx/config.json" else "{}")
    assert cli.main(["doctor", "--model-path", model]) == 0
    said = capsys.readouterr().out
    assert "ready: yes" in said and "empty: vocab.txt" in said and "invalid: onnx/config.json" in said and "missing: none" in said


def onnx_lookup(table):
    """A model by hand: logits of each input id are a row of the table (one Gather node)."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    put = lambda field, value: number(field << 3) + number(value) if isinstance(value, int) else number(field << 3 | 2) + number(len(value)) + value
    raw = b"".join(struct.pack("<f", x) for row in table for x in row)
    tensor = put(1, len(table)) + put(1, len(table[0])) + put(2, 1) + put(8, b"table") + put(9, raw)
    node = put(1, b"table") + put(1, b"input_ids") + put(2, b"logits") + put(4, b"Gather")
    value = lambda name, kind, dims: put(1, name) + put(2, put(1, put(1, kind) + put(2, b"".join(put(1, put(2, d)) for d in dims))))
    graph = put(1, node) + put(2, b"g") + put(5, tensor) + put(11, value(b"input_ids", 7, [b"b", b"n"])) + put(12, value(b"logits", 1, [b"b", b"n", b"l"]))
    return put(1, 8) + put(7, graph) + put(8, put(1, b"") + put(2, 13))


def test_model_tagger_runs_from_the_command_line(spark, folder, model, capsys):
    """An ONNX graph, a tokenizer and labels made by hand: words are looked up, so the result is known."""
    pytest.importorskip("onnxruntime")
    import os

    from tokenizers import Tokenizer, models, pre_tokenizers

    labels = ["O", "B-NAME", "B-COMPANY", "B-TITLE"]
    words = {"[UNK]": 0, "Jane": 1, "Borealis": 2, "Engineer": 3}
    made = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(f"{model}/tokenizer.json")
    os.makedirs(f"{model}/onnx")
    open(f"{model}/onnx/model_quantized.onnx", "wb").write(onnx_lookup([[9.0 if i == j else 0.0 for j in range(4)] for i in range(4)]))
    json.dump({"id2label": {str(i): x for i, x in enumerate(labels)}}, open(f"{model}/config.json", "w"))
    assert cli.main(["--text", "Jane is Engineer with Borealis", "--model-path", model, "--view", "json"]) == 0
    got = json.loads(capsys.readouterr().out)["parsed"]
    assert got["personal"]["name"] == "Jane" and got["experience"] == [{"title": "Engineer", "company": "Borealis"}]


def test_a_worker_makes_a_tagger_once(monkeypatch):
    monkeypatch.setattr(tagging, "_made", type(tagging._made)())
    made = []
    for key in (b"a", b"a", b"b", b"a", b"c", b"a", b"b"):
        tagging.once(key, lambda k=key: made.append(k) or k)
    assert made == [b"a", b"b", b"c", b"b"]
    assert tagging.as_token({"entity_group": "SKILL", "entity": "O", "word": "x"}, ["entity", "word", "end"]) == {"entity": "SKILL", "word": "x", "end": None}


def test_json_lines_equal_items(spark, folder, tmp_path):
    docs = documents.read_documents(spark, documents.discover([str(folder)]), pdf=lambda data, options: 1 / 0)
    quoted = docs.withColumn("raw_text", F.concat(F.coalesce("raw_text", F.lit("")), F.lit('\n"é\\ \t')))
    rows = parse(quoted, CONFIG, rule_tagger(CONFIG), chunk.by_chars(4), F.lit("2023-01-01").cast("date"))
    want = {r["input"]: sinks.as_item(r) for r in rows.collect()}
    sinks.write_jsonl(rows, str(tmp_path / "out"))
    got = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert {x["input"]: x for x in got} == want and len(got) == len(want) == 3
    assert sum("error" in x for x in got) == 1 and [list(x) for x in got if "parsed" in x][0] == ["input", "parsed", "ats"]


def test_stream_equals_batch(spark, folder, tmp_path):
    docs = stream.stream_documents(spark, str(folder), "*.txt")
    found = stream.stream_records(docs, CONFIG, rule_tagger(CONFIG), chunk.by_chars(4), F.lit("2023-01-01").cast("date"))
    query = stream.write_records(found, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row["skills"] == ["React", "Kafka"]
