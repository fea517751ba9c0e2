"""Command line: extract one document, a batch of them, or report on the environment. Without a command, `extract` is meant."""

from __future__ import annotations

import argparse
import json
import os
import platform
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import config as settings
from dossier.operators.chunk import by_chars, tokenizer
from dossier.operators.tagging import model_tagger, rule_tagger
from dossier.plans.pipeline import parse
from dossier.sources import documents, sinks

#: Files that a whole model folder holds; fixed names.
MODEL_FILES = (
    "config.json", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "vocab.txt", settings.FILE_NAME, settings.GAZETTEER_NAME, "city_country_map.json",
    "onnx/config.json", "onnx/model_quantized.onnx", "onnx/ort_config.json", "onnx/special_tokens_map.json", "onnx/tokenizer.json", "onnx/tokenizer_config.json", "onnx/vocab.txt",
)
#: Of these, what the model tagger reads.
TAGGER_FILES = ("config.json", "tokenizer.json", "onnx/model_quantized.onnx")
COMMANDS = ("extract", "batch", "doctor", "setup-model", "update-model")


def default_model_path() -> str:
    """Where a model is looked for: in the user's cache folder."""
    home = os.environ.get("XDG_CACHE_HOME") or (os.path.join(os.environ["HOME"], ".cache") if os.environ.get("HOME") else None)
    if home is None:
        raise SystemExit("No cache folder is known here. Give --model-path")
    return os.path.join(home, "dossier", "model")


def session() -> SparkSession:
    return SparkSession.builder.appName("dossier").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="dossier", description="Structured records from résumés")
    commands = out.add_subparsers(dest="command", required=True)

    def common(p: argparse.ArgumentParser) -> None:
        p.add_argument("--model-path", help="folder with resume_config.json, companies.json and the model; the user's cache folder unless given")
        p.add_argument("--tagger", choices=("model", "rules"), help="the model's where the folder has one, else rules")
        p.add_argument("--no-ats", dest="ats", action="store_false", help="leave the score out")
        p.add_argument("--ocr", action="store_true")
        p.add_argument("--ocr-backend")
        p.add_argument("--ocr-language")
        p.add_argument("--ocr-dpi", type=int)
        p.add_argument("--output", help="file to write to")

    one = commands.add_parser("extract", help="one document: a path, --text, or standard input")
    one.add_argument("path", nargs="?")
    one.add_argument("--text")
    one.add_argument("--view", choices=("json", "pretty"), default="pretty" if sys.stdout.isatty() else "json")
    one.add_argument("--compact", action="store_true")
    common(one)
    many = commands.add_parser("batch", help="files and folders")
    many.add_argument("inputs", nargs="*")
    many.add_argument("--input-dir")
    many.add_argument("--glob")
    many.add_argument("--output-format", choices=("json", "jsonl", "csv", "pretty"))
    many.add_argument("--concurrency", type=float, default=4)
    many.add_argument("--fail-fast", action="store_true")
    many.add_argument("--output-dir", help="folder to write JSON lines or CSV to from the executors, instead of collecting them")
    common(many)
    doctor = commands.add_parser("doctor", help="what is installed and whether the model folder is whole")
    doctor.add_argument("--model-path")
    doctor.add_argument("--json", action="store_true")
    for name, said in (("setup-model", "fetch the model"), ("update-model", "fetch the latest model")):
        p = commands.add_parser(name, help=f"{said} (not done here: says where its files belong)")
        p.add_argument("--model-path")
        p.add_argument("--model-revision")
    return out


def ready(folder: str) -> bool:
    return all(os.path.exists(os.path.join(folder, n)) for n in MODEL_FILES)


def inspect(folder: str) -> dict[str, list[str]]:
    """Model files that are missing, empty, or no JSON."""
    missing = [n for n in MODEL_FILES if not os.path.exists(os.path.join(folder, n))]
    there = [n for n in MODEL_FILES if n not in missing]
    empty = [n for n in there if os.path.getsize(os.path.join(folder, n)) == 0]
    invalid = []
    for name in (n for n in there if n not in empty and n.endswith(".json")):
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                json.load(f)
        except ValueError:
            invalid.append(name)
    return {"missing": missing, "empty": empty, "invalid": invalid}


def doctor(folder: str) -> dict:
    found = inspect(folder)
    return {"model_path": os.path.abspath(folder), "ready": ready(folder), **found, "platform": platform.platform(), "python": platform.python_version(), "java": shutil.which("java") or "", "tesseract": shutil.which("tesseract") or ""}


def render_doctor(report: dict) -> str:
    said = lambda v: ", ".join(v) or "none" if isinstance(v, list) else "yes" if v is True else "no" if v is False else v or "not found"
    lines = ["dossier doctor", "", *(f"{k.replace('_', ' ')}: {said(v)}" for k, v in report.items())]
    return "\n".join([*lines, *(["", "The model folder isn't whole. See: dossier setup-model"] if not report["ready"] else [])])


def parsed(docs: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Records of documents, by the model of the folder where there is one, else by rules."""
    folder = args.model_path or default_model_path()
    config = settings.load(folder)
    there = all(os.path.exists(os.path.join(folder, n)) for n in TAGGER_FILES)
    if args.tagger == "model" and not there:
        raise SystemExit(f"The model's files aren't at {folder}: {', '.join(TAGGER_FILES)}")
    docs = docs.withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    if there and args.tagger != "rules":
        out = parse(docs, config, model_tagger(folder), tokenizer(os.path.join(folder, "tokenizer.json")))
    else:
        out = parse(docs, config, rule_tagger(config), by_chars(4))
    return out if args.ats else out.drop("ats")


def _items(docs: DataFrame, args: argparse.Namespace) -> list[dict]:
    return [sinks.as_item(r) for r in parsed(docs, args).orderBy("input").collect()]


def _extract(args: argparse.Namespace) -> str:
    if args.path and args.text:
        raise SystemExit("Give either a path or --text")
    spark = session()
    options = documents.ocr_options(args.ocr, args.ocr_backend, args.ocr_language, args.ocr_dpi)
    docs = documents.inline(spark, args.text) if args.text else documents.read_documents(spark, [args.path], options=options) if args.path else documents.stdin(spark)
    (item,) = _items(docs, args)
    if "error" in item:
        raise SystemExit(item["error"])
    return sinks.render_record(item) if args.view == "pretty" else sinks.render_json(item, not args.compact)


def _batch(args: argparse.Namespace) -> str:
    if args.concurrency < 1:
        raise SystemExit("--concurrency must be at least 1")
    paths = documents.discover(args.inputs, args.input_dir, args.glob)
    if not paths:
        raise SystemExit("No input files")
    spark = session()
    options = documents.ocr_options(args.ocr, args.ocr_backend, args.ocr_language, args.ocr_dpi)
    docs = documents.read_documents(spark, paths, options=options).repartition(int(args.concurrency))
    if args.fail_fast:
        docs = docs.withColumn("raw_text", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("raw_text")))
    form = args.output_format or ("jsonl" if args.output or args.output_dir else "json")
    if args.output_dir:
        if form not in ("jsonl", "csv"):
            raise SystemExit("--output-dir takes jsonl or csv")
        {"jsonl": sinks.write_jsonl, "csv": sinks.write_csv}[form](parsed(docs, args), args.output_dir)
        return ""
    if form == "csv":
        wide = sinks.csv_columns(parsed(docs, args))
        return "\n".join([",".join(wide.columns), *(r[0] for r in sinks.csv_lines(wide.orderBy("input")).collect())])
    items = _items(docs, args)
    return {"json": sinks.render_json, "jsonl": sinks.render_jsonl, "pretty": sinks.render_batch}[form](items)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in (*COMMANDS, "-h", "--help"):
        argv = ["extract", *argv]
    args = parser().parse_args(argv)
    if args.command == "doctor":
        report = doctor(args.model_path or default_model_path())
        print(json.dumps(report, indent=2) if args.json else render_doctor(report))
        return 0
    if args.command in ("setup-model", "update-model"):
        folder = args.model_path or default_model_path()
        raise SystemExit(f"{args.command}: models aren't downloaded. Put these files into {folder}: {', '.join(MODEL_FILES)}")
    text = _extract(args) if args.command == "extract" else _batch(args)
    if not getattr(args, "output_dir", None):
        sinks.write_output(text, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
