"""Taggers: functions from a text to tokens with positions. A model is one kind; rules are another."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from dossier.config import Config

#: Models that a worker keeps for its later tasks, by the key of the factory that made them.
KEPT = 2
_made: OrderedDict[bytes, Any] = OrderedDict()


def once(key: bytes, factory: Callable[[], Any]) -> Any:
    """What the factory makes, made once in a worker process."""
    if key not in _made:
        _made[key] = factory()
        while len(_made) > KEPT:
            _made.popitem(last=False)
    _made.move_to_end(key)
    return _made[key]


def as_token(t: dict[str, Any], names: list[str]) -> dict[str, Any]:
    """A tagger's token with the columns `names`; a grouped label counts before a plain one."""
    return {n: t.get(n) for n in names} | {"entity": t.get("entity_group") or t.get("entity")}


def rule_tagger(config: Config):
    """A deterministic tagger for tests and for texts of plain form: e-mails, phones, dates, companies, known skills."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    present = "|".join(map(re.escape, config.present_words)) or "present"
    companies = sorted(config.companies, key=len, reverse=True)
    patterns = [("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.]+"), ("PHONE", r"\+\d[\d ()-]{7,}\d"), ("DATE", rf"\b(?:{months})\s+\d{{4}}(?:\s*-\s*(?:{present}))?")]
    patterns += [("COMPANY", "|".join(rf"\b{re.escape(c)}\b" for c in companies))] if companies else []
    compiled = [(label, re.compile(p, re.IGNORECASE)) for label, p in patterns]

    def factory():
        def run(text: str) -> list[dict[str, Any]]:
            found = [{"entity": f"B-{label}", "word": m[0], "start": m.start(), "end": m.end(), "score": 1.0} for label, p in compiled for m in p.finditer(text)]
            return sorted(found, key=lambda t: (t["start"], -t["end"]))

        return run

    return factory


def onnx_tagger(model_path: str, tokenizer_path: str, labels: list[str]):
    """Token classification with an ONNX model: the likeliest label of each token that isn't special, with its probability."""

    def factory():
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        session, tokenizer = onnxruntime.InferenceSession(model_path), Tokenizer.from_file(tokenizer_path)
        wanted = {x.name for x in session.get_inputs()}

        def run(text: str) -> list[dict[str, Any]]:
            coded = tokenizer.encode(text)
            feed = {"input_ids": coded.ids, "attention_mask": coded.attention_mask, "token_type_ids": coded.type_ids}
            logits = session.run(None, {k: np.array([v], np.int64) for k, v in feed.items() if k in wanted})[0][0]
            logits = np.exp(logits - logits.max(axis=1, keepdims=True))
            best, score = logits.argmax(axis=1), logits.max(axis=1) / logits.sum(axis=1)
            rows = zip(best.tolist(), score.tolist(), coded.tokens, coded.offsets, coded.special_tokens_mask, strict=True)
            return [{"entity": labels[b], "word": w, "start": s, "end": e, "score": p} for b, p, w, (s, e), special in rows if not special]

        return run

    return factory


def model_tagger(folder: str):
    """The tagger of a model folder: its quantised ONNX graph, tokenizer and labels (`id2label` of config.json)."""
    import json
    import os

    with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
        named = json.load(f)["id2label"]
    labels = [named[str(i)] for i in range(len(named))]
    return onnx_tagger(os.path.join(folder, "onnx", "model_quantized.onnx"), os.path.join(folder, "tokenizer.json"), labels)
