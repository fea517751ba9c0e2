"""Byte-level BPE: encoding and decoding by forced-boundary splitting (op3), and the vocabulary helpers op2 shares.

A cut between bytes a|b is *forced* when no vocabulary token holds a followed by b: no merge can ever cross it. Two steps
use it. First, texts are cut where a forced pair is also sure to be a border of the pre-tokenizer's pieces whatever surrounds
it: before ASCII white space that follows a character which isn't white space. Such fragments repeat, so each task keeps a
memo of the short ones, bounded in bytes. Second, a long fragment (text without such a cut) is split into the pre-tokenizer's
pieces, and these at every forced pair, wherever it lies: inside words, numbers, and scripts without spaces. Every part is
encoded on its own and the ids are concatenated.

Defined results: a null or empty text has no tokens, its ids string is empty and so is its decoded text. The special
string inside a text gives its special id. Repeated rows give repeated rows; nothing is grouped or joined. Extra columns
play no part. Memory is in proportion to the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import kernel as K
from dossier.llm.common import lean, ship, table

#: Bytes that a task's memo of fragments may hold, bytes that an entry takes besides its strings, and the longest fragment in it.
MEMO, ENTRY, SHORT = 40 << 20, 300, 64
#: The split of the byte-level pre-tokenizer, which its files name and don't spell out; fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = b"\t\n\x0b\x0c\r "
#: UTF-8 tails of the white space characters beyond ASCII (fixed values of Unicode's White_Space property).
WIDE_WHITE = rb"(?<=\xc2[\x85\xa0])|(?<=\xe1\x9a\x80)|(?<=\xe2\x80[\x80-\x8a\xa8\xa9\xaf])|(?<=\xe2\x81\x9f)|(?<=\xe3\x80\x80)"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer file: ids, token bytes, special strings, forced pairs."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} isn't plain byte-level BPE")
        to_byte = {c: b for b, c in enumerate(_byte_alphabet())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes_of = {i: token for token, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.core = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.together = np.zeros((256, 256), bool)  # together[a, b]: some token holds a followed by b
        for token in ranks:
            raw = np.frombuffer(token, np.uint8)
            self.together[raw[:-1], raw[1:]] = True
        self.piece = regex.compile(SPLIT)
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def encode(self, text: str) -> list[int]:
        """Ids of a text as the file's own library gives them, special strings included."""
        return self.core.encode(text, allowed_special="all", disallowed_special=())

    def forced(self, raw: bytes) -> list[int]:
        """Places of all forced cuts: between two bytes that no token holds side by side."""
        data = np.frombuffer(raw, np.uint8)
        return (np.flatnonzero(~self.together[data[:-1], data[1:]]) + 1).tolist()

    def encode_long(self, text: str) -> list[int]:
        """Ids of a text without special strings: the pre-tokenizer's pieces are cut at every forced pair."""
        out: list[int] = []
        for m in self.piece.finditer(text):
            raw = m[0].encode()
            if len(raw) <= SHORT:
                out += self.core._encode_single_piece(raw)
            else:
                for begin, end in pairwise([0, *self.forced(raw), len(raw)]):
                    out += self.core._encode_single_piece(raw[begin:end])
        return out

    def fragment_pattern(self) -> re.Pattern[bytes]:
        """Matches one fragment after another of UTF-8 text: cuts only where the byte pair is forced and the split is sure."""
        not_forced = []
        for b in WHITE:
            if prior := bytes(a for a in range(256) if self.together[a, b] and a not in WHITE):
                not_forced.append(b"(?<=[" + re.escape(prior) + b"])" + re.escape(bytes([b])))
        uncut = b"|".join([*not_forced, b"(?:" + WIDE_WHITE + rb")[\t-\r ]"])
        return re.compile(rb"[\t-\r ]*(?:[^\t-\r ]+(?:(?:" + uncut + rb")[\t-\r ]*)?)+|[\t-\r ]+")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


class _Memo(dict):
    """fragment -> what `make` says of it. Long ones aren't kept; at half of MEMO bytes the entries become the old generation,
    from which those still in use come back, and the one before it is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.size, self.old = make, 0, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= SHORT:
            self.size += len(key) + len(out[0]) + len(out[1]) + ENTRY
            if 2 * self.size > MEMO:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[key] = out
        return out


class Codec:
    """Encodes by forced-boundary splitting and decodes again."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.split = self.bpe.fragment_pattern().findall
        self.memo = _Memo(self._fragment)

    def _fragment(self, piece: bytes) -> tuple[str, bytes]:
        text = piece.decode()
        ids = self.bpe.core.encode_ordinary(text) if len(piece) <= SHORT else self.bpe.encode_long(text)
        return ",".join(map(str, ids)), b"".join(map(self.bpe.bytes_of.__getitem__, ids))

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        """(ids joined by commas, bytes that those ids decode to) of each fragment, in order."""
        special = self.bpe.special_split
        if special is None or not special.search(text):
            return list(map(self.memo.__getitem__, self.split(text.encode())))
        out = []
        for i, part in enumerate(special.split(text)):
            if i % 2:
                out.append((str(self.bpe.special[part]), self.bpe.bytes_of[self.bpe.special[part]]))
            else:
                out += map(self.memo.__getitem__, self.split(part.encode()))
        return out

    def ids(self, text: str) -> str:
        return ",".join(x for x, _ in self.pieces(text))

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        ids, back = zip(*self.pieces(text), strict=True)
        joined = ",".join(ids)
        return joined.count(",") + 1, joined, b"".join(back).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` the ids as an array<int> and the decoded text."""
    ship(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keep).schema]
    schema = ", ".join([*(f"`{x.split(' ', 1)[0]}` {x.split(' ', 1)[1]}" for x in fields), "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for whole in batches:
            for batch, _, _ in K.slices(whole, "__text"):
                n, ids_sha, back_sha, all_ids, all_back = [], [], [], [], []
                for x in batch.column(len(keep)):
                    count, ids, back = codec.round_trip(x.as_py() or "")
                    n.append(count)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    back_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids.split(",") if ids else [], np.int32))
                        all_back.append(back)
                columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_back, pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    return kept.mapInArrow(lean(run), schema)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
