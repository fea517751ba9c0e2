"""Token counts of whole texts by overlap resynchronisation (op2).

A huge text is never encoded at once. It is cut into chunks that overlap; every chunk is encoded with offsets, and two
neighbours are spliced at a *proven stable common boundary* of their overlap. Such a place
- ends a token in both encodings, which shows that the right one, whose chunk begins anywhere, has found its step;
- is a border of the pre-tokenizer's pieces whatever surrounds it: white space after a character that isn't, or a change
  between ASCII letters, digits and signs, but for the letters after an apostrophe;
- lies at least a guard before the left chunk's end, so that no special string, and nothing the pre-tokenizer looks ahead to, is cut.
From there on both encodings depend on the same text only, since the pre-tokenizer never looks back. Where the overlap holds
no such place it is widened, twice as far each time, up to the end of the text if need be.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows; nothing is grouped. Extra
columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import kernel as K
from dossier.llm.bpe import ByteBPE, load, tokenizer_path
from dossier.llm.common import lean, ship, table

#: Characters in a chunk, and by which neighbours overlap at first.
CHUNK, OVERLAP = 8_192, 256
#: A boundary nearer than this to a chunk's end isn't proven: a contraction or a special string might go on beyond it.
GUARD = 24
LIMIT = 512
#: Kinds of ASCII characters: 0 white space and controls, 1 letters, 2 digits, 3 signs.
KIND = np.full(128, 3, np.uint8)
KIND[:0x21] = KIND[0x7F] = 0
KIND[0x30:0x3A] = 2
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1


def is_border(raw: bytes, at: int) -> bool:
    """Whether the pre-tokenizer splits before byte `at` whatever surrounds it."""
    after = raw[at]
    if after >= 0x80:
        return False
    if K.SPACE[after]:
        return not raw[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:].isspace()
    before = raw[at - 1]
    return before < 0x80 and before != 0x27 and KIND[before] != 0 and KIND[after] != 0 and KIND[before] != KIND[after]


class Splicer:
    def __init__(self, bpe: ByteBPE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.guard = max([GUARD, *(len(s) + 1 for s in bpe.special)])
        self.bpe, self.chunk, self.overlap = bpe, chunk, max(overlap, 2 * self.guard)
        if chunk <= self.overlap + self.guard:
            raise ValueError("a chunk must be longer than the overlap")
        self.length = np.zeros(max(bpe.bytes_of) + 1, np.int64)
        for i, token in bpe.bytes_of.items():
            self.length[i] = len(token)
        self.spliced = self.widened = 0

    def coded(self, part: str) -> tuple[list[int], np.ndarray]:
        """Ids of a chunk and the byte at which each ends."""
        ids = self.bpe.encode(part)
        return ids, np.cumsum(self.length[ids])

    def boundary(self, overlap: str, left: np.ndarray, right: np.ndarray) -> int:
        """The last proven boundary in the overlap, in bytes from its start; 0 if there is none."""
        raw, limit = overlap.encode(), len(overlap[: -self.guard].encode())
        both = np.intersect1d(left[(left > 0) & (left <= limit)], right)
        return next((at for at in both[::-1].tolist() if is_border(raw, at)), 0)

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, encoded a chunk at a time."""
        if len(text) <= self.chunk:
            return self.bpe.encode(text)
        out: list[int] = []
        begin, end, done = 0, self.chunk, 0  # the left chunk, and how many of its tokens come before its splice
        ids, ends = self.coded(text[:end])
        while end < len(text):
            start, wider = end - self.overlap, self.overlap
            while True:
                stop = min(len(text), end + self.chunk - self.overlap)
                right, right_ends = self.coded(text[start:stop])
                shift = len(text[begin:start].encode())
                if at := self.boundary(text[start:end], ends - shift, right_ends):
                    break
                self.widened += 1
                end, wider = min(len(text), end + wider), 2 * wider
                ids, ends = self.coded(text[begin:end])
                if end == len(text):
                    return out + ids[done:]
            self.spliced += 1
            out += ids[done : int(np.searchsorted(ends, at + shift)) + 1]
            ids, ends, done = right, right_ends, int(np.searchsorted(right_ends, at)) + 1
            begin, end = start, stop
        return out + ids[done:]


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_bytes, n_tokens and whether there are more than `limit` tokens."""
    ship(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema), "n_bytes long", "n_tokens long", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splicer = Splicer(load(path), chunk, overlap)
        for whole in batches:
            for batch, _, at in K.slices(whole, "__text"):
                n = [len(splicer.encode(x.as_py() or "")) for x in batch.column(len(keep))]
                columns = [*batch.columns[: len(keep)], pa.array(np.diff(at)), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(lean(run), schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
