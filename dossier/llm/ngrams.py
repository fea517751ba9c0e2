"""Character n-gram counts of each language as a table, and their modified Kneser-Ney costs (for op5).

Symbols are code points (ASCII letters without case, white space as one blank), so the alphabet is open and every language
is apart. The distinct n-grams of order ORDER are rows (key, lang, a, b, n) of a table that grows with the corpus: b packs
the last three code points, a those before, and key is the 64-bit hash of (lang, a, b) that the gram is found by. Lower
orders are counts of left contexts, made from it by grouping; nothing of the model is held whole anywhere.

The costs are sorted hash arrays, cut into ranges of about SLICE keys that are broadcast. With one range each block of text
is looked up in it. With more, a task holds HOLD bytes of text (or the blocks of HELD distinct grams), reads one range after
the other for their distinct grams only, and scores the held blocks from what it found, so neither the driver nor a worker
holds more than one range, and ranges are read once for many blocks.

Counts are integers and each cost is one expression of them, so results don't depend on partitions or order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import kernel as K
from dossier.llm.common import cut, discard, lean, ship

ORDER, POINT = 5, 21
#: Fixed-point logarithms: this many to a bit. Costs end at -log2 LEAST, below 2**16 of them.
SCALE, LEAST = 1024, 1e-12
#: Distinct grams that a counting task holds before it sends them on, and keys of a range of the table of costs.
RUN, SLICE = 3 << 17, 1 << 21
#: Runs of leading bits whose places are looked up at a time.
STEP = 1 << 16
#: Bytes of text and distinct grams that a task holds for one reading of all ranges, and bytes of a long text at a time.
HOLD, HELD, WINDOW = 1 << 25, 1 << 21, 1 << 18
FOLD = np.arange(256, dtype=np.int64)
FOLD[65:91] += 32
FOLD[K.SPACE] = 32
WIDTH = np.ones(256, np.int64)
WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:] = 2, 3, 4


def lang_id(lang: str | None) -> int:
    name = b"\0" if lang is None else b"\1" + lang.encode()
    return int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "big", signed=True)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a and b of the gram that ends at each code point (as if blanks came before the row), and the rows' offsets."""
    real = (data & 0xC0) != 0x80
    offset = np.concatenate([[0], np.cumsum(real)])[at]
    lead = np.flatnonzero(real)
    width = WIDTH[data[lead]]
    point = FOLD[data[lead]]
    wide = np.flatnonzero(width > 1)
    if len(wide):
        where, w = lead[wide], width[wide]
        value = data[where].astype(np.int64) & (0x7F >> w)
        for k in range(1, 4):
            value = np.where(w > k, (value << 6) | (data[np.minimum(where + k, len(data) - 1)] & 0x3F), value)
        point[wide] = value
    pad = ORDER - 1
    point = np.insert(point, np.repeat(offset[:-1], pad), 32)
    n = len(point) - pad if len(point) else 0
    keep = np.arange(offset[-1]) + np.repeat(np.arange(len(at) - 1), np.diff(offset)) * pad  # windows by row, without those in padding
    a = ((point[:n] << POINT) | point[1 : n + 1])[keep]
    b = ((point[2 : n + 2] << 2 * POINT) | (point[3 : n + 3] << POINT) | point[4 : n + 4])[keep]
    return a, b, offset


def gram_runs(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b and row offsets of a run of rows; a single long row comes in several such runs."""
    if len(at) != 2 or len(data) <= 2 * WINDOW:
        yield grams(data, at)
        return
    begin = 0
    while begin < len(data):
        end = min(begin + WINDOW, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        back, context = begin, 0
        while back and context < ORDER - 1:
            back -= 1
            context += int(data[back] & 0xC0 != 0x80)
        a, b, _ = grams(data[back:end], np.array([0, end - back]))
        yield a[context:], b[context:], np.array([0, len(a) - context])
        begin = end


def keys(lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    u = np.uint64
    return K.mix(K.mix(lang.view(u) ^ (a.view(u) * u(K.BASE))) + b.view(u)).view(np.int64)


def _rows_langs(batch: pa.RecordBatch, offset: np.ndarray) -> np.ndarray:
    names = batch.column(batch.num_columns - 1).to_pylist()
    known = {x: lang_id(x) for x in set(names)}
    return np.repeat(np.array([known[x] for x in names], np.int64), np.diff(offset))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, a, b, n): how often each gram of each language occurs in all documents."""
    ship(docs.sparkSession)

    def merged(held: list) -> tuple:
        key, lang, a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        return key[first], lang[first], a[first], b[first], np.bincount(back, n).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["key", "lang", "a", "b", "n"])

        for whole in batches:
            for batch, data, at in K.slices(whole, "__text"):
                for a, b, offset in gram_runs(data, at):
                    of = _rows_langs(batch, offset)
                    key = keys(of, a, b)
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    held.append((key[first], of[first], a[first], b[first], n))
                    size += len(first)
                if size >= RUN:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if 2 * size >= RUN:
                        yield rows(held[0])
                        held, size = [], 0
        if held:
            yield rows(merged(held))

    part = docs.select(F.col(text).alias("__text"), F.col(lang).alias("__lang")).mapInArrow(lean(run), "key long, lang long, a long, b long, n long")
    return part.groupBy("key", "lang", "a", "b").agg(F.sum("n").alias("n"))


def probabilities(counted: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """(key, lang, a, b, p): the interpolated modified Kneser-Ney probability of each counted gram's last symbol. The tables
    that it reads are added to `made`."""
    mask = lambda k: F.lit((1 << POINT * k) - 1)
    a, b, none = F.col("a"), F.col("b"), F.lit(0).cast("long")
    #: the same gram without its first symbol, by order
    shorter = {5: (a.bitwiseAND(mask(1)), b), 4: (none, b), 3: (none, b.bitwiseAND(mask(2))), 2: (none, b.bitwiseAND(mask(1)))}
    levels = {ORDER: counted}
    for k in range(ORDER, 1, -1):
        x, y = shorter[k]
        levels[k - 1] = cut(levels[k].groupBy("lang", x.alias("a"), y.alias("b")).agg(F.count("*").alias("n")), f"quality-grams-{k - 1}")
        if made is not None:
            made.append(levels[k - 1])
    is_n = lambda k: F.count_if(F.col("n") == k).cast("double")
    p = None
    for k in range(1, ORDER + 1):
        level = levels[k]
        c1, c2, c3, c4 = (F.col(f"c{i}") for i in range(1, 5))
        y = F.when(c1 > 0, c1 / (c1 + 2 * c2)).otherwise(0.5)
        d = [F.when((c > 0) & (e > 0), F.least(F.greatest(i - (i + 1) * y * e / c, F.lit(0.05)), F.lit(i - 0.05))).otherwise(0.5 * i) for i, c, e in ((1, c1, c2), (2, c2, c3), (3, c3, c4))]
        by_lang = level.groupBy("lang").agg(*(is_n(i).alias(f"c{i}") for i in range(1, 5)), F.count("*").alias("size")).select("lang", *(x.alias(f"d{i + 1}") for i, x in enumerate(d)), "size")
        context = level.groupBy("lang", "a", F.shiftright("b", POINT).alias("ctx")).agg(F.sum("n").alias("total"), is_n(1).alias("n1"), is_n(2).alias("n2"), F.count_if(F.col("n") >= 3).cast("double").alias("n3"))
        rows = level.withColumn("ctx", F.shiftright("b", POINT)).join(context, ["lang", "a", "ctx"]).join(F.broadcast(by_lang), "lang")  # broadcast: one row for each language
        if p is None:
            rows = rows.withColumn("less", 1.0 / F.col("size"))
        else:
            x, y = shorter[k]
            rows = rows.withColumn("la", x).withColumn("lb", y).join(p.select("lang", F.col("a").alias("la"), F.col("b").alias("lb"), F.col("p").alias("less")), ["lang", "la", "lb"])
        n = F.col("n")
        off = F.when(n >= 3, F.col("d3")).when(n == 2, F.col("d2")).otherwise(F.col("d1"))
        back = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")
        p = rows.select(*(["key"] if k == ORDER else []), "lang", "a", "b", ((n - off + back * F.col("less")) / F.col("total")).alias("p"))
    return p


class Model:
    """Sorted hash arrays of (key, cost), broadcast in ranges; every gram of a document that was counted is in one of them."""

    def __init__(self, table: DataFrame):
        spark = table.sparkSession
        cost = F.rint(-F.log2(F.greatest("p", F.lit(LEAST))) * SCALE).cast("int")
        costs = cut(table.select("key", cost.alias("cost")), "quality-costs")
        n = max(1, -(-costs.count() // SLICE))
        edges = [(-1 << 63) + (i << 64) // n for i in range(n)]
        self.ranges = []
        for i, least in enumerate(edges):
            some = costs.filter(F.col("key") >= least) if i + 1 == n else costs.filter((F.col("key") >= least) & (F.col("key") < edges[i + 1]))
            got = some.toArrow()  # bounded: about SLICE rows
            key, cost = ordered(got["key"].to_numpy()), got["cost"].to_numpy().astype(np.uint16)
            order = np.argsort(key)
            self.ranges.append(spark.sparkContext.broadcast((key[order], cost[order])))
        discard(costs)

    def close(self) -> None:
        """Takes the ranges from all nodes; only after what was scored with them has been written."""
        for r in self.ranges:
            r.destroy()


def ordered(key: np.ndarray) -> np.ndarray:
    """Signed keys as unsigned numbers of the same order."""
    return key.view(np.uint64) ^ np.uint64(1 << 63)


class Finder:
    """Sorted keys with the place where each run of leading bits starts; keys are hashes, so such a run holds about one."""

    def __init__(self, key: np.ndarray, cost: np.ndarray):
        self.key, self.cost = key, cost
        if not len(key):
            return
        self.low, span = key[0], int(key[-1] - key[0])
        self.shift = np.uint64(max(0, span.bit_length() - len(key).bit_length()))
        last = int((key[-1] - self.low) >> self.shift)
        self.start = np.zeros(last + 1, np.int32)
        for at in range(0, last + 1, STEP):
            begins = (np.arange(at, min(at + STEP, last + 1), dtype=np.uint64) << self.shift) + self.low
            self.start[at : at + STEP] = np.searchsorted(key, begins)

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds to `out` the cost of each key that is here."""
        if not len(self.key) or not len(x):
            return
        rows = None
        if x.min() < self.low or x.max() > self.key[-1]:
            rows = np.flatnonzero((x >= self.low) & (x <= self.key[-1]))
            x = x[rows]
        at = self.start[((x - self.low) >> self.shift).view(np.int64)]
        behind = np.flatnonzero(self.key[at] < x)
        while len(behind):
            at[behind] += 1  # ends at the last key, which no x is beyond
            behind = behind[self.key[at[behind]] < x[behind]]
        cost = np.where(self.key[at] == x, self.cost[at], 0)
        if rows is None:
            out += cost
        else:
            out[rows] += cost


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    made = [cut(counts(docs, text, lang), "quality-grams")]
    model = Model(probabilities(made[0], made))
    discard(*made, at_once=True)
    return model


Part = tuple[pa.RecordBatch, np.ndarray, np.ndarray]


def _keys_of(part: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    batch, data, at = part
    for a, b, offset in gram_runs(data, at):
        yield ordered(keys(_rows_langs(batch, offset), a, b)), offset


def _sums(part: Part, finder: Finder) -> tuple[np.ndarray, np.ndarray]:
    total, symbols = np.zeros(part[0].num_rows, np.int64), np.zeros(part[0].num_rows, np.int64)
    for key, offset in _keys_of(part):
        cost = np.zeros(len(key), np.int64)
        finder.add(key, cost)
        upto = np.concatenate([[0], np.cumsum(cost)])
        total += upto[offset[1:]] - upto[offset[:-1]]
        symbols += np.diff(offset)
    return total, symbols


def symbol_costs(model: Model, parts: Iterator[Part]) -> Iterator[tuple[Part, np.ndarray, np.ndarray]]:
    """Of each part (rows, their bytes and offsets; the language is the last column): the sum of the costs of each row's
    symbols, in 1/SCALE bit, and their number. Runs on executors."""
    if len(model.ranges) == 1:
        finder = Finder(*model.ranges[0].value)
        for part in parts:
            yield part, *_sums(part, finder)
        return
    held: list[Part] = []
    seen: list[np.ndarray] = []
    size = grams_held = 0

    def flush() -> Iterator[tuple[Part, np.ndarray, np.ndarray]]:
        key = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        cost = np.zeros(len(key), np.int64)
        for r in model.ranges:
            Finder(*r.value).add(key, cost)
            if hasattr(r, "_value"):
                del r._value
        finder = Finder(key, cost)
        for part in held:
            yield part, *_sums(part, finder)

    for part in parts:
        held.append(part)
        fresh = [np.unique(key) for key, _ in _keys_of(part)]
        seen += fresh
        size += len(part[1])
        grams_held += sum(map(len, fresh))
        if grams_held >= HELD:
            seen = [np.unique(np.concatenate(seen))]
            grams_held = len(seen[0])
        if size >= HOLD or 2 * grams_held >= HELD:
            yield from flush()
            held, seen, size, grams_held = [], [], 0, 0
    yield from flush()
