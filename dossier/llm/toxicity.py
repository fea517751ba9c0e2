"""Toxic passages by maximum-scoring segments (op9).

Words and their stems carry log-odds of toxic against clean training documents under a Dirichlet prior that follows the
counts of the whole corpus, shrunk by their standard errors; a token scores by the feature with the surest evidence. A
linear-time scan finds all maximal scoring segments of a document. Scores of segments follow an extreme-value law: lambda
comes from the token scores of clean texts, K from their best segments. A document's segments are aggregated into one
significance, which a logistic curve turns into a probability.

The margin, the shrinkage and whether stems count are chosen on the training rows alone: these are halved by the hash of
their text, each half is scored with the log-odds of the other under every setting of GRID, and the setting with the least
log loss is taken. The same cross-fitted scores give the law and the curve. The log-odds themselves come from both halves.

Training rows are a bounded sample: at most TRAIN toxic and TRAIN clean labelled documents, those of the smallest hashes
of the id, equal texts once, never any whose crc32 of the id modulo 4 is 2. Their texts stay on the executors; the driver
gets counts by slot, a histogram, and a few numbers for each text and setting. Corpus counts cover all documents. Features
are hashed to 2**22 slots, so the model is bounded. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have no segment and get the score of significance 0. Without both toxic and clean
training rows every score is 0. Repeated rows give repeated rows. Labels that are null or occur for ids without a document
are not used; of several labels of one id the greatest counts. An empty table gives no rows. A text is scored whole, a
block of whole texts at a time; memory is in proportion to the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm import kernel as K
from dossier.llm.common import cut, lean, ship, table

SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Labelled rows of each class that the classifier may learn from.
TRAIN = 10_000
#: Least count of any feature, and words that the corpus prior is worth.
LEAST, PRIOR = 0.5, 500.0
#: Occurrences in training documents from which a feature is evidence, and what a neutral word takes from a segment.
EVIDENCE, COST = 5, 0.5
#: Settings that are tried: log-odds that a token must exceed before it adds to a segment (a language or topic that is a
#: little more often toxic than the rest must not add up word by word), standard errors that log-odds are shrunk by, and
#: whether stems count besides whole words.
GRID = list(product((0.5, 1.0, 1.5), (0.5, 1.0, 2.0), (True, False)))
#: Bins of token scores, to one and in all; and nats below expectation from which a segment no longer adds to a text's significance.
STEP, STEPS, FAR = 32, 1024, 12.0
THRESHOLD = 0.3
#: A segment that stands out by more than so many nats (a chance of about 1 in 20 a text) is a toxic passage.
PASSAGE = 3.0
#: A token's features, most specific first: the whole word, and its first 5 and 4 characters where it has more.
STEMS = (5, 4)

#: Punctuation that is cut off at a word's edges.
_EDGE = np.zeros(256, bool)
_EDGE[[*b".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"]] = True


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots (a row for each feature, -1 for none), start and end of each word, and each row's first word."""
    start, end = K.word_spans(data, at)
    run = np.arange(len(data))
    inner = ~_EDGE[data]
    ahead = np.minimum.accumulate(np.where(inner, run, len(data))[::-1])[::-1]  # next place that isn't edge
    behind = np.maximum.accumulate(np.where(inner, run, -1))
    s = np.minimum(ahead[start], end) if len(start) else start
    e = np.maximum(behind[end - 1] + 1, s) if len(start) else end
    s, e = s[e > s], e[e > s]
    low = K.LOWER[data]
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first_char = np.searchsorted(chars, s)
    chars = np.concatenate([chars, np.full(max(STEMS) + 1, len(data))])
    slots = np.full((1 + len(STEMS), len(s)), -1, np.int64)
    slots[0] = K.span_hashes(low, s, e) >> K.U(64 - SLOT_BITS)
    for k, size in enumerate(STEMS, 1):
        stop = chars[first_char + size]
        longer = stop < e
        slots[k, longer] = K.mix(K.span_hashes(low, s[longer], stop[longer]) + K.U(k)) >> K.U(64 - SLOT_BITS)
    return slots, s, e, np.searchsorted(s, at, "left")


def segments(where: np.ndarray, gain: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end token, score), in time linear in the positive tokens.

    Token where[i] scores gain[i] > 0, every other one -cost. Each positive token is a candidate; candidates wait on a
    stack with the running sums before and after them. One joins backwards to the nearest candidate that begins at a
    smaller sum if it ends above that one's end, and the joined segment is tried again.
    """
    sums = np.cumsum(gain) - cost * (where - np.arange(len(where)))
    held: list[tuple[int, int, float, float]] = []
    smaller: list[int] = []  # for each, the nearest earlier one with a smaller sum before it
    for at, plus, after in zip(where.tolist(), gain.tolist(), sums.tolist(), strict=True):
        begin, before = at, after - plus
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= before:
                k = smaller[k]
            if k < 0 or held[k][3] >= after:
                held.append((begin, at + 1, before, after))
                smaller.append(k)
                break
            begin, before = held[k][0], held[k][2]
            del held[k:], smaller[k:]
    return [(a, b, y - x) for a, b, x, y in held]


@dataclass
class Toxicity:
    slots: np.ndarray  # known slots, ascending
    weights: np.ndarray  # float32 by place among the known slots from 1 on; 0 where there is no evidence either way
    margin: float
    stems: bool
    cost: float  # what a neutral token takes
    rate: float  # lambda of the extreme-value law
    size: float  # K
    slope: float
    shift: float

    def excess(self, scores: np.ndarray, n: int) -> np.ndarray:
        """Of the segments that count, how far each stands out of n words, but for K."""
        out = self.rate * scores - np.log(max(n, 1))
        return out[out > -FAR]

    def nats(self, scores: np.ndarray, n: int) -> np.ndarray:
        """How far each segment's score stands out of a clean text of n words."""
        return self.rate * scores - np.log(max(self.size * max(n, 1), 1e-9))

    def significance(self, excess: np.ndarray) -> float:
        return float(np.log1p(np.logaddexp(0, excess - np.log(max(self.size, 1e-9))).sum())) if len(excess) else 0.0

    def probability(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -50, 50))))


def places(slots: np.ndarray) -> np.ndarray:
    """The place among the known slots of each slot, from 1 on; 0 for others."""
    out = np.zeros(SLOTS, np.int32)
    out[slots] = np.arange(1, len(slots) + 1, dtype=np.int32)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(labels: DataFrame, limit: int = TRAIN) -> DataFrame:
    """(__id, __toxic): at most `limit` labelled ids of each class that may be learnt from, of the smallest id hashes."""
    ok = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = ok.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    order = [F.xxhash64("__id"), F.col("__id")]
    return one.filter("__toxic = 1").orderBy(*order).limit(limit).unionAll(one.filter("__toxic = 0").orderBy(*order).limit(limit))


def _counts(marked: DataFrame, kinds: int, only: np.ndarray | None) -> np.ndarray:
    """Feature counts by kind (the second column) and slot, of the slots in `only`; at most kinds * SLOTS rows."""
    spark = marked.sparkSession
    mask = spark.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((kinds, SLOTS), np.int32)
        for whole in batches:
            for batch, data, at in K.slices(whole, "__text"):
                slots, _, _, first = tokens(data, at)
                label = batch.column(1).to_numpy(zero_copy_only=False)
                of = np.repeat(label, np.diff(first))
                for kind in range(kinds):
                    part = slots[:, of == kind].ravel()
                    part = part[part >= 0]
                    if mask.value is not None:
                        part = part[mask.value[part]]
                    at_slot, n = np.unique(part, return_counts=True)
                    counts[kind, at_slot] += n.astype(np.int32)
        for kind in range(kinds):
            at = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), pa.array(counts[kind][at].astype(np.int64))], ["slot", "kind", "n"])

    got = marked.mapInArrow(lean(run), "slot int, kind int, n long").groupBy("slot", "kind").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((kinds, SLOTS), np.int64)
    out[got["kind"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def weights_of(clean: np.ndarray, toxic: np.ndarray, corpus: np.ndarray, corpus_total: float, errors: float) -> np.ndarray:
    """Shrunk log-odds of each known slot with evidence, else 0; a 0 for unknown slots comes first."""
    prior = LEAST + PRIOR * corpus / max(corpus_total, 1.0)
    a, b = toxic + prior, clean + prior
    n_toxic, n_clean = toxic.sum() + PRIOR, clean.sum() + PRIOR
    odds = np.log(a / (n_toxic - np.minimum(a, n_toxic - 1))) - np.log(b / (n_clean - np.minimum(b, n_clean - 1)))
    error = errors * np.sqrt(1 / a + 1 / b)
    shrunk = np.sign(odds) * np.maximum(np.abs(odds) - error, 0.0)
    return np.concatenate([[0.0], np.where(toxic + clean >= EVIDENCE, np.where(shrunk == 0, -1e-6, shrunk), 0.0)]).astype(np.float32)


def token_scores(known: np.ndarray, weights: np.ndarray, margin: float, stems: bool) -> np.ndarray:
    """Each token's score; `known` has its features' places, a row for each feature."""
    score = weights[known[0]]
    for level in known[1:] if stems else ():  # the feature with the surest evidence decides, the most specific one in a tie
        own = weights[level]
        score = np.where(np.abs(own) > np.abs(score), own, score)
    return score - np.float32(margin)


def known_of(slots: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(slots >= 0, place[np.maximum(slots, 0)], 0)


def _law(train: DataFrame, place, settings) -> list[tuple[np.ndarray, int]]:
    """Under each setting, how often clean texts' positive token scores fall into each bin, and the number of their tokens.

    A setting is (weights by half of the training rows, margin, stems); a text is scored with its own half's entry."""
    n = len(settings.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((n, STEPS), np.int64), 0
        for whole in batches:
            for batch, data, at in K.slices(whole, "__text"):
                slots, _, _, first = tokens(data, at)
                kind = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(first))
                total += int((kind % 2 == 0).sum())
                for half in (0, 1):
                    known = known_of(slots[:, kind == 2 * half], place.value)
                    for i, (weights, margin, stems) in enumerate(settings.value):
                        score = token_scores(known, weights[half], margin, stems)
                        counts[i] += np.bincount(np.minimum(score[score > 0] * STEP, STEPS - 1).astype(np.int64), minlength=STEPS)
        i, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1], pa.int32()), pa.array([*at.tolist(), 0], pa.int32()), pa.array([*counts[i, at].tolist(), total], pa.int64())], ["setting", "bin", "n"])

    got = train.mapInArrow(lean(run), "setting int, bin int, n long").groupBy("setting", "bin").agg(F.sum("n").alias("n")).collect()  # bounded: STEPS rows a setting
    out, total = np.zeros((n, STEPS), np.int64), 0
    for r in got:
        if r["setting"] < 0:
            total = r["n"]
        else:
            out[r["setting"], r["bin"]] = r["n"]
    return [(x, total) for x in out]


def _segments_of(train: DataFrame, place, settings, models) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Under each setting, whether each text is toxic and the excess of its segments that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in K.slices(whole, "__text"):
                slots, _, _, first = tokens(data, at)
                known = known_of(slots, place.value)
                kinds = batch.column(1).to_pylist()
                out = []
                for i, ((weights, margin, stems), model) in enumerate(zip(settings.value, models.value, strict=True)):
                    score = [token_scores(known, w, margin, stems) for w in weights]
                    for r, kind in enumerate(kinds):
                        mine = score[kind // 2][first[r] : first[r + 1]]
                        found = scored_segments(mine, model.cost)
                        out.append((i, kind % 2, batch.column(2)[r].as_py(), model.excess(np.array([x for _, _, x in found]), len(mine))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64())), strict=True)], ["setting", "toxic", "digest", "excess"])

    got = train.mapInArrow(lean(run), "setting int, toxic int, digest string, excess array<double>").toArrow().sort_by([("setting", "ascending"), ("digest", "ascending")])
    which, toxic, excess = got["setting"].to_numpy(), got["toxic"].to_numpy(), got["excess"].to_pylist()
    edges = np.searchsorted(which, np.arange(len(settings.value) + 1))
    return [(toxic[a:b].astype(np.float64), [np.array(x) for x in excess[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def scored_segments(score: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    where = np.flatnonzero(score > 0)
    return segments(where, score[where].astype(np.float64), cost)


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    spark = docs.sparkSession
    ship(spark)
    sample = training_rows(labels).collect()  # bounded: 2 * TRAIN rows of two numbers
    rows = spark.createDataFrame([(r[0], r[1]) for r in sample], T.StructType([T.StructField("__id", labels.schema["doc_id"].dataType), T.StructField("__toxic", T.IntegerType())]))
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(rows), "__id")
    once = texts.groupBy(F.md5("__text").alias("__digest")).agg(F.first("__text").alias("__text"), F.max("__toxic").alias("__toxic"))
    half = F.crc32(F.coalesce("__digest", F.lit("")).cast("binary")) % 2
    train = cut(once.select("__text", (half * 2 + F.col("__toxic")).cast("int").alias("__kind"), F.coalesce("__digest", F.lit("")).alias("__digest")), "toxicity-train")
    counted = _counts(train.select("__text", "__kind"), 4, None)
    clean, toxic = counted[0] + counted[2], counted[1] + counted[3]
    if not clean.any() or not toxic.any():
        return Toxicity(np.zeros(0, np.int64), np.zeros(1, np.float32), 1.0, True, COST, 1.0, 1.0, 0.0, -50.0)
    known = np.flatnonzero(clean + toxic >= EVIDENCE)
    corpus = _counts(docs.select(F.col("text").alias("__text"), F.lit(0).alias("__kind")), 1, clean + toxic >= EVIDENCE)[0][known]
    total = float(corpus.sum())
    # a half is scored with the log-odds of the other one; with those of both where one has no toxic or no clean text
    apart = all(c.any() for c in counted)
    others = [(counted[2][known], counted[3][known]), (counted[0][known], counted[1][known])] if apart else [(clean[known], toxic[known])] * 2
    by_errors = {e: [weights_of(c, t, corpus, total, e) for c, t in others] for e in {e for _, e, _ in GRID}}
    sc = spark.sparkContext
    place, settings = sc.broadcast(places(known)), sc.broadcast([(by_errors[e], margin, stems) for margin, e, stems in GRID])
    models = []
    for (margin, _, stems), (hist, n) in zip(GRID, _law(train, place, settings), strict=True):
        gains = (np.arange(STEPS) + 0.5) / STEP
        # neutral words must outweigh the chance hits of clean texts, so that a text's expected score is negative
        cost = max(COST, 4 * float((gains * hist).sum()) / max(n, 1))
        models.append(Toxicity(known, np.zeros(0, np.float32), margin, stems, cost, extreme_rate(gains, hist, max(n, 1), cost), 1.0, 1.0, 0.0))
    best = None
    shared = sc.broadcast(models)
    for model, (_, errors, _), (y, excess) in zip(models, GRID, _segments_of(train, place, settings, shared), strict=True):
        peaks = [x.max() for x, t in zip(excess, y, strict=True) if not t and len(x)]
        if peaks:  # the mean of a Gumbel law is ln(K n) + 0.5772, so the best segments of clean documents give K
            model.size = float(np.exp(np.mean(peaks) - 0.5772156649))
        x = np.array([model.significance(e) for e in excess])
        model.slope, model.shift = logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -50, 50))), 1e-6, 1 - 1e-6)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[0] - 1e-9:
            best = (loss, model, errors)
    for b in (place, settings, shared):
        b.destroy()
    best[1].weights = weights_of(clean[known], toxic[known], corpus, total, best[2])
    return best[1]


def extreme_rate(gains: np.ndarray, counts: np.ndarray, total: int, cost: float) -> float:
    """lambda: the positive root of E exp(lambda * score) = 1 over the tokens of clean texts, of which counts[i] gain gains[i]."""
    if not counts.any():
        return 1.0
    lo, hi = 0.0, 1.0
    rest = (total - counts.sum()) / total

    def excess(x: float) -> float:
        return rest * np.exp(-x * cost) + float((counts * np.exp(np.minimum(x * gains, 600))).sum()) / total - 1

    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(hi, 1e-2)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method with a small ridge."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxicity(docs: DataFrame, model: Toxicity, passages: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, and with `passages` each significant segment's byte span and score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("__text"), held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = places(m.slots)
        for whole in batches:
            for batch, data, at in K.slices(whole, "__text"):
                slots, start, end, first = tokens(data, at)
                every = token_scores(known_of(slots, place), m.weights, m.margin, m.stems)
                score, spans = [], []
                for r in range(batch.num_rows):
                    n, begin = int(first[r + 1] - first[r]), int(first[r])
                    found = scored_segments(every[begin : begin + n], m.cost)
                    best = np.array([x for _, _, x in found])
                    score.append(m.probability(m.significance(m.excess(best, n))))
                    spans.append([{"start": int(start[begin + i] - at[r]), "end": int(end[begin + j - 1] - at[r]), "score": x} for (i, j, x), e in zip(found, m.nats(best, n) if found else (), strict=True) if e > PASSAGE])
                columns = [batch.column(0), batch.column(2), pa.array(score), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array([len(s) for s in spans], pa.int32())]
                if passages:
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_passages", *(["passages"] if passages else [])])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages int" + (", passages array<struct<start:bigint,end:bigint,score:double>>" if passages else ""))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
