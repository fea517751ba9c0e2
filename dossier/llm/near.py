"""N-gram Jaccard join with multiple global orders (op4), and the components of its links.

Two documents link when 100 * |intersection| >= NUM * |union| of their shingle sets. A set of n shingles misses at most
m = n - ceil(NUM * n / 100) of a linked set, so under any order of all shingles the first m + 1 of both share one. The
filter holds within any fixed part of all shingles unless both sets have only m or fewer there; longer sets use a smaller
part (TIERS), and a document with so few in its part also stands with its whole set in a tier of such documents (THIN).

Order 1 is rarest first: shingles are counted over the corpus, and those of a single document are never emitted, so a
passage that many documents share makes no candidates of documents that differ elsewhere. The few hottest shingles (at
most HOT_MAX, found by task-local counts and broadcast) come last in that order and are never shuffled but by documents
that hold almost nothing else. Orders 2 and 3 are random. A pair is emitted only where both have a shingle of order 1's
prefix and the sketches of their prefixes under orders 2 and 3 meet; before sets are fetched, those prefixes themselves must.

Lists of documents that share a shingle are told apart by their members: of lists of equal members (a shared passage gives
one for each of its shingles) one is joined. Every list row carries its set's size and BITS parities: two parity bitmaps
differ in no more bits than the sets in shingles, so pairs that differ too much are dropped inside the join. Sets of the
longer tiers have parities of a sample of all shingles; a pair is then dropped beyond the bound's expected share in the
sample by MARGIN standard deviations, which loses a linked pair with a probability below 1e-13, as does a collision of
two of its 64-bit shingle hashes.

Near copies in their thousands are joined without all their pairs: equal sets are one node; each member of a list is first
compared with LEADERS leaders of the list of like length; then, once those links have been contracted, only pairs whose
documents are still in different components are generated and compared, long lists in salted parts. A pair that shares a
prefix shingle is thus compared or already connected, so no component is lost. Near copies share dozens of lists: a pair is
emitted only from the first list that both documents have among the HEADS smallest of their longer lists, as it is tested alike
in all. What is emitted is verified by blocks of a list: a set goes once to each block of its list, not once with each pair.

Defined results: a text without words has the empty set and links with nothing. Fewer words than a shingle make one
shingle. Equal sets link. Rows of one id are one node of the join: their links are pooled, also where their texts differ.
A null id links with nothing and has a null component. Empty tables give no rows. `drop_near_copies` decides by row instead:
of a component stays the row of the smallest id (then of the smallest text hash), once; rows of null ids and of texts without
words stay, the latter once for equal id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm import kernel as K
from dossier.llm.common import HOT, cut, discard, hot_keys, join_by_key, join_salted, lean, ship, table

WORDS, NUM = 5, 80
#: Least size of a set in each tier; a set is in every tier from its least size up to OVERLAP times the next tier's, so that
#: both sets of a linking pair share a tier. THIN is the tier of whole sets of documents with too few shingles in a part.
TIERS = (0, 128, 512, 2048, 8192, 32768, 131072)
OVERLAP, THIN = 1.25, 7
HOT_MAX = 200_000
#: A shingle in more than one of HOT_SHARE documents of a run of documents may be hot; runs hold so many shingles.
HOT_SHARE, RUN = 200, 1 << 20
BITMAP = 1 << 26
#: Bits of a set's parity bitmap and of its sketch under each random order, and leaders of a posting list.
BITS, SKETCH, LEADERS = 512, 128, 8
#: Shingles that two linked sets of the longest size of a tier differ by in its sample, at most; standard deviations and
#: shingles beyond the expected difference from which a sampled pair is dropped.
SAMPLE, MARGIN, SPARE = 110, 8.0, 12.0
#: Members of a list that meet all its other members in one task.
SALT = 4096
#: Members from which a list is one of the longer ones, of which a document's HEADS smallest tell which list emits a pair; and
#: shingles of a list's sets in one side of a block.
LONGER, HEADS, SIDE = 16, 8, 1 << 14
#: Links in a file, and of a node from which it is a hub (if they also are more than one in HOT of all).
FILE, HUB = 500_000, 500
#: Seeds of the hashes that make orders 2 and 3.
SEEDS = (0x5DEECE66D, 0x2545F4914F6CDD1D)
FACTS = [*(f"w{i}" for i in range(BITS // 64)), *(f"o{k}{i}" for k in (2, 3) for i in range(SKETCH // 64))]
U = np.uint64


def missing(n: int, num: int) -> int:
    """The most shingles of a set of n that a linked set may lack."""
    return n - -(-num * n // 100)


def tiers_of(n: int) -> list[int]:
    ends = [int(t * OVERLAP) for t in TIERS[1:]] + [1 << 62]
    return [i for i, (t, end) in enumerate(zip(TIERS, ends, strict=True)) if t <= n < end]


def part_of(tier: int, num: int) -> float:
    """The part of all shingles that stands for a tier's sets."""
    loss = 1 - num / 100
    return 1.0 if tier in (0, THIN) else min(1.0, max(0.5, 2.5 * loss)) if tier == 1 else min(1.0, max(0.3, 2 * loss))


def sampled(tier: int, num: int) -> float:
    """The part of all shingles that a tier's parities are of."""
    if tier == THIN:
        return 1.0
    longest = OVERLAP * (TIERS[tier + 1] if tier + 1 < len(TIERS) else 4 * TIERS[tier])
    apart = 2 * (100 - num) / (100 + num) * longest
    return 1.0 if apart <= 0.4 * BITS else SAMPLE / apart


def _part(values: np.ndarray, share: float) -> np.ndarray:
    """The sorted values in a part of all shingles."""
    return values if share >= 1 else values[: int(np.searchsorted(values, U(int(share * 2**64))))]


def _tag(values: np.ndarray, tier: int) -> np.ndarray:
    """Shingle keys of a tier, as signed numbers."""
    return ((values & ~U(7)) | U(tier)).astype(np.int64)


def _tier(h: str) -> Column:
    return F.col(h).bitwiseAND(F.lit(7))


def _hash(d: int, digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(d.to_bytes(8, "big", signed=True) + digest, digest_size=8).digest(), "big", signed=True)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _first(values: np.ndarray, seed: int, need: int) -> np.ndarray:
    """Hashes of the first `need` shingles under a random order."""
    order = K.mix(values ^ U(seed))
    return np.partition(order, need - 1)[:need] if need < len(order) else order


def _packed(places: np.ndarray, size: int) -> np.ndarray:
    """Parities of how often each place occurs, 64 to a number."""
    return np.packbits((np.bincount(places.astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def _facts(values: np.ndarray, num: int, tier: int) -> np.ndarray:
    """Parities of the shingles that the tier samples, and sketches of the prefixes under orders 2 and 3."""
    mixed = K.mix(values ^ U(0x6C62272E07BB0142))
    if (share := sampled(tier, num)) < 1:
        mixed = mixed[mixed < U(int(share * 2**64))]
    need = missing(len(values), num) + 1
    return np.concatenate([_packed(mixed & U(BITS - 1), BITS), *(_packed(np.unique(_first(values, seed, need) & U(SKETCH - 1)), SKETCH) for seed in SEEDS)])


def _standing(values: np.ndarray, num: int, share=part_of) -> list[tuple[int, np.ndarray]]:
    """(tier, shingles that stand for the set there), with the whole set in THIN where a part has too few."""
    m = missing(len(values), num)
    found = [(tier, _part(values, share(tier, num))) for tier in tiers_of(len(values))]
    return [*found, (THIN, values)] if any(len(part) <= m for _, part in found) else found


def _rows(batches: Iterator[pa.RecordBatch], k: int):
    """(row's place, its batch, sorted shingle array) of every row; texts are in the column __text."""
    for whole in batches:
        for batch, data, at in K.slices(whole, "__text"):
            values, offset = K.shingle_sets(data, at, k)
            for r in range(batch.num_rows):
                yield r, batch, values[offset[r] : offset[r + 1]]


PROFILE = "kind int, d long, t long, n long, digest binary, h long, tier int, facts array<long>"


def profiles(docs: DataFrame, k: int, num: int) -> DataFrame:
    """Rows of documents (kind 0: d, t, n, digest, h), hot shingles (1: h, n) and facts of a document in a tier (2: d, h, n, tier, facts)."""

    def run(batches):
        held: list[np.ndarray] = []
        size = documents = 0
        out: list[tuple] = []

        def hot():
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                much = c >= max(8, documents // HOT_SHARE)
                out.extend((1, None, None, int(x), None, int(y), None, None) for x, y in zip(c[much], h[much], strict=True))

        def rows():
            kind, d, t, n, digest, h, tier, facts = zip(*out, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip((kind, d, t, n, digest, h, tier, facts), kinds, strict=True)], [x.split(" ")[0] for x in PROFILE.split(", ")])

        for r, batch, values in _rows(batches, k):
            d, t, n = batch.column(0)[r].as_py(), batch.column(2)[r].as_py(), len(values)
            digest = _digest(values)
            h = None if d is None else _hash(d, digest)
            out.append((0, d, t, n, digest, h, None, None))
            for tier, part in _standing(values, num) if n and d is not None else ():
                out.append((2, d, None, n, None, h, tier, _facts(values, num, tier)))
                held.append(_tag(part, tier))
                size += len(part)
            documents += 1
            if size >= RUN:
                hot()
                held, size, documents = [], 0, 0
            if len(out) >= 2048:
                yield rows()
                out.clear()
        hot()
        if out:
            yield rows()

    return docs.mapInArrow(lean(run), PROFILE)


def _bit(d: str) -> Column:
    return F.pmod(F.xxhash64(d), F.lit(BITMAP))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the places b that occur; others that fall on the same bits must do no harm."""
    words = ids.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toArrow()  # bounded: BITMAP / 64 rows
    out = np.zeros(BITMAP >> 6, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, b: int) -> bool:
    return len(bits) > 0 and bool(int(bits[b >> 6]) >> (b & 63) & 1)


def _picked(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose id's place (the third column) is in a bitmap."""
    for batch in batches:
        b = batch.column(2).to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array((wanted[b >> 6] >> (b & 63).astype(np.uint64)) & U(1) == 1))
        if batch.num_rows:
            yield batch


def shingle_rows(docs: DataFrame, ids: DataFrame, k: int, num: int, hot: np.ndarray, several: np.ndarray) -> DataFrame:
    """(h, k, extra, hots): shingles of the documents whose id's place `b` is in `ids` in their tiers but the hot ones; a row with
    extra > 0 tells of the document: 2**40 + the prefix length less the shingles that aren't hot, with the hot shingles of its prefix.

    A document's key is its id, or a hash of id and set where its id's bit says that the id has several sets."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, several, _bitmap(ids)))

    def run(batches):
        known, bits, wanted = shared.value
        h, key, extra, hots = [], [], [], []
        size = 0

        def flush():
            n = [len(x) for x in h]
            flat = np.concatenate(h)
            more = np.zeros(len(flat), np.int64)
            first = np.cumsum([0, *n[:-1]])
            more[first] = extra
            sizes = np.zeros(len(flat) + 1, np.int32)
            has = np.zeros(len(flat), bool)
            lists = [x for x in hots if x is not None]
            at = first[[i for i, x in enumerate(hots) if x is not None]] if lists else np.zeros(0, np.int64)
            sizes[at + 1] = [len(x) for x in lists]
            has[at] = True
            column = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64), pa.int64()), mask=pa.array(~has))
            return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(key, np.int64), n)), pa.array(more), column], ["h", "k", "extra", "hots"])

        for r, batch, values in _rows(_picked(batches, wanted), k):
            d = batch.column(0)[r].as_py()
            if d is None or not len(values):
                continue
            own = _hash(d, _digest(values))
            need = missing(len(values), num) + 1
            for tier, part in _standing(values, num):
                tagged = _tag(part, tier)
                at = np.minimum(np.searchsorted(known, tagged), max(len(known) - 1, 0))
                is_hot = known[at] == tagged if len(known) else np.zeros(len(tagged), bool)
                cold = tagged[~is_hot]
                # the first row of a document in a tier is about it; its key is no shingle's
                h.append(np.concatenate([np.array([(own & ~7) | tier], np.int64), cold]))
                key.append(own if _has(bits, batch.column(2)[r].as_py()) else d)
                extra.append((1 << 40) + need - len(cold))
                hots.append(tagged[is_hot][: need - len(cold)] if need > len(cold) else None)
                size += len(cold) + 1
            if size >= 1 << 16:
                yield flush()
                h, key, extra, hots, size = [], [], [], [], 0
        if h:
            yield flush()

    return docs.mapInArrow(lean(run), "h long, k long, extra long, hots array<long>")


def postings(tokens: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, k): the shingles of each document's prefix under order 1 that some other document has too, for the keys of `firsts`.

    A document knows how many shingles aren't hot; those that don't come back with a count of 2 or more are its own
    alone, are the rarest, and fill the prefix first. They are dealt to their documents as rows: a task of shingles has
    hardly two of one document, so lists that it collected first would be a row each, of several times the bytes.
    """
    counted = tokens.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1 OR extra > 0")
    shared = F.when(F.col("extra") == 0, F.struct(F.col("df"), F.col("h")))
    # rows that repeat an id and text only lengthen its prefix, which is safe
    dealt = counted.repartition("k").join(firsts.select("k"), "k", "left_semi")
    own = dealt.groupBy("k", _tier("h").alias("tier")).agg(F.max("extra").alias("extra"), F.max("hots").alias("hots"), F.sort_array(F.collect_list(shared)).alias("shared"))
    # prefix length - (cold - shared) of the shared ones, then the hot ones
    want = (F.col("extra") - F.lit(1 << 40)) + F.size("shared")
    prefix = F.slice("shared", F.lit(1), F.greatest(want, F.lit(0)).cast("int"))
    listed = F.concat(F.transform(prefix, lambda x: x["h"]), F.coalesce("hots", F.array().cast("array<long>")))
    return own.select(F.explode(F.array_distinct(listed)).alias("h"), "k")


def close(a: str, b: str, num: int) -> Column:
    """Whether sizes, parities and sketches of the aliases a and b allow a link: num * union <= 100 * intersection bounds in
    how many shingles two sets of given sizes may differ, and parities differ in no more bits; prefixes under orders 2 and 3 share one."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    apart = sum((F.bit_count(x(f"w{i}").bitwiseXOR(y(f"w{i}"))) for i in range(BITS // 64)), F.lit(0))
    bound = x("share") * (100 - num) * (x("n") + y("n")) / (100 + num)
    most = F.when(x("share") < 1, bound + MARGIN * F.sqrt(bound) + SPARE).otherwise(bound + 1e-6)
    out = (100 * F.least(x("n"), y("n")) >= num * F.greatest(x("n"), y("n"))) & (apart <= most)
    for order in (2, 3):
        meet = [x(f"o{order}{i}").bitwiseAND(y(f"o{order}{i}")) for i in range(SKETCH // 64)]
        out &= sum((F.bit_count(m) for m in meet), F.lit(0)) > 0
    return out


def sets(docs: DataFrame, ids: DataFrame, k: int, num: int, several: np.ndarray) -> DataFrame:
    """(k, n, p2, p3, members): the set of each document whose id's place `b` is in `ids`, and its prefixes under orders 2 and 3."""
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(ids), several))

    def run(batches):
        wanted, bits = shared.value
        out, size = [], 0

        def flush():
            key, n, p2, p3, members = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(p2, pa.list_(pa.int32())), pa.array(p3, pa.list_(pa.int32())), pa.array(members, pa.list_(pa.int64()))], ["k", "n", "p2", "p3", "members"])

        for r, batch, values in _rows(_picked(batches, wanted), k):
            d, n = batch.column(0)[r].as_py(), len(values)
            if d is None or not n:
                continue
            key = _hash(d, _digest(values)) if _has(bits, batch.column(2)[r].as_py()) else d
            prefixes = ((_first(values, seed, missing(n, num) + 1) >> U(32)).astype(np.uint32).view(np.int32) for seed in SEEDS)
            out.append((key, n, *prefixes, values.view(np.int64)))
            size += n
            if size >= 1 << 17:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return docs.mapInArrow(lean(run), "k long, n long, p2 array<int>, p3 array<int>, members array<long>")


def verified(pairs: DataFrame, kept: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) that link: first the whole prefixes under orders 2 and 3 are intersected, then the sets."""
    light = lambda x: kept.select(F.col("k").alias(x), F.col("p2").alias(f"p2_{x}"), F.col("p3").alias(f"p3_{x}"))
    heavy = lambda x: kept.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(f"set_{x}"))
    hot = hot_keys(pairs, "a")  # the leader of a large group of near copies
    left = join_salted(pairs.join(light("b"), "b"), light("a"), "a", hot).filter(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b").distinct()
    both = F.size(F.array_intersect("set_a", "set_b"))
    return join_salted(left.join(heavy("b"), "b"), heavy("a"), "a", hot).filter(100 * both >= num * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def verified_by_block(pairs: DataFrame, kept: DataFrame, num: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (block, a, b) that link, and the table of blocks that they are read from."""
    ends = F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))
    blocks = cut(pairs.groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("pairs"), ends.alias("ends")), "near-blocks")
    held = blocks.select("block", F.explode("ends").alias("k")).join(kept.select("k", "members"), "k")
    sets_of = held.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("k", "members"))).alias("sets"))
    links = F.filter("pairs", lambda p: _linked(F.element_at("sets", p["a"]), F.element_at("sets", p["b"]), num))
    return blocks.select("block", "pairs").join(sets_of, "block").select(F.explode(links).alias("p")).select("p.*"), blocks


def _linked(a: Column, b: Column, num: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= num * (F.size(a) + F.size(b) - both)


def components(links: DataFrame) -> DataFrame:
    """(k, root): the smallest node that each node of a link reaches, by alternating large-star and small-star steps."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        by_root = edges.groupBy(F.col("v").alias("u")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
        count, total, most = by_root.agg(F.sum("n"), F.sum("sum"), F.max("n")).first()
        if (count, total) == state or not count:
            return edges.withColumnsRenamed({"u": "k", "v": "root"})
        state, before = (count, total), edges
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hubs = by_root.filter((F.col("n") * HOT > count) & (F.col("n") > HUB)).select("u", F.lit(True).alias("__hot")) if most * HOT > count and most > HUB else None
        large = join_salted(both, least, "u", hubs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = cut(small.coalesce(1 + count // FILE), "edges")  # few files; a step makes no more edges than there were
        discard(before)


def _links(rows: DataFrame, k: int, num: int) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(documents: d, t, n, digest, k; (digest, root, copies) of each set; whether an id has several sets;
    whether an id and set occur in several rows)."""
    profile = cut(profiles(rows, k, num), "near-profiles")
    documents = profile.filter("kind = 0").select("d", "t", "n", "digest", "h")
    sets_of = documents.filter("d IS NOT NULL").groupBy("d").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
    several = sets_of.filter("x <> y").select(_bit("d").alias("b")).distinct()
    any_several = several.limit(1).count() > 0
    several = cut(several, "near-several") if any_several else several
    bits = _bitmap(several) if any_several else np.zeros(0, np.uint64)

    def keyed(df: DataFrame) -> DataFrame:
        if not any_several:
            return df.withColumn("k", F.col("d"))
        marked = df.withColumn("b", _bit("d")).join(several.withColumn("marked", F.lit(True)), "b", "left")
        return marked.withColumn("k", F.when(F.col("marked"), F.col("h")).otherwise(F.col("d"))).drop("b", "marked")

    documents = keyed(documents).drop("h")
    # equal sets are one node: of several, only the first is counted and compared with others
    first_of = F.min(F.struct("k", F.col("d").alias("of"))).alias("first")
    firsts = documents.filter("d IS NOT NULL AND n > 0").groupBy("digest").agg(first_of, F.min("d").alias("d"), F.count("*").alias("copies"))
    firsts = cut(firsts.select("digest", "first.k", "first.of", "d", "copies"), "near-firsts")

    hot = profile.filter("kind = 1").groupBy("h").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "h").limit(HOT_MAX).select("h").toArrow()["h"].to_numpy()
    placed = rows.withColumn("__t", _bit("__d"))
    tokens = shingle_rows(placed, firsts.select(_bit("of").alias("b")), k, num, np.sort(hot), bits)
    posted = cut(postings(tokens, firsts), "near-postings")

    # of lists of equal members one is joined; members are compared by two 64-bit hashes of all of them and their number
    members = posted.groupBy("h").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")).filter("size > 1")
    once = members.groupBy(_tier("h").alias("tier"), "size", "x", "y").agg(F.min("h").alias("h")).select("h")
    told = keyed(profile.filter("kind = 2").select("d", "h", "n", "tier", "facts")).drop("d", "h").dropDuplicates(["k", "tier"])
    shares = F.element_at(F.array(*(F.lit(float(sampled(i, num))) for i in range(THIN + 1))), F.col("tier") + 1)
    band = F.floor(F.log("n") / float(-np.log(num / 100))).cast("int")
    listed = posted.join(once, "h").withColumn("tier", _tier("h").cast("int")).join(told, ["k", "tier"])
    lists = cut(listed.select("h", "k", "n", band.alias("band"), shares.alias("share"), *(F.col("facts")[i].alias(x) for i, x in enumerate(FACTS))), "near-lists")
    wanted = lists.select("k").distinct().join(documents.filter("d IS NOT NULL").select("k", "d").distinct(), "k").select(_bit("d").alias("b")).distinct()
    repeated = documents.filter("d IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    found = sets(placed, wanted, k, num, bits)
    kept = cut(found.dropDuplicates(["k"]) if repeated else found, "near-sets")

    facts = ["n", "share", *FACTS]
    lot = F.pmod(F.xxhash64("h", "k"), F.lit(LEADERS))
    leads = lists.groupBy("h", "band", lot).agg(F.min(F.struct("k", *facts)).alias("lead")).select("h", "band", "lead.*")
    x, y = lists.alias("x"), leads.alias("y")
    near_lead = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.k") != F.col("y.k")) & close("x", "y", num))
    star = cut(near_lead.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct(), "near-star")
    first = components(verified(star, kept, num))

    labelled = cut(lists.join(first, "k", "left").withColumn("c", F.coalesce("root", "k")).select("h", "k", "c", *facts), "near-labelled")
    groups = labelled.groupBy("h", "c").agg(F.count("*").alias("size"), F.sum("n").alias("whole"))
    # of each list that several components meet in, its largest component: pairs are sought for the other members only
    mixed = groups.groupBy("h").agg(F.max(F.struct("size", "c")).alias("top"), F.min("c").alias("p"), F.max("c").alias("q"), F.sum("size").alias("size"), F.sum("whole").alias("whole")).filter("p <> q")
    parts, sides = 1 + F.floor(F.col("size") / SALT).cast("int"), 1 + F.floor(F.col("whole") / SIDE)
    # a pair of two components shares open lists only, and each would emit it: the first of the longer ones does, or all shorter ones
    longer = labelled.select("h", "k").join(mixed.filter(F.col("size") >= LONGER).select("h"), "h")
    heads = longer.groupBy("k").agg(F.slice(F.array_sort(F.collect_set("h")), 1, HEADS).alias("heads"))
    open_lists = labelled.join(mixed.select("h", F.col("top.c").alias("top"), parts.alias("parts"), sides.alias("sides")), "h").join(heads, "k", "left")
    earlier = F.filter(F.coalesce("heads", F.array().cast("array<long>")), lambda x: x < F.col("h"))
    open_lists = open_lists.withColumn("earlier", earlier).drop("heads")
    x = open_lists.filter("c <> top").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).alias("x")
    y = open_lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    one_way = (F.col("y.c") == F.col("x.top")) | (F.col("x.k") < F.col("y.k"))
    once_only = ~F.arrays_overlap("x.earlier", "y.earlier")
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.c") != F.col("y.c")) & one_way & close("x", "y", num) & once_only)
    pairs = pairs.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"), F.col("x.h").alias("h"), F.col("x.sides").alias("sides"))
    side = lambda k: F.pmod(F.xxhash64(k), F.col("sides"))
    pairs = pairs.groupBy("a", "b").agg(F.min(F.xxhash64("h", side("a"), side("b"))).alias("block"))
    pairs = cut(pairs.join(star, ["a", "b"], "left_anti"), "near-pairs")
    last = first
    if pairs.limit(1).count():
        more, blocks = verified_by_block(pairs, kept, num)
        last = components(first.select(F.col("k").alias("a"), F.col("root").alias("b")).unionAll(more))
        discard(blocks)
    roots = cut(firsts.join(last, "k", "left").select("digest", "d", F.coalesce("root", "k").alias("root"), "copies"), "near-roots")
    discard(firsts, posted, lists, kept, star, labelled, pairs, at_once=True)
    return documents, roots, any_several, repeated


def near_components(docs: DataFrame, k: int = WORDS, num: int = NUM) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id long, text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("__d"), F.col("text").alias("__text"), F.lit(0).cast("long").alias("__t"))
    documents, roots, several, _ = _links(rows, k, num)
    if several:  # the ids of one document pool their links; then a component's root need not be an id
        linked = documents.filter("d IS NOT NULL AND n > 0").select("d", "digest").distinct().join(roots.select("digest", "root"), "digest").select("d", "root").distinct()
        pooled = linked.join(linked.groupBy("d").agg(F.min("root").alias("least")), "d").filter("root <> least").select(F.col("least").alias("a"), F.col("root").alias("b"))
        merged = components(pooled)
        roots = roots.join(merged.select(F.col("k").alias("root"), F.col("root").alias("__root")), "root", "left").withColumn("root", F.coalesce("__root", "root")).drop("__root")
        # an id may have further ids' texts: the least id of a root, over all of its sets
        roots = roots.join(roots.groupBy("root").agg(F.min("d").alias("component")), "root")
    else:
        roots = roots.withColumn("component", F.col("root"))
    found = join_by_key(documents.drop("t", "k"), cut(roots.select("digest", "component", "copies"), "near-components"), "digest", "copies")
    component = F.when(F.col("n") > 0, F.col("component"))
    if several:  # texts without words, too, have their id's component
        own = found.filter("d IS NOT NULL").groupBy("d").agg(F.min("component").alias("own"))
        found = found.join(own, "d", "left")
        component = F.col("own")
    return found.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.coalesce(component, F.col("d"))).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = WORDS, num: int = NUM) -> DataFrame:
    """One row of each component, with all columns; see above for which, and for rows of null ids."""
    ship(docs.sparkSession)
    keys = [F.col("doc_id").cast("long").alias("__d"), F.xxhash64("text").alias("__t")]
    documents, roots, _, repeated = _links(docs.select(keys[0], F.col("text").alias("__text"), keys[1]), k, num)
    with_roots = join_by_key(documents.filter("d IS NOT NULL").drop("k"), roots.select("digest", "root", "copies"), "digest", "copies")
    rooted = cut(with_roots.select("d", "t", F.when(F.col("n") > 0, F.col("root")).alias("root")), "near-rooted")
    stays = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("d", "t")).alias("s")).select("s.*")
    linked = rooted.filter("root IS NOT NULL").select("d", "t").distinct()
    gone = linked.join(stays, ["d", "t"], "left_anti").select(F.col("d").alias("__gone"), F.col("t").alias("__of"))
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *keys).join(gone, (F.col("__d") == F.col("__gone")) & (F.col("__t") == F.col("__of")), "left_anti")
    if not repeated:
        return kept.select("__row.*")
    twice = rooted.groupBy("d", "t").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("d").alias("__twice"), F.col("t").alias("__of"))
    same = (F.col("__d") == F.col("__twice")) & (F.col("__t") == F.col("__of"))
    first = F.row_number().over(Window.partitionBy("__d", "__t").orderBy(F.xxhash64("__row")))
    once = kept.join(twice, same, "left_semi").withColumn("__nth", first).filter("__nth = 1").select("__row.*")
    return kept.join(twice, same, "left_anti").select("__row.*").unionAll(once)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), 4, 85)
