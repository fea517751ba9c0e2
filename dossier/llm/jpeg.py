"""Baseline JPEG media columns (op7): parse markers, Huffman-decode scans, rebuild DC-only luminance thumbnails in numpy.

A DC-only thumbnail has one sample for each 8x8 block: the block's mean, which is its DC coefficient times the quantiser
over 8, plus 128. Scans are decoded in lockstep: all restart intervals of a batch of images that share a layout advance
together, one symbol at a time, so numpy works on thousands of lanes. An image without restart markers is one lane.

`store` writes bytes as such an image: each byte is the constant sample of one block (quantiser 8, so the coefficient is
the byte less 128), 64 blocks a row, one restart interval a row. The thumbnail that is read back is the payload again.
A payload of more rows than a frame may have is stored as several images end to end; a text beyond one frame is written and
read back a frame at a time, so the arrays stay at some tens of bytes for each byte of one frame (half a megabyte).

Defined results: a null or empty text is 64 zero bytes. A media value that is null, truncated, not JPEG, or not baseline
gives null dimensions and an error text, never an exception. Repeated rows give repeated rows; nothing is grouped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import lean, ship, table

ACROSS = 64
#: A frame's height is a 16-bit number of lines, 8 to a row of blocks.
ROWS = 65_535 // 8
#: Payload bytes of a whole frame, and of small texts that are encoded and decoded together.
FRAME, TOGETHER = ROWS * ACROSS, 1 << 19

#: Code length of each DC category 0..8 in the images that `store` writes, and of the only AC symbol, end of block.
DC_LENGTHS = {5: 2, 6: 2, 4: 3, 7: 3, 3: 4, 0: 4, 2: 5, 1: 6, 8: 6}
AC_LENGTHS = {0: 1}


def _spec(lengths: dict[int, int]) -> bytes:
    """A DHT table body: the number of codes of each length, then the symbols."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], list(lengths).index(s)))
    return bytes(sum(x == n for x in lengths.values()) for n in range(1, 17)) + bytes(symbols)


def _codes(spec: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical table body."""
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for symbol in spec[at : at + spec[n - 1]]:
            out[symbol] = (code, n)
            code += 1
        at += spec[n - 1]
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


DC_SPEC, AC_SPEC = _spec(DC_LENGTHS), _spec(AC_LENGTHS)
_DC_CODE = np.zeros(16, np.int64)
_DC_LEN = np.zeros(16, np.int64)
for _s, (_c, _n) in _codes(DC_SPEC).items():
    _DC_CODE[_s], _DC_LEN[_s] = _c, _n
#: For each difference -255..255, the bits that stand for it (code, magnitude, end of block) and how many they are.
_DIFF = np.arange(-255, 256)
_CATEGORY = np.array([int(abs(d)).bit_length() for d in range(-255, 256)], np.int64)
_BITS = (((_DC_CODE[_CATEGORY] << _CATEGORY) | np.where(_DIFF < 0, _DIFF + (1 << _CATEGORY) - 1, _DIFF)) << 1).astype(np.int32)
_N_BITS = (_DC_LEN[_CATEGORY] + _CATEGORY + 1).astype(np.int32)


def _head(rows: int) -> bytes:
    quant = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    frame = _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (ACROSS * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    huffman = _segment(0xC4, bytes([0x00]) + DC_SPEC + bytes([0x10]) + AC_SPEC)
    return b"\xff\xd8" + quant + frame + huffman + _segment(0xDD, ACROSS.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG byte string for each payload (uint8, length a positive multiple of 64)."""
    frames: list[list[int]] = []  # rows of each image of each payload
    for x in payloads:
        rows = len(x) // ACROSS
        frames.append([min(ROWS, rows - r) for r in range(0, rows, ROWS)])
    grid = np.concatenate(payloads).reshape(-1, ACROSS)
    diff = grid.astype(np.int16)
    diff[:, 1:] -= grid[:, :-1]
    diff[:, 0] -= 128
    diff += 255
    length = _N_BITS[diff]
    ends = np.cumsum(length, axis=1, dtype=np.int32)
    row_bytes = (ends[:, -1].astype(np.int64) + 7) >> 3
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    begin = ends - length  # bits before each sample, within its row
    shifted = (_BITS[diff] << (24 - (begin & 7) - length)).ravel()
    where = ((begin >> 3) + row_at[:-1, None]).ravel()
    n = int(row_at[-1])
    packed = sum(np.bincount(where + k, (shifted >> s) & 255, n + 2)[:n] for k, s in ((0, 16), (1, 8), (2, 0))).astype(np.uint8)
    packed[row_at[1:] - 1] |= ((1 << ((-ends[:, -1]) & 7)) - 1).astype(np.uint8)  # ones fill the last byte

    heights = [h for f in frames for h in f]
    first = np.zeros(len(grid), bool)
    image_at = np.concatenate([[0], np.cumsum(heights)])
    first[image_at[:-1]] = True
    within = np.arange(len(grid)) - np.repeat(image_at[:-1], heights)
    marks = np.cumsum(~first)  # restart markers up to and before each row
    full = packed == 255
    stuffed = np.concatenate([[0], np.cumsum(full)])
    row = np.repeat(np.arange(len(grid)), row_bytes)
    place = np.arange(n) + stuffed[:-1] + 2 * marks[row]
    out = np.zeros(n + int(stuffed[-1]) + 2 * int(marks[-1]), np.uint8)
    out[place] = packed
    starts = place[row_at[:-1]]
    out[starts[~first] - 2] = 0xFF
    out[starts[~first] - 1] = 0xD0 + (within[~first] - 1) % 8
    cuts = np.concatenate([starts[image_at[:-1]], [len(out)]]).tolist()
    made, image = [], 0
    for f in frames:
        parts = []
        for h in f:
            parts += [_head(h), out[cuts[image] : cuts[image + 1]].tobytes(), b"\xff\xd9"]
            image += 1
        made.append(b"".join(parts))
    return made


@dataclass
class Image:
    """One parsed image: what its markers say, and its entropy-coded intervals with the stuffing removed."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    quant: dict[int, int] = field(default_factory=dict)  # DC quantiser of each table
    huffman: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id -> table body
    restart: int = 0
    data: np.ndarray | None = None
    starts: np.ndarray | None = None
    thumb: np.ndarray | None = None
    end: int = 0

    def layout(self) -> tuple:
        return tuple(self.components), tuple(self.scan), tuple(sorted(self.huffman.items()))

    def units(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.scan) == 1 and len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(media: bytes, at: int = 0) -> Image:
    """Walk the markers of the image that starts at byte `at`; ValueError for anything that isn't whole baseline JPEG."""
    out = Image()
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        while at < len(media) and media[at] == 0xFF and media[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut short")
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out.quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC0:
            if body[0] != 8 or len(body) != 6 + 3 * body[5]:
                raise ValueError("not 8-bit samples")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3)]
            if not out.height or not out.width or any(not 1 <= x <= 4 for c in out.components for x in c[1:3]):
                raise ValueError("the frame has no size")
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = 17 + sum(body[k + 1 : k + 17])
                out.huffman[body[k]] = body[k + 1 : k + n]
                k += n
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            places = {c[0]: i for i, c in enumerate(out.components)}
            out.scan = [(places[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])] if body and all(body[1 + 2 * k] in places for k in range(body[0])) else []
            if len(out.scan) != len(out.components) or not out.scan:
                raise ValueError("the scan doesn't hold all components")
            if any(d not in out.huffman or 16 + a not in out.huffman for _, d, a in out.scan) or any(c[3] not in out.quant for c in out.components):
                raise ValueError("a table is missing")
            break
    raw = np.frombuffer(media, np.uint8, offset=at)
    mark = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    after = raw[mark + 1] if len(mark) else np.zeros(0, np.uint8)
    stop = mark[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(stop):
        raise ValueError("the scan is cut short")
    stop = int(stop[0])
    out.end = at + stop + 2
    mark, after = mark[mark < stop], after[mark < stop]
    keep = np.ones(stop, bool)
    keep[mark + 1] = False
    restarts = mark[after != 0]
    keep[restarts] = False
    out.data = raw[:stop][keep]
    lost = np.cumsum(~keep)
    out.starts = np.concatenate([[0], restarts + 2 - lost[restarts + 1]]).astype(np.int64)
    across, down = out.units()
    if len(out.starts) != (-(-across * down // out.restart) if out.restart else 1):
        raise ValueError("restart markers are missing")
    return out


def _lookup(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead, the symbol and the length of the code they start with (0: none)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in _codes(spec).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
_whole: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}


def _whole_blocks(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead that hold a whole block without AC coefficients, its bits and its difference (else 0 bits)."""
    if (dc, ac) not in _whole:
        if len(_whole) > 64:
            _whole.clear()
        symbol, length = _table(dc)
        bits = np.arange(1 << 16, dtype=np.int64)
        used = length + symbol
        fits = (length > 0) & (symbol <= 11) & (used < 16)
        category = np.where(fits, symbol, 0)
        raw = ((bits << np.where(fits, length, 0)) & 0xFFFF) >> (16 - category)
        diff = np.where((category > 0) & (raw < (1 << np.maximum(category - 1, 0))), raw - (1 << category) + 1, raw)
        rest = (bits << np.where(fits, used, 0)) & 0xFFFF
        next_symbol, next_length = _table(ac)
        fits &= (next_length[rest] > 0) & (next_symbol[rest] == 0) & (used + next_length[rest] <= 16)
        _whole[dc, ac] = np.where(fits, used + next_length[rest], 0), np.where(fits, diff, 0)
    return _whole[dc, ac]


def _table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    if spec not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[spec] = _lookup(spec)
    return _tables[spec]


def decode(images: list[Image]) -> list[str | None]:
    """Fill in the DC-only luminance thumbnail of each image; an error text for those whose scan is broken."""
    errors: list[str | None] = [None] * len(images)
    groups = defaultdict(list)
    for i, x in enumerate(images):
        groups[x.layout()].append(i)
    for members in groups.values():
        _decode_alike([images[i] for i in members], members, errors)
    return errors


def _decode_alike(images: list[Image], members: list[int], errors: list[str | None]) -> None:
    one = images[0]
    single = len(one.components) == 1
    blocks = [(k, bx, by, d, a) for k, d, a in one.scan for by in range(1 if single else one.components[k][2]) for bx in range(1 if single else one.components[k][1])]
    base = np.cumsum([0, *(len(x.data) + 8 for x in images)])
    data = np.zeros(int(base[-1]) + 8, np.uint8)
    for x, b in zip(images, base, strict=False):
        data[b : b + len(x.data)] = x.data
    ahead = np.zeros(len(data) - 3, np.int64)  # the 32 bits from each byte on
    for k in range(4):
        ahead |= data[k : len(data) - 3 + k].astype(np.int64) << (24 - 8 * k)
    lanes = [len(x.starts) for x in images]
    owner = np.repeat(np.arange(len(images)), lanes)
    pos = (np.concatenate([x.starts + b for x, b in zip(images, base, strict=False)]) * 8).astype(np.int64)
    limit = np.repeat((base[1:] - 1) * 8, lanes)
    total = np.array([np.prod(x.units()) for x in images], np.int64)
    each = np.array([x.restart for x in images], np.int64)
    each = np.where(each == 0, total, each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum([0, *lanes[:-1]]), lanes)
    n_units = np.minimum(each[owner], total[owner] - nth * each[owner])
    order = np.argsort(-n_units, kind="stable")
    pos, limit, n_units = pos[order], limit[order], n_units[order]
    luma = [(j, bx, by) for j, (k, bx, by, _, _) in enumerate(blocks) if k == 0]
    steps = int(n_units[0]) if len(n_units) else 0
    got = np.zeros((len(luma), steps, len(pos)), np.int16)
    broken = np.zeros(len(pos), bool)
    pred = np.zeros((len(one.components), len(pos)), np.int64)

    def peek(p: np.ndarray, bits: int = 16) -> np.ndarray:
        return ((ahead[p >> 3] << (p & 7)) >> (32 - bits)) & ((1 << bits) - 1)

    def block(p: np.ndarray, top: np.ndarray, d: bytes, a: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One block of each lane symbol by symbol: the new places, DC differences, and which lanes are broken."""
        symbol, length = _table(d)
        bits = peek(p)
        category, n = symbol[bits], length[bits]
        bad = (n == 0) | (category > 11)
        category = np.where(bad, 0, category)
        p = np.minimum(p + n, top)
        raw = peek(p) >> (16 - category)
        value = np.where((category > 0) & (raw < (1 << np.maximum(category - 1, 0))), raw - (1 << category) + 1, raw)
        p = np.minimum(p + category, top)
        symbol, length = _table(a)
        at, going = np.ones(len(p), np.int64), np.arange(len(p))
        while len(going):  # AC coefficients are skipped one by one
            bits = peek(p[going])
            rs, n = symbol[bits], length[bits]
            bad[going] |= n == 0
            p[going] = np.minimum(p[going] + n + (rs & 15), top[going])
            at[going] += np.where(rs == 0xF0, 16, (rs >> 4) + 1)
            going = going[(rs != 0) & (n > 0) & (at[going] <= 63)]
        return p, value, bad

    for step in range(steps):
        active = len(pos) if n_units[-1] > step else int(np.searchsorted(-n_units, -step, "left"))
        p, top = pos[:active], limit[:active]
        taken = 0
        for k, _, _, d, a in blocks:
            n_bits, diffs = _whole_blocks(one.huffman[d], one.huffman[16 + a])
            bits = peek(p)
            n, value = n_bits[bits], diffs[bits]
            if len(slow := np.flatnonzero(n == 0)):
                p2, value[slow], bad = block(p[slow], top[slow], one.huffman[d], one.huffman[16 + a])
                p = p + n
                p[slow] = p2
                broken[slow] |= bad
            else:
                p = p + n
            np.minimum(p, top, out=p)
            pred[k, :active] += value
            if k == 0:
                got[taken, step, :active] = pred[0, :active]
                taken += 1
        broken[:active] |= p >= top
        pos[:active] = p
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    quant = [x.quant[x.components[0][3]] for x in images]
    at = 0
    h0, v0 = (1, 1) if single else one.components[0][1:3]
    for i, x in enumerate(images):
        own = back[at : at + lanes[i]]
        at += lanes[i]
        if broken[own].any():
            errors[members[i]] = "the scan is broken"
            continue
        across, down = x.units()
        dc = got[:, : int(each[i]), own]
        sample = np.clip(np.rint(dc * (quant[i] / 8.0)) + 128, 0, 255).astype(np.uint8)
        flat = sample.transpose(0, 2, 1).reshape(len(luma), -1)[:, : across * down]
        thumb = np.zeros((down * v0, across * h0), np.uint8)
        for j, (_, bx, by) in enumerate(luma):
            thumb[by::v0, bx::h0] = flat[j].reshape(down, across)
        h, v = (1, 1) if single else (max(c[1] for c in x.components), max(c[2] for c in x.components))
        x.thumb = thumb[: -(-x.height * v0 // (8 * v)), : -(-x.width * h0 // (8 * h))]


def mean_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid over the thumbnail are brighter than its mean."""
    rows = np.minimum(np.arange(8) * thumb.shape[0] // 8, thumb.shape[0] - 1)
    columns = np.minimum(np.arange(8) * thumb.shape[1] // 8, thumb.shape[1] - 1)
    high, wide = np.diff([*rows, thumb.shape[0]]), np.diff([*columns, thumb.shape[1]])
    sums = np.add.reduceat(np.add.reduceat(thumb, columns, axis=1, dtype=np.int64), rows, axis=0)
    area = np.maximum(high, 1)[:, None] * np.maximum(wide, 1)[None, :]
    return np.packbits(sums * thumb.size > area * int(thumb.sum(dtype=np.int64))).tobytes().hex()


def thumbnails(media: list[bytes | None]) -> list[tuple[list[Image], str | None]]:
    """The images of each media value with their thumbnails, or an error text."""
    found: list[tuple[list[Image], str | None]] = []
    every, owners = [], []
    for i, x in enumerate(media):
        images, error, at = [], None, 0
        try:
            if not x:
                raise ValueError("no media")
            while at < len(x):
                images.append(parse(x, at))
                at = images[-1].end
        except (ValueError, IndexError) as e:
            error = str(e) if isinstance(e, ValueError) else "a segment is cut short"
        found.append(([] if error else images, error))
        if not error:
            every += images
            owners += [i] * len(images)
    for i, error in zip(owners, decode(every), strict=True):
        if error:
            found[i] = ([], error)
    return found


def _feature(images: list[Image]) -> str:
    return "+".join(f"{x.width}x{x.height}:{mean_hash(x.thumb)}" for x in images)


def jpeg_columns(df: DataFrame, media: str, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns, width, height, thumb_sha256, thumb_hash and error of a column of JPEG bytes."""
    ship(df.sparkSession)
    kept = df.select(*keep, F.col(media).alias("__media"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema), "width int", "height int", "thumb_sha256 string", "thumb_hash string", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = []
                for images, error in thumbnails([x.as_py() for x in batch.column(len(keep))]):
                    x = images[0] if images else None
                    rows.append((x and x.width, x and x.height, x and hashlib.sha256(x.thumb.tobytes()).hexdigest(), x and mean_hash(x.thumb), error))
                columns = zip(*rows, strict=True)
                types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keep, "width", "height", "thumb_sha256", "thumb_hash", "error"])

    return kept.mapInArrow(lean(run), schema)


def store_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = False) -> DataFrame:
    """`keep` columns and, of each text stored as JPEG and read back, sizes, digests and the thumbnail feature; with `with_media` the image too."""
    ship(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("__text"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if with_media else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: len(names)]
    sql = ["long", "long", "string", "long", "long", "string", "string", "binary"][: len(names)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema), *(f"{n} {t}" for n, t in zip(names, sql, strict=True))])

    def some(texts: list[bytes]) -> list[tuple]:
        payloads = [np.frombuffer(x + bytes((-len(x)) % 64 if x else 64), np.uint8) for x in texts]
        made = store(payloads)
        rows = []
        for x, media, (images, error) in zip(texts, made, thumbnails(made), strict=True):
            if error:
                raise ValueError(error)
            back = b"".join(y.thumb.tobytes() for y in images)
            rows.append((len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(images), media)[: len(names)])
        return rows

    def long(x: bytes) -> tuple:
        """The same row of a text beyond one frame."""
        back_sha, media_sha, tail, sizes, features, kept_media = hashlib.sha256(), hashlib.sha256(), b"", [0, 0], [], []
        for at in range(0, len(x), FRAME):
            part = x[at : at + FRAME]
            (media,) = store([np.frombuffer(part + bytes((-len(part)) % 64), np.uint8)])
            ((images, error),) = thumbnails([media])
            if error:
                raise ValueError(error)
            back = images[0].thumb.tobytes()
            back_sha.update(back)
            media_sha.update(media)
            tail, sizes = back[-64:], [sizes[0] + len(back), sizes[1] + len(media)]
            features.append(_feature(images))
            kept_media += [media] if with_media else []
        return (len(x), sizes[0], back_sha.hexdigest(), zlib.crc32(tail), sizes[1], media_sha.hexdigest(), "+".join(features), b"".join(kept_media))[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(len(keep))
            at = 0
            while at < whole.num_rows:
                end, size, some_texts = at, 0, []
                while end < whole.num_rows and size < TOGETHER and end - at < 4096:
                    x = (texts[end].as_py() or "").encode()
                    if len(x) > FRAME and end > at:
                        break
                    some_texts.append(x)
                    size += len(x) + 64
                    end += 1
                rows = [long(some_texts[0])] if len(some_texts[0]) > FRAME else some(some_texts)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*whole.slice(at, end - at).columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keep, *names])
                at = end

    return kept.mapInArrow(lean(run), schema)


def op7_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
