"""Media columns: texts kept losslessly as baseline JPEG, and a decoder for DC-only luminance thumbnails.

Writing. A payload byte becomes one flat 8x8 block: with a DC quantiser of 8 the quantised DC coefficient
is the byte less 128, and the block's samples are all equal to the byte. Blocks have no AC coefficients,
so a block is a DC difference followed by an end-of-block code of one bit. Images are ``ACROSS`` blocks
wide, each row is a restart interval, and a payload over ``PER_IMAGE`` bytes continues in further images,
one after the other in the stored bytes.

Reading. Markers are parsed, and scans Huffman-decoded. Restart intervals start on a byte with a fresh
prediction, so all intervals of many images are decoded side by side in numpy: one table lookup of 16 bits
gives a whole DC-only block, and blocks that are longer or hold AC coefficients take the general steps.
Scans with several components or without restart markers are decoded one symbol at a time. AC values
are skipped: the thumbnail holds one luminance sample for each 8x8 block.

Defined cases: a null text counts as empty; the payload is padded with spaces to a positive multiple of
192 bytes; equal texts give equal rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT, ACROSS = 192, 64
#: A JPEG is at most 65,535 samples high.
PER_IMAGE = ACROSS * 8190
BATCH_BYTES = 1 << 20

# Fixed values of the format: the usual luminance DC code lengths (codes of 1 to 16 bits), for categories 0 to 11.
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
# Only end-of-block occurs among the AC symbols; it gets the one code of a single bit that is not all ones.
AC_LENGTHS, AC_SYMBOLS = [1] + [0] * 15, [0]

Frame = namedtuple("Frame", "width height components quant dc ac interval scan selected")
Component = namedtuple("Component", "id across down table")


def huffman(lengths: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    found, code, k = [], 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            found.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return found


def lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit window: symbol << 5 | code length, or 0 where no code begins."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, code, length in huffman(list(lengths), list(symbols)):
        table[code << 16 - length: (code + 1) << 16 - length] = symbol << 5 | length
    return table


def extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number that ``size`` bits stand for."""
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


def whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For each 16-bit window that begins with a whole DC-only block: difference << 5 | bits used; else 0."""
    window = np.arange(1 << 16)
    size, used = dc >> 5, dc & 31
    fits = (dc > 0) & (used + size < 16)
    size, used = np.where(fits, size, 0), np.where(fits, used, 0)
    value = window >> (16 - used - size) & ((1 << size) - 1)
    rest = ac[window << (used + size) & 0xFFFF]
    total = used + size + (rest & 31)
    return np.where(fits & (rest > 0) & (rest >> 5 == 0) & (total <= 16), extend(value, size) << 5 | total, 0)


def _writer_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = {s: (c, n) for s, c, n in huffman(DC_LENGTHS, DC_SYMBOLS)}
    end, end_bits = huffman(AC_LENGTHS, AC_SYMBOLS)[0][1:]
    words, sizes = [], []
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, bits = codes[size]
        value = diff if diff > 0 else diff + (1 << size) - 1
        words.append(((code << size | value) << end_bits) | end)
        sizes.append(bits + size + end_bits)
    # Rows 511 to 518 are the 0 to 7 ones that fill a byte.
    words += [(1 << n) - 1 for n in range(8)]
    sizes += range(8)
    longest = max(sizes)
    rows = np.array([[w >> n - 1 - k & 1 if k < n else 0 for k in range(longest)] for w, n in zip(words, sizes)], np.uint8)
    return rows, np.array([[k < n for k in range(longest)] for n in sizes]), np.array(sizes, np.int64)


BITS, USED, SIZES = _writer_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    return (b"\xff\xd8" + _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63)
            + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
            + _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS]))
            + _segment(0xDD, struct.pack(">H", ACROSS)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])))


def write_images(parts: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each part; their lengths are positive multiples of ``ACROSS``."""
    lanes = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64).reshape(-1, ACROSS)
    symbols = np.empty((len(lanes), ACROSS + 1), np.int64)
    symbols[:, 0] = lanes[:, 0] - 128 + 255
    symbols[:, 1:ACROSS] = np.diff(lanes, axis=1) + 255
    bits = SIZES[symbols[:, :ACROSS]].sum(axis=1)
    symbols[:, ACROSS] = 511 + -bits % 8
    symbols = symbols.ravel()
    data = np.packbits(BITS[symbols][USED[symbols]])
    lane_bytes = -(-bits // 8)
    rows = np.array([len(p) // ACROSS for p in parts])
    last = np.zeros(len(lanes), bool)
    last[np.cumsum(rows) - 1] = True
    # Bytes of 255 are followed by a zero, lanes but an image's last by a restart marker.
    full = data == 255
    gaps = full.astype(np.int64)
    ends = np.cumsum(lane_bytes)
    gaps[ends - 1] += 2 * ~last
    place = np.arange(len(data)) + np.cumsum(gaps) - gaps
    out = np.zeros(len(data) + int(gaps.sum()), np.uint8)
    out[place] = data
    marks = place[ends - 1] + 1 + full[ends - 1]
    number = np.arange(len(lanes)) - np.repeat(np.cumsum(rows) - rows, rows)
    out[marks[~last]] = 255
    out[marks[~last] + 1] = 0xD0 + number[~last] % 8
    stops = marks[last]
    raw, start, images = out.tobytes(), 0, []
    for n, stop in zip(rows, stops):
        images.append(header(int(n)) + raw[start:stop] + b"\xff\xd9")
        start = stop
    return images


SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def frames(data: bytes) -> list[Frame]:
    """The images of stored bytes: one baseline JPEG after the other."""
    found, at = [], 0
    quant: dict = {}
    dc: dict = {}
    ac: dict = {}
    interval, size, components = 0, (0, 0), []
    while at < len(data):
        if data[at] != 255:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD8:
            quant, dc, ac, interval, components = {}, {}, {}, 0, []
            continue
        if marker == 0xD9 or marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        length = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2: at + length], at + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + n:]
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                n = sum(lengths)
                (ac if body[0] >> 4 else dc)[body[0] & 15] = (lengths, tuple(body[17: 17 + n]))
                body = body[17 + n:]
        elif marker in (0xC0, 0xC1):
            size = struct.unpack_from(">HH", body, 1)
            components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            end = SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            chosen = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2))
            found.append(Frame(size[1], size[0], tuple(components), dict(quant), dict(dc), dict(ac), interval, data[at:stop], chosen))
            at = stop
    return found


def luminance(images: list[Frame]) -> list[np.ndarray]:
    """The DC-only luminance of each image: one byte for each 8x8 block."""
    out: list = [None] * len(images)
    groups: dict = {}
    for k, f in enumerate(images):
        if len(f.components) == len(f.selected) == 1 and f.interval:
            groups.setdefault((f.dc[f.selected[0][1]], f.ac[f.selected[0][2]], f.interval), []).append(k)
        else:
            out[k] = _samples(_one_by_one(f), f)
    for (dc, ac, interval), members in groups.items():
        for k, values in zip(members, _side_by_side([images[k] for k in members], dc, ac, interval)):
            out[k] = _samples(values, images[k])
    return out


def _samples(coefficients: np.ndarray, f: Frame) -> np.ndarray:
    return np.clip(np.rint(coefficients * f.quant[f.components[0].table] / 8) + 128, 0, 255).astype(np.uint8)


_tables: dict = {}


def _side_by_side(images: list[Frame], dc_code: tuple, ac_code: tuple, interval: int) -> list[np.ndarray]:
    key = (dc_code, ac_code)
    if key not in _tables:
        _tables.clear()
        dc, ac = lookup(*dc_code), lookup(*ac_code)
        _tables[key] = dc, ac, whole_blocks(dc, ac)
    dc, ac, whole = _tables[key]
    shapes = [(-(-f.height // 8), -(-f.width // 8)) for f in images]
    totals = np.array([h * w for h, w in shapes])
    lanes = -(-totals // interval)
    data = np.frombuffer(b"".join(f.scan for f in images), np.uint8)
    after = np.zeros(len(data), np.uint8)
    after[:-1] = data[1:]
    full = data == 255
    marks = full & (after >= 0xD0) & (after <= 0xD7)
    drop = marks.copy()
    drop[1:] |= full[:-1] & ((data[1:] == 0) | marks[:-1])
    kept = np.cumsum(~drop)
    begins = np.cumsum([0] + [len(f.scan) for f in images])[:-1]
    starts = np.sort(np.concatenate((begins, np.flatnonzero(marks) + 2)))
    if len(starts) != lanes.sum():
        raise ValueError("restart markers are missing")
    clean = np.concatenate((data[~drop], np.full(8, 255, np.uint8))).astype(np.int64)
    window = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]
    last = len(window) - 1
    bit = np.where(starts > 0, kept[np.maximum(starts, 1) - 1], 0) * 8
    blocks = np.full(len(starts), interval)
    blocks[np.cumsum(lanes) - 1] = totals - (lanes - 1) * interval
    order = np.argsort(-blocks, kind="stable")
    bit, blocks = bit[order], blocks[order]
    active = len(blocks) - np.searchsorted(blocks[::-1], np.arange(interval), side="right")
    before = np.zeros(len(blocks), np.int64)
    values = np.zeros((interval, len(blocks)), np.int64)

    def peek(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return window[np.minimum(at >> 3, last)] >> (40 - n - (at & 7)) & ((1 << n) - 1)

    for step in range(int(blocks[0]) if len(blocks) else 0):
        n = active[step]
        at = bit[:n]
        found = whole[window[at >> 3] >> (24 - (at & 7)) & 0xFFFF]
        at += found & 31
        before[:n] += found >> 5
        slow = np.flatnonzero(found == 0)
        if len(slow):
            code = dc[peek(at[slow], 16)]
            if (code == 0).any():
                raise ValueError("a DC code is wrong")
            size, start = code >> 5, at[slow] + (code & 31)
            before[slow] += extend(peek(start, size), size)
            at[slow] = start + size
            done = np.zeros(len(slow), np.int64)
            while len(slow):
                code = ac[peek(at[slow], 16)]
                if (code == 0).any():
                    raise ValueError("an AC code is wrong")
                run, size = code >> 9, code >> 5 & 15
                at[slow] += (code & 31) + size
                done += np.where((size == 0) & (run < 15), 63, run + 1)
                slow, done = slow[done < 63], done[done < 63]
        values[step, :n] = before[:n]
    lane_values = np.empty((len(blocks), interval), np.int64)
    lane_values[order] = values.T
    out, lane = [], 0
    for shape, total, n in zip(shapes, totals, lanes):
        out.append(lane_values[lane: lane + n].ravel()[:total].reshape(shape))
        lane += n
    return out


class _Bits:
    def __init__(self, scan: bytes):
        self.data = scan.replace(b"\xff\x00", b"\xff")
        self.number = int.from_bytes(self.data + b"\xff\xff\xff\xff", "big")
        self.size, self.at = (len(self.data) + 4) * 8, 0

    def peek(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the scan ends early")
        byte, bit = divmod(self.at, 8)
        return int.from_bytes((self.data[byte: byte + 4] + b"\xff" * 4)[:4], "big") >> (32 - bit - n) & ((1 << n) - 1)


def _one_by_one(f: Frame) -> np.ndarray:
    """DC coefficients of the first component, symbol by symbol."""
    parts = [(c, lookup(*f.dc[d]), lookup(*f.ac[a])) for k, d, a in f.selected for c in f.components if c.id == k]
    most_across, most_down = max(c.across for c in f.components), max(c.down for c in f.components)
    first = parts[0][0]
    if len(parts) == 1:
        # A scan of one component has its blocks in plain rows.
        width = -(-(-(-f.width * first.across // most_across)) // 8)
        height = -(-(-(-f.height * first.down // most_down)) // 8)
        units, across = width * height, width
        parts = [(first._replace(across=1, down=1), *parts[0][1:])]
    else:
        across = -(-f.width // (8 * most_across))
        units = across * -(-f.height // (8 * most_down))
    lead = parts[0][0]
    out = np.zeros((units // across * lead.down, across * lead.across), np.int64)
    pieces = re.split(rb"\xff[\xd0-\xd7]", f.scan) if f.interval else [f.scan]
    unit = 0
    for piece in pieces:
        bits, before = _Bits(piece), [0] * len(parts)
        for unit in range(unit, min(units, unit + (f.interval or units))):
            for k, (c, dc, ac) in enumerate(parts):
                for down in range(c.down):
                    for right in range(c.across):
                        code = int(dc[bits.peek(16)])
                        if not code:
                            raise ValueError("a DC code is wrong")
                        bits.at += code & 31
                        size = code >> 5
                        if size:
                            value = bits.peek(size)
                            bits.at += size
                            before[k] += value if value >= 1 << size - 1 else value - (1 << size) + 1
                        done = 0
                        while done < 63:
                            code = int(ac[bits.peek(16)])
                            if not code:
                                raise ValueError("an AC code is wrong")
                            run, size = code >> 9, code >> 5 & 15
                            bits.at += (code & 31) + size
                            done += 63 if size == 0 and run < 15 else run + 1
                        if k == 0:
                            out[unit // across * c.down + down, unit % across * c.across + right] = before[0]
        unit += 1
    if len(parts) > 1:
        out = out[: -(-f.height * lead.down // (8 * most_down)), : -(-f.width * lead.across // (8 * most_across))]
    return out


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Difference hash and mean hash (16 hexadecimal digits each) of a thumbnail averaged to 8 rows of 9."""
    rows = np.arange(8) * thumb.shape[0] // 8
    columns = np.arange(9) * thumb.shape[1] // 9

    def over(values: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
        size = np.maximum(np.diff(np.append(at, values.shape[axis])), 1)
        return np.add.reduceat(values, at, axis=axis) / (size[:, None] if axis == 0 else size)

    small = over(over(thumb.astype(np.float64), rows, 0), columns, 1)
    bits = (small[:, 1:] > small[:, :-1], small[:, :8] > small[:, :8].mean())
    return tuple(np.packbits(b).tobytes().hex() for b in bits)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT), len(raw)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload's JPEG images, one after the other."""
    parts = [(k, p[a: a + PER_IMAGE]) for k, p in enumerate(payloads) for a in range(0, len(p), PER_IMAGE)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for group in _batches(parts, lambda x: len(x[1])):
        for (k, _), image in zip(group, write_images([p for _, p in group])):
            out[k].append(image)
    return [b"".join(x) for x in out]


def read(stored: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """Each one's images with their thumbnails."""
    every = [(k, f) for k, s in enumerate(stored) for f in frames(s)]
    out: list[list] = [[] for _ in stored]
    for group in _batches(every, lambda x: x[1].width * x[1].height // 64):
        for (k, f), thumb in zip(group, luminance([f for _, f in group])):
            out[k].append((f, thumb))
    return out


def _batches(items: list, weight) -> Iterator[list]:
    group, held = [], 0
    for x in items:
        group.append(x)
        held += weight(x)
        if held >= BATCH_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


def describe(text_list: list[str | None]) -> Iterator[tuple[tuple, bytes]]:
    """For each text the columns of ``SCHEMA``, computed from the bytes read back, and the stored bytes."""
    for group in _batches([payload_of(t) for t in text_list], lambda x: len(x[0])):
        media = store([p for p, _ in group])
        for (_, size), stored, images in zip(group, media, read(media)):
            payload = b"".join(thumb.tobytes() for _, thumb in images)
            features = ";".join(f"{f.width}x{f.height}:" + ":".join(thumbnail_hashes(thumb)) for f, thumb in images)
            yield (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                   len(stored), hashlib.sha256(stored).hexdigest(), features), stored


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id, ``SCHEMA``, and the JPEG bytes as ``media`` if asked for."""
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_"))
    schema = T.StructType([chosen.schema[0], *SCHEMA.fields, *[T.StructField("media", T.BinaryType())] * with_media])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [(*row, stored) if with_media else row for row, stored in describe(part.column(1).to_pylist())]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), KINDS if with_media else KINDS[:-1])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return chosen.mapInArrow(run, schema)


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
