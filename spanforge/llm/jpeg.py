"""Baseline JPEG in numpy: markers, Huffman scans, DC-only luminance thumbnails.

``decode`` reads baseline sequential files (SOF0, 8 bit, 1 to 4 components, restart intervals) and keeps only the DC
coefficient of each block, so a thumbnail is 1/8 of the size in either direction. Restart intervals of all files of
a call are decoded in step: one look-up a symbol for all of them.

``encode`` stores bytes losslessly: a grey image of one byte a block, the quantised DC coefficient (its unit is the
8-bit sample less 128), 64 blocks a restart interval.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

UNIT = 64
MOST_ROWS = 8191
#: Payload bytes of one image; more are stored as images one after another. Bounds the arrays of a call, too.
MOST_BYTES = UNIT * MOST_ROWS * 8
# Code lengths of the common DC table for categories 0 to 11.
DC_LENGTHS = (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9)


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical (code, length) of each symbol."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


def dht(kind: int, lengths: dict[int, int]) -> bytes:
    by = sorted(lengths, key=lambda s: lengths[s])
    body = bytes([kind, *(sum(n == k for n in lengths.values()) for k in range(1, 17)), *by])
    return segment(0xC4, body)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape(n: int) -> tuple[int, int]:
    """Rows and columns of blocks for n payload bytes, n a positive multiple of 64."""
    columns = UNIT * max(1, -(-n // (UNIT * MOST_ROWS)))
    return -(-n // columns), columns


def encode_all(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG of each payload (uint8, length a positive multiple of 64, ``MOST_BYTES`` at most)."""
    if not payloads:
        return []
    dims = [shape(len(p)) for p in payloads]
    padded = [p if len(p) == r * c else np.pad(p, (0, r * c - len(p))) for p, (r, c) in zip(payloads, dims)]
    value = np.concatenate(padded).astype(np.int32) - 128
    diff = value.copy()
    diff[1:] -= value[:-1]
    diff[::UNIT] = value[::UNIT]
    size = np.abs(diff)
    category = np.zeros(len(diff), np.int32)
    for k in range(9):
        category += size >> k > 0
    table = codes(dict(enumerate(DC_LENGTHS)))
    code, length = np.array([table[k][0] for k in range(12)], np.int32), np.array(DC_LENGTHS, np.int32)
    bits = length[category] + category + 1  # one 0 bit: end of block
    word = (((code[category] << category) | np.where(diff < 0, diff + (1 << category) - 1, diff)) << 1).astype(np.int64)
    total = bits.reshape(-1, UNIT)
    before = np.cumsum(total, axis=1)
    used = before[:, -1]
    full = (used + 7) >> 3
    first = np.cumsum(full) - full
    at = ((first * 8)[:, None] + before - total).ravel()
    word <<= 24 - bits - (at & 7)
    place = at >> 3
    end = int(full.sum())
    out = np.bincount(place, word >> 16, end + 2) + np.bincount(place + 1, (word >> 8) & 255, end + 2) + np.bincount(place + 2, word & 255, end + 2)
    out = out[:end].astype(np.uint8)
    last = first + full - 1
    out[last] |= ((1 << (full * 8 - used)) - 1).astype(np.uint8)
    heads = np.cumsum([0] + [len(p) // UNIT for p in padded])
    marked = np.ones(len(full), bool)
    marked[heads[1:] - 1] = False  # no restart marker after a file's last interval
    width = 1 + (out == 255).astype(np.int64)
    width[last] += 2 * marked
    to = np.cumsum(width) - width
    scan = np.zeros(int(width.sum()), np.uint8)
    scan[to] = out
    interval = np.arange(len(full)) - np.repeat(heads[:-1], np.diff(heads))
    where = (to + width)[last[marked]]
    scan[where - 2], scan[where - 1] = 255, 0xD0 + (interval[marked] & 7)
    cut = np.append(to, len(scan))[np.append(first, end)[heads]]
    tables = dht(0x00, dict(enumerate(DC_LENGTHS))) + dht(0x10, {0: 1}) + segment(0xDD, struct.pack(">H", UNIT))
    quant = segment(0xDB, bytes([0, *[8] * 64]))
    start = segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    files = []
    for i, (p, (r, c)) in enumerate(zip(payloads, dims)):
        frame = segment(0xC0, struct.pack(">BHHB", 8, r * 8, c * 8, 1) + bytes([1, 0x11, 0]))
        files.append(b"".join((b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(p))), quant, frame, tables, start, scan[cut[i] : cut[i + 1]].tobytes(), b"\xff\xd9")))
    return files


@dataclass
class Header:
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, list[int]] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    order: list[tuple[int, int]] = field(default_factory=list)  # of the scan: component, DC and AC table
    restart: int = 0
    comment: bytes = b""
    scan: int = 0


def header(data: bytes) -> Header:
    """Markers up to the scan; ValueError if it isn't a baseline file of one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    h, at = Header(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                h.quant[name] = list(struct.unpack_from(">64H" if wide else ">64B", body, k + 1))
                k += 1 + 64 * (1 + (wide > 0))
        elif kind == 0xC0:
            depth, h.height, h.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("8 bits expected")
            h.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                h.huffman[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind == 0xDD:
            h.restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            h.comment = body
        elif kind == 0xDA:
            names = [p[0] for p in h.parts]
            h.order = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            if len(h.order) != len(h.parts) or not h.width or not h.height:
                raise ValueError("one scan of all components expected")
            h.scan = at
            return h
    raise ValueError("no scan")


def images(data: bytes) -> list[bytes]:
    """The JPEG files that lie one after another in ``data``; ValueError as in ``header``."""
    out = []
    while data:
        end = data.find(b"\xff\xd9", header(data).scan)  # coded data can't hold it
        if end < 0:
            raise ValueError("no end")
        out.append(data[: end + 2])
        data = data[end + 2 :]
    return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def lookup(spec: bytes) -> np.ndarray:
    """Length * 256 + symbol by the next 16 bits; 0 where no code begins so."""
    if spec not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        table, code, at = np.zeros(65536, np.int32), 0, 16
        for n in range(1, 17):
            for _ in range(spec[n - 1]):
                low = code << (16 - n)
                table[low : low + (1 << (16 - n))] = n * 256 + spec[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[spec] = table
    return _LOOKUPS[spec]


def intervals(data: bytes, start: int) -> list[np.ndarray]:
    """Entropy-coded bytes of each restart interval, stuffing removed."""
    raw = np.frombuffer(data, np.uint8)[start:]
    follows = np.append(raw[1:], 0)
    mark = (raw == 255) & (follows != 0) & (follows != 255)
    restart = mark & (follows >= 0xD0) & (follows <= 0xD7)
    ends = np.flatnonzero(mark & ~restart)
    end = int(ends[0]) if len(ends) else len(raw)
    cuts = np.flatnonzero(restart[:end])
    keep = np.ones(len(raw), bool)
    keep[1:][(raw[:-1] == 255) & (raw[1:] == 0)] = False
    keep[cuts] = keep[cuts + 1] = False
    count = np.concatenate([[0], np.cumsum(keep)])
    bounds = count[np.concatenate([[0], cuts, [end]])]
    return np.split(raw[:end][keep[:end]], bounds[1:-1])


def decode(files: list[bytes]) -> list[tuple[Header, np.ndarray] | None]:
    """Header and quantised luminance DC of each block (rows, columns) of each file; None where it can't be read."""
    out: list = [None] * len(files)
    alike: dict[tuple, list[tuple[int, Header, list[np.ndarray]]]] = {}
    for i, data in enumerate(files):
        try:
            h = header(data)
            key = (tuple((h.parts[c][1:3], h.huffman[t >> 4], h.huffman[16 + (t & 15)]) for c, t in h.order),)
        except (ValueError, KeyError, IndexError, struct.error):
            continue
        alike.setdefault(key, []).append((i, h, intervals(data, h.scan)))
    for (key,), group in alike.items():
        alone = len(key) == 1
        blocks = [(c, lookup(dc), lookup(ac)) for c, ((across, down), dc, ac) in enumerate(key) for _ in range(1 if alone else across * down)]
        lanes, units, owners = [], [], []
        for g, (_, h, parts) in enumerate(group):
            left = units_of(h)
            for part in parts:
                n = min(left, h.restart or left)
                lanes.append(part)
                units.append(n)
                owners.append(g)
                left -= n
        dc, good = scan_dc(lanes, np.array(units), blocks)
        firsts = np.cumsum(units) - units
        heads = np.searchsorted(owners, np.arange(len(group) + 1))
        for g, (i, h, _) in enumerate(group):
            a, b = heads[g], heads[g + 1]
            n = units_of(h)
            if good[a:b].all() and sum(units[a:b]) == n:
                out[i] = h, luminance(dc[firsts[a] : firsts[a] + n], h)
    return out


def units_of(h: Header) -> int:
    """Coded units (MCUs)."""
    across, down = (1, 1) if len(h.parts) == 1 else (max(p[1] for p in h.parts), max(p[2] for p in h.parts))
    return -(-h.width // (8 * across)) * -(-h.height // (8 * down))


def scan_dc(lanes: list[np.ndarray], units: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """DC values of the first component's blocks of each unit, lanes one after another, and which lanes were sound."""
    mine = sum(c == blocks[0][0] for c, _, _ in blocks)
    order = np.argsort(-units, kind="stable")
    firsts = (np.cumsum(units) - units)[order]
    sizes = np.array([len(x) for x in lanes])
    flat = np.concatenate([*lanes, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
    heads = np.cumsum(sizes) - sizes
    bit, limit = heads[order] * 8, ((heads + sizes) * 8)[order]
    last_word = len(words) - 1
    out = np.zeros((int(units.sum()), mine), np.int32)
    good = np.ones(len(lanes), bool)
    before = np.zeros((max(c for c, _, _ in blocks) + 1, len(lanes)), np.int64)
    counts = units[order]
    n = len(lanes)

    def take(lut: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = words[np.minimum(bits >> 3, last_word)] << (bits & 7).astype(np.uint32)
        return lut[word >> 16], word

    for unit in range(int(counts[0]) if n else 0):
        while n and counts[n - 1] <= unit:
            n -= 1
        seen = 0
        for part, dc, ac in blocks:
            entry, word = take(dc, bit[:n])
            length, category = entry >> 8, entry & 255
            good[:n] &= (length > 0) & (category <= 11)
            # 25 bits of the word are sure; code and magnitude take up to 16 + 11, so long ones are read anew
            if (long := length + category > 25).any():
                again = (bit[:n] + length)[long]
                word[long] = take(dc, again)[1] >> length[long].astype(np.uint32)
            value = ((word << length.astype(np.uint32)) >> 16).astype(np.int64) >> (16 - np.minimum(category, 16))
            value = np.where(category > 0, np.where(value < (1 << category >> 1), value - (1 << category) + 1, value), 0)
            before[part][:n] += value
            bit[:n] += length + category
            if part == blocks[0][0]:
                out[firsts[:n] + unit, seen] = before[part][:n]
                seen += 1
            live, k = np.arange(n), np.ones(n, np.int64)
            while len(live):
                entry = take(ac, bit[live])[0]
                length, symbol = entry >> 8, entry & 255
                good[live[length == 0]] = False
                run, category = symbol >> 4, symbol & 15
                bit[live] += length + category
                k = k + run + 1
                more = (k < 64) & (length > 0) & ((category > 0) | (run == 15))
                if more.all():
                    continue
                live, k = live[more], k[more]
    good &= bit <= limit
    result = np.ones(len(lanes), bool)
    result[order] = good
    return out, result


def luminance(dc: np.ndarray, h: Header) -> np.ndarray:
    """Blocks of the first component in place; only those that cover the image."""
    _, across, down, _ = h.parts[0]
    if len(h.parts) == 1:
        across = down = 1
    most_across, most_down = (1, 1) if len(h.parts) == 1 else (max(p[1] for p in h.parts), max(p[2] for p in h.parts))
    columns = -(-h.width // (8 * most_across))
    grid = dc.reshape(-1, columns, down, across).transpose(0, 2, 1, 3).reshape(-1, columns * across)
    wide, high = -(-(-(-h.width * across // most_across)) // 8), -(-(-(-h.height * down // most_down)) // 8)
    return grid[:high, :wide]


def thumbnail(h: Header, dc: np.ndarray) -> np.ndarray:
    """8-bit samples, one a block."""
    step = h.quant.get(h.parts[0][3], [8])[0]
    return np.clip(np.rint(dc * step / 8) + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: which of 8 x 8 areas are lighter than their mean."""
    rows, columns = thumb.shape
    r, c = np.arange(8) * rows // 8, np.arange(8) * columns // 8
    area = np.add.reduceat(np.add.reduceat(thumb.astype(np.float64), r, axis=0), c, axis=1)
    area /= np.outer(np.maximum(1, np.diff(np.append(r, rows))), np.maximum(1, np.diff(np.append(c, columns))))
    return np.packbits(area.ravel() > area.mean()).tobytes().hex()


def payload(h: Header, dc: np.ndarray) -> bytes:
    """What ``encode_all`` stored."""
    return (dc.ravel()[: struct.unpack(">Q", h.comment)[0]] + 128).astype(np.uint8).tobytes()
