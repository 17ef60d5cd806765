"""Progressive JPEG in numpy, many images at a time.

Decoding: scans are read one after another; the images of a batch that agree on a scan's parameters and tables are read
together, one symbol of every restart interval of every image per step. Scans add to coefficient arrays (spectral
selection fills bands, successive approximation adds bits); then an inverse transform in exact integer arithmetic,
chroma upsampling and conversion to RGB. Equal files give equal pixels in whatever batch.

Encoding: coefficient arrays to 4:2:0 files with restart intervals, in the scan order of SCRIPT.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: Scans that are written: components, first and last coefficient, bit position before (0: first scan) and after.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 0, 0), ((0,), 1, 5, 1, 0), ((0, 1, 2), 0, 0, 1, 0)]
#: Units (blocks, or groups of six for all components) to a restart interval.
INTERVAL = 8
NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


# --- Huffman tables


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code over the weights and one more symbol, so that no code is all ones."""
    heap = [(float(w), i, None) for i, w in enumerate(weights)] + [(0.0, len(weights), None)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
        n += 1
    lengths = np.zeros(len(weights) + 1, int)
    todo = [(heap[0], 0)]
    while todo:
        (_, i, kids), depth = todo.pop()
        if kids is None:
            lengths[i] = depth
        else:
            todo += [(k, depth + 1) for k in kids]
    return lengths[:-1]


def table_of(symbols: list[int], weights: list[float]) -> bytes:
    """The body of a DHT table (without its number): counts by length, then the symbols by length."""
    lengths = code_lengths(np.maximum(np.array(weights) / sum(weights), 2.0**-13))
    assert lengths.max() <= 16
    order = sorted(range(len(symbols)), key=lambda i: (lengths[i], i))
    return bytes(int((lengths == n).sum()) for n in range(1, 17)) + bytes(symbols[i] for i in order)


def codes(table: bytes) -> dict[int, tuple[int, int]]:
    """symbol: (code, length)."""
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[table[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_luts: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: length * 256 + symbol of the code that they begin with (0: none)."""
    if table not in _luts:
        lut = np.zeros(1 << 16, np.int32)
        for symbol, (code, n) in codes(table).items():
            lut[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
        if len(_luts) > 64:
            _luts.clear()
        _luts[table] = lut
    return _luts[table]


def _own_tables() -> tuple[bytes, bytes, bytes]:
    """Tables for payloads of text: DC, AC and AC refinement, from rough shares of sizes and geometric runs. They
    have a code for each symbol that encode() can need: magnitudes up to 128, refined bands of five."""
    size = {1: 0.25, 2: 0.28, 3: 0.27, 4: 0.12, 5: 0.05, 6: 0.02, 7: 0.008, 8: 0.002}
    ac = {(r << 4) | s: p * 0.84 * 0.16**r for s, p in size.items() for r in range(16)} | {0xF0: 1e-3, 0x00: 0.004}
    dc = dict(zip(range(10), (0.1, 0.08, 0.13, 0.2, 0.2, 0.12, 0.08, 0.05, 0.03, 0.005)))
    fine = {(r << 4) | 1: 0.4 * 0.4**r for r in range(6)} | {0x00: 0.5}
    return tuple(table_of(list(t), list(t.values())) for t in (dc, ac, fine))


# --- Encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _code_arrays(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in codes(table).items():
        code[s], length[s] = c, n
    return code, length


def _bit_size(v: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _first_scan(c: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, bits, length) of the codes of a first AC scan over c, the band's coefficients of each block."""
    code, length = _code_arrays(table)
    b, k = np.nonzero(c)
    v = c[b, k].astype(np.int64)
    new = np.ones(len(b), bool)
    new[1:] = b[1:] != b[:-1]
    run = k - np.where(new, 0, np.concatenate([[0], k[:-1] + 1]))
    size = _bit_size(v)
    skip = run // 16
    symbol = ((run % 16) << 4) | size
    last = np.full(len(c), -1)
    last[b] = k  # the last one written stays
    end = last < c.shape[1] - 1
    ends_before = np.cumsum(end) - end
    place = np.arange(len(b)) + np.cumsum(skip) + ends_before[b]
    total = len(b) + int(skip.sum()) + int(end.sum())
    block, bits, n = np.zeros(total, np.int64), np.full(total, code[0xF0]), np.full(total, length[0xF0])
    block[place], bits[place], n[place] = b, (code[symbol] << size) | _extra(v, size), length[symbol] + size
    if skip.any():
        some = np.flatnonzero(skip)
        at = np.repeat(place[some], skip[some]) - 1 - (np.arange(int(skip.sum())) - np.repeat(np.cumsum(skip[some]) - skip[some], skip[some]))
        block[at] = np.repeat(b[some], skip[some])
    per = np.bincount(block[place], minlength=len(c)) + np.bincount(b, skip, minlength=len(c)).astype(np.int64) + end
    at = np.cumsum(per)[end] - 1
    block[at], bits[at], n[at] = np.flatnonzero(end), code[0], length[0]
    return block, bits, n


def _fine_scan(c: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One string of bits a block: a refinement (of the lowest bit) of a band of at most 5 coefficients."""
    code, length = _code_arrays(table)
    n = len(c)
    bits, size, late, n_late, run = (np.zeros(n, np.int64) for _ in range(5))
    magnitude = np.abs(c).astype(np.int64)
    fresh = magnitude == 1
    last = np.where(fresh.any(axis=1), c.shape[1] - 1 - np.argmax(fresh[:, ::-1], axis=1), -1)
    for k in range(c.shape[1]):
        old, new = magnitude[:, k] > 1, fresh[:, k]
        late, n_late = np.where(old, late << 1 | (magnitude[:, k] & 1), late), n_late + old
        symbol = (run << 4) | 1
        add = (((code[symbol] << 1) | (c[:, k] > 0)) << n_late) | late
        n_add = length[symbol] + 1 + n_late
        bits, size = np.where(new, (bits << n_add) | add, bits), np.where(new, size + n_add, size)
        run = np.where(new, 0, np.where(old, run, run + 1))
        late, n_late = np.where(new, 0, late), np.where(new, 0, n_late)
    rest = last < c.shape[1] - 1
    n_add = length[0] + n_late
    bits, size = np.where(rest, (bits << n_add) | (code[0] << n_late) | late, bits), np.where(rest, size + n_add, size)
    return np.arange(n), bits, size


def _packed(unit: np.ndarray, bits: np.ndarray, n: np.ndarray, interval_of: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of all intervals and each interval's length. unit: of each code, in order; interval_of: of each unit."""
    at = interval_of[unit]
    size = np.bincount(at, n, minlength=intervals).astype(np.int64)
    octets = -(-size // 8)
    first = np.cumsum(octets) - octets
    stop = np.cumsum(n)
    begin = np.cumsum(size) - size
    start = first[at] * 8 + (stop - n) - begin[at]
    # The last byte of an interval is filled with ones.
    fill = octets * 8 - size
    some = np.flatnonzero(fill)
    start = np.concatenate([start, (first[some] + octets[some]) * 8 - fill[some]])
    bits = np.concatenate([bits, (1 << fill[some]) - 1])
    n = np.concatenate([n, fill[some]])
    low = start >> 3
    span = (start & 7) + n
    total = int(octets.sum())
    out = np.zeros(total + 9)
    for lane in range(int(-(-span.max(initial=0) // 8))):
        shift = span - 8 * (lane + 1)
        part = np.where(shift >= 0, bits >> np.maximum(shift, 0), bits << np.minimum(-np.minimum(shift, 0), 8)) & 255
        live = span > 8 * lane
        out[: total + 9] += np.bincount(low[live] + lane, part[live], minlength=total + 9)[: total + 9]
    data = out[:total].astype(np.uint8)
    full = data == 255
    reps = 1 + full
    stuffed = np.repeat(data, reps)
    stuffed[np.cumsum(reps)[full] - 1] = 0
    owner = np.repeat(np.arange(intervals), octets)
    return stuffed, np.bincount(owner, reps, minlength=intervals).astype(np.int64)


TABLES = _own_tables()


def geometry(blocks: int) -> tuple[int, int]:
    """Groups of six blocks (four luma, two chroma) in a row, and rows, of an image for so many blocks."""
    groups = max(1, -(-blocks // 6))
    wide = int(np.ceil(np.sqrt(groups)))
    return wide, -(-groups // wide)


def encode(payloads: list[np.ndarray], notes: list[bytes]) -> list[bytes]:
    """Files whose coefficients are the rows of each payload ((blocks, 64) int16, zigzag order, at least one row),
    dealt to groups of four luma and two chroma blocks. A note goes into each file's comment."""
    shape = [geometry(len(p)) for p in payloads]
    groups = np.array([w * h for w, h in shape])
    first = np.cumsum(groups) - groups
    whole = np.zeros((int(groups.sum()) * 6, 64), np.int16)
    for p, at in zip(payloads, first):
        whole[at * 6 : at * 6 + len(p)] = p
    # Luma rows in raster order of each image: row y of blocks takes two of the four from each group.
    six = whole.reshape(-1, 6, 64)
    luma = np.concatenate([six[a : a + w * h, :4].reshape(h, w, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) for a, (w, h) in zip(first, shape)])
    planes = [luma, six[:, 4], six[:, 5]]
    files: list[list[bytes]] = []
    dc, ac, fine = TABLES
    tables = _segment(0xC4, b"\x00" + dc) + _segment(0xC4, b"\x10" + ac) + _segment(0xC4, b"\x11" + fine)
    for note, (w, h) in zip(notes, shape):
        frame = struct.pack(">BHHB", 8, h * 16, w * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        files.append([b"\xff\xd8", _segment(0xFE, note), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC2, frame), tables, _segment(0xDD, struct.pack(">H", INTERVAL))])
    for comps, start, stop, high, low in SCRIPT:
        if start == 0:
            value = six[:, :, 0].astype(np.int64)
            per_image = groups
            if high:
                unit, bits, n = np.arange(len(six)), (value & 1) @ (1 << np.arange(5, -1, -1)), np.full(len(six), 6)
            else:
                value = value >> low
                begin = np.zeros(len(six), bool)
                for a, g in zip(first, groups):
                    begin[a : a + g : INTERVAL] = True
                diff = np.empty_like(value)
                diff[:, 1:4] = value[:, 1:4] - value[:, 0:3]
                for k, before in ((0, 3), (4, 4), (5, 5)):
                    diff[:, k] = value[:, k] - np.where(begin, 0, np.concatenate([[0], value[:-1, before]]))
                size = _bit_size(diff)
                code, length = _code_arrays(dc)
                unit, bits, n = np.repeat(np.arange(len(six)), 6), ((code[size] << size) | _extra(diff, size)).ravel(), (length[size] + size).ravel()
        else:
            band = planes[comps[0]][:, start : stop + 1]
            per_image = groups * (4 if comps[0] == 0 else 1)
            if high:
                unit, bits, n = _fine_scan(band, fine)
            else:
                shifted = np.sign(band) * (np.abs(band) >> low) if low else band
                unit, bits, n = _first_scan(shifted, ac)
        count = -(-per_image // INTERVAL)
        interval_of = np.concatenate([a + np.arange(u) // INTERVAL for a, u in zip(np.cumsum(count) - count, per_image)])
        data, lengths = _packed(unit, bits, n, interval_of, int(count.sum()))
        ends = np.cumsum(lengths).tolist()
        table = 0x01 if high and start else 0x00
        head = _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, table]) for c in comps) + bytes([start, stop, high << 4 | low]))
        raw, at, begin = data.tobytes(), 0, 0
        for f, k in zip(files, count.tolist()):
            f.append(head)
            for i in range(k):
                f.append(raw[begin : ends[at]])
                begin, at = ends[at], at + 1
                if i < k - 1:
                    f.append(bytes([0xFF, 0xD0 + i % 8]))
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


# --- Decoding


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row and rows, as scans of this component alone have them
    high: int = 0
    full_wide: int = 0  # the same, filled up to whole groups
    full_high: int = 0
    row: int = 0  # of its first block in the batch's coefficients


@dataclass
class Image:
    height: int = 0
    width: int = 0
    note: bytes = b""
    parts: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)
    groups_wide: int = 0
    groups_high: int = 0


def parse(data: bytes) -> Image:
    """Headers of a progressive file and its scans: (parameters, components, entropy-coded bytes)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, interval, at = Image(), {}, 0, 2
    while True:
        marker, size = data[at + 1], 0
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.note = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                image.quants[body[0] & 15] = values
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(c.h for c in image.parts), max(c.v for c in image.parts)
            image.groups_wide, image.groups_high = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            for c in image.parts:
                c.wide, c.high = -(-(-(-image.width * c.h // most_h)) // 8), -(-(-(-image.height * c.v // most_v)) // 8)
                c.full_wide, c.full_high = image.groups_wide * c.h, image.groups_high * c.v
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDA:
            n = body[0]
            comps = tuple(next(i for i, c in enumerate(image.parts) if c.id == body[1 + 2 * k]) for k in range(n))
            start, stop, bits = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(body[2 + 2 * k] >> 4 if start == 0 else 0x10 | body[2 + 2 * k] & 15, b"") for k in range(n))
            layout = tuple((image.parts[c].h, image.parts[c].v) for c in comps)
            end = NEXT_MARKER.search(data, at).start()
            image.scans.append(((comps, start, stop, bits >> 4, bits & 15, used, interval, layout), data[at:end]))
            at = end


def _reader(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit windows from each byte of all chunks without stuffing and restart markers; the first bit of each
    interval; the chunk of each interval."""
    raw = np.frombuffer(b"".join(chunks) + b"\x00\x00", np.uint8)
    sizes = np.array([len(c) for c in chunks])
    starts = np.cumsum(sizes) - sizes
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    new = np.cumsum(keep) - keep
    begin = np.sort(np.concatenate([starts, marks + 2]))
    chunk = np.searchsorted(starts, begin, "right") - 1
    data = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
    n = len(data) - 7
    windows = np.zeros(n, np.uint64)
    for k in range(8):
        windows |= data[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    return windows, new[begin].astype(np.int64) * 8, chunk


def _peek(windows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48 bits and more from bit positions, at the top of 63-bit numbers."""
    byte = np.minimum(at >> 3, len(windows) - 1)
    return ((windows[byte] << (at & 7).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _runs(group: list[tuple[Image, bytes]], units: list[int], interval: int) -> tuple[np.ndarray, ...]:
    """windows; of each interval: first bit, its first unit (over all images), number of units."""
    windows, bit, chunk = _reader([d for _, d in group])
    units_of = np.array(units)
    base = np.cumsum(units_of) - units_of
    number = np.arange(len(chunk)) - np.searchsorted(chunk, chunk)
    each = interval or max(units)
    count = np.minimum(each, units_of[chunk] - number * each)
    if (count <= 0).any():
        raise ValueError("damaged file: more restart intervals than blocks")
    return windows, bit, base[chunk] + number * each, count


def _alone(image: Image, comp: int) -> np.ndarray:
    """Rows of a component's blocks in the order of its own scans."""
    c = image.parts[comp]
    return (c.row + np.arange(c.high)[:, None] * c.full_wide + np.arange(c.wide)).ravel()


def _together(image: Image, comps: tuple[int, ...]) -> np.ndarray:
    """Rows of the blocks of each group, groups in order: (groups, blocks of a group)."""
    out = []
    y, x = (a.ravel() for a in np.mgrid[: image.groups_high, : image.groups_wide])
    for k in comps:
        c = image.parts[k]
        for v in range(c.v):
            for h in range(c.h):
                out.append(c.row + (y * c.v + v) * c.full_wide + x * c.h + h)
    return np.stack(out, axis=1)


def _dc(coefs, group, params) -> None:
    comps, _, _, high, low, used, interval, layout = params
    if len(comps) == 1:
        rows = [_alone(i, comps[0])[:, None] for i, _ in group]
        owner = [0]
    else:
        rows = [_together(i, comps) for i, _ in group]
        owner = [k for k, (h, v) in enumerate(layout) for _ in range(h * v)]
    windows, at, first, count = _runs(group, [len(r) for r in rows], interval)
    rows = np.concatenate(rows)
    last = np.zeros((len(at), len(comps)), np.int64)
    for unit in range(int(count.max())):
        live = np.flatnonzero(unit < count)
        for k, c in enumerate(owner):
            w = _peek(windows, at[live])
            where = rows[first[live] + unit, k]
            if high:
                coefs[where, 0] |= ((w >> 62) << low).astype(np.int16)
                at[live] += 1
                continue
            code = lookup(used[c])[w >> 47]
            n, size = code >> 8, code & 255
            bits = (w >> (63 - n - size)) & ((1 << size) - 1)
            last[live, c] += _signed(bits, size)
            coefs[where, 0] = last[live, c] << low
            at[live] += n + size


def _ac_first(coefs, group, params) -> None:
    comps, start, stop, _, low, used, interval, _ = params
    rows = [_alone(i, comps[0]) for i, _ in group]
    windows, at, first, count = _runs(group, [len(r) for r in rows], interval)
    rows, lut = np.concatenate(rows), lookup(used[0])
    k, end = np.full(len(at), start), first + count
    block = first.copy()
    flat, big = coefs.reshape(-1), len(windows) - 1
    while len(at):
        w = ((windows[np.minimum(at >> 3, big)] << (at & 7).astype(np.uint64)) >> np.uint64(1)).view(np.int64)
        code = lut[w >> 47].astype(np.int64)
        n, run, size = code >> 8, (code >> 4) & 15, code & 15
        plain = size > 0
        jump = (run < 15) & ~plain
        more = np.where(jump, run, size)
        bits = (w >> (63 - n - more)) & ((1 << more) - 1)
        at += n + more
        k += run
        place = np.flatnonzero(plain)
        flat[rows[block[place]] * 64 + np.minimum(k[place], 63)] = _signed(bits[place], size[place]) << low
        k += 1
        over = jump | (k > stop)
        block += np.where(jump, (1 << run) + bits, over)
        k[over] = start
        live = block < end
        if not live.all():
            at, k, end, block = at[live], k[live], end[live], block[live]


def _ac_fine(coefs, group, params) -> None:
    comps, start, stop, _, low, used, interval, _ = params
    rows = [_alone(i, comps[0]) for i, _ in group]
    windows, at, first, count = _runs(group, [len(r) for r in rows], interval)
    rows, lut = np.concatenate(rows), lookup(used[0])
    end, block, k = first + count, first.copy(), np.full(len(at), start)
    skip, fresh, left = (np.zeros(len(at), np.int64) for _ in range(3))
    need = np.ones(len(at), bool)
    flat, one = coefs.reshape(-1), 1 << low
    while len(at):
        ask = np.flatnonzero(need)
        if len(ask):
            w = _peek(windows, at[ask])
            code = lut[w >> 47].astype(np.int64)
            n, run, size = code >> 8, (code >> 4) & 15, code & 15
            jump = (size == 0) & (run < 15)
            more = np.where(jump, run, size)
            bits = (w >> (63 - n - more)) & ((1 << more) - 1)
            at[ask] += n + more
            left[ask] = np.where(jump, (1 << run) + bits, 0)
            skip[ask] = run
            fresh[ask] = np.where(size > 0, np.where(bits > 0, one, -one), 0)
            need[ask] = False
        where = rows[block] * 64 + k
        value = flat[where]
        old = np.flatnonzero(value)
        if len(old):
            bit = _peek(windows, at[old]) >> 62
            v = value[old]
            flat[where[old]] = v + np.where(bit > 0, np.where(v > 0, one, -one), 0)
            at[old] += 1
        zero = (value == 0) & (left == 0)
        done = zero & (skip == 0)
        put = np.flatnonzero(done & (fresh != 0))
        flat[where[put]] = fresh[put]
        skip -= zero & ~done
        need |= done
        k += 1
        over = k > stop
        block += over
        k[over] = start
        need |= over & (left <= 1)
        left -= over & (left > 0)
        live = block < end
        if not live.all():
            at, end, block, k, skip, fresh, left, need = (a[live] for a in (at, end, block, k, skip, fresh, left, need))


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images and the coefficients of all their blocks, (blocks, 64) int16 in zigzag order; Component.row tells whose."""
    images = [parse(f) for f in files]
    rows = 0
    for image in images:
        for c in image.parts:
            c.row = rows
            rows += c.full_wide * c.full_high
    coefs = np.zeros((rows, 64), np.int16)
    for number in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list] = {}
        for image in images:
            if number < len(image.scans):
                params, data = image.scans[number]
                groups.setdefault(params, []).append((image, data))
        for params, group in groups.items():
            read = _dc if params[1] == 0 else _ac_fine if params[3] else _ac_first
            read(coefs, group, params)
    return images, coefs


_BASIS = np.round(np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * 4096)


def samples(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) dequantised coefficients in zigzag order to (n, 8, 8) samples. All numbers are integers below 2 ** 53,
    so that sums are exact in any order."""
    natural = np.zeros((len(blocks), 64))
    natural[:, ZIGZAG] = blocks
    half = natural.reshape(-1, 8) @ _BASIS  # along rows
    full = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _BASIS
    out = np.floor(full / (1 << 24) + 0.5).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(out + 128, 0, 255).astype(np.uint8)


def rgb(images: list[Image], coefs: np.ndarray) -> list[np.ndarray]:
    """Full-resolution (height, width, 3) uint8 tensors; grey images get three equal channels."""
    out: list[np.ndarray | None] = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        key = (image.height, image.width, *((c.h, c.v, image.quants[c.quant].tobytes()) for c in image.parts))
        alike.setdefault(key, []).append(i)
    for own in alike.values():
        model = images[own[0]]
        most_h, most_v = max(c.h for c in model.parts), max(c.v for c in model.parts)
        planes = []
        for p, c in enumerate(model.parts):
            n = c.full_wide * c.full_high
            rows = np.concatenate([np.arange(n) + images[i].parts[p].row for i in own])
            pixels = samples(coefs[rows].astype(np.int64) * model.quants[c.quant])
            plane = pixels.reshape(len(own), c.full_high, c.full_wide, 8, 8).transpose(0, 1, 3, 2, 4).reshape(len(own), c.full_high * 8, c.full_wide * 8)
            planes.append(plane.repeat(most_v // c.v, axis=1).repeat(most_h // c.h, axis=2)[:, : model.height, : model.width])
        if len(planes) == 1:
            tensor = np.repeat(planes[0][..., None], 3, axis=3)
        else:
            y, cb, cr = (x.astype(np.int32) for x in planes[:3])
            cb, cr = cb - 128, cr - 128
            # The YCbCr conversion in 16 fractional bits.
            red = y + ((91881 * cr + 32768) >> 16)
            green = y - ((22554 * cb + 46802 * cr - 32768) >> 16)
            blue = y + ((116130 * cb + 32768) >> 16)
            tensor = np.clip(np.stack([red, green, blue], axis=3), 0, 255).astype(np.uint8)
        for i, t in zip(own, tensor):
            out[i] = t
    return out
