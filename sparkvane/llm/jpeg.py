"""Progressive JPEG in numpy, many files at once.

Scans are decoded in lockstep: all entropy-coded segments (restart intervals)
of all files whose scans have like parameters and tables advance together, one
symbol a step, so the loop is as long as a segment and not as a corpus.
Spectral-selection and successive-approximation scans accumulate in one
coefficient array in MCU order. Inverse transform and colour conversion use
whole numbers only, so results do not depend on batching.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)), np.int64)
INTERVAL = 8  # MCUs between restarts in files written here
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_SIZE = np.array([i.bit_length() for i in range(1 << 12)], np.int64)


# -- Huffman tables ---------------------------------------------------------------------


def _table(lengths: dict[int, list[int]]) -> bytes:
    """BITS and HUFFVAL of a DHT segment from {code length: symbols}."""
    return bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(s for n in sorted(lengths) for s in lengths[n])


_ALL_AC = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
_SHORT = {3: [0x03, 0x04, 0x05, 0x06, 0x02], 4: [0x01, 0x07, 0x00]}
DC_TABLE = _table({4: list(range(12))})
AC_TABLE = _table(_SHORT | {12: [s for s in _ALL_AC if s not in sum(_SHORT.values(), [])]})
REFINE_TABLE = _table({1: [0x00], 2: [0x01], 8: [r << 4 | 1 for r in range(1, 16)] + [0xF0]})


@lru_cache(64)
def _codes(table: bytes):
    """symbol -> (code, length), and the 16-bit look-up of length << 8 | symbol."""
    code, at = 0, 16
    code_of, len_of = np.zeros(256, np.int64), np.zeros(256, np.int64)
    look = np.zeros(1 << 16, np.int64)
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            s = table[at]
            at += 1
            code_of[s], len_of[s] = code, n
            look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1
        code <<= 1
    return code_of, len_of, look


# -- geometry ------------------------------------------------------------------------------


@lru_cache(4096)
def raster_order(mcux: int, per_mcu: int, at: int, h: int, v: int, bw: int, bh: int):
    """Block ids within a file of one component, in the order of a scan of its own."""
    b = np.arange(bw * bh)
    row, col = b // bw, b % bw
    mcu = (row // v) * mcux + col // h
    return mcu * per_mcu + at + (row % v) * h + col % h


# -- encoder -------------------------------------------------------------------------------


def _pack(val, nb, per_segment):
    """Codes to bytes, each segment aligned and padded with ones; (buffer, byte offsets)."""
    ends = np.cumsum(per_segment)
    cum = np.concatenate(([0], np.cumsum(nb)))
    bits = cum[ends] - cum[ends - per_segment]
    size = (bits + 7) >> 3
    off = np.concatenate(([0], np.cumsum(size)))
    shift = off[:-1] * 8 - cum[ends - per_segment]
    pos = cum[:-1] + np.repeat(shift, per_segment)
    words = np.zeros(int(off[-1]) // 8 + 2, np.uint64)
    w, over = pos >> 6, (pos & 63) + nb - 64
    v = val.astype(np.uint64)
    main = np.where(over <= 0, v << np.maximum(-over, 0).astype(np.uint64), v >> np.maximum(over, 0).astype(np.uint64))
    if len(w):
        start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        words[w[start]] = np.bitwise_or.reduceat(main, start)
        s = np.flatnonzero(over > 0)
        words[w[s] + 1] |= v[s] << (64 - over[s]).astype(np.uint64)
    buf = np.frombuffer(words.astype(">u8").tobytes(), np.uint8)[: int(off[-1])].copy()
    some = size > 0
    buf[off[1:][some] - 1] |= ((1 << (size * 8 - bits)) - 1)[some].astype(np.uint8)
    return buf.tobytes(), off


@lru_cache(4)
def _first_lut(al: int):
    """(value, bits) of a coefficient without a run before it, by coefficient + 256."""
    code, length, _ = _codes(AC_TABLE)
    v = np.arange(-256, 256)
    m = np.abs(v) >> al
    size = _SIZE[m]
    val = code[size] << size | np.where(v > 0, m, (1 << size) - 1 - m)
    return val.astype(np.uint64), (length[size] + size).astype(np.uint8)


def _mixed(full, fast, slow, blocks, per_segment):
    """Entries of full rows (a matrix of one shape) and of the others, in block order."""
    per_block = np.empty(len(blocks), np.int64)
    fv, fn = fast
    per_block[full] = fv.shape[1]
    if full.all():
        val, nb = fv.ravel(), fn.ravel()
    else:
        sv, sn, per_block[~full] = slow
        begin = np.cumsum(per_block) - per_block
        val, nb = np.empty(int(per_block.sum()), np.uint64), np.empty(int(per_block.sum()), np.int64)
        at = begin[full][:, None] + np.arange(fv.shape[1])
        val[at], nb[at] = fv, fn
        own = per_block[~full]
        at = np.repeat(begin[~full] - (np.cumsum(own) - own), own) + np.arange(len(sv))
        val[at], nb[at] = sv.astype(np.uint64), sn
    return _pack(val, nb, np.add.reduceat(per_block, np.cumsum(per_segment) - per_segment))


def _encode_first(blocks, per_segment, ss, se, al):
    """Rows without a zero, the common case of dense data, join five codes to an entry."""
    band = blocks[:, ss : se + 1]
    mag = np.abs(band) >> al
    full = (mag > 0).all(1) & (np.abs(band).max(1, initial=0) <= 255) & (mag.max(1, initial=0) < 128)
    lut_v, lut_n = _first_lut(al)
    at = (band[full] + np.int16(256)) if not full.all() else band + np.int16(256)
    v, n = lut_v[at], lut_n[at]
    starts = range(0, se - ss + 1, 5)
    fv, fn = np.empty((len(at), len(starts)), np.uint64), np.empty((len(at), len(starts)), np.int64)
    for g, a in enumerate(starts):
        acc, used = v[:, a], n[:, a].astype(np.int64)
        for k in range(a + 1, min(a + 5, se - ss + 1)):
            acc = acc << n[:, k] | v[:, k]
            used = used + n[:, k]
        fv[:, g], fn[:, g] = acc, used
    rest = blocks[~full]
    return _mixed(full, (fv, fn), _first_entries(rest, ss, se, al) if len(rest) else None, blocks, per_segment)


def _first_entries(blocks, ss, se, al):
    code, length, _ = _codes(AC_TABLE)
    v = blocks[:, ss : se + 1].astype(np.int64)
    width = se - ss + 1
    mag = np.abs(v) >> al
    b, j = np.nonzero(mag)
    m = mag[b, j]
    same = np.concatenate(([False], b[1:] == b[:-1])) if len(b) else np.zeros(0, bool)
    run = np.where(same, j - np.concatenate(([0], j[:-1])) - 1, j)
    size = _SIZE[m]
    sym = (run & 15) << 4 | size
    extra = np.where(v[b, j] > 0, m, (1 << size) - 1 - m)
    zrl = run >> 4
    last = np.full(len(blocks), -1)
    last[b] = j
    eob = last < width - 1
    eob_before = np.cumsum(eob) - eob
    nz = np.bincount(b, weights=1 + zrl, minlength=len(blocks)).astype(np.int64)
    upto = np.cumsum(nz)
    total = int(upto[-1] + eob.sum()) if len(blocks) else 0
    val, nb = np.full(total, code[0xF0]), np.full(total, length[0xF0])
    at = np.cumsum(1 + zrl) - 1 + eob_before[b]
    val[at], nb[at] = code[sym] << size | extra, length[sym] + size
    e = upto[eob] + eob_before[eob]
    val[e], nb[e] = code[0], length[0]
    return val, nb, nz + eob


def _encode_refine(blocks, per_segment, ss, se, al):
    """Rows whose coefficients all have a history are one code and up to 63 bits: one entry."""
    code, length, _ = _codes(REFINE_TABLE)
    band = blocks[:, ss : se + 1]
    width = se - ss + 1
    full = ((np.abs(band) >> al) > 1).all(1) & (int(length[0]) + width <= 64)
    bits = np.zeros((int(full.sum()), 64), np.uint8)
    bits[:, 64 - width :] = (np.abs(band[full]) >> al) & 1
    fv = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(-1, 1) | np.uint64(int(code[0]) << width)
    fn = np.full(fv.shape, int(length[0]) + width)
    rest = blocks[~full]
    return _mixed(full, (fv, fn), _refine_entries(rest, ss, se, al) if len(rest) else None, blocks, per_segment)


def _refine_entries(blocks, ss, se, al):
    """One bit of precision more: bit `al` of coefficients first sent down to al + 1."""
    code, length, _ = _codes(REFINE_TABLE)
    v = blocks[:, ss : se + 1].astype(np.int64)
    width = se - ss + 1
    mag = np.abs(v) >> al
    hist, new = mag > 1, mag == 1
    col = np.arange(width)
    last_new = np.where(new.any(1), width - 1 - np.argmax(new[:, ::-1], 1), -1)
    if new.any():
        zero = ~(hist | new)
        zc = np.cumsum(zero, 1)
        base = np.maximum.accumulate(np.where(new, zc, 0), 1)
        base = np.concatenate((np.zeros((len(v), 1), np.int64), base[:, :-1]), 1)
        run = zc - base  # zeros since the last new one, this one included
        cut = new | (zero & (run % 16 == 0) & (col < last_new[:, None]))
    else:
        run, cut = np.zeros_like(v), new
    eob = last_new < width - 1
    groups = cut.sum(1) + eob
    first_group = np.cumsum(groups) - groups
    gid = first_group[:, None] + np.cumsum(cut, 1) - cut
    hb, hj = np.nonzero(hist)
    hg = gid[hb, hj]
    n_groups = int(groups.sum())
    val, nb = np.empty(n_groups + len(hb), np.int64), np.empty(n_groups + len(hb), np.int64)
    at = np.arange(len(hb)) + hg + 1
    val[at], nb[at] = mag[hb, hj] & 1, 1
    of_group = np.bincount(hg, minlength=n_groups)
    start = np.arange(n_groups) + np.cumsum(of_group) - of_group
    val[start], nb[start] = code[0], length[0]
    cb, cj = np.nonzero(cut)
    if len(cb):
        s = start[gid[cb, cj]]
        is_new = new[cb, cj]
        sym = np.where(is_new, (run[cb, cj] % 16) << 4 | 1, 0xF0)
        val[s] = np.where(is_new, code[sym] << 1 | (v[cb, cj] > 0), code[sym])
        nb[s] = length[sym] + is_new
    return val, nb, groups + hist.sum(1)


def _encode_dc(dc, comp, per_segment, al):
    code, length, _ = _codes(DC_TABLE)
    v = dc.astype(np.int64) >> al
    seg = np.repeat(np.arange(len(per_segment)), per_segment)
    diff = v.copy()
    for c in range(int(comp.max()) + 1):
        i = np.flatnonzero(comp == c)
        same = seg[i[1:]] == seg[i[:-1]]
        diff[i[1:]] -= np.where(same, v[i[:-1]], 0)
    m = np.abs(diff)
    size = _SIZE[m]
    extra = np.where(diff > 0, m, (1 << size) - 1 - m)
    return _pack(code[size] << size | extra, length[size] + size, per_segment)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


_SCRIPT = [("dc", (1, 2, 3), 0, 0, 0, 1), ("first", (1, 2, 3), 1, 5, 0, 1), ("first", (1, 2, 3), 6, 63, 0, 1), ("refine", (1, 2, 3), 1, 63, 1, 0), ("dcbit", (1, 2, 3), 0, 0, 1, 0)]


def encode_blocks(coefs, mcus: list[int]) -> list[bytes]:
    """4:2:0 progressive files from quantised coefficients (all MCUs, 6, 64) in zigzag
    order; file i takes mcus[i] MCUs in as few MCU rows as fit, unused ones zero there."""
    rows = [max(1, -(-m // 4095)) for m in mcus]
    cols = [-(-m // r) for m, r in zip(mcus, rows)]
    full = np.array(rows) * np.array(cols)
    if (full != np.array(mcus)).any():
        wide = np.zeros((int(full.sum()), 6, 64), coefs.dtype)
        at = np.repeat(np.cumsum(full) - full - (np.cumsum(mcus) - mcus), mcus) + np.arange(sum(mcus))
        wide[at] = coefs
        coefs = wide
    flat = coefs.reshape(-1, 64)
    order, sizes, owner = [], [], []  # blocks of component scans; blocks per segment
    start = 0
    for i, (r, c) in enumerate(zip(rows, cols)):
        for k, (at, h) in enumerate(((0, 2), (4, 1), (5, 1))):
            o = start * 6 + raster_order(c, 6, at, h, h, c * h, r * h)
            order.append(o)
            n = -(-len(o) // INTERVAL)
            sizes += [INTERVAL] * (n - 1) + [len(o) - INTERVAL * (n - 1)]
            owner.append(n)
        start += r * c
    order, sizes = np.concatenate(order), np.array(sizes)
    mcu_sizes, mcu_owner = [], []
    for m in full.tolist():
        n = -(-m // INTERVAL)
        mcu_sizes += [INTERVAL * 6] * (n - 1) + [6 * (m - INTERVAL * (n - 1))]
        mcu_owner.append(n)
    mcu_sizes = np.array(mcu_sizes)
    blocks = flat[order]
    comp = np.tile(np.array([0, 0, 0, 0, 1, 2]), len(coefs))
    scans = [
        _encode_dc(flat[:, 0], comp, mcu_sizes, 1),
        _encode_first(blocks, sizes, 1, 5, 1),
        _encode_first(blocks, sizes, 6, 63, 1),
        _encode_refine(blocks, sizes, 1, 63, 0),
        _pack(flat[:, 0].astype(np.int64) & 1, np.ones(len(flat), np.int64), mcu_sizes),
    ]
    tables = b"".join(_segment(0xC4, bytes((t,)) + body) for t, body in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE)))
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
    tail = _segment(0xDD, struct.pack(">H", INTERVAL)) + tables
    out, seg, mseg = [], 0, 0
    marks = [bytes((0xFF, 0xD0 + i)) for i in range(8)]

    def body(buf: bytes, off, a: int, n: int) -> bytes:
        parts = []
        for i in range(n):
            if i:
                parts.append(marks[(i - 1) % 8])
            parts.append(buf[off[a + i] : off[a + i + 1]].replace(b"\xff", b"\xff\0"))
        return b"".join(parts)

    offs = [o.tolist() for _, o in scans]
    for i, (r, c) in enumerate(zip(rows, cols)):
        parts = [head, _segment(0xC2, struct.pack(">BHHB", 8, 16 * r, 16 * c, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))), tail]
        for (kind, ids, ss, se, ah, al), (buf, _), off in zip(_SCRIPT, scans, offs):
            if kind.startswith("dc"):
                parts += [_segment(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, ss, se, ah << 4 | al))), body(buf, off, mseg, mcu_owner[i])]
            else:
                a = seg
                for k, ident in enumerate(ids):
                    n = owner[3 * i + k]
                    parts += [_segment(0xDA, bytes((1, ident, 1 if kind == "refine" else 0, ss, se, ah << 4 | al))), body(buf, off, a, n)]
                    a += n
        seg += sum(owner[3 * i : 3 * i + 3])
        mseg += mcu_owner[i]
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


# -- decoder -------------------------------------------------------------------------------


class Frame:
    """Parsed headers of one file: components, geometry and scans."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        quant, huff, interval, at = {}, {}, 0, 2
        self.scans: list[tuple] = []
        self.comps: list[tuple[int, int, int, int]] = []
        level: dict[int, int] = {}
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("no marker")
            m = data[at + 1]
            if m == 0xD9:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if m == 0xDB:
                i = 0
                while i < len(body):
                    wide, t = body[i] >> 4, body[i] & 15
                    raw = body[i + 1 : i + 1 + 64 * (1 + wide)]
                    quant[t] = np.frombuffer(raw, ">u2" if wide else np.uint8).astype(np.int64)
                    i += 1 + 64 * (1 + wide)
            elif m == 0xC4:
                i = 0
                while i < len(body):
                    k = 17 + sum(body[i + 1 : i + 17])
                    huff[body[i]] = body[i + 1 : i + k]
                    i += k
            elif m == 0xC2:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or n not in (1, 3):
                    raise ValueError("8-bit samples in one or three components only")
                self.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if n == 1:
                    self.comps = [(self.comps[0][0], 1, 1, self.comps[0][3])]
                self.hmax, self.vmax = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
                self.mcux, self.mcuy = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                self.at = np.concatenate(([0], np.cumsum([h * v for _, h, v, _ in self.comps]))).tolist()
                self.blocks = self.mcux * self.mcuy * self.at[-1]
            elif m in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman file")
            elif m == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif m == 0xDA:
                ids = [c[0] for c in self.comps]
                comps = tuple(ids.index(body[1 + 2 * i]) for i in range(body[0]))
                sel = [body[2 + 2 * i] for i in range(body[0])]
                ss, se, a = body[1 + 2 * body[0] :][:3]
                found = _END.search(data, at)
                end = found.start() if found else len(data)
                parts = [p.replace(b"\xff\0", b"\xff") for p in _RESTART.split(data[at:end])]
                at = end
                tables = tuple(huff[s >> 4] if ss == 0 else huff[0x10 | s & 15] for s in sel) if ss or not a >> 4 else ()
                k = 1 + max((level.get(c, -1) for c in comps))
                level |= dict.fromkeys(comps, k)
                shape = tuple((self.comps[c][1], self.comps[c][2]) for c in comps) if ss == 0 else ()
                self.scans.append(((k, ss, se, a >> 4, a & 15, tables, shape, len(comps) > 1), comps, interval, parts))
        self.quant = [quant[t] for *_, t in self.comps]

    def order(self, comps: tuple[int, ...], first: int):
        """Global block ids in scan order, and blocks per MCU of the scan."""
        if len(comps) == 1:
            c = comps[0]
            _, h, v, _ = self.comps[c]
            bw = -(-(-(-self.width * h // self.hmax)) // 8)
            bh = -(-(-(-self.height * v // self.vmax)) // 8)
            return first + raster_order(self.mcux, self.at[-1], self.at[c], h, v, bw, bh), 1
        cols = np.concatenate([np.arange(self.at[c], self.at[c + 1]) for c in comps])
        return (first + np.arange(self.mcux * self.mcuy)[:, None] * self.at[-1] + cols).ravel(), len(cols)


def _words(parts: list[bytes]):
    """All segments in one array of 32-bit windows, one per byte; first bit of each."""
    sizes = np.array([len(p) + 8 for p in parts])
    d = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts) + b"\0" * 8, np.uint8).astype(np.int64)
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:], (np.cumsum(sizes) - sizes) * 8


def _decode_first(win, pos, base, count, order, coef, ss, se, al, look):
    k, b, end = np.full(len(pos), ss), base.copy(), base + count
    flat = coef.reshape(-1)
    while len(pos):
        e = look[(win[pos >> 3] >> (16 - (pos & 7))) & 0xFFFF]
        if not e.all():
            raise ValueError("broken code")
        pos = pos + (e >> 8)
        r, s = (e >> 4) & 15, e & 15
        has = s > 0
        n = np.where(has, s, np.where(r < 15, r, 0))
        bits = (win[pos >> 3] >> (32 - (pos & 7) - n)) & ((1 << n) - 1)
        pos += n
        if has.all():
            k += r
            flat[order[b] * 64 + k] = np.where(bits >> (s - 1), bits, bits - (1 << s) + 1) << al
            k += 1
        else:
            i = np.flatnonzero(has)
            k2, s2, b2 = k[i] + r[i], s[i], bits[i]
            flat[order[b[i]] * 64 + k2] = np.where(b2 >> (s2 - 1), b2, b2 - (1 << s2) + 1) << al
            eob = ~has & (r < 15)
            k = np.where(eob, se + 1, k + 16)
            k[i] = k2 + 1
            b += np.where(eob, bits + (1 << r) - 1, 0)
        over = k > se
        b += over
        k[over] = ss
        if (b >= end).any():
            live = b < end
            pos, k, b, end = pos[live], k[live], b[live], end[live]


def _decode_refine(win, pos, base, count, order, coef, ss, se, al, look):
    k, b, end = np.full(len(pos), ss), base.copy(), base + count
    eobs = np.zeros(len(pos), np.int64)
    col = np.arange(ss, se + 1)
    while len(pos):
        want = eobs == 0
        e = np.where(want, look[(win[pos >> 3] >> (16 - (pos & 7))) & 0xFFFF], 0)
        if not (e[want] > 0).all():
            raise ValueError("broken code")
        pos = pos + (e >> 8)
        r, s = (e >> 4) & 15, e & 15
        n = np.where(want, np.where(s > 0, 1, np.where(r < 15, r, 0)), 0)
        bits = (win[pos >> 3] >> (32 - (pos & 7) - n)) & ((1 << n) - 1)
        pos += n
        eobs += np.where(want & (s == 0) & (r < 15), (1 << r) + bits, 0)
        at_eob = eobs > 0
        row = order[b]
        h = coef[row, ss : se + 1].astype(np.int64)
        mask = col >= k[:, None]
        zero = (h == 0) & mask
        stop = np.full(len(pos), se + 1)
        if not at_eob.all():
            reach = (np.cumsum(zero, 1) == (r + 1)[:, None]) & zero & ~at_eob[:, None]
            stop = np.where(reach.any(1), ss + reach.argmax(1), stop)
        fix = (h != 0) & mask & (col < stop[:, None])
        nth = np.cumsum(fix, 1)
        p = pos[:, None] + nth - 1
        got = ((win[p >> 3] >> (31 - (p & 7))) & 1).astype(bool) & fix
        pos = pos + nth[:, -1]
        h += np.where(got, np.where(h > 0, 1 << al, -(1 << al)), 0)
        put = np.flatnonzero((s == 1) & want & (stop <= se))
        h[put, stop[put] - ss] = np.where(bits[put] > 0, 1 << al, -(1 << al))
        coef[row, ss : se + 1] = h
        over = at_eob | (stop >= se)
        eobs -= at_eob
        k = np.where(over, ss, stop + 1)
        b += over
        if (b >= end).any():
            live = b < end
            pos, k, b, end, eobs = pos[live], k[live], b[live], end[live], eobs[live]


def _decode_dc(win, pos, base, count, order, coef, al, looks, comp_of):
    pred = np.zeros((max(comp_of) + 1, len(pos)), np.int64)
    for t in range(int(count.max(initial=0))):
        i = np.flatnonzero(count > t)
        c = comp_of[t % len(comp_of)]
        p = pos[i]
        e = looks[c][(win[p >> 3] >> (16 - (p & 7))) & 0xFFFF]
        if not e.all():
            raise ValueError("broken code")
        p = p + (e >> 8)
        s = e & 255
        bits = (win[p >> 3] >> (32 - (p & 7) - s)) & ((1 << s) - 1)
        pos[i] = p + s
        pred[c, i] += np.where(s > 0, np.where(bits >> np.maximum(s - 1, 0), bits, bits - (1 << s) + 1), 0)
        coef[order[base[i] + t], 0] = pred[c, i] << al


def decode_coefficients(files: list[bytes]):
    """(frames, first block of each, quantised coefficients (blocks, 64) in zigzag and MCU order)."""
    frames = [Frame(f) for f in files]
    first = np.concatenate(([0], np.cumsum([f.blocks for f in frames]))).astype(np.int64)
    coef = np.zeros((int(first[-1]), 64), np.int16)
    groups: dict[tuple, list] = {}
    for i, f in enumerate(frames):
        for key, comps, interval, parts in f.scans:
            groups.setdefault(key, []).append((i, comps, interval, parts))
    for key in sorted(groups, key=lambda x: x[0]):
        _, ss, se, ah, al, tables, shape, _ = key
        orders, bases, counts, segs, done = [], [], [], [], 0
        for i, comps, interval, parts in groups[key]:
            o, per = frames[i].order(comps, int(first[i]))
            step = interval * per if interval else len(o)
            n = -(-len(o) // step)
            if len(parts) < n:
                raise ValueError("segments are missing")
            orders.append(o)
            bases += range(done, done + len(o), step)
            counts += [step] * (n - 1) + [len(o) - step * (n - 1)]
            segs += parts[:n]
            done += len(o)
        order, base, count = np.concatenate(orders), np.array(bases), np.array(counts)
        win, pos = _words(segs)
        if ss == 0 and ah == 0:
            per_comp = [c for c, (h, v) in enumerate(shape) for _ in range(h * v if len(shape) > 1 else 1)]
            _decode_dc(win, pos, base, count, order, coef, al, [_codes(t)[2] for t in tables], per_comp)
        elif ss == 0:
            p = np.repeat(pos - base, count) + np.arange(len(order))
            coef[order, 0] |= (((win[p >> 3] >> (31 - (p & 7))) & 1) << al).astype(np.int16)
        elif ah == 0:
            _decode_first(win, pos, base, count, order, coef, ss, se, al, _codes(tables[0])[2])
        else:
            _decode_refine(win, pos, base, count, order, coef, ss, se, al, _codes(tables[0])[2])
    return frames, first, coef


@lru_cache(1)
def _idct_matrix():
    """Natural-order coefficients to samples, times 2^13, rounded to whole numbers."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    return np.round(np.einsum("xu,yv->uvxy", c, c).reshape(64, 64) * (1 << 13))[ZIGZAG]


def samples(coef, quant):
    """Samples (blocks, 64) of coefficients in zigzag order; exact in doubles."""
    acc = (coef * quant).astype(np.float64) @ _idct_matrix()
    return np.clip(np.floor((acc + (1 << 12)) / (1 << 13)).astype(np.int32) + 128, 0, 255)


def to_rgb(y, cb, cr):
    """Whole-number YCbCr (JFIF) to RGB, last axis."""
    cb, cr = cb - 128, cr - 128
    r = y + ((91881 * cr + 32768) >> 16)
    g = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
    b = y + ((116130 * cb + 32768) >> 16)
    return np.clip(np.stack((r, g, b), -1), 0, 255).astype(np.uint8)


def tensors(frames: list[Frame], first, coef) -> list:
    """(height, width, 3) uint8 per file, chroma upsampled by repetition. Files of one
    layout with halved chroma are transformed together, others one by one."""
    layout = {(tuple(c[1:3] for c in f.comps), *(q.tobytes() for q in f.quant)) for f in frames}
    if len(layout) == 1 and next(iter(layout))[0] == ((2, 2), (1, 1), (1, 1)):
        per, quant = coef.reshape(-1, 6, 64), frames[0].quant
        tiles = np.empty((len(per), 16, 16, 3), np.uint8)
        for a in range(0, len(per), 2048):
            part = per[a : a + 2048].astype(np.int64)
            n = len(part)
            y = samples(part[:, :4].reshape(-1, 64), quant[0]).reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 16, 16)
            cb, cr = (np.repeat(np.repeat(samples(part[:, k], quant[k - 3]).reshape(n, 8, 8), 2, 1), 2, 2) for k in (4, 5))
            tiles[a : a + n] = to_rgb(y, cb, cr)
        out, at = [], 0
        for f in frames:
            n = f.mcux * f.mcuy
            t = tiles[at : at + n].reshape(f.mcuy, f.mcux, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * f.mcuy, 16 * f.mcux, 3)
            out.append(t[: f.height, : f.width])
            at += n
        return out
    out = []
    for i, f in enumerate(frames):
        mine = coef[first[i] : first[i + 1]].astype(np.int64).reshape(f.mcuy, f.mcux, f.at[-1], 64)
        planes = []
        for c, (_, h, v, _) in enumerate(f.comps):
            s = samples(mine[:, :, f.at[c] : f.at[c + 1]].reshape(-1, 64), f.quant[c]).reshape(f.mcuy, f.mcux, v, h, 8, 8)
            p = s.transpose(0, 2, 4, 1, 3, 5).reshape(f.mcuy * v * 8, f.mcux * h * 8)
            p = np.repeat(np.repeat(p, f.vmax // v, 0), f.hmax // h, 1)
            planes.append(p[: f.height, : f.width])
        if len(planes) == 1:
            planes += [np.full_like(planes[0], 128)] * 2
        out.append(to_rgb(*planes))
    return out


def rgb_tensors(files: list[bytes]) -> list:
    return tensors(*decode_coefficients(files))
