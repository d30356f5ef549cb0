import hashlib
import random
import zlib

import numpy as np
import pytest

from sparkvane.llm import jpeg as J
from sparkvane.llm import media as m


def plain_decode(data):
    """A bit-by-bit decoder of one file, after the standard's flow charts."""
    f = J.Frame(data)
    coef = np.zeros((f.blocks, 64), np.int64)
    for (_, ss, se, ah, al, tables, shape, _), comps, interval, parts in f.scans:
        order, per = f.order(comps, 0)
        owner = [c for c in range(len(comps)) for _ in range(f.comps[comps[c]][1] * f.comps[comps[c]][2] if len(comps) > 1 else 1)]
        step = interval * per if interval else len(order)
        for n, part in enumerate(parts):
            bits = "".join(f"{x:08b}" for x in part) + "1" * 64
            at = 0

            def take(k):
                nonlocal at
                at += k
                return int(bits[at - k : at], 2) if k else 0

            def symbol(t):
                code, i = 0, 16
                for length in range(1, 17):
                    code = code << 1 | take(1)
                    first = getattr(symbol, "firsts")[t][length - 1]
                    if code - first < t[length - 1]:
                        return t[i + code - first]
                    i += t[length - 1]
                raise AssertionError

            symbol.firsts = {}
            for t in tables:
                c, out = 0, []
                for length in range(16):
                    out.append(c)
                    c = (c + t[length]) << 1
                symbol.firsts[t] = out
            ext = lambda v, s: v if s == 0 or v >> (s - 1) else v - (1 << s) + 1
            pred, eob = [0] * len(comps), 0
            for i, b in enumerate(order[n * step : (n + 1) * step]):
                x = coef[b]
                if ss == 0:
                    c = owner[i % len(owner)]
                    if ah:
                        x[0] |= take(1) << al
                    else:
                        s = symbol(tables[c])
                        pred[c] += ext(take(s), s)
                        x[0] = pred[c] * (1 << al)
                    continue
                k = ss
                if not ah:
                    if eob:
                        eob -= 1
                        continue
                    while k <= se:
                        r, s = divmod(symbol(tables[0]), 16)
                        if s:
                            k += r
                            x[k] = ext(take(s), s) * (1 << al)
                            k += 1
                        elif r == 15:
                            k += 16
                        else:
                            eob = (1 << r) + take(r) - 1
                            break
                    continue
                fix = lambda k: x.__setitem__(k, x[k] + (take(1) << al) * (1 if x[k] > 0 else -1))
                while k <= se and not eob:
                    r, s = divmod(symbol(tables[0]), 16)
                    new = 0
                    if s:
                        new = (1 if take(1) else -1) * (1 << al)
                    elif r < 15:
                        eob = (1 << r) + take(r)
                        break
                    while k <= se:
                        if x[k]:
                            fix(k)
                        elif r == 0:
                            if new:
                                x[k] = new
                            k += 1
                            break
                        else:
                            r -= 1
                        k += 1
                if eob:
                    while k <= se:
                        if x[k]:
                            fix(k)
                        k += 1
                    eob -= 1
    return coef


@pytest.mark.parametrize("kind", range(5))
def test_round_trip_and_plain_decoder(kind):
    rng = np.random.default_rng(kind)
    mcus = rng.integers(1, 12, 3).tolist() + ([4097] if kind == 4 else [])
    c = rng.integers(-128, 128, (sum(mcus), 6, 64)).astype(np.int16)
    if kind == 1:
        c[rng.random(c.shape) < 0.95] = 0
    if kind == 2:
        c = rng.integers(-1, 2, c.shape).astype(np.int16)
    if kind == 3:
        c = rng.integers(-1000, 1001, c.shape).astype(np.int16)
        c[rng.random(c.shape) < 0.3] = 0
        c[:, :, 0] //= 4
    files = J.encode_blocks(c, mcus)
    _, first, coef = J.decode_coefficients(files)
    at = 0
    for i, n in enumerate(mcus):
        got = coef[first[i] : first[i] + 6 * n]
        assert np.array_equal(got, c[at : at + n].reshape(-1, 64))
        if n < 100:
            assert np.array_equal(plain_decode(files[i]), got)
        at += n


def test_eob_runs_and_no_restarts():
    """What the writer here never writes: runs of ended blocks, one segment a scan."""
    ac = J._table({1: [0x01], 2: [0x10], 3: [0x20, 0x00], 8: [0xF0, 0x21]})
    bits = "0" + "1" + "111" * 0 + "10" + "0" + "0" + "0"  # coefficient 1 in block 0, end of 2 blocks; block 2: -1 ...
    bits += "101"
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    dc = J._table({1: [0]})
    seg = J._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, bytes((8, 0, 8, 0, 24, 1, 1, 0x11, 0))) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac)
    data = head + seg(0xDA, bytes((1, 1, 0, 0, 0, 0))) + b"\x1f" + seg(0xDA, bytes((1, 1, 0, 1, 63, 0))) + body + b"\xff\xd9"
    got = J.decode_coefficients([data])[2]
    assert np.array_equal(got, plain_decode(data)) and got[0, 1] == 1 and not got[1].any() and got[2, 1] == -1


def test_tensor_is_the_inverse_transform():
    rng = np.random.default_rng(7)
    c = rng.integers(-20, 21, (6, 6, 64)).astype(np.int16)
    (t,) = J.rgb_tensors(J.encode_blocks(c, [6]))
    assert t.shape == (16, 96, 3)
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1) / 2
    for mcu in range(6):
        def plane(k):
            q = np.zeros(64)
            q[J.ZIGZAG] = c[mcu, k]
            return np.clip(np.round(basis @ q.reshape(8, 8) @ basis.T) + 128, 0, 255)
        y = np.block([[plane(0), plane(1)], [plane(2), plane(3)]])
        cb, cr = (np.kron(plane(k), np.ones((2, 2))) - 128 for k in (4, 5))
        want = np.clip(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), -1), 0, 255)
        assert np.abs(t[:, 16 * mcu : 16 * mcu + 16].astype(float) - want).max() <= 3


def test_digest(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc é\x80\x81\x7f€") for _ in range(rng.randint(0, 3000)))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "x" * 576), (103, "y" * 1_700_000), (104, rows[3][1]), (104, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as feature")
    got = m.media_digest(df.repartition(3)).collect()
    text = {i: t or "" for i, t in rows}
    for r in got:
        b = text[r.doc_id].encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    by = {r.doc_id: r for r in got}
    assert by[104].feature == by[3].feature and by[104].media_sha256 == by[3].media_sha256 and by[100].feature == by[101].feature
    stored = m.store_texts(df).collect()
    assert all(len(r.media) == by[r.doc_id].media_bytes for r in stored)
    media = m.store_texts(df.limit(3)).select("doc_id", "media").unionAll(spark.createDataFrame([(900, bytearray(b"no")), (901, None)], "doc_id long, media binary"))
    for r in m.decode_tensors(media).collect():
        assert (r.rgb is None) == (r.doc_id >= 900)
        assert r.rgb is None or len(r.rgb) == r.height * r.width * 3
    assert m.media_digest(df.limit(0)).count() == 0


def test_layouts_together_and_one_by_one():
    """The joint transform of halved-chroma files is the general one."""
    rng = np.random.default_rng(9)
    mcus = [1, 7, 4100]
    c = rng.integers(-128, 128, (sum(mcus), 6, 64)).astype(np.int16)
    files = J.encode_blocks(c, mcus)
    frames, first, coef = J.decode_coefficients(files)
    for i, (f, t) in enumerate(zip(files, J.tensors(frames, first, coef))):
        f0 = frames[i]
        mine = coef[first[i] : first[i + 1]].astype(np.int64).reshape(f0.mcuy, f0.mcux, 6, 64)
        y = J.samples(mine[:, :, :4].reshape(-1, 64), f0.quant[0]).reshape(f0.mcuy, f0.mcux, 2, 2, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(f0.mcuy * 16, -1)
        cb, cr = (np.kron(J.samples(mine[:, :, k].reshape(-1, 64), f0.quant[k - 3]).reshape(f0.mcuy, f0.mcux, 8, 8).transpose(0, 2, 1, 3).reshape(f0.mcuy * 8, -1), np.ones((2, 2), int)) for k in (4, 5))
        assert np.array_equal(t, J.to_rgb(y, cb, cr))
        assert m.feature(t).startswith(f"{t.shape[1]}x{t.shape[0]}:")
    assert [x is None for x in m.decode([files[0], b"no", files[1]])] == [False, True, False]


def test_feature_is_of_the_stored_tensor(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "y" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in m.media_digest(df).collect()}
    for r in m.decode_tensors(m.store_texts(df)).collect():
        t = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert got[r.doc_id].feature == f"{r.width}x{r.height}:" + ",".join(f"{x:.4f}" for x in (*t.mean((0, 1)), *t.std((0, 1))))
