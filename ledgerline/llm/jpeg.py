"""Luma of sequential Huffman-coded JPEG frames (baseline and extended, 8 bits), as Motion-JPEG files hold them.

Defined cases: frames without Huffman tables use the standard ones; restart intervals are read; colour components
are decoded only as far as the bits have to be passed over; what isn't such a frame, or is damaged, raises ValueError.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

_rows = lambda *firsts: [16 * a + b for a in firsts for b in range(2, 11)]
# The standard's typical Huffman tables: code counts for lengths 1 to 16, then symbols (K.3 to K.6).
_DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
_DC_COLOUR = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
_AC = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    [
        *bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"), 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A,
        *range(0x34, 0x3B), *range(0x43, 0x4B), *range(0x53, 0x5B), *range(0x63, 0x6B), *range(0x73, 0x7B), *range(0x83, 0x8B), *_rows(9, 10, 11, 12, 13), *range(0xE1, 0xEB), *range(0xF1, 0xFB),
    ],
)
_AC_COLOUR = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    [
        *bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1".replace(" ", "")), 0x17, 0x18, 0x19, 0x1A, *range(0x26, 0x2B),
        *range(0x35, 0x3B), *range(0x43, 0x4B), *range(0x53, 0x5B), *range(0x63, 0x6B), *range(0x73, 0x7B), *_rows(8, 9, 10, 11, 12, 13, 14, 15),
    ],
)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Place in an 8 x 8 block of each coefficient in coded order: diagonals, in turn up and down."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


_ZIGZAG = _zigzag()
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """For 16 bits that begin with a code: the code's length and symbol."""
    out: list[tuple[int, int] | None] = [None] * (1 << 16)
    code = k = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if k >= len(symbols) or code >> length:
                raise ValueError("bad Huffman table")
            first = code << 16 - length
            out[first : first + (1 << 16 - length)] = [(length, symbols[k])] * (1 << 16 - length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


_STANDARD = {(kind, k): (bytes(c), bytes(s)) for (kind, k), (c, s) in {(0, 0): _DC, (0, 1): _DC_COLOUR, (1, 0): _AC, (1, 1): _AC_COLOUR}.items()}


def _block(bits: int, at: int, dc, ac, out: list[int] | None) -> tuple[int, int]:
    """Read one block that begins ``at`` bits before the end of ``bits``; returns what follows and the DC difference."""
    k, diff = 0, 0
    while k < 64:
        found = (dc if k == 0 else ac)[bits >> at - 16 & 0xFFFF] if at >= 16 else None
        if found is None:
            raise ValueError("bad Huffman code")
        at -= found[0]
        run, size = found[1] >> 4, found[1] & 15
        if k:
            if not size and run != 15:
                break
            k += run
            if k > 63:
                raise ValueError("too many coefficients in a block")
        elif run:
            raise ValueError("bad DC category")
        if size:
            at -= size
            value = bits >> at & (1 << size) - 1
            if not value >> size - 1:
                value -= (1 << size) - 1
            if k == 0:
                diff = value
            elif out is not None:
                out[k] = value
        k += 1
    return at, diff


def luma(jpeg: bytes) -> np.ndarray:
    """The first component's samples, height by width."""
    try:
        return _luma(jpeg)
    except (struct.error, IndexError, KeyError, ZeroDivisionError) as e:
        raise ValueError(f"damaged JPEG frame: {e!r}") from e


def _luma(jpeg: bytes) -> np.ndarray:
    tables, quant, parts, restart, at = dict(_STANDARD), {}, [], 0, 2
    height = width = 0
    while True:
        while jpeg[at] == 0xFF and jpeg[at + 1] == 0xFF:
            at += 1
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one is due")
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 << (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.float64)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("only 8-bit frames of stated size are read")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError(f"JPEG process {mark:#x} is not read")
        elif mark == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif mark == 0xDA:
            break
    scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
    used = [p for p in parts if p[0] in scan]
    if not parts or not used or used[0] != parts[0]:
        raise ValueError("the first scan lacks the first component")
    h_most, v_most = max(p[1] for p in parts), max(p[2] for p in parts)
    first, h, v, q = parts[0]
    if (h, v) != (h_most, v_most):
        raise ValueError("the first component is sampled less than others")
    if len(used) == 1:
        across, down, layout = -(-width // 8), -(-height // 8), [(0, 1, 1, *scan[first])]
        h = v = 1
    else:
        across, down = -(-width // (8 * h)), -(-height // (8 * v))
        layout = [(k, p[1], p[2], *scan[p[0]]) for k, p in enumerate(used)]
    decoders = [(k, x * y, _lookup(*tables[0, d]), _lookup(*tables[1, a])) for k, x, y, d, a in layout]
    end = jpeg.rfind(b"\xff\xd9")
    coded = [s.replace(b"\xff\x00", b"\xff") for s in _RESTART.split(jpeg[at : end if end >= at else None])]
    total, blocks = across * down, []
    step = restart or total
    if len(coded) < -(-total // step):
        raise ValueError("the frame ends early")
    for k, start in enumerate(range(0, total, step)):
        bits, left = int.from_bytes(coded[k] + b"\xff\xff", "big"), len(coded[k]) * 8 + 16
        before = [0] * len(layout)
        # Bits are taken from pieces of the long integer, so that each step costs a piece and not the whole.
        for _ in range(min(step, total - start)):
            for j, n, dc, ac in decoders:
                for _ in range(n):
                    out = [0] * 64 if j == 0 else None
                    low = max(left - 4096, 0)
                    now, diff = _block(bits >> low & (1 << min(left, 4096)) - 1, left - low, dc, ac, out)
                    left = low + now
                    before[j] += diff
                    if out is not None:
                        out[0] = before[0]
                        blocks.append(out)
        if left < 16:
            raise ValueError("the frame ends early")
    coefficients = np.zeros((len(blocks), 64))
    coefficients[:, _ZIGZAG] = np.array(blocks) * quant[q]
    samples = np.einsum("ux,nuv,vy->nxy", _COS, coefficients.reshape(-1, 8, 8), _COS) + 128
    samples = np.clip(np.rint(samples), 0, 255).astype(np.uint8)
    plane = samples.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
    return plane[:height, :width]
