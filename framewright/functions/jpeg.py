"""Baseline JPEG with integer arithmetic throughout, so that equal pixels give equal bytes.

Blocks of a whole frame are transformed, quantised, reordered and coded together as int64 arrays.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed values of ITU-T T.81 Annex K: quantisers in raster order, code lengths and symbols.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_STEPS = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
) + (99,) * 32
DC_SYMBOLS = tuple(range(12))
DC_LENGTHS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
AC_LENGTHS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
AC_SYMBOLS = (
    (
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32,
        0x81, 0x91, 0xa1, 0x08, 0x23, 0x42, 0xb1, 0xc1, 0x15, 0x52, 0xd1, 0xf0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0a, 0x16,
        0x17, 0x18, 0x19, 0x1a, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2a, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3a, 0x43, 0x44, 0x45,
        0x46, 0x47, 0x48, 0x49, 0x4a, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5a, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69,
        0x6a, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7a, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8a, 0x92, 0x93, 0x94,
        0x95, 0x96, 0x97, 0x98, 0x99, 0x9a, 0xa2, 0xa3, 0xa4, 0xa5, 0xa6, 0xa7, 0xa8, 0xa9, 0xaa, 0xb2, 0xb3, 0xb4, 0xb5, 0xb6,
        0xb7, 0xb8, 0xb9, 0xba, 0xc2, 0xc3, 0xc4, 0xc5, 0xc6, 0xc7, 0xc8, 0xc9, 0xca, 0xd2, 0xd3, 0xd4, 0xd5, 0xd6, 0xd7, 0xd8,
        0xd9, 0xda, 0xe1, 0xe2, 0xe3, 0xe4, 0xe5, 0xe6, 0xe7, 0xe8, 0xe9, 0xea, 0xf1, 0xf2, 0xf3, 0xf4, 0xf5, 0xf6, 0xf7, 0xf8,
        0xf9, 0xfa,
    ),
    (
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81,
        0x08, 0x14, 0x42, 0x91, 0xa1, 0xb1, 0xc1, 0x09, 0x23, 0x33, 0x52, 0xf0, 0x15, 0x62, 0x72, 0xd1, 0x0a, 0x16, 0x24, 0x34,
        0xe1, 0x25, 0xf1, 0x17, 0x18, 0x19, 0x1a, 0x26, 0x27, 0x28, 0x29, 0x2a, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3a, 0x43, 0x44,
        0x45, 0x46, 0x47, 0x48, 0x49, 0x4a, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5a, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68,
        0x69, 0x6a, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7a, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8a, 0x92,
        0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9a, 0xa2, 0xa3, 0xa4, 0xa5, 0xa6, 0xa7, 0xa8, 0xa9, 0xaa, 0xb2, 0xb3, 0xb4,
        0xb5, 0xb6, 0xb7, 0xb8, 0xb9, 0xba, 0xc2, 0xc3, 0xc4, 0xc5, 0xc6, 0xc7, 0xc8, 0xc9, 0xca, 0xd2, 0xd3, 0xd4, 0xd5, 0xd6,
        0xd7, 0xd8, 0xd9, 0xda, 0xe2, 0xe3, 0xe4, 0xe5, 0xe6, 0xe7, 0xe8, 0xe9, 0xea, 0xf2, 0xf3, 0xf4, 0xf5, 0xf6, 0xf7, 0xf8,
        0xf9, 0xfa,
    ),
)
#: Scale of the cosines, and the scaled square root of a half.
COSINE_SCALE, ROOT_HALF = 65536, 46341

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
COSINES = np.rint(COSINE_SCALE * np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16)).astype(np.int64)
DIVISORS = np.full((8, 8), 4 * COSINE_SCALE * COSINE_SCALE, np.int64)
DIVISORS[0, :] = DIVISORS[:, 0] = 8 * ROOT_HALF * COSINE_SCALE
DIVISORS[0, 0] = 8 * COSINE_SCALE * COSINE_SCALE


def quality_scale(quality: int) -> int:
    """Per cent by which the standard steps are scaled; capped at 256 below quality 20."""
    if quality >= 100:
        return 2
    return min(256, 5000 // quality) if quality < 50 else 200 - 2 * quality


def steps(quality: int, chroma: bool) -> np.ndarray:
    return np.clip((np.array(CHROMA_STEPS if chroma else LUMA_STEPS, np.int64) * quality_scale(quality) + 50) // 100, 1, 255)


def toward_zero(x: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    return np.sign(x) * (np.abs(x) // by)


def half_away(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * ((np.abs(x) + (by >> 1)) // by)


def ycbcr(rgb: np.ndarray) -> np.ndarray:
    """(…, 3) uint8 planes of luma and chroma; weights are in 256ths, shifts floor."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    y = (77 * r + 150 * g + 29 * b + 128) >> 8
    cb = ((-43 * r - 85 * g + 128 * b + 128) >> 8) + 128
    cr = ((128 * r - 107 * g - 21 * b + 128) >> 8) + 128
    return np.clip(np.stack([y, cb, cr], -1), 0, 255).astype(np.uint8)


def halve(plane: np.ndarray) -> np.ndarray:
    """Means of 2x2 boxes, rounded half up; at odd edges of what is there."""
    h, w = plane.shape
    total = np.zeros(((h + 1) // 2, (w + 1) // 2), np.int64)
    count = np.zeros_like(total)
    for dy in (0, 1):
        for dx in (0, 1):
            part = plane[dy::2, dx::2]
            total[: part.shape[0], : part.shape[1]] += part
            count[: part.shape[0], : part.shape[1]] += 1
    return ((total + count // 2) // count).astype(np.uint8)


def blocks(plane: np.ndarray, rows: int, cols: int, pad: int) -> np.ndarray:
    """(rows, cols, 8, 8) blocks; what lies outside the plane is ``pad``."""
    out = np.full((rows * 8, cols * 8), pad, np.uint8)
    h, w = min(plane.shape[0], rows * 8), min(plane.shape[1], cols * 8)
    out[:h, :w] = plane[:h, :w]
    return out.reshape(rows, 8, cols, 8).swapaxes(1, 2)


def forward_dct(block: np.ndarray) -> np.ndarray:
    """Integer transform of (…, 8, 8) samples centred at zero, truncated toward zero."""
    x = block.astype(np.int64)
    return toward_zero(np.einsum("vy,...yx,ux->...vu", COSINES, x, COSINES, optimize=True), DIVISORS)


def coefficients(block: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of uint8 blocks in zigzag order."""
    q = half_away(forward_dct(block.astype(np.int64) - 128), table.reshape(8, 8))
    return q.reshape(*q.shape[:-2], 64)[..., ZIGZAG]


@cache
def codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length)."""
    out, code, it = {}, 0, iter(symbols)
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            out[next(it)] = (code, n)
            code += 1
        code <<= 1
    return out


def magnitudes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size categories, bits) of signed values; negative values as ones' complement."""
    size = np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)
    return size, np.where(values >= 0, values, values + (1 << size) - 1)


def deltas(levels: np.ndarray) -> np.ndarray:
    """Differences of one component's mean levels in scan order, the predictor moved on by what was written."""
    levels = np.clip(levels, -32768, 32767)
    out = np.diff(levels, prepend=0)
    if (np.abs(out) > 2047).any():
        at = 0
        for i, v in enumerate(levels.tolist()):
            out[i] = max(-2047, min(2047, v - at))
            at += int(out[i])
    return out


@cache
def code_tables(chroma: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and lengths by symbol: of differences, and of runs and sizes."""
    out = []
    for table in (codes(DC_LENGTHS[chroma], DC_SYMBOLS), codes(AC_LENGTHS[chroma], AC_SYMBOLS[chroma])):
        both = np.zeros((2, 256), np.int64)
        for symbol, (code, n) in table.items():
            both[:, symbol] = code, n
        out += [both[0], both[1]]
    return tuple(out)


def scan(zz: np.ndarray, component: np.ndarray) -> bytes:
    """Entropy-coded bytes of (blocks, 64) zigzag levels in scan order; component 0 is luma, others chroma.

    Every symbol with its bits is one number of known length; the numbers' bits are laid out at
    once, filled up with ones to whole bytes, and a zero byte is put after each byte of ones.
    """
    zz = zz.astype(np.int64)
    n = len(zz)
    chroma = component > 0
    dc = np.zeros(n, np.int64)
    for c in np.unique(component):
        dc[component == c] = deltas(zz[component == c, 0])
    tables = [code_tables(False), code_tables(True)]
    pick = lambda k, is_chroma, symbol: np.where(is_chroma, tables[1][k][symbol], tables[0][k][symbol])
    size, bits = magnitudes(dc)
    block, k = np.nonzero(zz[:, 1:])
    k += 1
    new = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
    run = k - 1 - np.where(new, 0, np.r_[0, k[:-1]])
    a_size, a_bits = magnitudes(np.clip(zz[block, k], -1023, 1023))
    symbol = (run % 16) << 4 | a_size
    long = np.repeat(np.arange(len(block)), run // 16)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, k)
    ends = np.flatnonzero(last < 63)
    place = [np.arange(n) * 256, block[long] * 256 + 2 * k[long] - 1, block * 256 + 2 * k, ends * 256 + 255]
    value = [pick(0, chroma, size) << size | bits, pick(2, chroma[block[long]], 0xF0), pick(2, chroma[block], symbol) << a_size | a_bits, pick(2, chroma[ends], 0)]
    length = [pick(1, chroma, size) + size, pick(3, chroma[block[long]], 0xF0), pick(3, chroma[block], symbol) + a_size, pick(3, chroma[ends], 0)]
    order = np.argsort(np.concatenate(place), kind="stable")
    value, length = np.concatenate(value)[order], np.concatenate(length)[order]
    stop = np.cumsum(length)
    total = int(stop[-1]) if n else 0
    shift = np.repeat(stop, length) - 1 - np.arange(total)
    laid = np.ones(-(-total // 8) * 8, np.uint8)
    laid[:total] = np.repeat(value, length) >> shift & 1
    data = np.packbits(laid)
    return np.insert(data, np.flatnonzero(data == 0xFF) + 1, 0).tobytes()


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(rgb: np.ndarray, quality: int = 75, subsampled: bool = True) -> bytes:
    """A JPEG file of (height, width, 3) uint8 pixels, 4:2:0 or 4:4:4."""
    h, w = rgb.shape[:2]
    tables = [steps(quality, c) for c in (False, True)]
    head = [b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    head += [segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].astype(np.uint8))) for k, t in enumerate(tables)]
    sampling = 0x22 if subsampled else 0x11
    head.append(segment(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, sampling, 0, 2, 0x11, 1, 3, 0x11, 1])))
    for kind, lengths, symbols in ((0x00, DC_LENGTHS, (DC_SYMBOLS,) * 2), (0x10, AC_LENGTHS, AC_SYMBOLS)):
        head.append(segment(0xC4, b"".join(bytes([kind | k]) + bytes(lengths[k]) + bytes(symbols[k]) for k in (0, 1))))
    head.append(segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])))
    planes = ycbcr(rgb)
    unit = 16 if subsampled else 8
    rows, cols = -(-h // unit), -(-w // unit)
    k = unit // 8
    luma = coefficients(blocks(planes[..., 0], rows * k, cols * k, 0), tables[0])
    chroma = [coefficients(blocks(halve(planes[..., c]) if subsampled else planes[..., c], rows, cols, 128), tables[1]) for c in (1, 2)]
    # units of k by k luma blocks, then one block of each chroma plane
    units = luma.reshape(rows, k, cols, k, 64).swapaxes(1, 2).reshape(rows * cols, k * k, 64)
    units = np.concatenate([units, *(c.reshape(rows * cols, 1, 64) for c in chroma)], axis=1)
    component = np.tile(np.r_[np.zeros(k * k, np.int64), 1, 2], rows * cols)
    return b"".join(head) + scan(units.reshape(-1, 64), component) + b"\xff\xd9"
