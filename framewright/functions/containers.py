"""Container files: ISO base media and RIFF AVI writers, box readers, layouts, and faults.

A file is built from nested parts whose lengths are known, so offsets are sums over frame sizes and
nothing is patched afterwards.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from itertools import accumulate

from framewright.functions.exact import binary32


class ContainerError(ValueError):
    """A size does not fit its field, or frames are missing."""


def u32(n: int) -> bytes:
    if not 0 <= n < 2**32:
        raise ContainerError(f"{n} does not fit 32 bits")
    return n.to_bytes(4, "big")


def box(tag: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return u32(len(body) + 8) + tag + body


FULL = bytes(4)  # version and flags
ONE_16, ONE_30 = 1 << 16, 1 << 30


def fits_classic(width: int, height: int, frames: int) -> bool:
    """Whether raw frames, each with its headers, stay within 32-bit sizes."""
    return frames * (width * height * 3 + 16) <= 2**32 - 1


def track_matrix(turn: str, width: int, height: int) -> bytes:
    """The nine fixed-point numbers of a quarter turn: 16.16, the last column 2.30."""
    a, b, c, d, x, y = {
        "identity": (1, 0, 0, 1, 0, 0),
        "rot90": (0, 1, -1, 0, height, 0),
        "rot180": (-1, 0, 0, -1, width, height),
        "rot270": (0, -1, 1, 0, 0, width),
    }[turn]
    if max(x, y) >= 2**15:
        raise ContainerError("translation does not fit 16.16")
    return struct.pack(">9i", a * ONE_16, b * ONE_16, 0, c * ONE_16, d * ONE_16, 0, x * ONE_16, y * ONE_16, ONE_30)


def capture_boxes(rate: Fraction, carrier: str) -> bytes:
    """The rate at which frames were taken, as an exact fraction or as QuickTime metadata."""
    if carrier == "cfps":
        return box(b"udta", box(b"cfps", FULL, u32(rate.numerator), u32(rate.denominator)))
    name = b"com.apple.quicktime.capture.fps"
    return box(
        b"meta", FULL,
        box(b"hdlr", FULL, u32(0), b"mdta", bytes(13)),
        box(b"keys", FULL, u32(1), u32(len(name) + 8), b"mdta", name),
        box(b"ilst", box(u32(1), box(b"data", u32(23), u32(0), u32(binary32(rate.numerator, rate.denominator))))),
    )


def iso_head(sizes: list[int], width: int, height: int, jpeg: bool, rate: Fraction, turn: str = "identity", capture: tuple[Fraction, str] | None = None) -> bytes:
    """Everything before the first frame's bytes: a function of the frames' sizes alone."""
    if not sizes:
        raise ContainerError("no frames")
    n = len(sizes)
    duration = u32(n * rate.denominator)
    scale = u32(rate.numerator)
    size = struct.pack(">HH", width, height)
    unit = struct.pack(">9i", ONE_16, 0, 0, 0, ONE_16, 0, 0, 0, ONE_30)
    entry = box(b"mjpg" if jpeg else b"raw ", bytes(6), b"\0\1", bytes(16), size, u32(0x480000) * 2, u32(0), b"\0\1", bytes(32), b"\0\x18\xff\xff")

    def moov(offset: int) -> bytes:
        offsets = b"".join(u32(x) for x in accumulate([offset, *sizes[:-1]]))
        table = box(
            b"stbl", box(b"stsd", FULL, u32(1), entry), box(b"stts", FULL, u32(1), u32(n), u32(rate.denominator)), box(b"stsc", FULL, u32(1) * 4),
            box(b"stsz", FULL, u32(0), u32(n), b"".join(map(u32, sizes))), box(b"stco", FULL, u32(n), offsets),
        )
        data = box(b"dinf", box(b"dref", FULL, u32(1), box(b"url ", b"\0\0\0\1")))
        media = box(b"mdia", box(b"mdhd", FULL, bytes(8), scale, duration, b"\x55\xc4\0\0"), box(b"hdlr", FULL, u32(0), b"vide", bytes(12), b"VideoHandler"), box(b"minf", box(b"vmhd", FULL, b"\0\0" + b"\xff" * 6), data, table))
        head = box(b"tkhd", b"\0\0\0\x0f", bytes(8), u32(1), u32(0), duration, bytes(12), b"\1\0\0\0", track_matrix(turn, width, height), struct.pack(">HHHH", width, 0, height, 0))
        movie = box(b"mvhd", FULL, bytes(8), scale, duration, u32(ONE_16), b"\1\0", bytes(10), unit, bytes(24), u32(2))
        return box(b"moov", movie, box(b"trak", head, media), capture_boxes(*capture) if capture else b"")

    kind = box(b"ftyp", b"isom", u32(512), b"isom")
    # offsets have a fixed width, so the length does not depend on them
    start = len(kind) + len(moov(0)) + 8
    return kind + moov(start) + u32(sum(sizes) + 8) + b"mdat"


def iso_file(frames: list[bytes], **how) -> bytes:
    return iso_head([len(f) for f in frames], **how) + b"".join(frames)


def le(n: int) -> bytes:
    if not 0 <= n < 2**32:
        raise ContainerError(f"{n} does not fit 32 bits")
    return n.to_bytes(4, "little")


def chunk(tag: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return tag + le(len(body)) + body


def avi_file(frames: list[bytes], width: int, height: int, jpeg: bool, rate: Fraction) -> bytes:
    """A RIFF AVI with an index; frames are top-down, padded to even lengths."""
    if not frames:
        raise ContainerError("no frames")
    if not jpeg and any(len(f) != width * height * 3 for f in frames):
        raise ContainerError("a raw frame has the wrong size")
    tag = b"00dc" if jpeg else b"00db"
    n = le(len(frames))
    head = chunk(b"avih", le(rate.denominator * 1_000_000 // rate.numerator), bytes(8), le(16), n, bytes(4), le(1), bytes(4), le(width), le(height), bytes(16))
    stream = chunk(b"strh", b"vids", b"MJPG" if jpeg else b"DIB ", bytes(12), le(rate.denominator), le(rate.numerator), bytes(4), n, bytes(4), b"\xff" * 4, bytes(12))
    form = chunk(b"strf", le(40), le(width), le(2**32 - height), b"\1\0\x18\0", b"MJPG" if jpeg else bytes(4), bytes(20))
    bodies = [tag + le(len(f)) + f + bytes(len(f) % 2) for f in frames]
    starts = accumulate([4, *map(len, bodies[:-1])])
    index = b"".join(tag + le(16) + le(at) + le(len(f)) for at, f in zip(starts, frames, strict=True))
    return chunk(b"RIFF", b"AVI ", chunk(b"LIST", b"hdrl", head, chunk(b"LIST", b"strl", stream, form)), chunk(b"LIST", b"movi", *bodies), chunk(b"idx1", index))


@dataclass(frozen=True)
class Box:
    """A box or chunk: where it starts, where its payload does, and where it ends (without padding)."""

    path: tuple[str, ...]
    occurrence: int
    start: int
    payload: int
    end: int
    padded: int


#: Boxes whose payload is a sequence of boxes and nothing else.
ISO_PARENTS = frozenset("moov trak mdia minf dinf edts stbl".split())


class FaultError(ValueError):
    """A fault cannot be put into this file."""


def detect(data: bytes) -> str:
    """"iso", "avi" or "neither", by the first bytes."""
    if len(data) >= 8 and 8 <= int.from_bytes(data[:4], "big") <= len(data):
        return "iso"
    return "avi" if data[:4] == b"RIFF" and data[8:12] == b"AVI " else "neither"


class Parsed(bytes):
    """A file whose boxes and regions are read once, however many faults are put into it."""

    @cached_property
    def boxes(self) -> list[Box]:
        return _read_boxes(self)

    @cached_property
    def regions(self) -> list[Region]:
        return _layout(self)


def read_boxes(data: bytes) -> list[Box]:
    """All boxes, parents before children, in file order; a LIST goes by its list type."""
    return data.boxes if isinstance(data, Parsed) else _read_boxes(data)


def _read_boxes(data: bytes) -> list[Box]:
    kind = detect(data)
    if kind == "neither":
        raise FaultError("neither format")
    out: list[Box] = []

    def walk(at: int, end: int, above: tuple[str, ...]) -> None:
        seen: dict[str, int] = {}
        while at + 8 <= end:
            if kind == "iso":
                size, tag = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
                payload, stop = at + 8, at + size
                into = payload if tag in ISO_PARENTS else None
            else:
                tag, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
                payload, stop = at + 8, at + 8 + size
                into = None
                if tag in ("LIST", "RIFF"):
                    tag = data[payload : payload + 4].decode("latin-1") if tag == "LIST" else tag
                    into = payload + 4
            if stop < payload or stop > end:
                raise FaultError(f"{tag} at {at} does not fit")
            k = seen.get(tag, 0)
            seen[tag] = k + 1
            padded = min(end, stop + (stop - at) % 2) if kind == "avi" else stop
            out.append(Box((*above, tag), k, at, payload, stop, padded))
            if into is not None:
                walk(into, stop, (*above, tag))
            at = padded

    walk(0, len(data), ())
    return out


def find(data: bytes, *path: str) -> tuple[Box, list[int]]:
    """(first box at ``path``, offsets of the size fields of its ancestors); paths into AVI leave RIFF out."""
    avi = detect(data) == "avi"
    full = ("RIFF", *path) if avi else path
    if not path:
        # the root: the whole file; an AVI's has the RIFF size above it
        return Box((), 0, 0, 0, len(data), len(data)), [4] if avi else []
    boxes = read_boxes(data)
    got = next((b for b in boxes if b.path == full), None)
    if got is None:
        raise FaultError(f"no box at {'/'.join(full)}")
    above = [b for b in boxes if b.start <= got.start and b.end >= got.end and len(b.path) < len(full) and full[: len(b.path)] == b.path]
    return got, [b.start + 4 if avi else b.start for b in above]


#: A step of an address: a tag with its number among siblings of that tag, or a frame's number.
Step = tuple[str, int] | int


@dataclass(frozen=True)
class Region:
    """What an address owns: from its start to that of the next region in document order."""

    address: tuple[Step, ...]
    start: int
    end: int


def layout(data: bytes) -> list[Region]:
    """Regions in document order; each byte of the file is in exactly one.

    Frames stand below the mdat that holds the first of them, or below movi in place of their
    chunks; a frame's region starts at its data, so the header of its chunk belongs to the one before.
    """
    return data.regions if isinstance(data, Parsed) else _layout(data)


def _layout(data: bytes) -> list[Region]:
    avi = detect(data) == "avi"
    known: dict[tuple[str, ...], list[tuple[Box, tuple[Step, ...]]]] = {}
    places: list[tuple[tuple[Step, ...], int]] = []
    frames = 0
    for b in read_boxes(data):
        # the box above is the last one listed at its path
        above = known[b.path[:-1]][-1][1] if len(b.path) > 1 else ()
        own = avi and b.path[:2] == ("RIFF", "movi") and len(b.path) == 3 and b.path[2] in ("00dc", "00db")
        address = (*above, frames if own else (b.path[-1], b.occurrence))
        frames += own
        known.setdefault(b.path, []).append((b, address))
        places.append((address, b.payload if own else b.start))
    if not avi and (ranges := frame_ranges(data)):
        at, last = ranges[0][0], len(data)
        ends = [p for _, p in places[1:]] + [len(data)]
        where = next((i for i, ((address, start), end) in enumerate(zip(places, ends, strict=True)) if len(address) == 1 and address[0][0] == "mdat" and start < at < end), None)
        if where is None:
            raise FaultError("no mdat holds the first frame")
        last = ends[where]
        for start, end in ranges:
            if start < at or end > last:
                raise FaultError("frames overlap or leave their mdat")
            at = end
        places[where + 1 : where + 1] = [((*places[where][0], k), start) for k, (start, _) in enumerate(ranges)]
    ends = [p for _, p in places[1:]] + [len(data)]
    return [Region(address, start, end) for (address, start), end in zip(places, ends, strict=True)]


def steps(address: tuple) -> tuple[Step, ...]:
    """Tags without a number mean the first sibling."""
    return tuple((x, 0) if isinstance(x, str) else x for x in address)


def span(data: bytes, address: tuple) -> tuple[int, int]:
    """(start, end) of what an address owns."""
    want = steps(address)
    got = next((r for r in layout(data) if r.address == want), None)
    if got is None:
        raise FaultError(f"nothing at {address}")
    return got.start, got.end


def frame_ranges(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each frame: samples by stsz and stco of the sample table, or chunks of movi."""
    boxes = read_boxes(data)
    if detect(data) == "avi":
        return [(b.payload, b.end) for b in boxes if b.path[:2] == ("RIFF", "movi") and len(b.path) == 3 and b.path[2] in ("00dc", "00db")]
    tables = [next((b for b in boxes if b.path == (*STBL, tag)), None) for tag in ("stsz", "stco")]
    if None in tables:
        return []

    def number(b: Box, at: int) -> int:
        if b.payload + at + 4 > len(data):
            raise FaultError("a table is cut short")
        return int.from_bytes(data[b.payload + at : b.payload + at + 4], "big")

    sizes, offsets = tables
    constant, n = number(sizes, 4), number(sizes, 8)
    if n != number(offsets, 4):
        raise FaultError("sample and chunk counts differ")
    starts = [number(offsets, 8 + 4 * k) for k in range(n)]
    return [(at, at + (constant or number(sizes, 12 + 4 * k))) for k, at in enumerate(starts)]


def put(data: bytes, at: int, value: int, order: str) -> bytes:
    if at + 4 > len(data):
        raise FaultError("field outside the file")
    return data[:at] + (value % 2**32).to_bytes(4, order) + data[at + 4 :]


def grown(data: bytes, at: int, by: int, order: str) -> bytes:
    return put(data, at, int.from_bytes(data[at : at + 4], order) + by, order)


TRUNCATION, DECLARED, ABSURD_RATE = 100, 42, 1_000_001
STBL = ("moov", "trak", "mdia", "minf", "stbl")


def inject(data: bytes, fault: str, **how) -> bytes:
    """``data`` with one named fault; FaultError where the file has no place for it."""
    kind = detect(data)
    if kind == "neither":
        raise FaultError("neither format")
    iso = kind == "iso"
    order = "big" if iso else "little"
    path = tuple(how.get("path", ()))
    if fault == "trunc-before":
        return data[: span(data, how.get("address", ("moov",) if iso else ("RIFF", "movi")))[0]]
    if fault == "trunc-within":
        start, end = span(data, how.get("address", ("mdat", 0) if iso else ("RIFF", "movi", 0)))
        offset = how.get("offset", TRUNCATION)
        if not 0 < offset < end - start:
            raise FaultError("offset outside the region")
        return data[: start + offset]
    if fault == "zero-pay":
        return put(data, find(data, *(path or ("mdat",)))[0].start, 8, order)
    if fault in ("over-len", "under-len"):
        at = find(data, *(path or (("ftyp",) if fault == "over-len" else ("moov",))))[0].start
        return grown(data, at if iso else at + 4, 256 if fault == "over-len" else -1, order)
    if fault == "off-end":
        b, _ = find(data, *(path or (*STBL, "stco")))
        if b.end - b.payload < 8 or not int.from_bytes(data[b.payload + 4 : b.payload + 8], order):
            raise FaultError("no offsets")
        return put(data, b.payload + 8, len(data) + 1, order)
    if fault == "dup-box":
        b, above = find(data, *(path or ("moov", "trak")))
        data = data[: b.end] + data[b.start : b.end] + data[b.end :]
        for at in above:
            data = grown(data, at, b.end - b.start, order)
        return data
    if fault == "unk-box":
        b, above = find(data, *path)
        tag = how.get("tag", b"UNKN")
        data = data[: b.end] + (u32(8) + tag if iso else tag + le(8)) + data[b.end :]
        # the box itself grows too, by the four bytes at its start
        for at in (*above, b.start):
            data = grown(data, at, 8, order)
        return data
    if fault in ("zero-fps", "absurd-fps"):
        b, _ = find(data, *(("moov", "mvhd") if iso else ("hdrl", "strl", "strh")))
        return put(data, b.payload + (12 if iso else 24), 0 if fault == "zero-fps" else how.get("rate", ABSURD_RATE), order)
    if fault == "no-dim":
        if not iso:
            raise FaultError("only in ISO files")
        b, _ = find(data, "moov", "trak", "tkhd")
        s, _ = find(data, *STBL, "stsd")
        return put(put(put(data, b.payload + 76, 0, order), b.payload + 80, 0, order), s.payload + 40, 0, order)
    if fault == "zero-dim":
        b, _ = find(data, *(("moov", "trak", "tkhd") if iso else ("hdrl", "avih")))
        high = how.get("axis", "width") == "height"
        return put(data, b.payload + (76 if iso else 32) + 4 * high, 0, order)
    if fault == "non-mono":
        if not iso:
            raise FaultError("only in ISO files")
        return put(data, find(data, *STBL, "stts")[0].payload + 12, 0, order)
    if fault == "count-mis":
        b, _ = find(data, *((*STBL, "stsz") if iso else ("hdrl", "avih")))
        return put(data, b.payload + (8 if iso else 16), how.get("declared", DECLARED), order)
    if fault == "reorder":
        first, second = how.get("paths", (("moov",), ("mdat",)))
        if first[:-1] != second[:-1]:
            raise FaultError("not siblings")
        a, b = sorted((find(data, *first)[0], find(data, *second)[0]), key=lambda x: x.start)
        return data[: a.start] + data[b.start : b.end] + data[a.end : b.start] + data[a.start : a.end] + data[b.end :]
    raise FaultError(f"unknown fault {fault}")
