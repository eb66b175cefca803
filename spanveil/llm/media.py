"""Media columns: AVI files of motion JPEG, written, indexed, decoded and cut into shots.

A payload is stored losslessly in the format's own unit, the quantised coefficient: each 64 bytes are one
8 x 8 block, byte b as coefficient b - CENTRE in zigzag order, coded by run lengths and Huffman codes as in any baseline JPEG.
CENTRE lies amid the bytes of text, so that most samples of text stay within 0..255.  Each block is a restart interval.

Frames are read by one decoder, whoever made them: it finds the restart intervals of many frames with the same
tables and reads them in lockstep, a symbol of every interval at a time.  Frames without restart markers are one interval each.

Files whose frames exceed SEGMENT bytes go on in further RIFF segments with indexes of 64 bits (OpenDML).

Shots: histograms of luma are compared from frame to frame; a cut is where the difference exceeds a floor and
the recent differences' mean by several of their deviations.

Defined results: a null or empty text is a payload of 64 zero bytes; repeated rows give equal rows; a null doc_id
is kept; an empty table gives no rows; a frame that cannot be decoded raises ValueError.  A very long text is held a few times over
by its task, its coefficients only SLICE intervals at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, read_table, texts_of

BLOCK = 64
#: Blocks in a row and in a column of a frame.
SIDE = 4
FPS = 25
#: The byte whose coefficient is 0.
CENTRE = 96
#: Bytes of frames in a RIFF segment; intervals read in lockstep; bytes of texts whose frames are read together.
SEGMENT, SLICE, TOGETHER = 1 << 30, 1 << 14, 1 << 21
#: Bins of the luma histogram, frames that the adaptive threshold looks back, its deviations and floor.
BINS, BACK, DEVIATIONS, FLOOR = 32, 12, 3.0, 0.12


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Place in a block (row major) of each coefficient in order of transmission."""
    return np.asarray([8 * y + x for s in range(15) for y, x in sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), reverse=s % 2 == 0)])


@lru_cache(maxsize=1)
def inverse_dct() -> np.ndarray:
    """64 x 64: coefficients (row major) to samples."""
    u = np.arange(8)
    a = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(a, a).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table of Huffman codes as JPEG writes it, and the code and its length of each symbol."""
    codes, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code, last = code << (n - last) if last else 0, n
        codes[symbol] = code, n
        code += 1
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bytes(counts) + bytes(codes), codes


@lru_cache(maxsize=1)
def _codes() -> tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both tables, then codes and lengths by symbol of the first coefficient and of the others.

    Symbols without a run of zeros, and the end of a block, have 4 bits, all others 9."""
    first, first_codes = _canonical({size: 4 for size in range(9)})
    runs = {run << 4 | size: 9 for run in range(1, 16) for size in range(1, 9)}
    other, other_codes = _canonical({0: 4, 0xF0: 9, **{size: 4 for size in range(1, 9)}, **runs})
    arrays = []
    for codes in (first_codes, other_codes):
        for k in (0, 1):
            arrays.append(np.zeros(256, dtype=np.int64))
            arrays[-1][list(codes)] = [c[k] for c in codes.values()]
    return first, other, *arrays


@lru_cache(maxsize=64)
def _head(width: int, height: int) -> bytes:
    first, other = _codes()[:2]
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + first + b"\x10" + other)
        + _segment(0xDD, b"\x00\x01")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode_frames(blocks: np.ndarray, width: int, height: int) -> Iterator[bytes]:
    """Baseline JPEGs of blocks (n, 64) of bytes in zigzag order; n is a multiple of the blocks of a frame."""
    per = width * height // BLOCK
    step = max(1, SLICE // per) * per
    for i in range(0, len(blocks), step):
        yield from _encoded(blocks[i : i + step], per, _head(width, height))


def _encoded(blocks: np.ndarray, per: int, head: bytes) -> list[bytes]:
    _, _, first_code, first_bits, code, bits = _codes()
    units = blocks.astype(np.int64) - CENTRE
    told = units != 0
    told[:, 0] = True  # the first coefficient is always told
    row, place = np.nonzero(told)
    v = units[row, place]
    size = _sizes()[np.abs(v)]
    is_first = place == 0
    run = np.where(is_first, 0, place - np.concatenate([[0], place[:-1]]) - 1)
    symbol = (run & 15) << 4 | size
    width = np.where(is_first, first_bits[size], bits[symbol]) + size
    value = np.where(is_first, first_code[size], code[symbol]) << size | (v - (v < 0)) & ((1 << size) - 1)
    for _ in range(3):  # 16 zeros each
        more = run > 15
        value = np.where(more, code[0xF0] << width | value, value)
        width, run = width + more * bits[0xF0], run - 16 * more
    last = np.append(np.flatnonzero(is_first)[1:], len(row)) - 1
    short = last[place[last] < BLOCK - 1]
    value[short] = value[short] << bits[0] | code[0]
    width[short] += bits[0]
    fill = -np.bincount(row, weights=width, minlength=len(blocks)).astype(np.int64) % 8
    value[last] = value[last] << fill | (1 << fill) - 1
    width[last] += fill
    ends = np.cumsum(width)
    data = _packed(value, width, ends - width, int(ends[-1]) // 8)
    # a zero follows each byte of all ones, a marker each block but a frame's last
    block = np.arange(len(blocks))
    marked = (block + 1) % per != 0
    final = ends[last] // 8 - 1
    more = 1 + (data == 0xFF)
    more[final] += 2 * marked
    after = np.cumsum(more)
    out = np.zeros(after[-1], dtype=np.uint8)
    out[after - more] = data
    out[after[final[marked]] - 2] = 0xFF
    out[after[final[marked]] - 1] = 0xD0 + block[marked] % per % 8
    edges = [0, *after[final[per - 1 :: per]].tolist()]
    return [head + out[a:b].tobytes() + b"\xff\xd9" for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=1)
def _sizes() -> np.ndarray:
    return np.asarray([n.bit_length() for n in range(256)])


def _packed(value: np.ndarray, width: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """n bytes of values of at most 57 bits, each at its first bit."""
    offset = start & 7
    aligned = value << (64 - width - offset - 1)  # a bit is left for the sign
    out, byte, used = np.zeros(n), start >> 3, offset + width
    for j in range(8):
        if j:
            keep = used > 8 * j
            aligned, byte, used = aligned[keep], byte[keep], used[keep]
        if not len(byte):
            break
        out += np.bincount(byte + j, weights=aligned >> (55 - 8 * j) & 0xFF, minlength=n) if j < 7 else np.bincount(byte + j, weights=aligned << 1 & 0xFF, minlength=n)
    return out.astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _index(chunks: list[tuple[int, int]], base: int) -> bytes:
    """A standard index: the place after base and the size of each frame."""
    head = struct.pack("<HBBI4sQI", 2, 0, 1, len(chunks), b"00dc", base, 0)
    return _chunk(b"ix00", head + b"".join(struct.pack("<II", at, size) for at, size in chunks))


def _header(width: int, height: int, fps: int, sizes: list[int], first: int, places: list[tuple[int, int, int]]) -> bytes:
    """places: place, size and frames of each segment's index, where there are several segments."""
    largest = max(sizes)
    avih = struct.pack("<14I", 1_000_000 // fps, min(largest * fps, 0xFFFFFFFF), 0, 0x10, first, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(sizes), largest, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    stream, rest = _chunk(b"strh", strh) + _chunk(b"strf", strf), b""
    if places:
        stream += _chunk(b"indx", struct.pack("<HBBI4s3I", 4, 0, 0, len(places), b"00dc", 0, 0, 0) + b"".join(struct.pack("<QII", *p) for p in places))
        rest = _chunk(b"LIST", b"odml" + _chunk(b"dmlh", struct.pack("<I", len(sizes)).ljust(248, b"\x00")))
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + stream) + rest)


def to_avi(payload: bytes, fps: int = FPS, segment: int = SEGMENT) -> bytes:
    """An AVI whose frames hold the payload, a multiple of 64 bytes; the last frame is filled up with zeros."""
    blocks = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCK)
    across = min(len(blocks), SIDE)
    down = min(-(-len(blocks) // across), SIDE)
    per, width, height = across * down, 8 * across, 8 * down
    if len(blocks) % per:
        blocks = np.vstack([blocks, np.zeros((per - len(blocks) % per, BLOCK), dtype=np.uint8)])
    frames = list(encode_frames(blocks, width, height))
    parts: list[list[bytes]] = []
    held = segment
    for f in frames:
        if held + len(f) > segment:
            parts.append([])
            held = 0
        parts[-1].append(f)
        held += len(f)
    sizes = list(map(len, frames))
    several = [(0, 0, 0)] * len(parts) if len(parts) > 1 else []
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload)))
    at, out, places = 12 + len(_header(width, height, fps, sizes, len(parts[0]), several)) + len(info), [], []
    for k, part in enumerate(parts):
        at += 24 if k else 12  # of the list and, from the second on, of the segment
        listed, place = [], 4
        for f in part:
            listed.append((place, len(f)))
            place += 8 + len(f) + len(f) % 2
        body = b"movi" + b"".join(_chunk(b"00dc", f) for f in part)
        tail = b""
        if several:
            own = _index([(p + 4, n) for p, n in listed], at)
            places.append((at + len(body) - 4, len(own), len(part)))
            body += own
        if not k:
            tail = _chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, p, n) for p, n in listed))
        out.append(_chunk(b"LIST", body) + tail)
        at += len(out[-1]) - 12
    head = _header(width, height, fps, sizes, len(parts[0]), places)
    return _chunk(b"RIFF", b"AVI " + head + info + out[0]) + b"".join(_chunk(b"RIFF", b"AVIX" + x) for x in out[1:])


@dataclass
class Movie:
    width: int = 0
    height: int = 0
    seconds_per_frame: float = 0.0
    payload_bytes: int | None = None
    frames: list[bytes] = field(default_factory=list)


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def _is_frame(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db")


def _standard_index(data: memoryview, at: int) -> list[tuple[int, int]]:
    """Place and size of the frames that the standard index in the chunk at this place lists."""
    longs, _, kind, n, _, base, _ = struct.unpack_from("<HBBI4sQI", data, at + 8)
    if (longs, kind) != (2, 1):
        raise ValueError("unknown kind of index")
    return [(base + p, size & 0x7FFFFFFF) for p, size in struct.iter_unpack("<II", data[at + 32 : at + 32 + 8 * n])]


def parse_avi(media: bytes) -> Movie:
    """Reads the RIFF chunks of all segments and finds the frames by the index of indexes, or by idx1, or else by the chunks."""
    data = memoryview(media)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("no AVI file")
    movie, movi, walked, index, above = Movie(), 0, [], None, None
    for riff, start, length in _chunks(data, 0, len(data)):
        segment = bytes(data[start : start + 4])
        if riff != b"RIFF" or segment not in (b"AVI ", b"AVIX"):
            break
        found = None
        for name, at, size in _chunks(data, start + 4, start + length):
            kind = bytes(data[at : at + 4]) if name == b"LIST" else b""
            if kind == b"hdrl":
                for n, a, s in _chunks(data, at + 4, at + size):
                    if n == b"avih":
                        h = struct.unpack_from("<10I", data, a)
                        movie.seconds_per_frame, movie.width, movie.height = h[0] / 1e6, h[8], h[9]
                    elif n == b"LIST" and bytes(data[a : a + 4]) == b"strl":
                        for m, c, _ in _chunks(data, a + 4, a + s):
                            if m == b"indx" and data[c + 3] == 0 and _is_frame(bytes(data[c + 8 : c + 12])):
                                above = [p for p, _, _ in struct.iter_unpack("<QII", data[c + 24 : c + 24 + 16 * struct.unpack_from("<I", data, c + 4)[0]])]
            elif kind == b"INFO":
                for n, a, s in _chunks(data, at + 4, at + size):
                    if n == b"ICMT" and bytes(data[a : a + 8]) == b"payload=":
                        movie.payload_bytes = int(bytes(data[a + 8 : a + s]))
            elif kind == b"movi":
                movi, found = at, (at + 4, at + size)
            elif name == b"idx1":
                index = [e for e in struct.iter_unpack("<4sIII", data[at : at + size - size % 16]) if _is_frame(e[0])]
                # offsets count from the list's name in most files and from the file's start in some
                base = movi if not index or bytes(data[movi + index[0][2] : movi + index[0][2] + 4]) == index[0][0] else 0
                walked += [(base + p + 8, n) for _, _, p, n in index]
                found = None
        if found and above is None:
            walked += [(a, s) for n, a, s in _chunks(data, *found) if _is_frame(n)]
    listed = walked if above is None else [x for p in above for x in _standard_index(data, p)]
    movie.frames = [media[a : a + s] for a, s in listed]
    return movie


@dataclass
class Scan:
    """What a frame's segments before the coded data say."""

    head: bytes
    #: Component, blocks across and down in a unit, tables of the first coefficient and of the others.
    parts: list[tuple[int, int, int, np.ndarray, np.ndarray]]
    scale: np.ndarray
    #: Units in an interval, across and down.
    every: int
    mcus_x: int
    mcus_y: int

    @property
    def across(self) -> int:
        return self.mcus_x * self.parts[0][1]

    @property
    def down(self) -> int:
        return self.mcus_y * self.parts[0][2]


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Length and symbol of the code that each 16 bits begin with; 0 where none does."""
    table, at, code = np.zeros(1 << 16, dtype=np.int32), 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbols[at]
            at, code = at + 1, code + 1
        code *= 2
    return table


def read_head(jpeg: bytes) -> Scan:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, scales, codes, parts, every, size, chosen = 2, {}, {}, [], 0, (0, 0), {}
    while not chosen:
        if jpeg[at : at + 1] != b"\xff" or at + 4 > len(jpeg):
            raise ValueError("no segment where one should be")
        marker, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body, at = jpeg[at + 4 : at + 2 + length], at + 2 + length
        if at > len(jpeg):
            raise ValueError("a segment is cut off")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                scales[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                end = 17 + sum(body[1:17])
                codes[body[0]], body = _lookup(body[1:17], body[17:end]), body[end:]
        elif marker in (0xC0, 0xC1):
            size = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if not parts or any(p[0] not in chosen for p in parts) or parts[0][3] not in scales:
        raise ValueError("a table or component is missing")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    mcus_x, mcus_y = (-(-n // (8 * max(p[k] for p in parts))) for n, k in ((size[1], 1), (size[0], 2)))
    try:
        tables = [(p, h, v, codes[chosen[p] >> 4], codes[16 + (chosen[p] & 15)]) for p, h, v, _ in parts]
    except KeyError as e:
        raise ValueError("a table is missing") from e
    return Scan(jpeg[:at], tables, scales[parts[0][3]], every or mcus_x * mcus_y, mcus_x, mcus_y)


def _peek(window: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16 bits from each place on."""
    return window[at >> 3] >> (8 - (at & 7)) & 0xFFFF


def _amplitude(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    v, one = bits >> (16 - size), np.left_shift(1, size)
    return v - (v < one >> 1) * (one - 1)


def _blocks(window: np.ndarray, at: np.ndarray, first: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next block of each interval, its first coefficient as a difference, and the places after."""
    out, at = np.zeros((len(at), BLOCK), dtype=np.int32), at.copy()
    found = first[_peek(window, at)]
    if not found.all() or ((found & 0xFF) > 15).any():
        raise ValueError("no such code")
    at += found >> 8
    size = found & 0xFF
    out[:, 0] = _amplitude(_peek(window, at), size)
    at += size
    live, pos, place = np.arange(len(at)), at.copy(), np.ones(len(at), dtype=np.int64)
    while len(live):
        found = other[_peek(window, pos)]
        if not found.all():
            raise ValueError("no such code")
        pos += found >> 8
        run, size = found >> 4 & 15, found & 15
        place += run
        told = size > 0
        if told.all():
            if place.max() >= BLOCK:
                raise ValueError("a block of more than 64 coefficients")
            out[live, place] = _amplitude(_peek(window, pos), size)
            pos += size
            place += 1
            done = place == BLOCK
        else:
            if (place[told] >= BLOCK).any():
                raise ValueError("a block of more than 64 coefficients")
            out[live[told], place[told]] = _amplitude(_peek(window, pos), size)[told]
            pos += size
            place += 1
            done = (place >= BLOCK) | ~told & (run < 15)
        if done.any():
            at[live[done]] = pos[done]
            live, pos, place = live[~done], pos[~done], place[~done]
    return out, at


def _decode(scan: Scan, coded: list[bytes]) -> np.ndarray:
    """The first component's coefficients (frames, blocks, 64) of frames with one head, from their coded data."""
    data = np.frombuffer(b"".join(c + b"\xff\xd0" for c in coded), dtype=np.uint8)
    frame_ends = np.cumsum([len(c) + 2 for c in coded])
    ones = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ones + 1]
    keep = np.ones(len(data), dtype=bool)
    keep[ones[after == 0] + 1] = False
    marks = ones[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    total, mcus = scan.mcus_x * scan.mcus_y, -(-scan.mcus_x * scan.mcus_y // scan.every)
    if (np.searchsorted(marks, frame_ends, side="left") != mcus * np.arange(1, len(coded) + 1)).any():
        raise ValueError("another number of restart intervals than the head says")
    end = 8 * np.cumsum(keep)[marks].astype(np.int64)
    at = np.concatenate([[0], end[:-1]])
    clean = np.concatenate([data[keep], np.zeros(4 * BLOCK * 4, dtype=np.uint8)]).astype(np.int32)
    window = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    frame, interval = np.divmod(np.arange(len(marks)), mcus)
    out = np.zeros((len(coded), scan.across * scan.down, BLOCK), dtype=np.int32)
    before = np.zeros((len(scan.parts), len(marks)), dtype=np.int32)
    for m in range(min(scan.every, total)):
        rows = np.flatnonzero(interval * scan.every + m < total)
        mcu = interval[rows] * scan.every + m
        for k, (_, h, v, first, other) in enumerate(scan.parts):
            for y in range(v):
                for x in range(h):
                    block, at[rows] = _blocks(window, at[rows], first, other)
                    before[k, rows] += block[:, 0]
                    block[:, 0] = before[k, rows]
                    if (at[rows] > end[rows]).any():
                        raise ValueError("the scan ends early")
                    if not k:
                        out[frame[rows], (mcu // scan.mcus_x * v + y) * scan.across + mcu % scan.mcus_x * h + x] = block
    return out


def decode_frames(frames: Iterable[tuple[object, bytes]]) -> Iterator[tuple[list, Scan, np.ndarray]]:
    """Of frames with any keys: keys, their common head, and coefficients (frames, blocks, 64) in zigzag order before scaling."""
    heads: list[tuple[Scan, list]] = []
    for key, jpeg in frames:
        known = next((h for h in heads if jpeg.startswith(h[0].head)), None)
        if known is None:
            try:
                known = (read_head(jpeg), [])
            except (IndexError, struct.error) as e:
                raise ValueError("a segment is too short") from e
            heads = [known, *heads]
        scan, waiting = known
        end = jpeg.rfind(b"\xff\xd9")
        if end < len(scan.head):
            raise ValueError("the frame has no end")
        waiting.append((key, jpeg[len(scan.head) : end]))
        if len(waiting) * scan.across * scan.down >= SLICE:
            yield [k for k, _ in waiting], scan, _decode(scan, [c for _, c in waiting])
            waiting.clear()
        elif len(heads) > 64:
            scan, waiting = heads.pop()
            if waiting:
                yield [k for k, _ in waiting], scan, _decode(scan, [c for _, c in waiting])
    for scan, waiting in heads:
        if waiting:
            yield [k for k, _ in waiting], scan, _decode(scan, [c for _, c in waiting])


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A baseline frame's first component: coefficients (blocks, 64) in zigzag order before scaling, its scale, and
    blocks across and down."""
    _, scan, units = next(decode_frames([(0, jpeg)]))
    return units[0], scan.scale, scan.across, scan.down


def luma(coefficients: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Samples 0..255 of each block, row major."""
    placed = np.empty(coefficients.shape, dtype=np.float32)
    placed[:, zigzag()] = coefficients * scale
    return np.clip(np.rint(placed @ inverse_dct()) + 128, 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, difference at its start) of each shot."""
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    change = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    starts, since = [(0, 0.0)], 0
    for k, d in enumerate(change.tolist()):
        recent = change[max(since, k - BACK) : k]
        if d > FLOOR and (len(recent) == 0 or d > recent.mean() + DEVIATIONS * recent.std()) and k + 1 - starts[-1][0] > 1:
            starts.append((k + 1, d))
            since = k + 1
    return [(a, b, d) for (a, d), b in zip(starts, [s for s, _ in starts[1:]] + [len(histograms)], strict=True)]


@dataclass
class Decoded:
    movie: Movie
    payload: bytes
    shots: list[tuple[int, int, float]]


def read_back_all(files: list[bytes]) -> list[Decoded]:
    """The stored payload (units outside the bytes are cut off) and the shots of each file."""
    movies = [parse_avi(f) for f in files]
    kept = [[b""] * len(m.frames) for m in movies]
    histograms = [np.zeros((len(m.frames), BINS), dtype=np.int64) for m in movies]
    for keys, scan, units in decode_frames(((i, k), f) for i, m in enumerate(movies) for k, f in enumerate(m.frames)):
        stored = np.clip(units + CENTRE, 0, 255).astype(np.uint8)
        bins = luma(units.reshape(-1, BLOCK), scan.scale).reshape(len(keys), -1) >> 3
        counts = np.bincount((bins + BINS * np.arange(len(keys))[:, None]).ravel(), minlength=BINS * len(keys)).reshape(-1, BINS)
        for (i, k), s, c in zip(keys, stored, counts, strict=True):
            kept[i][k] = s.tobytes()
            histograms[i][k] = c
    payloads = [b"".join(k)[: m.payload_bytes] for k, m in zip(kept, movies, strict=True)]
    return [Decoded(m, p, shots(h) if len(h) else []) for m, p, h in zip(movies, payloads, histograms, strict=True)]


def read_back(media: bytes) -> Decoded:
    return read_back_all([media])[0]


def padded(data: bytes) -> bytes:
    return data + b"\x00" * (-len(data) % BLOCK or (0 if data else BLOCK))


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI of each text's bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "media": [to_avi(padded(t.encode("utf-8", "surrogatepass"))) for t in pdf["text"]]})

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(per_batch(run), "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """A timed row for each shot of each AVI in the column media; a null gives no row."""
    kind = "doc_id long, clip int, first_frame long, frames long, starts_s double, ends_s double, difference double, width int, height int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, data in zip(pdf["doc_id"], pdf["media"], strict=True):
            got = read_back(data)
            s, w, h = got.movie.seconds_per_frame, got.movie.width, got.movie.height
            rows += [(doc_id, k, a, b - a, a * s, b * s, d, w, h) for k, (a, b, d) in enumerate(got.shots)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")]).astype({"doc_id": "Int64"})

    return media.select(F.col("doc_id").cast("long"), "media").filter("media IS NOT NULL").mapInPandas(per_batch(run), kind)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text, reads it back and describes both forms in a row."""
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, waiting, held = [], [], 0

        def flush() -> None:
            for (doc_id, n, media), got in zip(waiting, read_back_all([w[2] for w in waiting]), strict=True):
                frames, cuts = len(got.movie.frames), ",".join(str(a) for a, _, _ in got.shots)
                feature = f"{got.movie.width}x{got.movie.height};frames={frames};clips={len(got.shots)};starts={cuts}"
                rows.append((doc_id, n, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            waiting.clear()

        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            waiting.append((doc_id, len(data), to_avi(padded(data))))
            held += len(data)
            if held >= TOGETHER:
                flush()
                held = 0
        flush()
        return pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")]).astype({"doc_id": "Int64"})

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(per_batch(run), kind)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))
