"""Lossless WebP in numpy (operator 2): a decoder of the whole format, and a writer for media columns.

Decoding runs many images in lockstep. Each image is a lane with a bit position of its own; step ``i`` makes pixel ``i`` of every
lane with a few vector operations: fetch 64 bits at each position, look prefix codes up in one concatenated table,
or continue a back-reference, or take a colour-cache entry. Images are small where speed matters (the writer cuts long data into
tiles), so lanes are many and of like length. Images inside a stream (palettes, transform blocks, code groups) are lanes too: files are
opened as generators that hand out one inner image at a time, and those of all files run together. Transforms are inverted
afterwards, the predictor's pixels in lockstep again.

The writer picks for each tile a palette, or cross-colour multipliers and predictor modes for the blocks that gain by them, or none of
these; then back-references, then the size of the colour cache by the entropy of what it leaves.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import ship

# Fixed values of the format.
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
BLACK = 0xFF000000
#: Offsets of the 120 short distance codes: the neighbourhood above and to the left, by distance.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: Lanes that run together, and pixels they hold at most; both bound memory.
LANES, LANE_PIXELS = 8192, 1 << 24


class BadImage(ValueError):
    """The bytes are no lossless WebP image, or end too early."""


# -- prefix codes -------------------------------------------------------------------------------------------------


def _reversed(bits: int) -> np.ndarray:
    """Indices with their ``bits`` bits reversed."""
    i, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for _ in range(bits):
        out, i = out << 1 | i & 1, i >> 1
    return out


_REVERSED = [_reversed(b) for b in range(16)]


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with a code in canonical order, and their code values (most significant bit first)."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    longest = int(lengths[order[-1]])
    steps = 1 << (longest - lengths[order].astype(np.int64))
    return order, (np.cumsum(steps) - steps) >> (longest - lengths[order].astype(np.int64))


def lookup_table(lengths: np.ndarray) -> np.ndarray:
    """Table over the next bits (first bit lowest) of ``symbol << 4 | length``; one entry if a single symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        return np.zeros(1, np.int32)
    if len(used) == 1:
        return np.array([used[0] << 4], np.int32)
    order = used[np.argsort(lengths[used], kind="stable")]
    longest = int(lengths[order[-1]])
    entries = np.repeat(order << 4 | lengths[order], 1 << (longest - lengths[order].astype(np.int64)))
    if len(entries) != 1 << longest:
        raise BadImage("a prefix code is not complete")
    return entries[_REVERSED[longest]].astype(np.int32)


class Bits:
    """Reads little-endian bit fields from a position on, through a window of one Python number."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at
        self._from, self._bits = -1, 0

    def _fill(self) -> None:
        self._from = self.at & ~7
        self._bits = int.from_bytes(self.data[self._from >> 3 : (self._from >> 3) + 256], "little")

    def peek(self, n: int) -> int:
        if self._from < 0 or self.at < self._from or self.at + n > self._from + 2048:
            self._fill()
        return self._bits >> (self.at - self._from) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise BadImage("the data ends within an image")
        return value


@dataclass
class Codes:
    """Prefix codes one after the other: the reader that stands before them, their alphabets, and their code lengths once they are read."""

    bits: Bits
    alphabets: tuple[int, ...]
    found: list[bytes] = field(default_factory=list)


class Streams:
    """Data of many lanes in one buffer, with a bit position for each."""

    def __init__(self, data: list[bytes], at: list[int]) -> None:
        sizes = np.array([len(d) for d in data], np.int64)
        self.starts = np.cumsum(sizes + 16) - sizes - 16
        self.pos, self.limits = np.array(at, np.int64), 8 * sizes
        buffer = b"".join(x for d in data for x in (d, bytes(16)))  # with room to fetch beyond the end
        self.words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))

    def fetch(self, which: np.ndarray | slice) -> np.ndarray:
        """At least 57 bits from each position on."""
        p = self.pos[which]
        return (self.words[self.starts[which] + (np.minimum(p, self.limits[which]) >> 3)] >> (p & 7).view(np.uint64)).view(np.int64)

    def check(self) -> None:
        if (self.pos > self.limits).any():
            raise BadImage("the data ends within an image")


_ORDER = np.array(LENGTH_ORDER)


def _length_tables(own: np.ndarray) -> np.ndarray:
    """For rows of the 19 lengths of the code that tells code lengths: a table over the next 7 bits of ``symbol << 4 | length``."""
    single = np.count_nonzero(own, axis=1) == 1
    steps = np.where(own > 0, 128 >> own, 0)
    steps[single] = np.where(own[single] > 0, 128, 0)
    if (steps.sum(axis=1) != 128).any():
        raise BadImage("a prefix code is not complete")
    order = np.argsort(np.where(own > 0, own, 99), axis=1, kind="stable")
    entry = order << 4 | np.where(single[:, None], 0, np.take_along_axis(own, order, axis=1))
    return np.repeat(entry.ravel(), np.take_along_axis(steps, order, axis=1).ravel()).reshape(-1, 128)[:, _REVERSED[7]]


def run_codes(asked: list[Codes]) -> None:
    """Read the code lengths of all requests, the first codes of each together, then the second ones, and so on."""
    s = Streams([x.bits.data for x in asked], [x.bits.at for x in asked])
    for j in range(max(len(x.alphabets) for x in asked)):
        who = np.array([i for i, x in enumerate(asked) if j < len(x.alphabets)])
        alphabet = np.array([asked[i].alphabets[j] for i in who.tolist()])
        lengths = np.zeros((len(who), int(alphabet.max())), np.int16)
        window = s.fetch(who)
        simple = np.flatnonzero(window & 1)
        if len(simple):
            head = window[simple]
            two, wide = head >> 1 & 1, head >> 2 & 1
            first, second = np.where(wide, head >> 3 & 255, head >> 3 & 1), head >> np.where(wide, 11, 4) & 255
            if (np.maximum(first, second * two) >= alphabet[simple]).any():
                raise BadImage("a symbol is outside its alphabet")
            lengths[simple, first] = 1
            pair = np.flatnonzero(two)
            lengths[simple[pair], second[pair]] = 1
            s.pos[who[simple]] += np.where(wide, 11, 4) + 8 * two
        rest = np.flatnonzero(~window & 1)
        if len(rest):
            _read_lengths(s, who[rest], alphabet[rest], rest, lengths)
        for k, i in enumerate(who.tolist()):
            asked[i].found.append(lengths[k, : alphabet[k]].tobytes())
    s.check()
    for x, at in zip(asked, s.pos.tolist(), strict=True):
        x.bits.at = at


def _read_lengths(s: Streams, who: np.ndarray, alphabet: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> None:
    """Run-length coded code lengths of the lanes ``who`` into the rows ``row`` of ``lengths``, a token of each lane a step."""
    told = 4 + (s.fetch(who) >> 1 & 15)
    s.pos[who] += 5
    window, own = s.fetch(who), np.zeros((len(who), 19), np.int64)
    own[:, _ORDER] = np.where(np.arange(19) < told[:, None], window[:, None] >> 3 * np.arange(19) & 7, 0)
    s.pos[who] += 3 * told
    tables = _length_tables(own).ravel()
    window = s.fetch(who)
    wide = 2 + 2 * (window >> 1 & 7)
    left = np.where(window & 1, 2 + (window >> 4 & ((1 << wide) - 1)), alphabet)
    s.pos[who] += np.where(window & 1, 4 + wide, 1)
    found, previous = np.zeros(len(who), np.int64), np.full(len(who), 8)
    live = np.flatnonzero(left > 0)
    while len(live):
        own_who = who[live]
        window = s.fetch(own_who)
        entry = tables[live * 128 + (window & 127)]
        n, code = entry & 15, entry >> 4
        window >>= n
        plain, repeat = code < 16, np.ones(len(live), np.int64)
        at, value = live[plain], code[plain]
        if (found[at] >= alphabet[at]).any():
            raise BadImage("code lengths run over their alphabet")
        lengths[row[at], found[at]] = value
        previous[at] = np.where(value, value, previous[at])
        runs = np.flatnonzero(~plain)
        if len(runs):
            kind, more = code[runs], window[runs]
            extra = np.array([2, 3, 7])[kind - 16]
            repeat[runs] = np.array([3, 3, 11])[kind - 16] + (more & ((1 << extra) - 1))
            n[runs] += extra
            for k in runs[kind == 16].tolist():
                i = live[k]
                lengths[row[i], found[i] : found[i] + repeat[k]] = previous[i]
        s.pos[own_who] += n
        found[live] += repeat
        left[live] -= 1
        if (found[live] > alphabet[live]).any():
            raise BadImage("code lengths run over their alphabet")
        live = live[(left[live] > 0) & (found[live] < alphabet[live])]


# -- pixels, in lockstep ------------------------------------------------------------------------------------------


@dataclass
class Lane:
    """One entropy-coded image: its data from a bit on, its size, and its prefix codes."""

    data: bytes
    at: int
    width: int
    height: int
    cache_bits: int
    groups: list[tuple[bytes, ...]]
    group_of: np.ndarray | None = None
    pixels: np.ndarray | None = None
    end: int = 0

    def kind(self) -> int:
        """2 with a colour cache, 1 with back-references but no cache, 0 with neither."""
        return 2 if self.cache_bits else int(any(any(g[0][512:]) for g in self.groups))


#: What opening an image asks for: code lengths, or the pixels of an inner image.
Asked = Codes | Lane


def read_lane(bits: Bits, width: int, height: int, main: bool) -> Generator[Asked, None, Lane]:
    """Everything up to the pixels of an image; only the main image may have several groups of codes. Yields what is to be run with that of other images."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    group_of, count = None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across, down = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
        inner = yield from read_image(bits, across, down)
        numbers = (inner >> 8 & 0xFFFF).astype(np.int64)
        count = int(numbers.max()) + 1
        group_of = numbers.reshape(down, across)[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block].ravel()
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = Codes(bits, sizes * count)
    yield codes
    groups = [tuple(codes.found[i : i + 5]) for i in range(0, 5 * count, 5)]
    return Lane(bits.data, bits.at, width, height, cache_bits, groups, group_of)


def read_image(bits: Bits, width: int, height: int) -> Generator[Asked, None, np.ndarray]:
    """The ARGB values of an image inside the stream, once its lane has been run; the reader goes on after it."""
    lane = yield from read_lane(bits, width, height, main=False)
    yield lane
    bits.at = lane.end
    return lane.pixels


def run_lanes(lanes: list[Lane]) -> None:
    """Fill ``pixels`` and ``end`` of all lanes; batches by size bound memory."""
    for kind in range(3):  # images of literals, and those without a cache, take fewer operations a step
        order = sorted((x for x in lanes if x.kind() == kind), key=lambda x: -x.width * x.height)
        while order:
            largest = max(1, order[0].width * order[0].height)
            n = max(1, min(LANES, LANE_PIXELS // largest))
            _run_batch(order[:n])
            order = order[n:]


def _prefix_value(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length or distance of a prefix symbol with the extra bits in ``window``; and how many bits those are."""
    extra = np.maximum(symbol - 2, 0) >> 1
    value = ((2 + (symbol & 1)) << extra) + (window & ((1 << extra) - 1)) + 1
    return np.where(symbol < 4, symbol + 1, value), np.where(symbol < 4, 0, extra)


def _run_batch(lanes: list[Lane]) -> None:
    k = len(lanes)
    sizes = np.array([x.width * x.height for x in lanes])
    steps = int(sizes.max())
    streams = Streams([x.data for x in lanes], [x.at for x in lanes])
    pos, fetch = streams.pos, streams.fetch
    # tables of all codes, equal ones once
    offsets: dict[bytes, tuple[int, int]] = {}
    tables, total = [], 0
    rows, first_row = [], np.zeros(k, np.int64)
    literal_only, alpha_bits, widest = True, False, 0
    for i, x in enumerate(lanes):
        first_row[i] = len(rows)
        for group in x.groups:
            row, span = [], 0
            for code, raw in enumerate(group):
                if raw not in offsets:
                    table = lookup_table(np.frombuffer(raw, np.int16))
                    offsets[raw] = (total, len(table) - 1)
                    tables.append(table)
                    total += len(table)
                row.append(offsets[raw])
                if code < 4:
                    span += offsets[raw][1].bit_length()
            literal_only &= not np.frombuffer(group[0], np.int16)[256:].any()
            alpha_bits |= row[3][1] > 0
            widest = max(widest, span)
            rows.append(row)
    table = np.concatenate(tables).astype(np.int64)
    code_at = np.array([[o for o, _ in r] for r in rows], np.int64).T.copy()
    code_mask = np.array([[m for _, m in r] for r in rows], np.int64).T.copy()
    many_groups = any(x.group_of is not None for x in lanes)
    literal_only &= not any(x.cache_bits for x in lanes)
    if many_groups:
        group_map = np.zeros((steps, k), np.int32)
        for i, x in enumerate(lanes):
            if x.group_of is not None:
                group_map[: len(x.group_of), i] = x.group_of
    out = np.zeros((steps, k), np.uint32)
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # lanes with more than i pixels; sizes fall
    copying, distance = np.zeros(k, np.int64), np.ones(k, np.int64)
    widths = np.array([x.width for x in lanes])
    cached = lanes[0].cache_bits > 0  # then all of a batch have one
    cache_bits = np.array([x.cache_bits for x in lanes])
    cache_shift = (32 - cache_bits).astype(np.uint32)
    cache_at = np.cumsum(1 << cache_bits) - (1 << cache_bits)
    cache = np.zeros(int(cache_at[-1]) + (1 << lanes[-1].cache_bits) if cached else 1, np.uint32)
    near_x, near_y = np.array([p[0] for p in NEAR]), np.array([p[1] for p in NEAR])

    def decode(code: int, row: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry = table[code_at[code][row] + (window & code_mask[code][row])]
        n = entry & 15
        return entry >> 4, window >> n, n

    last = -1
    for i in range(steps):
        a = int(active[i])
        if many_groups or a != last:
            row = first_row[:a] + (group_map[i, :a] if many_groups else 0)
            last = a
        if literal_only:
            window = fetch(slice(0, a))
            green, window, n1 = decode(0, row, window)
            red, window, n2 = decode(1, row, window)
            if widest > 56:
                pos[:a] += n1 + n2
                window, n1, n2 = fetch(slice(0, a)), 0, 0
            blue, window, n3 = decode(2, row, window)
            alpha, n4 = 0xFF, 0
            if alpha_bits:
                alpha, window, n4 = decode(3, row, window)
            else:
                alpha = table[code_at[3][row]] >> 4
            pos[:a] += n1 + n2 + n3 + n4
            out[i, :a] = alpha << 24 | red << 16 | green << 8 | blue
            continue
        fresh = np.flatnonzero(copying[:a] == 0)
        if len(fresh):
            own = row[fresh]
            symbol, window, n = decode(0, own, fetch(fresh))
            literal = np.flatnonzero(symbol < 256)
            lit, own_lit = fresh[literal], own[literal]
            if widest > 56:  # the codes of a pixel may not fit in one window
                pos[fresh] += n
                n = np.zeros(len(fresh), np.int64)
                red, _, n2 = decode(1, own_lit, fetch(lit))
                pos[lit] += n2
                window = fetch(lit)
            else:
                red, window, n2 = decode(1, own_lit, window[literal])
                n[literal] += n2
            blue, window, n3 = decode(2, own_lit, window)
            n[literal] += n3
            if alpha_bits:
                alpha, _, n4 = decode(3, own_lit, window)
                n[literal] += n4
            else:
                alpha = table[code_at[3][own_lit]] >> 4
            out[i, lit] = alpha << 24 | red << 16 | symbol[literal] << 8 | blue
            pos[fresh] += n
            if len(lit) < len(fresh):
                kind = (symbol >= 256) & (symbol < 256 + LENGTH_CODES)
                ref = fresh[kind]
                if len(ref):
                    length, n = _prefix_value(symbol[kind] - 256, fetch(ref))
                    pos[ref] += n
                    far, _, n = decode(4, own[kind], fetch(ref))
                    pos[ref] += n
                    far, n = _prefix_value(far, fetch(ref))
                    pos[ref] += n
                    short = np.minimum(far, 120) - 1
                    distance[ref] = np.where(far > 120, far - 120, np.maximum(near_x[short] + near_y[short] * widths[ref], 1))
                    copying[ref] = length
                    if (distance[ref] > i).any():
                        raise BadImage("a back-reference begins before the image")
                kind = symbol >= 256 + LENGTH_CODES
                hit = fresh[kind]
                if len(hit):
                    out[i, hit] = cache[cache_at[hit] + symbol[kind] - 256 - LENGTH_CODES]
        copied = np.flatnonzero(copying[:a])
        if len(copied):
            out[i, copied] = out[i - distance[copied], copied]
            copying[copied] -= 1
        if cached:
            value = out[i, :a]
            slot = (value * np.uint32(CACHE_MULTIPLIER)) >> cache_shift[:a]
            cache[cache_at[:a] + slot] = value
    streams.check()
    for i, x in enumerate(lanes):
        x.pixels, x.end = out[: sizes[i], i].copy(), int(pos[i])


# -- transforms ---------------------------------------------------------------------------------------------------


def _blocks(values: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """Each pixel's value of a sub-sampled image."""
    across = (width + (1 << bits) - 1) >> bits
    return values.reshape(-1, across)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def _mean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x + y) >> 1


#: Predictions by mode from the pixels to the left, above, above to the right and above to the left; channels are the last axis.
MODES = {
    0: lambda left, top, right, corner: np.array([255, 0, 0, 0]),
    1: lambda left, top, right, corner: left,
    2: lambda left, top, right, corner: top,
    3: lambda left, top, right, corner: right,
    4: lambda left, top, right, corner: corner,
    5: lambda left, top, right, corner: _mean(_mean(left, right), top),
    6: lambda left, top, right, corner: _mean(left, corner),
    7: lambda left, top, right, corner: _mean(left, top),
    8: lambda left, top, right, corner: _mean(corner, top),
    9: lambda left, top, right, corner: _mean(top, right),
    10: lambda left, top, right, corner: _mean(_mean(left, corner), _mean(top, right)),
    11: lambda left, top, right, corner: np.where((np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1))[..., None], left, top),
    12: lambda left, top, right, corner: np.clip(left + top - corner, 0, 255),
    13: lambda left, top, right, corner: np.clip(_mean(left, top) + _towards_zero(_mean(left, top) - corner), 0, 255),
}
#: Modes that do not look to the left, so that whole rows go at once.
UPWARD = (0, 2, 3, 4, 8, 9)


def _towards_zero(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -(-x >> 1), x >> 1)


def invert_predictors(images: list[np.ndarray], modes: list[np.ndarray]) -> list[np.ndarray]:
    """Adds predictions to residuals (height, width, ARGB) of images of one width, the highest first.

    Row by row for all images. In a row, modes that only look up are done at once unless what they look at is the row itself (the pixel
    above to the right of the last column is the row's first, which is done by then); the others go pixel by pixel, in all images together.
    """
    heights = np.array([len(x) for x in images])
    width = images[0].shape[1]
    out = np.zeros((len(images), int(heights[0]), width, 4), np.int16)
    kind = np.zeros(out.shape[:3], np.int8)
    for i, (x, m) in enumerate(zip(images, modes, strict=True)):
        out[i, : len(x)], kind[i, : len(x)] = x, np.where(m > 13, 0, m)
    out[:, 0, 0] += np.array([255, 0, 0, 0], np.int16)
    out[:, 0] = np.cumsum(out[:, 0], axis=1) & 255
    upward = np.isin(kind, UPWARD)
    for y in range(1, out.shape[1]):
        k = int((heights > y).sum())
        row, above = out[:k, y], out[:k, y - 1]
        row[:, 0] = (row[:, 0] + above[:, 0]) & 255
        mode = kind[:k, y].copy()
        mode[:, 0] = -1
        beyond = np.concatenate((above[:, 1:], row[:, :1]), axis=1)
        for m in UPWARD:
            who, x = np.nonzero(mode == m)
            if len(who):
                row[who, x] = (row[who, x] + MODES[m](None, above[who, x], beyond[who, x], above[who, x - 1])) & 255
        waiting = np.flatnonzero((~upward[:k, y, 1:]).any(axis=0)) + 1
        for x in waiting.tolist():
            at = mode[:, x]
            for m in np.unique(at).tolist():
                if m not in UPWARD:
                    who = np.flatnonzero(at == m)
                    row[who, x] = (row[who, x] + MODES[m](row[who, x - 1], above[who, x], beyond[who, x], above[who, x - 1])) & 255
    return [out[i, : len(x)].astype(np.uint8) for i, x in enumerate(images)]


def invert_cross_colour(image: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Adds to red what follows from green, then to blue what follows from green and red."""
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int64)
    out = image.astype(np.int64)
    red_to_blue, green_to_blue, green_to_red = (signed(elements >> s & 255) for s in (16, 8, 0))
    green = signed(out[..., 2])
    out[..., 1] = (out[..., 1] + (green_to_red * green >> 5)) & 255
    out[..., 3] = (out[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(out[..., 1]) >> 5)) & 255
    return out.astype(np.uint8)


def invert_subtract_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1] += out[..., 2]
    out[..., 3] += out[..., 2]
    return out


def invert_palette(image: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    """Looks green's indices up; small palettes hold several indices in a byte, lowest bits first. Unknown indices are 0."""
    bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    index = image[..., 2].astype(np.int64)
    if bits:
        each = 8 >> bits
        index = (index[..., None] >> (np.arange(1 << bits) * each) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(colours)] = colours
    return full[index]


def _channels(values: np.ndarray) -> np.ndarray:
    """ARGB values as bytes in that order."""
    return values.astype(">u4").view(np.uint8).reshape(*values.shape, 4)


# -- files --------------------------------------------------------------------------------------------------------


@dataclass
class _Open:
    width: int
    height: int
    transforms: list[tuple] = field(default_factory=list)
    lane: Lane | None = None


def _open(chunk: bytes) -> Generator[Asked, None, _Open]:
    """An image ready for its main lane; yields the lanes of images inside it."""
    bits = Bits(chunk)
    if bits.read(8) != SIGNATURE:
        raise BadImage("no lossless WebP data")
    found = _Open(bits.read(14) + 1, bits.read(14) + 1)
    bits.read(1)
    if bits.read(3):
        raise BadImage("unknown version")
    width, seen = found.width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            inner = yield from read_image(bits, (width + (1 << block) - 1) >> block, (found.height + (1 << block) - 1) >> block)
            found.transforms.append((kind, width, block, inner))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            inner = yield from read_image(bits, n, 1)
            colours = np.cumsum(_channels(inner).astype(np.int64), axis=0).astype(np.uint8)
            found.transforms.append((kind, width, colours))
            per_byte = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            width = (width + (1 << per_byte) - 1) >> per_byte
        else:
            found.transforms.append((kind, width))
    found.lane = yield from read_lane(bits, width, found.height, main=True)
    return found


def _finish(images: list[_Open]) -> list[np.ndarray]:
    """Inverts each image's transforms, the last one first; predictors of many images go together."""
    pixels = [_channels(x.lane.pixels).reshape(x.height, x.lane.width, 4) for x in images]
    for back in range(1, 1 + max((len(x.transforms) for x in images), default=0)):
        predicted: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, x in enumerate(images):
            if back > len(x.transforms):
                continue
            kind, width, *rest = x.transforms[-back]
            if kind == SUBTRACT_GREEN:
                pixels[i] = invert_subtract_green(pixels[i])
            elif kind == PALETTE:
                pixels[i] = invert_palette(pixels[i], rest[0], width)
            elif kind == CROSS_COLOUR:
                pixels[i] = invert_cross_colour(pixels[i], _blocks(rest[1], rest[0], width, x.height))
            else:
                predicted.setdefault(width, []).append((i, _blocks(rest[1], rest[0], width, x.height) >> 8 & 15))
        for group in predicted.values():
            group.sort(key=lambda g: -len(g[1]))
            while group:
                n = max(1, LANE_PIXELS // group[0][1].size)
                for (i, _), done in zip(group[:n], invert_predictors([pixels[i] for i, _ in group[:n]], [m for _, m in group[:n]]), strict=True):
                    pixels[i] = done
                group = group[n:]
    return pixels


def files(data: bytes) -> Iterator[bytes]:
    """The lossless image data of each RIFF file in ``data``, which may hold several in a row."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise BadImage("no WebP file")
        end, inner = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12
        if end > len(data):
            raise BadImage("a file is cut short")
        while inner + 8 <= end and data[inner : inner + 4] != b"VP8L":
            n = int.from_bytes(data[inner + 4 : inner + 8], "little")
            inner += 8 + n + n % 2
        if inner + 8 > end:
            raise BadImage("a file has no lossless image")
        yield data[inner + 8 : inner + 8 + int.from_bytes(data[inner + 4 : inner + 8], "little")]
        at = end


def decode_many(chunks: Iterable[bytes]) -> list[np.ndarray]:
    """The (height, width, ARGB) byte arrays of many images, decoded together."""
    at_work = list(enumerate(_open(c) for c in chunks))
    opened: list[_Open | None] = [None] * len(at_work)
    while at_work:
        asked = []
        for i, reader in at_work:
            try:
                asked.append((i, reader, next(reader)))
            except StopIteration as end:
                opened[i] = end.value
        if codes := [x for _, _, x in asked if isinstance(x, Codes)]:
            run_codes(codes)
        run_lanes([x for _, _, x in asked if isinstance(x, Lane)])
        at_work = [(i, reader) for i, reader, _ in asked]
    run_lanes([x.lane for x in opened])
    return _finish(opened)


# -- writing ------------------------------------------------------------------------------------------------------

LONGEST = 11


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Huffman code lengths, none above ``longest``: counts are flattened until the tree is low enough. A single symbol has length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights, n = [*counts[order].tolist(), math.inf], len(order)
    while True:
        # leaves by rising weight and the inner nodes, which arise by rising weight: the two lightest are at the heads of both queues
        tree, parent, leaf, inner = [math.inf] * n, [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):
            if weights[leaf] <= tree[inner]:
                total, parent[leaf], leaf = weights[leaf], n + k, leaf + 1
            else:
                total, parent[n + inner], inner = tree[inner], n + k, inner + 1
            if weights[leaf] <= tree[inner]:
                total, parent[leaf], leaf = total + weights[leaf], n + k, leaf + 1
            else:
                total, parent[n + inner], inner = total + tree[inner], n + k, inner + 1
            tree[k] = total
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= longest:
            lengths[order] = depth[:n]
            return lengths
        weights = [*((w + 1) // 2 for w in weights[:n]), math.inf]


def code_bits(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code with its first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    if np.count_nonzero(lengths) > 1:
        order, values = canonical(lengths)
        codes[order] = _REVERSED[15][values] >> (15 - lengths[order])
    return codes


class Writer:
    """Collects bit fields, lowest bit first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def put_lengths(w: Writer, lengths: np.ndarray) -> None:
    """Write a prefix code: by its symbol if it has one only, else as run-length coded lengths."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (len(used) == 0 or used[0] < 256):
        w.put(0b101, 3)
        w.put(int(used[0]) if len(used) else 0, 8)
        return
    tokens = _RUNS.findall(lengths[: used[-1] + 1].astype(np.uint8).tobytes())
    symbols = [t[0] if t[0] or len(t) < 3 else 17 if len(t) < 11 else 18 for t in tokens]
    if len(tokens) == 1:
        tokens.append(b"\0")
        symbols.append(0)
    own = code_lengths(np.bincount(symbols, minlength=19), 7)
    if np.count_nonzero(own) == 1:  # a code of one symbol must still be complete
        own[0 if own[0] == 0 else 1] = 1
    # fields as binary numerals, which are joined from the last one to the first
    names = [format(c, f"0{n}b") if n else "" for c, n in zip(code_bits(own).tolist(), own.tolist(), strict=True)]
    parts = [(format(len(t) - 3, "03b") if s == 17 else format(len(t) - 11, "07b") if s == 18 else "") + names[s] for s, t in zip(symbols, tokens, strict=True)]
    ordered = [int(own[i]) for i in LENGTH_ORDER]
    told = max(4, max(i for i, n in enumerate(ordered) if n) + 1)
    w.put(0, 1)
    w.put(told - 4, 4)
    for n in ordered[:told]:
        w.put(n, 3)
    w.put(1, 1)
    wide = max(1, -(-(len(tokens) - 2).bit_length() // 2))  # the number of tokens less 2, in 2 * wide bits
    w.put(wide - 1, 3)
    w.put(len(tokens) - 2, 2 * wide)
    body = "".join(reversed(parts))
    w.put(int(body, 2), len(body))


#: Code lengths are told one by one, but for runs of 3 to 138 zeros.
_RUNS = re.compile(rb"\0{3,138}|(?s:.)")


def pack(values: np.ndarray, sizes: np.ndarray, at: int) -> tuple[bytes, int]:
    """Bit fields (32 bits each at most) in a row from bit ``at`` on, and the end."""
    place = at + np.cumsum(sizes) - sizes
    end = int(place[-1] + sizes[-1])
    shifted = values.astype(np.uint64) << (place & 31).astype(np.uint64)
    word, room = place >> 5, (end >> 5) + 2
    # fields take bits of their own, so sums of 32-bit parts are exact in double precision
    packed = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(float), room) + np.bincount(word + 1, (shifted >> np.uint64(32)).astype(float), room)
    return packed.astype("<u4").tobytes()[: (end + 7) >> 3], end


def riff(chunk: bytes) -> bytes:
    pad = b"\0" * (len(chunk) % 2)
    return b"RIFF" + (12 + len(chunk) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + pad


BLOCK_BITS = 3
#: Predictor modes that the writer tries; bits of the colour cache, and pixels from which on an image may gain by one.
WRITER_MODES = (1, 2, 11, 12)
CACHE_BITS, CACHE_FROM = 8, 1024
#: Shortest back-reference, in pixels, and the longest that the format has.
SHORTEST, FURTHEST_COPY = 3, 4096


def entropy(counts: np.ndarray) -> float:
    """Bits that symbols with these counts take at least."""
    used = counts[counts > 0].astype(float)
    return float(used @ (np.log2(used.sum()) - np.log2(used))) if len(used) else 0.0


def _literal_bits(image: np.ndarray) -> float:
    return sum(entropy(np.bincount(image[..., c].ravel(), minlength=256)) for c in range(4))


def _block_sums(values: np.ndarray) -> np.ndarray:
    """Sums over the last two axes by blocks."""
    step = 1 << BLOCK_BITS
    down = np.add.reduceat(values, np.arange(0, values.shape[-2], step), axis=-2)
    return np.add.reduceat(down, np.arange(0, values.shape[-1], step), axis=-1)


def predictor_modes(image: np.ndarray) -> np.ndarray:
    """For each block the mode that leaves most zeros, or 0 where none leaves them in over half of the samples."""
    x = image.astype(np.int16)
    left, top, corner = (np.zeros_like(x) for _ in range(3))
    left[:, 1:], top[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    half = 3 * _block_sums(np.ones(image.shape[:2], np.int64)) // 2
    zeros = np.stack([_block_sums(((MODES[m](left, top, None, corner) - x)[..., 1:] & 255 == 0).sum(-1)) for m in WRITER_MODES])
    return np.where(zeros.max(axis=0) > half, np.array(WRITER_MODES)[zeros.argmax(axis=0)], 0)


def subtract_prediction(image: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """What the predictor leaves of an image, by a mode for each block."""
    x = image.astype(np.int16)
    out, kind = x.copy(), _blocks(modes, BLOCK_BITS, x.shape[1], x.shape[0])
    left, top, corner = (np.zeros_like(x) for _ in range(3))
    left[:, 1:], top[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    for m in np.unique(kind).tolist():
        at = kind == m
        out[at] -= MODES[m](left[at], top[at], None, corner[at]).astype(np.int16)
    out[:, 0], out[0] = x[:, 0] - top[:, 0], x[0] - left[0]
    out[0, 0] = x[0, 0] - np.array([255, 0, 0, 0])
    return (out & 255).astype(np.uint8)


def colour_elements(image: np.ndarray) -> np.ndarray:
    """For each block the cross-colour multipliers (ARGB values); a channel is taken off another that it equals in half of the pixels."""
    red, green, blue = (image[..., c] for c in (1, 2, 3))
    half = _block_sums(np.ones(image.shape[:2], np.int64))
    same = lambda x, y: 2 * _block_sums((x == y).astype(np.int64)) > half
    on_blue = same(blue, green)
    # a multiplier of 32 is a factor of one
    return (BLACK + (32 * (same(blue, red) & ~on_blue) << 16) + (32 * on_blue << 8) + 32 * same(red, green)).astype(np.int64)


def subtract_colour(image: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """What cross-colour leaves of an image."""
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int64)
    inner = _blocks(elements, BLOCK_BITS, image.shape[1], image.shape[0])
    red_to_blue, green_to_blue, green_to_red = (signed(inner >> s & 255) for s in (16, 8, 0))
    green, red, out = signed(image[..., 2]), signed(image[..., 1]), image.astype(np.int64)
    out[..., 1] -= green_to_red * green >> 5
    out[..., 3] -= (green_to_blue * green >> 5) + (red_to_blue * red >> 5)
    return (out & 255).astype(np.uint8)


def _pays(blocks: np.ndarray) -> bool:
    """Whether enough blocks gain by a transform: a quarter."""
    return 4 * np.count_nonzero(blocks) >= blocks.size


def _values(image: np.ndarray) -> np.ndarray:
    """ARGB values of bytes in that order."""
    return np.ascontiguousarray(image).view(">u4")[..., 0].astype(np.int64)


def back_references(pixels: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Where copies begin, how long they are and how far back their source is; greedily, each from the nearest equal run."""
    n = len(pixels)
    if n <= SHORTEST:
        return [], [], []
    p = pixels.astype(np.uint64)
    key = p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    earlier = np.full(len(key), -1)
    earlier[order[again + 1]] = order[again]
    starts, lengths, distances, at = [], [], [], 0
    for i in np.flatnonzero(earlier >= 0).tolist():
        if i < at:
            continue
        far = i - int(earlier[i])
        size, reach = 0, min(n - i, FURTHEST_COPY)
        while size < reach:  # source and target may overlap: a copy repeats what it writes
            m = min(reach, size + 64 + 7 * size)
            differ = np.flatnonzero(pixels[i + size : i + m] != pixels[i + size - far : i + m - far])
            if len(differ):
                size += int(differ[0])
                break
            size = m
        if size >= SHORTEST:
            starts.append(i)
            lengths.append(size)
            distances.append(far)
            at = i + size
    return starts, lengths, distances


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value of lengths or distances."""
    u = value - 1
    high = np.frexp(np.maximum(u, 1))[1].astype(np.int64) - 1
    extra = np.where(u < 4, 0, high - 1)
    return np.where(u < 4, u, 2 * high + (u >> np.maximum(high - 1, 0) & 1)), extra, u & ((1 << extra) - 1)


def cache_hits(pixels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot in a colour cache, and whether the last pixel with that slot was the same."""
    slot = (pixels * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - bits)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    hit = np.zeros(len(pixels), bool)
    before, after = order[:-1], order[1:]
    hit[after] = (slot[before] == slot[after]) & (pixels[before] == pixels[after])
    return slot, hit


@functools.cache
def _short_codes(width: int) -> dict[int, int]:
    """Distances that a short code names in an image of this width."""
    return {max(x + y * width, 1): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def put_pixels(w: Writer, pixels: np.ndarray, width: int, main: bool) -> bytes | None:
    """Write an entropy-coded image: size of the cache, prefix codes, pixels. The main image ends the data and is returned as such."""
    n = len(pixels)
    starts, lengths, distances = back_references(pixels) if main else ([], [], [])
    # a step is a pixel that is written by itself, or a whole copy
    begun = np.ones(n, bool)
    for at, size in zip(starts, lengths, strict=True):
        begun[at + 1 : at + size] = False
    steps = np.flatnonzero(begun)
    copies = np.searchsorted(steps, starts)
    literal = np.ones(len(steps), bool)
    literal[copies] = False
    blue, green, red, alpha = np.ascontiguousarray(pixels[steps].astype("<u4")).view(np.uint8).reshape(-1, 4).T
    first, cache_bits = green.astype(np.int64), 0
    if main and n >= CACHE_FROM:
        slot, hit = cache_hits(pixels, CACHE_BITS)
        hit = hit[steps] & literal
        plain, slot = literal & ~hit, slot[steps]
        counts = np.bincount(np.where(hit, 256 + slot, first)[literal], minlength=256)
        bill = entropy(counts) + entropy(np.bincount(red[plain])) + entropy(np.bincount(blue[plain]))
        # a symbol of the cache takes about 4 bits in the table of code lengths
        if bill + 4 * np.count_nonzero(counts[256:]) < sum(entropy(np.bincount(c[literal])) for c in (green, red, blue)):
            cache_bits, literal = CACHE_BITS, plain
            first = np.where(hit, 256 + LENGTH_CODES + slot, first)
    w.put(1 | cache_bits << 1, 5) if cache_bits else w.put(0, 1)
    if main:
        w.put(0, 1)  # one group of codes
    # four fields a step: green or cache symbol or length, red or extra bits, blue or distance, alpha or extra bits
    far_symbol = np.zeros(0, np.int64)
    if starts:
        length_symbol, length_extra, length_value = _prefix_of(np.array(lengths))
        short = _short_codes(width)
        far_symbol, far_extra, far_value = _prefix_of(np.array([short.get(d, d + 120) for d in distances]))
        first[copies] = 256 + length_symbol
    alphabets = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    symbols = [first, red[literal], blue[literal], alpha[literal], far_symbol]
    counts = [np.bincount(found, minlength=size) for found, size in zip(symbols, alphabets, strict=True)]
    counts[1] += counts[2]  # red and blue have a code in common
    tables = []
    for k, size in enumerate(alphabets):
        if k == 2:
            told, table = tables_told, tables[1]
        else:
            code, head = code_lengths(counts[k]), Writer()
            put_lengths(head, code)
            told, table = head, (code_bits(code), code if np.count_nonzero(code) > 1 else np.zeros(size, np.int64))
            tables_told = told
        w.put(told.value, told.n)
        tables.append(table)
    fields, sizes = np.zeros((len(steps), 4), np.int64), np.zeros((len(steps), 4), np.int64)
    fields[:, 0], sizes[:, 0] = tables[0][0][first], tables[0][1][first]
    for k in (1, 2, 3):
        if tables[k][1].any():
            fields[literal, k], sizes[literal, k] = tables[k][0][symbols[k]], tables[k][1][symbols[k]]
    if starts:
        fields[copies, 1], sizes[copies, 1] = length_value, length_extra
        fields[copies, 2], sizes[copies, 2] = tables[4][0][far_symbol], tables[4][1][far_symbol]
        fields[copies, 3], sizes[copies, 3] = far_value, far_extra
    value, size = fields.ravel(), sizes.ravel()
    body, end = pack(value, size, w.n)
    body = bytearray(body)
    for i, b in enumerate(w.value.to_bytes((w.n + 7) >> 3, "little")):
        body[i] |= b
    if main:
        return bytes(body)
    w.value, w.n = int.from_bytes(body, "little"), end
    return None


def _put_palette(w: Writer, pixels: np.ndarray, colours: np.ndarray, index: np.ndarray, width: int, height: int) -> tuple[np.ndarray, int]:
    """Write a palette; the pixels of the image that then holds indices, several a pixel if they are few, and its width."""
    w.put(1 | PALETTE << 1, 3)
    w.put(len(colours) - 1, 8)
    own = _channels(colours).astype(np.int64)
    put_pixels(w, _values((np.diff(own, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255).astype(np.uint8)), len(colours), False)
    bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    per, across = 1 << bits, (width + (1 << bits) - 1) >> bits
    rows = np.zeros((height, across * per), np.int64)
    rows[:, :width] = index.reshape(height, width)
    packed = (rows.reshape(height, across, per) << np.arange(per) * (8 >> bits)).sum(-1)
    return (BLACK | packed << 8).ravel(), across


def encode_rgb(data: bytes, width: int) -> bytes:
    """A lossless WebP file of opaque RGB rows.

    A palette is taken if indices and colours cost less than plain samples by their entropy. Else blocks take cross-colour multipliers and
    then a predictor mode where those make most of their samples zero; a transform that less than a quarter of the blocks wants is left out.
    """
    rgb = np.frombuffer(data, np.uint8).reshape(-1, width, 3)
    height = len(rgb)
    image = np.full((height, width, 4), 255, np.uint8)
    image[..., 1:] = rgb
    pixels = _values(image).ravel()
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # opaque, version 0
    choice = None
    if len(set(pixels[:300].tolist())) <= 256 and (colours := np.unique(pixels)).size <= 256:
        index = np.searchsorted(colours, pixels)
        packed = entropy(np.bincount(index)) / (8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2 if len(colours) <= 16 else 1) + 20 * len(colours)
        if packed < _literal_bits(image):
            choice = PALETTE
    modes = elements = None
    if choice is None:
        left = image
        if 8 * max(np.count_nonzero(rgb[..., 0] == rgb[..., 1]), np.count_nonzero(rgb[..., 1] == rgb[..., 2]), np.count_nonzero(rgb[..., 0] == rgb[..., 2])) >= len(pixels):
            elements = colour_elements(image)
            if _pays(elements != BLACK):
                left = subtract_colour(image, elements)
            else:
                elements = None
        if 8 * (np.count_nonzero(pixels[1:] == pixels[:-1]) + np.count_nonzero(pixels[width:] == pixels[:-width])) >= len(pixels):
            modes = predictor_modes(left)
            if not _pays(modes > 0):
                modes = None
    across = width
    if choice == PALETTE:
        pixels, across = _put_palette(w, pixels, colours, index, width, height)
    else:
        if elements is not None:
            w.put(1 | CROSS_COLOUR << 1 | BLOCK_BITS - 2 << 3, 6)
            put_pixels(w, elements.ravel(), elements.shape[1], False)
        if modes is not None:
            w.put(1 | PREDICTOR << 1 | BLOCK_BITS - 2 << 3, 6)
            put_pixels(w, (BLACK | modes << 8).ravel(), modes.shape[1], False)
            left = subtract_prediction(left, modes)
        pixels = _values(left).ravel()
    w.put(0, 1)  # no further transform
    return riff(put_pixels(w, pixels, across, True))


# -- media columns ------------------------------------------------------------------------------------------------

WIDTH, TILE_ROWS = 64, 64
UNIT = 3 * WIDTH
#: Payload bytes that are stored and read back together.
GROUP_BYTES = 24 << 20


def store_bytes(data: bytes, tile_rows: int = TILE_ROWS) -> bytes:
    """Bytes, a positive multiple of ``UNIT`` of them, as lossless WebP files of ``WIDTH`` columns one after the other."""
    if not data or len(data) % UNIT:
        raise ValueError(f"the data is no positive multiple of {UNIT} bytes")
    step = UNIT * tile_rows
    return b"".join(encode_rgb(data[i : i + step], WIDTH) for i in range(0, len(data), step))


#: Pixels of images that are decoded together.
TOGETHER = 1 << 23


def _size(chunk: bytes) -> int:
    """Pixels of an image by its header."""
    head = int.from_bytes(chunk[1:5], "little")
    return ((head & 0x3FFF) + 1) * ((head >> 14 & 0x3FFF) + 1)


def _decoded(chunks: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Images in order, about ``TOGETHER`` pixels of them at a time, which bounds memory however many files a row has."""
    part, pixels = [], 0
    for c in chunks:
        part.append(c)
        pixels += _size(c)
        if pixels >= TOGETHER or len(part) == LANES:
            yield from decode_many(part)
            part, pixels = [], 0
    yield from decode_many(part)


def load_bytes(media: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """What each of ``media`` stores, and its pixel arrays (height, width, RGB)."""
    cut = [list(files(m)) for m in media]
    images = _decoded(c for own in cut for c in own)
    out = []
    for own in cut:
        arrays = [np.ascontiguousarray(next(images)[..., 1:]) for _ in own]
        out.append((b"".join(a.tobytes() for a in arrays), arrays))
    return out


def feature(arrays: list[np.ndarray]) -> str:
    """Size, channel means in thousandths, share of horizontal steps above 32 in thousandths."""
    rows, total, sharp, steps = sum(len(a) for a in arrays), np.zeros(3, np.int64), 0, 0
    for a in arrays:
        total += a.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        change = np.abs(np.diff(a[..., 1].astype(np.int16), axis=1)) > 32
        sharp, steps = sharp + int(change.sum()), steps + change.size
    means = ",".join(str(int(x) * 1000 // (rows * WIDTH)) for x in total)
    return f"{WIDTH}x{rows} mean={means} sharp={sharp * 1000 // max(steps, 1)}"


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(texts: list[str | None]) -> Iterator[tuple]:
    payloads = []
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        payloads.append((len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")))
    media = [store_bytes(p) for _, p in payloads]
    for (n, _), m, (back, arrays) in zip(payloads, media, load_bytes(media), strict=True):
        yield n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(arrays)


def stored_texts(docs: DataFrame, text: str = "text") -> Column:
    """A struct column (``MEDIA``): every whole text as UTF-8, padded with spaces, stored as WebP, read back and described.

    Null and empty texts store one row of spaces. What is stored depends on the text alone, so repeated rows have equal
    values, whatever their ids (null ones too). Rows are taken in groups of about ``GROUP_BYTES``, which bounds memory; a longer text is a group by itself
    and is decoded about ``TOGETHER`` pixels at a time. An empty table gives an empty column; no other column is read, so names cannot clash.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(MEDIA)
    def described(bodies: pd.Series) -> pd.DataFrame:
        from veilframe.llm.webp import _described as run

        rows, group, size = [], [], 0
        for body in bodies:
            group.append(body)
            size += len(body or "") + UNIT
            if size >= GROUP_BYTES:
                rows += run(group)
                group, size = [], 0
        rows += run(group)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MEDIA.split(", ")])

    return described(F.col(text))


def text_media(docs: DataFrame, text: str = "text") -> Column:
    """A binary column with the WebP files of every whole text."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def media(bodies: pd.Series) -> pd.Series:
        from veilframe.llm.webp import UNIT as unit
        from veilframe.llm.webp import store_bytes as store

        return pd.Series([store(raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" ")) for raw in ((x or "").encode("utf-8", "surrogatepass") for x in bodies)], dtype="object")

    return media(F.col(text))


def pixel_arrays(docs: DataFrame, media: str = "media") -> Column:
    """``array<struct<width, height, argb binary>>`` of each row's WebP files; null for null or broken data, empty for empty data."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<width:int,height:int,argb:binary>>")
    def arrays(rows: pd.Series) -> pd.Series:
        from veilframe.llm import webp

        out = []
        for row in rows:
            try:
                out.append(None if row is None else [{"width": a.shape[1], "height": a.shape[0], "argb": a.tobytes()} for a in webp._decoded(webp.files(bytes(row)))])
            except webp.BadImage:
                out.append(None)
        return pd.Series(out, dtype="object")

    return arrays(F.col(media))
