"""Exact term matching, rendering with span maps, and source scanners, for one text at a time.

These routines run inside Arrow UDFs. Offsets are UTF-8 bytes. What a run becomes is remembered by its matcher, and a matcher by its
process (``matcher_for``), since few different runs make up most of a corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa

from veilframe.functions.text import KEYWORDS

_RUN = re.compile(rb"[A-Za-z0-9_]+")
_KEYWORDS = frozenset(k.encode() for k in KEYWORDS)
PROSE = frozenset({"markdown", "plaintext"})
#: Distinct runs that a matcher remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Term:
    raw: str
    normalized: str
    replacement: str
    policy_source: str


def adapt(original: str, replacement: str) -> str:
    """The replacement in the casing of ``original``."""
    base = re.sub("[^A-Za-z0-9_]", "_", replacement)
    if re.search("[A-Za-z]", original):
        if not re.search("[a-z]", original):
            return base.upper()
        if not re.search("[A-Z]", original):
            return base.lower()
    return base[:1].upper() + base[1:] if "A" <= original[:1] <= "Z" else base


@dataclass
class Matcher:
    """Finds all terms in runs that are neither keywords nor protected."""

    terms: list[Term]
    protected: frozenset[str] = frozenset()
    exempt: bool = True
    _seen: dict[bytes, list[tuple[int, int, int, str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._needles = [t.normalized.encode() for t in self.terms]
        self._any = re.compile(b"|".join(map(re.escape, sorted(set(self._needles), key=len)))) if any(self._needles) else None
        self._shielded = frozenset(p.encode() for p in self.protected)

    def hits(self, run: bytes) -> list[tuple[int, int, int]]:
        """``(start, end, term)`` of every term, each searched from left to right without overlaps of its own.

        Underscores do not count; a hit reaches from its first to its last letter, inner underscores included.
        """
        places = [i for i, b in enumerate(run) if b != 0x5F]
        compact = run.replace(b"_", b"").lower()
        if self._any is None or not self._any.search(compact):
            return []
        found = []
        for k, needle in enumerate(self._needles):
            at = compact.find(needle)
            while at >= 0:
                found.append((places[at], places[at + len(needle) - 1] + 1, k))
                at = compact.find(needle, at + len(needle))
        return found

    def selected(self, run: bytes) -> list[tuple[int, int, int, str]]:
        """Hits that stay, with their replacements: by start, the longest first, none that overlaps one that stays."""
        if run in self._seen:
            return self._seen[run]
        kept: list[tuple[int, int, int, str]] = []
        if not (self.exempt and (run in _KEYWORDS or run in self._shielded)):
            end = 0
            for a, b, k in sorted(self.hits(run), key=lambda h: (h[0], h[0] - h[1])):
                if a >= end:
                    kept.append((a, b, k, adapt(run[a:b].decode(), self.terms[k].replacement)))
                    end = b
        if len(self._seen) >= REMEMBERED:
            self._seen.clear()
        self._seen[run] = kept
        return kept

    def cuts(self, raw: bytes, spared: frozenset[bytes] = frozenset()) -> list[tuple[int, int, int, str]]:
        """``(start, end, term, replacement)`` of all selected hits of a text; runs in ``spared`` are left alone as well."""
        known, found = self._seen, []
        for m in _RUN.finditer(raw):
            run = m[0]
            kept = known.get(run)
            if kept is None:
                kept = self.selected(run)
            if kept and run not in spared:
                at = m.start()
                found += [(at + a, at + b, k, new) for a, b, k, new in kept]
        return found

    def replace(self, text: str, spared: frozenset[bytes] = frozenset()) -> str:
        """The text with all selected hits replaced."""
        raw, out, at = text.encode(), [], 0
        for a, b, _, new in self.cuts(raw, spared):
            out += [raw[at:a], new.encode()]
            at = b
        return b"".join([*out, raw[at:]]).decode()

    def render(self, text: str, language: str = "text", spared: frozenset[bytes] = frozenset()) -> tuple[str, list[dict], list[dict]]:
        """The rendered text, its replacements, and spans that tile both texts.

        Unchanged stretches are spans with a null replacement. Line numbers count from 1.
        """
        made = self.render_all([text], [language], [spared]).to_pylist()[0]
        return made["rendered"], made["replacements"], made["spans"]

    def render_all(self, texts: Iterable[str | None], languages: Iterable[str | None], spared: Iterable[frozenset[bytes]] | None = None, whole: bool = True) -> pa.Array:
        """Rows ``(rendered, replacements, spans)`` as Arrow columns, whose values are appended flat; null texts give nulls.

        Without ``whole`` only the lists of replacements are made.
        """
        texts = list(texts)
        spared = spared or [frozenset()] * len(texts)
        rendered: list[str | None] = []
        r_ends, s_ends = np.zeros(len(texts) + 1, np.int32), np.zeros(len(texts) + 1, np.int32)
        categories, originals, aliases, sources, numbers = [], [], [], [], []
        places: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        for i, (text, language, own) in enumerate(zip(texts, languages, spared, strict=True)):
            if text is not None:
                raw = text.encode()
                found = self.cuts(raw, own)
                n = len(found)
                news = [new.encode() for *_, new in found]
                start, end = (np.fromiter((c[k] for c in found), np.int64, n) for k in (0, 1))
                grown = np.fromiter(map(len, news), np.int64, n) - (end - start)
                shift = np.cumsum(grown)
                for a, b, k, new in found:
                    originals.append(raw[a:b].decode())
                    aliases.append(new)
                    sources.append(self.terms[k].policy_source)
                places.append(np.stack([np.arange(n), start, end, start + shift - grown, end + shift], axis=1))
                categories += zones(language or "text", raw, start)
                r_ends[i + 1] = n
                if not whole:
                    continue
                out, at = [], 0
                for (a, b, *_), coded in zip(found, news, strict=True):
                    out += [raw[at:a], coded]
                    at = b
                rendered.append(b"".join([*out, raw[at:]]).decode())
                # spans: what lies before each replacement, the replacement, and what lies behind the last
                edges = np.empty(2 * n + 2, np.int64)
                edges[0], edges[-1], edges[1:-1:2], edges[2:-1:2] = 0, len(raw), start, end
                moved = edges.copy()
                moved[2:-1:2] += shift
                moved[1:-1:2] += shift - grown
                moved[-1] += shift[-1] if n else 0
                kept = np.flatnonzero(np.diff(edges))
                ends_of_lines = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
                # a replacement has no line end on either side
                line = 1 + np.searchsorted(ends_of_lines, edges[kept])
                pieces.append(np.stack([np.where(kept % 2, kept // 2, -1), edges[kept], edges[kept + 1], moved[kept], moved[kept + 1], line], axis=1))
                s_ends[i + 1] = len(kept)
            else:
                rendered.append(None)
        none = pa.array([t is None for t in texts])
        numbers = np.concatenate(places) if places else np.zeros((0, 5), np.int64)
        tiles = np.concatenate(pieces) if pieces else np.zeros((0, 6), np.int64)
        replacements = pa.StructArray.from_arrays(
            [pa.array(numbers[:, 0]), pa.array(categories, pa.string()), pa.array(originals, pa.string()), pa.array(aliases, pa.string()), pa.array(sources, pa.string()), *(pa.array(numbers[:, k]) for k in (1, 2, 3, 4))],
            ["id", "category", "original_text", "sanitized_text", "policy_source", "original_start", "original_end", "sanitized_start", "sanitized_end"],
        )
        listed = lambda e, values: pa.ListArray.from_arrays(pa.array(np.cumsum(e, dtype=np.int32)), values, mask=none)
        if not whole:
            return listed(r_ends, replacements)
        spans = pa.StructArray.from_arrays(
            [pa.array(tiles[:, 0], mask=tiles[:, 0] < 0), *(pa.array(tiles[:, k]) for k in (1, 2, 3, 4)), pa.array(tiles[:, 5]), pa.array(tiles[:, 5])],
            ["replacement_id", "original_start", "original_end", "sanitized_start", "sanitized_end", "original_line_start", "sanitized_line_start"],
        )
        return pa.StructArray.from_arrays([pa.array(rendered, pa.string()), listed(r_ends, replacements), listed(s_ends, spans)], ["rendered", "replacements", "spans"])


class Placed(Matcher):
    """Renders replacements that are given by place instead of found: each text's ``(start, end, source, replacement)`` in order."""

    def __init__(self, sources: list[str], given: list[list[tuple[int, int, int, str]]]) -> None:
        super().__init__([Term("", "", "", s) for s in sources])
        self._given = iter(given)

    def cuts(self, raw: bytes, spared: frozenset[bytes] = frozenset()) -> list[tuple[int, int, int, str]]:
        return next(self._given)


@lru_cache(maxsize=16)
def matcher_for(terms: tuple[Term, ...], protected: frozenset[str] = frozenset(), exempt: bool = True) -> Matcher:
    """One matcher a process for each policy, so that what it has seen is kept from one Arrow batch to the next."""
    return Matcher(list(terms), protected, exempt)


def zones(language: str, raw: bytes, at: np.ndarray) -> list[str]:
    """``comment``, ``string_literal`` or ``identifier`` for each offset."""
    strings = string_ranges(language, raw) if len(at) else []
    comments = comment_ranges(language, raw, strings) if len(at) else []

    def inside(ranges: list[tuple[int, int]]) -> np.ndarray:
        if not ranges:
            return np.zeros(len(at), bool)
        bounds = np.array(ranges)
        k = np.searchsorted(bounds[:, 0], at, side="right") - 1
        return (k >= 0) & (at < bounds[np.maximum(k, 0), 1])

    return np.where(inside(comments), "comment", np.where(inside(strings), "string_literal", "identifier")).tolist()


def within(ranges: list[tuple[int, int]], at: int) -> bool:
    """Whether sorted, disjoint ranges hold an offset."""
    i = bisect_right(ranges, (at, 1 << 62)) - 1
    return i >= 0 and ranges[i][0] <= at < ranges[i][1]


_ESCAPED = {q: re.compile(rb"(?s)(?:\\.|[^\\" + q + (b"" if q == b"`" else rb"\n") + rb"])*") for q in (b'"', b"'", b"`")}
_QUOTES = {"rust": b'"', "go": b'"`', "typescript": b"\"'`", "javascript": b"\"'`", "json": b'"'}


def string_ranges(language: str, raw: bytes) -> list[tuple[int, int]]:
    """The insides of string literals. Prose, and code of unknown language, has none. A plain literal ends at its quote; one that meets the line's end
    first is none, and reading goes on at that line end. Python's triple quotes and Go's raw strings may span lines.
    """
    if language in PROSE or language == "text":
        return []
    opening = re.compile(b"[" + _QUOTES.get(language, b"\"'") + b"]")
    found, at = [], 0
    while m := opening.search(raw, at):
        quote, start = m[0], m.end()
        if language == "python" and raw.startswith(quote * 3, m.start()):
            end = raw.find(quote * 3, start + 2)
            if end < 0:
                found.append((start + 2, len(raw)))
                break
            found.append((start + 2, end))
            at = end + 3
        elif language == "go" and quote == b"`":
            end = raw.find(quote, start)
            end = len(raw) if end < 0 else end
            found.append((start, end))
            at = end + 1
        else:
            end = _ESCAPED[quote].match(raw, start).end()
            if raw[end : end + 1] == quote:
                found.append((start, end))
                at = end + 1
            else:
                at = max(end, start)
    return found


_LINE_COMMENTS = {"rust": b"//", "typescript": b"//", "javascript": b"//", "go": b"//", "c": b"//", "text": b"//|#", "python": b"#", "shell": b"#", "yaml": b"#"}
_BLOCKS = frozenset({"rust", "typescript", "javascript", "go", "c"})


def comment_ranges(language: str, raw: bytes, strings: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What stands after comment markers outside strings; prose is one comment."""
    if language in PROSE:
        return [(0, len(raw))]
    if language not in _LINE_COMMENTS:
        return []
    marker = re.compile(_LINE_COMMENTS[language] + (rb"|/\*" if language in _BLOCKS else b""))
    found, at = [], 0
    while m := marker.search(raw, at):
        if within(strings, m.start()):
            at = m.start() + 1
            continue
        end = raw.find(b"*/", m.end()) if m[0] == b"/*" else raw.find(b"\n", m.end())
        end = len(raw) if end < 0 else end
        found.append((m.end(), end))
        at = min(len(raw), end + 2 if m[0] == b"/*" else end)
    return found


# Words that make what follows public or foreign (fixed values).
_IMPORTS = frozenset((b"use", b"import", b"from", b"require", b"package", b"include", b"using"))
_MARKERS = _IMPORTS | frozenset((b"mod", b"pub", b"export", b"crate", b"extern"))


def protected_names(text: str, language: str) -> set[str]:
    """Names of public declarations and imports, and dunders, from code outside comments and strings.

    A line whose first two code runs hold a marker protects all its code runs (on import lines those in strings too);
    elsewhere a marker protects the next four code runs of its line. Prose protects nothing.
    """
    if language in PROSE:
        return set()
    raw = text.encode()
    strings = string_ranges(language, raw)
    comments = comment_ranges(language, raw, strings)
    names: set[bytes] = set()
    start = 0
    for line in raw.splitlines(keepends=True) if b"\r" not in raw else re.findall(rb"[^\n]*\n|[^\n]+", raw):
        found = [(m[0], within(comments, start + m.start()), within(strings, start + m.start())) for m in _RUN.finditer(line)]
        start += len(line)
        code = [r for r, c, s in found if not c and not s]
        lead = code[:2]
        if any(r in _MARKERS for r in lead):
            imports = any(r in _IMPORTS for r in lead)
            names.update(r for r, c, s in found if r not in _KEYWORDS and ((not c and not s) or (imports and not c)))
        for i, r in enumerate(code):
            if r not in _KEYWORDS and (r.startswith(b"__") or any(x in _MARKERS for x in code[max(0, i - 4) : i])):
                names.add(r)
    return {n.decode() for n in names}


def external_names(text: str, language: str) -> set[str]:
    """Names that imports, angle-bracket includes and extern declarations bring from outside; relative imports are local."""
    if language in PROSE:
        return set()
    names: set[bytes] = set()
    for line in text.encode().splitlines():
        line = line.strip()
        bare = line.replace(b"'", b"").replace(b'"', b"")
        if m := re.match(rb"#(?:include|import)\s*<([^>]*)>", line):
            part = m[1]
        elif m := re.match(rb"(?:@import|extern) (.*)", line):
            part = m[1]
        elif not re.match(rb"(?:import|from|package|use) |require\(", line) or b"from ." in bare or b"require(." in bare or re.match(rb"use (?:crate|self|super)", bare):
            continue
        else:
            part = line
        names.update(r for r in _RUN.findall(part) if r not in _KEYWORDS)
    return {n.decode() for n in names}


def masked_comments(text: str, language: str) -> str:
    """The text with comment bytes blanked, line ends kept."""
    raw = bytearray(text.encode())
    for a, b in comment_ranges(language, bytes(raw), string_ranges(language, bytes(raw))):
        raw[a:b] = bytes(c if c in b"\r\n" else 32 for c in raw[a:b])
    return raw.decode()


def changed_range(old: str, new: str) -> tuple[int, int]:
    """Bytes of ``old`` between the longest common prefix and then suffix, in whole characters."""
    n = 0
    for a, b in zip(old, new, strict=False):
        if a != b:
            break
        n += 1
    start = len(old[:n].encode())
    k = 0
    while k < min(len(old), len(new)) - n and old[-1 - k] == new[-1 - k]:
        k += 1
    return start, len(old.encode()) - len(old[len(old) - k :].encode())
