"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 10).

The patterns find the plain forms (``base_spans``); the field then adds spans elsewhere in the text: more spellings of the same kinds
(``KINDS``), and further kinds (``MORE_KINDS``): bank accounts, national numbers, hardware addresses, secrets such as keys, tokens and passwords. It scores whole
candidate segments by features of the span as a whole (its digits, their grouping, separators, check digits, alphabet,
what stands beside it), and dynamic programming over the tokens picks boundaries and kinds together. Weights come from maximum
likelihood on generated lines (``learn``), in which all kinds in many spellings stand among dates, versions, amounts, order
numbers, file names and identifiers. Spans of the patterns are barriers: the field never touches them.

A segment is as long as its kind can be: a number of at most 15 or 19 digits with a separator or two after each, one run of key characters, one
match of a kind's shape. So every text takes time linear in its length.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import ship

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "id", "mac", "secret")
EVERY_KIND = KINDS + MORE_KINDS
#: Digits and tokens that a card or phone number has at most: each digit a token, one separator between those of a card, two between those of a phone.
CARD_DIGITS, PHONE_DIGITS = 19, 15
CARD_TOKENS, PHONE_TOKENS = 2 * CARD_DIGITS - 1, 3 * PHONE_DIGITS
#: Tokens of an address of 254 characters, the most that one may have.
EMAIL_TOKENS = 254
SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"

# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ , looked up from each @ so that no text takes quadratic time
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match of the ip pattern can only begin where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@=]")
# Shapes of the kinds that are no numbers in groups; the field judges what they match.
_HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|@)[A-Za-z0-9-]{1,63}+(?:(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?)[A-Za-z0-9-]{1,63}+)+", re.IGNORECASE)
_SHAPES = {
    "email": _HIDDEN,
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "mac": re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "id": re.compile(r"(?<![0-9A-Za-z])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_~])(?=[A-Za-z0-9+/_])[A-Za-z0-9+/_~.-]{8,}+={0,2}"),
}
_NAMED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|private.?key|auth(?:orization)?|bearer|credentials?|key)[\"']?\s?(?:[:=]|is)?\s?[\"']?$", re.IGNORECASE)
_KEY_PREFIX = re.compile(r"AKIA|ASIA|gh[opsu]_|github_pat_|sk[-_]|pk[-_]|rk_|xox[abprs]-|AIza|eyJ|glpat-|npm_|SG\.|hf_|ya29\.")
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|(?s:.)")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # a later match cannot hold this @
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind, then by start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


class Region:
    """A stretch of neighbouring chunks with an anchor as tokens, and its candidate segments."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self.spans = [m.span() for m in _TOKEN.finditer(text, start, end)]

    def candidates(self) -> Iterator[tuple[int, int, str]]:
        """``(first token, token after the last, kind)``."""
        words = [self.text[a:b] for a, b in self.spans]
        yield from self._shaped()
        for i, w in enumerate(words):
            digit = w[0] in "0123456789"
            if digit or w in "+(":
                yield from self._numbers(words, i, digit)
            if (digit or w[0] in _LOCAL) and (i == 0 or words[i - 1][0] not in _LOCAL):
                at = None
                for j in range(i, min(i + EMAIL_TOKENS, len(words))):
                    x = words[j]
                    if x == "@" and at is None and j > i:
                        at = j
                    elif at is not None and j > at + 1 and x.isascii() and x.isalpha():
                        yield i, j + 1, "email"
                    elif x[0] not in _LOCAL:
                        break

    def _numbers(self, words: list[str], i: int, digit: bool) -> Iterator[tuple[int, int, str]]:
        """Cards, phones and dotted addresses from token ``i`` on; none that goes on beside it with the same separator and a group as long as one inside."""
        n, dots, sizes, inside = 0, 0, [], ["", ""]
        before = (words[i - 1], len(words[i - 2])) if i > 1 and words[i - 1] in " .-/" and words[i - 2][0] in "0123456789" else None
        for j in range(i, min(i + PHONE_TOKENS, len(words))):
            x = words[j]
            if x[0] in "0123456789":
                n += len(x)
                if n > CARD_DIGITS:
                    return
                if sizes:
                    inside = [inside[0] or words[j - 1], words[j - 1]]
                sizes.append(len(x))
                if n < 7 and len(sizes) < 4:
                    continue
                if before and before[0] == (inside[0] or before[0]) and before[1] in sizes:
                    return
                if j + 2 < len(words) and words[j + 1] in " .-/" and words[j + 1] == (inside[1] or words[j + 1]) and words[j + 2][0] in "0123456789" and len(words[j + 2]) in sizes:
                    continue
                if 7 <= n <= PHONE_DIGITS and (i == 0 or words[i - 1] != "+"):
                    yield i, j + 1, "phone"
                if digit and n >= 13 and j - i < CARD_TOKENS:
                    yield i, j + 1, "card"
                if digit and len(sizes) == 4 and dots == 3 and j == i + 6:
                    yield i, j + 1, "ip"
            elif len(x) == 1 and (x in " ().-/" or (x == "+" and j == i)):
                dots += x == "."
            else:
                return

    def _shaped(self) -> Iterator[tuple[int, int, str]]:
        """Matches of the kinds' shapes that begin and end with tokens."""
        place = after = None
        for kind, shape in _SHAPES.items():
            for m in shape.finditer(self.text, self.start, self.end):
                a, b = m.span()
                if kind == "secret":
                    while b > a and self.text[b - 1] in ".-_":
                        b -= 1
                    # mixed alphabets or many digits; words and plain numbers are no keys
                    if b - a < 8 or not any(c.isalpha() for c in self.text[a:b]) or not _DIGIT.search(self.text, a, b):
                        continue
                if place is None:
                    place, after = {x: k for k, (x, _) in enumerate(self.spans)}, {y: k + 1 for k, (_, y) in enumerate(self.spans)}
                if a in place and b in after:
                    yield place[a], after[b], kind

    def features(self, i: int, j: int, kind: str) -> list[str]:
        """Of the whole span: digits, grouping, separators, alphabet, checks, and what stands beside it."""
        start, end = self.spans[i][0], self.spans[j - 1][1]
        span = self.text[start:end]
        before = self.text[start - 1] if start else ""
        after = self.text[end] if end < len(self.text) else ""
        named = ["bias", f"before={_side(before)}", f"after={_side(after)}"]
        if kind == "secret":
            return [f"{kind}|{x}" for x in named + _key_features(span, self.text[max(0, start - 32) : start])]
        digits = _digits(span)
        groups = [len(x) for x in _GROUPS.findall(span)]
        separators = "".join(sorted(set(_SEPARATORS.findall(span))))
        named.append(f"separators={separators}")
        if kind not in ("email", "iban", "mac") and ":" not in span:
            named.append(f"groups={'.'.join(map(str, groups[:6]))}")
        if kind in ("phone", "card"):
            named += [f"digits={len(digits)}", f"plus={span[0] == '+'}", f"paren={'(' in span and ')' in span and span.count('(') == span.count(')')}", f"even={len(set(groups[:-1])) <= 1}"]
        if kind == "card":
            named.append(f"luhn={luhn(digits)}")
        if kind == "ip":
            named.append(f"six={_ipv6(span)}" if ":" in span else f"octets={all(map(_octet, span.split('.')))}")
        if kind == "email":
            named += [f"tld={min(len(span) - span.rfind('.') - 1, 8) if '.' in span[span.find('@') :] else 0}", f"hidden={'@' not in span}"]
        if kind == "iban":
            named.append(f"check={_iban(span)}")
        if kind == "id":
            named.append(f"issued={span[:3] not in ('000', '666') and span[0] != '9' and span[4:6] != '00' and span[7:] != '0000'}")
        return [f"{kind}|{x}" for x in named]


_GROUPS, _SEPARATORS = re.compile(r"[0-9]+"), re.compile(r"[^0-9A-Za-z]")


def _ipv6(span: str) -> bool:
    parts = span.split(":")
    return span.count("::") <= 1 and ":::" not in span and (len(parts) == 8 and all(parts) or "::" in span and len(parts) <= 8)


def _iban(span: str) -> bool:
    """Whether the remainder of an account number by 97 is 1."""
    plain = span.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _key_features(span: str, context: str) -> list[str]:
    n, digits = len(span), len(_digits(span))
    kinds = "".join(k for k, x in (("u", any("A" <= c <= "Z" for c in span)), ("l", any("a" <= c <= "z" for c in span)), ("s", any(not c.isalnum() for c in span))) if x)
    alphabet = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) else "uuid" if re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", span) else kinds
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    length = next((x for x in (10, 12, 16, 20, 24, 32, 40, 64) if n <= x), 99)
    named, prefix = bool(_NAMED.search(context)), bool(_KEY_PREFIX.match(span))
    mixed = "low" if turns * 8 < n else "some" if turns * 4 < n else "high"
    return [f"length={length}", f"alphabet={alphabet}", f"digits={4 * digits // n}", f"mixed={mixed}", f"named={named}", f"prefix={prefix}", f"named={named} long={n >= 16} mixed={mixed}", f"prefix={prefix} long={n >= 16}", f"dots={min(span.count('.'), 3)}", f"cuts={min(span.count('-') + span.count('_') + span.count('/'), 4)}"]


def _side(c: str) -> str:
    return "edge" if not c or c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in ".,:;-/#@+()" else "other"


_BRACKETED = re.compile(r"[\[({]\s?(?:at|dot|@|\.)\s?[\])}]", re.IGNORECASE)


def regions(text: str, barriers: list[tuple[int, int]]) -> Iterator[Region]:
    """Neighbouring chunks with an anchor, cut at the barriers."""
    # chunks of these need no anchor of their own
    hidden = [m.span() for m in _HIDDEN.finditer(text)] if _BRACKETED.search(text) else []
    hidden = deque(sorted(hidden + [m.span() for m in _SHAPES["iban"].finditer(text)]))
    if not hidden and not _ANCHOR.search(text):
        return
    walls, k = sorted(barriers), 0
    start = end = None
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        while hidden and hidden[0][1] <= a:
            hidden.popleft()
        if not (hidden and hidden[0][0] < b) and not _ANCHOR.search(text, a, b):
            continue
        pieces = []
        while k < len(walls) and walls[k][1] <= a:
            k += 1
        at, q = a, k
        while q < len(walls) and walls[q][0] < b:
            if walls[q][0] > at:
                pieces.append((at, walls[q][0]))
            at = max(at, walls[q][1])
            q += 1
        if at < b:
            pieces.append((at, b))
        for x, y in pieces:
            if end is not None and x == end + 1 and text[end] == " ":
                end = y
            else:
                if end is not None:
                    yield Region(text, start, end)
                start, end = x, y
    if end is not None:
        yield Region(text, start, end)


Weights = dict[str, float]


def _lattice(region: Region) -> dict[int, list[tuple[int, str, list[str]]]]:
    """Candidate segments by the token after their last one."""
    ending = defaultdict(list)
    for i, j, kind in region.candidates():
        ending[j].append((i, kind, region.features(i, j, kind)))
    return ending


def decode(region: Region, weights: Weights) -> list[tuple[str, int, int]]:
    """The best segmentation's spans; a token outside any span scores 0, and wins ties."""
    ending = _lattice(region)
    if not ending:
        return []
    n = len(region.spans)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, names in ending.get(j, ()):
            score = best[i] + sum(weights.get(x, 0.0) for x in names)
            if score > best[j]:
                best[j], back[j] = score, (i, kind)
    found, j = [], n
    while j > 0:
        if back[j]:
            i, kind = back[j]
            found.append((kind, region.spans[i][0], region.spans[j - 1][1]))
            j = i
        else:
            j -= 1
    return found[::-1]


def _log_add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def _gradient(region: Region, gold: set[tuple[int, int, str]], weights: Weights) -> Weights:
    """Observed less expected features of a line's segmentation."""
    ending, n = _lattice(region), len(region.spans)
    scored = {j: [(i, kind, names, sum(weights[x] for x in names)) for i, kind, names in c] for j, c in ending.items()}
    ahead = [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for i, _, _, s in scored.get(j, ()):
            ahead[j] = _log_add(ahead[j], ahead[i] + s)
    rest = [-math.inf] * (n + 1)
    rest[n] = 0.0
    for j in range(n, 0, -1):
        rest[j - 1] = _log_add(rest[j - 1], rest[j]) if rest[j - 1] > -math.inf else rest[j]
        for i, _, _, s in scored.get(j, ()):
            rest[i] = _log_add(rest[i], rest[j] + s) if rest[i] > -math.inf else rest[j] + s
    change: Weights = defaultdict(float)
    for j, segments in scored.items():
        for i, kind, names, s in segments:
            p = (((i, j, kind) in gold) - math.exp(ahead[i] + s + rest[j] - ahead[n]))
            for x in names:
                change[x] += p
    return change


def _line(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated line and the spans in it."""
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    number = lambda n: pick("0123456789", n)
    letters, hexadecimal = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    capitals = letters.upper() + "234567"
    word = lambda: pick(letters, r.randint(2, 9))
    base62 = letters + letters.upper() + "0123456789"

    def card() -> str:
        body = r.choice("3456") + number(r.choice((13, 14, 14, 14)))
        body += next(d for d in "0123456789" if luhn(body + d))
        if r.random() < 0.1:
            return r.choice(" -").join(body)
        sep = r.choice(("", " ", "-", ".", "/"))
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        area, mid, last = number(3), number(3), number(4)
        return r.choice((f"({area}) {mid}-{last}", f"({area}){mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}", f"+{number(2)} {number(2)} {number(4)} {number(4)}", f"+1 ({area}) {mid}-{last}", f"1-{area}-{mid}-{last}", f"+{number(2)}/{number(3)}/{number(6)}", f"0{number(3)} {number(7)}", f"0{number(2)}/{number(7)}", "-".join(area + mid + last)))

    def mail() -> str:
        at = r.choice((" [at] ", "[at]", " (at) ", "(at)", " {at} ", " [AT] "))
        dot = r.choice((".", ".", " [dot] ", "(dot)", " (dot) "))
        host = f"{word()}{dot}{r.choice(('com', 'org', 'net', 'example'))}"
        return f"{word()}{r.choice(('', '.' + word(), number(2)))}{r.choice(('@', '@', at))}{host}" if r.random() < 0.7 else f"{word()}{at}{host}"

    def ip() -> str:
        if r.random() < 0.6:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        groups = [pick(hexadecimal, r.randint(1, 4)) for _ in range(8)]
        keep = r.randint(1, 4)
        return ":".join(groups) if r.random() < 0.5 else ":".join(groups[:keep]) + "::" + ":".join(groups[keep : keep + r.randint(1, 3)])

    def iban() -> str:
        country, body = r.choice(("DE", "FR", "GB", "ES", "NL", "AT", "IT")), number(r.choice((14, 16, 18, 20)))
        if r.random() < 0.3:
            body = pick(letters.upper(), 4) + body[4:]
        rest = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{rest:02}{body}"
        return whole if r.random() < 0.4 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def key() -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what stands behind it."""
        name = r.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "API_KEY", "access_key", "client_secret", "auth_token", "private key", "Bearer", "SECRET_KEY"))
        join = r.choice(("=", "=", ": ", " = ", ":", " is "))
        quote = r.choice(("", "", '"', "'"))
        value = r.choice((pick(hexadecimal, r.choice((16, 18, 20, 32, 40, 64))), pick(base62, r.randint(12, 44)), f"{word()}{number(r.randint(2, 5))}{pick(base62, 4)}", pick(base62 + "+/", 40) + "="))
        known = r.choice(("AKIA" + pick(capitals, 16), "ASIA" + pick(capitals, 16), "ghp_" + pick(base62, 36), "sk-" + pick(base62, 32), "xoxb-" + number(12) + "-" + pick(base62, 24), "AIza" + pick(base62, 35), "eyJ" + pick(base62, 20) + "." + pick(base62, 30) + "." + pick(base62, 30)))
        if r.random() < 0.4:
            return r.choice(("", "", f"{name}{join}")), known, ""
        return f"{name}{' ' if name == 'Bearer' else join}{quote}", value, quote

    makers = {
        "email": mail, "ip": ip, "card": card, "phone": phone, "iban": iban, "secret": key,
        "id": lambda: f"{r.randint(1, 665):03}{(c := r.choice('-- '))}{r.randint(1, 99):02}{c}{r.randint(1, 9999):04}", "mac": lambda: r.choice(":-").join(pick(r.choice((hexadecimal, hexadecimal.upper())), 2) for _ in range(6)),
    }
    plain = (
        lambda: number(r.randint(1, 12)), lambda: f"{r.randint(1900, 2099)}", lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2099)}",
        lambda: f"{r.randint(0, 23)}:{number(2)}", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: ".".join(number(1) for _ in range(r.randint(2, 3))), lambda: f"{number(3)}.{number(2)}", lambda: f"{number(3)},{number(3)}", lambda: f"{word()}{number(3)}", lambda: number(r.randint(13, 24)),
        lambda: f"{number(5)}-{number(4)}", lambda: " ".join(number(r.randint(1, 6)) for _ in range(r.randint(2, 5))), lambda: "-".join(number(r.randint(1, 5)) for _ in range(5)), lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"@{word()}", lambda: f"{r.choice(('', '+'))}{number(r.randint(1, 6))}",
        lambda: f"{number(r.randint(1, 4))}/{number(r.randint(1, 4))}/{number(r.randint(2, 4))}", lambda: f"{number(4)}-{number(4)}", lambda: f"{word()}={r.choice((word(), number(2)))}", lambda: f"{word()}_{word()}_{number(4)}.{r.choice(('pdf', 'txt', 'csv', 'py'))}", lambda: f"{word()}{word().title()}{number(1)}", lambda: f"{pick(letters.upper(), 3)}-{number(5)}",
        lambda: f"https://{word()}.{r.choice(('org', 'com'))}/{word()}/{number(r.randint(1, 4))}/{word()}", lambda: f"{word()}-{number(4)}-{word()}-{word()}", lambda: f"v{number(1)}.{number(1)}.{number(1)}-{r.choice(('rc1', 'beta2', 'alpha'))}", lambda: f"commit {pick(hexadecimal, r.choice((7, 8, 40)))}", lambda: f"{r.choice(('the key is', 'token', 'password:', 'secret'))} {word()}",
        lambda: f"0x{pick(hexadecimal, r.choice((2, 4, 8)))}", lambda: f"{number(1)}st {word()}{number(1)}", lambda: f"{word()}/{word()}{number(2)}/{word()}.html", lambda: f"{pick(letters.upper(), 2)}{number(2)} {word()}", lambda: f"sha256:{pick(hexadecimal, 64)}", lambda: "-".join(pick(hexadecimal, n) for n in (8, 4, 4, 4, 12)),
    )
    text, spans = "", []
    for _ in range(r.randint(2, 5)):
        text += word() + r.choice((" ", " ", ", ", ": ", " #"))
        behind = ""
        if r.random() < 0.5:
            kind = r.choice(EVERY_KIND)
            made = makers[kind]()
            if kind == "secret":
                ahead, made, behind = made
                text += ahead
            spans.append((kind, len(text), len(text) + len(made)))
        else:
            made = r.choice(plain)()
        text += made + behind + r.choice((" ", ". ", ", ", "; "))
    return text, spans


@functools.cache
def learn(lines: int = 2000, epochs: int = 5, seed: int = 11, rate: float = 0.25, decay: float = 1e-3) -> Weights:
    """Weights by stochastic gradient ascent on generated lines; the same arguments give the same weights."""
    r = random.Random(seed)
    data = []
    for _ in range(lines):
        text, spans = _line(r)
        for region in regions(text, []):
            place = {a: i for i, (a, _) in enumerate(region.spans)}
            after = {b: i + 1 for i, (_, b) in enumerate(region.spans)}
            data.append((region, {(place[a], after[b], k) for k, a, b in spans if a in place and b in after}))
    weights: Weights = defaultdict(float)
    for epoch in range(epochs):
        r.shuffle(data)
        for region, gold in data:
            for x, g in _gradient(region, gold, weights).items():
                weights[x] += rate / (1 + epoch) * (g - decay * weights[x])
    return dict(weights)


def find_spans(text: str | None, weights: Weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the patterns, and those that the field adds; both by kind, then by start."""
    text = text or ""
    base = base_spans(text)
    added = [s for region in regions(text, [(a, b) for _, a, b in base]) for s in decode(region, weights)]
    return base, sorted(added, key=lambda s: (EVERY_KIND.index(s[0]), s[1]))


def pii_spans(docs: DataFrame, text: str = "text", weights: Weights | None = None) -> Column:
    """A column ``struct<base, added>`` of span arrays with code-point offsets; null texts count as empty.

    Equal texts and repeated rows get equal spans. A very long text is one row's work, in time linear in its length; an empty table gives an empty
    column, and no column but the text is read, so names cannot clash. Ties between segmentations go to the one that ends first.
    """
    ship(docs.sparkSession)
    known = weights if weights is not None else learn()

    @F.pandas_udf(f"struct<base:{SPAN_TYPE},added:{SPAN_TYPE}>")
    def spans(bodies: pd.Series) -> pd.DataFrame:
        both = [find_spans(x, known) for x in bodies]
        as_rows = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]
        return pd.DataFrame({"base": [as_rows(x) for x, _ in both], "added": [as_rows(x) for _, x in both]})

    return spans(F.col(text))


def redact(text: str | None, weights: Weights) -> str | None:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    base, added = find_spans(text, weights)
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", weights: Weights | None = None) -> Column:
    """A column with the redacted text; null stays null."""
    ship(docs.sparkSession)
    known = weights if weights is not None else learn()

    @F.pandas_udf("string")
    def clean(bodies: pd.Series) -> pd.Series:
        return pd.Series([redact(x, known) for x in bodies], dtype="object")

    return clean(F.col(text))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by kind and start, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, EVERY_KIND)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
