"""Builds lossless WebP streams with every feature of the format, one bit field after the other."""

import numpy as np

from veilframe.llm import webp


def put_codes(w, tokens, cache_bits, group_of):
    """Writes the prefix codes of all groups and then the tokens.

    Tokens: ("lit", argb), ("ref", length symbol, extra bits, extra value, distance symbol, extra bits, extra value), ("hit", index).
    ``group_of`` gives each token's group.
    """
    groups = max(group_of) + 1
    alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in alphabets] for _ in range(groups)]
    for t, g in zip(tokens, group_of, strict=True):
        c = counts[g]
        if t[0] == "lit":
            a, r, gr, b = t[1] >> 24, t[1] >> 16 & 255, t[1] >> 8 & 255, t[1] & 255
            c[0][gr] += 1
            c[1][r] += 1
            c[2][b] += 1
            c[3][a] += 1
        elif t[0] == "ref":
            c[0][256 + t[1]] += 1
            c[4][t[4]] += 1
        else:
            c[0][280 + t[1]] += 1
    codes = []
    for g in range(groups):
        own = []
        for n in counts[g]:
            lengths = webp.code_lengths(n)
            used = np.flatnonzero(lengths)
            if len(used) == 1 and used[0] >= 256:  # a single symbol beyond 8 bits cannot be named: give it a neighbour
                lengths[0] = 1
            webp.put_lengths(w, lengths)
            own.append((webp.code_bits(lengths).tolist(), lengths.tolist() if np.count_nonzero(lengths) > 1 else [0] * len(lengths)))
        codes.append(own)
    for t, g in zip(tokens, group_of, strict=True):
        put = lambda k, s: w.put(codes[g][k][0][s], codes[g][k][1][s])  # noqa: B023, E731
        if t[0] == "lit":
            for k, s in ((0, t[1] >> 8 & 255), (1, t[1] >> 16 & 255), (2, t[1] & 255), (3, t[1] >> 24)):
                put(k, s)
        elif t[0] == "ref":
            put(0, 256 + t[1])
            w.put(t[3], t[2])
            put(4, t[4])
            w.put(t[6], t[5])
        else:
            put(0, 280 + t[1])


def put_image(w, pixels, cache_bits=0):
    """A sub-image of literals."""
    w.put(0, 1) if not cache_bits else w.put(1 | cache_bits << 1, 5)
    put_codes(w, [("lit", int(p)) for p in pixels], cache_bits, [0] * len(pixels))


def start(width, height):
    w = webp.Writer()
    w.put(webp.SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 4)
    return w


def finish(w, pixels_or_tokens, cache_bits=0, groups=None):
    """No further transform, then the main image; ``groups``: (block bits, entropy image values, group of each token)."""
    w.put(0, 1)
    w.put(1 | cache_bits << 1, 5) if cache_bits else w.put(0, 1)
    tokens = [t if isinstance(t, tuple) else ("lit", int(t)) for t in pixels_or_tokens]
    if groups:
        bits, values, group_of = groups
        w.put(1, 1)
        w.put(bits - 2, 3)
        put_image(w, [0xFF000000 | v << 8 for v in values])
    else:
        w.put(0, 1)
        group_of = [0] * len(tokens)
    put_codes(w, tokens, cache_bits, group_of)
    return w.value.to_bytes((w.n + 7) // 8, "little")


def argb(image):
    return [int.from_bytes(bytes(p), "big") for p in image.reshape(-1, 4)]
