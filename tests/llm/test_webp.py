import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import webp_streams as S
from veilframe.llm import queries, webp


def random_image(seed, height, width, low=0, high=256):
    return np.random.default_rng(seed).integers(low, high, (height, width, 4), dtype=np.uint8)


def test_literals_with_alpha_in_lockstep():
    images = [random_image(i, 1 + i % 7, 3 + 5 * i % 11) for i in range(12)]
    chunks = [S.finish(S.start(x.shape[1], x.shape[0]), S.argb(x)) for x in images]
    for a, b in zip(webp.decode_many(chunks), images, strict=True):
        assert (a == b).all()


def test_back_references_and_colour_cache():
    colours = [0xFF102030, 0x80405060, 0xFFA0B0C0]
    tokens, expected = [("lit", c) for c in colours], list(colours)
    # length 4 = symbol 3; distance 3 from the plane code: 120 + 3 -> symbol 13 (offset 96, 5 extra bits)
    far = 123 - 1 - 96
    tokens.append(("ref", 3, 0, 0, 13, 5, far))
    for _ in range(4):
        expected.append(expected[-3])
    slot = (colours[1] * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - 6)
    tokens.append(("hit", slot))
    expected.append(colours[1])
    # near code 1 (symbol 0) is the pixel above
    tokens += [("lit", colours[2]), ("ref", 0, 0, 0, 0, 0, 0), ("ref", 6, 2 - 1, 1, 1, 0, 0)]
    expected += [colours[2]]
    width = 5
    expected.append(expected[len(expected) - width])
    # symbol 6 has two extra bits and starts at (2 << 2) + 1 = 9; with the extra value 1 it means 10 pixels, here at distance 1
    tokens[-1] = ("ref", 6, 2, 1, 1, 0, 0)
    expected += [expected[-1]] * 10
    assert len(expected) == 20
    (got,) = webp.decode_many([S.finish(S.start(width, 4), tokens, cache_bits=6)])
    assert S.argb(got) == expected


def test_several_groups_of_codes():
    image = random_image(3, 8, 8)
    group_map = [0, 1, 1, 0]
    group_of = [group_map[(y >> 2) * 2 + (x >> 2)] for y in range(8) for x in range(8)]
    (got,) = webp.decode_many([S.finish(S.start(8, 8), S.argb(image), groups=(2, group_map, group_of))])
    assert (got == image).all()


def predicted(mode, left, top, right, corner):
    """The format's predictions for one channel each, as its specification words them (mode 11 looks at all channels)."""
    average = lambda a, b: (a + b) // 2
    clamp = lambda a: max(0, min(255, a))
    if mode == 11:
        estimate = [x + y - z for x, y, z in zip(left, top, corner, strict=True)]
        to_left, to_top = (sum(abs(e - p) for e, p in zip(estimate, side, strict=True)) for side in (left, top))
        return left if to_left < to_top else top
    out = []
    for k, (x, t, r, c) in enumerate(zip(left, top, right, corner, strict=True)):
        half = average(x, t) - c
        out.append(
            [255 * (k == 0), x, t, r, c, average(average(x, r), t), average(x, c), average(x, t), average(c, t), average(t, r), average(average(x, c), average(t, r)), None, clamp(x + t - c), clamp(average(x, t) + int(half / 2))][mode]
            if mode < 14
            else 255 * (k == 0)
        )
    return out


@pytest.mark.parametrize("mode", range(16))
def test_predictor(mode):
    """Several images in lockstep, of several heights, against predictions pixel by pixel."""
    images = [random_image(mode + 20 * k, height, 7) for k, height in enumerate((6, 1, 9))]
    chunks = []
    for image in images:
        px = image.astype(int).tolist()
        residual = image.astype(int)
        for y in range(len(px)):
            for x in range(7):
                if y == 0:
                    p = [255, 0, 0, 0] if x == 0 else px[0][x - 1]
                elif x == 0:
                    p = px[y - 1][0]
                else:
                    p = predicted(mode, px[y][x - 1], px[y - 1][x], px[y - 1][x + 1] if x < 6 else px[y][0], px[y - 1][x - 1])
                residual[y, x] = (residual[y, x] - p) & 255
        w = S.start(7, len(px))
        w.put(1, 1)
        w.put(webp.PREDICTOR, 2)
        w.put(2, 3)  # blocks of 16
        S.put_image(w, [0xFF000000 | mode << 8])
        chunks.append(S.finish(w, S.argb(residual.astype(np.uint8))))
    for got, image in zip(webp.decode_many(chunks), images, strict=True):
        assert (got == image).all()


def test_cross_colour_then_subtract_green():
    image = random_image(9, 5, 6)
    r2b, g2b, g2r = 37, 200, 131
    signed = lambda v: (int(v) + 128) % 256 - 128
    coded = image.astype(int)
    coded[..., 1] = (coded[..., 1] - coded[..., 2]) & 255  # subtract green is applied first, so inverted last
    coded[..., 3] = (coded[..., 3] - coded[..., 2]) & 255
    for p in coded.reshape(-1, 4):
        a, r, g, b = p
        p[3] = (b - (signed(g2b) * signed(g) >> 5) - (signed(r2b) * signed(r) >> 5)) & 255
        p[1] = (r - (signed(g2r) * signed(g) >> 5)) & 255
    w = S.start(6, 5)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(1, 3)
    S.put_image(w, [0xFF000000 | r2b << 16 | g2b << 8 | g2r])
    (got,) = webp.decode_many([S.finish(w, S.argb(coded.astype(np.uint8)))])
    assert (got == image).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 16, 17, 200, 256])
def test_palette(n):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 256, (n, 4))
    index = rng.integers(0, n, (4, 13))
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    per, each = 1 << bits, 8 >> bits
    packed = np.zeros((4, -(-13 // per)), int)
    for y in range(4):
        for x in range(13):
            packed[y, x // per] |= int(index[y, x]) << (x % per * each)
    w = S.start(13, 4)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(n - 1, 8)
    delta = np.diff(np.vstack([np.zeros(4, int), colours]), axis=0) & 255
    S.put_image(w, S.argb(delta.astype(np.uint8)))
    (got,) = webp.decode_many([S.finish(w, [0xFF000000 | int(v) << 8 for v in packed.ravel()])])
    assert (got == colours[index]).all()


def test_simple_codes_and_long_codes():
    skewed = np.concatenate([np.full(2**k, k, np.uint8) for k in range(14)])
    data = skewed.tobytes().ljust(-(-len(skewed) // 192) * 192, b" ")
    assert webp.load_bytes([webp.store_bytes(data)])[0][0] == data
    assert webp.code_lengths(2 ** np.arange(30)).max() <= webp.LONGEST


def test_broken_files_are_told():
    good = webp.store_bytes(b"abc" * 64)
    with pytest.raises(webp.BadImage):
        list(webp.files(good[:-4]))
    with pytest.raises(webp.BadImage):
        webp.decode_many([b"\x2f\x00"])
    chunk = next(webp.files(good))
    with pytest.raises(webp.BadImage):
        webp.decode_many([chunk[:12]])


def test_texts_round_trip_and_rows(spark):
    texts = [None, "", "a", "ü" * 5000, "x" * 200_000, "line\n" * 300, "line\n" * 300]
    docs = spark.createDataFrame([(i, t, "feature") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = sorted(docs.select("doc_id", webp.stored_texts(docs).alias("m")).select("doc_id", "m.*").collect())
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[5][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]
    media = docs.withColumn("media", webp.text_media(docs))
    arrays = sorted(media.select("doc_id", webp.pixel_arrays(media).alias("a")).collect())
    assert sum(a.height for a in arrays[4].a) * 64 * 3 >= 200_000
    broken = spark.createDataFrame([(b"RIFFxxxx",), (None,)], "media binary")
    assert [r.a for r in broken.select(webp.pixel_arrays(broken).alias("a")).collect()] == [None, None]


PATCH = st.one_of(st.binary(max_size=60), st.binary(min_size=1, max_size=9).map(lambda b: b * 40), st.sampled_from([b"\0" * 500, b" " * 700, b"abcabd" * 200, bytes(range(256))]))


@given(st.lists(PATCH, min_size=1, max_size=12), st.integers(1, 70))
@settings(max_examples=120, deadline=None)
def test_writer_round_trip(parts, tile_rows):
    data = b"".join(parts)
    data = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
    assert webp.load_bytes([webp.store_bytes(data, tile_rows)])[0][0] == data


def used_features(media):
    """What each stored file of ``media`` is made of."""
    for chunk in webp.files(media):
        reader = webp._open(chunk)
        try:
            while True:
                asked = next(reader)
                webp.run_codes([asked]) if isinstance(asked, webp.Codes) else webp.run_lanes([asked])
        except StopIteration as end:
            image = end.value
        green = np.frombuffer(image.lane.groups[0][0], np.int16)
        yield {t[0] for t in image.transforms} | ({"cache"} if image.lane.cache_bits else set()) | ({"copies"} if green[256:280].any() else set())


def test_query_stores_by_every_part_of_the_format_and_reads_it_back(spark, sf_dir):
    """Every column against the library functions and plain arithmetic over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op2_webp_media(spark, sf_dir).collect()}
    media = {r.doc_id: bytes(r.m) for r in docs.select("doc_id", webp.text_media(docs).alias("m")).collect()}
    seen = {}
    for doc in docs.collect():
        raw, r = (doc.text or "").encode(), rows.pop(doc.doc_id)
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[doc.doc_id]), hashlib.sha256(media[doc.doc_id]).hexdigest())
        lines = [payload[i : i + 192] for i in range(0, len(payload), 192)]
        means = [sum(sum(x[c::3]) for x in lines) * 1000 // (64 * len(lines)) for c in range(3)]
        sharp = sum(abs(a - b) > 32 for x in lines for a, b in zip(x[1::3], x[4::3], strict=False))
        assert r.feature == f"64x{len(lines)} mean={means[0]},{means[1]},{means[2]} sharp={sharp * 1000 // (63 * len(lines))}"
        for found in used_features(media[doc.doc_id]):
            for x in found:
                seen[x] = seen.get(x, 0) + 1
    assert not rows
    assert seen.keys() >= {webp.PREDICTOR, webp.CROSS_COLOUR, webp.PALETTE, "cache", "copies"}


def test_rows_without_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "x"), (3, None)], "doc_id long, text string")
    rows = docs.select("doc_id", webp.stored_texts(docs).alias("m")).select("doc_id", "m.*").collect()
    assert len(rows) == 3 and rows[0] == rows[1]
    empty = docs.limit(0)
    assert empty.select(webp.stored_texts(empty)).count() == empty.select(webp.text_media(empty).alias("media")).count() == 0
    nothing = spark.createDataFrame([(b"",)], "media binary")
    assert nothing.select(webp.pixel_arrays(nothing).alias("a")).first().a == []
