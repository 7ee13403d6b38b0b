import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import tiff

SCHEMA = "doc_id long, text string, media string"


@pytest.mark.parametrize("data", [b"", b"a", b"aaa", b"aaab", b"ab" * 700, b"x" * 1000, bytes(range(256)) * 60, b"aaa" * 5 + bytes(range(200)) + b"zz"])
def test_codecs_give_back_what_they_took(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    rng = np.random.default_rng(len(data))
    noise = rng.integers(0, 4, 30_000, np.uint8).tobytes() + rng.bytes(20_000)
    assert tiff.lzw_decode(tiff.lzw_encode(noise)) == noise
    assert tiff.unpack_bits(tiff.pack_bits(noise)) == noise


def test_known_streams():
    # the packed example of the format's documents
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    assert tiff.unpack_bits(packed) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA".replace(" ", ""))
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("codec", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.ADOBE_DEFLATE, tiff.DEFLATE])
def test_pages_round_trip(order, tiled, codec):
    rng = np.random.default_rng(5)
    pages = [(rng.integers(0, 256, shape, np.uint8), codec, predictor, tiled) for shape in ((1, 1, 1), (21, 37, 3), (16, 16, 3), (40, 5, 1)) for predictor in (1, 2)]
    got = list(tiff.read_pages(tiff.write_tiff(pages, order)))
    assert len(got) == len(pages)
    for page, (pixels, c, predictor, _) in zip(got, pages, strict=True):
        assert (page.pixels == pixels).all() and (page.compression, page.predictor, page.tiled) == (c, predictor, tiled)


def test_separate_planes():
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    planes = [pixels[:, :, k].tobytes() for k in range(3)]
    tags = {256: [3], 257: [2], 258: [8, 8, 8], 259: [1], 277: [3], 284: [2], 278: [2], 273: [0, 6, 12], 279: [6, 6, 6]}
    assert (tiff.read_page(b"".join(planes), tags).pixels == pixels).all()


def test_broken_files_are_errors():
    good = tiff.write_tiff([(np.zeros((9, 4, 3), np.uint8), tiff.ADOBE_DEFLATE, 1, False)])
    for bad in (b"", b"II", b"XX*\0" + good[4:], good[:40], good[:8] + b"\xff" * 20 + good[28:], good[:4] + struct.pack("<I", len(good)) + good[8:]):
        with pytest.raises(tiff.TiffError):
            list(tiff.read_pages(bad))
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    assert len(list(tiff.read_pages(bytes(loop)))) == 1


def test_texts_round_trip(spark):
    long = "Ünïcode and plain text, " * 9000
    docs = [(1, "abc", "x"), (2, "", ""), (3, None, ""), (4, "é" * 96, ""), (5, "é" * 97, ""), (6, long, ""), (6, long, ""), (None, "abc", "")]
    given = spark.createDataFrame(docs, SCHEMA)
    files = {r.doc_id: bytes(r.media) for r in tiff.stored(given).collect()}
    texts = {i: t for i, t, _ in docs}
    rows = tiff.store_texts(given).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, *_ in docs)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        want = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.error) == (len(data), len(want), hashlib.sha256(want).hexdigest(), None)
        assert r.tail_crc32 == zlib.crc32(want[-16:]) and r.n_pages == max(1, -(-len(want) // tiff.PAGE))
        assert r.media_sha256 == hashlib.sha256(files[r.doc_id]).hexdigest() and r.media_bytes == len(files[r.doc_id])
        assert r.feature == tiff.features(np.frombuffer(want, np.uint8))
    pages = tiff.pages_of(tiff.stored(given.filter("doc_id = 6").limit(1))).collect()
    assert [r.page for r in pages] == list(range(len(pages))) and pages[0].doc_id == 6
    assert {(r.compression, r.predictor, r.tiled) for r in pages} == set(tiff.STYLES)
    assert b"".join(bytes(r.pixels) for r in pages).rstrip() == long.encode().rstrip()
    assert tiff.store_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    more = given.withColumns({"page": F.lit("p"), "n_pages": F.lit("n"), "error": F.lit(1), "lang": F.lit("xx")})
    out = tiff.store_texts(more)
    assert out.columns == ["doc_id", "lang", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "n_pages", "feature", "error"]
    assert {r.lang for r in out.collect()} == {"xx"} and out.count() == len(docs)


def test_styles_serve_short_texts_alike(spark):
    docs = [(k, f"text number {k}", "") for k in range(3_000)]
    rows = tiff.pages_of(tiff.stored(spark.createDataFrame(docs, SCHEMA))).groupBy("compression", "predictor", "tiled").count().collect()
    assert len(rows) == len(tiff.STYLES) and all(abs(r["count"] - 250) < 80 for r in rows)


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.ADOBE_DEFLATE])
def test_bits_in_the_other_order(codec):
    pixels = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    packed = tiff.compress(pixels.tobytes(), codec)
    tags = {256: [5], 257: [4], 258: [8, 8, 8], 259: [codec], 277: [3], 266: [2], 273: [0], 279: [len(packed)]}
    assert (tiff.read_page(packed.translate(tiff.TURNED), tags).pixels == pixels).all()


def test_mutated_files_give_pages_or_errors():
    rng = np.random.default_rng(4)
    pixels = rng.integers(0, 9, (20, 20, 3), np.uint8)
    good = tiff.write_tiff([(pixels, *style) for style in tiff.STYLES])
    places = [k for k in range(len(good)) if good[k : k + 1] != b""]
    for _ in range(3_000):
        bad = bytearray(good)
        for k in rng.choice(places, rng.integers(1, 4)):
            bad[k] = rng.integers(0, 256)
        try:
            assert all(p.pixels.size == p.width * p.height * p.samples for p in tiff.read_pages(bytes(bad)))
        except tiff.TiffError:
            pass
    page = tiff.write_tiff([(pixels, tiff.NONE, 1, True)])
    tags = {256: [20], 257: [20], 258: [8] * 3, 259: [1], 277: [3], 322: [16], 323: [16], 324: [0] * 4, 325: [768] * 4}
    for change in ({256: []}, {256: [-3]}, {256: [2.5]}, {322: [1 << 20], 323: [1 << 20]}, {322: [0]}, {257: [1 << 31]}, {277: [0]}, {324: []}, {266: [3]}, {258: []}):
        with pytest.raises(tiff.TiffError):
            tiff.read_page(page, tags | change)


def test_pages_of_null_and_broken(spark):
    good = tiff.text_tiff(tiff.text_payload("hello")[1])
    rows = tiff.pages_of(spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk"))], "id long, media binary")).orderBy("id").collect()
    assert [(r.id, r.page, r.error is None) for r in rows] == [(1, 0, True), (2, 0, False), (3, 0, False)]
