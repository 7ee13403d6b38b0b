"""TIFF: image directories, strips and tiles, four codecs, predictors; one row a page.

``read_pages`` walks the chain of directories of a classic TIFF of either byte order,
fetches the strips or tiles, undoes bit order, compression (none, PackBits, LZW, deflate) and
the horizontal predictor, and gives each page's samples. ``write_tiff`` stores payloads
losslessly; the text query deals a document's bytes into pages of at most ``PAGE`` bytes,
64 pixels of 3 samples a row. The first page's style (codec, predictor, strips or tiles) and
the byte order come from a hash of the payload and the others follow in turn, so that all
styles serve documents of every length alike. ``pages_of`` reads files back as one row a
page; ``joined`` puts a file's pages together again as they pass by, without a shuffle.

Defined cases: null text is empty and gives one page of a row of spaces; a null or broken
file gives a row with its error and no pixels after those of its pages before; a page whose
directory promises more samples than its data can hold, or more than ``MOST_SAMPLES``, is
broken; a directory chain that loops ends where it meets a directory again; equal texts give
equal files; empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T


# Fixed values of the format.
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SIZE_OF = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LETTER = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
PAGE = 32 * ROW
STRIP_ROWS = 8
#: Bytes of pixels in one batch of pages, about.
BATCH = 4 << 20
TILE = 16
#: Codec, predictor and tiles of pages, in turn.
STYLES = [(c, p, t) for c, p in ((NONE, 1), (PACKBITS, 1), (LZW, 1), (LZW, 2), (ADOBE_DEFLATE, 1), (ADOBE_DEFLATE, 2)) for t in (False, True)]
#: What one page may hold, and how many samples a byte of packed data gives at most.
MOST_SAMPLES, MOST_A_BYTE = 1 << 30, 2048
TURNED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def unpack_bits(data: bytes, size: int = 1 << 62) -> bytes:
    """Up to about ``size`` bytes."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        c = data[at]
        if c < 128:
            out += data[at + 1 : at + 2 + c]
            at += c + 2
        elif c > 128:
            out += data[at + 1 : at + 2] * (257 - c)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes are runs; all between is literal."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(start, len(a)))
    out, literal = bytearray(), 0

    def flush(to):
        nonlocal literal
        while literal < to:
            n = min(128, to - literal)
            out.append(n - 1)
            out.extend(data[literal : literal + n])
            literal += n

    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        flush(s)
        while n > 0:
            m = min(128, n)
            out.append(257 - m if m > 1 else 0)
            out.append(data[s])
            n -= m
        literal = s + int(size[np.searchsorted(start, s)])
    flush(len(data))
    return bytes(out)


#: Width and first bit of the k-th code after a clear: widths grow with the table, one early.
LZW_WIDTH = np.array([min(12, (258 + k).bit_length()) for k in range(4096)])
LZW_FIRST = np.concatenate([[0], np.cumsum(LZW_WIDTH)])
LZW_SINGLE = [bytes([k]) for k in range(256)] + [b"", b""]


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    codes, table, next_, prefix = [256], {}, 258, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        if (code := table.get(key)) is not None:
            prefix = code
            continue
        codes.append(prefix)
        table[key] = next_
        next_ += 1
        if next_ == 4094:
            codes.append(256)
            table, next_ = {}, 258
        prefix = byte
    codes += [257] if prefix < 0 else [prefix, 257]
    c = np.array(codes, np.uint16)
    at = np.arange(len(c))
    clear = np.maximum.accumulate(np.where(c == 256, at, 0))
    width = LZW_WIDTH[np.concatenate([[0], (at - clear - 1)[1:]]).clip(0)]
    again = np.flatnonzero(c == 256)[1:]  # a clear is as wide as the codes before it
    width[again] = LZW_WIDTH[again - clear[again - 1] - 1]
    bits = (c[:, None] >> np.arange(11, -1, -1, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) >= (12 - width)[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int = 1 << 62) -> bytes:
    """At least ``size`` bytes, if there are as many. From one clear to the next the codes'
    places are known, so they are read at once."""
    out: list[bytes] = []
    padded, made, begin = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32), 0, 0
    total = 8 * len(data)
    while made < size and total - begin >= 9:
        most = np.searchsorted(LZW_FIRST, total - begin, "right") - 1
        more = max(0, (total - begin - int(LZW_FIRST[-1])) // 12)  # a table that is full stays
        place = begin + LZW_FIRST[:most]
        width = LZW_WIDTH[:most]
        if more:
            place, width = np.concatenate([place, begin + LZW_FIRST[-1] + 12 * np.arange(more)]), np.concatenate([width, np.full(more, 12)])
        at = place >> 3
        four = padded[at] << 24 | padded[at + 1] << 16 | padded[at + 2] << 8 | padded[at + 3]
        codes = (four >> (32 - (place & 7) - width).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        words = lzw_words(codes[:n].tolist())
        out += words
        made += sum(map(len, words))
        if not len(stop) or codes[n] == 257:
            break
        begin = int(place[n] + width[n])
    return b"".join(out)


def lzw_words(codes: list[int]) -> list[bytes]:
    if not codes:
        return []
    if codes[0] > 255:
        raise TiffError("LZW: a string before any literal")
    table = LZW_SINGLE.copy()
    last = table[codes[0]]
    out = [last]
    for code in codes[1:]:
        if code < len(table):
            word = table[code]
        elif code == len(table):
            word = last + last[:1]
        else:
            raise TiffError("LZW: a code beyond the table")
        out.append(word)
        table.append(last + word[:1])
        last = word
    return out


def decompress(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (ADOBE_DEFLATE, DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size + 1)
        except zlib.error as error:
            raise TiffError(f"deflate: {error}") from None
    else:
        raise TiffError(f"compression {compression} is unknown")
    if len(out) < size:
        raise TiffError("a strip or tile is short")
    return out[:size]


def compress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6)


def read_directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    """Tag -> values, and where the next directory is."""
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = SIZE_OF.get(kind, 0) * count
            where = at + 10 + 12 * k
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if kind in LETTER and where + size <= len(data):
                tags[tag] = list(struct.unpack_from(f"{order}{count}{LETTER[kind]}", data, where))
            elif kind in LETTER:
                raise TiffError("a tag's values lie beyond the file")
        (next_,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error:
        raise TiffError("a directory lies beyond the file") from None
    return tags, next_


def read_page(data: bytes, tags: dict[int, list]) -> Page:
    def many(tag, default):
        values = tags.get(tag) or default
        if not all(isinstance(v, int) and v >= 0 for v in values):
            raise TiffError(f"tag {tag} holds no whole numbers")
        return values

    def one(tag, default=None, least=0):
        values = many(tag, [] if default is None else [default])
        if not values or values[0] < least:
            raise TiffError(f"tag {tag} is missing or too small")
        return values[0]

    width, height, samples = one(256, least=1), one(257, least=1), one(277, 1, 1)
    compression, predictor, planar, fill = one(259, NONE), one(317, 1), one(284, 1), one(266, 1)
    if any(b != 8 for b in many(258, [1])):
        raise TiffError("only samples of 8 bits are read")
    if predictor not in (1, 2) or planar not in (1, 2) or fill not in (1, 2):
        raise TiffError("predictor, planar configuration or fill order is unknown")
    tiled = 322 in tags
    wide, high = (one(322, least=1), one(323, least=1)) if tiled else (width, min(one(278, height, 1), height))
    where, size = many(324 if tiled else 273, []), many(325 if tiled else 279, [])
    across, down = -(-width // wide), -(-height // high)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    n, held = across * down * planes, across * wide * down * high * samples
    if len(where) < n or len(size) < n:
        raise TiffError("strips or tiles are missing")
    if any(w + s > len(data) for w, s in zip(where[:n], size[:n], strict=True)):
        raise TiffError("a strip or tile lies beyond the file")
    if held > min(MOST_SAMPLES, MOST_A_BYTE * sum(size[:n]) + wide * high * samples) or wide * high * depth > MOST_A_BYTE * max(size[:n]):
        raise TiffError("more samples than the data can hold")
    pixels = np.zeros((down * high, across * wide, samples), np.uint8)
    for k in range(n):
        plane, y, x = k // (across * down), k // across % down, k % across
        rows = high if tiled else min(high, height - y * high)
        raw = data[where[k] : where[k] + size[k]]
        raw = decompress(raw.translate(TURNED) if fill == 2 else raw, compression, rows * wide * depth)
        part = np.frombuffer(raw, np.uint8).reshape(rows, wide, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        band = slice(plane, plane + 1) if planar == 2 else slice(None)
        pixels[y * high : y * high + rows, x * wide : (x + 1) * wide, band] = part
    return Page(width, height, samples, compression, predictor, tiled, pixels[:height, :width])


def read_pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a classic TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    if not at:
        raise TiffError("no directory")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        tags, at = read_directory(data, at, order)
        yield read_page(data, tags)


def write_page(pixels: np.ndarray, compression: int, predictor: int, tiled: bool, base: int, order: str) -> tuple[bytes, int]:
    """A page's data and directory, to stand at offset ``base``, and where the directory is;
    its link to the next is zero."""
    height, width, samples = pixels.shape
    if tiled:
        pad = np.pad(pixels, ((0, -height % TILE), (0, -width % TILE), (0, 0)), mode="edge")
        parts = [pad[y : y + TILE, x : x + TILE] for y in range(0, pad.shape[0], TILE) for x in range(0, pad.shape[1], TILE)]
    else:
        parts = [pixels[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
    chunks = []
    for part in parts:
        if predictor == 2:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
        chunks.append(compress(part.tobytes(), compression))
    body, places = bytearray(), []
    for chunk in chunks:
        places.append(base + len(body))
        body += chunk
    body += b"\0" * (len(body) % 2)
    entries: list[tuple[int, str, list[int]]] = [(256, "I", [width]), (257, "I", [height]), (258, "H", [8] * samples), (259, "H", [compression]), (262, "H", [2 if samples == 3 else 1]), (277, "H", [samples])]
    sizes = [len(c) for c in chunks]
    entries += [(322, "I", [TILE]), (323, "I", [TILE]), (324, "I", places), (325, "I", sizes)] if tiled else [(273, "I", places), (278, "I", [STRIP_ROWS]), (279, "I", sizes)]
    entries += [(317, "H", [predictor])] if predictor != 1 else []
    rows = b""
    for tag, letter, values in sorted(entries):
        packed = struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(packed) > 4:
            held = struct.pack(order + "I", base + len(body))
            body += packed + b"\0" * (len(packed) % 2)
        else:
            held = packed.ljust(4, b"\0")
        rows += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[letter], len(values)) + held
    directory = base + len(body)
    body += struct.pack(order + "H", len(entries)) + rows + struct.pack(order + "I", 0)
    return bytes(body), directory


def write_tiff(pages: list[tuple[np.ndarray, int, int, bool]], order: str = "<") -> bytes:
    """pages: (pixels, compression, predictor, tiled). Each directory stands after its page's
    data, so the links are filled in afterwards."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for pixels, compression, predictor, tiled in pages:
        body, directory = write_page(pixels, compression, predictor, tiled, len(out), order)
        out += body
        struct.pack_into(order + "I", out, link, directory)
        link = len(out) - 4
    return bytes(out)


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Length in bytes, and the bytes with spaces up to a positive multiple of a row."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


def text_tiff(payload: bytes) -> bytes:
    """The payload as pages of 8-bit samples in its own order."""
    pages, first = [], xxhash.xxh3_64_intdigest(payload)
    for k, at in enumerate(range(0, len(payload), PAGE)):
        pixels = np.frombuffer(payload[at : at + PAGE], np.uint8).reshape(-1, WIDTH, SAMPLES)
        pages.append((pixels, *STYLES[(first + k) % len(STYLES)]))
    return write_tiff(pages, "<>"[first >> 63])


def features(pixels: np.ndarray) -> str:
    """Mean and spread of all samples, share of flat steps between neighbours, entropy."""
    flat = pixels.reshape(-1)
    return described(np.bincount(flat, minlength=256), int((flat[1:] == flat[:-1]).sum()))


def described(counts: np.ndarray, flat: int) -> str:
    n, value = max(1, int(counts.sum())), np.arange(256)
    mean = float((counts * value).sum()) / n
    spread = np.sqrt(max(0.0, float((counts * value * value).sum()) / n - mean * mean))
    p = counts[counts > 0] / n
    return f"mean={mean:.4f};sd={spread:.4f};flat={flat / max(1, n - 1):.4f};entropy={max(0.0, -(p * np.log2(p)).sum()):.4f}"


PAGE_FIELDS = "page long, width long, height long, samples long, compression long, predictor long, tiled boolean, pixels binary, feature string, error string"


@dataclass
class Step:
    """A function over Arrow batches, the columns it reads in their order, and its result's
    schema. Steps that follow one another may share one Python worker."""

    run: Callable
    reads: list[str]
    schema: T.StructType

    def of(self, df: DataFrame) -> DataFrame:
        return df.select(*self.reads).mapInArrow(self.run, self.schema)


def paging(schema: T.StructType, column: str) -> Step:
    new = T._parse_datatype_string(PAGE_FIELDS)
    kept = [f for f in schema.fields if f.name not in (column, *new.names)]
    names = [f.name for f in kept]
    kinds = _arrow_types(new)

    def rows_of(data):
        k = 0
        try:
            for k, p in enumerate(read_pages(data), 1):
                yield k - 1, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), features(p.pixels), None
        except TiffError as error:
            yield k, *[None] * 8, str(error)

    def run(batches):
        for batch in batches:
            own, rows, size = [], [], 0

            def made():
                columns = [batch.column(n).take(pa.array(own)) for n in names]
                return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=[*names, *new.names])

            for k in range(batch.num_rows):
                for row in rows_of(batch.column(column)[k].as_py() or b""):
                    own.append(k)
                    rows.append(row)
                    size += len(row[7] or b"")
                    if size > BATCH:
                        yield made()
                        own, rows, size = [], [], 0
            if rows:
                yield made()

    return Step(run, [*names, column], T.StructType(kept + new.fields))


def joining(schema: T.StructType) -> Step:
    old = T._parse_datatype_string(PAGE_FIELDS).names
    new = T._parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, n_pages long, feature string, error string")
    kept = [f for f in schema.fields if f.name not in (*old, *new.names)]
    names, kinds = [f.name for f in kept], _arrow_types(new)

    def run(batches):
        first, file = None, None

        def made():
            values = [pa.array([v], t) for v, t in zip(file.values(), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*first.columns, *values], names=[*names, *new.names])

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            pixels, errors = batch.column("pixels"), batch.column("error")
            for k, page in enumerate(batch.column("page").to_pylist()):
                if page == 0:
                    if first is not None:
                        ready.append(made())
                    first, file = batch.select(names).slice(k, 1), Samples()
                file.add(pixels[k].as_py(), errors[k].as_py())
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if first is not None:
            yield made()

    return Step(run, [*names, "page", "pixels", "error"], T.StructType(kept + new.fields))


def pages_of(files: DataFrame, column: str = "media") -> DataFrame:
    """One row for each page of the TIFF file in a binary column, in their order; other
    columns repeat, the file itself is left out."""
    return paging(files.schema, column).of(files)


def joined(pages: DataFrame) -> DataFrame:
    """The other columns of ``pages_of``, once a file, with payload_bytes, payload_sha256,
    tail_crc32, n_pages, feature and error of its pages' samples. Reads pages as ``pages_of``
    leaves them: a file's own stand one after another in one task."""
    return joining(pages.schema).of(pages)


class Samples:
    """Digests of a file's samples, page by page; no page is held."""

    def __init__(self):
        self.sha, self.size, self.tail, self.pages, self.error = hashlib.sha256(), 0, b"", 0, None
        self.counts, self.flat = np.zeros(256, np.int64), 0

    def add(self, pixels: bytes | None, error: str | None) -> None:
        self.error = self.error or error
        if pixels is None:
            return
        flat = np.frombuffer(self.tail[-1:] + pixels, np.uint8)
        self.flat += int((flat[1:] == flat[:-1]).sum())
        self.counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        self.sha.update(pixels)
        self.size += len(pixels)
        self.tail = (self.tail + pixels)[-16:]
        self.pages += 1

    def values(self) -> tuple:
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), self.pages, described(self.counts, self.flat), self.error


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


def storing(schema: T.StructType) -> Step:
    new = T._parse_datatype_string("n_bytes long, media binary, media_bytes long, media_sha256 string")
    kept = [f for f in schema.fields if f.name not in new.names]
    names, kinds = [f.name for f in kept], _arrow_types(new)

    def run(batches):
        for batch in batches:
            first, rows, size = 0, [], 0

            def made():
                columns = batch.slice(first, len(rows)).columns
                return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=[*names, *new.names])

            for k, text in enumerate(batch.column("text"), 1):
                n, payload = text_payload(text.as_py())
                media = text_tiff(payload)
                rows.append((n, media, len(media), hashlib.sha256(media).hexdigest()))
                size += len(media)
                if size > BATCH:
                    yield made()
                    first, rows, size = k, [], 0
            if rows:
                yield made()

    return Step(run, names, T.StructType(kept + new.fields))


def stored(docs: DataFrame) -> DataFrame:
    """docs with the text stored as TIFF: n_bytes, media, media_bytes, media_sha256."""
    return storing(docs.schema).of(docs)


def store_texts(docs: DataFrame) -> DataFrame:
    """docs without text, with the digests of the text stored as TIFF and read back page by
    page: n_bytes, media_bytes, media_sha256 and the columns of ``joined``. The three steps
    are those of ``stored``, ``pages_of`` and ``joined``, one after another in one worker."""
    store = storing(docs.schema)
    page = paging(T.StructType([f for f in store.schema.fields if f.name != "text"]), "media")
    join = joining(page.schema)

    def run(batches):
        return join.run(page.run(store.run(batches)))

    return Step(run, store.reads, join.schema).of(docs)
