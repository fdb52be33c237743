"""TIFF images in a binary column: one row for each page.

The reader walks the chain of image directories in either byte order, gathers
strips or tiles, of one or of separate planes, undoes PackBits, LZW or deflate
and the horizontal predictor, and gives 8-bit samples.  What it doesn't
support is an error, never other pixels, and nothing is allocated or unpacked
beyond what the bytes at hand can hold.  The writer makes files that the
reader, and any other, can read: grey or RGB pages in strips or tiles.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tag numbers, field sizes, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
MAX_PAGES = 1 << 20
#: Samples of a page at most, and how many a stored byte stands for at most, whatever the compression.
MAX_SAMPLES, MAX_RATIO = 1 << 28, 4096


class TiffError(ValueError):
    """Bytes that aren't a readable TIFF file of 8-bit samples."""


@dataclass(frozen=True)
class TiffParams:
    """``page_rows`` and ``chunk_rows``: height of a page, and of a strip or a tile; ``tile_width`` 0 makes strips."""

    width: int = 192
    page_rows: int = 1024
    chunk_rows: int = 128
    tile_width: int = 0
    compression: int = DEFLATE
    predictor: int = 2
    level: int = 1
    big_endian: bool = False

    def of(self, raw: bytes) -> TiffParams:
        """The form of one text when forms are mixed: most are these, one in sixteen is PackBits tiles, one LZW strips if it is short."""
        kind = zlib.crc32(raw) % 16
        if kind == 0:
            return replace(self, compression=PACKBITS, tile_width=64, chunk_rows=64, predictor=1)
        if kind == 1 and len(raw) <= 1 << 14:
            return replace(self, compression=LZW)
        return self


def packbits_decode(data: bytes, most: int = MAX_SAMPLES) -> bytes:
    """The unpacked bytes, ``most`` at most."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:most])


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < n and end - i < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out += bytes((end - i - 1,)) + data[i:end]
        i = end
    return bytes(out)


def lzw_decode(data: bytes, most: int = MAX_SAMPLES) -> bytes:
    """Most significant bit first; code lengths grow one code early, as the format asks; ``most`` bytes at most."""
    out = bytearray()
    table: list[bytes] = []
    bits = width = at = 0
    old = b""
    value = 0
    while len(out) < most:
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        while bits < width:
            if at >= len(data):
                return bytes(out)
            value = (value << 8 | data[at]) & 0xFFFFFFFF
            at, bits = at + 1, bits + 8
        code = value >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, old = [bytes((i,)) for i in range(256)] + [b"", b""], b""
            continue
        if not table:
            raise TiffError("LZW data without a clear code")
        if not old:
            word = table[code] if code < len(table) else None
        elif code < len(table):
            word = table[code]
            table.append(old + word[:1])
        else:
            word = old + old[:1] if code == len(table) else None
            table.append(word or b"")
        if not word or len(table) > 4096:
            raise TiffError("LZW code out of range")
        out += word
        old = word
    return bytes(out[:most])


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    value = bits = 0
    table: dict[bytes, int] = {}
    size = 258

    def put(code: int) -> None:
        nonlocal value, bits
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        value, bits = value << width | code, bits + width
        while bits >= 8:
            out.append(value >> (bits - 8) & 255)
            bits -= 8
        value &= (1 << bits) - 1

    put(256)
    table = {bytes((i,)): i for i in range(256)}
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size += 1
        word = data[i : i + 1]
        if size == 4094:
            put(256)
            table, size = {bytes((k,)): k for k in range(256)}, 258
    if word:
        put(table[word])
        size += 1
    put(257)
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def _decoded(data: bytes, compression: int, most: int) -> bytes:
    """The unpacked bytes of a strip or tile, ``most`` at most."""
    if compression == NONE:
        return data[:most]
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, most)
        except zlib.error as e:
            raise TiffError(str(e)) from None
    if compression == PACKBITS:
        return packbits_decode(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    raise TiffError(f"compression {compression} is not known")


def _encoded(data: bytes, p: TiffParams) -> bytes:
    if p.compression == DEFLATE:
        return zlib.compress(data, p.level)
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode}[p.compression](data)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("directory beyond the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("directory is cut off")
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = FIELD_BYTES.get(kind, 0) * count
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if kind in FIELD:
            if where + size > len(data):
                raise TiffError("field beyond the end")
            tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, where)
    (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, after


def directories(data: bytes) -> tuple[str, list[dict[int, tuple]], str | None]:
    """Byte order, the tags of each page, and why the chain ends before its end, if it does."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        return "<", [], "no TIFF header"
    (at,) = struct.unpack_from(order + "I", data, 4)
    found, seen = [], set()
    while at:
        if at in seen or len(seen) >= MAX_PAGES:
            return order, found, "directories form a loop"
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
        except TiffError as e:
            return order, found, str(e)
        found.append(tags)
    return order, found, None


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    """Pages of a file as arrays of (height, width, samples); raises :class:`TiffError` on anything else."""
    _, found, error = directories(data)
    for tags in found:
        yield _page(data, tags)
    if error:
        raise TiffError(error)


def _page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    def one(tag: int, default: int | None = None) -> int:
        if tag not in tags or not tags[tag]:
            if default is None:
                raise TiffError(f"tag {tag} is missing")
            return default
        return tags[tag][0]

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    predictor, photometric = one(PREDICTOR, 1), one(PHOTOMETRIC, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))):
        raise TiffError("samples aren't 8 bits wide")
    if predictor not in (1, 2) or photometric not in (0, 1, 2) or one(FILL_ORDER, 1) != 1 or one(PLANAR, 1) not in (1, 2):
        raise TiffError("predictor, photometric, fill order or planes aren't supported")
    planes = samples if one(PLANAR, 1) == 2 else 1
    per = samples // planes
    tiled = TILE_OFFSETS in tags
    cw = one(TILE_WIDTH) if tiled else width
    ch = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
    offsets, counts = (tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ()))
    if not (width and height and samples and cw and ch):
        raise TiffError("page without area")
    across, down = -(-width // cw), -(-height // ch)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    area = down * ch * across * cw * samples
    if area > min(MAX_SAMPLES, MAX_RATIO * (sum(counts) + 1)):
        raise TiffError("the page is larger than its bytes can hold")
    page = np.empty((down * ch, across * cw, samples), np.uint8)
    for k in range(across * down * planes):
        if offsets[k] + counts[k] > len(data):
            raise TiffError("strip or tile beyond the end")
        plane, place = divmod(k, across * down)
        row, col = divmod(place, across)
        rows = ch if tiled else min(ch, height - row * ch)
        size = rows * cw * per
        raw = _decoded(data[offsets[k] : offsets[k] + counts[k]], one(COMPRESSION, 1), size)
        if len(raw) < size:
            raise TiffError("strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, size).reshape(rows, cw, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        page[row * ch : row * ch + rows, col * cw : (col + 1) * cw, plane * per : (plane + 1) * per] = block
    page = page[:height, :width]
    return 255 - page if photometric == 0 else page


def write_pages(pages: list[np.ndarray], p: TiffParams) -> bytes:
    """A file of pages, arrays of (height, width, samples) of 8-bit samples."""
    order = ">" if p.big_endian else "<"
    out = bytearray(b"MM\0*" if p.big_endian else b"II*\0") + b"\0\0\0\0"
    link = 4
    for page in pages:
        height, width, samples = page.shape
        cw, ch = p.tile_width or width, p.chunk_rows
        offsets, counts = [], []
        for y in range(0, height, ch):
            for x in range(0, width, cw):
                block = page[y : y + ch, x : x + cw]
                if p.tile_width:
                    block = np.pad(block, ((0, ch - block.shape[0]), (0, cw - block.shape[1]), (0, 0)))
                if p.predictor == 2:
                    block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
                offsets.append(len(out))
                raw = _encoded(block.tobytes(), p)
                counts.append(len(raw))
                out += raw
        fields = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8] * samples), (COMPRESSION, "H", [p.compression]), (PHOTOMETRIC, "H", [2 if samples == 3 else 1])]
        fields += [(SAMPLES, "H", [samples])] if p.tile_width else [(STRIP_OFFSETS, "I", offsets), (SAMPLES, "H", [samples]), (ROWS_PER_STRIP, "I", [ch]), (STRIP_COUNTS, "I", counts)]
        fields += [(PLANAR, "H", [1]), (PREDICTOR, "H", [p.predictor])]
        fields += [(TILE_WIDTH, "I", [cw]), (TILE_HEIGHT, "I", [ch]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts)] if p.tile_width else []
        entries = bytearray()
        for tag, kind, values in fields:
            raw = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 4 if kind == "I" else 3, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: bytes, width: int) -> bytes:
    """``text`` filled with spaces to the next positive multiple of ``width``."""
    return text + b" " * (width - len(text) % width if len(text) % width or not text else 0)


def texts_to_tiff(docs: DataFrame, params: TiffParams = TiffParams(), mixed: bool = False) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text, as UTF-8 filled to whole rows, in a grey TIFF file.

    ``mixed`` gives some texts another form, by their bytes alone.

    A null text is an empty one and makes one row of spaces.  A null
    ``doc_id`` is returned as null, repeated rows give one file each, and an
    empty table gives none.  Other columns are not read.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                rows = np.frombuffer(payload_of(raw, p.width), np.uint8).reshape(-1, p.width, 1)
                media.append(write_pages([rows[i : i + p.page_rows] for i in range(0, len(rows), p.page_rows)], p.of(raw) if mixed else p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: Pixels that one batch of pages holds at most, but for a single larger page.
BATCH_BYTES = 8 << 20
PAGE_FIELDS = "page int, pages int, width int, height int, samples int, pixels binary, error string"


def tiff_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row for each page of each file in ``column``, after the table's other columns.

    ``pixels`` holds the page's samples row by row; ``page`` counts from 0 and
    ``pages`` is the number of pages that the file's directories tell.  A page
    that can't be read gives a row with ``error`` set and null pixels, and the
    file's other pages come all the same.  Where the directories break off,
    one more row has the error and a null ``page``; a file without a page, and
    a null, give that row alone.  Rows keep their order inside a partition.
    Other columns named like the page's, in any case, are replaced by them.
    """
    names = [x.split()[0] for x in PAGE_FIELDS.split(", ")]
    rest = [c for c in media.columns if c.lower() not in (*names, column.lower())]
    quoted = [F.col(f"`{c}`") for c in rest]
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]

    def rows(raw: bytes | None) -> Iterator[tuple]:
        if raw is None:
            yield (None, None, None, None, None, None, "no bytes")
            return
        _, found, error = directories(raw)
        for i, tags in enumerate(found):
            try:
                x = _page(raw, tags)
                yield (i, len(found), x.shape[1], x.shape[0], x.shape[2], x.tobytes(), None)
            except TiffError as e:
                yield (i, len(found), None, None, None, None, str(e))
        if error or not found:
            yield (None, len(found), None, None, None, None, error or "no pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def flushed() -> pa.RecordBatch:
                own = [batch.column(c).take(pa.array([k for k, _ in held])) for c in range(1, batch.num_columns)]
                return pa.RecordBatch.from_arrays(own + [pa.array(c, t) for c, t in zip(zip(*(x for _, x in held), strict=True), kinds, strict=True)], rest + names)

            for k in range(batch.num_rows):
                for row in rows(batch.column(0)[k].as_py()):
                    held.append((k, row))
                    size += len(row[5] or b"")
                    if size > BATCH_BYTES:
                        yield flushed()
                        held, size = [], 0
            if held:
                yield flushed()

    schema = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in rest] + [PAGE_FIELDS])
    return media.select(F.col(f"`{column}`"), *quoted).mapInArrow(run, schema)


_FILE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def file_features(pages: DataFrame) -> DataFrame:
    """One row for each file of :func:`tiff_pages` rows of text files: digests of its samples and a feature string.

    The feature holds the page count, the mean sample of each quarter of the
    payload and its commonest sample.  A file with a page that can't be read
    has nulls for what its samples tell, and the error as its feature.  Rows
    of a file follow each other, as that function returns them; nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: list[bytes] = []
        bad = None
        out: list[tuple] = []
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, n_bytes, media_bytes, media_sha, page, count, pixels, error = (batch.column(c)[k].as_py() for c in range(8))
                if page == 0:
                    held, bad = [], None
                bad = bad or error
                held.append(pixels or b"")
                if page is not None and page < count - 1:
                    continue
                if page is None and count:
                    out.pop()  # the directories broke off behind the last page
                raw, held = b"".join(held), []
                if bad:
                    out.append((doc_id, n_bytes, None, None, None, media_bytes, media_sha, f"error={bad}"))
                    bad = None
                    continue
                a = np.frombuffer(raw, np.uint8)
                means = ",".join(f"{x.mean():.3f}" for x in np.array_split(a, 4))
                feature = f"pages={count};means={means};mode={np.bincount(a, minlength=256).argmax()}"
                out.append((doc_id, n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), media_bytes, media_sha, feature))
            if len(out) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[:-1], strict=True), kinds, strict=True)], [x.split()[0] for x in _FILE.split(", ")])
                out = out[-1:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _FILE.split(", ")])

    return pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pages", "pixels", "error").mapInArrow(run, _FILE)
