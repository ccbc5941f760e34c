"""TIFF columns (operator 8): write and read images inside a DataFrame.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that are stored plain, by
PackBits, LZW or deflate, undoes the horizontal predictor and emits one row per page.

Input rules: null media gives no page; media that aren't TIFF, or are cut off, raise ValueError in `read_pages` and give
one row with `error` set in `tiff_pages`; null text is the empty text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import enter, text_or_empty

# Fixed values of the format: tags, compression schemes, field sizes by type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
SCHEMES = {"none": PLAIN, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}

PAYLOAD_WIDTH = 576


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    bits, count, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int):
        nonlocal bits, count
        bits, count = (bits << width) | code, count + width
        while count >= 8:
            out.append((bits >> (count - 8)) & 255)
            count -= 8
        bits &= (1 << count) - 1

    put(256)
    table, free, word = {bytes((b,)): b for b in range(256)}, 258, b""
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = free
        free += 1
        if free == 4095:
            put(256)
            table, free, width = {bytes((x,)): x for x in range(256)}, 258, 9
        elif free >= (1 << width):
            width += 1
        word = bytes((b,))
    if word:
        put(table[word])
        free += 1
        if free >= (1 << width) and width < 12:
            width += 1
    put(257)
    if count:
        out.append((bits << (8 - count)) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out: list[bytes] = []
    table: list[bytes] = []
    width, bits, count, last = 9, 0, 0, None
    for byte in data:
        bits, count = (bits << 8) | byte, count + 8
        if count < width:
            continue
        code = bits >> (count - width)
        count -= width
        bits &= (1 << count) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((b,)) for b in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            raise ValueError("LZW data don't begin with a clear code")
        if code > len(table) or (code == len(table) and last is None):
            raise ValueError("LZW code out of range")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return b"".join(out)


def _pack(data: bytes, scheme: int, level: int) -> bytes:
    if scheme == PLAIN:
        return data
    if scheme == PACKBITS:
        return packbits_encode(data)
    return lzw_encode(data) if scheme == LZW else zlib.compress(data, level)


def _unpack(data: bytes, scheme: int) -> bytes:
    if scheme == PLAIN:
        return data
    if scheme == PACKBITS:
        return packbits_decode(data)
    if scheme == LZW:
        return lzw_decode(data)
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise ValueError(str(e)) from e
    raise ValueError(f"unknown compression {scheme}")


def write_tiff(pages: list[np.ndarray], scheme: str = "deflate", predictor: int = 1, rows: int = 64, tile: int = 0, order: str = "<", level: int = 1) -> bytes:
    """A file of 8- or 16-bit pages (height x width, or height x width x samples), in strips of `rows` or square tiles."""
    code = SCHEMES[scheme]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        a = page if page.ndim == 3 else page[:, :, None]
        h, w, s = a.shape
        bits = a.dtype.itemsize * 8
        parts = []
        th, tw = (tile, tile) if tile else (rows, w)
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = a[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = block.copy()
                    block[:, 1:] -= block[:, :-1].copy()
                parts.append(_pack(block.astype(block.dtype.newbyteorder(order)).tobytes(), code, level))
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) & 1)
        fields = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [bits] * s), COMPRESSION: (3, [code]), PHOTOMETRIC: (3, [1 if s == 1 else 2]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        sizes = [len(p) for p in parts]
        fields |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, sizes)} if tile else {OFFSETS: (4, offsets), ROWS: (4, [rows]), COUNTS: (4, sizes)}
        entries = b""
        for tag in sorted(fields):
            kind, values = fields[tag]
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes):
    """Yields (page number, width, height, samples, bits, compression, predictor, array) of each image directory."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    try:
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError("no TIFF header")
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags: dict[int, tuple] = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                place = at + 10 + 12 * k
                if kind not in (1, 3, 4):
                    continue
                if TYPE_SIZE[kind] * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, place)
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
            yield (len(seen) - 1, *_image(data, tags, order))
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError(f"damaged TIFF: {e!r}") from e


def _image(data: bytes, tags: dict[int, tuple], order: str):
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    s, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (1,))[0]
    scheme, predictor = tags.get(COMPRESSION, (PLAIN,))[0], tags.get(PREDICTOR, (1,))[0]
    if bits not in (8, 16) or tags.get(PLANAR, (1,))[0] != 1 or predictor not in (1, 2):
        raise ValueError(f"unsupported layout: {bits} bits, predictor {predictor}")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    th, tw = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS, (h,))[0], h) or 1, w)
    places, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    image = np.empty((h, w, s), dtype=kind.newbyteorder("="))
    k = 0
    for y in range(0, h, th):
        for x in range(0, w, tw):
            rows = th if tiled else min(th, h - y)
            raw = _unpack(data[places[k] : places[k] + sizes[k]], scheme)
            need = rows * tw * s * kind.itemsize
            if len(raw) < need:
                raise ValueError("damaged TIFF: a strip or tile is too short")
            block = np.frombuffer(raw, dtype=kind, count=rows * tw * s).reshape(rows, tw, s).astype(image.dtype)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            image[y : y + rows, x : x + tw] = block[: h - y, : w - x]
            k += 1
    return w, h, s, bits, scheme, predictor, image


def payload_of(text: str, width: int = PAYLOAD_WIDTH) -> bytes:
    """UTF-8 of the text, filled with bytes 255 up to a positive multiple of `width`."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % width if raw else width)


def text_to_tiff(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_rows: int = 256, scheme: str = "deflate", predictor: int = 2) -> DataFrame:
    """The id and `media`: each text's payload as grey rows of 576 samples, `page_rows` to a page.

    Null and empty texts are one row of padding; very long ones have as many pages as they take; repeated rows are files of
    their own.  Columns other than id and text are ignored, whatever their names."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enter("tiff")
        for b in batches:
            ids, texts = b.column("id"), b.column("t").to_pylist()
            for lo in range(0, len(texts), 500):
                media = []
                for t in texts[lo : lo + 500]:
                    a = np.frombuffer(payload_of(t), dtype=np.uint8).reshape(-1, PAYLOAD_WIDTH)
                    media.append(write_tiff([a[y : y + page_rows] for y in range(0, len(a), page_rows)], scheme, predictor))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 500), pa.array(media, pa.binary())], names=[id_col, "media"])

    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, media binary")


def tiff_pages(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row per page, in file order: id, media_bytes, media_sha256, page, pages, width, height, samples, bits,
    compression, predictor, pixels (row by row), error."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["media_bytes", "media_sha256", "page", "pages", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error"]
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 8, pa.binary(), pa.string()]

    def run(batches):
        enter("tiff")
        for b in batches:
            ids, media = b.column("id"), b.column("m").to_pylist()
            for lo in range(0, len(media), 500):
                own, rows = [], []
                for k, m in enumerate(media[lo : lo + 500], lo):
                    if m is None:
                        continue
                    head = (len(m), hashlib.sha256(m).hexdigest())
                    try:
                        found = [(*head, p[0], None, *p[1:7], p[7].tobytes(), None) for p in read_pages(m)]
                    except ValueError as e:
                        found = [(*head, 0, None, *[None] * 7, str(e))]
                    own += [k] * len(found)
                    rows += [(*r[:3], len(found), *r[4:]) for r in found]
                cols = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[id_col, *names])

    return df.select(df[id_col].alias("id"), df[media_col].alias("m")).mapInArrow(run, f"`{id_col}` {id_type}, media_bytes bigint, media_sha256 string, page int, pages int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string")


def features_of(pixels: np.ndarray) -> str:
    """An 8 x 8 mean hash and a histogram of 16 bins in sixteenths of the largest, both in hexadecimal."""
    flat = pixels.reshape(-1)
    sums = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
    cut = np.arange(65) * len(flat) // 64
    means = (sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(np.diff(cut), 1)
    bits = int("".join("1" if m > sums[-1] / len(flat) else "0" for m in means), 2)
    bins = np.bincount(flat >> 4, minlength=16)
    return f"{bits:016x}-" + "".join(f"{int(v):x}" for v in bins * 15 // bins.max())


def payload_digests(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per file from the consecutive rows of its pages: the payload's length, hashes and features.

    Narrow: `pages` must come straight from `tiff_pages`, whose rows of one file lie together in order.  A file that could
    not be read is an error, as its row would be missing.  Null ids and repeated rows are files like others; very long texts
    have many pages; other columns of `pages` are ignored."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        enter("tiff")
        held: list[bytes] = []
        for b in batches:
            out, own = [], []
            cols = [b.column(c).to_pylist() for c in ("page", "pages", "media_bytes", "media_sha256", "pixels")]
            for k, (page, pages_, size, sha, pixels) in enumerate(zip(*cols)):
                held = [pixels] if page == 0 else [*held, pixels]
                if page + 1 == pages_:
                    data = b"".join(held)
                    own.append(k)
                    out.append((len(data.rstrip(b"\xff")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), size, sha, features_of(np.frombuffer(data, dtype=np.uint8))))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    whole = F.when(F.col("error").isNull(), F.col("pixels")).otherwise(F.raise_error(F.concat(F.lit("a stored file can't be read: "), F.col("error").cast("string"))))
    return pages.select(pages[id_col].alias("id"), "page", "pages", "media_bytes", "media_sha256", whole.alias("pixels")).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
