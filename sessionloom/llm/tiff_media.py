"""Media columns holding TIFF files: write samples, walk the directories, decode, one row per page.

The reader follows the chain of image file directories in either byte order, decodes strips or tiles stored plain, with
PackBits, LZW (codes from the high bit, early change) or deflate, undoes horizontal differencing, and crops tiles at the
image's edge. A file that is cut short or no TIFF gives one row whose ``error`` says so; null bytes give none.

Text as media: a text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the 8-bit samples of grey
pages 64 wide and at most 16384 rows high, deflated in strips of 256 rows after horizontal differencing. Null counts as
empty (64 zero bytes). Equal texts give equal files. An empty table gives an empty one; a text of any length becomes one
file of as many pages as it needs. Repeated rows repeat; columns named like a result are replaced. Rows are handled in
steps of a megabyte of text or file, one row at least.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_slices

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 16384, 256
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: TIFF field types and their sizes in bytes.
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


#: A page of more samples than a binary value of Arrow can hold is refused; no codec here makes more than GROWTH of a byte.
MOST_BYTES, GROWTH = 2**31 - 1, 4096


class TiffError(ValueError):
    """The bytes are no TIFF that this reader can decode."""


def packbits_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Decodes until ``most`` bytes are there, as the other decoders do."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        count = data[at]
        at += 1
        if count < 128:
            out += data[at : at + count + 1]
            at += count + 1
        elif count > 128:
            out += data[at : at + 1] * (257 - count)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Clear code 256, end code 257, widths from 9 to 12 bits that grow one code early."""
    table: list[bytes] = []
    out: list[bytes] = []
    previous, width, bits, held, size = b"", 9, 0, 0, 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, previous = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        previous = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, held, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
            bits &= (1 << held) - 1

    table = {bytes((i,)): i for i in range(256)}
    put(256)
    current, size = b"", 258
    for i in range(len(data)):
        longer = current + data[i : i + 1]
        if longer in table:
            current = longer
            continue
        put(table[current])
        table[longer] = size
        size += 1
        width = min(12, max(9, size.bit_length()))
        if size >= 4094:
            put(256)
            table, size, width = {bytes((k,)): k for k in range(256)}, 258, 9
        current = data[i : i + 1]
    if current:
        put(table[current])
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    try:
        stream = zlib.decompressobj()
        found = stream.decompress(data, most)
        if not stream.decompress(stream.unconsumed_tail, 1) and not stream.eof:
            raise TiffError("deflate: the stream is cut short")
    except zlib.error as error:
        raise TiffError(f"deflate: {error}") from error
    return found


def _unpack(data: bytes, compression: int, most: int) -> bytes:
    """The first ``most`` bytes of a strip or tile, so that no stream makes more than its place holds."""
    if compression == NONE:
        return data[:most]
    if compression in (DEFLATE, OLD_DEFLATE):
        return _inflate(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression == PACKBITS:
        return packbits_decode(data, most)
    raise TiffError(f"compression {compression}")


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 1), LZW: lzw_encode, PACKBITS: packbits_encode}[compression](data)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = FIELD_SIZES.get(kind, 0) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if kind in FIELD_CODES:
                tags[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODES[kind]}", data, place)
        return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as error:
        raise TiffError(f"directory: {error}") from error


def _whole(tags: dict[int, tuple], tag: int, default: int | None = None) -> int:
    """The first value of a tag, a number above 0."""
    value = (tags.get(tag) or (default,))[0] if tag in tags or default is not None else None
    if tag in tags and not tags[tag] or value is None or value < 1:
        raise TiffError(f"tag {tag} is missing or no size")
    return value


def pages(data: bytes) -> Iterator[dict]:
    """Every page in order: width, height, samples (pixels' samples, rows from the top), compression, predictor, tiled."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        tags, at = _directory(data, at, order)
        width, height, planes = _whole(tags, 256), _whole(tags, 257), _whole(tags, 277, 1)
        if set(tags.get(258, (8,))) - {8} or _whole(tags, 284, 1) != 1:
            raise TiffError("only 8-bit samples, interleaved")
        compression, predictor = _whole(tags, 259, 1), _whole(tags, 317, 1)
        if width * height * planes > min(MOST_BYTES, GROWTH * len(data)):
            raise TiffError("a page larger than its bytes can hold")
        tiled = 324 in tags
        across, down = (_whole(tags, 322), _whole(tags, 323)) if tiled else (width, min(height, _whole(tags, 278, height)))
        if across * down * planes > min(MOST_BYTES, GROWTH * len(data)):
            raise TiffError("a tile larger than its bytes can hold")
        places, sizes = (tags[324], tags.get(325)) if tiled else (tags.get(273), tags.get(279))
        columns, lines = -(-width // across), -(-height // down)
        if not places or not sizes or min(len(places), len(sizes)) < columns * lines or min(places) < 0 or min(sizes) < 0:
            raise TiffError("strips or tiles are missing")
        image = np.zeros((height, width, planes), np.uint8)
        for k, (place, size) in enumerate(zip(places[: columns * lines], sizes, strict=False)):
            top, left = k // columns * down, k % columns * across
            rows = down if tiled else min(down, height - top)
            raw = np.frombuffer(_unpack(data[place : place + size], compression, rows * across * planes), np.uint8)
            if len(raw) < rows * across * planes:
                raise TiffError("a strip or tile is cut short")
            part = raw[: rows * across * planes].reshape(rows, across, planes)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            elif predictor != 1:
                raise TiffError(f"predictor {predictor}")
            image[top : top + rows, left : left + across] = part[: height - top, : width - left]
        yield {"width": width, "height": height, "planes": planes, "compression": compression, "predictor": predictor, "tiled": tiled, "samples": image.tobytes()}


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """Pages of 8-bit grey samples as one file; tile > 0: square tiles of that side, else strips of ``rows`` rows."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width = image.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = image
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [image[y : y + rows] for y in range(0, height, rows)]
        places, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            packed = _pack(np.ascontiguousarray(part, np.uint8).tobytes(), compression)
            places.append(len(out))
            sizes.append(len(packed))
            out += packed
        tags = {256: [width], 257: [height], 258: [8], 259: [compression], 262: [1], 277: [1], 317: [predictor]}
        tags |= {322: [tile], 323: [tile], 324: places, 325: sizes} if tile else {273: places, 278: [rows], 279: sizes}
        for values in tags.values():
            if len(values) > 1:
                place = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
                values[:] = [place, len(values)]
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag in sorted(tags):
            out += struct.pack(order + "HHII", tag, 4, (tags[tag] + [1])[1] if len(tags[tag]) > 1 else 1, tags[tag][0])
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded size, and the bytes padded with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def text_media(text: str | None) -> bytes:
    samples = np.frombuffer(payload(text)[1], np.uint8).reshape(-1, WIDTH)
    return write([samples[k : k + PAGE_ROWS] for k in range(0, len(samples), PAGE_ROWS)])


def feature(pages_read: int, counts: np.ndarray) -> str:
    """Pages, pixels, mean, deviation, share of zero samples and entropy in bits, from how often each sample occurs."""
    total = int(counts.sum())
    share, level = counts / total, np.arange(256)
    mean = float(share @ level)
    deviation = float(np.sqrt(max(0.0, share @ level**2 - mean * mean)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum()) + 0.0
    return f"pages={pages_read};pixels={total};mean={mean:.4f};sd={deviation:.4f};zero={share[0]:.6f};bits={entropy:.4f}"


def media_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Each row with its text stored as a TIFF file in column ``media`` in place of the text."""
    keep = [c for c in docs.columns if c not in (text, media, "n_bytes")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                texts = part.column(text).to_pylist()
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [sizes, pa.array(map(text_media, texts), pa.binary())], names=[*keep, "n_bytes", media])

    return docs.select(*keep, text).mapInArrow(run, schema)


PAGE_FIELDS = [("page", "int"), ("width", "int"), ("height", "int"), ("planes", "int"), ("compression", "int"), ("predictor", "int"), ("tiled", "boolean"), ("samples", "binary"), ("error", "string")]


def page_rows(frame: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of every file; a file that cannot be read gives one row with page null and the reason in error."""
    keep = [c for c in frame.columns if c != media and c not in dict(PAGE_FIELDS)]
    schema = T.StructType([frame.schema[c] for c in keep] + T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in PAGE_FIELDS)).fields)
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, media):
                rows, found = [], []
                for i, value in enumerate(part.column(media)):
                    if value.as_py() is None:
                        continue
                    try:
                        for n, page in enumerate(pages(value.as_py())):
                            rows.append(i)
                            found.append(page | {"page": n, "error": None})
                    except TiffError as error:
                        rows.append(i)
                        found.append({"error": str(error)})
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(rows, pa.int64())) for c in keep] + [pa.array([p.get(n) for p in found], kinds[t]) for n, t in PAGE_FIELDS], names=[*keep, *dict(PAGE_FIELDS)])

    return frame.select(*keep, media).mapInArrow(run, schema)


DIGEST_FIELDS = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("feature", "string")]


class _FileDigest:
    """What is kept of a file while its pages go by."""

    def __init__(self, row: pa.RecordBatch):
        self.row, self.sha, self.size, self.tail, self.pages, self.counts = row, hashlib.sha256(), 0, b"", 0, np.zeros(256, np.int64)

    def add(self, samples: memoryview) -> None:
        self.sha.update(samples)
        self.size += len(samples)
        self.tail = (self.tail + bytes(samples[-WIDTH:]))[-WIDTH:]
        self.pages += 1
        self.counts += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)

    def values(self) -> tuple:
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), feature(self.pages, self.counts)


def page_digests(rows: DataFrame) -> DataFrame:
    """One row per file from its rows of ``page_rows``, which follow each other in their partition; a page at a time is held.

    A file that could not be read fails the job here, as its content would be lost.
    """
    keep = [c for c in rows.columns if c not in dict(PAGE_FIELDS) and c not in dict(DIGEST_FIELDS)]
    schema = T.StructType([rows.schema[c] for c in keep] + T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in DIGEST_FIELDS)).fields)
    kinds = [pa.int64() if t == "long" else pa.string() for _, t in DIGEST_FIELDS]

    def result(files: list[_FileDigest]) -> pa.RecordBatch:
        own = pa.Table.from_batches([f.row for f in files]).combine_chunks()
        found = [pa.array(v, k) for v, k in zip(zip(*(f.values() for f in files), strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([own.column(c).combine_chunks() for c in keep] + found, names=[*keep, *dict(DIGEST_FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[_FileDigest] = []
        for batch in batches:
            own, samples = batch.select(keep), batch.column("samples")
            for i, (page, error) in enumerate(zip(batch.column("page").to_pylist(), batch.column("error").to_pylist(), strict=True)):
                if error is not None:
                    raise TiffError(error)
                if page == 0:
                    files.append(_FileDigest(own.take(pa.array([i]))))
                files[-1].add(memoryview(samples[i].as_buffer()))
            if len(files) > 1:
                yield result(files[:-1])
                del files[:-1]
        if files:
            yield result(files)

    return rows.select(*keep, "page", "samples", "error").mapInArrow(run, schema)


def media_digests(frame: DataFrame, media: str = "media") -> DataFrame:
    """Reads each stored file back page by page and digests its samples, the file's own size and digest beside them."""
    stored = frame.withColumns({"media_bytes": F.length(media).cast("long"), "media_sha256": F.sha2(media, 256)})
    return page_digests(page_rows(stored, media))


def op6_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(media_column(table(spark, sf_dir, "documents").select("doc_id", F.col("text"))))
