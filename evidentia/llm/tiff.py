"""TIFF columns: image directories walked, strips and tiles decoded, predictors undone, one row per page."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, small_batches

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: Tag numbers of the format (fixed).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
#: Bytes and unpacking codes of the field types that hold unsigned numbers.
_TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
#: Kinds of samples by the format's number (fixed), and the widths in bits that each may have.
_KINDS = {1: ("u", (1, 8, 16, 32)), 2: ("i", (8, 16, 32)), 3: ("f", (16, 32, 64))}
#: Decoded bytes of one file at most; pages beyond it are unreadable.
LARGEST = 1 << 30
#: No codec here makes more bytes of one (LZW: 3,839 of a code of 12 bits).
EXPANSION = 4096
#: Bytes of decoded files that are handed on together, or one larger file.
TOGETHER = 32 << 20

#: Shape of the pages written for payloads: one row of pixels is 192 bytes.
PAGE_WIDTH, PAGE_SAMPLES, PAGE_ROWS = 64, 3, 256
ROW_BYTES = PAGE_WIDTH * PAGE_SAMPLES
#: Codes after a clear code, by width, until the next width: the table grows by one entry a code.
_SPANS = ((9, 254), (10, 512), (11, 1024), (12, 2048))
CLEAR, STOP = 256, 257


class Broken(ValueError):
    """The file is no TIFF that this operator reads."""


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[:, None] >> np.arange(width - 1, -1, -1)) & 1


def lzw_encode(data: bytes) -> bytes:
    """Most-significant-bit-first LZW of 9 to 12 bits with early change, clearing a full table."""
    codes, run = [], [CLEAR]
    table: dict[int, int] = {}
    get, fresh, prefix = table.get, CLEAR + 2, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = get(key := prefix << 8 | byte)
        if code is not None:
            prefix = code
            continue
        run.append(prefix)
        if fresh == 4094:
            codes.append(run)
            run, fresh = [CLEAR], CLEAR + 2
            table.clear()
        else:
            table[key] = fresh
            fresh += 1
        prefix = byte
    if prefix >= 0:
        run.append(prefix)
    run.append(STOP)
    codes.append(run)
    bits, width = [], 9
    for run in codes:
        all_ = np.array(run, np.int32)
        bits.append(_bits(all_[:1], width).ravel())  # the clear code still has the width before it
        at = 1
        for width, span in _SPANS:  # noqa: B007
            bits.append(_bits(all_[at : at + span], width).ravel())
            at += span
            if at >= len(all_):
                break
    return np.packbits(np.concatenate(bits).astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int = 1 << 62) -> bytes:
    """The bytes of the stream, up to the code that completes `size` bytes."""
    stream = np.unpackbits(np.frombuffer(data, np.uint8))
    out: list[bytes] = []
    at = made = 0
    roots = [bytes([b]) for b in range(256)] + [b"", b""]
    start = True
    while True:
        table, last, again = list(roots), b"", False
        for width, span in _SPANS:
            if start:
                width, span = 9, 1
            n = min(span, (len(stream) - at) // width)
            if n < 1:
                return b"".join(out)
            weights = 1 << np.arange(width - 1, -1, -1)
            codes = (stream[at : at + n * width].reshape(n, width) @ weights).tolist()
            for k, code in enumerate(codes):
                if code == CLEAR:
                    at += (k + 1) * width
                    again = True
                    break
                if code == STOP:
                    return b"".join(out)
                if code < len(table):
                    entry = table[code]
                    if last:
                        table.append(last + entry[:1])
                elif last and code == len(table):
                    entry = last + last[:1]
                    table.append(entry)
                else:
                    raise Broken("an LZW code is not in the table")
                out.append(entry)
                last = entry
                made += len(entry)
                if made >= size:
                    return b"".join(out)
            if again:
                break
            if start:
                raise Broken("an LZW stream starts without a clear code")
            at += n * width
        start = False
        if not again:
            raise Broken("an LZW table is over full")


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(lo, hi):
        for i in range(lo, hi, 128):
            part = data[i : min(i + 128, hi)]
            out.append(bytes([len(part) - 1]) + part)

    for m in _RUN.finditer(data):
        literal(at, m.start())
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(at, len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int = 1 << 62) -> bytes:
    out, at, n, made = [], 0, len(data), 0
    while at < n and made < size:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
            made += 1 + head
        elif head == 128:
            at += 1
        else:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
            made += 257 - head
    return b"".join(out)


def _compress(block: np.ndarray, compression: int) -> bytes:
    if compression == NONE:
        return block.tobytes()
    if compression == PACKBITS:  # rows are packed one by one
        return b"".join(packbits_encode(row.tobytes()) for row in block)
    return lzw_encode(block.tobytes()) if compression == LZW else zlib.compress(block.tobytes(), 6)


def _expand(data: bytes, compression: int, size: int) -> bytes:
    """The first `size` bytes of a strip or tile; no more are made than these and one code's."""
    try:
        if compression == NONE:
            raw = data
        elif compression == PACKBITS:
            raw = packbits_decode(data, size)
        elif compression == LZW:
            raw = lzw_decode(data, size)
        elif compression in (DEFLATE, 32946):
            raw = zlib.decompressobj().decompress(data, size)
        else:
            raise Broken(f"compression {compression}")
    except zlib.error as e:
        raise Broken(f"deflate: {e}") from e
    if len(raw) < size:
        raise Broken("a strip or tile is too short")
    return raw[:size]


def write_tiff(pages: list[np.ndarray], layouts: list[tuple[int, int, bool]]) -> bytes:
    """A little-endian TIFF of 8-bit pages (rows, width, samples); a layout is (compression, predictor, tiled)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image, (compression, predictor, tiled) in zip(pages, layouts, strict=True):
        rows, width, samples = image.shape
        if tiled:
            side = 32
            down, across = -(-rows // side), -(-width // side)
            full = np.zeros((down * side, across * side, samples), np.uint8)
            full[:rows, :width] = image
            parts = [full[y * side : y * side + side, x * side : x * side + side] for y in range(down) for x in range(across)]
        else:
            side = 64
            parts = [image[y : y + side] for y in range(0, rows, side)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            data = _compress(part, compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        tags = {WIDTH: [width], HEIGHT: [rows], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [side], TILE_HEIGHT: [side], TILES: offsets, TILE_BYTES: counts} if tiled else {STRIPS: offsets, ROWS_PER_STRIP: [side], STRIP_BYTES: counts}
        fields = []
        for tag, values in sorted(tags.items()):
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            raw = struct.pack(f"<{len(values)}{_TYPES[kind][1]}", *values)
            if len(raw) > 4:
                spot = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", spot)
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack("<I", len(out))
        link = len(out) + 2 + 12 * len(fields)
        out += struct.pack("<H", len(fields)) + b"".join(fields) + b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    """A directory's tags with unsigned numbers, and where the next directory is (0: there is none)."""

    def numbers(code, count, spot):
        if spot + count * struct.calcsize(code) > len(data):
            raise Broken("a directory reaches beyond the file")
        return np.frombuffer(data, order + {"B": "u1", "H": "u2", "I": "u4"}[code], count, spot).tolist()

    (n,) = numbers("H", 1, at)
    (following,) = numbers("I", 1, at + 2 + 12 * n)
    tags: dict[int, list[int]] = {}
    for spot in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind = numbers("H", 2, spot)
        (count,) = numbers("I", 1, spot + 4)
        if kind in _TYPES and count:
            size, code = _TYPES[kind]
            tags[tag] = numbers(code, count, spot + 8 if size * count <= 4 else numbers("I", 1, spot + 8)[0])
    return tags, following


def read_tiff(data: bytes, largest: int = LARGEST):
    """Each page's (tags, samples as an array of rows, width, samples), following the chain of directories.

    A page that cannot be read has None for its samples; the first fault is raised after the last page, a
    broken directory ends the file. Whatever the bytes, the only error is Broken, and no more than `largest`
    bytes are decoded.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise Broken("no TIFF header")
    fault, seen, room = None, set(), [largest]  # the room is spent by pages that fail, too
    (at,) = struct.unpack_from(order + "I", data, 4)
    while at:
        if at in seen:
            raise fault or Broken("the directories form a loop")
        seen.add(at)
        try:
            tags, at = _fields(data, order, at)
        except Broken as e:
            raise fault or e from e
        try:
            image = _pixels(data, tags, order, room)
        except Broken as e:
            image, fault = None, fault or e
        yield tags, image
    if fault:
        raise fault


def _pixels(data: bytes, tags: dict[int, list[int]], order: str, room: list[int]) -> np.ndarray:
    def one(tag, default=None):
        found = set(tags[tag]) if tag in (BITS, FORMAT) and tag in tags else set(tags.get(tag, [default])[:1])
        if found == {None} or len(found) > 1:
            raise Broken(f"tag {tag} is missing or mixed")
        return found.pop()

    width, rows, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    kind, widths = _KINDS.get(one(FORMAT, 1), ("", ()))
    if bits not in widths or planar not in (1, 2) or min(width, rows, samples) < 1:
        raise Broken("samples of this format are not read")
    if predictor != 1 and (predictor, kind == "f") not in ((2, False), (3, True)) or predictor == 2 and bits == 1:
        raise Broken("this predictor is not read")
    planes, chunk = (samples, 1) if planar == 2 else (1, samples)
    item = max(1, bits // 8)
    if TILES in tags:
        tall, wide = one(TILE_HEIGHT), one(TILE_WIDTH)
        offsets, counts = tags[TILES], tags.get(TILE_BYTES, [])
    else:
        tall, wide = min(one(ROWS_PER_STRIP, rows), rows), width
        offsets, counts = tags.get(STRIPS, []), tags.get(STRIP_BYTES, [])
    if min(tall, wide) < 1:
        raise Broken("strips or tiles without size")
    down, across = -(-rows // tall), -(-width // wide)
    if len(offsets) != planes * down * across or len(counts) != len(offsets):
        raise Broken("the number of strips or tiles is wrong")
    line = -(-wide * chunk * bits // 8)
    if rows * width * samples * item > room[0] or planes * rows * across * line > EXPANSION * len(data):
        raise Broken("the page is too large")
    image = np.empty((rows, width, samples), f"{kind}{item}")
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, y, x = k // (down * across), k // across % down * tall, k % across * wide
        height = tall if TILES in tags else min(tall, rows - y)
        room[0] -= height * wide * chunk * item
        if room[0] < 0:
            raise Broken("the file is too large")
        block = np.frombuffer(_expand(data[offset : offset + count], compression, height * line), np.uint8).reshape(height, line)
        if bits == 1:
            block = np.unpackbits(block, axis=1)[:, : wide * chunk]
        elif predictor == 3:  # a row's bytes by place in the number, the highest first, as differences
            block = np.cumsum(block.reshape(height, -1, chunk), axis=1, dtype=np.uint8).reshape(height, item, wide * chunk)
            block = np.ascontiguousarray(block.transpose(0, 2, 1)).view(f">f{item}")
        else:
            block = block.view(f"{order}{'u' if predictor == 2 else kind}{item}")
        block = block.reshape(height, wide, chunk)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=f"u{item}").view(f"{kind}{item}")
        part = image[y : y + height, x : x + wide, plane if planar == 2 else 0 :][:, :, :chunk]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return image


def page_feature(image: np.ndarray) -> str:
    """The mean sample, and a 64-bit average hash over 64 equal runs of the samples."""
    flat = image.ravel()
    kind = np.float64 if image.dtype.kind == "f" else np.int64
    with np.errstate(all="ignore"):
        total = np.add.reduceat(flat, np.arange(64) * len(flat) // 64, dtype=kind) if len(flat) >= 64 else np.zeros(64, np.int64)
        sizes = np.diff(np.append(np.arange(64) * len(flat) // 64, len(flat)))
        mean = float(flat.mean(dtype=np.float64))
    bits = np.packbits(total > mean * sizes).tobytes().hex()
    return f"{mean:.2f}/{bits}"


def payload_layout(raw: bytes, page: int) -> tuple[int, int, bool]:
    """The layout of a payload's page, by its content alone: each codec, predictor and form as often as any other."""
    spin = zlib.crc32(raw, page) >> 8
    compression = (LZW, NONE, PACKBITS, DEFLATE)[spin % 4]
    return compression, 2 if compression in (LZW, DEFLATE) and spin >> 4 & 1 else 1, bool(spin >> 5 & 1)


def payload_tiff(text: str | None) -> bytes:
    """The text's UTF-8 bytes and spaces up to a positive multiple of a pixel row, as a TIFF of RGB pages."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    raw += b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES)
    image = np.frombuffer(raw, np.uint8).reshape(-1, PAGE_WIDTH, PAGE_SAMPLES)
    pages = [image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)]
    return write_tiff(pages, [payload_layout(p.tobytes(), k) for k, p in enumerate(pages)])


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, media (the text's payload as a TIFF); null counts as empty text."""
    small_batches(df)
    own, kind, back = carried(df, id_col)
    rows = df.select(own.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for pdf in batches:
            for lo, hi in _runs(pdf["text"]):
                part = pdf.iloc[lo:hi]
                yield pd.DataFrame({"id": part["id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in part["text"]], "media": [payload_tiff(t) for t in part["text"]]})

    out = rows.mapInPandas(run, f"id {kind}, n_bytes long, media binary")
    return out.select(back(F.col("id")).alias(id_col), "n_bytes", "media")


def _runs(column, limit: int = TOGETHER):
    """(first, after last) of runs of values of at most `limit` characters or bytes, or one longer value."""
    lo = size = 0
    for i, value in enumerate(column):
        n = len(value) if value is not None else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(column):
        yield lo, len(column)


_PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, feature string, data binary"


def tiff_files(df: DataFrame, media_col: str = "media", largest: int = LARGEST, joined: bool = False) -> DataFrame:
    """The input with `pages` (array of page structs, in order) and `error` instead of columns of these names.

    A page's `data` are its samples row by row: a byte each for 1 and 8 bits, else little-endian numbers of
    `bits`. joined: the samples of all pages follow one another in a column `payload`, and `data` is null.
    Pages that cannot be read are left out, the others keep their number in the file, and `error` tells the
    first fault; a broken directory ends the file. A null or empty file has no pages and the error `no TIFF
    header`; no bytes make the task fail, and a file gives `largest` bytes at most. An empty table gives no rows.
    """
    df = df.drop(*(c for c in df.columns if c in ("pages", "error") or joined and c == "payload"))

    def one(data):
        pages, samples, error = [], [], None
        try:
            for page, (tags, image) in enumerate(read_tiff(data or b"", largest)):
                if image is None:
                    continue
                raw = image.tobytes()
                samples.append(raw)
                pages.append({
                    "page": page, "width": image.shape[1], "height": image.shape[0], "samples": image.shape[2], "bits": tags.get(BITS, [1])[0],
                    "compression": tags.get(COMPRESSION, [1])[0], "predictor": tags.get(PREDICTOR, [1])[0], "tiled": TILES in tags,
                    "feature": page_feature(image), "data": None if joined else raw,
                })
        except Broken as e:
            error = str(e)
        return pages, error, samples

    def run(batches):
        for pdf in batches:
            lo, size, made = 0, 0, []
            for i, data in enumerate(pdf[media_col]):
                made.append(one(data))
                size += sum(map(len, made[-1][2]))
                if size > TOGETHER or i + 1 == len(pdf):
                    out = pdf.iloc[lo : i + 1].copy()
                    out["pages"], out["error"] = [m[0] for m in made], [m[1] for m in made]
                    yield out.assign(payload=[b"".join(m[2]) for m in made]) if joined else out
                    lo, size, made = i + 1, 0, []

    small_batches(df)
    ways = {c: carried(df, c) for c in df.columns}
    own = ", ".join(f"`{c}` {kind}" for c, (_, kind, _) in ways.items())
    out = df.select(*(column.alias(c) for c, (column, _, _) in ways.items())).mapInPandas(run, f"{own}, pages array<struct<{_PAGE.replace(' ', ': ').replace(',:', ',')}>>, error string" + ", payload binary" * joined)
    return out.select(*(back(F.col(c)).alias(c) for c, (_, _, back) in ways.items()), *out.columns[len(ways) :])


def tiff_pages(df: DataFrame, media_col: str = "media", largest: int = LARGEST) -> DataFrame:
    """One row per page: the other input columns, then the page's own columns and `error`; columns that clash
    with these names are dropped. A file without a readable page gives one row with null page columns."""
    names = [x.split()[0] for x in _PAGE.split(", ")]
    files = tiff_files(df.drop(*(c for c in df.columns if c in names and c != media_col)), media_col, largest)
    rest = [c for c in files.columns if c not in (media_col, "pages", "error")]
    out = files.select(*rest, F.explode_outer("pages").alias("_page"), "error")
    return out.select(*rest, *(F.col(f"_page.{n}").alias(n) for n in names), "error")
