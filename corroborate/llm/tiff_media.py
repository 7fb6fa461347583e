"""Media columns: TIFF. Walk the image directories of a file, decode PackBits, LZW or deflate strips and tiles, undo
the horizontal predictor, and emit one row per page.

``pages`` reads any binary column of baseline files of either byte order, with chunky samples of 1, 8 or 16 bits. ``store``
writes a payload losslessly as the 8-bit samples of such a file, of several pages, strips or tiles. A null payload gives a
null file; a null or unreadable file gives one row with page -1 and the reason in ``error`` (the other columns null), so
no row is lost, whatever a file says: sizes and counts that its bytes can't fill are errors, and what a strip unpacks to is
bounded by its page. Repeated rows each give their rows; an empty table gives an empty result. Other columns of the input
are not read.
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

from .shared import by_bytes, id_and_text

#: Fixed values of the format: tags, and codes of the compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes of each field type.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LINE = 64
#: Bytes of texts or files that are worked on together.
BATCH_BYTES = 8_000_000
PAGE_ROW = "doc_id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, data binary, error string"
PAGE_NAMES = [x.split()[0] for x in PAGE_ROW.split(", ")]
#: Rows of 64 samples in a page that ``store`` writes, at most: the first page is short, so that many files have several.
FIRST_ROWS, PAGE_ROWS = 24, 1 << 14
#: Bytes of a decoded page at most, and for each byte of its strips (deflate packs no tighter).
PAGE_BYTES, EXPANSION = 1 << 30, 1100
FILL_ORDER = 266


def unpack_bits(data: bytes, most: int = PAGE_BYTES) -> bytes:
    out, i, n, size = [], 0, len(data), 0
    while i < n and size < most:
        c = data[i]
        size += c + 1 if c < 128 else 257 - c if c > 128 else 0
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += c + 2
        elif c > 128:
            out.append(data[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes are stored as runs, all else as literals; runs are found for all bytes at once."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    lengths = np.diff(np.append(starts, len(x)))
    long = lengths >= 3
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        out.extend(bytes([min(b - k, 128) - 1]) + data[k : min(b, k + 128)] for k in range(a, b, 128))

    for a, n in zip(starts[long].tolist(), lengths[long].tolist()):
        literal(at, a)
        at = a + n
        while n > 1:
            k = min(n, 128)
            out.append(bytes([257 - k, data[a]]))
            n -= k
        if n:
            literal(a, a + 1)
    literal(at, len(data))
    return b"".join(out)


def unpack_lzw(data: bytes, most: int = PAGE_BYTES) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early, as the format has it."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    own, out, bits, have, width, before, size = table[:], [], 0, 0, 9, b"", 0
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            own, width, before = table[:], 9, b""
            continue
        if code < len(own):
            now = own[code]
        elif before and code == len(own):
            now = before + before[:1]
        else:
            raise ValueError("LZW code before its entry")
        out.append(now)
        size += len(now)
        if size >= most:
            break
        if before:
            own.append(before + now[:1])
            n = len(own) + 1
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        before = now
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    table = {bytes([k]): k for k in range(256)}
    own, codes, widths, size, width, now = dict(table), [256], [9], 258, 9, b""
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if more in own:
            now = more
            continue
        codes.append(own[now])
        widths.append(width)
        own[more] = size
        size += 1
        now = data[k : k + 1]
        if size == 4094:
            codes.append(256)
            widths.append(width)
            own, size, width = dict(table), 258, 9
        elif size in (512, 1024, 2048):
            width += 1
    if now:
        codes.append(own[now])
        widths.append(width)
        if size + 1 in (512, 1024, 2048):
            width += 1
    codes.append(257)
    widths.append(width)
    code, wide = np.array(codes, np.int64), np.array(widths)
    place = np.arange(12)
    shift = wide[:, None] - 1 - place
    return np.packbits((code[:, None] >> np.maximum(shift, 0) & 1).astype(np.uint8)[shift >= 0]).tobytes()


def compress(data: bytes, how: int) -> bytes:
    return data if how == NONE else pack_bits(data) if how == PACKBITS else pack_lzw(data) if how == LZW else zlib.compress(data, 1)


def decompress(data: bytes, how: int, most: int = PAGE_BYTES) -> bytes:
    """What ``data`` unpacks to, as far as ``most`` bytes (a code may run over)."""
    if how == NONE:
        return data
    if how == PACKBITS:
        return unpack_bits(data, most)
    if how == LZW:
        return unpack_lzw(data, most)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {how}")


def difference(samples: np.ndarray) -> np.ndarray:
    """Horizontal predictor: each sample less the one before it in its row; rows, columns, samples."""
    out = samples.copy()
    out[:, 1:] -= samples[:, :-1]
    return out


def undo_difference(samples: np.ndarray) -> np.ndarray:
    return np.cumsum(samples, axis=1, dtype=samples.dtype)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 256, order: str = "<", tile_width: int = 0) -> bytes:
    """A file of 8-bit pages (rows, columns[, samples]) in strips, or in tiles of ``tile`` rows and ``tile_width`` (else as
    many) columns, both multiples of 16."""
    wide = tile_width or tile
    out, link = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4)), 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        h, w, s = page.shape
        if tile:
            padded = np.zeros((-(-h // tile) * tile, -(-w // wide) * wide, s), np.uint8)
            padded[:h, :w] = page
            parts = [padded[y : y + tile, x : x + wide] for y in range(0, h, tile) for x in range(0, w, wide)]
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, sizes = [], []
        for part in parts:
            data = compress((difference(part) if predictor == 2 else part).tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + bytes(len(data) % 2)
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * s), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if s >= 3 else 1])]
        fields += [(SAMPLES, 3, [s]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 3, [wide]), (TILE_HEIGHT, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_SIZES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_SIZES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                place = len(out)
                out += data + bytes(len(data) % 2)
                data = struct.pack(f"{order}I", place)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries) // 12) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(file: bytes) -> Iterator[dict[int, list[int]]]:
    """The fields of each image directory, in the file's order."""
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if not order or struct.unpack_from(f"{order}H", file, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", file, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", file, at)
        found = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", file, at + 2 + 12 * k)
            size = TYPE_SIZE.get(kind, 1) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", file, at + 10 + 12 * k)[0]
            if size > len(file):
                raise ValueError(f"field {tag} of {count} values")
            if kind in (1, 3, 4):
                found[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[kind // 2 if kind < 4 else 2]}", file, place))
        yield found
        (at,) = struct.unpack_from(f"{order}I", file, at + 2 + 12 * n)


def read_page(file: bytes, field: dict[int, list[int]], order: str = "<") -> np.ndarray:
    """Samples of one directory: rows, columns, samples; uint16 where they have 16 bits."""
    one = lambda tag, default: field.get(tag, [default])[0]
    w, h, s = field[WIDTH][0], field[HEIGHT][0], one(SAMPLES, 1)
    bits = set(field.get(BITS, [1]))
    if bits not in ({1}, {8}, {16}) or s < 1 or s > 1 and (one(PLANAR, 1) != 1 or bits == {1}):
        raise ValueError("only chunky samples of 8 or 16 bits, or one of 1 bit")
    how, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in field
    if predictor not in (1, 2) or predictor == 2 and bits == {1} or one(FILL_ORDER, 1) != 1:
        raise ValueError(f"predictor {predictor}, fill order {one(FILL_ORDER, 1)}")
    tw, th = (field[TILE_WIDTH][0], field[TILE_HEIGHT][0]) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    places, sizes = field[TILE_OFFSETS if tiled else STRIP_OFFSETS], field[TILE_SIZES if tiled else STRIP_SIZES]
    if not min(w, h, tw, th) or len(places) != len(sizes):
        raise ValueError("a side of 0, or sizes that don't go with offsets")
    across, down, kind = -(-w // tw), -(-h // th), np.dtype(f"{order}u2") if bits == {16} else np.dtype(np.uint8)
    line = -(-tw // 8) if bits == {1} else tw * s * kind.itemsize
    if len(places) < across * down or across * down * th * line > min(PAGE_BYTES, EXPANSION * (sum(sizes[: across * down]) + 64)):
        raise ValueError(f"{len(places)} parts of {sum(sizes)} bytes can't fill {w} x {h} x {s}")
    out = np.zeros((h, w, s), kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(places[: across * down], sizes)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        data = decompress(file[at : at + size], how, rows * line)
        if bits == {1}:
            part = np.unpackbits(np.frombuffer(data, np.uint8, rows * line).reshape(rows, line), axis=1)[:, :tw, None]
        else:
            part = np.frombuffer(data, kind, rows * tw * s).reshape(rows, tw, s).astype(out.dtype, copy=False)
        out[y : y + rows, x : x + tw] = (undo_difference(part) if predictor == 2 else part)[: h - y, : w - x]
    return out


def order_of(file: bytes) -> str:
    return ">" if file[:2] == b"MM" else "<"


def read_tiff(file: bytes) -> list[np.ndarray]:
    return [read_page(file, x, order_of(file)) for x in directories(file)]


#: The layouts that stored payloads take in turn, by their bytes' checksum: compression, predictor, rows and columns of tiles.
LAYOUTS = [(DEFLATE, 1, 0, 0), (DEFLATE, 2, 16, 32), (PACKBITS, 1, 0, 0), (PACKBITS, 1, 64, 48), (LZW, 1, 0, 0), (PACKBITS, 2, 64, 64), (NONE, 2, 0, 0), (DEFLATE, 2, 0, 0)]


def payload_of(data: bytes) -> bytes:
    """``data``, then bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % LINE or (0 if data else LINE))


def store(payload: bytes) -> bytes:
    how, predictor, tile, wide = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    samples = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    cuts = [0, *range(FIRST_ROWS, len(samples), PAGE_ROWS)]
    return write_tiff([samples[a:b] for a, b in zip(cuts, [*cuts[1:], len(samples)])], how, predictor, tile, order="<>"[payload[0] & 1], tile_width=wide)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (of the text in UTF-8), file binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) for x in batch.column(1)]
            for a, b in by_bytes(sizes, BATCH_BYTES):
                files = [store(payload_of(x.as_buffer().to_pybytes())) for x in batch.column(1).slice(a, b - a)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "file"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, file binary")


#: What a hostile file may raise.
WRONG = (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error)


def decoded(file: bytes | None) -> Iterator[tuple[int, dict, np.ndarray | None, Exception | None]]:
    """(page, its fields, samples, None) of each page of a file, or (page, fields, None, what is wrong with it). After a
    broken directory no more are found; a file without any readable one gives page -1."""
    if file is None:
        yield -1, {}, None, ValueError("no file")
        return
    found, k = directories(file), 0
    while True:
        try:
            if (field := next(found, None)) is None:
                return
        except WRONG as e:  # what follows can't be found
            yield k or -1, {}, None, e
            return
        try:
            yield k, field, read_page(file, field, order_of(file)), None
        except WRONG as e:
            yield k, field, None, e
        k += 1


def pages(files: DataFrame, id_col: str = "doc_id", file_col: str = "file", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: doc_id, page (0 first), width, height, samples, compression, predictor, tiled, data binary (16-bit
    samples little-endian), error. A page that can't be read has a row with its number and the error, and the others are
    read all the same; after a broken directory no more are found. A file without any readable directory has one row, of
    page -1. A file's rows follow each other. Columns named in ``keep`` go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(1)], BATCH_BYTES):
                rows, of = [], []
                for at, key, cell in zip(range(a, b), batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a)):
                    for k, field, x, e in decoded(cell.as_py()):
                        of.append(at)
                        if x is None:
                            rows.append((key, k, *[None] * 7, f"{type(e).__name__}: {e}"[:200]))
                        else:
                            data = x.astype("<u2").tobytes() if x.dtype.itemsize == 2 else x.tobytes()
                            rows.append((key, k, x.shape[1], x.shape[0], x.shape[2], field.get(COMPRESSION, [1])[0], field.get(PREDICTOR, [1])[0], TILE_OFFSETS in field, data, None))
                kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]
                kept = [x.take(pa.array(of, pa.int64())) for x in batch.columns[2:]]
                yield pa.record_batch([*(pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 10, kinds)), *kept], [*PAGE_NAMES, *keep])

    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(file_col).alias("file"), *keep)
    return rows.mapInArrow(run, ", ".join([PAGE_ROW, *[f"{c} {dict(rows.dtypes)[c]}" for c in keep]]))


def features(x: np.ndarray) -> str:
    """Mean, standard deviation and share of zero of some bytes."""
    n = np.bincount(x, minlength=256)
    mean = float(n @ np.arange(256)) / len(x)
    spread = max(0.0, float(n @ np.arange(256) ** 2) / len(x) - mean * mean) ** 0.5
    return f"{mean:.4f};{spread:.4f};{n[0] / len(x):.6f}"


def stored_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text in a media column, read the column back page by page, and compute features of what was read.

    Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64), media_bytes, media_sha256,
    feature (pages, layout of the first, mean and standard deviation of samples, share of zero samples), n_pages. A page
    that can't be read would end the job, so no digest is of less than the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        parts: list[bytes] = []
        head: tuple = ()

        def close() -> list[tuple]:
            if not parts:
                return []
            back, (key, layout, size, stored, digest) = b"".join(parts), head
            feature = f"{len(parts)};{layout};{features(np.frombuffer(back, np.uint8))}"
            return [(key, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-LINE:]), stored, digest, feature, len(parts))]

        as_batch = lambda rows: pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)
        for batch in batches:
            rows: list[tuple] = []
            for r in range(batch.num_rows):
                key, page, _, _, _, how, predictor, tiled, data, error, *kept = (x[r].as_py() for x in batch.columns)
                if error:
                    raise ValueError(f"doc_id {key}, page {page}: {error}")
                if page == 0:
                    rows += close()
                    parts, head = [], (key, f"c{how}p{predictor}" + "t" * tiled, *kept)
                parts.append(data)
            yield as_batch(rows)
        yield as_batch(close())

    files = media(docs, id_col, text_col).withColumns({"media_bytes": F.length("file").cast("long"), "media_sha256": F.sha2("file", 256)})
    read = pages(files, keep=("n_bytes", "media_bytes", "media_sha256"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
