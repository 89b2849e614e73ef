"""TIFF as a media column: text bytes stored as image pages, and a reader with a row per page.

The reader walks the chain of image directories of either byte order and decodes strips and tiles,
uncompressed, PackBits, LZW or deflate, undoes the horizontal predictor and emits a row for each
page. The writer stores a payload of 8-bit samples in pages WIDTH wide and at most HEIGHT high: a
page of one row in PackBits strips, one of two rows in LZW strips, one of less than TILED rows in
deflate strips, a larger one in deflate tiles; all but the first with the predictor. Digests are
folded from the stream of page rows, so a file of any number of pages is never held whole there.

A null or empty text is one row of padding, an empty table has no pages. All work is within a row of
the table; repeated rows give equal media. A file that is no TIFF, is cut short or damaged gives the
pages before the damage and then one row with a null page and the error; a null file gives one row
with neither. Further columns of a table may have any name: only the named ones are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trim

WIDTH, HEIGHT, TILED, STRIP, TILE = 576, 1024, 256, 32, (192, 64)
#: Tag numbers and values of the format.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}
NAMES = {v: k for k, v in TAGS.items()}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}


# compression


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    start = 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(k + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            literal(start, i)
            out.append(257 - (j - i))
            out.append(data[i])
            start = j
        i = j
    literal(start, n)
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    acc = bits = 0
    out = bytearray()
    table: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
            acc &= (1 << bits) - 1

    width, following = 9, 258
    put(256, 9)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            run = longer
            continue
        put(run[0] if len(run) == 1 else table[run], width)
        table[longer] = following
        following += 1
        if following == 4094:
            put(256, width)
            table, width, following = {}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
        run = data[i : i + 1]
    if run:
        put(run[0] if len(run) == 1 else table[run], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, acc, bits, width, last = list(single), [], 0, 0, 9, b""
    have = 0
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(single), 9, b""
            continue
        if code == 257 or have >= size:
            break
        if code < len(table):
            item = table[code]
        elif code == len(table) and last:
            item = last + last[:1]
        else:
            raise ValueError("an LZW code is out of range")
        out.append(item)
        have += len(item)
        if last and len(table) < 4096:
            table.append(last + item[:1])
        last = item
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _compress(data: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}[how](data)


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompress(data)
        except zlib.error as e:
            raise ValueError(f"a deflate strip is damaged: {e}") from None
    elif how in (NONE, LZW, PACKBITS):
        out = data if how == NONE else (unlzw if how == LZW else unpack_bits)(data, size)
    else:
        raise ValueError(f"compression {how} is not read")
    if len(out) < size:
        raise ValueError("a strip or tile is cut short")
    return out[:size]


# writing


def write_pages(pages: list[np.ndarray], compression: list[int] | int = DEFLATE, predictor: bool = True, tile: list[tuple[int, int] | None] | tuple[int, int] | None = None, strip: int = STRIP) -> bytes:
    """A little-endian TIFF of 8-bit grey pages; compression and tile for all pages or one for each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for k, page in enumerate(pages):
        how = compression[k] if isinstance(compression, list) else compression
        box = tile[k] if isinstance(tile, list) else tile
        step = predictor and how in (LZW, DEFLATE)
        high, wide = page.shape
        if box:
            w, h = box
            full = np.zeros((-(-high // h) * h, -(-wide // w) * w), np.uint8)
            full[:high, :wide] = page
            blocks = [full[y : y + h, x : x + w] for y in range(0, high, h) for x in range(0, wide, w)]
        else:
            blocks = [page[y : y + strip] for y in range(0, high, strip)]
        offsets, counts = [], []
        for b in blocks:
            if step:
                b = np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8))
            if how == PACKBITS:  # rows are packed apart
                data = b"".join(pack_bits(r.tobytes()) for r in b)
            else:
                data = _compress(np.ascontiguousarray(b).tobytes(), how)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        entries = {"width": wide, "height": high, "bits": 8, "compression": how, "photometric": 1, "samples": 1, "predictor": 2 if step else 1}
        entries |= {"tile_width": box[0], "tile_height": box[1], "tile_offsets": offsets, "tile_counts": counts} if box else {"rows_per_strip": strip, "strip_offsets": offsets, "strip_counts": counts}
        rows = []
        for tag, v in sorted((TAGS[n], v) for n, v in entries.items()):
            v = v if isinstance(v, list) else [v]
            if len(v) == 1:
                value = v[0]
            else:
                value = len(out)
                out += struct.pack(f"<{len(v)}I", *v)
            rows.append(struct.pack("<HHII", tag, 4, len(v), value))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(rows)) + b"".join(rows) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def store_bytes(data: bytes) -> bytes:
    """The bytes as pages, filled up with 255 to a positive multiple of the width."""
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    flat = np.full(size, 255, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    rows = flat.reshape(-1, WIDTH)
    pages = [rows[i : i + HEIGHT] for i in range(0, len(rows), HEIGHT)]
    return write_pages(pages, [{1: PACKBITS, 2: LZW}.get(len(p), DEFLATE) for p in pages], True, [TILE if len(p) >= TILED else None for p in pages])


# reading


def directories(data: bytes) -> Iterator[dict[str, list[int]]]:
    """The entries of each image directory, along the chain."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        try:
            n = struct.unpack_from(order + "H", data, at)[0]
            out = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if tag in NAMES and kind in KINDS:
                    form = f"{order}{count}{KINDS[kind]}"
                    size = struct.calcsize(form)
                    place = at + 10 + 12 * i
                    if size > 4:
                        place = struct.unpack_from(order + "I", data, place)[0]
                    out[NAMES[tag]] = list(struct.unpack_from(form, data, place))
            yield out
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        except struct.error as e:
            raise ValueError(f"a directory is cut short: {e}") from None


def page_samples(data: bytes, entries: dict[str, list[int]]) -> np.ndarray:
    """The samples of a page, an array of height, width (and of samples, if there are several)."""

    def one(name: str, default: int | None = None) -> int:
        if name not in entries and default is None:
            raise ValueError(f"a directory has no {name}")
        return entries.get(name, [default])[0]

    wide, high, depth, how = one("width"), one("height"), one("samples", 1), one("compression", NONE)
    if set(entries.get("bits", [1])) != {8} or one("planar", 1) != 1:
        raise ValueError("only chunky samples of 8 bits are read")
    tiled = "tile_offsets" in entries
    w, h = (one("tile_width"), one("tile_height")) if tiled else (wide, min(one("rows_per_strip", high), high))
    offsets, counts = (entries.get(f"{'tile' if tiled else 'strip'}_{x}", []) for x in ("offsets", "counts"))
    across, down = -(-wide // w), -(-high // h)
    if len(offsets) < across * down or len(counts) < across * down:
        raise ValueError("strips or tiles are missing")
    out = np.zeros((down * h, across * w, depth), np.uint8)
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, high - y)
        raw = data[offsets[k] : offsets[k] + counts[k]]
        block = np.frombuffer(_expand(raw, how, rows * w * depth), np.uint8).reshape(rows, w, depth)
        if one("predictor", 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + w] = block
    out = out[:high, :wide]
    return out[:, :, 0] if depth == 1 else out


#: A row for each page; `last` marks the last row of a file.
PAGE = "page int, width int, height int, samples binary, total long, squares long, last boolean, error string"
ARROW = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("total", pa.int64()), ("squares", pa.int64()), ("last", pa.bool_()), ("error", pa.string())])
#: Bytes of samples in an Arrow batch of pages, but for a single larger page.
SAMPLES = 1 << 22


def store(text: Column) -> Column:
    """The media of a text column."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([store_bytes((t.as_py() or "").encode()) for t in x], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def page_rows(data: bytes | None) -> Iterator[dict]:
    """The decoded pages of a file, one after another, and how it ends."""
    held: dict = dict.fromkeys(ARROW.names) | {"last": False}
    first = True
    try:
        for i, entries in enumerate(directories(data) if data is not None else ()):
            s = page_samples(data, entries)
            if not first:
                yield held
            first = False
            sums = np.bincount(s.ravel(), minlength=256)
            value = np.arange(256)
            held = dict(zip(ARROW.names, (i, s.shape[1], s.shape[0], s.tobytes(), int(sums @ value), int(sums @ value**2), False, None), strict=True))
        yield held | {"last": True}
    except (ValueError, IndexError, MemoryError, OverflowError) as e:  # what a damaged directory can lead to
        if not first:
            yield held
        yield dict.fromkeys(ARROW.names) | {"last": True, "error": str(e) or type(e).__name__}


def _read(carried: int):
    """Page rows of the files in the column after the carried ones, which each row of a file repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            owner: list[int] = []
            size = 0

            def done(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                own = batch.take(pa.array(owner, pa.int64())).columns[:carried]
                return pa.RecordBatch.from_arrays([*own, *pa.RecordBatch.from_pylist(rows, ARROW).columns], [*batch.schema.names[:carried], *ARROW.names])

            for i, media in enumerate(batch.column(carried)):
                for row in page_rows(media.as_py()):
                    rows.append(row)
                    owner.append(i)
                    size += len(row["samples"] or b"")
                    if size >= SAMPLES:
                        yield done()
                        rows, owner, size = [], [], 0
            if rows:
                yield done()
        trim()

    return run


def read_pages(df: DataFrame, key: str = "doc_id", media: str = "media", carry: Sequence[str] = ()) -> DataFrame:
    """One row for each page of each file: (key, *carry, page, width, height, samples, total, squares, last, error)."""
    bounded_batches(df.sparkSession)
    own = [key, *carry]
    rows = df.select(*own, F.col(media).alias("_media"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_read(len(own)), ", ".join([*fields, PAGE]))


def store_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of every whole text."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), store(F.col(text)).alias("media"))


FOLDED = [("pages", "int"), ("samples", "long"), ("total", "long"), ("squares", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("error", "string")]


def _fold(carried: int):
    """The page rows of each file, which follow one another, as one row."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = samples = total = squares = 0
        payload, tail = hashlib.sha256(), b""
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            columns = {c: batch.column(carried + i) for i, c in enumerate(ARROW.names)}
            number = {c: columns[c].to_pylist() for c in ("page", "total", "squares", "last", "error")}
            for i, data in enumerate(columns["samples"]):
                if number["page"][i] is not None:
                    raw = data.as_buffer()
                    payload.update(raw)
                    tail = (tail + raw[max(0, raw.size - 32) :].to_pybytes())[-32:]
                    pages, samples = pages + 1, samples + raw.size
                    total, squares = total + number["total"][i], squares + number["squares"][i]
                if number["last"][i]:
                    at.append(i)
                    out.append((pages, samples, total, squares, samples, payload.hexdigest(), zlib.crc32(tail), number["error"][i]))
                    pages = samples = total = squares = 0
                    payload, tail = hashlib.sha256(), b""
            if at:
                own = batch.take(pa.array(at, pa.int64())).columns[:carried]
                made = [pa.array(c, types[t]) for c, (_, t) in zip(zip(*out, strict=True), FOLDED, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *made], [*batch.schema.names[:carried], *(n for n, _ in FOLDED)])
        trim()

    return run


def digests(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the media hold, folded from their pages as these are read back; a damaged file names its error."""
    carry = ["n_bytes", "media_bytes", "media_sha256"]
    rows = stored.select(F.col(key), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    paged = read_pages(rows, key, "media", carry)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in paged.schema.fields[: 1 + len(carry)]]
    folded = paged.mapInArrow(_fold(1 + len(carry)), ", ".join([*fields, *(f"{n} {t}" for n, t in FOLDED)]))
    n = F.nullif("samples", F.lit(0))  # a damaged file may have no page
    mean = F.col("total") / n
    shape = F.format_string("pages=%d;rows=%d;mean=%.3f;deviation=%.3f", "pages", F.floor(n / WIDTH), mean, F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))))
    return folded.select(key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.when(F.col("error").isNull(), shape).alias("feature"), "error")
