"""Image files that are read in parts: TIFF and DICOM series.

A page of a file is strips or tiles at known offsets.  The ``voxels`` data source turns the pages
into partitions of some megabytes each, so that one large file is many tasks, and reads only the
bytes that a region needs: the strips or tiles it crosses, and of uncompressed ones only its
rows.  A region is given when reading, or comes from filters on x, y and z where
``spark.sql.python.filterPushdown.enabled`` is set.  Paths are those of pyarrow's file systems.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..raster import AXES, PIXELS, Geometry, Raster
from ..staging import staged

#: Bytes of voxels that a partition reads, as far as strips and tiles allow.
SPLIT = 1 << 23

ReadAt = Callable[[int, int], bytes]
Region = list[list[int]]


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def listed(path: str, endings: Sequence[str]) -> list[str]:
    """The files of a folder with one of ``endings`` (or the file itself), in order."""
    store, inner = open_store(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if store.get_file_info(inner).is_file:
        return [path]
    found = store.get_file_info(pa.fs.FileSelector(inner))
    return sorted(head + f.path for f in found if f.is_file and (not endings or f.path.lower().endswith(tuple(endings))))


@dataclass
class Page:
    """A plane of voxels: where its strips or tiles (``rows`` by ``columns``) lie in a file."""

    path: str
    image: int
    z: int | None
    width: int
    height: int
    kind: str
    rows: int
    columns: int
    offsets: list[int]
    counts: list[int]
    compression: int = 1
    predictor: int = 1
    samples: int = 1
    slope: float = 1.0
    intercept: float = 0.0
    spacing: list[float] = field(default_factory=lambda: [1.0, 1.0])

    @property
    def row_bytes(self) -> int:
        return self.columns * self.samples * np.dtype(self.kind).itemsize


# TIFF

#: Fixed values of the format: sizes of field types, tags, compressions.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
X_RESOLUTION, Y_RESOLUTION, PLANAR, RESOLUTION_UNIT, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 282, 283, 284, 296, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
MILLIMETRES = {2: 25.4, 3: 10.0}


def tiff_pages(read: ReadAt, path: str = "", image: int = 0) -> list[Page]:
    """The pages of a TIFF or BigTIFF file, from its headers alone."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError(f"{path}: not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count_kind, entry, slot = ("Q", 20, 8) if big else ("H", 12, 4)
    pages = []
    while at:
        width = struct.calcsize(f"{order}{count_kind}")
        n = struct.unpack(f"{order}{count_kind}", read(at, width))[0]
        block = read(at + width, n * entry + slot)
        tags = {}
        for k in range(n):
            e = block[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(f"{order}HH", e[:4])
            count = struct.unpack(f"{order}{'Q' if big else 'I'}", e[4 : 4 + slot])[0]
            code = TYPES.get(kind)
            if code is None:
                continue
            size = count * struct.calcsize(f"{order}{code}")
            data = e[-slot:][:size] if size <= slot else read(struct.unpack(f"{order}{'Q' if big else 'I'}", e[-slot:])[0], size)
            tags[tag] = [data] if code == "s" else list(struct.unpack(f"{order}{count * len(code)}{code[0]}", data))
        pages.append(_page(tags, order, path, image, len(pages)))
        at = struct.unpack(f"{order}{'Q' if big else 'I'}", block[-slot:])[0]
    return pages


def _page(tags: dict[int, list], order: str, path: str, image: int, z: int) -> Page:
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    bits, samples = one(BITS, 1), one(SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    compression = one(COMPRESSION, 1)
    if bits not in (8, 16, 32, 64) or kind is None or (kind == "f" and bits < 32) or len(set(tags.get(BITS, [bits]))) > 1:
        raise ValueError(f"{path}: {bits}-bit samples of this format are not read")
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"{path}: compression {compression} with predictor {one(PREDICTOR, 1)} is not read")
    if samples > 1 and one(PLANAR, 1) != 1:
        raise ValueError(f"{path}: separate planes of samples are not read")
    tiled = TILE_OFFSETS in tags
    unit, spacing = MILLIMETRES.get(one(RESOLUTION_UNIT, 2)), [1.0, 1.0]
    for k, tag in enumerate((X_RESOLUTION, Y_RESOLUTION)):
        if unit and tag in tags and tags[tag][0]:
            spacing[k] = unit * tags[tag][1] / tags[tag][0]
    return Page(
        path, image, z, one(WIDTH), one(HEIGHT), f"{order}{kind}{bits // 8}", one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, 2**32 - 1), one(HEIGHT)), one(TILE_WIDTH) if tiled else one(WIDTH),
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], compression, one(PREDICTOR, 1), samples, spacing=spacing,
    )


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    out, table, before = bytearray(), [], b""
    bits, held, width = 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if before:
            table.append(before + (table[code] if code < len(table) else before)[:1])
        before = table[code]
        out += before
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


# Partitions


@dataclass
class Piece(InputPartition):
    """Bytes to read and the voxels they hold: ``rows`` from ``row`` and columns from ``column``."""

    page: dict
    offset: int
    length: int
    row: int
    rows: int
    column: int

    def __init__(self, page, offset, length, row, rows, column):
        self.page, self.offset, self.length, self.row, self.rows, self.column = page, offset, length, row, rows, column


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece], region: Region):
        self.pieces, self.region = pieces, region


def plan(pages: Sequence[Page], region: Region, split: int = SPLIT) -> list[Pieces]:
    """Partitions that read a region: first and last voxel of each axis, the last one included."""
    (x0, x1), (y0, y1) = region[:2]
    out, held, size = [], [], 0
    for page in pages:
        if page.z is not None and len(region) > 2 and not region[2][0] <= page.z <= region[2][1]:
            continue
        across = -(-page.width // page.columns)
        down = -(-page.height // page.rows)
        lean = asdict(page) | {"offsets": [], "counts": []}
        for j in range(max(y0, 0) // page.rows, min(y1 // page.rows + 1, down)):
            for i in range(max(x0, 0) // page.columns, min(x1 // page.columns + 1, across)):
                k, top = j * across + i, j * page.rows
                there = page.rows if page.columns < page.width or across > 1 else min(page.rows, page.height - top)
                pieces = [(top, there, page.offsets[k], page.counts[k])]
                if page.compression == NONE:
                    first, last = max(y0, top), min(y1 + 1, top + there, page.height)
                    step = max(1, split // page.row_bytes)
                    pieces = [(r, min(step, last - r), page.offsets[k] + (r - top) * page.row_bytes, min(step, last - r) * page.row_bytes) for r in range(first, last, step)]
                for row, rows, offset, length in pieces:
                    held.append(Piece(lean, offset, length, row, rows, i * page.columns))
                    size += rows * page.row_bytes
                    if size >= split:
                        out.append(Pieces(held, region))
                        held, size = [], 0
    return [*out, Pieces(held, region)] if held else out


def voxels_of(piece: Piece, data: bytes, region: Region) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """x, y and values of the piece's voxels inside the region."""
    page = Page(**piece.page)
    raw = np.frombuffer(UNPACK[page.compression](data), page.kind)
    rows = min(piece.rows, len(raw) // (page.columns * page.samples))
    a = raw[: rows * page.columns * page.samples].reshape(rows, page.columns, page.samples)
    a = a.astype(a.dtype.newbyteorder("="))
    if page.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    low_y, high_y = max(region[1][0], piece.row), min(region[1][1] + 1, piece.row + rows, page.height)
    low_x, high_x = max(region[0][0], piece.column), min(region[0][1] + 1, piece.column + page.columns, page.width)
    if low_y >= high_y or low_x >= high_x:
        return None
    a = a[low_y - piece.row : high_y - piece.row, low_x - piece.column : high_x - piece.column]
    if (page.slope, page.intercept) != (1.0, 0.0):
        a = (a * page.slope + page.intercept).astype(np.float32)
    y, x = np.indices(a.shape[:2])
    return (x + low_x).ravel(), (y + low_y).ravel(), a.reshape(-1, page.samples)


class VoxelReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.pages = schema, [Page(**p) for p in json.loads(options["pages"])]
        self.region, self.split = json.loads(options["region"]), int(options.get("split", SPLIT))

    def partitions(self):
        return plan(self.pages, self.region, self.split) or [Pieces([], self.region)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, store = to_arrow_schema(self.schema), {}
        for piece in partition.pieces:
            path = piece.page["path"]
            if path not in store:
                for f in store.values():
                    f.close()
                system, inner = open_store(path)
                store = {path: system.open_input_file(inner)}
            got = voxels_of(piece, store[path].read_at(piece.length, piece.offset), partition.region)
            if got is None:
                continue
            x, y, v = got
            n, kind = len(x), schema.field("v").type
            if pa.types.is_list(kind):
                values = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), pa.array(v.ravel()).cast(kind.value_type))
            elif pa.types.is_decimal(kind):
                values = pa.array(v.ravel()).cast(pa.decimal128(20, 0))
            else:
                values = pa.array(v.ravel()).cast(kind)
            axes = [pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))] + ([] if piece.page["z"] is None else [pa.array(np.full(n, piece.page["z"], np.int32))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, piece.page["image"], np.int64)), *axes, values.cast(kind)], schema=schema)
        for f in store.values():
            f.close()


class PrunedReader(VoxelReader):
    def pushFilters(self, filters: list[Filter]):
        """Bounds on the axes narrow the region; Spark still checks every filter."""
        for f in filters:
            axis = AXES.index(f.attribute[0]) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in AXES[: len(self.region)] else None
            if axis is not None and isinstance(f.value, int):
                bounds = self.region[axis]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    bounds[0] = max(bounds[0], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    bounds[1] = min(bounds[1], f.value - isinstance(f, LessThan))
        yield from filters


class VoxelSource(DataSource):
    """Options: ``pages`` and ``region`` as JSON, ``split`` in bytes, ``columns`` as DDL, and
    ``pushdown`` (true: filters narrow the region, which the session must allow)."""

    @classmethod
    def name(cls) -> str:
        return "voxels"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> VoxelReader:
        return (PrunedReader if self.options.get("pushdown") == "true" else VoxelReader)(schema, self.options)


def _raster(spark: SparkSession, pages: list[Page], g: Geometry, region: Region | None, split: int) -> Raster:
    """Voxels of a region (default: all), on the grid that starts at the region's first voxel."""
    first = pages[0]
    if len({(p.width, p.height, np.dtype(p.kind).newbyteorder("="), p.samples) for p in pages}) > 1:
        raise ValueError("pages differ in size or type")
    d, box = len(g.size), region or [[0, n - 1] for n in g.size]
    box = [[max(lo, 0), min(hi, n - 1)] for (lo, hi), n in zip(box, g.size)]
    if len(box) != d or any(lo > hi for lo, hi in box):
        raise ValueError("the region holds no voxel")
    real = any((p.slope, p.intercept) != (1.0, 0.0) for p in pages)
    pixel = PIXELS["float32" if real else np.dtype(first.kind).newbyteorder("=").name]
    value = f"array<{pixel.spark}>" if first.samples > 1 else pixel.spark
    columns = "image_id bigint, " + ", ".join(f"{a} int" for a in AXES[:d]) + f", v {value}"
    spark.dataSource.register(VoxelSource)
    lean = [asdict(p) | {"z": p.z if d > 2 else None} for p in pages]
    options = {"pages": json.dumps(lean), "region": json.dumps(box), "split": str(split), "columns": columns, "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    df = spark.read.format("voxels").options(**options).load()
    moved = [(F.col(a) - lo).cast("int").alias(a) if lo else F.col(a) for a, (lo, _) in zip(AXES, box)]
    return Raster(df.select("image_id", *moved, "v"), g.shifted([lo for lo, _ in box], [hi - lo + 1 for lo, hi in box]), pixel)


def read_tiff(spark: SparkSession, path: str, region: Region | None = None, split: int = SPLIT) -> Raster:
    """A TIFF file, or those of a folder as images in order of their names.  Pages are planes along z;
    a single page makes a plane image.  Only headers are read before the query runs."""
    pages = []
    for i, name in enumerate(listed(path, (".tif", ".tiff"))):
        store, inner = open_store(name)
        with store.open_input_file(inner) as f:
            pages += tiff_pages(lambda at, n: f.read_at(n, at), name, i)  # noqa: B023
    if not pages:
        raise ValueError(f"{path}: no TIFF files")
    counts = {sum(p.image == i for p in pages) for i in {p.image for p in pages}}
    if len(counts) > 1:
        raise ValueError("files differ in their number of pages")
    p, depth = pages[0], counts.pop()
    size, spacing = [p.width, p.height], list(p.spacing)
    return _raster(spark, pages, Geometry((*size, depth) if depth > 1 else tuple(size), (*spacing, 1.0) if depth > 1 else tuple(spacing)), region, split)


def _directory(order: str, big: bool, tags: list[tuple[int, int, list]], at: int, last: bool) -> bytes:
    """A directory at ``at`` with the values that do not fit into it behind it."""
    slot, width = (8, 8) if big else (4, 2)
    body, extra = b"", b""
    behind = at + width + len(tags) * (20 if big else 12) + slot
    for tag, kind, values in sorted(tags):
        code = TYPES[kind]
        data = struct.pack(f"{order}{len(values)}{code[0]}", *values)
        body += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, kind, len(values) // len(code))
        if len(data) > slot:
            extra += b"\0" * ((behind + len(extra)) % 2)
            body += struct.pack(f"{order}{'Q' if big else 'I'}", behind + len(extra))
            extra += data
        else:
            body += data.ljust(slot, b"\0")
    extra += b"\0" * ((behind + len(extra)) % 2)
    following = 0 if last else behind + len(extra)
    return struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + body + struct.pack(f"{order}{'Q' if big else 'I'}", following) + extra


def write_tiff(r: Raster, folder: str, compression: str = "none", level: int = 6, rows: int | None = None) -> DataFrame:
    """``image_id``, ``path``, ``bytes`` of one TIFF file for each image (``image_<id>.tif``), written at once.

    Strips of ``rows`` lines (default: about 64 KB) are packed in parallel; a task then appends an
    image's strips in order without holding them.  Files of 4 GB or more are BigTIFF.
    ``deflate`` packs by zlib at ``level``.
    """
    if compression not in ("none", "deflate") or r.dim not in (2, 3):
        raise ValueError("TIFF files are planes or stacks of them, packed by none or deflate")
    g, kind = r.geometry, np.dtype(r.pixel.name)
    width, height, depth = g.size[0], g.size[1], g.size[2] if r.dim > 2 else 1
    each = rows or max(1, min(height, (1 << 16) // (width * kind.itemsize)))

    def pack(strip: pa.Table) -> pa.Table:
        top = strip.column("strip")[0].as_py() * each
        a = np.zeros((min(each, height - top), width), kind)
        v = strip.column("v")
        values = np.array(v.to_pylist(), object).astype(kind) if pa.types.is_decimal(v.type) else v.to_numpy().astype(kind)
        a[strip.column("y").to_numpy() - top, strip.column("x").to_numpy()] = values
        data = a.astype(kind.newbyteorder("<")).tobytes()
        data = zlib.compress(data, level) if compression == "deflate" else data
        return pa.table({"image_id": strip.column("image_id")[:1], "z": strip.column("z")[:1], "strip": strip.column("strip")[:1], "content": pa.array([data])})

    z = F.col("z") if r.dim > 2 else F.lit(0)
    lines = r.df.select("image_id", "x", "y", z.alias("z"), F.floor(F.col("y") / each).cast("int").alias("strip"), "v")
    strips = staged(lines.groupBy("image_id", "z", "strip").applyInArrow(pack, "image_id long, z int, strip int, content binary"))
    total = strips.groupBy("image_id").agg(F.sum(F.expr("length(content) + length(content) % 2")).alias("total"))
    per_page, tags = -(-height // each), 14
    spacing = [25.4 / s for s in g.spacing[:2]]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, out, offsets, counts, at, big = None, None, [], [], 0, False

        def close() -> pa.RecordBatch:
            nonlocal at
            for page in range(depth):
                mine = slice(page * per_page, (page + 1) * per_page)
                wide = 16 if big else 4
                entries = [
                    (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [kind.itemsize * 8]), (COMPRESSION, 3, [DEFLATE if compression == "deflate" else NONE]), (PHOTOMETRIC, 3, [1]), (STRIP_OFFSETS, wide, offsets[mine]),
                    (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [each]), (STRIP_COUNTS, wide, counts[mine]), (PLANAR, 3, [1]), (RESOLUTION_UNIT, 3, [2]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]]),
                    (X_RESOLUTION, 5, [round(spacing[0] * 100_000), 100_000]), (Y_RESOLUTION, 5, [round(spacing[1] * 100_000), 100_000]),
                ]
                data = _directory("<", big, entries, at, page + 1 == depth)
                out.write(data)
                at += len(data)
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([image]), pa.array([f"{folder}/image_{image}.tif"]), pa.array([at])], names=["image_id", "path", "bytes"])

        for b in batches:
            for row in b.to_pylist():
                if row["image_id"] != image:
                    if out is not None:
                        yield close()
                    image, offsets, counts = row["image_id"], [], []
                    big = row["total"] + 64 + depth * (400 + per_page * 16 + tags * 20) >= 1 << 32
                    system, inner = open_store(f"{folder}/image_{image}.tif")
                    system.create_dir(os.path.dirname(inner), recursive=True)
                    out, at = system.open_output_stream(inner), 16 if big else 8
                    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + row["total"]) if big else struct.pack("<2sHI", b"II", 42, 8 + row["total"]))
                data = row["content"]
                offsets.append(at)
                counts.append(len(data))
                data += b"\0" * (len(data) % 2)
                out.write(data)
                at += len(data)
        if out is not None:
            yield close()

    ordered = strips.join(total, "image_id").repartition("image_id").sortWithinPartitions("image_id", "z", "strip")
    return staged(ordered.select("image_id", "z", "strip", "content", "total").mapInArrow(write, "image_id long, path string, bytes long"))


# DICOM

#: Fixed values of the format: value representations with a long length, transfer syntaxes, tags.
LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"OV", b"SQ", b"UC", b"UR", b"UT", b"UN", b"SV", b"UV"}
EXPLICIT, IMPLICIT = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2"
SYNTAX, SERIES, INSTANCE, POSITION, ORIENTATION, DICOM_SAMPLES, FRAMES = (2, 0x10), (0x20, 0xE), (0x20, 0x13), (0x20, 0x32), (0x20, 0x37), (0x28, 2), (0x28, 8)
DICOM_ROWS, DICOM_COLUMNS, PIXEL_SPACING, BITS_ALLOCATED, SIGNED, INTERCEPT, SLOPE, PIXEL_DATA = (0x28, 0x10), (0x28, 0x11), (0x28, 0x30), (0x28, 0x100), (0x28, 0x103), (0x28, 0x1052), (0x28, 0x1053), (0x7FE0, 0x10)


def dicom_elements(read: ReadAt, path: str = "") -> tuple[dict[tuple[int, int], bytes], int, int]:
    """Elements before the pixels, and offset and length of the pixels.  Sequences are passed over."""
    if read(128, 4) != b"DICM":
        raise ValueError(f"{path}: not a DICOM file")
    at, found, explicit, depth = 132, {}, True, 0
    while True:
        head = read(at, 12)
        if len(head) < 8:
            raise ValueError(f"{path}: no pixels")
        tag = struct.unpack("<HH", head[:4])
        if tag[0] != 2 and SYNTAX in found:
            syntax = found[SYNTAX].rstrip(b"\0 ").decode()
            if syntax not in (EXPLICIT, IMPLICIT):
                raise ValueError(f"{path}: transfer syntax {syntax} is not read")
            explicit = syntax == EXPLICIT
        if tag[0] == 0xFFFE:  # items and their ends
            length, size = struct.unpack("<I", head[4:8])[0], 8
            depth += (tag[1] == 0xE000 and length == 0xFFFFFFFF) - (tag[1] in (0xE00D, 0xE0DD) and depth > 0)
            at += size + (0 if length == 0xFFFFFFFF else length if tag[1] == 0xE000 else 0)
            continue
        if not explicit:
            length, size = struct.unpack("<I", head[4:8])[0], 8
        elif head[4:6] in LONG:
            length, size = struct.unpack("<I", head[8:12])[0], 12
        else:
            length, size = struct.unpack("<H", head[6:8])[0], 8
        if tag == PIXEL_DATA and not depth:
            return found, at + size, length
        if length == 0xFFFFFFFF:
            depth += 1
            at += size
            continue
        if not depth and length <= 1 << 16 and tag[0] in (2, 0x20, 0x28):
            found[tag] = read(at + size, length)
        at += size + length


def _dicom_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            store, inner = open_store(path)
            with store.open_input_file(inner) as f:
                found, offset, length = dicom_elements(lambda at, n: f.read_at(n, at), path)  # noqa: B023
            text = lambda tag, default="": found[tag].decode("latin-1").rstrip("\0 ") if tag in found else default  # noqa: B023, E731
            numbers = lambda tag, default: [float(x) for x in text(tag).split("\\")] if text(tag) else default  # noqa: B023, E731
            whole = lambda tag, default: struct.unpack("<H", found[tag][:2])[0] if tag in found else default  # noqa: B023, E731
            if whole(DICOM_SAMPLES, 1) != 1 or float(text(FRAMES) or 1) != 1 or whole(BITS_ALLOCATED, 16) not in (8, 16, 32):
                raise ValueError(f"{path}: only single frames of one sample of 8, 16 or 32 bits are read")
            out.append({
                "path": path, "series": text(SERIES), "instance": int(float(text(INSTANCE) or 0)), "position": numbers(POSITION, [0.0, 0.0, 0.0]), "orientation": numbers(ORIENTATION, [1.0, 0, 0, 0, 1.0, 0]), "spacing": numbers(PIXEL_SPACING, [1.0, 1.0]),
                "height": whole(DICOM_ROWS, 0), "width": whole(DICOM_COLUMNS, 0), "kind": f"<{'i' if whole(SIGNED, 0) else 'u'}{whole(BITS_ALLOCATED, 16) // 8}", "slope": numbers(SLOPE, [1.0])[0], "intercept": numbers(INTERCEPT, [0.0])[0], "offset": offset, "length": length,
            })
        yield pa.RecordBatch.from_pylist(out, schema=_HEAD)


_HEAD = pa.schema([("path", pa.string()), ("series", pa.string()), ("instance", pa.int64()), ("position", pa.list_(pa.float64())), ("orientation", pa.list_(pa.float64())), ("spacing", pa.list_(pa.float64())), ("height", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("slope", pa.float64()), ("intercept", pa.float64()), ("offset", pa.int64()), ("length", pa.int64())])


def read_dicom_series(spark: SparkSession, folder: str, series: str | None = None, region: Region | None = None, split: int = SPLIT) -> Raster:
    """The slices of one series (default: the first by name) as a volume, in order along the normal of
    their planes, ties by instance number.  Headers are read by tasks, one row for each file
    reaches the driver.  A rescale slope or intercept makes real values."""
    paths = listed(folder, (".dcm", ".ima"))
    if not paths:
        raise ValueError(f"{folder}: no DICOM files")
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism))
    kinds = "path string, series string, instance long, position array<double>, orientation array<double>, spacing array<double>, height int, width int, kind string, slope double, intercept double, offset long, length long"
    heads = files.mapInArrow(_dicom_heads, kinds).collect()
    chosen = series if series is not None else min(h.series for h in heads)
    heads = [h for h in heads if h.series == chosen]
    if not heads:
        raise ValueError(f"{folder}: no series {series}")
    across, down = (np.array(heads[0].orientation[k : k + 3]) for k in (0, 3))
    normal = np.cross(across, down)
    heads.sort(key=lambda h: (float(normal @ h.position), h.instance, h.path))
    step = float(normal @ (np.array(heads[-1].position) - heads[0].position)) / max(len(heads) - 1, 1)
    spacing = (heads[0].spacing[1], heads[0].spacing[0], step if step > 0 else 1.0)
    pages = [Page(h.path, 0, z, h.width, h.height, h.kind, h.height, h.width, [h.offset], [h.length], slope=h.slope, intercept=h.intercept) for z, h in enumerate(heads)]
    g = Geometry((heads[0].width, heads[0].height, len(heads)), spacing, tuple(heads[0].position), tuple(map(tuple, np.stack([across, down, normal], 1).tolist())))
    return _raster(spark, pages, g, region, split)
