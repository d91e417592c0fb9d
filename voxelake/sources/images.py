"""Image files as sources and sinks: MetaImage, NRRD, NIfTI-1 and NIfTI-2, GIPL, legacy VTK and PNG.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do; one
file is decoded in one task, many files in parallel.  The writer returns encoded files as
rows (image_id, content) that any Spark sink can store.  Arrays are (z, y, x); axes with a
negative spacing are not accepted.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..raster import AXES, PIXELS, Geometry, Raster

# Fixed values of the file formats: type names and codes.
META = {"MET_UCHAR": "uint8", "MET_CHAR": "int8", "MET_USHORT": "uint16", "MET_SHORT": "int16", "MET_UINT": "uint32", "MET_INT": "int32", "MET_ULONG_LONG": "uint64", "MET_LONG_LONG": "int64", "MET_FLOAT": "float32", "MET_DOUBLE": "float64"}
NRRD = {"uint8": "uint8", "int8": "int8", "uint16": "uint16", "int16": "int16", "uint32": "uint32", "int32": "int32", "uint64": "uint64", "int64": "int64", "float": "float32", "double": "float64"}
NIFTI = {2: "uint8", 4: "int16", 8: "int32", 16: "float32", 64: "float64", 256: "int8", 512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64"}
#: Of NIfTI headers by their length: fields and place of the sizes, place of the type, fields and place
#: of the spacing, of the data's start (the scale follows it), of the code and of the rows of the matrix.
NIFTI_PLACES = {348: (("8h", 40), 70, ("8f", 76), ("f", 108), ("h", 254), ("4f", 280)), 540: (("8q", 16), 12, ("8d", 104), ("q", 168), ("i", 348), ("4d", 400))}
VTK = {"unsigned_char": "uint8", "char": "int8", "unsigned_short": "uint16", "short": "int16", "unsigned_int": "uint32", "int": "int32", "float": "float32", "double": "float64"}
GIPL = {7: "int8", 8: "uint8", 15: "int16", 16: "uint16", 31: "uint32", 32: "int32", 64: "float32", 65: "float64"}
GIPL_MAGIC = 719555000

Image = tuple[np.ndarray, Geometry, str]


def _shape(data: bytes, pixel: str, g: Geometry, order: str = "<") -> np.ndarray:
    a = np.frombuffer(data, np.dtype(pixel).newbyteorder(order), count=g.count)
    return a.astype(np.dtype(pixel)).reshape(g.size[::-1])


def _numbers(x) -> str:
    return " ".join(repr(float(v)) if not isinstance(v, (int, np.integer)) else str(v) for v in x)


def decode_meta(data: bytes) -> Image:
    fields, at = {}, 0
    while "ElementDataFile" not in fields:
        end = data.index(b"\n", at)
        k, _, v = data[at:end].decode("latin-1").partition("=")
        fields[k.strip()], at = v.strip(), end + 1
    if fields["ElementDataFile"] != "LOCAL":
        raise ValueError("only images with their data in the same file are read")
    pixel = META[fields["ElementType"]]
    d = int(fields["NDims"])
    of = lambda *names, default: next((list(map(float, fields[n].split())) for n in names if n in fields), default)
    turn = of("TransformMatrix", "Rotation", default=np.eye(d).ravel().tolist())
    g = Geometry(tuple(map(int, fields["DimSize"].split())), tuple(of("ElementSpacing", "ElementSize", default=[1.0] * d)), tuple(of("Offset", "Position", "Origin", default=[0.0] * d)), tuple(map(tuple, np.array(turn).reshape(d, d).T.tolist())))
    body = data[at:]
    if fields.get("CompressedData", "False").lower() == "true":
        body = zlib.decompress(body)
    big = fields.get("BinaryDataByteOrderMSB", fields.get("ElementByteOrderMSB", "False")).lower() == "true"
    return _shape(body, pixel, g, ">" if big else "<"), g, pixel


def encode_meta(a: np.ndarray, g: Geometry, pixel: str, compress: bool = True) -> bytes:
    body = np.ascontiguousarray(a, np.dtype(pixel).newbyteorder("<")).tobytes()
    body = zlib.compress(body) if compress else body
    kind = next(k for k, v in META.items() if v == pixel)
    size = f"CompressedDataSize = {len(body)}\n" if compress else ""
    head = f"ObjectType = Image\nNDims = {len(g.size)}\nBinaryData = True\nBinaryDataByteOrderMSB = False\nCompressedData = {compress}\n{size}TransformMatrix = {_numbers(np.array(g.direction).T.ravel())}\nOffset = {_numbers(g.origin)}\nElementSpacing = {_numbers(g.spacing)}\nDimSize = {_numbers(g.size)}\nElementType = {kind}\nElementDataFile = LOCAL\n"
    return head.encode() + body


def decode_nrrd(data: bytes) -> Image:
    end = data.index(b"\n\n")
    fields = dict(line.split(": ", 1) for line in data[:end].decode("latin-1").splitlines() if ": " in line and not line.startswith("#"))
    size = tuple(map(int, fields["sizes"].split()))
    d = len(size)
    vector = lambda s: [float(x) for x in s.strip("() ").split(",")]
    if "space directions" in fields:
        axes = np.array([vector(s) for s in fields["space directions"].split()])
        spacing = np.linalg.norm(axes, axis=1)
        direction = (axes / spacing[:, None]).T
    else:
        spacing, direction = np.array([float(x) for x in fields.get("spacings", " ".join(["1"] * d)).split()]), np.eye(d)
    g = Geometry(size, tuple(spacing.tolist()), tuple(vector(fields["space origin"])) if "space origin" in fields else (), tuple(map(tuple, direction.tolist())))
    body = data[end + 2 :]
    if fields.get("encoding", "raw") in ("gzip", "gz"):
        body = gzip.decompress(body)
    pixel = NRRD[fields["type"]]
    return _shape(body, pixel, g, ">" if fields.get("endian") == "big" else "<"), g, pixel


def encode_nrrd(a: np.ndarray, g: Geometry, pixel: str) -> bytes:
    kind = next(k for k, v in NRRD.items() if v == pixel)
    axes = (np.array(g.direction) * np.array(g.spacing)[None, :]).T
    write = lambda v: "(" + ",".join(repr(float(x)) for x in v) + ")"
    head = f"NRRD0004\ntype: {kind}\ndimension: {len(g.size)}\nspace dimension: {len(g.size)}\nsizes: {_numbers(g.size)}\nspace directions: {' '.join(map(write, axes))}\nspace origin: {write(g.origin)}\nendian: little\nencoding: gzip\n\n"
    return head.encode() + gzip.compress(np.ascontiguousarray(a, np.dtype(pixel).newbyteorder("<")).tobytes(), mtime=0)


def decode_nifti(data: bytes) -> Image:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    little, big = (struct.unpack(o + "i", data[:4])[0] for o in "<>")
    order, length = "<" if little in (348, 540) else ">", 540 if 540 in (little, big) else 348
    # NIfTI-2 has wider fields at other places
    (sizes, at), kind_at, (steps, step_at), (starts, start_at), (codes, code_at), (row, row_at) = NIFTI_PLACES[length]
    read = lambda fields, at: struct.unpack_from(order + fields, data, at)
    dim = read(sizes, at)
    d = dim[0]
    kind, = read("h", kind_at)
    step = read(steps, step_at)
    start, = read(starts, start_at)
    origin = (0.0,) * d
    direction: tuple = ()
    if read(codes, code_at)[0] > 0 and d == 3:
        m = np.array([read(row, row_at + struct.calcsize("<" + row) * k) for k in range(3)])
        m[:2] *= -1  # the file's axes point right, anterior; the library's left, posterior
        direction = tuple(map(tuple, (m[:, :3] / np.linalg.norm(m[:, :3], axis=0)[None, :]).tolist()))
        origin = tuple(m[:, 3].tolist())
    g = Geometry(tuple(dim[1 : d + 1]), tuple(float(abs(s)) or 1.0 for s in step[1 : d + 1]), origin, direction)
    return _shape(data[int(start) :], NIFTI[kind], g, order), g, NIFTI[kind]


def encode_nifti(a: np.ndarray, g: Geometry, pixel: str) -> bytes:
    """NIfTI-1, or NIfTI-2 if a side is too long for the 16 bits that NIfTI-1 has for it."""
    d = len(g.size)
    length = 348 if max(g.size) < 1 << 15 else 540
    (sizes, at), kind_at, (steps, step_at), (starts, start_at), (codes, code_at), (row, row_at) = NIFTI_PLACES[length]
    h = bytearray(length + 4)
    put = lambda fields, at, *values: struct.pack_into("<" + fields, h, at, *values)
    kind = next(k for k, v in NIFTI.items() if v == pixel)
    put("i", 0, length)
    put(sizes, at, d, *g.size, *[1] * (7 - d))
    put("hh", kind_at, kind, np.dtype(pixel).itemsize * 8)
    put(steps, step_at, 1.0, *g.spacing, *[0.0] * (7 - d))
    put(starts, start_at, length + 4)
    put(steps[-1], start_at + struct.calcsize("<" + starts), 1.0)
    if d == 3:
        m = np.column_stack([np.array(g.direction) * np.array(g.spacing)[None, :], g.origin])
        m[:2] *= -1
        put(codes, code_at, 1)
        for k in range(3):
            put(row, row_at + struct.calcsize("<" + row) * k, *m[k])
    magic = b"n+1\0" if length == 348 else b"n+2\0\r\n\x1a\n"
    put(f"{len(magic)}s", 344 if length == 348 else 4, magic)
    return bytes(h) + np.ascontiguousarray(a, np.dtype(pixel).newbyteorder("<")).tobytes()


def decode_vtk(data: bytes) -> Image:
    f = io.BytesIO(data)
    head = [f.readline().decode("latin-1").strip() for _ in range(4)]
    fields: dict[str, list[str]] = {}
    while "LOOKUP_TABLE" not in fields:
        line = f.readline().decode("latin-1").split()
        if line:
            fields[line[0].upper()] = line[1:]
    size = tuple(map(int, fields["DIMENSIONS"]))
    flat = len(size) == 3 and size[2] == 1
    cut = 2 if flat else 3
    g = Geometry(size[:cut], tuple(map(float, fields.get("SPACING", fields.get("ASPECT_RATIO", ["1"] * 3))[:cut])), tuple(map(float, fields.get("ORIGIN", ["0"] * 3)[:cut])))
    pixel = VTK[fields["SCALARS"][1]]
    if head[2].upper() == "ASCII":
        return np.array(f.read().split()[: g.count], dtype=float).astype(pixel).reshape(g.size[::-1]), g, pixel
    return _shape(f.read(), pixel, g, ">"), g, pixel


def encode_vtk(a: np.ndarray, g: Geometry, pixel: str) -> bytes:
    kind = next(k for k, v in VTK.items() if v == pixel)
    pad = lambda x, fill: [*x, *[fill] * (3 - len(x))]
    head = f"# vtk DataFile Version 3.0\nimage\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {_numbers(pad(g.size, 1))}\nSPACING {_numbers(pad(g.spacing, 1.0))}\nORIGIN {_numbers(pad(g.origin, 0.0))}\nPOINT_DATA {g.count}\nSCALARS scalars {kind} 1\nLOOKUP_TABLE default\n"
    return head.encode() + np.ascontiguousarray(a, np.dtype(pixel).newbyteorder(">")).tobytes()


def decode_gipl(data: bytes) -> Image:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    size = struct.unpack(">4H", data[:8])
    kind, = struct.unpack(">H", data[8:10])
    step = struct.unpack(">4f", data[10:26])
    origin = struct.unpack(">4d", data[204:236])
    if struct.unpack(">I", data[252:256])[0] != GIPL_MAGIC:
        raise ValueError("not a GIPL image")
    d = 3 if size[2] > 1 else 2
    g = Geometry(size[:d], tuple(float(s) for s in step[:d]), origin[:d])
    return _shape(data[256:], GIPL[kind], g, ">"), g, GIPL[kind]


def encode_gipl(a: np.ndarray, g: Geometry, pixel: str) -> bytes:
    h = bytearray(256)
    d = len(g.size)
    struct.pack_into(">4H", h, 0, *g.size, *[1] * (4 - d))
    struct.pack_into(">H", h, 8, next(k for k, v in GIPL.items() if v == pixel))
    struct.pack_into(">4f", h, 10, *g.spacing, *[1.0] * (4 - d))
    struct.pack_into(">4d", h, 204, *g.origin, *[0.0] * (4 - d))
    struct.pack_into(">I", h, 252, GIPL_MAGIC)
    return bytes(h) + np.ascontiguousarray(a, np.dtype(pixel).newbyteorder(">")).tobytes()


def decode_png(data: bytes) -> Image:
    """Greyscale, 8 or 16 bits, not interlaced."""
    at, body, head = 8, b"", None
    while at < len(data):
        n, = struct.unpack(">I", data[at : at + 4])
        name = data[at + 4 : at + 8]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif name == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, colour, _, _, laced = head
    if colour or laced or depth not in (8, 16):
        raise ValueError("only greyscale PNG of 8 or 16 bits is read")
    k = depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * k)
    out = np.zeros((height, width * k), np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(width * k, np.int64)
        if kind == 2:
            line = line + up
        elif kind:
            for i in range(width * k):
                left, corner = (line[i - k] if i >= k else 0), (up[i - k] if i >= k else 0)
                if kind == 1:
                    line[i] += left
                elif kind == 3:
                    line[i] += (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    line[i] += min((left, up[i], corner), key=lambda c: abs(p - c))
                line[i] &= 255
        out[y] = line & 255
    pixel = "uint8" if k == 1 else "uint16"
    return (out if k == 1 else out.view(">u2").astype(np.uint16)).reshape(height, width), Geometry((width, height)), pixel


def encode_png(a: np.ndarray, g: Geometry, pixel: str) -> bytes:
    if pixel not in ("uint8", "uint16") or len(g.size) != 2:
        raise ValueError("PNG holds 2-D uint8 or uint16 images")
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.ascontiguousarray(a, np.dtype(pixel).newbyteorder(">")).view(np.uint8).reshape(g.size[1], -1)
    raw = np.column_stack([np.zeros(len(lines), np.uint8), lines]).tobytes()
    head = struct.pack(">IIBBBBB", g.size[0], g.size[1], 8 if pixel == "uint8" else 16, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


FORMATS = {
    "mha": (decode_meta, encode_meta), "nrrd": (decode_nrrd, encode_nrrd), "nii": (decode_nifti, encode_nifti),
    "vtk": (decode_vtk, encode_vtk), "gipl": (decode_gipl, encode_gipl), "png": (decode_png, encode_png),
}


def format_of(path: str) -> str:
    name = path.lower().removesuffix(".gz")
    return next(f for f in FORMATS if name.endswith(f".{f}"))


def encode(r: Raster, format: str) -> DataFrame:
    """One encoded file for each image: image_id, content."""
    g, pixel, axes = r.geometry, r.pixel.name, list(r.axes)
    encoder = FORMATS[format][1]

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(g.size[::-1], np.dtype(pixel))
        a[tuple(rows[x].to_numpy() for x in reversed(axes))] = rows["v"].to_numpy().astype(np.dtype(pixel))
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "content": [encoder(a, g, pixel)]})

    return r.df.groupBy("image_id").applyInPandas(write, "image_id long, content binary")


def decode(files: DataFrame, format: str) -> Raster:
    """A raster from rows image_id, content; all images must have one grid and pixel type."""
    decoder = FORMATS[format][0]

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [decoder(bytes(c))[1:] for c in b["content"]]
            yield pd.DataFrame({"size": [list(g.size) for g, _ in found], "spacing": [list(g.spacing) for g, _ in found], "origin": [list(g.origin) for g, _ in found], "direction": [[list(row) for row in g.direction] for g, _ in found], "pixel": [p for _, p in found]})

    heads = files.select("content").mapInPandas(head, "size array<int>, spacing array<double>, origin array<double>, direction array<array<double>>, pixel string").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError("the files do not share one grid and pixel type")
    h = heads[0]
    g, p = Geometry(tuple(h.size), tuple(h.spacing), tuple(h.origin), tuple(map(tuple, h.direction))), PIXELS[h.pixel]
    axes = AXES[: len(g.size)]

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image_id, c in zip(b["image_id"], b["content"]):
                a = decoder(bytes(c))[0]
                for k, part in enumerate(a if a.ndim > 2 else [a]):  # a plane at a time
                    where = np.indices(part.shape)
                    out = {"image_id": np.full(part.size, image_id)}
                    for j, x in enumerate(axes[: part.ndim]):
                        out[x] = where[part.ndim - 1 - j].ravel().astype(np.int32)
                    if a.ndim > 2:
                        out[axes[-1]] = np.full(part.size, k, np.int32)
                    out["v"] = [Decimal(int(x)) for x in part.ravel()] if p.name == "uint64" else part.ravel().astype("int64" if p.integer else float)
                    yield pd.DataFrame(out)

    rows = files.select("image_id", "content").mapInPandas(body, "image_id long, " + ", ".join(f"{a} int" for a in axes) + f", v {p.spark if p.name == 'uint64' else 'bigint' if p.integer else 'double'}")
    return Raster(rows.select("image_id", *axes, F.col("v").cast(p.spark).alias("v")), g, p)


def read_images(spark: SparkSession, path: str, format: str | None = None) -> Raster:
    """Images of a path or glob; image_id numbers the files by path."""
    files = spark.read.format("binaryFile").load(path)
    paths = sorted(r.path for r in files.select("path").collect())
    number = spark.createDataFrame(list(enumerate(paths)), "image_id long, path string")
    return decode(files.join(number, "path").select("image_id", "content"), format or format_of(paths[0]))


def read_series(spark: SparkSession, path: str, format: str | None = None) -> Raster:
    """Files of one grid stacked along a new last axis, in path order."""
    r = read_images(spark, path, format)
    axis = AXES[r.dim]
    g = r.geometry
    n = r.df.agg(F.max("image_id")).first()[0] + 1
    rows = r.df.select(F.lit(0).cast("long").alias("image_id"), *r.axes, F.col("image_id").cast("int").alias(axis), "v")
    return Raster(rows, Geometry((*g.size, n), (*g.spacing, 1.0), (*g.origin, 0.0)), r.pixel)
