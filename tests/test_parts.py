"""TIFF and DICOM by bytes that the formats fix, and regions by the bytes they read."""

import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.raster import Geometry, from_table
from voxelake.sources import parts

rng = np.random.default_rng(8)


def array(r):
    out = np.full(r.geometry.size, np.nan)
    for row in r.df.collect():
        out[tuple(row[a] for a in r.axes)] = row.v
    return out


def reader(data):
    return lambda at, n: data[at : at + n]


def by_hand(order, tags, body):
    """A file with one directory behind the header and the strips behind that."""
    n = len(tags)
    start = 8 + 2 + n * 12 + 4
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, n)
    for tag, kind, count, value in tags:
        value = struct.pack(f"{order}H", value) + b"\0\0" if kind == 3 else struct.pack(f"{order}I", value if value >= 0 else start - value - 1)
        head += struct.pack(f"{order}HHI", tag, kind, count) + value
    return head + struct.pack(f"{order}I", 0) + body


def one_strip(order, width, height, bits, form, body, compression=1, predictor=1, rows=None):
    return by_hand(order, [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 1, bits), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, 1, -1), (277, 3, 1, 1), (278, 3, 1, rows or height), (279, 4, 1, len(body)), (317, 3, 1, predictor), (339, 3, 1, form)], body)


def voxels(data):
    (page,) = parts.tiff_pages(reader(data))
    out = np.zeros((page.height, page.width), page.kind.replace(">", "<"))
    for p in parts.plan([page], [[0, page.width - 1], [0, page.height - 1]]):
        for piece in p.pieces:
            x, y, v = parts.voxels_of(piece, data[piece.offset : piece.offset + piece.length], p.region)
            out[y, x] = v[:, 0]
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", ["u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"])
def test_bytes_of_every_type(order, kind):
    a = (rng.integers(0, 200, (3, 5)) - (100 if kind[0] != "u" else 0)).astype(kind)
    data = one_strip(order, 5, 3, 8 * int(kind[1]), {"u": 1, "i": 2, "f": 3}[kind[0]], a.astype(f"{order}{kind}").tobytes())
    assert (voxels(data) == a).all()


def test_compressions():
    a = np.array([[7, 7, 7, 7, 8, 8], [0, 0, 0, 1, 2, 3]], np.uint8)
    assert (voxels(one_strip("<", 6, 2, 8, 1, zlib.compress(a.tobytes()), 8)) == a).all()
    assert (voxels(one_strip("<", 6, 2, 8, 1, bytes([253, 7, 255, 8, 254, 0, 2, 1, 2, 3]), 32773)) == a).all()
    # the published example of packed bits
    assert parts.unpack_bits(bytes.fromhex("FEAA028000 2AFDAA038000 2A22F7AA".replace(" ", ""))) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 7, 8, 8, 0, 263, 1, 2, 3, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert (voxels(one_strip("<", 6, 2, 8, 1, int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"), 5)) == a).all()
    step = np.diff(a.astype(np.int16), axis=1, prepend=0).astype(np.uint16)
    assert (voxels(one_strip(">", 6, 2, 16, 1, step.astype(">u2").tobytes(), predictor=2)) == a).all()


def lzw(data):
    """Codes as the format packs them, with tables long enough to widen the codes."""
    table, out, width, w = {bytes([k]): k for k in range(256)}, f"{256:09b}", 9, b""
    n = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if w + c in table:
            w += c
            continue
        out += f"{table[w]:0{width}b}"
        table[w + c], n = n, n + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            out += f"{256:0{width}b}"
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = c
    out += f"{table[w]:0{width}b}"
    n += 1
    out += f"{257:0{9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12}b}"
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


def test_lzw_with_wide_codes():
    for size in (1, 300, 3000, 30_000):
        data = rng.integers(0, 7, size).astype(np.uint8).tobytes()
        assert parts.unpack_lzw(lzw(data)) == data


def test_what_is_not_read():
    with pytest.raises(ValueError):
        parts.tiff_pages(reader(b"GIF89a" + b"\0" * 20))
    with pytest.raises(ValueError):
        parts.tiff_pages(reader(one_strip("<", 4, 4, 8, 1, b"\0" * 16, compression=7)))
    with pytest.raises(ValueError):
        parts.tiff_pages(reader(one_strip("<", 4, 4, 4, 1, b"\0" * 16)))


def image(spark, *arrays, pixel="int32", spacing=()):
    axes = "xyz"[: arrays[0].ndim]
    rows = [(i, *map(int, p), float(a[p])) for i, a in enumerate(arrays) for p in np.ndindex(*a.shape)]
    df = spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{c} int" for c in axes) + ", v double").repartition(4)
    return from_table(df, Geometry(arrays[0].shape, spacing), pixel)


@pytest.mark.parametrize("pixel,compression", [("uint8", "none"), ("int16", "deflate"), ("float32", "deflate"), ("float64", "none"), ("uint64", "none"), ("int64", "deflate")])
def test_written_files_come_back(spark, tmp_path, pixel, compression):
    a, b = (rng.integers(0, 200, (11, 9, 3)) for _ in range(2))
    r = image(spark, a, b, pixel=pixel, spacing=(0.5, 2.0, 1.0))
    done = parts.write_tiff(r, str(tmp_path), compression, rows=4).collect()
    assert sorted(x.bytes for x in done) == sorted(f.stat().st_size for f in tmp_path.glob("*.tif"))
    back = parts.read_tiff(spark, str(tmp_path), split=64)
    assert back.pixel.name == pixel and back.geometry.size == (11, 9, 3) and np.allclose(back.geometry.spacing, (0.5, 2.0, 1.0))
    for i, want in enumerate((a, b)):
        got = back.with_rows(back.df.where(F.col("image_id") == i))
        assert (array(got) == want).all()
    first = parts.tiff_pages(reader((tmp_path / "image_0.tif").read_bytes()))
    assert len(first) == 3 and first[0].rows == 4 and len(first[0].offsets) == 3 and first[0].offsets[0] == 8


def test_a_region_reads_only_its_bytes(spark, tmp_path):
    a = rng.integers(0, 30_000, (64, 200))
    parts.write_tiff(image(spark, a, pixel="uint16"), str(tmp_path), rows=10).collect()
    parts.write_tiff(image(spark, a, pixel="uint16"), str(tmp_path / "packed"), "deflate", rows=10).collect()
    box = [[5, 20], [33, 46]]
    pages = parts.tiff_pages(reader((tmp_path / "image_0.tif").read_bytes()))
    plan = parts.plan(pages, box)
    assert sum(p.length for x in plan for p in x.pieces) == 14 * 64 * 2
    packed = parts.tiff_pages(reader((tmp_path / "packed" / "image_0.tif").read_bytes()))
    assert sum(p.length for x in parts.plan(packed, box) for p in x.pieces) == sum(packed[0].counts[3:5])
    assert len(parts.plan(pages, [[0, 63], [0, 199]], split=128 * 5)) == 40
    for folder in (tmp_path, tmp_path / "packed"):
        r = parts.read_tiff(spark, str(folder / "image_0.tif"), box)
        assert r.geometry.size == (16, 14) and np.allclose(r.geometry.origin, (5, 33)) and (array(r) == a[5:21, 33:47]).all()
    many = parts.read_tiff(spark, str(tmp_path / "image_0.tif"), split=128 * 5)
    assert many.df.rdd.getNumPartitions() == 40 and many.df.count() == a.size
    with pytest.raises(ValueError):
        parts.read_tiff(spark, str(tmp_path / "image_0.tif"), [[64, 70], [0, 3]])


def test_filters_prune(spark, tmp_path):
    a = rng.integers(0, 99, (16, 40))
    parts.write_tiff(image(spark, a, pixel="uint8"), str(tmp_path), rows=5).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        r = parts.read_tiff(spark, str(tmp_path), split=16 * 5)
        some = r.df.where("y >= 10 and y < 20 and x = 3")
        assert some.rdd.getNumPartitions() == 2 and sorted((x.y, x.v) for x in some.collect()) == [(y, a[3, y]) for y in range(10, 20)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tiles_and_samples():
    """Tiles of 16 by 16 over a 20 by 18 image of three samples, of which two tiles are cut."""
    a = rng.integers(0, 255, (18, 20, 3)).astype(np.uint8)
    tiles = []
    for j, i in itertools.product((0, 16), repeat=2):
        t = np.zeros((16, 16, 3), np.uint8)
        part = a[j : j + 16, i : i + 16]
        t[: part.shape[0], : part.shape[1]] = part
        tiles.append(t.tobytes())
    page = parts.Page("", 0, None, 20, 18, "|u1", 16, 16, [768 * k for k in range(4)], [768] * 4, samples=3)
    data, out = b"".join(tiles), np.zeros_like(a)
    box = [[4, 18], [15, 16]]
    pieces = [x for p in parts.plan([page], box) for x in p.pieces]
    assert sum(p.length for p in pieces) == 4 * 48
    for p in pieces:
        x, y, v = parts.voxels_of(p, data[p.offset : p.offset + p.length], box)
        out[y, x] = v
    assert (out[15:17, 4:19] == a[15:17, 4:19]).all() and not out[:15].any()


def element(group, number, vr, value, explicit=True):
    value += b"\0" * (len(value) % 2)
    tag = struct.pack("<HH", group, number)
    if not explicit:
        return tag + struct.pack("<I", len(value)) + value
    return tag + vr + (b"\0\0" + struct.pack("<I", len(value)) if vr in (b"OW", b"SQ") else struct.pack("<H", len(value))) + value


def dicom(a, position, instance, series="1.2", explicit=True, slope=None):
    e = lambda *x: element(*x, explicit)
    syntax = element(2, 0x10, b"UI", (parts.EXPLICIT if explicit else parts.IMPLICIT).encode())
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + e(0x28, 0x10, b"US", struct.pack("<H", 99)) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    sequence = struct.pack("<HH", 8, 0x1140) + (b"SQ\0\0" if explicit else b"") + struct.pack("<I", 0xFFFFFFFF) + item
    body = sequence + e(0x20, 0xE, b"UI", series.encode()) + e(0x20, 0x13, b"IS", str(instance).encode()) + e(0x20, 0x32, b"DS", "\\".join(map(str, position)).encode()) + e(0x20, 0x37, b"DS", b"1\\0\\0\\0\\1\\0")
    body += e(0x28, 2, b"US", struct.pack("<H", 1)) + e(0x28, 0x10, b"US", struct.pack("<H", a.shape[0])) + e(0x28, 0x11, b"US", struct.pack("<H", a.shape[1])) + e(0x28, 0x30, b"DS", b"0.5\\0.25")
    body += e(0x28, 0x100, b"US", struct.pack("<H", 16)) + e(0x28, 0x103, b"US", struct.pack("<H", 1))
    if slope:
        body += e(0x28, 0x1052, b"DS", b"-10") + e(0x28, 0x1053, b"DS", str(slope).encode())
    return b"\0" * 128 + b"DICM" + syntax + body + e(0x7FE0, 0x10, b"OW", a.astype("<i2").tobytes())


@pytest.mark.parametrize("explicit", [True, False])
def test_dicom_slices_in_order(spark, tmp_path, explicit):
    a = rng.integers(-500, 500, (4, 5, 6))
    for k, z in enumerate((2, 0, 3, 1)):
        (tmp_path / f"slice{k}.dcm").write_bytes(dicom(a[z], (1.0, 2.0, 3.0 + 1.5 * z), 10 - z, explicit=explicit))
    (tmp_path / "other.dcm").write_bytes(dicom(a[0], (0, 0, 0), 1, "9.9"))
    r = parts.read_dicom_series(spark, str(tmp_path))
    assert r.geometry.size == (6, 5, 4) and r.geometry.spacing == (0.25, 0.5, 1.5) and r.geometry.origin == (1.0, 2.0, 3.0) and r.pixel.name == "int16"
    assert (array(r) == a.transpose(2, 1, 0)).all()
    part = parts.read_dicom_series(spark, str(tmp_path), region=[[1, 4], [2, 3], [1, 2]])
    assert (array(part) == a.transpose(2, 1, 0)[1:5, 2:4, 1:3]).all() and part.geometry.origin == (1.25, 3.0, 4.5)
    assert parts.read_dicom_series(spark, str(tmp_path), "9.9").geometry.size == (6, 5, 1)


def test_dicom_rescales_and_refuses(spark, tmp_path):
    a = rng.integers(0, 50, (3, 4))
    (tmp_path / "a.dcm").write_bytes(dicom(a, (0, 0, 0), 1, slope=0.5))
    r = parts.read_dicom_series(spark, str(tmp_path))
    assert r.pixel.name == "float32" and np.allclose(array(r)[:, :, 0].T, a * 0.5 - 10)
    with pytest.raises(ValueError):
        parts.dicom_elements(reader(b"\0" * 200))
    jpeg = dicom(a, (0, 0, 0), 1).replace(parts.EXPLICIT.encode() + b"\0", b"1.2.840.10008.1.2.4\0"[:20])
    with pytest.raises(ValueError):
        parts.dicom_elements(reader(jpeg))
    with pytest.raises(ValueError):
        parts.read_dicom_series(spark, str(tmp_path), "none")
