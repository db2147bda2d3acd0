"""Outputs: spectra tables, masks, sessions and models."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from math import isfinite, isnan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Header
from ..shared import stored, whole_groups
from .envi import located


def wide_spectra(spectra: DataFrame, wavelengths: list[float], keys: list[str], column: str = "mean", digits: int = 2, prefix: str = "") -> DataFrame:
    """An array of band values as one column a wavelength, named by it."""
    return spectra.select(*keys, *[F.col(column)[b].alias(f"{prefix}{w:.{digits}f}") for b, w in enumerate(wavelengths)])


def general(v: Column, digits: int) -> Column:
    """A number in at most ``digits`` significant digits without trailing zeros, with an exponent from 10^digits on and below 0.0001.

    Its exact binary value is rounded, half to even; Spark's ``format_string`` rounds the shortest decimal that stands for it, half up.
    """

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        form = f"%.{digits}G"
        return pa.array([None if x is None else form % x if isfinite(x) else "NaN" if isnan(x) else "Infinity" if x > 0 else "-Infinity" for x in values.to_pylist()], pa.string())

    return text(v.cast("double"))


def formatted(rows: DataFrame, digits: int, keys: list[str]) -> DataFrame:
    """A table of numbers as text for a CSV file: every column but ``keys`` in ``digits`` significant digits (5 in batch tables, 6 in sample tables)."""
    quoted = lambda c: F.col(f"`{c}`")
    return rows.select(*[quoted(c) if c in keys else general(quoted(c), digits).alias(c) for c in rows.columns])


def sample_table(spectra: DataFrame, wavelengths: list[float]) -> DataFrame:
    """Spectra of instances (cube_id, roi_id, mean) as the spectral matrix: id ``file_k``, class (the file's name up to its first _), file, wavelengths."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("cube_id").orderBy("roi_id"))
    rows = spectra.select(F.concat_ws("_", "cube_id", k.cast("string")).alias("ID_Muestra"), F.split("cube_id", "_")[0].alias("Clase"), F.col("cube_id").alias("Nombre_Archivo"), "mean")
    return wide_spectra(rows, wavelengths, ["ID_Muestra", "Clase", "Nombre_Archivo"])


def batch_table(spectra: DataFrame, wavelengths: list[float]) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("cube_id").orderBy("roi_id"))
    rows = spectra.select(F.col("cube_id").alias("Image_Name"), F.format_string("Instancia_%03d", number).alias("Instance_ID"), "mean")
    return wide_spectra(rows, wavelengths, ["Image_Name", "Instance_ID"])


def with_problems(table: DataFrame, problems: DataFrame) -> DataFrame:
    """A table of text (see ``formatted``) with the rows of ``problems`` (file, problem) in it, as the batch's CSV file has them."""
    name, second, *others = table.columns
    text = F.when(F.col("problem") == "no objects found", "NO_OBJECTS_FOUND").otherwise(F.concat(F.lit("ERROR: "), F.col("problem")))
    rows = problems.select(F.col("file").alias(name), text.alias(second), *[F.lit(None).cast("string").alias(c) for c in others])
    return table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns]).union(rows)


def pixel_table(pixels: DataFrame, wavelengths: list[float]) -> DataFrame:
    """PixelX, PixelY and a column a band, NaN as 0, by line and sample."""
    clean = F.transform(F.col("spectrum").cast("array<double>"), lambda v: F.when(F.isnan(v), F.lit(0.0)).otherwise(v))
    rows = pixels.select("line", "sample", F.col("sample").alias("PixelX"), F.col("line").alias("PixelY"), clean.alias("mean")).orderBy("line", "sample")
    return wide_spectra(rows, wavelengths, ["PixelX", "PixelY"], digits=1, prefix="Wl_")


def roi_table(means: DataFrame, wavelengths: list[float], names: dict[int, str]) -> DataFrame:
    """Bands as rows, one column a region."""
    wl = F.create_map(*[F.lit(x) for b, w in enumerate(wavelengths) for x in (b, w)])
    named = means.withColumn("Banda", F.col("band") + 1).withColumn("Longitud_Onda_nm", wl[F.col("band")])
    label = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])[F.col("roi_id")]
    return named.withColumn("roi", label).groupBy("Banda", "Longitud_Onda_nm").pivot("roi", list(names.values())).agg(F.first("mean"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


#: Bytes of an image that one task encodes at a time.
BLOCK_BYTES = 8 << 20


def _height(header: Header, depth: int) -> int:
    return max(1, BLOCK_BYTES // max(1, header.samples * depth))


def blocks(rows: DataFrame, header: Header, columns: list[str], encode: Callable[[np.ndarray], tuple[bytes, int]]) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, check, plain size) of an image's blocks of lines, from the top; ``encode`` (an array of line, sample and channel to bytes and a check) runs in tasks.

    ``columns``: channels of 0 ... 255; pixels without a row are 0. The encoded blocks are stored, and the driver holds one of them at a time.
    """
    height, depth = _height(header, len(columns)), len(columns)
    spark = rows.sparkSession
    lines, samples = header.lines, header.samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["block"], 1):
            block, line = table.column("block").to_numpy(), table.column("line").to_numpy()
            for k in dict.fromkeys(block.tolist()):
                out = np.zeros((min(height, lines - k * height), samples, depth), np.uint8)
                own = np.flatnonzero((block == k) & (line >= 0))  # but for the row that stands for the block itself
                for c, name in enumerate(columns):
                    out[line[own] - k * height, table.column("sample").to_numpy()[own], c] = table.column(name).to_numpy()[own]
                data, check = encode(out)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([data], pa.binary()), pa.array([check]), pa.array([out.size])], names=["block", "data", "check", "size"])

    own = rows.select(F.floor(F.col("line") / height).cast("long").alias("block"), F.col("line").cast("int").alias("line"), F.col("sample").cast("int").alias("sample"), *[F.col(c).cast("int").alias(c) for c in columns])
    every = spark.range(-(-lines // height)).select(F.col("id").alias("block"), F.lit(-1).alias("line"), F.lit(-1).alias("sample"), *[F.lit(0).alias(c) for c in columns])
    spread = own.union(every).repartition("block").sortWithinPartitions("block")
    done = stored(spread.mapInArrow(run, "block long, data binary, check long, size long"), "image")
    for r in done.orderBy("block").toLocalIterator():
        yield bytes(r["data"]), r["check"], r["size"]


def _plain(x: np.ndarray) -> tuple[bytes, int]:
    return x.tobytes(), 0


def mask_npy(mask: DataFrame, header: Header) -> Iterator[bytes]:
    """One image's mask as the pieces of an NPY file of booleans (line, sample)."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "|b1", "fortran_order": False, "shape": (header.lines, header.samples)})
    yield head.getvalue()
    for data, _, _ in blocks(mask.select("line", "sample", F.lit(1).alias("on")), header, ["on"], _plain):
        yield data


def save_mask(mask: DataFrame, header: Header, path: str) -> None:
    save(mask_npy(mask, header), path)


def save(pieces: Iterator[bytes], path: str) -> None:
    """Writes pieces beside ``path`` and moves them there at the end, on any file system that pyarrow opens."""
    store, at = located(path)
    new = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(new) as out:
        for piece in pieces:
            out.write(piece)
    store.move(new, at)


def session_json(rois: DataFrame, date: str) -> DataFrame:
    """One row ``value``: the session document; explicit masks are left out."""
    kinds = {"pixel": "Pixel", "rect": "Rect", "circle": "Circle", "polygon": "Polygon", "freehand": "Freehand"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")]
    one = F.struct(
        kind.alias("Type"), F.col("color").alias("ColorArgb"), F.col("xs").alias("PointsX"), F.col("ys").alias("PointsY"), F.col("radius").alias("Radius"),
        F.col("variety").alias("Variety"), F.col("date").alias("Date"), F.col("brix").alias("MeasuredBrix"), F.col("notes").alias("Notes"),
    )
    kept = rois.where("kind <> 'mask'").agg(F.array_sort(F.collect_list(F.struct("roi_id", one.alias("s")))).alias("all"))
    return kept.select(F.to_json(F.struct(F.lit(date).alias("SessionDate"), F.col("all.s").alias("Selections"))).alias("value"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _deflated(x: np.ndarray) -> tuple[bytes, int]:
    """Lines, each after a filter byte of 0, as a part of a deflate stream that others can follow, and their checksum."""
    raw = np.pad(x.reshape(len(x), -1), ((0, 0), (1, 0))).tobytes()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw)


def _joined_adler(one: int, two: int, size: int) -> int:
    """Checksum of two stretches of bytes, the second ``size`` bytes long."""
    a, b, c, d = one & 0xFFFF, one >> 16, two & 0xFFFF, two >> 16
    return ((b + d + size * (a - 1)) % 65521) << 16 | (a + c - 1) % 65521


def png_pieces(image: DataFrame, header: Header) -> Iterator[bytes]:
    """A rendered image (line, sample, r, g, b) as the pieces of a PNG file, a chunk of data for each block."""
    yield b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", header.samples, header.lines, 8, 2, 0, 0, 0))
    check, held = 1, b"\x78\x9c"
    for k, (data, own, size) in enumerate(blocks(image, header, list("rgb"), _deflated)):
        if k:
            yield _chunk(b"IDAT", held)
        check, held = _joined_adler(check, own, size + size // (3 * header.samples)), data if k else held + data
    # the stream's last, empty part and its checksum
    yield _chunk(b"IDAT", held + b"\x03\x00" + struct.pack(">I", check)) + _chunk(b"IEND", b"")


def png(image: DataFrame, header: Header) -> bytes:
    return b"".join(png_pieces(image, header))


def tiff_pieces(image: DataFrame, header: Header) -> Iterator[bytes]:
    """The same as an uncompressed TIFF file, a strip for each block; files of this kind end at 4 GB."""
    size, height = header.lines * header.samples * 3, _height(header, 3)
    counts = [min(height, header.lines - k) * header.samples * 3 for k in range(0, header.lines, height)]
    offsets = [8 + sum(counts[:k]) for k in range(len(counts))]
    # bits a channel, then the lists of strips, then the directory; a list of one strip stands in its entry
    lists = 8 + size
    n = len(counts)
    where = lambda values, k: values[0] if n == 1 else lists + 6 + 4 * n * k
    directory_at = lists + 6 + (8 * n if n > 1 else 0)
    short, long = 3, 4
    # width, height, bits a channel, no compression, RGB, strips, channels, rows a strip, bytes of strips
    entries = [
        (256, long, 1, header.samples), (257, long, 1, header.lines), (258, short, 3, lists), (259, short, 1, 1), (262, short, 1, 2), (273, long, n, where(offsets, 0)),
        (277, short, 1, 3), (278, long, 1, height if n > 1 else header.lines), (279, long, n, where(counts, 1)),
    ]
    yield struct.pack("<2sHI", b"II", 42, directory_at)
    for data, _, _ in blocks(image, header, list("rgb"), _plain):
        yield data
    yield struct.pack("<3H", 8, 8, 8) + (struct.pack(f"<{2 * n}I", *offsets, *counts) if n > 1 else b"")
    yield struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)


def tiff(image: DataFrame, header: Header) -> bytes:
    return b"".join(tiff_pieces(image, header))


def save_image(image: DataFrame, header: Header, path: str) -> None:
    """A rendered image as PNG or TIFF, by the path's ending."""
    save((tiff_pieces if path.lower().endswith((".tif", ".tiff")) else png_pieces)(image, header), path)


def mat(variables: dict[str, np.ndarray]) -> bytes:
    """Double matrices as a version 5 MAT file, such as the wavelengths and the spectra of each region's pixels."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, a in variables.items():
        a = np.atleast_2d(np.asarray(a, dtype="<f8"))
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *a.shape)) + element(1, name.encode("ascii")) + element(9, a.tobytes("F"))
        out += element(14, body)
    return out
