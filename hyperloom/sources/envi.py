"""ENVI header and raw pairs: a header parser, a partitioned batch reader and a writer that commits, on any file system that pyarrow opens.

The reader takes plain filters on cube_id, line, sample and (in the long layout) band, and reads only the bytes that they leave. The writer's tasks write parts of their own
attempts; only the commit puts them together and in the place of an older file, so a failed job leaves that as it was.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..model import PIXELS, PIXELS_LONG, Header, ramp

#: The format's type codes, and the extensions of data files.
DTYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}
EXTENSIONS = (".raw", ".img", ".dat", ".bil", ".bip", ".bsq")
#: Name prefixes of reference scans, which folder scans leave out.
REFERENCE_PREFIXES: tuple[str, ...] = ("dark", "white", "blank", "reference", "ref_", "dark_", "white_", "blanco", "oscuro")


def _fields(text: str) -> dict[str, str]:
    """key = value pairs, values in braces over several lines; whole-line comments and the leading magic are dropped; the last of equal keys wins."""
    lines = [x for x in text.splitlines() if not x.lstrip().startswith(";")]
    body = "\n".join(lines)
    body = re.sub(r"\A\s*ENVI[^\n]*\n?", "", body)
    found: dict[str, str] = {}
    at = 0
    while m := re.compile(r"[^\S\n]*([^=\n]+?)\s*=[^\S\n]*").search(body, at):
        at = m.end()
        if body[at : at + 1] == "{":
            stop = body.find("}", at)
            value, at = (body[at + 1 :], len(body)) if stop < 0 else (body[at + 1 : stop], stop + 1)
        else:
            stop = body.find("\n", at)
            value, at = (body[at:], len(body)) if stop < 0 else (body[at:stop], stop)
        found[m[1].strip().lower()] = value.strip()
    return found


def _numbers(text: str) -> list[float]:
    out = []
    for part in re.split(r"[,\n\r]", text):
        try:
            out.append(float(part.strip()))
        except ValueError:
            continue
    return out


def parse_header(text: str) -> Header:
    """A header file's text. Wavelengths come from their list, else from the band names' digits, else from 400 to 900."""
    f = _fields(text)
    whole = lambda k, d=0: int(f[k]) if re.fullmatch(r"[+-]?\d+", f.get(k, "")) else d
    bands = whole("bands")
    names = tuple(x.strip() for x in f.get("band names", "").split(",") if x.strip())
    wl = _numbers(f.get("wavelength", ""))
    if not wl and names:
        digits = [re.sub(r"[^0-9.]", "", n) for n in names]
        try:
            wl = [float(d) for d in digits]
        except ValueError:
            wl = []
    if not wl and bands:
        wl = ramp(bands)
    interleave = f.get("interleave", "bil").lower()
    try:
        ignore = float(f.get("data ignore value", "nan"))
    except ValueError:
        ignore = float("nan")
    return Header(
        whole("samples"), whole("lines"), bands, whole("data type", 4), interleave if interleave in ("bsq", "bil", "bip") else "bil", whole("byte order"), whole("header offset"),
        tuple(wl), f.get("wavelength units", "nm"), f.get("description", ""), names, ignore, f,
    )


def located(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:") if path.startswith(("/", "file:")) else os.path.abspath(path))


def load_header(path: str) -> Header:
    store, at = located(path)
    with store.open_input_stream(at) as f:
        return parse_header(f.read().decode("utf-8", "replace"))


def binary_of(header_path: str) -> str:
    """The data file beside a header."""
    base = header_path[:-4] if header_path.lower().endswith(".hdr") else os.path.splitext(header_path)[0]
    store, at = located(base)
    endings = [*(e for ext in EXTENSIONS for e in (ext, ext.upper())), ""]
    for ending, info in zip(endings, store.get_file_info([at + e for e in endings])):
        if info.is_file:
            return base + ending
    raise FileNotFoundError(f"no data file beside {header_path}")


def scan_folder(folder: str, references: bool = False) -> list[str]:
    """Sorted headers of a folder that have a data file; reference scans are left out unless asked for."""
    from pyarrow import fs

    store, at = located(folder)
    names = sorted(os.path.basename(i.path) for i in store.get_file_info(fs.FileSelector(at)) if i.is_file)
    have = set(names)
    found: dict[str, str] = {}
    for name in names:
        stem, ext = os.path.splitext(name)
        data = any(stem + e in have for ext in EXTENSIONS for e in (ext, ext.upper())) or stem in have
        if ext.lower() == ".hdr" and data and (references or not name.lower().startswith(REFERENCE_PREFIXES)):
            found.setdefault(stem.lower(), os.path.join(folder, name))
    return sorted(found.values())


class Wanted:
    """What filters leave of the whole numbers of one column."""

    def __init__(self):
        self.filters: list[Filter] = []

    def of(self, numbers: np.ndarray) -> np.ndarray:
        for f in self.filters:
            if isinstance(f, (EqualTo, EqualNullSafe)):
                numbers = numbers[numbers == f.value]
            elif isinstance(f, In):
                numbers = numbers[np.isin(numbers, [v for v in f.value if v is not None])]
            elif isinstance(f, GreaterThan):
                numbers = numbers[numbers > f.value]
            elif isinstance(f, GreaterThanOrEqual):
                numbers = numbers[numbers >= f.value]
            elif isinstance(f, LessThan):
                numbers = numbers[numbers < f.value]
            elif isinstance(f, LessThanOrEqual):
                numbers = numbers[numbers <= f.value]
        return numbers


def runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """First and last-but-one of each run of consecutive rising numbers."""
    cut = np.flatnonzero(np.diff(numbers) != 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(numbers, cut) if len(x)]


@dataclass
class _Part(InputPartition):
    path: str
    lines: list[tuple[int, int]]
    bands: list[int]
    samples: tuple[int, int]

    def __post_init__(self):
        super().__init__(self)


def read_at(file, at: int, size: int) -> bytes:
    """``size`` bytes of an open file from ``at`` on."""
    raw = file.read_at(size, at)
    if len(raw) < size:
        raise ValueError(f"the data file ends {size - len(raw)} bytes early")
    return raw


def block(file, h: Header, bands: list[int], first: int, last: int, left: int, right: int) -> np.ndarray:
    """Cells (line, sample, band) of some bands, of the lines ``first`` to before ``last`` and the samples ``left`` to before ``right``; only stretches of bytes that hold them are read."""
    kind = np.dtype(_dtype(h))
    n, m, size = last - first, right - left, kind.itemsize
    get = lambda cell, count: np.frombuffer(read_at(file, h.header_offset + cell * size, count * size), kind)
    whole_lines = m == h.samples
    if h.interleave == "bip":
        if whole_lines:
            return get(first * h.samples * h.bands, n * m * h.bands).reshape(n, m, h.bands)[:, :, bands]
        return np.stack([get((line * h.samples + left) * h.bands, m * h.bands).reshape(m, h.bands) for line in range(first, last)])[:, :, bands]
    if h.interleave == "bil":
        if whole_lines and 2 * len(bands) > h.bands:
            return get(first * h.bands * h.samples, n * h.bands * m).reshape(n, h.bands, m)[:, bands].transpose(0, 2, 1)
        return np.stack([np.stack([get((line * h.bands + b) * h.samples + left, m) for b in bands], 1) for line in range(first, last)])
    out = np.empty((n, m, len(bands)), kind)
    for k, b in enumerate(bands):
        if whole_lines:
            out[:, :, k] = get((b * h.lines + first) * h.samples, n * m).reshape(n, m)
        else:
            out[:, :, k] = np.stack([get((b * h.lines + line) * h.samples + left, m) for line in range(first, last)])
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.paths = options["headers"].split("\n") if options.get("headers") else [path] if path.lower().endswith(".hdr") else scan_folder(path)
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        first, _, last = options.get("lines", "").partition(":")
        self.lines = int(first or 0), int(last) if last else None
        self.size = int(options.get("partitionbytes", 64 << 20))
        self.long = options.get("layout", "pixels") == "long"
        self.wanted = {c: Wanted() for c in ("line", "sample", *(["band"] if self.long else []))}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of line, sample, band and cube_id with constants, all of which the reader then holds to itself; no cell has a null there."""
        for f in filters:
            (name,) = f.attribute if getattr(f, "attribute", None) and len(f.attribute) == 1 else (None,)
            if isinstance(f, IsNotNull) and name in (*self.wanted, "cube_id"):
                continue
            if name in self.wanted and isinstance(f, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and getattr(f, "value", None) is not None:
                self.wanted[name].filters.append(f)
            elif name == "cube_id" and isinstance(f, (EqualTo, In)):
                names = f.value if isinstance(f, In) else (f.value,)
                self.paths = [p for p in self.paths if cube_of(p) in names]
            else:
                yield f

    def partitions(self) -> list[_Part]:
        out = []
        for path in self.paths:
            h = load_header(path)
            lines = np.arange(self.lines[0], h.lines if self.lines[1] is None else min(self.lines[1], h.lines))
            bands = np.array(self.bands if self.bands is not None else range(h.bands), np.int64)
            samples = self.wanted["sample"].of(np.arange(h.samples))
            lines = self.wanted["line"].of(lines)
            bands = self.wanted["band"].of(bands) if self.long else bands
            if not len(lines) or not len(samples) or not len(bands):
                continue
            left, right = int(samples[0]), int(samples[-1]) + 1
            step = max(1, self.size // max(1, (right - left) * len(bands) * np.dtype(_dtype(h)).itemsize))
            out += [_Part(path, runs(lines[k : k + step]), bands.tolist(), (left, right)) for k in range(0, len(lines), step)]
        return out or [_Part("", [], [], (0, 0))]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.lines:
            return
        h, (left, right) = load_header(partition.path), partition.samples
        own = self.wanted["sample"].of(np.arange(left, right))
        cube, bands = cube_of(partition.path), partition.bands
        store, at = located(binary_of(partition.path))
        # lines of about a megabyte at a time
        step = max(1, (1 << 20) // max(1, (right - left) * len(bands) * 4))
        with store.open_input_file(at) as file:
            for first, last in partition.lines:
                for a in range(first, last, step):
                    b = min(a + step, last)
                    cells = block(file, h, bands, a, b, left, right)[:, own - left].astype(np.float32)
                    line = np.repeat(np.arange(a, b, dtype=np.int32), len(own))
                    sample = np.tile(own.astype(np.int32), b - a)
                    yield self.batch(cube, bands, line, sample, cells.reshape(len(line), len(bands)))

    def batch(self, cube: str, bands: list[int], line: np.ndarray, sample: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        n, k = x.shape
        if self.long:
            columns = [pa.array([cube] * (n * k)), *(pa.array(v.astype(np.int32)) for v in (np.tile(bands, n), np.repeat(line, k), np.repeat(sample, k))), pa.array(x.ravel())]
            return pa.RecordBatch.from_arrays(columns, names=["cube_id", "band", "line", "sample", "value"])
        spectra = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([cube] * n), pa.array(line), pa.array(sample), spectra], names=["cube_id", "line", "sample", "spectrum"])


def cube_of(header_path: str) -> str:
    return os.path.splitext(os.path.basename(header_path))[0]


class EnviSource(DataSource):
    """``spark.read.format("envi").load(header or folder)`` and ``df.write.format("envi").mode("overwrite").save(header)``.

    Reading: filters on cube_id, line and sample reach the reader. ``layout="long"`` gives a row a cell, with filters on band too. ``bands`` (a list, which also orders
    spectra) and ``lines`` (first:last) are read by name, ``headers`` names the headers of one scan by itself, a line each, ``partitionBytes`` sizes the line ranges.
    """

    @classmethod
    def name(cls) -> str:
        return "envi"

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return PIXELS_LONG if self._options().get("layout") == "long" else PIXELS

    def reader(self, schema) -> _Reader:
        return _Reader(self._options())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self._options(), overwrite)


def _dtype(h: Header) -> str:
    if h.data_type not in DTYPES:
        raise ValueError(f"data type {h.data_type} isn't supported")
    return (">" if h.byte_order else "<") + DTYPES[h.data_type]


def file_bytes(h: Header) -> int:
    """Bytes of a whole data file."""
    return h.header_offset + h.lines * h.samples * h.bands * np.dtype(_dtype(h)).itemsize


def mapped(header_path: str, h: Header) -> np.ndarray:
    """The file as a memory-mapped band, line, sample array."""
    shape = {"bsq": (h.bands, h.lines, h.samples), "bil": (h.lines, h.bands, h.samples), "bip": (h.lines, h.samples, h.bands)}[h.interleave]
    raw = np.memmap(binary_of(header_path), dtype=_dtype(h), mode="r", offset=h.header_offset, shape=shape)
    return raw.transpose({"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (2, 0, 1)}[h.interleave])


def register(spark: SparkSession) -> None:
    """Makes ``format("envi")`` known; sources in Python are only given filters where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EnviSource)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("envi").options(**options).load(path)


def header_text(h: Header, wavelength_format: str = "{:.2f}") -> str:
    wl = ", ".join(wavelength_format.format(w) for w in h.wavelengths)
    return (
        f"ENVI\ndescription = {{ {h.description} }}\nsamples = {h.samples}\nlines = {h.lines}\nbands = {h.bands}\nheader offset = 0\n"
        f"data type = {h.data_type}\ninterleave = {h.interleave}\nbyte order = {h.byte_order}\ndata ignore value = NaN\nwavelength units = {h.units}\nwavelength = {{ {wl} }}\n"
    )


#: Bytes of lines that a writing task holds before it writes them.
CHUNK_BYTES = 16 << 20


@dataclass
class _Written(WriterCommitMessage):
    """A part and its chunks: (first line, lines, byte in the part)."""

    path: str
    chunks: list[tuple[int, int, int]]


class Writer(DataSourceArrowWriter):
    """Writes one cube. Tasks write chunks of whole lines to parts beside the target, named by attempt; the commit joins those of the attempts that count.

    Each task's rows must be in the order of lines, and no line in two tasks: ``write`` sees to that, and the commit checks it. Cells without a row are 0.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.base = options["path"].removesuffix(".hdr")
        self.header = parse_header(options["header"])
        self.nan_as_zero = options.get("nanaszero", "false") == "true"
        self.parts = f"{self.base}.parts-{uuid.uuid4().hex}"
        store, at = located(self.base)
        if not overwrite and store.get_file_info(at + ".hdr").is_file:
            raise FileExistsError(f"{self.base}.hdr is there; write with mode overwrite")
        # by the driver alone: a task that outlives the abort doesn't bring the folder back
        store.create_dir(located(self.parts)[1], recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        h = self.header
        store, at = located(self.parts)
        name = f"part-{uuid.uuid4().hex}"  # no other attempt's
        per_line = h.bands * h.samples * np.dtype(_dtype(h)).itemsize
        height = max(1, CHUNK_BYTES // max(1, per_line))
        chunks: list[tuple[int, int, int]] = []
        held, first, done = None, -1, 0
        with store.open_output_stream(f"{at}/{name}") as out:

            def close(last: int) -> None:
                nonlocal done
                used = held[: last + 1 - first].transpose({"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[h.interleave])
                out.write(np.ascontiguousarray(used).tobytes())
                chunks.append((first, last + 1 - first, done))
                done += (last + 1 - first) * per_line

            last = -1
            for batch in batches:
                if not batch.num_rows:
                    continue
                line, sample = (np.asarray(batch.column(c)) for c in ("line", "sample"))
                if line[0] < last or (np.diff(line) < 0).any():
                    raise ValueError("rows aren't in the order of lines")
                x = np.asarray(batch.column("spectrum").flatten(), dtype=float).reshape(batch.num_rows, -1)
                if x.shape[1] != h.bands or line[0] < 0 or line[-1] >= h.lines or sample.min() < 0 or sample.max() >= h.samples:
                    raise ValueError("cells outside of the header's size")
                if self.nan_as_zero:
                    x = np.nan_to_num(x, nan=0.0)
                begin = 0
                while begin < len(line):
                    if held is None or line[begin] >= first + height:
                        if held is not None:
                            close(last)
                        first = int(line[begin])
                        held = np.zeros((height, h.samples, h.bands), _dtype(h))
                    end = int(np.searchsorted(line, first + height))
                    held[line[begin:end] - first, sample[begin:end]] = x[begin:end]
                    last, begin = int(line[end - 1]), end
            if held is not None:
                close(last)
        return _Written(f"{at}/{name}", chunks)

    def commit(self, messages: list[_Written | None]) -> None:
        """Streams the parts' chunks into one file in the order of lines, and moves it and its header to their places."""
        h = self.header
        store, at = located(self.base)
        per_line = h.samples * np.dtype(_dtype(h)).itemsize
        chunks = sorted((first, n, offset, m.path) for m in messages if m for first, n, offset in m.chunks)
        if any(a[0] + a[1] > b[0] for a, b in zip(chunks, chunks[1:])):
            raise ValueError("lines of one number in two tasks")
        # each plane of the file: the chunks' stretches in it, and how long a line is there
        planes, width = (h.bands, per_line) if h.interleave == "bsq" else (1, per_line * h.bands)
        files = {path: store.open_input_file(path) for path in {c[3] for c in chunks}}
        new = f"{self.parts.removeprefix(self.base)}/whole"
        with store.open_output_stream(at + new) as out:
            for plane in range(planes):
                line = 0
                for first, n, offset, path in chunks:
                    _zeros(out, (first - line) * width)
                    begin, size = offset + plane * n * width, n * width
                    for k in range(0, size, CHUNK_BYTES):
                        out.write(read_at(files[path], begin + k, min(CHUNK_BYTES, size - k)))
                    line = first + n
                _zeros(out, (h.lines - line) * width)
        for f in files.values():
            f.close()
        with store.open_output_stream(at + new + ".hdr") as out:
            out.write(header_text(h).encode())
        store.move(at + new, at + ".raw")
        store.move(at + new + ".hdr", at + ".hdr")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes what the tasks wrote."""
        from pyarrow import fs

        store, at = located(self.parts)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


def _zeros(out, size: int) -> None:
    for k in range(0, size, CHUNK_BYTES):
        out.write(bytes(min(CHUNK_BYTES, size - k)))


def write(pixels: DataFrame, h: Header, path: str, nan_as_zero: bool = False) -> None:
    """One cube's pixels as ``path``.hdr and ``path``.raw, on any file system that pyarrow opens and all tasks share.

    Rows are dealt by ranges of lines. An older file is replaced at the end, or stays where the job fails.
    """
    register(pixels.sparkSession)
    ordered = pixels.select("line", "sample", F.col("spectrum").cast("array<double>").alias("spectrum")).repartitionByRange("line").sortWithinPartitions("line", "sample")
    ordered.write.format("envi").mode("overwrite").options(header=header_text(h, "{!r}"), nanAsZero=str(nan_as_zero).lower()).save(path)
