import os

import numpy as np
import pytest

from hyperloom.model import PIXELS, BatchOptions, Header, SegmentationParams
from hyperloom.operators.decompose import Pls
from hyperloom.plans import pipelines
from hyperloom.sources import envi, sinks, tables
from hyperloom.streaming.folder import watch


def make(folder, name, interleave="bil", data_type=12, order=0, offset=0, values=None, ext=".raw"):
    lines, samples, bands = 3, 4, 5
    b, l, s = np.meshgrid(range(bands), range(lines), range(samples), indexing="ij")
    cube = (100 * b + 10 * l + s) % (200 if data_type == 1 else 10000) if values is None else values
    axes = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
    raw = np.ascontiguousarray(np.transpose(cube, axes)).astype((">" if order else "<") + envi.DTYPES[data_type])
    with open(f"{folder}/{name}{ext}", "wb") as f:
        f.write(b"\0" * offset + raw.tobytes())
    with open(f"{folder}/{name}.hdr", "w") as f:
        f.write(f"ENVI\n; a note = 1\nsamples = 9\nSAMPLES = {samples}\nlines = {lines}\nbands = {bands}\nheader offset = {offset}\ndata type = {data_type}\ninterleave = {interleave}\nbyte order = {order}\nwavelength = {{ 400, 425.5,\n450, x, 475\n, 500 }}\n")
    return cube


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("data_type", sorted(envi.DTYPES))
def test_decoding(tmp_path, interleave, data_type):
    for order in (0, 1):
        for offset in (0, 64):
            cube = make(tmp_path, "a", interleave, data_type, order, offset)
            h = envi.load_header(f"{tmp_path}/a.hdr")
            assert (envi.mapped(f"{tmp_path}/a.hdr", h) == cube).all()


def test_reader(spark, tmp_path):
    cube = make(tmp_path, "a", ext=".bil")
    make(tmp_path, "b")
    make(tmp_path, "White_1")
    open(f"{tmp_path}/lonely.hdr", "w").write("ENVI\n")
    assert [os.path.basename(p) for p in envi.scan_folder(str(tmp_path))] == ["a.hdr", "b.hdr"]
    df = envi.read(spark, str(tmp_path), partitionBytes="40")
    assert df.count() == 24 and df.rdd.getNumPartitions() == 6
    assert list(df.where("cube_id = 'a' and line = 2 and sample = 3").first()["spectrum"]) == cube[:, 2, 3].tolist()
    assert list(envi.read(spark, f"{tmp_path}/a.hdr", bands="4,0").where("line = 1 and sample = 2").first()["spectrum"]) == [cube[4, 1, 2], cube[0, 1, 2]]


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("data_type", [2, 5, 12])
def test_blocks(tmp_path, interleave, data_type):
    cube = make(tmp_path, "a", interleave, data_type, 1, 7)
    h = envi.load_header(f"{tmp_path}/a.hdr")
    store, at = envi.located(envi.binary_of(f"{tmp_path}/a.hdr"))
    with store.open_input_file(at) as f:
        for bands in ([0, 1, 2, 3, 4], [3], [4, 0]):
            for first, last, left, right in ((0, 3, 0, 4), (1, 2, 0, 4), (1, 3, 1, 3), (2, 3, 3, 4)):
                got = envi.block(f, h, bands, first, last, left, right)
                assert (got == cube[bands][:, first:last, left:right].transpose(1, 2, 0)).all()
    with open(f"{tmp_path}/a.raw", "ab") as f:
        f.truncate(60)
    with pytest.raises(ValueError, match="early"), store.open_input_file(at) as f:
        envi.block(f, h, [0, 4], 0, 3, 0, 4)


FILTERS = ["line = 1", "line >= 1 and line < 2", "line in (0, 2)", "line > 7", "1 >= line", "line = 1 or sample = 2", "cube_id = 'b'", "cube_id = 'a' and line <=> 2", "line is not null", "sample = 3", "sample between 1 and 2 and line = 0"]


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_plain_filters_reach_the_file(spark, tmp_path, interleave):
    make(tmp_path, "a", interleave)
    whole = envi.read(spark, f"{tmp_path}/a.hdr")
    rows = {(r["cube_id"], r["line"], r["sample"]): list(r["spectrum"]) for r in whole.collect()}
    cells = envi.read(spark, f"{tmp_path}/a.hdr", layout="long")
    sums = {(r["band"], r["line"], r["sample"]): r["value"] for r in cells.collect()}
    assert sums == {(b, line, sample): v for (_, line, sample), x in rows.items() for b, v in enumerate(x)}
    for condition in FILTERS:
        some = envi.read(spark, f"{tmp_path}/a.hdr").where(condition)
        kept = {(r["cube_id"], r["line"], r["sample"]): list(r["spectrum"]) for r in some.collect()}
        local = spark.createDataFrame([(*k, v) for k, v in rows.items()], PIXELS).where(condition)
        assert kept == {(r["cube_id"], r["line"], r["sample"]): list(r["spectrum"]) for r in local.collect()}
        assert (" or " in condition) == ("Filter (" in some._jdf.queryExecution().executedPlan().toString())
    long = {(r["band"], r["line"], r["sample"]): r["value"] for r in cells.where("band in (1, 4) and line = 2 and sample <> 0").collect()}
    assert long == {k: v for k, v in sums.items() if k[0] in (1, 4) and k[1] == 2 and k[2] != 0}


def test_bytes_that_filters_leave(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not

    sizes = []
    real = envi.read_at
    monkeypatch.setattr(envi, "read_at", lambda f, at, size: sizes.append(size) or real(f, at, size))

    def read(filters, interleave, **options):
        make(tmp_path, "a", interleave)
        r = envi._Reader({"path": f"{tmp_path}/a.hdr", **options})
        rest = list(r.pushFilters(filters))
        sizes.clear()
        n = sum(b.num_rows for p in r.partitions() for b in r.read(p))
        return n, sum(sizes), len(rest)

    line, sample, band = EqualTo(("line",), 1), EqualTo(("sample",), 2), EqualTo(("band",), 3)
    for interleave in ("bsq", "bil", "bip"):
        assert read([], interleave) == (12, 120, 0)
        assert read([line], interleave) == (4, 40, 0)
        assert read([line, sample], interleave)[:2] == (1, 10)
        assert read([In(("line",), (0, 2)), Not(line)], interleave) == (8, 80, 1)
        assert read([GreaterThan(("line",), 5)], interleave) == (0, 0, 0)
        assert read([band], interleave) == (12, 120, 1)  # a whole spectrum's column
        assert read([], interleave, bands="3")[1] == (120 if interleave == "bip" else 24)
        assert read([band, line], interleave, layout="long")[:2] == (4, 40 if interleave == "bip" else 8)
        assert read([EqualTo(("cube_id",), "b")], interleave) == (0, 0, 0)


def test_a_failed_write_leaves_the_older_file(spark, tmp_path):
    h = Header(4, 30, 5, interleave="bsq", wavelengths=(1, 2, 3, 4, 5))
    rows = spark.range(120, numPartitions=6).selectExpr("'c' as cube_id", "cast(id div 4 as int) as line", "cast(id % 4 as int) as sample", "transform(sequence(1, 5), b -> cast(b * id as float)) as spectrum")
    envi.write(rows, h, f"{tmp_path}/out")
    key = lambda d: sorted((r["line"], r["sample"], list(r["spectrum"])) for r in d.collect())
    old = key(envi.read(spark, f"{tmp_path}/out.hdr"))
    assert old == key(rows)
    bad = rows.selectExpr("cube_id", "line", "sample", "case when line = 17 then array(cast(raise_error('lost') as float)) else transform(spectrum, v -> v + 1) end as spectrum")
    with pytest.raises(Exception, match="lost"):
        envi.write(bad, h, f"{tmp_path}/out")
    assert key(envi.read(spark, f"{tmp_path}/out.hdr")) == old
    # two tasks with a line in common, lines out of order, and cells beyond the header
    for odd in (rows.repartition(3), rows.orderBy("line").union(rows.where("line = 3")), rows.selectExpr("cube_id", "line + 5 as line", "sample", "spectrum").coalesce(1)):
        with pytest.raises(Exception):
            odd.select("line", "sample", "spectrum").write.format("envi").mode("overwrite").options(header=envi.header_text(h)).save(f"{tmp_path}/out")
    assert key(envi.read(spark, f"{tmp_path}/out.hdr")) == old
    assert sorted(os.listdir(tmp_path)) == ["out.hdr", "out.raw"]
    with pytest.raises(Exception, match="overwrite"):
        rows.select("line", "sample", "spectrum").coalesce(1).write.format("envi").mode("append").options(header=envi.header_text(h)).save(f"{tmp_path}/out")
    envi.write(rows.where("line in (3, 29)"), h, f"{tmp_path}/out")
    got = {r["line"]: sum(r["spectrum"]) for r in envi.read(spark, f"{tmp_path}/out.hdr").where("sample = 1").collect()}
    assert len(got) == 30 and {k for k, v in got.items() if v} == {3, 29}


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_chunks_and_types_written(spark, tmp_path, interleave, monkeypatch):
    """Chunks of a line or two, whole numbers, both byte orders."""
    x = np.arange(7 * 3 * 2).reshape(7, 3, 2)
    h = Header(3, 7, 2, data_type=12, interleave=interleave, byte_order=1)
    w = envi.Writer({"path": f"{tmp_path}/o.hdr", "header": envi.header_text(h)}, True)
    monkeypatch.setattr(envi, "CHUNK_BYTES", 20)

    def batch(lines):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"line": pa.array(np.repeat(lines, 3)), "sample": pa.array(np.tile(range(3), len(lines))), "spectrum": [x[i, s].astype(float).tolist() for i in lines for s in range(3)]})

    lost = w.write(iter([batch([0, 1])]))  # an attempt that doesn't count
    w.commit([w.write(iter([batch([4]), batch([5, 6])])), w.write(iter([])), None, w.write(iter([batch([0, 1, 2])]))])
    assert lost.chunks and sorted(os.listdir(tmp_path)) == ["o.hdr", "o.raw"]
    back = np.asarray(envi.mapped(f"{tmp_path}/o.hdr", envi.load_header(f"{tmp_path}/o.hdr")))
    x[3] = 0
    assert (back == x.transpose(2, 0, 1)).all()


def test_headers():
    h = envi.parse_header("ENVI\nbands = 2\nband names = { b 410.5, b 420 }\ninterleave = xyz\n")
    assert h.wavelengths == (410.5, 420) and h.interleave == "bil" and h.band_names == ("b 410.5", "b 420")
    assert envi.parse_header("ENVI\nbands = 3\nband names = { a, b, c }\n").wavelengths == (400, 650, 900)
    assert envi.parse_header("ENVI\nbands = 2\nwavelength = { 1,\n2").wavelengths == (1, 2)
    assert envi.parse_header("ENVI\ndata ignore value = 7\n").ignore_value == 7
    with pytest.raises(ValueError):
        envi._dtype(Header(1, 1, 1, data_type=6))
    with pytest.raises(FileNotFoundError):
        envi.binary_of("/nowhere/x.hdr")


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_write_and_read_back(spark, tmp_path, interleave):
    make(tmp_path, "a")
    df = envi.read(spark, f"{tmp_path}/a.hdr")
    envi.write(df, Header(4, 3, 5, interleave=interleave, wavelengths=(1, 2, 3, 4, 5)), f"{tmp_path}/out")
    back = envi.read(spark, f"{tmp_path}/out.hdr")
    key = lambda d: sorted((r["line"], r["sample"], list(r["spectrum"])) for r in d.collect())
    assert key(back) == key(df)


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ID,Clase,Archivo,400.5,x\n1,a,f,1.5,bad\n2,b,f,nan,3\n")
    df, wl = tables.spectral_matrix(spark, str(tmp_path / "m.csv"))
    assert wl == [400.5, 1.0] and sorted(list(r["spectrum"]) for r in df.collect()) == [[0, 3], [1.5, 0]]
    (tmp_path / "t.csv").write_text("PixelX,Wl_400,Wl_401.5,Brix\n1,2,3,10\n2,x,4,bad\n3,5,6,11\n")
    df, names = tables.training_table(spark, str(tmp_path / "t.csv"))
    assert names == ["Wl_400", "Wl_401.5"] and df.count() == 2
    assert tables.training_table(spark, str(tmp_path / "t.csv"), features="first_row_numeric")[1] == ["PixelX", "Wl_400", "Wl_401.5"]
    assert tables.sniff_separator("a;b;c,d") == ";"
    model = Pls(np.array([1.0, -2.5]), 0.25)
    back = tables.parse_model(tables.model_text(model))
    assert back.intercept == 0.25 and back.coefficients.tolist() == [1.0, -2.5]
    other = tables.parse_model("Intercepto,12.0\nCoeficientes,1,2\n")
    assert other.intercept == 12 and other.coefficients.tolist() == [1, 2]
    pts = spark.createDataFrame([(0, 0), (4, 3)], "PixelX int, PixelY int")
    assert all(6 < r["Brix"] < 17 for r in tables.simulate_labels(pts).collect())


def test_sessions_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"SessionDate": "d", "Selections": [{"Type": "Rect", "ColorArgb": 1, "PointsX": [1, 3], "PointsY": [1, 2], "Radius": 0, "Variety": "v", "Date": "", "MeasuredBrix": 12.5, "Notes": ""}, {"Type": "Pixel", "PointsX": [9], "PointsY": [0]}]}')
    rois = tables.session(spark, str(tmp_path / "s.json"), 5, 5)
    assert [r["kind"] for r in rois.collect()] == ["rect"]
    text = sinks.session_json(rois, "d").first()[0]
    (tmp_path / "t.json").write_text(text)
    assert tables.session(spark, str(tmp_path / "t.json"), 5, 5).collect() == rois.collect()
    mask = spark.createDataFrame([(1, 2)], "line int, sample int")
    sinks.save_mask(mask, Header(4, 3, 1), str(tmp_path / "m.npy"))
    assert np.load(tmp_path / "m.npy").sum() == 1
    means = spark.createDataFrame([("img_7", 1, [1.0, 2.0]), ("img_7", 2, [3.0, 4.0])], "cube_id string, roi_id int, mean array<double>")
    assert sinks.sample_table(means, [400.0, 401.0]).columns == ["ID_Muestra", "Clase", "Nombre_Archivo", "400.00", "401.00"]
    assert {r["Instance_ID"] for r in sinks.batch_table(means, [400.0, 401.0]).collect()} == {"Instancia_001", "Instancia_002"}
    px = spark.createDataFrame([("c", 0, 1, [1.0, float("nan")])], PIXELS)
    assert tuple(sinks.pixel_table(px, [400.0, 401.0]).first()) == (1, 0, 1.0, 0.0)
    long = spark.createDataFrame([(1, 0, 5.0), (2, 0, 6.0)], "roi_id int, band int, mean double")
    assert tuple(sinks.roi_table(long, [400.0], {1: "a", 2: "b"}).first()) == (1, 400.0, 5.0, 6.0)
    sinks.write_csv(sinks.sample_table(means, [400.0, 401.0]), str(tmp_path / "out"))
    assert tables.spectral_matrix(spark, str(tmp_path / "out"))[1] == [400.0, 401.0]


def test_folder_and_stream(spark, tmp_path):
    values = np.zeros((5, 3, 4))
    values[:, 1:, 1:3] = 9
    make(tmp_path, "x_1", values=values)
    (tmp_path / "bad.hdr").write_text("ENVI\nsamples = 1\nlines = 1\nbands = 1\ndata type = 6\n")
    (tmp_path / "bad.raw").write_bytes(b"0000")
    o = BatchOptions(segmentation=SegmentationParams(threshold=100, invert=False, open_iterations=0, close_iterations=0, min_area=2, stretch=(0.0, 9.0)))
    spectra, problems = pipelines.folder(spark, str(tmp_path), o)
    assert [list(r["mean"]) for r in spectra.collect()] == [[9.0] * 5] and "bad.hdr" in problems.collect()[0][0]
    os.remove(tmp_path / "bad.hdr")
    q = watch(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "cp"), o)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    make(tmp_path, "y_2", values=values)
    make(tmp_path, "z_3", values=np.zeros((5, 3, 4)))
    watch(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "cp"), o).awaitTermination(120)
    assert {r["cube_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"x_1", "y_2"}
    spectra, problems = pipelines.folder(spark, str(tmp_path), o)
    assert spectra.count() == 2 and [tuple(r) for r in problems.collect()] == [("z_3", "no objects found")]


def test_reads_of_some_lines_and_bands(spark, tmp_path):
    make(tmp_path, "a")
    whole = {(r["line"], r["sample"]): list(r["spectrum"]) for r in envi.read(spark, f"{tmp_path}/a.hdr").collect()}
    some = {(r["line"], r["sample"]): list(r["spectrum"]) for r in envi.read(spark, f"{tmp_path}/a.hdr", lines="1:2", bands="3,0").collect()}
    assert some == {k: [v[3], v[0]] for k, v in whole.items() if k[0] == 1}


def strips(data):
    """Width, height and pixels of a TIFF file of strips."""
    import struct

    at = struct.unpack_from("<I", data, 4)[0]
    e = {x[0]: x[1:] for x in (struct.unpack_from("<HHII", data, at + 2 + 12 * k) for k in range(struct.unpack_from("<H", data, at)[0]))}
    n = e[273][1]
    read = lambda tag: [e[tag][2]] if n == 1 else list(struct.unpack_from(f"<{n}I", data, e[tag][2]))
    assert struct.unpack_from("<3H", data, e[258][2]) == (8, 8, 8)
    return e[256][2], e[257][2], b"".join(data[a : a + k] for a, k in zip(read(273), read(279)))


@pytest.mark.parametrize("size", [1 << 20, 40, 1])
def test_images_of_many_blocks(spark, tmp_path, monkeypatch, size):
    import zlib

    monkeypatch.setattr(sinks, "BLOCK_BYTES", size)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (23, 7, 3))
    x[5:12] = 0  # blocks without a row
    h = Header(7, 23, 1)
    rows = [(y, s, *map(int, x[y, s])) for y in range(23) for s in range(7) if x[y, s].any()]
    image = spark.createDataFrame(rows, "line int, sample int, r int, g int, b int").repartition(3)
    sinks.save_image(image, h, str(tmp_path / "a.png"))
    data = (tmp_path / "a.png").read_bytes()
    at, idat = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        idat += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(23, 22)
    assert (raw[:, 0] == 0).all() and (raw[:, 1:].reshape(23, 7, 3) == x).all()
    sinks.save_image(image, h, str(tmp_path / "a.tif"))
    width, height, pixels = strips((tmp_path / "a.tif").read_bytes())
    assert (width, height) == (7, 23) and (np.frombuffer(pixels, np.uint8).reshape(23, 7, 3) == x).all()
    sinks.save_mask(image, h, str(tmp_path / "m.npy"))
    assert (np.load(tmp_path / "m.npy") == x.any(2)).all() and sorted(os.listdir(tmp_path)) == ["a.png", "a.tif", "m.npy"]


def test_tiff(spark):
    import struct

    data = sinks.tiff(spark.createDataFrame([(0, 1, 1, 2, 3)], "line int, sample int, r int, g int, b int"), Header(2, 1, 1))
    mark, version, at = struct.unpack("<2sHI", data[:8])
    n = struct.unpack("<H", data[at : at + 2])[0]
    entries = {e[0]: e[3] for e in (struct.unpack("<HHII", data[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(n))}
    assert (mark, version) == (b"II", 42) and (entries[256], entries[257]) == (2, 1)
    assert data[entries[273] : entries[273] + entries[279]] == bytes([0, 0, 0, 1, 2, 3]) and struct.unpack("<3H", data[entries[258] : entries[258] + 6]) == (8, 8, 8)


def test_png(spark):
    import struct
    import zlib

    data = sinks.png(spark.createDataFrame([(0, 1, 1, 2, 3)], "line int, sample int, r int, g int, b int"), Header(2, 1, 1))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2, 1)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == bytes([0, 0, 0, 0, 1, 2, 3])


def test_mat():
    import struct

    data = sinks.mat({"wvgood": np.array([400.0, 500.0]), "ROI_1_Spec": np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])})
    assert len(data) % 8 == 0 and data[126:128] == b"IM"
    kind, size = struct.unpack("<II", data[128:136])
    body = data[136 : 136 + size]
    assert kind == 14 and struct.unpack("<ii", body[24:32]) == (1, 2) and body[40:46] == b"wvgood" and np.frombuffer(body[56:72]).tolist() == [400.0, 500.0]
