"""The registered queries, over the virtual cube and the star schema, each with its SQL.

The virtual cube sees ``embeddings`` as 25 samples a line and 64 bands; ``invalid`` variants have NaN and infinities planted by the same rule on both
sides. Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.formula import PRESETS, compile_formula, preview
from ..functions.valid import nearest_rank, to_long
from ..model import ROIS, BatchOptions, Header, RenderOptions, SegmentationParams, ramp, virtual_cube
from ..operators import decompose, preprocess, render, roi, segment, stats
from ..operators.nearest import nearest_join
from ..sources import sinks
from ..sources.tables import session_rois
from . import pipelines, sql

BANDS, WIDTH = 64, 25
WL = ramp(BANDS)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The cube in SQL: px and lg (long form) as they are, lv (long form) with invalid cells.
PRELUDE = """with px as (
  select cast(vec_id // 25 as integer) as line, cast(vec_id % 25 as integer) as sample, label, vec_id,
    list_transform(embedding, lambda x: cast(x as double)) as sp from embeddings),
lg as (select line, sample, label, vec_id, cast(unnest(range(0, 64)) as integer) as band, unnest(sp) as v from px),
lv as (select line, sample, label, vec_id, band, case when (vec_id * 64 + band) % 97 = 0 then 'nan'::double
    when (vec_id * 64 + band) % 101 = 0 then 'inf'::double else v end as v from lg),
dim as (select cast(max(line) + 1 as integer) as n_lines, 25 as n_samples from px)
"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its SQL; SQL that begins with a comma or "select" gets the prelude."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = PRELUDE + sql if sql.lstrip().startswith((",", "select")) else sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def s6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str, invalid: bool = False) -> DataFrame:
    return virtual_cube(spark, sf_dir, invalid).select("cube_id", "line", "sample", "spectrum")


def size_of(pixels: DataFrame) -> Header:
    """Header of the virtual cube."""
    return Header(WIDTH, pixels.agg(F.max("line")).first()[0] + 1, BANDS, wavelengths=tuple(WL))


def long_result(pixels: DataFrame) -> DataFrame:
    return to_long(pixels).select("line", "sample", "band", r6("value", "value"))


ROI_ROWS = [
    (1, "rect", [3, 6], [2, 4], 0), (2, "circle", [12], [9], 5), (3, "polygon", [2, 20, 23, 8], [1, 3, 15, 17], 0), (4, "pixel", [5], [5], 0),
]


def rois(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, xs, ys, r, 0, None, None, None, None) for i, k, xs, ys, r in ROI_ROWS], ROIS)


def region_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = size_of(cube(spark, sf_dir))
    return roi.rasterise(rois(spark), h.lines, h.samples)


#: The same regions as SQL over px.
_POLYGON = list(zip(ROI_ROWS[2][2], ROI_ROWS[2][3]))


def _crossings() -> str:
    out = []
    for (xi, yi), (xj, yj) in zip(_POLYGON, _POLYGON[-1:] + _POLYGON[:-1]):
        if yi != yj:
            out.append(f"cast((({yi} > line) <> ({yj} > line)) and sample < ({xj}.0 - {xi}.0) * (line - {yi}.0) / ({yj}.0 - {yi}.0) + {xi}.0 as integer)")
    return " + ".join(out)


MASK = f""", roi as (
  select 1 as roi_id, line, sample from px where sample between 3 and 9 and line between 2 and 6
  union all select 2, line, sample from px where (sample - 12) * (sample - 12) + (line - 9) * (line - 9) <= 25
  union all select 3, line, sample from px where ({_crossings()}) % 2 = 1
  union all select 4, line, sample from px where sample = 5 and line = 5)
"""
#: A mask of scattered pixels and its SQL.
SPECKLE_BAND, SPECKLE = 7, 0.02


def speckle(pixels: DataFrame) -> DataFrame:
    return pixels.where(F.col("spectrum")[SPECKLE_BAND].cast("double") > SPECKLE).select("cube_id", "line", "sample")


SPECKLED = f", m as (select line, sample from px where sp[{SPECKLE_BAND + 1}] > {SPECKLE})\n"


_FOUR = ", o as (select * from (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)), n as (select m.line + dy as line, m.sample + dx as sample from m, o)\n"

# -- aggregation


@query(f"""select band, {s6('coalesce(min(v) filter (isfinite(v)), 0)')} as min, {s6('coalesce(max(v) filter (isfinite(v)), 0)')} as max,
  {s6('coalesce(avg(v) filter (isfinite(v)), 0)')} as mean, {s6('coalesce(stddev_pop(v) filter (isfinite(v)), 0)')} as std from lv group by band""")
def band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.band_stats(cube(spark, sf_dir, True)).select("band", *[r6(c, c) for c in ("min", "max", "mean", "std")])


@query(f"""select band, {s6('coalesce(min(v) filter (not isnan(v) and abs(v - 0.1) >= 1e-5), 0)')} as min,
  case when isinf(max(v) filter (not isnan(v))) then 'inf'::double else {s6('coalesce(max(v) filter (not isnan(v) and abs(v - 0.1) >= 1e-5), 1)')} end as max from lv group by band""")
def band_minmax_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.band_minmax(cube(spark, sf_dir, True), 0.1)
    return out.select("band", r6("min", "min"), F.when(F.col("max") == float("inf"), F.col("max")).otherwise(r6(F.when(F.col("max") < float("inf"), F.col("max")))).alias("max"))


@query(MASK + f"""select band, {s6('min(v)')} as min, {s6('max(v)')} as max from lg join (select distinct line, sample from roi) using (line, sample) group by band""")
def masked_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.band_minmax(cube(spark, sf_dir), mask=region_mask(spark, sf_dir)).select("band", r6("min", "min"), r6("max", "max"))


@query(f"select band, {s6('coalesce(avg(v) filter (isfinite(v)), 0)')} as mean from lv group by band")
def global_mean_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_spectrum(cube(spark, sf_dir, True)).select("band", r6("mean", "mean"))


@query(f"select label, band, {s6('avg(v)')} as mean from lg group by label, band")
def class_mean_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_spectrum(virtual_cube(spark, sf_dir), ["label"]).select("label", "band", r6("mean", "mean"))


@query(MASK + f"""select roi_id, band, {s6('coalesce(sum(v) filter (not isnan(v)), 0) / count(*)')} as mean
  from (select roi_id, band, case when isinf(v) then 0 else v end as v from lv join roi using (line, sample)) group by roi_id, band""")
def roi_mean_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir, True).withColumn("spectrum", F.transform("spectrum", lambda v: F.when(v == float("inf"), F.lit(0.0).cast("float")).otherwise(v)))
    return stats.roi_mean_spectrum(pixels, region_mask(spark, sf_dir)).select("roi_id", "band", r6("mean", "mean"))


@query(f"""select line, sample, {s6('avg(v)')} as mean, {s6('min(v)')} as min, {s6('max(v)')} as max, {s6('max(v) - min(v)')} as range
  from lv where isfinite(v) and not (vec_id * 64) % 97 = 0 group by line, sample""")
def pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pixel_stats(cube(spark, sf_dir, True)).where(~F.isnan("mean")).select("line", "sample", *[r6(c, c) for c in ("mean", "min", "max", "range")])


def _stats_sql(source: str) -> str:
    ranks = ", ".join(f"{s6(f'(list_sort(list(v)))[least(cast(count(*) as bigint) - 1, cast(floor(count(*) * {p}.0 / 100) as bigint)) + 1]')} as p{p}" for p in (1, 2, 5, 25, 50, 75, 95, 98, 99))
    return f"""select {s6('min(v)')} as min, {s6('max(v)')} as max, {s6('avg(v)')} as mean, {s6('stddev_pop(v)')} as std,
  {s6('(list_sort(list(v)))[cast(floor(count(*) * 50.0 / 100) as bigint) + 1]')} as median,
  {s6('avg((v - m) * (v - m) * (v - m)) / pow(max(s), 3)')} as skew, {ranks}, count(*) as count
  from (select v, avg(v) over () as m, stddev_pop(v) over () as s from ({source}))"""


def _stats_of(rows: DataFrame, column: str) -> DataFrame:
    out = stats.result_stats(rows, column)
    return out.select(*[r6(c, c) for c in out.columns if c != "count"], "count")


@query("with q as (select 1) " + _stats_sql("select value as v from events where isfinite(value)"))
def result_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_of(table(spark, sf_dir, "events"), "value")


@query("with q as (select 1) " + _stats_sql("select l_extendedprice as v from lineitem"))
def result_stats_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_of(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(f"""select band, {s6('s[cast(floor(n * 2.0 / 100) as bigint) + 1]')} as lo, {s6('s[greatest(1, cast(floor(n * 98.0 / 100) as bigint))]')} as render_hi,
  {s6('s[least(n, cast(floor(n * 98.0 / 100) as bigint) + 1)]')} as hi
  from (select band, list_sort(list(v)) as s, count(*) as n from lv where isfinite(v) group by band)""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_long(cube(spark, sf_dir, True)).select("band", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value").cast("double")).alias("v"))
    out = nearest_rank(rows, ["band"], "v", [("lo", 2.0, "plain"), ("render_hi", 98.0, "render_high"), ("hi", 98.0, "plain")])
    return out.select("band", r6("lo", "lo"), r6("render_hi", "render_hi"), r6("hi", "hi"))


def _histogram_sql(source: str, lo: str, hi: str) -> str:
    return f"""with v as ({source}), e as (select {lo} as lo, {hi} as hi from v),
  b as (select cast(greatest(0, least(255, floor((v - lo) / (case when hi = lo then 1 else hi - lo end) * 255))) as integer) as bin from v, e)
  select cast(g.bin as integer) as bin, count(b.bin) as count from range(256) g(bin) left join b on b.bin = g.bin group by g.bin"""


@query(_histogram_sql("select l_extendedprice as v from lineitem", "min(v)", "max(v)"))
def histogram_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(_histogram_sql("select value as v from events where isfinite(value)", "10.0", "60.0").replace("from v),", "),", 1))
def histogram_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events"), "value", lo=10.0, hi=60.0)


@query(f"""select a.band as i, b.band as j, {s6('covar_samp(a.v, b.v)')} as covariance from lg a join lg b using (vec_id) where a.band <= b.band group by all""")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.covariance(cube(spark, sf_dir)).select("i", "j", r6("covariance", "covariance"))


@query(f"""select source, split_part(file, '_', 1) as class, count(*) as documents from (select regexp_extract(source, '^[^0-9]*') || '_' || split_part(source, 'src', 2) as file, source from documents) group by all""")
def class_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.concat_ws("_", F.regexp_extract("source", "^[^0-9]*", 0), F.split("source", "src")[1]).alias("file"))
    return docs.groupBy("source", F.split("file", "_")[0].alias("class")).agg(F.count("*").alias("documents")).select("source", "class", "documents")


@query("select event_type, min(event_id) as first from events group by event_type")
def distinct_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(f"""with k as (select try_cast(json_extract_string(props, '$.k') as double) as k, value from events)
select count(*) as kept, {s6('avg(value)')} as mean from k where k is not null""")
def drop_bad_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").where(k.isNotNull()).agg(F.count("*").alias("kept"), r6(F.avg("value"), "mean"))


# -- projection and filters


@query("select line, sample, sp[11] as value from px")
def band_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).select("line", "sample", F.col("spectrum")[10].cast("double").alias("value"))


@query("select band, v as value from lg where line = 3 and sample = 7")
def spectrum_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(cube(spark, sf_dir).where("line = 3 and sample = 7")).select("band", F.col("value").cast("double").alias("value"))


@query("select line - 2 as line, sample - 4 as sample, band - 10 as band, v as value from lg where line between 2 and 9 and sample between 4 and 20 and band between 10 and 20")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(preprocess.crop(cube(spark, sf_dir), (4, 20), (2, 9), (10, 20))).select("line", "sample", "band", F.col("value").cast("double").alias("value"))


@query("select sample, sp[6] as value from px where line = 4")
def profile_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).where("line = 4").select("sample", F.col("spectrum")[5].cast("double").alias("value"))


@query("select line, sp[6] as value from px where sample = 4")
def profile_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).where("sample = 4").select("line", F.col("spectrum")[5].cast("double").alias("value"))


@query("select line, sample, band, v as value from lg where line % 4 = 0 and sample % 4 = 0")
def subsample4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(cube(spark, sf_dir).where("line % 4 = 0 and sample % 4 = 0")).select("line", "sample", "band", F.col("value").cast("double").alias("value"))


#: Digests by which cells are drawn, as keyed as the library's.
_DRAWN = """, d as (select label, line, sample, band, v, row_number() over (partition by label order by md5('42|' || line || '|' || sample || '|' || band || '|' || vec_id), line, sample, band, vec_id) as k from lg)
"""


@query(_DRAWN + "select label, line, sample, band, v as value from d where k <= 700")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same 700 cells of each class, however they are partitioned."""
    cells = to_long(virtual_cube(spark, sf_dir), "label", "vec_id")
    return stats.exact_sample(cells, 700, ["line", "sample", "band", "vec_id"], ["label"]).select("label", "line", "sample", "band", F.col("value").cast("double").alias("value"))


@query(f""", d as (select v, row_number() over (order by md5('42|' || line || '|' || sample || '|' || band), line, sample, band) as k from lv),
q as (select list_sort(list(v) filter (isfinite(v))) as s, count(*) filter (isfinite(v)) as n from d where k <= 5000)
select {s6('s[cast(floor(n * 2.0 / 100) as bigint) + 1]')} as lo, {s6('s[least(n, cast(floor(n * 98.0 / 100) as bigint) + 1)]')} as hi from q""")
def sampled_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sampled_limits(cube(spark, sf_dir, True)).select(r6("lo", "lo"), r6("hi", "hi"))


#: Orders seen as an image 125 samples wide.
_ORDERS = """with o as (select cast(o_orderkey // 125 as integer) as line, cast(o_orderkey % 125 as integer) as sample, o_totalprice as v from orders),
d as (select max(line) + 1 as n_lines, 125 as n_samples from o) """


@query(_ORDERS + f"""select o.line, o.sample, {s6('v')} as value from o, d where sample between case when n_samples < 1000 then 40 else 200 end and n_samples - case when n_samples < 1000 then 60 else 200 end
  and line between case when n_lines < 600 then 70 else 300 end and n_lines - case when n_lines < 600 then 40 else 100 end""")
def central_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    image = table(spark, sf_dir, "orders").select(((key - key % 125) / 125).cast("int").alias("line"), (key % 125).cast("int").alias("sample"), F.array("o_totalprice").alias("spectrum"))
    lines = image.agg(F.max("line")).first()[0] + 1
    return roi.central(image, lines, 125).select("line", "sample", r6(F.col("spectrum")[0], "value"))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's bands and their wavelengths."""
    n = cube(spark, sf_dir).agg(F.max(F.size("spectrum")).alias("n"))
    return n.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("band")).select("band", (400 + F.col("band") * 500.0 / 63).alias("wl"))


_BANDS_SQL = "w as (select cast(i as integer) as band, 400 + i * 500.0::double / 63 as wl from (select max(len(embedding)) as n from embeddings), range(1000) t(i) where i < n)"


def _nearest_sql(left: str, right: str, on: str, key: str, column: str, distance: str, by: str | None = None) -> str:
    """Both neighbours of each row of ``l`` by as-of joins with ``r`` (one row a value); ties go to the lower one. ``distance``: of places {a} and {b}."""
    same = f"l.{by} = r.{by} and " if by else ""
    one = lambda name, op: f"{name} as (select l.{key}, r.{on} as x, r.{column} from l asof join r on {same}l.{on} {op} r.{on})"
    down, up = distance.format(a="lo.x", b=f"l.{on}"), distance.format(a=f"l.{on}", b="hi.x")
    lower = f"lo.x is not null and (hi.x is null or {down} <= {up})"
    return f"""with {left}, {right}, {one('lo', '>=')}, {one('hi', '<=')} select l.{key}, case when {lower} then lo.{column} else hi.{column} end as {column},
  case when {lower} then {down} else {up} end as distance from l left join lo using ({key}) left join hi using ({key})"""


@query(_nearest_sql("l as (select event_id, 400 + value as wl from events where isfinite(value))", _BANDS_SQL + ", r as (select * from w)", "wl", "event_id", "band", "round({b} - {a}, 6) + 0.0"))
def nearest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band nearest to each of many wavelengths."""
    targets = table(spark, sf_dir, "events").where(~F.isnan("value") & (F.abs("value") < float("inf"))).select("event_id", (400 + F.col("value")).alias("wl"))
    return nearest_join(targets, _bands(spark, sf_dir), "wl", ["band"]).select("event_id", "band", r6("distance", "distance"))


@query(_nearest_sql("l as (select event_id, user_id, ts from events)", "r as (select user_id, ts, min(event_id) as purchase from events where event_type = 'purchase' group by all)", "ts", "event_id", "purchase", "epoch_us({b}) - epoch_us({a})", "user_id"))
def nearest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's nearest purchase of the same user in time."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return nearest_join(events.select("event_id", "user_id", "ts"), bought, "ts", ["purchase"], ["user_id"]).select("event_id", "purchase", "distance")


@query(f"with {_BANDS_SQL}, r as (select 400 + (p_retailprice - 900) * 5 as rwl, min(p_partkey) as ref from part group by all) select band, arg_min(ref, struct_pack(d := abs(rwl - wl), x := rwl)) as ref from w, r group by band")
def nearest_band_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band of the cube and the nearest one of a reference with many bands."""
    reference = table(spark, sf_dir, "part").select((400 + (F.col("p_retailprice") - 900) * 5).alias("wl"), F.col("p_partkey").alias("ref"))
    return nearest_join(_bands(spark, sf_dir), reference, "wl", ["ref"]).select("band", "ref")


@query(f"select {s6('sum(var)')} as total, cast(max(n) as bigint) as rows from (select var_samp(v) as var, count(*) as n from lg where vec_id not in (17, 30) group by band)")
def outlier_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components fitted again without two samples; their variances sum to the bands' own."""
    left, c = decompose.refit_without(virtual_cube(spark, sf_dir), [17, 30], BANDS, "vec_id")
    m = decompose.moments(left)
    total = float((c.loadings.T @ m.scatter @ c.loadings).trace() / (m.n - 1))
    return spark.createDataFrame([(total, m.n)], "total double, rows long").select(r6("total", "total"), "rows")


@query(f"select line, sample, band, {s6('case when line = 3 and sample = 7 and band = 9 then 2.5 else v end')} as value from lg")
def cell_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(preprocess.with_cell(cube(spark, sf_dir), 3, 7, 9, 2.5)).select("line", "sample", "band", r6(F.col("value").cast("double"), "value"))


# -- preprocessing

CALIBRATED = """, w as (select sample, band, max(v) filter (isfinite(v)) as w from lv where line in (0, 1) group by all),
d as (select sample, band, min(v) filter (isfinite(v)) as d from lv where line in (2, 3) group by all),
cal as (select line, sample, band, case when not isfinite(v) then v
  else least(1, greatest(0, (v - coalesce(d, 0)) / greatest(coalesce(w, 1) - coalesce(d, 0), 1e-4) * 0.99)) end as v from lv join w using (sample, band) join d using (sample, band))
"""


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir, True)
    return preprocess.calibrate(pixels, pixels.where("line in (0, 1)"), pixels.where("line in (2, 3)"))


def _finite(pixels: DataFrame) -> DataFrame:
    return long_result(pixels.withColumn("spectrum", F.transform("spectrum", lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)))).where("value is not null")


@query(CALIBRATED + f"select line, sample, band, {s6('v')} as value from cal where isfinite(v)")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(calibrated(spark, sf_dir))


@query(CALIBRATED + f"select line, sample, band, {s6('-log10(greatest(v, 1e-4))')} as value from cal where isfinite(v)")
def absorbance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(preprocess.absorbance(calibrated(spark, sf_dir)))


SNV = """, mo as (select line, sample, avg(v) as m, stddev_pop(v) as s from lv where isfinite(v) group by all)
"""


@query(SNV + f"select line, sample, band, {s6('(v - m) / (case when s < 1e-6 then 1 else s end)')} as value from lv join mo using (line, sample) where isfinite(v)")
def snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(preprocess.snv(cube(spark, sf_dir, True)))


@query(SNV + f"select line, sample, band, {s6('(v - m) / (case when s < 1e-6 then 1 else s end)')} as value from lv join mo using (line, sample) where isfinite(v)")
def snv_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(preprocess.snv_expression(cube(spark, sf_dir, True)))


@query(f""", me as (select band, avg(v) as m from lv where isfinite(v) group by band),
fit as (select line, sample, regr_slope(v, m) as b, regr_intercept(v, m) as a, count(*) as n from lv join me using (band) where isfinite(v) group by all)
select line, sample, band, {s6('(v - a) / case when abs(b) < 1e-9 then 1 else b end')} as value from lv join fit using (line, sample) where isfinite(v)""")
def msc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(preprocess.msc(cube(spark, sf_dir, True)))


def _savgol_sql(weights: str) -> str:
    """``weights``: a list in SQL; its middle is the centre's."""
    return f"""select line, sample, cast(unnest(range(0, 64)) as integer) as band, {s6('unnest(y)')} as value from (select line, sample, list_transform(range(0, 64), lambda b:
  list_sum(list_transform(range(1, len(w) + 1), lambda k: w[k] * sp[greatest(1, least(64, b + k - (len(w) - 1) // 2))]))) as y from px, (select {weights} as w))"""


#: The closed forms: of a parabola's slope over 15 points, and of its value over 5.
_SLOPE_15, _SMOOTH_5 = "list_transform(range(-7, 8), lambda k: k / 280.0::double)", "list_transform([-3, 12, 17, 12, -3], lambda k: k / 35.0::double)"


@query(_savgol_sql(_SLOPE_15))
def savgol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_result(preprocess.savgol(cube(spark, sf_dir), BANDS, 15, 2, 1))


@query(_savgol_sql(_SMOOTH_5))
def savgol_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_result(preprocess.savgol(cube(spark, sf_dir), BANDS, 5, 2, 0))


@query(f""", s as (select line, sample, band, v, 400 + band * 500.0 / 63 as wl from lg),
a as (select *, coalesce((lead(v) over w - lag(v) over w) / (lead(wl) over w - lag(wl) over w), 0) as d1 from s window w as (partition by line, sample order by band)),
b as (select *, (lead(d1) over w - lag(d1) over w) / (lead(wl) over w - lag(wl) over w) as e from a window w as (partition by line, sample order by band))
select line, sample, band, {s6('d1')} as d1, {s6('case when band between 2 and 61 then e else 0 end')} as d2 from b""")
def derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = preprocess.derivatives_of(cube(spark, sf_dir), WL)
    cells = both.select("line", "sample", F.posexplode(F.arrays_zip("d1", "d2")).alias("band", "d"))
    return cells.select("line", "sample", "band", r6("d.d1", "d1"), r6("d.d2", "d2"))


@query(f""", o as (select a.i - 1 as dy, b.i - 1 as dx from range(3) a(i), range(3) b(i)),
n as (select p.line, p.sample, p.band, case when isnan(q.v) then '-inf'::double else q.v end as v from lv p, o, dim, lv q where q.band = p.band and q.line = greatest(0, least(n_lines - 1, p.line + dy)) and q.sample = greatest(0, least(n_samples - 1, p.sample + dx)))
select line, sample, band, {s6('(list_sort(list(v)))[5]')} as value from n group by all having isfinite((list_sort(list(v)))[5])""")
def median3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir, True)
    h = size_of(pixels)
    return _finite(preprocess.median_filter(pixels, 3, h.lines, h.samples, tile=8))


def _rotate_sql(degrees: float, lines: str) -> str:
    import math

    a = degrees * math.pi / 180
    c, s = f"{math.cos(a)!r}::double", f"{math.sin(a)!r}::double"
    corner = lambda x, y: (f"({c} * ({x} - cx) - {s} * ({y} - cy) + cx)", f"({s} * ({x} - cx) + {c} * ({y} - cy) + cy)")
    xs, ys = zip(*(corner(x, y) for x in ("0.0::double", "25.0::double") for y in ("0.0::double", "n")))
    ends = ", ".join(f"{f}({', '.join(v)}) as {n}" for f, v, n in (("least", xs, "x0"), ("greatest", xs, "x1"), ("least", ys, "y0"), ("greatest", ys, "y1")))
    return f""", e as (select cast(n_lines as double) as n, 12.5::double as cx, n_lines / 2.0::double as cy, n_lines from dim), f as (select *, {ends} from e),
g as (select cast(y.i as integer) as line, cast(x.i as integer) as sample, cx, cy, x0, y0 from f, range(200) y(i), range(200) x(i) where y.i < ceil(y1 - y0) and x.i < ceil(x1 - x0)),
h as (select line, sample, cast(round_even({c} * (sample + x0 - cx) + {s} * (line + y0 - cy) + cx, 0) as integer) as sx,
  cast(round_even(-({s}) * (sample + x0 - cx) + {c} * (line + y0 - cy) + cy, 0) as integer) as sy from g)
select h.line, h.sample, cast(b.i as integer) as band, {s6('sp[b.i + 1]')} as value from h join px on px.line = sy and px.sample = sx, range(64) b(i)
union all select h.line, h.sample, -1, null from h where not exists (select 1 from px where px.line = sy and px.sample = sx)"""


def _or_empty(pixels: DataFrame) -> DataFrame:
    """All cells; one row of band -1 and no value for a pixel of nothing but NaN."""
    cells = to_long(pixels).select("line", "sample", "band", F.col("value").cast("double").alias("v"))
    some = cells.where(~F.isnan("v")).select("line", "sample", "band", r6("v", "value"))
    empty = pixels.where(F.forall("spectrum", lambda v: F.isnan(v))).select("line", "sample", F.lit(-1).alias("band"), F.lit(None).cast("double").alias("value"))
    return some.union(empty)


@query(_rotate_sql(30.0, ""))
def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    h = size_of(pixels)
    return _or_empty(preprocess.rotate(pixels, 30.0, h.lines, h.samples))


@query(f""", l as (select label, dense_rank() over (order by cast(label as varchar)) - 1 as k from (select distinct label from px)),
g as (select cast(y.i as integer) as line, cast(k * 25 + x.i as integer) as sample, label, cast(x.i as integer) as s from l, range(10000) y(i), range(25) x(i), dim where y.i < n_lines)
select g.line, g.sample, cast(b.i as integer) as band, {s6('sp[b.i + 1]')} as value from g join px on px.label = g.label and px.line = g.line and px.sample = g.s, range(64) b(i)
union all select g.line, g.sample, -1, null from g where not exists (select 1 from px where px.label = g.label and px.line = g.line and px.sample = g.s)""")
def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = virtual_cube(spark, sf_dir).withColumn("cube_id", F.concat(F.lit("c"), F.col("label").cast("string")))
    lines = pixels.agg(F.max("line")).first()[0] + 1
    sizes = pixels.select("cube_id").distinct().select("cube_id", F.col("cube_id").alias("path"), F.lit(lines).alias("lines"), F.lit(WIDTH).alias("samples"), F.lit(BANDS).alias("bands"))
    return _or_empty(preprocess.mosaic(pixels, sizes))


# -- formulas


def _band_at(nm: float) -> int:
    return min(range(BANDS), key=lambda i: (abs(WL[i] - nm), i)) + 1


def _guard(x: str) -> str:
    return f"case when isfinite(coalesce({x}, 'nan'::double)) then coalesce({x}, 0) else 0 end"


_N, _R, _B, _G = (f"sp[{_band_at(w)}]" for w in (800, 680, 450, 550))


def _formula(text: str, excluded=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cube(spark, sf_dir).select("line", "sample", r6(compile_formula(text, WL, excluded), "value"))

    return run


def _formula_query(name: str, text: str, sql: str, excluded=None) -> None:
    query(f"select line, sample, {s6(_guard(sql))} as value from px", name)(_formula(text, excluded))


_formula_query("formula_ndvi", PRESETS["ndvi"], f"({_N} - {_R}) / nullif({_N} + {_R}, 0)")
_formula_query("formula_evi", PRESETS["evi"], f"2.5 * ({_N} - {_R}) / nullif({_N} + 6 * {_R} - 7.5 * {_B} + 1, 0)")
_formula_query("formula_ratio", PRESETS["ratio"], f"{_R} / nullif({_G}, 0)")
_formula_query("formula_first_derivative", PRESETS["first_derivative"], "(sp[10] - sp[8]) / 2")
_formula_query("formula_second_derivative", PRESETS["second_derivative"], "sp[11] - 2 * sp[10] + sp[9]")
_formula_query("formula_sum", PRESETS["sum"], "sp[1] + sp[2]")
_formula_query("formula_geometric_mean", PRESETS["geometric_mean"], "case when sp[1] * sp[2] >= 0 then sqrt(sp[1] * sp[2]) end")
_formula_query("formula_log", PRESETS["log"], "ln(sp[1] + 1)")
_formula_query("formula_square", PRESETS["square"], "pow(sp[1], 2)")
_formula_query("formula_root", PRESETS["root"], "case when sp[1] >= 0 then sqrt(sp[1]) end")
_formula_query("formula_power", "-B[3]^2 + (B[1] + B[2])^2 * 2^3^0.5", "-pow(sp[3], 2) + pow(sp[1] + sp[2], 2) * pow(2, pow(3, 0.5))")
_formula_query(
    "formula_functions", "MIN(sin(B[1]), cos(B[2])) + max(exp(B[3]), atan2(B[4], PI)) + floor(B[5]*10) + ceil(B[6]*10) + round(B[7]*10) + abs(tan(B[8])) + asin(B[9]) + acos(B[10]) + atan(E) + log2(2 + B[11]) + log10(2 + B[12])",
    "least(sin(sp[1]), cos(sp[2])) + greatest(exp(sp[3]), atan2(sp[4], pi())) + floor(sp[5] * 10) + ceil(sp[6] * 10) + round_even(sp[7] * 10, 0) + abs(tan(sp[8])) + asin(sp[9]) + acos(sp[10]) + atan(exp(1)) + log2(2 + sp[11]) + log10(2 + sp[12])",
)
_formula_query("formula_excluded", "B{680} + B{800} * 3 + B[200]", f"{_N} * 3 + sp[64]", [(670.0, 690.0)])


_formula_query(
    "formula_conditional", "IIF(B[1] > 0.02 AND NOT (B[2] <= B[3] OR B[4] = 0), B[1] / B[5], IIF(B[6] <> 0, B[7] * 100 % 3, -1)) + IIF(B[8] >= B[9], 1, 0)",
    "case when sp[1] > 0.02 and not (sp[2] <= sp[3] or sp[4] = 0) then sp[1] / nullif(sp[5], 0) when sp[6] <> 0 then sp[7] * 100 - 3 * trunc(sp[7] * 100 / 3) else -1 end + case when sp[8] >= sp[9] then 1 else 0 end",
)
_formula_query("formula_condition", "B{800} > B{680} OR B[1] < 0", f"case when {_N} > {_R} or sp[1] < 0 then 1 else 0 end")


@query(MASK + f"""select roi_id, count(*) as pixels, {s6('avg(v)')} as mean, {s6('max(v)')} as most
from (select roi_id, {_guard(f'({_N} - {_R}) / nullif({_N} + {_R}, 0)')} as v from px join roi using (line, sample)) group by roi_id""")
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and a formula in SQL alone."""
    sql.register(spark, {"hl_ndvi": PRESETS["ndvi"]}, WL)
    cube(spark, sf_dir).createOrReplaceTempView("hl_pixels")
    rois(spark).createOrReplaceTempView("hl_regions")
    return spark.sql("""
        WITH size AS (SELECT max(line) + 1 AS lines, max(sample) + 1 AS samples FROM hl_pixels),
        region AS (SELECT r.roi_id, m.line, m.sample FROM hl_regions r CROSS JOIN size s, LATERAL rasterise(r.kind, r.xs, r.ys, r.radius, s.lines, s.samples) m)
        SELECT roi_id, count(*) AS pixels, round(avg(hl_ndvi(spectrum)), 6) + 0D AS mean, round(max(hl_ndvi(spectrum)), 6) + 0D AS most FROM hl_pixels JOIN region USING (line, sample) GROUP BY roi_id""")


@query(f"""select line, sample, {s6('case when isfinite(a) then a else 0 end + case when isfinite(b) then b else 0 end * 2 + 1')} as value
  from (select line, sample, max(v) filter (band = 0) as a, max(v) filter (band = 1) as b from lv group by line, sample)""")
def formula_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid cells read as 0 before anything is worked out."""
    return cube(spark, sf_dir, True).select("line", "sample", r6(compile_formula("B[1] + B[2] * 2 + 1", WL), "value"))


@query(MASK + f""", c as (select line, sample, 'centre' as place from dim, px where line = n_lines // 2 and sample = n_samples // 2
  union all (select line, sample, 'region' from roi where roi_id = 1 order by line, sample limit 1))
select place, sample, line, {s6('sp[1] + sp[2]')} as value from c join px using (line, sample)""")
def formula_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    h = size_of(pixels)
    both = [preview(pixels, "B[1] + B[2]", WL, h.lines, h.samples, m).withColumn("place", F.lit(p)) for p, m in (("centre", None), ("region", region_mask(spark, sf_dir)))]
    return both[0].union(both[1]).select("place", "sample", "line", r6("value", "value"))


# -- similarity and regression


@query(f""", ref as (select band, avg(v) as r from lg where line between 2 and 6 and sample between 3 and 9 group by band),
a as (select line, sample, sum(v * r) as dot, sqrt(sum(v * v)) as nv, sqrt(sum(r * r)) as nr from lg join ref using (band) group by line, sample)
select line, sample, {s6('acos(greatest(-1, least(1, dot / (nv * nr))))')} as angle from a""")
def spectral_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    mask = region_mask(spark, sf_dir).where("roi_id = 1")
    reference = [r["mean"] for r in stats.roi_mean_spectrum(pixels, mask).orderBy("band").collect()]  # one spectrum
    return decompose.spectral_angle(pixels, reference).select("line", "sample", r6("angle", "angle"))


_COEF = [(b % 7 - 3) / 10 for b in range(60)]


@query(f"select line, sample, {s6('1.5 + sum(case when isfinite(v) and band < 60 then v * (band % 7 - 3) / 10 else 0 end)')} as prediction from lv group by line, sample")
def pls_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    out = decompose.predict(cube(spark, sf_dir, True), decompose.Pls(np.array(_COEF), 1.5))
    return out.select("line", "sample", r6("prediction", "prediction"))


@query(f"select line, sample, {s6('list_avg(sp)')} as x, {s6('sp[33] - sp[17]')} as y from px")
def pseudo_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.pseudo_scatter(cube(spark, sf_dir)).select("line", "sample", r6("x", "x"), r6("y", "y"))


@query(f"select {s6('sum(var)')} as total, cast(64 as integer) as bands from (select var_samp(v) as var from lg group by band)")
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components' variances sum to the bands' own."""
    pixels = cube(spark, sf_dir)
    m = decompose.moments(pixels)
    c = decompose.principal(pixels, BANDS)
    total = float(c.explained.sum() * m.scatter.trace() / (m.n - 1))
    return spark.createDataFrame([(total, BANDS)], "total double, bands int").select(r6("total", "total"), "bands")


@query(f"""select {s6('sum(v) / sum(v)')} as shares, {s6('(select sum(c * c) from (select covar_samp(a.v, b.v) as c from lg a join lg b using (vec_id) group by a.band, b.band)) / pow(sum(v), 2)')} as squares
  from (select var_samp(v) as v from lg group by band)""")
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of variance of all components: they sum to 1, and their squares to those of the covariances."""
    e = decompose.principal(cube(spark, sf_dir), BANDS).explained
    return spark.createDataFrame([(float(e.sum()), float((e * e).sum()))], "shares double, squares double").select(r6("shares", "shares"), r6("squares", "squares"))


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    return decompose.project(pixels, decompose.principal(pixels, 3), True).select("line", "sample", *[r6(F.col("scores")[i], f"pc{i + 1}") for i in range(3)])


@query(f"""select line, sample, {s6('sum((v - m) * (v - m))')} as squares from lg join (select band, avg(v) as m from lg group by band) using (band) group by all""")
def pca_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a pixel's centred scores together are as long as its centred spectrum."""
    pixels = cube(spark, sf_dir)
    scores = decompose.project(pixels, decompose.principal(pixels, BANDS), True)
    return scores.select("line", "sample", r6(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x * x), "squares"))


@query()
def pca_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.pca_rgb(cube(spark, sf_dir)).drop("cube_id")


@query()
def nipals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    return decompose.project(pixels, decompose.nipals(pixels), True).select("line", "sample", *[r6(F.col("scores")[i], f"pc{i + 1}") for i in range(3)])


@query()
def analysed_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_result(decompose.analysed(cube(spark, sf_dir), 5))


_PRICE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(f"""select {s6('regr_slope(l_extendedprice, l_quantity)')} as coefficient, {s6('regr_intercept(l_extendedprice, l_quantity)')} as intercept, {s6('regr_r2(l_extendedprice, l_quantity)')} as r2 from lineitem""".replace("select", "with q as (select 1) select", 1))
def pls_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component on one column that varies (beside one that doesn't) is least squares."""
    rows = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity"), F.lit(1.0)).alias("spectrum"), F.col("l_extendedprice").alias("y"))
    m = decompose.train_pls(rows, 1)
    return spark.createDataFrame([(float(m.coefficients[0]), m.intercept, m.r2)], "coefficient double, intercept double, r2 double").select(*[r6(c, c) for c in ("coefficient", "intercept", "r2")])


def _pls_sql() -> str:
    cov = ", ".join(f"covar_samp({a}, {b}) as c{i}{j}" for i, a in enumerate(_PRICE) for j, b in enumerate(_PRICE))
    with_y = ", ".join(f"covar_samp({a}, l_extendedprice) as y{i}" for i, a in enumerate(_PRICE))
    means = ", ".join(f"avg({a}) as m{i}" for i, a in enumerate(_PRICE))
    tt = " + ".join(f"w{i} * w{j} * c{i}{j}" for i in range(4) for j in range(4))
    rows = " union all ".join(f"select '{a}' as name, {s6(f'b{i}')} as value from b" for i, a in enumerate(_PRICE))
    return f"""with c as (select {cov}, {with_y}, {means}, avg(l_extendedprice) as my from lineitem), n as (select *, sqrt(y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3) as norm from c),
w as (select *, {", ".join(f"y{i} / norm as w{i}" for i in range(4))} from n), q as (select *, (w0 * y0 + w1 * y1 + w2 * y2 + w3 * y3) / ({tt}) as q from w),
b as (select {", ".join(f"w{i} * q as b{i}" for i in range(4))}, my - q * (w0 * m0 + w1 * m1 + w2 * m2 + w3 * m3) as b4 from q) {rows} union all select 'intercept', {s6("b4")} from b"""


@query(_pls_sql())
def pls_one_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.array(*[F.col(c).cast("double") for c in _PRICE]).alias("spectrum"), F.col("l_extendedprice").alias("y"))
    m = decompose.train_pls(rows, 1)
    return spark.createDataFrame([*zip(_PRICE, m.coefficients.tolist()), ("intercept", m.intercept)], "name string, value double").select("name", r6("value", "value"))


def _pls3_sql() -> str:
    """Three components on four columns: each extraction a few subqueries."""
    n = range(len(_PRICE))
    cov = ", ".join(f"covar_samp({a}, {b}) as c{i}{j}" for i, a in enumerate(_PRICE) for j, b in enumerate(_PRICE))
    first = ", ".join(f"covar_samp({a}, l_extendedprice) as y{i}, avg({a}) as m{i}, 0.0 as b0_{i}, covar_samp({a}, l_extendedprice) as s0_{i}" for i, a in enumerate(_PRICE))
    dot = lambda a, b: " + ".join(f"{a}{i} * {b}{i}" for i in n)
    sql = f"with k0 as (select {cov}, {first}, avg(l_extendedprice) as my, var_samp(l_extendedprice) as vy, count(*) as n from lineitem)"
    for k in range(1, 4):
        sql += f", u{k} as (select *, " + ", ".join(f"s{k - 1}_{i} / sqrt({dot(f's{k - 1}_', f's{k - 1}_')}) as w{k}_{i}" for i in n) + f" from k{k - 1})"
        before = f"u{k}"
        for j in range(1, k):  # made orthogonal to the loadings so far, one after another
            old = f"w{k}_"
            name = f"r{k}_{j}_"
            source = f"r{k}_{j - 1}_" if j > 1 else old
            sql += f", v{k}_{j} as (select *, " + ", ".join(f"{source}{i} - ({dot(f'p{j}_', old)}) * r{j}_{i} as {name}{i}" for i in n) + f" from {before})"
            before = f"v{k}_{j}"
        last = f"r{k}_{k - 1}_" if k > 1 else f"w{k}_"
        sql += f", r{k} as (select *, " + ", ".join(f"{last}{i} as r{k}_{i}" for i in n) + f" from {before})"
        sql += f", t{k} as (select *, " + " + ".join(f"r{k}_{i} * r{k}_{j} * c{i}{j}" for i in n for j in n) + f" as tt{k} from r{k})"
        sql += f", l{k} as (select *, " + ", ".join("(" + " + ".join(f"c{i}{j} * r{k}_{j}" for j in n) + f") / tt{k} as p{k}_{i}" for i in n) + f", ({dot(f'r{k}_', f's{k - 1}_')}) / tt{k} as q{k} from t{k})"
        sql += f", k{k} as (select *, " + ", ".join(f"s{k - 1}_{i} - p{k}_{i} * q{k} * tt{k} as s{k}_{i}, b{k - 1}_{i} + r{k}_{i} * q{k} as b{k}_{i}" for i in n) + f" from l{k})"
    fit = " + ".join(f"b3_{i} * b3_{j} * c{i}{j}" for i in n for j in n)
    sql += f", f as (select *, my - ({dot('b3_', 'm')}) as intercept, vy - 2 * ({dot('b3_', 'y')}) + {fit} as e from k3)"
    rows = " union all ".join(f"select '{a}' as name, {s6(f'b3_{i}')} as value from f" for i, a in enumerate(_PRICE))
    return sql + f" {rows} union all select 'intercept', {s6('intercept')} from f union all select 'r2', {s6('1 - e / vy')} from f union all select 'rmse', {s6('sqrt(e * (n - 1) / n)')} from f"


@query(_pls3_sql())
def pls_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.array(*[F.col(c).cast("double") for c in _PRICE]).alias("spectrum"), F.col("l_extendedprice").alias("y"))
    m = decompose.train_pls(rows, 3)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(_PRICE, m.coefficients)] + [("intercept", m.intercept), ("r2", m.r2), ("rmse", m.rmse)], "name string, value double").select("name", r6("value", "value"))


# -- regions


@query(MASK + "select roi_id, line, sample from roi")
def roi_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_mask(spark, sf_dir)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mask = region_mask(spark, sf_dir)
    return mask.where("roi_id = 1").select("line", "sample"), mask.where("roi_id = 2").select("line", "sample")


_AB = MASK + ", a as (select line, sample from roi where roi_id = 1), b as (select line, sample from roi where roi_id = 2)\n"


@query(_AB + "select * from a union select * from b")
def roi_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.union(*_two(spark, sf_dir))


@query(_AB + "select * from a except select * from b")
def roi_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.subtract(*_two(spark, sf_dir))


@query(_AB + "select * from a intersect select * from b")
def roi_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.intersect(*_two(spark, sf_dir))


@query(MASK + "select roi_id, min(sample) as x0, max(sample) as x1, min(line) as y0, max(line) as y1 from roi group by roi_id")
def roi_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.bounds(region_mask(spark, sf_dir))


@query(MASK + f", mm as (select distinct line, sample from roi) select p.line, p.sample, band, case when mm.line is not null then {s6('v')} end as value from lg p left join mm using (line, sample)")
def apply_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to_long(roi.apply_mask(cube(spark, sf_dir), region_mask(spark, sf_dir)))
    return out.select("line", "sample", "band", r6(F.when(~F.isnan("value"), F.col("value").cast("double")), "value"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes as cubes of their own, with lines of twelve pixels."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = virtual_cube(spark, sf_dir).withColumn("k", k)
    return rows.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("cube_id"), ((F.col("k") - F.col("k") % 12) / 12).cast("int").alias("line"), (F.col("k") % 12).cast("int").alias("sample"), "spectrum")


_CUBES = """, k as (select 'c' || label as cube_id, row_number() over (partition by label order by vec_id) - 1 as k, sp from px),
cu as (select cube_id, cast(k // 12 as integer) as line, cast(k % 12 as integer) as sample, sp from k),
cm as (select cube_id, line, sample, cast(right(cube_id, 1) as integer) % 3 + 1 as roi_id from cu where sp[3] > 0.01)
"""


def _cube_masks(pixels: DataFrame) -> DataFrame:
    own = pixels.where(F.col("spectrum")[2].cast("double") > 0.01)
    return own.select("cube_id", "line", "sample", (F.substring("cube_id", -1, 1).cast("int") % 3 + 1).alias("roi_id"))


@query(_CUBES + f"""select cube_id, roi_id, cast(band as integer) as band, {s6('avg(sp[band + 1])')} as mean from cu join cm using (cube_id, line, sample), range(64) t(band) group by all""")
def cubes_under_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' mean spectra in many cubes, each under its own mask."""
    pixels = _labelled(spark, sf_dir)
    return stats.roi_mean_spectrum(pixels, _cube_masks(pixels)).select("cube_id", "roi_id", "band", r6("mean", "mean"))


@query(_CUBES + _FOUR + """, nn as (select cube_id, cm.line + dy as line, cm.sample + dx as sample from cm, o),
x as (select cube_id, line, sample from nn group by all having count(*) = 5) select cube_id, line, sample, 'erode' as step from x
union all select cm.cube_id, cm.line, cm.sample, 'rest' from cm where not exists (select 1 from x where x.cube_id = cm.cube_id and x.line = cm.line and x.sample = cm.sample)""".replace(", n as", ", n0 as"))
def cube_mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of many cubes eroded, and what that takes away; no cube's mask touches another's."""
    mask = _cube_masks(_labelled(spark, sf_dir))
    small = roi.erode(mask)
    return small.withColumn("step", F.lit("erode")).union(roi.subtract(mask, small).withColumn("step", F.lit("rest")))


@query(_CUBES + f""", me as (select cube_id, cast(b as integer) as band, avg(sp[b + 1]) as m from cu, range(64) t(b) group by all)
select cube_id, line, sample, {s6('sum((sp[band + 1] - m) * (sp[band + 1] - m))')} as squares from cu join me using (cube_id) group by all""")
def cube_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each cube by itself: all of a pixel's centred scores together are as long as its spectrum."""
    scores = decompose.project_each(_labelled(spark, sf_dir), BANDS)
    squares = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x * x)
    return scores.select("cube_id", "line", "sample", r6(squares, "squares"))


_HITS = """, c as (select cast(100 + s_suppkey as integer) as roi_id, cast(s_suppkey * 7 % 25 as integer) as cx, cast(s_suppkey * 11 % 40 as integer) as cy, cast(s_nationkey % 5 as integer) as radius from supplier),
n as (select cast(1000 + n_nationkey as integer) as roi_id, cast(n_nationkey * 3 % 23 as integer) as x0, cast(n_nationkey * 5 % 37 as integer) as y0, cast(n_regionkey * 4 as integer) as w from nation),
al as (select * from roi union all select c.roi_id, line, sample from px join c on (sample - cx) * (sample - cx) + (line - cy) * (line - cy) <= radius * radius
  union all select n.roi_id, line, sample from px join n on sample between x0 and x0 + w and line between y0 and y0 + w)
select px.vec_id, max(roi_id) as top, min(roi_id) as first, count(roi_id) as regions from px left join al using (line, sample) group by px.vec_id
"""


@query(MASK + _HITS)
def region_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last and the first of many regions that hold each of many points."""
    rest = lambda c: F.lit(None).cast(c)
    c = table(spark, sf_dir, "supplier").select((100 + F.col("s_suppkey")).cast("int").alias("roi_id"), F.lit("circle").alias("kind"), F.array((F.col("s_suppkey") * 7 % 25).cast("int")).alias("xs"), F.array((F.col("s_suppkey") * 11 % 40).cast("int")).alias("ys"), (F.col("s_nationkey") % 5).cast("int").alias("radius"))
    side = (F.col("n_regionkey") * 4).cast("int")
    n = table(spark, sf_dir, "nation").select((1000 + F.col("n_nationkey")).cast("int").alias("roi_id"), F.lit("rect").alias("kind"), F.array((F.col("n_nationkey") * 3 % 23).cast("int"), side).alias("xs"), F.array((F.col("n_nationkey") * 5 % 37).cast("int"), side).alias("ys"), rest("int").alias("radius"))
    regions = rois(spark).select("roi_id", "kind", "xs", "ys", "radius").union(c).union(n)
    return roi.hits(virtual_cube(spark, sf_dir).select("vec_id", "line", "sample"), regions).select("vec_id", "top", "first", "regions")


_OUTLINE = [(2, 1), (3, 2), (4, 2), (9, 4), (15, 3), (20, 3), (21, 8), (23, 14), (16, 15), (8, 16), (7, 12), (3, 6)]


def _outline_sql() -> str:
    points = roi.simplify(_OUTLINE)
    crossings = " + ".join(
        f"cast((({yi} > line) <> ({yj} > line)) and sample < ({xj}.0 - {xi}.0) * (line - {yi}.0) / ({yj}.0 - {yi}.0) + {xi}.0 as integer)" for (xi, yi), (xj, yj) in zip(points, points[-1:] + points[:-1]) if yi != yj
    )
    return f"select line, sample from px where ({crossings}) % 2 = 1"


@query(_outline_sql())
def freehand_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A freehand outline, simplified and filled."""
    points = roi.simplify(_OUTLINE)
    df = spark.createDataFrame([(1, "freehand", [x for x, _ in points], [y for _, y in points], 0, 0, None, None, None, None)], ROIS)
    h = size_of(cube(spark, sf_dir))
    return roi.rasterise(df, h.lines, h.samples).select("line", "sample")


@query("""with o as (select n_nationkey as roi_id, n_name as name from nation) select cast(case roi_id when 7 then 6 when 6 then 7 when (select min(roi_id) from o where roi_id > 11) then 11 when 11 then
  (select min(roi_id) from o where roi_id > 11) else roi_id end as integer) as roi_id, name from o""")
def region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region moved up past its neighbour, another one moved down."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("roi_id"), F.col("n_name").alias("name"))
    return roi.moved(roi.moved(regions, 7, -1), 11, 1).select("roi_id", "name")




@query(SPECKLED + _FOUR + "select distinct n.line, n.sample from n, dim where n.line between 0 and n_lines - 1 and n.sample between 0 and n_samples - 1")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    h = size_of(pixels)
    return roi.dilate(speckle(pixels), h.lines, h.samples).select("line", "sample")


@query(SPECKLED + _FOUR + "select line, sample from n group by all having count(*) = 5")
def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.erode(speckle(cube(spark, sf_dir))).select("line", "sample")


@query(SPECKLED + _FOUR + """select m.line, m.sample from m join (select line, sample, count(*) as c from n group by all) using (line, sample), dim
where c < 5 or m.line = 0 or m.sample = 0 or m.line = n_lines - 1 or m.sample = n_samples - 1""")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    h = size_of(pixels)
    return roi.edges(speckle(pixels), h.lines, h.samples).select("line", "sample")


def _reach(source: str, step: str) -> str:
    """Components of the cells of ``source`` by recursion from every cell."""
    return f""" walk(root, line, sample) as (select line * 25 + sample, line, sample from {source}
  union select w.root, c.line, c.sample from walk w join {source} c on {step})"""


_EIGHT = "abs(c.line - w.line) <= 1 and abs(c.sample - w.sample) <= 1"
_CROSS = "abs(c.line - w.line) + abs(c.sample - w.sample) <= 1"


def _recursive(sql: str) -> str:
    return (PRELUDE + sql).replace("with px", "with recursive px", 1)


@query(_recursive(SPECKLED + "," + _reach("m", _EIGHT) + """, c as (select line, sample, min(root) as root from walk group by all)
select line, sample, cast(dense_rank() over (order by root) as integer) as label from c"""))
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.labels(speckle(cube(spark, sf_dir))).select("line", "sample", "label")


@query(_recursive(SPECKLED + "," + _reach("m", _EIGHT) + """, c as (select line, sample, min(root) as root from walk group by all), z as (select root, count(*) as area from c group by root having count(*) >= 6),
z2 as (select root, area, row_number() over (order by root) as k from z)
select line, sample, area, format('Instancia_{:03d}', k) as name from c join z2 using (root)"""))
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments(speckle(cube(spark, sf_dir)), 6).select("line", "sample", "area", "name")


@query(_recursive(SPECKLED + ", bg as (select line, sample from px where (line, sample) not in (select (line, sample) from m))," + _reach("bg", _CROSS) + """, c as (select line, sample, min(root) as root from walk group by all),
outside as (select distinct root from c, dim where line = 0 or sample = 0 or line = n_lines - 1 or sample = n_samples - 1)
select line, sample from m union select line, sample from c where root not in (select root from outside)"""))
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    h = size_of(pixels)
    return segment.fill_holes(speckle(pixels), h.lines, h.samples, pixels).select("line", "sample")


@query(_recursive(""", s4 as (select line, sample, list_transform(range(0, 16), lambda k: sp[k * 4 + 1]) as s from px),
seed as (select s as t from s4 where line = 8 and sample = 12),
ok as (select line, sample from s4, seed where list_dot_product(s, t) / sqrt(list_dot_product(s, s) * list_dot_product(t, t)) >= cos(0.9 * 1.5)),
walk(line, sample) as (select line, sample from ok where line = 8 and sample = 12
  union select c.line, c.sample from walk w join ok c on abs(c.line - w.line) + abs(c.sample - w.sample) <= 1)
select line, sample from walk"""))
def region_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.grow(cube(spark, sf_dir), 8, 12, 90.0, BANDS).select("line", "sample")


#: Stretch limits of band 20.
_LIMITS = ", q as (select list_sort(list(v)) as s, count(*) as n from lv where band = 20 and isfinite(v)), e as (select s[cast(floor(n * 0.02) as bigint) + 1] as lo, s[cast(floor(n * 0.98) as bigint) + 1] as hi from q)\n"


def _segment_sql() -> str:
    """Threshold, close, open and label, a step a subquery."""
    sql = _LIMITS.replace("lv", "lg") + """, gray as (select line, sample, cast(floor(greatest(0, least(1, (v - lo) / (case when hi - lo <= 1e-5 then 1 else hi - lo end))) * 255) as integer) as gray from lg, e where band = 20),
k as (select * from (values """ + ", ".join(f"({dy}, {dx})" for dy, dx in segment.ELLIPSE) + """) t(dy, dx)),
s0 as (select line, sample from gray, dim where gray <= 110 and line >= cast(floor(n_lines * 5 / 100) as integer))"""
    needed = "(select count(*) from k where c.line + dy between 0 and n_lines - 1 and c.sample + dx between 0 and n_samples - 1)"
    for i, step in enumerate(("dilate", "erode", "erode", "dilate")):
        shifted = f"select s{i}.line + dy as line, s{i}.sample + dx as sample from s{i}, k"
        if step == "dilate":
            sql += f", s{i + 1} as (select distinct line, sample from ({shifted}), dim where line between 0 and n_lines - 1 and sample between 0 and n_samples - 1)"
        else:
            sql += f", c{i} as (select line, sample, count(*) as n from ({shifted}) group by all), s{i + 1} as (select line, sample from c{i} c, dim where line between 0 and n_lines - 1 and sample between 0 and n_samples - 1 and n = {needed})"
    return _recursive(sql + "," + _reach("s4", _EIGHT) + """, c as (select line, sample, min(root) as root from walk group by all), l as (select *, cast(dense_rank() over (order by root) as integer) as label from c),
z as (select label, count(*) as area from l group by label having count(*) >= 4), z2 as (select label, area, row_number() over (order by label) as k from z)
select line, sample, label, area, format('Instancia_{:03d}', k) as name from l join z2 using (label)""")


@query(_segment_sql())
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    p = SegmentationParams(threshold=110, invert=True, open_iterations=1, close_iterations=1, min_area=4, ignore_top=5)
    h = size_of(pixels)
    mask = segment.raw_mask(segment.to_8bit(pixels, 20), h.lines, h.samples, p)
    return segment.segments(mask, p.min_area).select("line", "sample", "label", "area", "name")


@query("""with o as (select o_orderkey, cast(o_orderkey % 30 as integer) as x, cast(o_custkey % 24 as integer) as y, cast(o_orderkey % 5 + 1 as integer) as w, o_orderstatus as s, o_totalprice as p from orders),
t as (select x, y, w, p, 0 as roi_id, 'rect' as kind, greatest(x, w) as mx, greatest(y, 3) as my from o union all select x, y, w, p, 1, 'circle', x, y from o union all select x, y, w, p, 2, 'pixel', x + 5, y from o)
select cast(roi_id as integer) as roi_id, kind, count(*) as regions, cast(sum(x) as bigint) as xs, round(avg(case when kind = 'rect' then cast(cast(p / 1e5 as float) as double) end), 5) + 0.0 as brix
from t where mx < 25 and my < 20 group by all""")
def session_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of three regions for each order; regions that leave the image are dropped."""
    from ..sources.tables import SESSION

    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 30).cast("int").alias("x"), (F.col("o_custkey") % 24).cast("int").alias("y"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("w"), (F.col("o_totalprice") / 1e5).cast("float").alias("brix"))
    none = F.lit(None)
    shape = lambda kind, xs, ys, radius, brix: F.struct(F.lit(kind).alias("Type"), none.alias("ColorArgb"), xs.alias("PointsX"), ys.alias("PointsY"), radius.alias("Radius"), none.alias("Variety"), none.alias("Date"), brix.alias("MeasuredBrix"), none.alias("Notes"))
    x, y = F.col("x"), F.col("y")
    kinds = [("Rect", F.array(x, F.col("w")), F.array(y, F.lit(3)), none, F.col("brix")), ("Circle", F.array(x), F.array(y), F.col("w"), none), ("Pixel", F.array(x + 5), F.array(y), none, none)]
    types = dict(t.split(":", 1) for t in SESSION.split("struct<")[1].removesuffix(">>").replace("array<int>", "array_int").split(","))
    kind_of = "array<struct<" + ",".join(f"{k}:{v.replace('array_int', 'array<int>')}" for k, v in types.items()) + ">>"
    sessions = o.select(F.lit("2024-01-01").alias("SessionDate"), F.array(*[shape(*k) for k in kinds]).cast(kind_of).alias("Selections"))
    out = session_rois(sessions, WIDTH, 20).withColumn("x", F.when(F.col("kind") == "pixel", F.col("xs")[0] - 5).otherwise(F.col("xs")[0]))
    return out.groupBy("roi_id", "kind").agg(F.count("*").alias("regions"), F.sum("x").alias("xs"), (F.round(F.avg(F.col("brix").cast("double")), 5) + 0.0).alias("brix"))


# -- rendering



@query(_LIMITS + """select line, sample, case when not isfinite(v) then 0 else cast(floor(greatest(0, least(1, (v - lo) / (case when hi - lo <= 1e-5 then 1 else hi - lo end))) * 255) as integer) end as gray from lv, e where band = 20""")
def stretch_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.to_8bit(cube(spark, sf_dir, True), 20).select("line", "sample", "gray")


def _byte(x: str) -> str:
    return f"cast(floor(greatest(0.0, least(1.0, {x})) * 255) as integer)"


_RAINBOW = {
    "r": "case when t < 0.375 then 0.0 when t < 0.625 then (t - 0.375) * 4 else 1.0 end",
    "g": "case when t < 0.125 then 0.0 when t < 0.375 then (t - 0.125) * 4 when t < 0.625 then 1.0 when t < 0.875 then 1 - (t - 0.625) * 4 else (t - 0.875) * 8 end",
    "b": "case when t < 0.125 then 0.5 + t * 4 when t < 0.375 then 1.0 when t < 0.625 then 1 - (t - 0.375) * 4 when t < 0.875 then 0.0 else (t - 0.875) * 8 end",
}
_MAPS = {
    "rainbow": _RAINBOW,
    "heatmap": {"r": "t * 3", "g": "t * 3 - 1", "b": "t * 3 - 2"},
    "grayscale": {"r": "t", "g": "t", "b": "t"},
    "cold_blue": {"r": "t * 2 - 1", "g": "t * 2 - 1", "b": "t * 2"},
    "green_fluorescent": {"r": "greatest(0.0, least(1.0, t * 2 - 1)) * 0.5", "g": "t * 1.5", "b": "t * 0.5"},
    "red_fluorescent": {"r": "t * 1.5", "g": "greatest(0.0, least(1.0, t * 0.5)) * 0.3", "b": "0.0"},
}
#: Events' values in steps of 1024, which are exact on both sides.
_GRID = "with t as (select event_id as i, least(1024, floor(value * 2)) / 1024 as t from events where isfinite(value)) "


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").where(~F.isnan("value") & (F.abs("value") < float("inf")))
    return values.select(F.col("event_id").alias("i"), (F.least(F.lit(1024.0), F.floor(F.col("value") * 2).cast("double")) / 1024).alias("t"))


def _colormap_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _steps(spark, sf_dir).select("i", color.colormap(F.col("t"), name).alias("c")).select("i", "c.*")

    query(_GRID + "select i, " + ", ".join(f"{_byte(x)} as {c}" for c, x in _MAPS[name].items()) + " from t", f"colormap_{name}")(run)


for _name in _MAPS:
    _colormap_query(_name)


@query(_GRID + "select i, " + ", ".join(f"{_byte(f'1.5 - abs(2 * t - {c})')} as {n}" for c, n in ((1.5, "r"), (1.0, "g"), (0.5, "b"))) + " from t")
def colormap_jet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("i", color.jet(F.col("t")).alias("c")).select("i", "c.*")


_RENDER = """, q as (select list_sort(list(v)) as s, count(*) as n from lv where band = 20 and not isnan(v)),
e as (select s[least(cast(floor(n * 0.02) as bigint), greatest(0, cast(floor(n * 0.98) as bigint) - 1)) + 1] as lo, s[greatest(0, cast(floor(n * 0.98) as bigint) - 1) + 1] as hi from q),
x as (select line, sample, v, greatest(0.0, least(1.0, (v - lo) / (case when hi - lo <= 0 then 1e-6 else hi - lo end))) as t from lv, e where band = 20)
"""


@query(_RENDER + "select line, sample, " + ", ".join(f"case when isnan(v) or v < -0.1 then 0 else {_byte(x)} end as {c}" for c, x in _RAINBOW.items()) + " from x")
def render_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_band(cube(spark, sf_dir, True), 20, RenderOptions(threshold=-0.1)).drop("cube_id")


def _rgb_sql() -> str:
    bands = [_band_at(w) - 1 for w in (640, 550, 460)]
    out = ""
    for i, b in enumerate(bands):
        out += f", q{i} as (select list_sort(list(v)) as s, count(*) as n from lg where band = {b}), e{i} as (select s[cast(floor(n * 0.02) as bigint) + 1] as lo{i}, s[cast(floor(n * 0.98) as bigint)] as hi{i} from q{i})\n"
    cols = ", ".join(f"{_byte(f'(sp[{b + 1}] - lo{i}) / (hi{i} - lo{i})')} as {c}" for i, (b, c) in enumerate(zip(bands, "rgb")))
    return out + f"select line, sample, {cols} from px, e0, e1, e2"


@query(_rgb_sql())
def render_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = tuple(_band_at(w) - 1 for w in (640, 550, 460))
    return render.render_rgb(cube(spark, sf_dir), bands).drop("cube_id")


@query(MASK + ", mm as (select distinct line, sample from roi), e as (select min(sp[31]) as lo, max(sp[31]) as hi from px join mm using (line, sample)),"
       " x as (select px.line, px.sample, mm.line is not null as inside, greatest(0.0, least(1.0, (sp[31] - lo) / (case when hi - lo <= 0 then 1e-6 else hi - lo end))) as t from px left join mm using (line, sample), e) select line, sample, "
       + ", ".join(f"case when inside then {_byte(x)} else cast(floor(t * 255 * 0.25) as integer) end as {c}" for c, x in _RAINBOW.items()) + " from x")
def masked_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.masked_render(cube(spark, sf_dir), 30, region_mask(spark, sf_dir)).drop("cube_id")


@query(MASK + ", mm as (select distinct line, sample from roi) select sample as at, cast(min(line) as integer) as first, cast(max(line) as integer) as last from mm group by sample")
def cube_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.extremes(region_mask(spark, sf_dir), "line").withColumnRenamed("sample", "at")


_JET = {c: f"1.5 - abs(2 * t - {m})" for c, m in (("r", 1.5), ("g", 1.0), ("b", 0.5))}


@query(MASK + """, mm as (select distinct line, sample from roi),
p as (select line, sample, 1.5 + sum(case when isfinite(v) and band < 60 then v * (band % 7 - 3) / 10 else 0 end) as v, max(v) filter (band = 0) as g from lv group by line, sample),
q as (select list_sort(list(v)) as s, count(*) as n from p join mm using (line, sample)), e as (select s[cast(floor(n * 0.02) as bigint) + 1] as lo, s[least(n, cast(floor(n * 0.98) as bigint) + 1)] as hi from q),
x as (select p.line, p.sample, mm.line is not null as inside, greatest(0.0, least(1.0, (v - lo) / (case when hi - lo <= 1e-4 then 1 else hi - lo end))) as t,
  case when isnan(g) then 0 else greatest(0.0, least(1.0, g)) end as g from p left join mm using (line, sample), e) select line, sample, """
       + ", ".join(f"case when inside then {_byte(x)} else cast(floor(g * 255 * 0.2) as integer) end as {c}" for c, x in _JET.items()) + " from x")
def prediction_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    predicted = decompose.predict(cube(spark, sf_dir, True), decompose.Pls(np.array(_COEF), 1.5))
    return render.prediction_render(predicted, region_mask(spark, sf_dir)).drop("cube_id")


@query(MASK + _LIMITS + """, mm as (select distinct line, sample from roi),
y as (select line, sample, case when not isfinite(v) then 0 else cast(floor(greatest(0, least(1, (v - lo) / (case when hi - lo <= 1e-5 then 1 else hi - lo end))) * 255) as integer) end as gray from lv, e where band = 20)
select y.line, y.sample, case when mm.line is null then gray else 0 end as r, case when mm.line is null then gray else 255 end as g, case when mm.line is null then gray else 0 end as b from y left join mm using (line, sample)""")
def mask_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.overlay(segment.to_8bit(cube(spark, sf_dir, True), 20), region_mask(spark, sf_dir)).drop("cube_id")


_TINT = {
    "r": "case when h < 1 then 1.0 when h < 2 then x when h < 4 then 0.0 when h < 5 then x else 1.0 end",
    "g": "case when h < 1 then x when h < 3 then 1.0 when h < 4 then x else 0.0 end",
    "b": "case when h < 2 then 0.0 when h < 3 then x when h < 5 then 1.0 else x end",
}
_FACES = " union all ".join(
    f"select '{face}' as face, lg.band, lg.{other} as \"at\", lg.v from lg join (select {other}, {f}({along}) as {along} from mm group by {other}) using (line, sample)"
    for face, along, other, f in (("top", "line", "sample", "min"), ("bottom", "line", "sample", "max"), ("left", "sample", "line", "min"), ("right", "sample", "line", "max"))
)


@query(MASK + f""", mm as (select distinct line, sample from roi), f as ({_FACES}),
h as (select *, (270 * (1 - band / 63.0::double)) / 60 as h, 0.25 + 0.75 * greatest(0.0, least(1.0, (v + 0.5::double) / 1.0)) as i from f),
x as (select *, 1 - abs(h % 2 - 1) as x from h)
select face, band, "at", """ + ", ".join(f"cast(floor(floor(({e}) * 255) * i) as integer) as {c}" for c, e in _TINT.items()) + " from x")
def cube_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.faces(cube(spark, sf_dir), region_mask(spark, sf_dir), -0.5, 0.5, BANDS)


@query(_rgb_sql().replace("select line, sample,", ", img as (select line, sample,", 1) + """) select cast(line // 2 as integer) as line, cast(sample // 2 as integer) as sample,
cast(floor(avg(r)) as integer) as r, cast(floor(avg(g)) as integer) as g, cast(floor(avg(b)) as integer) as b from img group by line // 2, sample // 2""")
def thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = tuple(_band_at(w) - 1 for w in (640, 550, 460))
    return render.thumbnail(render.render_rgb(cube(spark, sf_dir), bands), 2).drop("cube_id")


@query(f"""select {s6('min(v) - 0.05 * (max(v) - min(v))')} as lo, {s6('max(v) + 0.05 * (max(v) - min(v))')} as hi from (select v from lv where isfinite(v))""")
def joint_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.joint_range(to_long(cube(spark, sf_dir, True)), "value", 0.05).select(r6("lo", "lo"), r6("hi", "hi"))


@query("""select cast(arg_min(vec_id, struct_pack(d := sqrt((sp[1] - 0.05) * (sp[1] - 0.05) + (sp[2] + 0.02) * (sp[2] + 0.02)), i := vec_id)) as bigint) as id from px""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = virtual_cube(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("spectrum")[0].cast("double").alias("x"), F.col("spectrum")[1].cast("double").alias("y"))
    return stats.nearest_point(points, 0.05, -0.02, 10.0)


@query(f"""select band, {s6('avg(v) filter (label = 0)')} as a, {s6('avg(v) filter (label = 1)')} as b from lg group by band""")
def cube_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.mean_spectrum(virtual_cube(spark, sf_dir), ["label"])
    one = lambda k: means.where(F.col("label") == k).select(F.col("band").alias("wl"), F.col("mean").alias("value"))
    return stats.side_by_side(one(0), one(1)).select(F.col("wl").alias("band"), r6("a", "a"), r6("b", "b"))


# -- pipelines


def _batch_sql() -> str:
    sg = _savgol_sql(_SLOPE_15).replace(" from px, (", " from treated, (")
    return CALIBRATED.replace("from lv", "from lg") + """, ab as (select line, sample, band, -log10(greatest(v, 1e-4)) as v from cal),
mo as (select line, sample, avg(v) as m, stddev_pop(v) as s from ab group by all),
treated as (select line, sample, list((v - m) / (case when s < 1e-6 then 1 else s end) order by band) as sp from ab join mo using (line, sample) group by line, sample)
""" + sg


@query(_batch_sql())
def batch_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    h = size_of(pixels)
    o = BatchOptions(snv=True, savgol=True, segment=False)
    return long_result(pipelines.batch(pixels, h, o, pixels.where("line in (0, 1)"), pixels.where("line in (2, 3)")))


@query(_segment_sql().replace("select line, sample, label, area, format('Instancia_{:03d}', k) as name from l join z2 using (label)", f", f as (select label, line, sample from l join z2 using (label)) select f.label as roi_id, band, {s6('avg(v)')} as mean from f join lg using (line, sample) group by all"))
def segmented_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, morphology, labels and the segments' mean spectra, as a folder run does them for each cube."""
    pixels = cube(spark, sf_dir)
    p = SegmentationParams(threshold=110, invert=True, open_iterations=1, close_iterations=1, min_area=4, ignore_top=5)
    spectra, _ = pipelines.extract(pixels, size_of(pixels), BatchOptions(calibrate=False, absorbance=False, segment=True, segment_band=20, segmentation=p))
    return spectra.select(F.col("roi_id").cast("int").alias("roi_id"), F.posexplode("mean").alias("band", "m")).select("roi_id", "band", r6("m", "mean"))


def _scatter_sql(source: str) -> str:
    """MSC of ``source`` (line, sample, band, v) as ``out``."""
    return f""", me as (select band, avg(v) as m from {source} group by band), fit as (select line, sample, regr_slope(v, m) as sl, regr_intercept(v, m) as ic from {source} join me using (band) group by all),
out as (select line, sample, band, (v - ic) / sl as v from {source} join fit using (line, sample))"""


_ABSORBED = CALIBRATED.replace("from lv", "from lg") + ", ab as (select line, sample, band, -log10(greatest(v, 1e-4)) as v from cal)"
_STANDARD = _ABSORBED + ", mo as (select line, sample, avg(v) as m, stddev_pop(v) as s from ab group by all), sn as (select line, sample, band, (v - m) / (case when s < 1e-6 then 1 else s end) as v from ab join mo using (line, sample))"


def _pipeline(spark: SparkSession, sf_dir: str, run: Callable, **steps) -> DataFrame:
    pixels = cube(spark, sf_dir)
    return long_result(run(pixels, size_of(pixels), BatchOptions(segment=False, **steps), pixels.where("line in (0, 1)"), pixels.where("line in (2, 3)")))


@query(_ABSORBED + _scatter_sql("ab") + f" select line, sample, band, {s6('v')} as value from out")
def interactive_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSC where SNV isn't asked for."""
    return _pipeline(spark, sf_dir, pipelines.interactive, msc=True)


@query(_STANDARD + _scatter_sql("sn") + f" select line, sample, band, {s6('v')} as value from out")
def sequential_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNV and MSC both."""
    return _pipeline(spark, sf_dir, pipelines.sequential, snv=True, msc=True)


@query("select line, sample, band, case when v = 0 then '0' else printf('%.4e', v) end as text from lg")
def csv_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five significant digits as the CSV files have them, read back and written in one form."""
    text = sinks.general(F.col("value"), 5)
    again = F.regexp_replace(F.format_string("%.4e", text.cast("double")), "e([+-])([0-9])$", "e$10$2")
    cells = to_long(cube(spark, sf_dir)).select("line", "sample", "band", F.col("value").cast("double").alias("value"))
    return cells.select("line", "sample", "band", F.when(F.col("value") == 0, "0").otherwise(again).alias("text"))


@query(MASK + f""", s as (select line, sample, avg(v) as m, stddev_pop(v) as d from lg group by all)
select roi_id, band, {s6('avg(v)')} as original, {s6('avg((v - m) / d)')} as treated from lg join s using (line, sample) join roi using (line, sample) group by roi_id, band""")
def roi_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = cube(spark, sf_dir)
    out = pipelines.compare(pixels, preprocess.snv(pixels), region_mask(spark, sf_dir))
    return out.select("roi_id", "band", r6("original", "original"), r6("treated", "treated"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean SNV spectrum of each class."""
    pixels = virtual_cube(spark, sf_dir)
    treated = preprocess.snv(pixels.select("cube_id", "line", "sample", "spectrum", "label"))
    return stats.mean_spectrum(treated, ["label"]).select("label", "band", r6("mean", "mean"))


@query(SNV.replace("from lv", "from lg") + f"select label, band, {s6('avg((v - m) / s)')} as mean from lg join mo using (line, sample) group by label, band")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
