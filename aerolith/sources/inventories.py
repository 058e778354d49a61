"""Emission inventories as long tables (time, lat, lon, sector, value): one loader, a row of settings for each product.

The loader takes rows as they come from the files: `file` (name), lat, lon, value, and what the product's rules need
(variable, long_name, year, time, time_index, model). A null lat, lon or value stays null; an empty table stays empty;
further columns stay as they are. Every step is a projection or a filter, so that nothing is shuffled on loading.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, physics, projections, timeops
from ..operators import aggregates, grid
from . import names, readers

Hook = Callable[[DataFrame], DataFrame]
STANDARD_UNITS = "kg km-2 d-1"


@dataclass(frozen=True)
class Product:
    """sector and time name the rules below; drop: sectors that are sums of others; digits: of lat and lon."""

    units: str
    sector: str
    time: str
    time_step: str = "annual"
    pollutant: str = "CH4"
    drop: tuple[str, ...] = ()
    digits: int | None = None
    wrap: bool = False
    skip: tuple[str, ...] = ()
    prefix: str = ""
    year: int | None = None


# Units, prefixes, sums and rounding of the products.
PRODUCTS = {
    "edgar-v7": Product("kg m-2 s-1", "flux_file", "flux_file", digits=2, wrap=True, skip=("TOTALS",)),
    "edgar-v8": Product("kg m-2 s-1", "long_name", "year", drop=("Fuel_exploitation",), skip=("TOTALS",)),
    "edgar-v8-monthly": Product("kg m-2 s-1", "long_name", "month", "monthly", drop=("Fuel_exploitation",), skip=("TOTALS",)),
    "epa-v1": Product("molec cm-2 s-1", "epa", "of_year", drop=("grid_cell_area",), digits=2, prefix="emissions", year=2012),
    "epa-v1-monthly": Product("molec cm-2 s-1", "epa", "of_year", "monthly", drop=("grid_cell_area",), digits=2, prefix="emissions", year=2012),
    "epa-v1-daily": Product("molec cm-2 s-1", "epa", "of_year", "daily", drop=("grid_cell_area",), digits=2, prefix="emissions", year=2012),
    "epa-v2": Product("molec cm-2 s-1", "epa", "year_of_time", drop=("grid_cell_area",), digits=2, prefix="emi_ch4"),
    "gfei-v1": Product("Mg km-2 a-1", "after_prefix", "year", drop=("Total_Fuel_Exploitation",), digits=2, skip=("_All.", "_gsd.", "_rsd."), prefix="Global_Fuel_Exploitation_Inventory"),
    "gfei-v2": Product("Mg km-2 a-1", "after_prefix", "year", drop=("Total_Fuel_Exploitation",), digits=2, skip=("_All.", "_gsd.", "_rsd."), prefix="Global_Fuel_Exploitation_Inventory_v2"),
    "vulcan": Product("Mg km-2 a-1", "token_5:_", "year_of_time", pollutant="CO2", skip=("total",)),
    "vulcan-hourly": Product("Mg km-2 hr-1", "token_5:.", "as_is", "hourly", pollutant="CO2", skip=("total",)),
    "wetcharts": Product("mg m-2 d-1", "wetlands", "month", "monthly"),
}
#: lower and upper bounds of a confidence interval, and standard deviations, lie in files of their own
DEVIATIONS = {"relative": "rsd", "geometric": "gsd"}
#: sectors whose monthly factors hold in later years, too
SCALABLE = ("Manure_Management", "Rice_Cultivation", "Field_Burning")
#: projections of the annual and hourly CO2 product and of the forecast fields
PROJECTIONS = {"epsg:4326": None, "co2_lambert": geo.Lambert(33.0, 45.0, 40.0, -97.0, 1000 * geo.WGS84_A, geo.WGS84_E), "forecast_lambert": geo.Lambert()}


def projection(name: str | int) -> geo.Lambert | None:
    """The projection of a name, an EPSG number, or proj4 or WKT text; None for plain latitudes and longitudes."""
    if isinstance(name, str) and ("+proj" in name or "[" in name):
        return projections.from_text(name)
    key = f"epsg:{name}" if isinstance(name, int) else name.lower()
    if key not in PROJECTIONS:
        raise ValueError(f"unknown projection {name!r}; known: {sorted(PROJECTIONS)}")
    return PROJECTIONS[key]


def _sector(p: Product) -> Column:
    match p.sector.split(":", 1):
        case ["flux_file"]:
            return names.flux_file_parts("file")[1]
        case ["long_name"]:
            return names.long_name_variable("long_name")
        case ["epa"]:
            found = F.when(F.col("variable").startswith(p.prefix), names.inventory_variable("variable")[1])
            return F.coalesce(found, F.col("variable"))
        case ["after_prefix"]:
            return F.substring_index(F.regexp_replace("file", "^.*?" + p.prefix + "_", ""), ".nc", 1)
        case ["token_5", sep]:
            return F.get(F.split("file", "[.]" if sep == "." else sep), F.lit(5))
        case ["wetlands"]:
            return F.lit("wetlands")
    raise ValueError(f"unknown sector rule {p.sector}")


def _time(p: Product) -> Column:
    start = lambda y: F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if p.time == "flux_file":
        return start(names.flux_file_parts("file")[0])
    if p.time == "year":
        return start(F.col("year").cast("int"))
    if p.time == "year_of_time":
        return F.date_trunc("year", "time").cast("timestamp_ntz")
    if p.time == "month":
        return F.date_trunc("month", "time").cast("timestamp_ntz")
    if p.time == "as_is":
        return F.col("time")
    if p.time == "of_year":
        first, i = start(F.lit(p.year)), F.col("time_index").cast("int")
        if p.time_step == "annual":
            return first
        if p.time_step == "monthly":
            return first + F.make_ym_interval(F.lit(0), i)
        if p.time_step == "daily":
            return first + F.make_dt_interval(i)
    raise ValueError(f"time step {p.time_step} not supported")


def product(name: str, **changes) -> Product:
    """The settings of a product, with some changed; names that aren't there are an error."""
    if name not in PRODUCTS:
        raise ValueError(f"unknown product {name!r}; known: {sorted(PRODUCTS)}")
    return replace(PRODUCTS[name], **changes)


def process(raw: DataFrame, p: Product, before: Sequence[Hook] = (), after: Sequence[Hook] = (), standardize: bool = False) -> DataFrame:
    """Rows of the files as (time, lat, lon, sector, value, further columns). Files and sectors that are sums go; so do
    rows whose file name says nothing of a sector. Hooks take and return a DataFrame, before and after these rules."""
    for hook in before:
        raw = hook(raw)
    if p.skip:
        raw = raw.filter(~F.coalesce(F.concat(*[F.when(F.col("file").contains(s), "x").otherwise("") for s in p.skip]) != "", F.lit(False)))
    used = {"time", "lat", "lon", "value", "variable", "long_name", "year", "time_index", "sector"}
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in used]
    code = [names.inventory_variable("variable")[0].alias("ipcc_code")] if p.sector == "epa" and "ipcc_code" not in raw.columns else []
    out = raw.select(_time(p).alias("time"), "lat", "lon", _sector(p).alias("sector"), "value", *code, *rest).filter("sector IS NOT NULL")
    out = grid.without_sectors(out, list(p.drop))
    if p.wrap:
        out = out.withColumn("lon", geo.wrap_lon("lon"))
    if p.digits is not None:
        out = grid.round_positions(out, p.digits, p.digits)
    out = with_units(out, p.units)
    for hook in after:
        out = hook(out)
    return convert(out, STANDARD_UNITS, p.pollutant) if standardize else out


def load(spark: SparkSession, path: str, p: Product, before: Sequence[Hook] = (), after: Sequence[Hook] = (), standardize: bool = False, recursive: bool = True) -> DataFrame:
    """A product from a folder of Parquet files (one long table each)."""
    if not p.units:
        raise ValueError("the product has no units")
    return process(readers.read_grid(spark, path, recursive=recursive), p, before, after, standardize)


def with_units(df: DataFrame, units: str, col: str = "value") -> DataFrame:
    """The same rows; the units are kept in the column's metadata."""
    physics.flux_factor(units, units)  # an unknown unit is an error now, not in a job
    return df.withMetadata(col, {**df.schema[col].metadata, "units": units})


def units_of(df: DataFrame, col: str = "value") -> str:
    units = df.schema[col].metadata.get("units")
    if units is None:
        raise ValueError(f"column {col} has no units")
    return units


def without_units(df: DataFrame, col: str = "value") -> DataFrame:
    return df.withMetadata(col, {k: v for k, v in df.schema[col].metadata.items() if k != "units"})


def convert(df: DataFrame, units: str, pollutant: str | None = None, col: str = "value") -> DataFrame:
    """Values in other units, which become the column's."""
    factor = physics.flux_factor(units_of(df, col), units, pollutant)
    return with_units(df.withColumn(col, F.col(col) * factor), units, col)


def deviations(raw: DataFrame, kind: str, p: Product) -> DataFrame:
    """Relative or geometric standard deviations by sector; files of all sectors together are left out."""
    mark = DEVIATIONS[kind]
    of_kind = raw.filter(F.col("file").endswith(f"{mark}.nc") & ~F.col("file").contains("All"))
    out = process(of_kind, replace(p, skip=(), drop=()))
    return out.withColumn("sector", F.regexp_replace("sector", f"_{mark}$", ""))


def estimate(raw: DataFrame, kind: str = "central", region: str = "US", p: Product = PRODUCTS["vulcan"]) -> DataFrame:
    """The central, lower or upper estimate of a region; bounds are given by the year only."""
    if region == "AK":
        raise ValueError("the region crosses the 180th meridian")
    if kind != "central" and p.time_step != "annual":
        raise ValueError("bounds are there for annual data only")
    return process(raw.filter(names.estimate_file("file", kind, region)), replace(p, skip=()))


def one_model(raw: DataFrame, model: str = "mean", p: Product = PRODUCTS["wetcharts"]) -> DataFrame:
    """Monthly wetland fluxes: mean or median over the models, or one of them."""
    return with_units(aggregates.ensemble(process(raw, p), ["time", "lat", "lon", "sector"], model=model), p.units)


def express_monthly(annual: DataFrame, factors: DataFrame, until: int, last_year: int = 2018) -> DataFrame:
    """Monthly values: factors of their own year, and for some sectors those of last_year again in each later year."""
    cells = ("lat", "lon", "sector")
    own = grid.scale_by_month(annual, factors, cells)
    later = grid.replicate_factors(factors.filter(F.col("sector").isin(*SCALABLE)), last_year, until).filter(F.year("time") > last_year)
    return grid.combine_first(own, grid.scale_by_month(annual, later, cells), ["time", *cells])


def at_time(df: DataFrame, time: str | int = "mean", coords: Sequence[str] = ("lat", "lon", "sector")) -> DataFrame:
    """The mean over the times, the i-th time (from 0, negative from the end), or the times of a label ('2018', '2018-03')."""
    if time == "mean":
        return df.groupBy(*coords).agg(F.avg("value").alias("value"))
    if isinstance(time, int):
        some = df.select("time").distinct().orderBy(F.col("time") if time >= 0 else F.desc("time"))
        at = some.offset(time if time >= 0 else -time - 1).limit(1)
        return df.join(F.broadcast(at), "time", "left_semi")  # one row
    span = timeops.TimeRange.of(time)
    of_label = F.col("time") < F.lit(span.stop).cast("timestamp_ntz") if span.stop > span.start else F.lit(True)
    return df.filter((F.col("time") == F.lit(span.start).cast("timestamp_ntz")) | (span.condition("time") & of_label))


def reproject(df: DataFrame, p: geo.Lambert | None, resolution: float, coords: Sequence[str] = ("time", "sector"), x: str = "x", y: str = "y") -> DataFrame:
    """Means of the projected cells whose centres lie in each square cell of latitude and longitude.

    Cells that no centre meets have no row: choose a resolution that isn't finer than the projected cells. Only for
    projected tables; clip first, as every cell is turned back.
    """
    if p is None:
        raise ValueError("the table has latitudes and longitudes already")
    lat, lon = p.inverse(x, y)
    centre = lambda c: F.round((F.floor(c / resolution) + 0.5) * resolution, grid.decimals(resolution))
    cell = df.select(*coords, centre(lat).alias("lat"), centre(lon).alias("lon"), "value")
    return cell.groupBy(*coords, "lat", "lon").agg(F.avg("value").alias("value"))


def sodar_at_height(df: DataFrame, height: float, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Wind at a height: its level is looked up in the first profile of each key (the least such level); rows without
    direction and speed are left out; keys whose first profile lacks the height have no rows."""
    first = df.groupBy(*keys).agg(F.min("ts").alias("ts"))
    level = df.filter(F.col("HEIGHT") == height).join(first, [*keys, "ts"], "left_semi").groupBy(*keys).agg(F.min("level").alias("level"))
    out = df.join(level, [*keys, "level"], "left_semi").select(*keys, "ts", F.col("WD").alias("direction"), F.col("WS").alias("speed"))
    return out.filter("direction IS NOT NULL OR speed IS NOT NULL")


def merge_profiles(parts: Sequence[DataFrame], start=None, stop=None, keys: Sequence[str] = ("ts", "level")) -> DataFrame:
    """Tables of the same keys and different (or equal) variables as one, both ends of the times included.

    A value comes from whichever part has it; where parts differ, the largest is taken.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    if start is not None:
        every = every.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        every = every.filter(F.col("ts") <= F.lit(stop).cast("timestamp_ntz"))
    return every.groupBy(*keys).agg(*[F.max(c).alias(c) for c in every.columns if c not in keys])


def product_path(root: str, version: str, time_step: Column | str, pollutant: Column | str) -> Column:
    """root/version/pollutant for annual files, root/version/step/pollutant else."""
    step = F.col(time_step) if isinstance(time_step, str) else time_step
    return F.concat(F.lit(f"{root}/{version}/"), F.when(step == "annual", "").otherwise(F.concat(step, F.lit("/"))), F.col(pollutant) if isinstance(pollutant, str) else pollutant)
