"""File names, addresses and catalogues of the data sets, as Column expressions and small helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sector_name(name: Column | str) -> Column:
    """White space, '(', '&' and '-' to '_'; ')' and ',' dropped."""
    return F.translate(F.regexp_replace(_c(name), r"[\s(&-]", "_"), "),", "")


def flux_file_parts(file: Column | str) -> tuple[Column, Column]:
    """(year, sector) of ..._2012_ENE.0.1x0.1.nc; null for other names."""
    pattern = r"_(\d{4})_(\w+)\.0\.1x0\.1\.nc$"
    part = lambda i: F.when(_c(file).rlike(pattern), F.regexp_extract(_c(file), pattern, i))
    return part(1).cast("int"), part(2)


def inventory_variable(name: Column | str) -> tuple[Column, Column]:
    """(IPCC code, short name) of emi_ch4_Supp_1B2a_Name or emissions_1A_Name; null for other names."""
    pattern = r"^(?:emi_ch4|emissions)(?:_Supp)?_([0-9][0-9A-Za-z]*)_(\w+)$"
    part = lambda i: F.when(_c(name).rlike(pattern), F.regexp_extract(_c(name), pattern, i))
    return part(1), part(2)


def long_name_variable(name: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_c(name), F.lit(" "), F.lit("_")), F.lit(","), F.lit("")), F.lit("-"), F.lit("_"))


def factor_variable(name: Column | str) -> Column:
    """What follows the first four '_' tokens."""
    parts = F.split(_c(name), "_")
    return F.array_join(F.slice(parts, F.lit(5), F.greatest(F.lit(0), F.size(parts) - 4)), "_")


def last_token_in(stem: Column | str, tokens: tuple[str, ...]) -> Column:
    return F.element_at(F.split(_c(stem), "_"), -1).isin(*tokens)


def zarr_address(run_hour: Column | str, level_type: str, level: Column | str, variable: Column | str, model_type: str, chunk: Column | str) -> Column:
    """Address of one chunk; forecasts have a leading time chunk."""
    t, lead = _c(run_hour), "0." if model_type == "fcst" else ""
    hour = F.concat(F.date_format(t, "yyyyMMdd"), F.lit("/"), F.date_format(t, "yyyyMMdd_HH"), F.lit(f"z_{model_type}.zarr"))
    return F.concat(F.lit(level_type + "/"), hour, F.lit("/"), _c(level), F.lit("/"), _c(variable), F.lit("/"), _c(level), F.lit("/"), _c(variable), F.lit("/" + lead), _c(chunk))


def zarr_requests(times: DataFrame, variables: list[tuple[str, str]]) -> DataFrame:
    """One row for each time, level and variable (the list of variables is fixed and small)."""
    v = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("variable")) for a, b in variables]))
    return times.withColumn("v", v).select(*times.columns, "v.level", "v.variable")


def sounding_dates(spark: SparkSession, start: dt.datetime, end: dt.datetime, months: tuple[int, ...] | None = None) -> DataFrame:
    """12-hourly times from start to end, of the given months."""
    all_times = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 12 HOURS"))).alias("time"))
    return all_times.filter(F.month("time").isin(*months)) if months else all_times


def flux_file_name(template: str, **parts: str) -> str:
    return template.format(**parts)


def standard_name(time_step: Column | str, pollutant: Column | str) -> Column:
    return F.concat(F.lower(_c(time_step)), F.lit("_"), _c(pollutant), F.lit("_emissions"))


# Marks of the estimates in file names.
ESTIMATES = {"central": "mn", "lower": "lo", "upper": "hi"}


def estimate_file(file: Column | str, estimate: str = "central", region: str = "US") -> Column:
    """Whether a file holds this estimate of the region's sectors (not the total); the mark ends the name or its first part."""
    name = F.substring_index(_c(file), "/", -1)
    return name.rlike(ESTIMATES[estimate] + r"(\.[^.]*\.[^.]*)?\.nc4$") & ~name.contains("total") & name.contains(region)
