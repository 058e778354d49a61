"""Readers of text, CSV and XML observations, and of long grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing in the sources; null is missing here."""
    number = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in number else F.col(c) for c in df.columns])


def read_flask(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated flask data with '#' comments; rows without a time are dropped."""
    raw = spark.read.csv(path, sep=" ", comment="#", header=True, inferSchema=False)
    return raw.withColumn("datetime", F.try_to_timestamp("datetime").cast("timestamp_ntz")).filter("datetime IS NOT NULL")


def quality_flags(df: DataFrame, flags: tuple[str, ...] = (), col: str = "qcflag") -> DataFrame:
    return df.filter(F.col(col).isin("...", *flags))


def read_soundings(spark: SparkSession, folder: str, station: str, start=None, end=None, months: tuple[int, ...] | None = None) -> DataFrame:
    """Profiles from STA_YYYYmmddHH.csv; times lie in (start, end], in the given months; station and time come from the
    name."""
    raw = spark.read.option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).csv(f"{folder}/{station}_*.csv", header=True, inferSchema=False)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"([A-Z]+)_(\d{10})\.csv$", 2)
    time = F.try_to_timestamp(stem, F.lit("yyyyMMddHH")).cast("timestamp_ntz")
    values = [c for c in raw.columns if c.lower() not in ("station", "time")]
    out = raw.select(F.lit(station).alias("station"), time.alias("time"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in values])
    if start is not None:
        out = out.filter(F.col("time") > F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("time") <= F.lit(end).cast("timestamp_ntz"))
    if months is not None:
        out = out.filter(F.month("time").isin(*months))
    return nan_to_null(out)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Placemark").load(path)


def read_grid(spark: SparkSession, path: str, skip: Column | None = None, glob: str = "*.parquet", recursive: bool = False) -> DataFrame:
    """A long grid from Parquet files; skip is a condition on `file`."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return nan_to_null(df if skip is None else df.filter(~skip))


def sentinel(col: Column | str, value: float = -9999.0) -> Column:
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(value))


def decode_sodar(df: DataFrame, scales: DataFrame, variables: list[str]) -> DataFrame:
    """Epoch seconds to times, sentinels to null, variables by their scale from (SHORTNAME, MULT)."""
    mult = {r["SHORTNAME"]: r["MULT"] for r in scales.filter(F.col("SHORTNAME").isin(*variables)).collect()}  # one row a variable
    return df.select(F.timestamp_seconds("DATTIM").cast("timestamp_ntz").alias("ts"), *[c for c in df.columns if c not in ("DATTIM", *variables)], *[(sentinel(v) / F.lit(float(mult.get(v, 1)))).alias(v) for v in variables])


def component_time(parts: Column | str) -> Column:
    """A time from an array of year, month, day, hour, minute, second."""
    a = F.col(parts) if isinstance(parts, str) else parts
    return F.make_timestamp_ntz(*[F.element_at(a, i) for i in range(1, 7)])
