"""Readers of landed files: airport CSV, station JSON, wide gauge CSV, link and gauge metadata, equation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions import expressions as x
from pluvia.functions.schemas import ASOS_METRIC, ASOS_RAW, OBSERVATION, RAW_NAMES, SIMPLE_NAMES, STATION_ORDER, conform
from pluvia.operators.joins import union_all
from pluvia.operators.timeseries import dedupe_first, last_days


#: Where a landed row stood: what "first" means among repeated rows, however files are packed into tasks.
_PLACE = [T.StructField("__file", T.StringType()), T.StructField("__part", T.LongType())]


def asos_csv(spark: SparkSession, path: str) -> DataFrame:
    """1-minute CSV as strings, whatever columns a file has, with each row's place (file name, offset of the part, row); then asos_metric()."""
    got = spark.read.option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__part"))
    return conform(got, T.StructType([*ASOS_RAW.fields, *_PLACE])).withColumn("__row", F.monotonically_increasing_id())


def asos_metric(raw: DataFrame, station: str | None = None) -> DataFrame:
    """Metric columns: °C, m/s, mm; unreadable numbers null; of repeated (station, time) the first row stays, by place in the files (else by content).

    One projection and one partial aggregation, all stations at once. station: its id where the file has none.
    """
    n = lambda c: x.parse_number(F.col(c))
    place = [c for c in ("__file", "__part", "__row") if c in raw.columns]
    raw = raw if place else conform(raw, ASOS_RAW)
    got = raw.select(
        F.struct(*(place or [F.col(f"`{f.name}`") for f in ASOS_RAW.fields])).alias("__n"),
        F.try_to_timestamp(F.col("`valid(UTC)`")).alias("datetime"), (F.col("station") if station is None else F.lit(station)).alias("station_id"),
        x.fahrenheit_to_celsius(n("tmpf")).alias("temp_c"), x.fahrenheit_to_celsius(n("dwpf")).alias("dewpoint_c"), x.knots_to_ms(n("sknt")).alias("wind_speed_ms"), n("drct").alias("wind_dir_deg"),
        x.knots_to_ms(n("gust_sknt")).alias("wind_gust_ms"), n("gust_drct").alias("wind_gust_dir_deg"), x.null_text(F.col("ptype")).alias("precip_type"), x.precip_category(F.col("ptype")).alias("precip_category"), x.inches_to_mm(n("precip")).alias("precip_mm"),
    ).where("datetime IS NOT NULL")
    return dedupe_first(got, ["station_id", "datetime"], ["__n"]).select(*[f.name for f in ASOS_METRIC.fields])


def observations_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row an observation of payloads with `observations` or `summaries`: every field that they have, structs as dotted names (metric.<name>).

    Known fields that no payload has are null. Names and types come from a first pass over the payloads, so current conditions, whose
    fields differ from those of a history, lose nothing.
    """
    return observations(payloads(spark, path, lines))


def payloads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed payloads as they are, a row each: a file each, or (lines) a line each, which Spark can split."""
    return spark.read.option("multiLine", not lines).json(path)


def observations(payloads: DataFrame, first: int | None = None) -> DataFrame:
    """See observations_json(). first: so many of a payload's observations or (daily) summaries alone. A payload without any has no rows."""
    lists = [F.col(c) for c in ("observations", "summaries") if c in payloads.columns and isinstance(payloads.schema[c].dataType, T.ArrayType)]
    known = [(f"metric.{g.name}", g.dataType) for g in OBSERVATION["metric"].dataType.fields]
    known = [(f.name, f.dataType) for f in OBSERVATION.fields if f.name != "metric"] + known
    if not lists:
        return payloads.sparkSession.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in known]))
    lists = [F.to_json(x) for x in lists] if len(lists) > 1 else lists
    if len(lists) > 1:  # their fields differ: read as one kind
        both = [payloads.schema[c].dataType.elementType for c in ("observations", "summaries")]
        kind = T.ArrayType(T.StructType([*both[0].fields, *[f for f in both[1].fields if f.name not in both[0].names]]))
        rows = F.from_json(F.coalesce(F.when(lists[0] != "[]", lists[0]), lists[1]), kind)
    else:
        rows = lists[0]
    flat = flatten(payloads.select(F.explode(rows if first is None else x.first_n(rows, first)).alias("o")).select("o.*"))
    kinds = dict(known)
    return flat.select(
        *[(F.col(f"`{n}`").try_cast(t) if n in flat.columns else F.lit(None).cast(t)).alias(n) for n, t in known], *[F.col(f"`{c}`") for c in flat.columns if c not in kinds]
    )


def has_observations(payloads: DataFrame) -> DataFrame:
    """found: whether a payload has any observation."""
    there = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("observations", "summaries") if c in payloads.columns]
    return payloads.withColumn("found", F.greatest(F.lit(False), F.lit(False), *there))


def flatten(df: DataFrame) -> DataFrame:
    """Fields of structs as columns with dotted names, at any depth; arrays stay."""

    def leaves(c: F.Column, kind: T.DataType, name: str) -> list:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(c.getField(f.name), f.dataType, f"{name}.{f.name}")]
        return [c.alias(name)]

    return df.select(*[x for f in df.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])


def product_bundle(products: dict[str, DataFrame], end: str, hourly: str = "hourly", ts: str = "ts", days: int = 7) -> DataFrame:
    """All products as rows with a product column; the hourly one is clipped to the `days` days before end."""
    parts = [(last_days(df, ts, end, days) if name == hourly else df).withColumn("product", F.lit(name)) for name, df in products.items()]
    return union_all(*parts)


def simple_names(df: DataFrame, keep_original: bool = False) -> DataFrame:
    """Canonical names in canonical order, other columns after them; keep_original: <name>_orig, last."""
    known = [s for s in STATION_ORDER if RAW_NAMES[s] in df.columns]
    extra = [c for c in df.columns if c not in SIMPLE_NAMES]
    return df.select(*[F.col(f"`{RAW_NAMES[s]}`").alias(s) for s in known], *[F.col(f"`{c}`") for c in extra], *[F.col(f"`{RAW_NAMES[s]}`").alias(f"{s}_orig") for s in known if keep_original])


def original_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({s: r for s, r in RAW_NAMES.items() if s in df.columns})


def station_times(df: DataFrame) -> DataFrame:
    """time_utc as timestamp, time_local without zone; both from the first 19 characters."""
    return df.withColumns({"time_utc": F.try_to_timestamp(F.replace(F.substring("time_utc", 1, 19), F.lit("T"), F.lit(" "))), "time_local": F.to_timestamp_ntz(F.replace(F.substring("time_local", 1, 19), F.lit("T"), F.lit(" ")))})


def hourly_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive range of the local time's first 19 characters."""
    t = F.to_timestamp_ntz(F.replace(F.substring("obsTimeLocal", 1, 19), F.lit("T"), F.lit(" ")))
    return df.where(t.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def wide_gauges(spark: SparkSession, path: str, interval_s: int = 60, time: str = "Time_UTC") -> DataFrame:
    """A column a gauge, stamped with the end of its interval -> gauge, ts (its start), rain_mm; <gauge>_QC becomes qc."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    gauges = [c for c in raw.columns if c != time and not c.endswith("_QC")]
    short = {c: c.rsplit("_", 1)[0] if f"{c.rsplit('_', 1)[0]}_QC" in raw.columns else c for c in gauges}
    rows = F.array(*[F.struct(F.lit(short[c]).alias("gauge"), x.parse_number(F.col(f"`{c}`")).alias("rain_mm"), (F.col(f"`{short[c]}_QC`") if f"{short[c]}_QC" in raw.columns else F.lit(None).cast("string")).alias("qc")) for c in gauges])
    start = F.try_to_timestamp(F.col(f"`{time}`")) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(interval_s))
    return raw.select(start.alias("ts"), F.inline(rows)).select("gauge", "ts", "rain_mm", "qc")


def metadata_csv(spark: SparkSession, path: str, first: str | None = None) -> DataFrame:
    """A dimension: byte-order mark and unnamed index columns gone; first: name of the first column."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if first:
        names[0] = first
    df = df.toDF(*names)
    return df.drop(*[c for c in names if c.startswith("Unnamed") or c in ("", "_c0")])


def link_metadata(df: DataFrame, frequency: str, length: str, mhz: bool, metres: bool) -> DataFrame:
    """frequency_ghz and length_km beside the given columns."""
    return df.withColumns({"frequency_ghz": F.col(frequency) / (1000 if mhz else 1), "length_km": F.col(length) / (1000 if metres else 1)})


def equation_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Complexity int, Loss double, Equation string").csv(path).toDF("complexity", "loss", "equation")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of files below a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
