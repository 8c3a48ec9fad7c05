"""Readers and writers: raw CSV tables, the processed panel per split, and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallycast.functions.names import EVENT_COLUMNS, ID_COLUMNS, SNAP_COLUMNS

CALENDAR_SCHEMA = T.StructType(
    [T.StructField("d", T.StringType()), T.StructField("date", T.DateType()), T.StructField("wm_yr_wk", T.IntegerType())]
    + [T.StructField("weekday", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("wday", "month", "year")]
    + [T.StructField(c, T.StringType()) for c in EVENT_COLUMNS]
    + [T.StructField(c, T.IntegerType()) for c in SNAP_COLUMNS]
)
PRICE_SCHEMA = T.StructType(
    [
        T.StructField("store_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("wm_yr_wk", T.IntegerType()),
        T.StructField("sell_price", T.DoubleType()),
    ]
)
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("origin", T.LongType()),
        T.StructField("segment", T.StringType()),
        T.StructField("n_series", T.LongType()),
        T.StructField("wql", T.DoubleType()),
        T.StructField("mase", T.DoubleType()),
    ]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def require(spark: SparkSession, path: str) -> str:
    """Fail early with a hint when an earlier step has not written its table yet."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run the step that writes it first")
    return path


def _scan_csv(spark: SparkSession, path: str, type_of) -> DataFrame:
    """Read a CSV in the column order of its own header, each column with the type its name calls for.

    Only the header line is read up front; nothing is inferred from the data.
    """
    header = spark.read.text(require(spark, path)).first()[0].split(",")
    schema = T.StructType([T.StructField(c, type_of(c)) for c in header])
    # The CSV parser stops at 20480 columns by default; a table with more days still has to load.
    return spark.read.schema(schema).option("maxColumns", max(20480, 2 * len(header))).csv(path, header=True)


def _types_in(schema: T.StructType):
    types = {f.name: f.dataType for f in schema}
    return lambda name: types.get(name, T.StringType())


def scan_sales_wide(spark: SparkSession, path: str) -> DataFrame:
    """The wide sales CSV: day columns are int, the rest string."""
    return _scan_csv(spark, path, lambda c: T.IntegerType() if c.startswith("d_") else T.StringType())


def scan_calendar(spark: SparkSession, path: str) -> DataFrame:
    return _scan_csv(spark, path, _types_in(CALENDAR_SCHEMA))


def scan_prices(spark: SparkSession, path: str) -> DataFrame:
    return _scan_csv(spark, path, _types_in(PRICE_SCHEMA))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Write a CSV table. ``single_file`` is for report tables of a few rows."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_report(spark: SparkSession, path: str, schema: T.StructType = RESULT_SCHEMA) -> DataFrame:
    return _scan_csv(spark, path, _types_in(schema)).select(*schema.names)


def write_splits(panel: DataFrame, path: str) -> str:
    """One folder per split. Clustering by id first keeps the number of files at tasks x splits."""
    (
        panel.repartition("id")
        .sortWithinPartitions("split", "id", "d_num")
        .write.mode("overwrite")
        .partitionBy("split")
        .parquet(path)
    )
    return path


def write_panel_table(panel: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The processed panel as an external table bucketed by id and partitioned by split.

    Windows, group-bys and joins on ``id`` over this table need no exchange.
    """
    (
        panel.repartition(buckets, "id")
        .sortWithinPartitions("split", "id", "d_num")
        .write.mode("overwrite")
        .partitionBy("split")
        .bucketBy(buckets, "id")
        .sortBy("id", "d_num")
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )
    return panel.sparkSession.table(table)


def bucket_count(series: int, days: int, rows_per_bucket: int = 2_000_000) -> int:
    """Buckets of about the given number of rows, so their size does not grow with the panel; at least eight."""
    return max(8, -(-series * days // rows_per_bucket))


def load_panel(
    source: DataFrame, splits: tuple[str, ...] = ("train", "val"), columns: list[str] | None = None
) -> DataFrame:
    """Rows of the given splits: the filter prunes partitions and the projection prunes columns."""
    kept = source.where(F.col("split").isin(*splits))
    return kept.select(*columns) if columns else kept


def split_profile(panel: DataFrame) -> DataFrame:
    """Rows, first and last day and number of series per split, in one pass over (split, id) sums."""
    per_series = panel.groupBy("split", "id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("d_num").alias("lo"), F.max("d_num").alias("hi")
    )
    return per_series.groupBy("split").agg(
        F.sum("rows").alias("rows"),
        F.min("lo").alias("min_day"),
        F.max("hi").alias("max_day"),
        F.count(F.lit(1)).alias("n_series"),
    )


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def series_sketches(panel: DataFrame, days_per_part: int = 365) -> DataFrame:
    """``[split, part, rows, min_day, max_day, series]``: per split and range of days the additive profile and a sketch of the series in it.

    Stored, these rows profile any later union of parts without reading the panel again.
    """
    part = F.floor(F.col("d_num") / days_per_part).cast("int").alias("part")
    return panel.groupBy("split", part).agg(
        F.count(F.lit(1)).alias("rows"), F.min("d_num").alias("min_day"), F.max("d_num").alias("max_day"), F.hll_sketch_agg("id", 14).alias("series"))


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """The profile of :func:`split_profile` with the number of series estimated from the merged sketches (about 1 % off at any number)."""
    merged = sketches.groupBy("split").agg(
        F.sum("rows").alias("rows"), F.min("min_day").alias("min_day"), F.max("max_day").alias("max_day"), F.hll_union_agg("series").alias("series"))
    return merged.select("split", "rows", "min_day", "max_day", F.hll_sketch_estimate("series").alias("n_series"))
