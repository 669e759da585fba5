"""Reading, landing and maintaining partitioned tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType() if n == "asset_id" else T.StringType()) for n in ("asset_id", "symbol", "market")]
    + [T.StructField("date", T.DateType())]
    + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "adj_close", "volume", "amount", "vwap")]
    + [T.StructField("adjusted", T.BooleanType())]
)


def read(spark: SparkSession, path: str | list[str], kind: str = "parquet", schema: T.StructType | None = None, recursive: bool = False) -> DataFrame:
    """Parquet, CSV (with header), JSON lines or ORC; a schema given is enforced, never inferred over."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE")
    return reader.format(kind).load(path)


def write(df: DataFrame, path: str, by: tuple[str, ...] = ("market", "year"), kind: str = "parquet") -> None:
    """Partitioned; only the partitions that the frame has are replaced."""
    if "year" in by and "year" not in df.columns:
        df = df.withColumn("year", F.year("date"))
    df.sortWithinPartitions(*[c for c in (*by, "asset_id", "date") if c in df.columns]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)


def scan(spark: SparkSession, path: str, market: str | None = None, start: date | None = None, end: date | None = None, columns: list[str] | None = None) -> DataFrame:
    """A bounded scan. The year predicate is derived from the dates, so that partitions are pruned."""
    df = spark.read.parquet(path)
    if market is not None:
        df = df.where(F.col("market") == market)
    if start is not None:
        df = df.where((F.col("date") >= F.lit(start)) & (F.col("year") >= start.year) if "year" in df.columns else F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where((F.col("date") <= F.lit(end)) & (F.col("year") <= end.year) if "year" in df.columns else F.col("date") <= F.lit(end))
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """The frame, materialised in the folder of spark.checkpoint.dir, for several readers; where none is set, each reader runs it again."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself; raises if a key repeats. One aggregate that stops at the first repeat."""
    if repeated_keys(df, keys).limit(1).count():
        raise ValueError(f"rows repeat by {', '.join(keys)}")
    return df


def stitch(segments: list[tuple[DataFrame, date | None, date | None]], keys: list[str]) -> DataFrame:
    """The union of date-bounded segments of several stores; they must not overlap by key."""
    out = None
    for df, start, end in segments:
        part = df.where((F.lit(start).isNull() | (F.col("date") >= F.lit(start))) & (F.lit(end).isNull() | (F.col("date") <= F.lit(end))))
        out = part if out is None else out.unionByName(part)
    return require_unique(out, keys)


def map_columns(raw: DataFrame, mapping: dict[str, tuple[str, str]], date_format: str = "yyyyMMdd") -> DataFrame:
    """Provider columns renamed and cast: target -> (source, type). Values that do not fit become NULL."""

    def one(source: str, kind: str) -> Column:
        if kind == "date":
            return F.to_date(F.try_to_timestamp(F.col(source).cast("string"), F.lit(date_format)))
        return F.expr(f"try_cast(`{source}` as {kind})")

    return raw.select(*[one(src, kind).alias(name) for name, (src, kind) in mapping.items()])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-insensitive hash of the content."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.expr("0").alias("zero"), F.bit_xor(row).alias("xor"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("sum")).drop("zero")


def keep_last(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: of equal keys the new row stays; within one side the later ``seq`` if there is one."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("__new")] + ([F.desc("seq")] if "seq" in both.columns else []) + [F.desc(F.xxhash64(*[c for c in both.columns if c != "__new"]))]
    return both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k", "__new")


def attach_adjusted(bars: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """adj_close = close * factor for all rows, or for none if any row lacks a factor or a factor repeats."""
    seen = factors.groupBy(*keys).agg(F.max("factor").alias("factor"), F.count(F.lit(1)).alias("times"))
    joined = bars.drop("adj_close", "adjusted").join(seen, keys, "left")
    audit = joined.agg(F.count_if(F.col("factor").isNull() | (F.col("times") > 1)).alias("bad"))
    good = F.col("bad") == 0
    return joined.crossJoin(F.broadcast(audit)).withColumns({"adj_close": F.when(good, F.col("close") * F.col("factor")).otherwise(F.col("close")), "adjusted": good}).drop("factor", "times", "bad")


def calendar_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sessions that only one of two calendars has."""
    left, right = a.select("date").distinct().withColumn("in_a", F.lit(True)), b.select("date").distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, "date", "full")
    return both.where("in_a is null or in_b is null").select("date", F.when(F.col("in_b").isNull(), "first").otherwise("second").alias("only_in"))


def missing_sessions(bars: DataFrame) -> DataFrame:
    """For every market, the sessions of the whole table's calendar that it lacks."""
    have = bars.select("market", "date").distinct()
    return have.select("market").distinct().crossJoin(have.select("date").distinct()).join(have, ["market", "date"], "left_anti")


def available_from(rows: DataFrame, calendar: DataFrame, on: str) -> DataFrame:
    """Rows with ``available_date``: the next session after theirs. The calendar is small and joined by date."""
    days = calendar.select("date").distinct()
    following = days.select(F.col("date").alias(on), F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("available_date"))
    return rows.join(following, on, "left")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes per file of a store."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
