"""Reading and writing bars, data sets, scalers and metrics (O-01 .. O-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ["open", "high", "low", "close", "volume"]
MILLIS_FROM = 1e12  # an epoch column whose maximum is above counts milliseconds


def read_ohlcv(spark: SparkSession, path: str, symbol: str = "ALL") -> DataFrame:
    """Bars from CSV with a header in any case: symbol, bar_ts, open .. volume. Rows whose timestamp is not a number
    are left out; other values that are no numbers become null."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    require_columns(raw, ["timestamp", *OHLCV])
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    bars = raw.select(number("timestamp").alias("bar_ts"), *[F.nanvl(number(c), F.lit(None)).alias(c) for c in OHLCV])
    bars = normalize_epoch(bars.filter(F.col("bar_ts").isNotNull() & ~F.isnan("bar_ts")), "bar_ts")
    return bars.select(F.lit(symbol).alias("symbol"), "bar_ts", *OHLCV)


def normalize_epoch(df: DataFrame, col: str) -> DataFrame:
    """Epoch numbers to UTC timestamps; the whole column is milliseconds if its maximum is above MILLIS_FROM."""
    top = df.agg(F.max(col)).first()[0]
    scale = 1000 if top is not None and top > MILLIS_FROM else 1
    micros = (F.col(col).cast("decimal(30,6)") * (1_000_000 // scale)).cast("long")
    return df.withColumn(col, F.timestamp_micros(micros).cast("timestamp_ntz"))


def date_range(df: DataFrame, start: str, end: str, ts: str = "bar_ts", must_exist: bool = True) -> DataFrame:
    """Rows from start to end, both included; an end given as a date is the midnight at which that day begins."""
    kind = df.schema[ts].dataType.simpleString()
    out = df.filter(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    if must_exist and out.isEmpty():
        raise ValueError(f"no rows from {start} to {end}")
    return out


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rounded(df: DataFrame, decimals: int = 5) -> DataFrame:
    """Fractional columns rounded half to even."""
    return df.select([F.bround(c, decimals).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in df.columns])


def write_dataset(df: DataFrame, path: str, decimals: int = 5) -> None:
    """Parquet under path/parquet and CSV under path/csv, rounded."""
    out = rounded(df, decimals)
    out.write.mode("overwrite").parquet(f"{path}/parquet")
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """df itself; an error names the columns that are missing. Reads no data."""
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_metrics(tables: dict[str, DataFrame], path: str) -> None:
    """Each table (scalars, per-class, report, matrix) as JSON lines under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_metrics(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of write_metrics()."""
    return spark.read.json(f"{path}/{name}")


def read_dataset_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The CSV side of write_dataset(), whose columns have the types of schema."""
    return spark.read.option("header", True).schema(schema).csv(f"{path}/csv")
