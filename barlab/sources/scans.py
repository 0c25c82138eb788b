"""Typed scans of bar exports and carry logs, and the checks that go before anything is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

BAR_SCHEMA = "time long, open decimal(18,2), high decimal(18,2), low decimal(18,2), close decimal(18,2), tick_volume long, spread long, real_volume long"
CARRY_SCHEMA = (
    "at timestamp, ticket long, symbol string, direction string, volume double, opened_at timestamp, days_open double, nights_held int, carry_paid double, floating_pnl double, price double, "
    "published_swap_long double, published_swap_short double, server_offset_hours double, server_offset_source string, equity double, currency string"
)
CARRY_REQUIRED = ("at", "ticket", "symbol", "direction", "volume", "carry_paid")


def load_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of a CSV export with exactly the expected header; any other header or value fails the job."""
    return spark.read.schema(BAR_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path).withColumn("symbol", F.lit(symbol))


def parse_price(text: Column) -> Column:
    """A price with two decimals at most; more is an error, not rounded away."""
    value = text.try_cast("decimal(18,2)")
    return F.when(F.length(F.split_part(text, F.lit("."), F.lit(2))) > 2,
        F.raise_error(F.concat(F.lit("more than two decimals: "), text))).when(value.isNull() & text.isNotNull(),
            F.raise_error(F.concat(F.lit("not a price: "), text))).otherwise(value)


def unrecorded_to_null(bars: DataFrame) -> DataFrame:
    """A spread or real volume of zero was not recorded."""
    return bars.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("spread", "real_volume")})


def conflicting_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that different rows share; rows repeated whole are one."""
    return rows.dropDuplicates().groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def load_carry_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trusted, refused) rows of JSON-lines carry logs. A file with one row whose offset is implausible or neither measured nor explicit is refused whole; a row without a required value fails the job."""
    rows = spark.read.schema(CARRY_SCHEMA).option("mode", "FAILFAST").json(path).withColumn("log_id", F.input_file_name())
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CARRY_REQUIRED]))
    rows = rows.withColumn("ticket", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing "), F.array_join(missing, ", ")))).otherwise(F.col("ticket")))
    bad = ~F.coalesce(F.col("server_offset_hours").between(-12, 14), F.lit(True)) | (F.col("server_offset_source")
        .isNotNull() & ~F.col("server_offset_source").isin("measured", "explicit"))
    marked = rows.withColumn("refused", F.max(bad).over(Window.partitionBy("log_id")))
    return marked.where("not refused").drop("refused"), marked.where("refused").drop("refused")


def audit_files(spark: SparkSession, folder: str, registry: DataFrame) -> DataFrame:
    """(filename, state) of each registered or present file against its registered hash and its .sha256 sidecar.

    registry: (filename, sha256, awaiting boolean). Contents are hashed where they are read; only digests move."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    is_side = F.col("filename").endswith(".sha256")
    data = files.where(~is_side).select("filename", F.sha2("content", 256).alias("actual"))
    side = files.where(is_side).select(F.expr("left(filename, length(filename) - 7)").alias("filename"),
        F.substring_index(F.trim(F.decode("content", "UTF-8")), " ", 1).alias("sidecar"))
    j = registry.join(data, "filename", "full").join(side, "filename", "left")
    state = (
        F.when(F.col("awaiting").isNull(), "unregistered").when(F.col("awaiting") & F.col("actual").isNotNull(), "present-but-awaiting")
            .when(F.col("awaiting"), "awaiting").when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("sha256"), "hash-mismatch")
            .when(F.col("sidecar").isNull() | (F.col("sidecar") != F.col("actual")), "sidecar-mismatch").otherwise("matched")
    )
    return j.select("filename", state.alias("state"))
