"""Costs of a position as Columns over a row that carries a cost variant."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_VALUE_PER_LOT = 1.0


@dataclass(frozen=True)
class CostModel:
    """Every cost constant of a run. Fixed values; the floor may be raised, never lowered, but for sweeps."""

    floor: float = 75.0
    open_multiplier: float = 3.0
    news_multiplier: float = 10.0
    open_bars: int = 3
    slippage: float = 0.05
    reference_lots: float = 1.0
    commission: float = 3.5
    swap_long: float = 20.0
    swap_short: float = 8.0
    latency_seconds: float = 0.25
    latency_per_second: float = 0.02

    def doubled(self) -> CostModel:
        """Twice every cost; the multipliers stay."""
        return replace(self, **{k: 2 * getattr(self, k) for k in ("floor", "slippage", "commission", "swap_long", "swap_short", "latency_seconds")})

    def at_floor(self, floor: float, sweep: bool = False) -> CostModel:
        if floor < CostModel.floor and not sweep:
            raise ValueError(f"a spread floor under {CostModel.floor} is for sweeps only")
        return replace(self, floor=floor)


def variants(spark: SparkSession, models: dict[str, CostModel]) -> DataFrame:
    """One row a variant, with version, a hash of its constants. A few rows, whatever the data."""
    rows = [(name, *asdict(m).values()) for name, m in models.items()]
    schema = "variant string, " + ", ".join(f"{k} {'int' if k == 'open_bars' else 'double'}" for k in asdict(CostModel()))
    table = spark.createDataFrame(rows, schema)
    return table.withColumn("version", F.sha2(F.to_json(F.struct(*[c for c in table.columns if c != "variant"])), 256))


def half_spread(multiplier: Column) -> Column:
    return 0.5 * F.col("floor") * multiplier


def slippage(atr: Column, lots: Column) -> Column:
    return F.when((lots > 0) & (atr > 0), F.col("slippage") * atr * F.sqrt(lots / F.col("reference_lots"))).otherwise(0.0)


def latency(atr: Column) -> Column:
    return F.col("latency_per_second") * atr * F.col("latency_seconds")


def commission(lots: Column, sides: int = 2) -> Column:
    return F.col("commission") * sides * lots


def swap(sign: Column, nights: Column, lots: Column) -> Column:
    """Charged to both directions."""
    return F.when(sign > 0, F.col("swap_long")).otherwise(F.col("swap_short")) * nights * lots
