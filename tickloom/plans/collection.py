"""Historical collection: clean, store, build bars, check, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions import scalar as S
from tickloom.operators import bars as B
from tickloom.operators import quality as Q
from tickloom.operators import ticks as K
from tickloom.sources import tables


def collect_history(raw: DataFrame, symbols: DataFrame, tick_path: str, bar_path: str) -> DataFrame:
    """Write cleaned ticks and their one-minute bars, then report on what was written."""
    spark: SparkSession = raw.sparkSession
    tables.write_ticks(K.clean(raw), tick_path)
    ticks = tables.read_ticks(spark, tick_path)
    tables.write_bars(S.with_bar_geometry(B.minute_bars(ticks)), bar_path)
    bars = tables.read_bars(spark, bar_path)
    return Q.collection_report(Q.validate_collection(symbols, ticks, bars))
