"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_STR, _DBL, _LONG, _INT, _TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType(),
)

TICKS = _struct(
    ("tick_id", _LONG), ("symbol", _STR), ("time", _TS),
    ("bid", _DBL), ("ask", _DBL), ("last", _DBL),
    ("volume", _LONG), ("time_msc", _LONG), ("flags", _INT), ("volume_real", _DBL),
)

BARS = _struct(
    ("symbol", _STR), ("timeframe", _STR), ("time", _TS),
    ("open", _DBL), ("high", _DBL), ("low", _DBL), ("close", _DBL),
    ("volume", _DBL), ("tick_count", _LONG), ("mean_mid", _DBL),
)

# One JSON document per line. Which fields are set depends on ``type``.
MESSAGE = _struct(
    ("type", _INT), ("timestamp", _STR), ("symbol", _STR), ("time", _LONG),
    ("bid", _DBL), ("ask", _DBL), ("last", _DBL), ("volume", _DBL),
    ("spread", _DBL), ("direction", _INT), ("confidence", _DBL), ("request_id", _LONG),
    ("operation", _INT), ("price", _DBL), ("sl", _DBL), ("tp", _DBL),
    ("comment", _STR), ("magic", _LONG),
    ("status", _STR), ("details", _STR), ("expert_id", _STR),
    ("key", _STR), ("value", _STR),
)

SIGNAL = _struct(
    ("type", _INT), ("symbol", _STR), ("direction", _INT), ("confidence", _DBL),
)
