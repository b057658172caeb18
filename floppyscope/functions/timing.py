"""Times: how fast a held button repeats, and whether a check is due again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floppyscope.functions.binary import col

# Seconds before a held button repeats, its first and last rate, seconds between these.
HOLD_DELAY = 0.35
HOLD_RATES = (20.0, 150.0)
HOLD_RAMP = 2.0


def hold_rate(held: Column | str) -> Column:
    """Steps a second of a button held for ``held`` seconds; null if that is."""
    low, high = HOLD_RATES
    risen = F.least(F.greatest((col(held) - HOLD_DELAY) / HOLD_RAMP, F.lit(0.0)), F.lit(1.0))
    return F.when(col(held) < HOLD_DELAY, 0.0).when(col(held).isNotNull(), low + (high - low) * risen)


def due(key: str, time: str, tie: str, seconds: int) -> Column:
    """Whether ``seconds`` lie between a row of ``key`` and the one before; null for its first."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return micros - F.lag(micros).over(Window.partitionBy(key).orderBy(time, tie)) >= seconds * 1_000_000
