"""Scalar formulas of training runs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate_scale(step: Column, total: int, warmup: int, floor: float) -> Column:
    """Linear warm-up, then a cosine from 1 to floor. Warm-up is shortened to total - 1 steps."""
    warmup = max(0, min(warmup, total - 1))
    up = F.greatest((step + 1) / F.lit(float(max(1, warmup))), F.lit(1e-8))
    done = F.least(F.greatest((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(0.0)), F.lit(1.0))
    down = F.lit(floor) + F.lit(1.0 - floor) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, up).otherwise(down) if warmup else down


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def achieved_tflops(parameters: Column, tokens_per_second: Column) -> Column:
    return F.lit(6.0) * parameters * tokens_per_second / F.lit(1e12)


def utilisation(parameters: Column, tokens_per_second: Column, peak_tflops: Column, world: Column) -> Column:
    """Share of the peak; null where the peak is unknown."""
    return achieved_tflops(parameters, tokens_per_second) / (peak_tflops * world)


def tokens_per_step(context: int, batch: int, world: int, accumulation: int) -> int:
    return context * batch * world * accumulation


def finite(c: Column) -> Column:
    """The value, or an error where it is not a finite number."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("non-finite value")).cast("double")).otherwise(c)
