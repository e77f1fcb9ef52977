"""Column functions over sample arrays: what needs no FFT stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C0 = 299_792_458.0


def db20(x: Column, floor: float = 1e-9) -> Column:
    return 20 * F.log10(x + F.lit(floor))


def db10(x: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(floor)))


def without_mean(x: Column) -> Column:
    """An array minus its mean; null stays null."""
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.element_at(F.transform(F.array(total / F.size(x)), lambda m: F.transform(x, lambda v: v - m)), 1)


def windowed(x: Column, kind: str = "hann") -> Column:
    """An array times symmetric window weights; a single sample, or an unknown kind, stays as it is."""
    a, b = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46)}.get(kind, (1.0, 0.0))
    weight = lambda i: F.when(F.size(x) > 1, a - b * F.cos(2 * math.pi * i / (F.size(x) - 1))).otherwise(1.0)
    return F.transform(x, lambda v, i: v * weight(i))


def magnitude(re: Column, im: Column, real: bool = False) -> Column:
    """Magnitudes of a spectrum, kept off zero; doubled for one-sided spectra of real samples."""
    scale = 2.0 if real else 1.0
    return F.zip_with(re, im, lambda a, b: (F.hypot(a, b) + 1e-9) * scale)


def next_pow2(n: Column) -> Column:
    """The least power of two that is n or more; null for n below 1. Digits are counted, as logarithms round."""
    whole = n.cast("bigint")
    return F.when(whole > 1, F.pow(F.lit(2.0), F.length(F.bin(whole - 1))).cast("bigint")).when(whole == 1, F.lit(1).cast("bigint"))


def bin_width_m(n_fft: int, rate: float, slope: float) -> float:
    """Metres from one range bin to the next; 1 (a bin number) without a rate or slope."""
    return C0 * (rate / n_fft) / (2 * slope) if rate > 0 and slope > 0 else 1.0


def velocity_step(n_fft: int, interval_s: float, start_hz: float) -> float:
    """Metres a second from one Doppler bin to the next."""
    return (C0 / start_hz / 2) / (n_fft * interval_s) if interval_s > 0 else (C0 / start_hz / 2) / n_fft
