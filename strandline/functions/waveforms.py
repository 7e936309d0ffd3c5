"""Waveform kernels on ``array<float>`` columns, in built-in functions.

A null or empty waveform gives null. Frames are cut with guards, since ``sequence`` counts down when its end
is below its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(y: Column) -> Column:
    return F.transform(y, lambda x: x.cast("double"))


def total(y: Column) -> Column:
    return F.aggregate(_doubles(y), F.lit(0.0), lambda a, x: a + x)


def power(y: Column) -> Column:
    """Mean of squares."""
    n = F.nullif(F.size(y), F.lit(0))
    return F.aggregate(_doubles(y), F.lit(0.0), lambda a, x: a + x * x) / n


def rms(y: Column) -> Column:
    return F.sqrt(power(y))


def peak(y: Column) -> Column:
    return F.array_max(F.transform(_doubles(y), lambda x: F.abs(x)))


def sign_changes(y: Column) -> Column:
    """How often neighbouring samples differ in sign (zero counts as positive)."""
    return F.when(F.size(y) > 0, F.aggregate(F.transform(y, lambda x, i: F.coalesce((x < 0) != (F.get(y, i - 1) < 0), F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x))


def gain(y: Column, factor: Column | float) -> Column:
    """Scaled samples, clipped to [-1, 1]."""
    factor = F.lit(factor) if isinstance(factor, float | int) else factor
    return F.transform(y, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * factor)).cast("float"))


def remove_dc(y: Column) -> Column:
    """Samples less their mean."""
    mean = total(y) / F.nullif(F.size(y), F.lit(0))
    return F.element_at(F.transform(F.array(mean), lambda m: F.transform(y, lambda x: (x.cast("double") - m).cast("float"))), 1)


def _starts(y: Column, last: Column, step: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(none)


def frame_energies(y: Column, frame: int = 400) -> Column:
    """Energies of frames that do not overlap; a frame that would end exactly at the end is left out."""
    return F.transform(_starts(y, F.size(y) - frame - 1, frame), lambda i: F.aggregate(_doubles(F.slice(y, i + 1, frame)), F.lit(0.0), lambda a, x: a + x * x))


def pooled(y: Column, stride: int) -> Column:
    """Means of windows of ``stride`` samples; the last window may be shorter and is averaged over its own length."""
    return F.transform(_starts(y, F.size(y) - 1, stride), lambda i: total(F.slice(y, i + 1, stride)) / F.size(F.slice(y, i + 1, stride)))


def percentile(values: Column, q: float) -> Column:
    """Percentile with linear interpolation, q in [0, 100]."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * (q / 100)
    lo = F.get(s, F.floor(at).cast("int"))
    hi = F.get(s, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def snr_estimate(y: Column, frame: int = 400) -> Column:
    """Ratio of the loud to the quiet frames in dB, clipped to [3, 30]; 15 for four frames or fewer."""
    e = F.filter(frame_energies(y, frame), lambda x: x > 0)
    ratio = 10 * F.log10(percentile(e, 90) / (percentile(e, 10) + 1e-9))
    return F.when(F.size(e) > 4, F.greatest(F.lit(3.0), F.least(F.lit(30.0), ratio))).otherwise(15.0)


def noise_scale(signal_power: Column, noise_power: Column, snr_db: Column) -> Column:
    """The factor that sets noise of some power at a signal-to-noise ratio."""
    return F.sqrt(signal_power / ((noise_power + 1e-12) * F.pow(F.lit(10.0), snr_db / 10)))


def mix(signal: Column, noise: Column, snr_db: Column) -> Column:
    """Signal with noise added at a signal-to-noise ratio."""
    scale = noise_scale(power(signal), power(noise), snr_db)
    return F.element_at(F.transform(F.array(scale), lambda s: F.zip_with(signal, noise, lambda x, n: (x.cast("double") + s * n.cast("double")).cast("float"))), 1)


def strength(text: Column) -> Column:
    """How strong a plan in words asks noise to be reduced; the words are fixed values."""
    named = F.when(F.contains(text, F.lit("重度谱减")), 1.6).when(F.contains(text, F.lit("轻度谱减")), 0.8).otherwise(1.0)
    db = F.regexp_extract(text, r"衰减\s*(\d+)\s*dB", 1)
    return F.when(db != "", F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.nullif(db, F.lit("")).cast("double") / 15.0))).otherwise(named)


def tone(frequency: Column, seconds: float, rate: int = 16000, volume: float = 0.08) -> Column:
    """A sine wave."""
    return F.transform(F.sequence(F.lit(0), F.lit(int(seconds * rate) - 1)), lambda i: (volume * F.sin(2 * F.pi() * frequency * i / rate)).cast("float"))


def pooled_frames(frames: Column, stride: int) -> Column:
    """Mean vectors of windows of ``stride`` frames, for an array of vectors; the last window may be shorter."""

    def mean(window: Column) -> Column:
        zero = F.transform(window[0], lambda _: F.lit(0.0))
        added = F.aggregate(window, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
        return F.transform(added, lambda x: x / F.size(window))

    windows = F.transform(_starts(frames, F.size(frames) - 1, stride), lambda i: F.slice(frames, i + 1, stride))
    return F.transform(windows, mean)
