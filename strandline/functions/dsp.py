"""Spectral kernels as Arrow-batched UDFs on ``array<float>`` columns.

They need transforms of the whole waveform, which built-in functions do not have. Each row is one
waveform; null gives null, and an empty one stays empty. Noise is seeded by an id, so that a task that is run
again makes the same samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WAVE = "array<float>"


def _each(values: pd.Series, of: Callable[[np.ndarray, int], np.ndarray]) -> pd.Series:
    return pd.Series([None if y is None else np.asarray(of(np.asarray(y, np.float64), i), np.float32) if len(y) else y for i, y in enumerate(values)])


def normalized(y: np.ndarray, to: float = 1.0) -> np.ndarray:
    top = np.abs(y).max(initial=0.0)
    return y * (to / top) if top > 0 else y


def gated(y: np.ndarray, quantile: float) -> np.ndarray:
    spectrum = np.fft.rfft(y)
    size = np.abs(spectrum)
    return np.clip(np.fft.irfft(np.where(size < np.quantile(size, quantile), 0, spectrum), n=len(y)), -1, 1)


#: What each kind of action makes of a waveform, given its value.
ACTIONS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "gain": lambda y, value: np.clip(y * value, -1, 1),
    "dc_remove": lambda y, _: y - y.mean(),
    "spectral_gate": gated,
}


def acted(y: np.ndarray, plan: list[tuple[str, float]]) -> np.ndarray:
    """The waveform after the actions of a plan, in order, rounded to single precision after each."""
    for kind, value in plan:
        y = ACTIONS[kind](np.asarray(y, np.float64), value).astype(np.float32)
    return y


def execute_plan(y: Column, plan: Column) -> Column:
    """The waveform after a plan that is a column, an array of (kind, value); each row has its own."""

    def run(waves: pd.Series, kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if w is None or k is None else acted(w, list(zip(k, v, strict=True))) if len(w) else w for w, k, v in zip(waves, kinds, values, strict=True)])

    return F.pandas_udf(run, WAVE)(y, F.transform(plan, lambda a: a["kind"]), F.transform(plan, lambda a: F.coalesce(a["value"], F.lit(0.0)).cast("double")))


def spectral_gate(y: Column, quantile: float) -> Column:
    """The waveform without the frequencies whose magnitude is under a quantile, clipped to [-1, 1]."""

    def run(values: pd.Series) -> pd.Series:
        return _each(values, lambda y, _: gated(y, quantile))

    return F.pandas_udf(run, WAVE)(y)


def section_filter(low: float, high: float, rate: int, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a Butterworth band pass by the bilinear transform."""
    warped = [2 * rate * np.tan(np.pi * f / rate) for f in (low, high)]
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    poles = []
    for k in range(order):
        p = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * width / 2
        root = np.sqrt(p * p - centre * centre + 0j)
        poles += [p + root, p - root]
    z = [(2 * rate + p) / (2 * rate - p) for p in poles]
    upper = sorted((x for x in z if x.imag > 0), key=abs)
    sections = [(np.array([1.0, 0.0, -1.0]), np.real(np.poly([p, p.conjugate()]))) for p in upper]
    mid = np.exp(2j * np.pi * np.arctan(centre / (2 * rate)) / np.pi)
    whole = np.prod([abs(np.polyval(b, mid) / np.polyval(a, mid)) for b, a in sections])
    b, a = sections[0]
    sections[0] = (b / whole, a)
    return sections


#: Samples that a second-order section takes at once.
BLOCK = 128


def section_run(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A second-order section over a waveform, without a loop over samples.

    With its two delays as the state, a block of samples maps the state at its start to that at its end: a fixed 2 x 2 matrix plus what the block
    adds from rest. Such maps compose, so the states at all starts follow by doubling, and every block's samples by two products.
    """
    n = -(-len(x) // BLOCK)
    blocks = np.zeros((n, BLOCK))
    blocks.ravel()[: len(x)] = x
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    enter = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = np.empty((BLOCK + 1, 2, 2))
    powers[0] = np.eye(2)
    for k in range(BLOCK):
        powers[k + 1] = powers[k] @ step
    reply = np.concatenate([[b[0]], (powers[: BLOCK - 1] @ enter)[:, 0]])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    from_rest = blocks @ np.where(lag >= 0, reply[np.maximum(lag, 0)], 0.0).T
    states = np.zeros((n, 2))
    states[1:] = (blocks @ (powers[BLOCK - 1 :: -1] @ enter))[:-1]
    move, reach = powers[BLOCK], 1
    while reach < n:
        states[reach:] += states[:-reach] @ move.T
        move, reach = move @ move, 2 * reach
    return (from_rest + states @ powers[:BLOCK, 0].T).ravel()[: len(x)]


def both_ways(y: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Filtered forwards and backwards, with mirrored ends."""
    pad = min(27, len(y) - 1)
    x = np.concatenate([2 * y[0] - y[pad:0:-1], y, 2 * y[-1] - y[-2 : -pad - 2 : -1]]) if pad > 0 else y
    for _ in range(2):
        for b, a in sections:
            x = section_run(x, b, a)
        x = x[::-1]
    return x[pad : pad + len(y)] if pad > 0 else x


def band_limit(y: Column, low: float, high: float, rate: int = 16000) -> Column:
    sections = section_filter(low, high, rate)

    def run(values: pd.Series) -> pd.Series:
        return _each(values, lambda y, _: both_ways(y, sections))

    return F.pandas_udf(run, WAVE)(y)


def convolved(y: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The full convolution with a shorter or longer tail, by transforms of overlapping blocks: n log n."""
    if len(tail) > len(y):
        y, tail = tail, y
    size = 1 << max(10, (2 * len(tail) - 1).bit_length())
    step = size - len(tail) + 1
    n = -(-len(y) // step)
    blocks = np.zeros((n, step))
    blocks.ravel()[: len(y)] = y
    parts = np.fft.irfft(np.fft.rfft(blocks, size) * np.fft.rfft(tail, size), size)
    out = np.zeros(n * step + size)
    out[: n * step] = parts[:, :step].ravel()
    # what a block's reply adds to the next one; it never reaches further
    over = np.zeros((n, step))
    over[:, : size - step] = parts[:, step:]
    out[step : step + n * step] += over.ravel()
    return out[: len(y) + len(tail) - 1]


def reverberant(y: np.ndarray, rt60: float, rate: int) -> np.ndarray:
    """Six parts dry and four parts of the waveform through a decaying tail, centred."""
    t = np.arange(max(10, int(2 * rt60 * rate)))
    tail = np.exp(-t / max(1.0, rt60 * rate / 6.91))
    full = convolved(y, tail / tail.sum())
    start = (len(full) - max(len(y), len(tail))) // 2 if len(tail) <= len(y) else (len(full) - len(y)) // 2
    return 0.6 * y + 0.4 * full[start:][: len(y)]


def reverb(y: Column, rt60: float, rate: int = 16000) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return _each(values, lambda y, _: reverberant(y, rt60, rate))

    return F.pandas_udf(run, WAVE)(y)


def noise_samples(kind: str, n: int, rate: int, rng: np.random.Generator) -> np.ndarray:
    """White, pink, hvac or cafe noise; an unknown kind is white."""
    white, t = rng.standard_normal(n), np.arange(n) / rate
    if kind == "pink":
        spectrum = np.fft.rfft(white)
        return normalized(np.fft.irfft(spectrum / np.sqrt(1 + np.arange(len(spectrum))), n=n))
    if kind == "hvac":
        hum = np.sin(2 * np.pi * np.outer((220, 280, 350, 420, 480), t)).sum(axis=0) + 0.3 * white
        return normalized(both_ways(hum, section_filter(200, 500, rate)))
    if kind == "cafe":
        tones = np.arange(500, 4000, 200)
        slow = np.sin(2 * np.pi * np.outer(rng.uniform(2, 8, len(tones)), t))
        return normalized(0.2 * (slow * np.sin(2 * np.pi * np.outer(tones, t))).sum(axis=0) + 0.2 * white)
    return white


def noise(seed: Column, length: Column, kind: str, rate: int = 16000) -> Column:
    """A waveform of noise for each seed and length."""

    def run(seeds: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(noise_samples(kind, int(n), rate, np.random.default_rng(abs(int(s)))), np.float32) if n else np.zeros(0, np.float32) for s, n in zip(seeds, lengths, strict=True)])

    return F.pandas_udf(run, WAVE)(seed, length)


def frames(y: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Windowed frames, centred, with reflected ends."""
    padded = np.pad(y, size // 2, mode="reflect" if len(y) > size // 2 else "constant")
    n = 1 + (len(padded) - size) // hop
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.stack([padded[i * hop : i * hop + size] * window for i in range(max(n, 1))], axis=1) if len(padded) >= size else np.zeros((size, 0))


def features(y: Column, rate: int = 16000) -> Column:
    """rms, spectral flatness, spectral centroid, zero-crossing rate and duration, to six decimals."""
    fields = ("rms", "spectral_flatness", "spectral_centroid_hz", "zero_crossing_rate", "duration_seconds")

    def of(y: np.ndarray) -> list[float]:
        size = np.abs(np.fft.rfft(frames(y, 2048, 512), axis=0))
        energy = np.maximum(size**2, 1e-10)
        flat = np.exp(np.log(energy).mean(axis=0)) / energy.mean(axis=0)
        hz = np.fft.rfftfreq(2048, 1 / rate)[:, None]
        centre = (hz * size).sum(axis=0) / np.maximum(size.sum(axis=0), 1e-12)
        crossed = np.mean(np.signbit(y[1:]) != np.signbit(y[:-1])) if len(y) > 1 else 0.0
        return [round(float(v), 6) for v in (np.sqrt(np.mean(y**2)), flat.mean(), centre.mean(), crossed, len(y) / rate)]

    def run(values: pd.Series) -> pd.DataFrame:
        rows = [of(np.asarray(v, np.float64)) if v is not None and len(v) else [None] * len(fields) for v in values]
        return pd.DataFrame(rows, columns=list(fields), dtype="float64")

    return F.pandas_udf(run, ", ".join(f"{f} double" for f in fields))(y)


def spectral_subtraction(y: Column, amount: float = 1.0, rate: int = 16000, size: int = 512, hop: int = 128) -> Column:
    """The waveform less the mean spectrum of its first 0.3 seconds, with peak 0.95."""

    def subtract(y: np.ndarray, _: int) -> np.ndarray:
        spectrum = np.fft.rfft(frames(y, size, hop), axis=0)
        mag = np.abs(spectrum)
        floor = mag[:, : max(1, int(0.3 * rate / hop))].mean(axis=1, keepdims=True)
        clean = np.fft.irfft(np.maximum(mag - amount * floor, 0) * np.exp(1j * np.angle(spectrum)), n=size, axis=0)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        out, weight = np.zeros(len(y) + size), np.zeros(len(y) + size)
        for i in range(clean.shape[1]):
            part = slice(i * hop, i * hop + size)
            n = len(out[part])
            out[part] += (clean[:, i] * window)[:n]
            weight[part] += (window**2)[:n]
        got = (out / np.maximum(weight, 1e-8))[size // 2 : size // 2 + len(y)]
        return normalized(np.pad(got, (0, len(y) - len(got))), 0.95)

    def run(values: pd.Series) -> pd.Series:
        return _each(values, subtract)

    return F.pandas_udf(run, WAVE)(y)


def degrade(y: Column, seed: Column, kind: Column, snr_db: Column, rt60: Column, low: Column, high: Column, rate: int = 16000) -> Column:
    """Reverberation, noise at a ratio, band limit, then peak 0.95; a null parameter leaves its step out."""

    def run(values: pd.Series, seeds: pd.Series, kinds: pd.Series, snrs: pd.Series, rts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = []
        for y, s, k, snr, rt, lo, hi in zip(values, seeds, kinds, snrs, rts, lows, highs, strict=True):
            if y is None or not len(y):
                out.append(y)
                continue
            x = np.asarray(y, np.float64)
            if rt and rt == rt:
                x = reverberant(x, rt, rate)
            n = noise_samples(k or "white", len(x), rate, np.random.default_rng(abs(int(s))))
            x = x + n * np.sqrt(np.mean(x**2) / ((np.mean(n**2) + 1e-12) * 10 ** ((15.0 if snr is None or snr != snr else snr) / 10)))
            if lo and lo == lo:
                x = both_ways(x, section_filter(lo, hi, rate))
            out.append(np.asarray(normalized(x, 0.95), np.float32))
        return pd.Series(out)

    return F.pandas_udf(run, WAVE)(y, seed, kind, snr_db, rt60, low, high)


# fixed values: the lines of the description
TOO_SHORT = "<audio_analysis>\n- 音频过短，无法分析\n</audio_analysis>"
NOISY, SPEECH = "噪声特征明显", "语音特征为主"
MID_HEAVY, LOW_HEAVY, EVEN = "200-500Hz 能量偏高（疑似窄带/空调噪声）", "低频(<250Hz)能量偏高", "全频段能量均匀"


def describe(y: Column, rate: int = 16000) -> Column:
    """A description in words: estimated ratio, flatness, and where the energy lies."""

    def of(y: np.ndarray) -> str:
        if len(y) < 400:
            return TOO_SHORT
        energy = np.array([np.sum(y[i : i + 400] ** 2) for i in range(0, len(y) - 400, 400)])
        energy, snr = energy[energy > 0], 15.0
        if len(energy) > 4:
            snr = float(np.clip(10 * np.log10(np.percentile(energy, 90) / (np.percentile(energy, 10) + 1e-9)), 3, 30))
        size = np.abs(np.fft.rfft(frames(y, 512, 128), axis=0))
        squared = np.maximum(size**2, 1e-10)
        flat = float((np.exp(np.log(squared).mean(axis=0)) / squared.mean(axis=0)).mean())
        band, hz = size.mean(axis=1), np.fft.rfftfreq(512, 1 / rate)
        whole = band.sum() + 1e-9
        where = MID_HEAVY if band[(hz >= 200) & (hz < 500)].sum() / whole > 0.35 else LOW_HEAVY if band[hz < 250].sum() / whole > 0.4 else EVEN
        return f"<audio_analysis>\n- 估计信噪比: {snr:.1f}dB\n- 频谱平坦度: {flat:.3f}（{NOISY if flat > 0.3 else SPEECH}）\n- 频带能量: {where}\n</audio_analysis>"

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else of(np.asarray(v, np.float64)) for v in values])

    return F.pandas_udf(run, "string")(y)
