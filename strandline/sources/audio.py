"""Waveforms from and to WAV bytes, through Spark's binary file source."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAVE = "array<float>"


def decode_wav(raw: bytes, rate: int) -> np.ndarray:
    """Samples in [-1, 1]: channels averaged, resampled by linear interpolation."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{width}") / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    if own != rate and len(x):
        n = max(1, round(len(x) * rate / own))
        x = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)
    return x.astype(np.float32)


def encode_wav(y: np.ndarray, rate: int) -> bytes:
    """Sixteen-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def waveform(content: Column, rate: int = 16000) -> Column:
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([decode_wav(bytes(b), rate) for b in raw])

    return F.pandas_udf(run, WAVE)(content)


def wav_bytes(y: Column, rate: int = 16000) -> Column:
    """WAV files as binary values, to be written by a table sink."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encode_wav(np.asarray(v), rate) for v in values])

    return F.pandas_udf(run, "binary")(y)


def read_wavs(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, y) of all WAV files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", waveform(F.col("content"), rate).alias("y"))


def list_wavs(spark: SparkSession, root: str, limit: int, seed: int = 42) -> DataFrame:
    """Up to ``limit`` paths below ``root``: of the first three times as many in order, those of least hash.

    Paths with a folder ``train`` are taken if there are any.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path")
    train = files.filter(F.contains("path", F.lit("/train/")))
    files = files if train.isEmpty() else train
    return files.orderBy("path").limit(3 * limit).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "path"), 256)).limit(limit)
