"""Media files: catalog and PCM samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions.convert import file_name, file_stem, file_suffix

BATCH_SAMPLES = 1 << 18


def media_columns(path: Column) -> dict[str, Column]:
    """Name, stem, extension, type and display name of a media path."""
    name, suffix = file_name(path), F.lower(file_suffix(path))
    types = F.create_map(*[F.lit(v) for kv in K.MEDIA_TYPES.items() for v in kv])
    # An upload is stored as <id>_<name>; an id is longer than 30 characters.
    prefix = F.substring_index(name, "_", 1)
    has_prefix = name.contains("_") & (F.length(prefix) > 30)
    return {
        "name": name,
        "stem": file_stem(path),
        "extension": suffix,
        "media_type": F.coalesce(F.try_element_at(types, suffix), F.lit("application/octet-stream")),
        "is_video": suffix.isin(*K.VIDEO_EXTENSIONS),
        "display_name": F.when(has_prefix, F.substring(name, F.length(prefix) + 2, F.length(name))).otherwise(name),
    }


def media_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``; the content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime").withColumns(media_columns(F.col("path")))


def _pcm(data: bytes, width: int, channels: int) -> np.ndarray:
    if width == 1:
        values = (np.frombuffer(data, dtype=np.uint8).astype(np.float64) - 128.0) / 128.0
    elif width == 2:
        values = np.frombuffer(data, dtype="<i2") / 32768.0
    elif width == 3:
        raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        signed = (raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000
        values = (signed - 0x800000) / 8388608.0
    elif width == 4:
        values = np.frombuffer(data, dtype="<i4") / 2147483648.0
    else:
        raise ValueError(f"unsupported sample width {width}")
    return values.reshape(-1, channels).mean(axis=1)


def decode_pcm(files: DataFrame) -> DataFrame:
    """(series_id, pos, value) of WAV contents (path, content): mono as the mean of the channels.

    A file is decoded in steps of BATCH_SAMPLES frames, so only its bytes are held.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as source:
                    pos = 0
                    while data := source.readframes(BATCH_SAMPLES):
                        values = _pcm(data, source.getsampwidth(), source.getnchannels())
                        yield pd.DataFrame({"series_id": name, "pos": np.arange(pos, pos + len(values)), "value": values})
                        pos += len(values)

    return files.select("path", "content").mapInPandas(decode, "series_id string, pos bigint, value double")


def read_pcm(spark: SparkSession, path: str) -> DataFrame:
    """Samples of the WAV files at ``path``; the file path is the series."""
    return decode_pcm(spark.read.format("binaryFile").load(path))


def read_pcm_meta(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, sample_rate, duration, channels) from the WAV headers."""

    def header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as source:
                    rate = source.getframerate()
                    rows.append((name, rate, source.getnframes() / rate, source.getnchannels()))
            yield pd.DataFrame(rows, columns=["series_id", "sample_rate", "duration", "channels"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(header, "series_id string, sample_rate int, duration double, channels int")
