"""Signals from and to WAV files."""

from __future__ import annotations

import io
import struct
import uuid
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import kebab, pcm16


def decode(data: bytes) -> tuple[float, np.ndarray]:
    """(rate, channels x samples in [-1, 1]) of a RIFF file with 8-, 16-, 24- or 32-bit PCM or 32- or 64-bit floats, plain or extensible; a ValueError for others."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    form, raw, at = b"", None, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        elif name == b"data":
            raw = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if len(form) < 16 or raw is None:
        raise ValueError("no format or no data in it")
    code, ch, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if code == 0xFFFE and len(form) >= 26:
        code = int.from_bytes(form[24:26], "little")
    width = bits // 8
    if not ch or (code, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError(f"{ch} channels of format {code} with {bits} bits")
    raw = raw[: len(raw) // (ch * width) * ch * width]
    if code == 3:
        x = np.frombuffer(raw, f"<f{width}").astype(float)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return float(rate), x.reshape(-1, ch).T


def read_wav(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(track, ch, sample_rate, n, samples array) of every .wav or .WAV file under path, one row a channel.

    track is the file's path below ``path``, so files of one name in two folders are two tracks. A file that ``decode`` can't read is
    left out, or if ``strict`` an error that names it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString().rstrip("/") + "/"
    name = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.element_at(F.split("path", "/"), -1))

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rate, x = decode(data)
                except ValueError as e:
                    if strict:
                        raise ValueError(f"{name}: {e}") from e
                    continue
                rows += [(name, c, rate, x.shape[1], v) for c, v in enumerate(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["track", "ch", "sample_rate", "n", "samples"])

    return files.select(name.alias("track"), "content").mapInArrow(run, "track string, ch int, sample_rate double, n bigint, samples array<double>")


def to_signal(rows: DataFrame) -> DataFrame:
    """(track, ch, i, x) from rows with arrays of samples."""
    return rows.select("track", "ch", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("bigint"))


def same_rate(rows: DataFrame) -> float:
    """The one sample rate of all rows; an error if they differ, as samples of different rates can't be mixed."""
    low, high = rows.agg(F.min("sample_rate"), F.max("sample_rate")).first()
    if low is None or low != high:
        raise ValueError(f"one sample rate is needed, there are {low} to {high}")
    return low


def wav_bytes(signal: DataFrame, rate: int) -> DataFrame:
    """(track, wav binary) of each track of (track, ch, i, x): 16-bit PCM, channels interleaved."""
    grouped = signal.select("track", "ch", "i", pcm16(F.col("x")).alias("v"))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        ch = int(pdf["ch"].max()) + 1
        out = np.zeros((int(pdf["i"].max()) + 1, ch), "<i2")
        out[pdf["i"].to_numpy(), pdf["ch"].to_numpy()] = pdf["v"].to_numpy()
        to = io.BytesIO()
        with wave.open(to, "wb") as w:
            w.setnchannels(ch)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(out.tobytes())
        return pd.DataFrame({"track": [pdf["track"].iloc[0]], "wav": [to.getvalue()]})

    return grouped.groupBy("track").applyInPandas(encode, "track string, wav binary")


def write_wav(signal: DataFrame, rate: int, folder: str) -> None:
    """One .wav file a track in folder, a path or a URI that every executor can reach; tracks' names in lower case, blanks as dashes.

    Files appear whole, so a task that is run again does no harm. Two tracks with one file name are an error.
    """
    name = F.concat(kebab(F.regexp_replace("track", "[/\\\\]", "-")), F.lit(".wav"))
    twice = signal.select("track").distinct().groupBy(name.alias("file")).count().where("count > 1").first()
    if twice:
        raise ValueError(f"several tracks would be written to {twice['file']}")

    def save(rows):
        to, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for r in rows:
            part = f"{base}/.{uuid.uuid4().hex}"
            with to.open_output_stream(part) as f:
                f.write(r["wav"])
            to.move(part, f"{base}/{r['file']}")

    wav_bytes(signal, rate).select(name.alias("file"), "wav").foreachPartition(save)
