"""Raw recordings in binary files as a Spark data source.

Files are named ``c<cell>_<type>.bin``; ``patch`` files hold one channel of float64, ``npx`` and ``lfp``
files interleave channels of int16. Every file is read in chunks of a fixed number of samples, one
task per stretch of a file, so a file of any size spreads over the cluster.

    spark.dataSource.register(RecordingSource)
    spark.read.format("recording").option("channels", 384).option("channel", 10).load("/data")
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Known types with their sample format and sampling rate, fixed values.
TYPES = {"patch": ("<f8", 50_000.0), "npx": ("<i2", 30_000.0), "lfp": ("<i2", 2_500.0)}
_NAME = re.compile(r"c(\d+)_([A-Za-z]+)\.bin$")
_SCHEMA = "recording_id string, cell int, kind string, fs double, chunk_id int, sample_offset bigint, samples array<double>"
_ARROW = pa.schema([("recording_id", pa.string()), ("cell", pa.int32()), ("kind", pa.string()), ("fs", pa.float64()), ("chunk_id", pa.int32()), ("sample_offset", pa.int64()), ("samples", pa.list_(pa.float64()))])


def parse_name(path: str) -> tuple[int, str] | None:
    """(cell, type) of a file name; None for other files."""
    m = _NAME.search(os.path.basename(path))
    return (int(m[1]), m[2].lower()) if m else None


class _Part(InputPartition):
    def __init__(self, path, cell, kind, first, last):
        self.path, self.cell, self.kind, self.first, self.last = path, cell, kind, first, last


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", ".")
        self.chunk = int(options.get("chunk", 65_536))
        self.per_task = int(options.get("chunksPerTask", 64))
        self.channels = int(options.get("channels", 1))
        self.channel = int(options.get("channel", 0))
        self.cells = {int(c) for c in options.get("cells", "").split(",") if c.strip()}
        self.kinds = {k.strip().lower() for k in options.get("types", ",".join(TYPES)).split(",")}

    def _format(self, kind):
        dtype, fs = TYPES[kind]
        return np.dtype(dtype), fs, 1 if kind == "patch" else self.channels

    def partitions(self):
        parts = []
        files = [self.root] if os.path.isfile(self.root) else sorted(os.path.join(self.root, f) for f in os.listdir(self.root))
        for path in files:
            known = parse_name(path)
            if not known or known[1] not in TYPES or known[1] not in self.kinds or (self.cells and known[0] not in self.cells):
                continue
            dtype, _, channels = self._format(known[1])
            samples = os.path.getsize(path) // (dtype.itemsize * channels)
            chunks = -(-samples // self.chunk)
            parts += [_Part(path, *known, k, min(chunks, k + self.per_task)) for k in range(0, chunks, self.per_task)]
        return parts or [_Part("", 0, "patch", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        dtype, fs, channels = self._format(part.kind)
        frame = dtype.itemsize * channels
        name = os.path.basename(part.path)[:-4]
        with open(part.path, "rb") as f:
            for k in range(part.first, part.last):
                f.seek(k * self.chunk * frame)
                raw = f.read(self.chunk * frame)
                x = np.frombuffer(raw[: len(raw) // frame * frame], dtype).reshape(-1, channels)[:, self.channel if channels > 1 else 0]
                if len(x):
                    yield pa.RecordBatch.from_pylist([{"recording_id": name, "cell": part.cell, "kind": part.kind, "fs": fs, "chunk_id": k, "sample_offset": k * self.chunk, "samples": x.astype(float).tolist()}], schema=_ARROW)


class RecordingSource(DataSource):
    """Options: path, chunk (samples), chunksPerTask, channels, channel, cells and types (comma-separated filters)."""

    @classmethod
    def name(cls):
        return "recording"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return RecordingReader(dict(self.options))
