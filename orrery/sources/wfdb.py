"""Beat annotations from header and annotation files of the WFDB format."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the published annotation format: codes that carry no annotation of their own.
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63
DEFAULT_RATE = 250


def sampling_rate(header: bytes) -> int:
    """Samples a second from a header's first line that is no comment: name, signals, rate."""
    for line in header.decode("ascii", "replace").splitlines():
        if line.strip() and not line.startswith("#"):
            parts = line.split()
            return int(float(parts[2].split("/")[0].split("(")[0])) if len(parts) > 2 else DEFAULT_RATE
    return DEFAULT_RATE


def annotation_samples(content: bytes) -> list[int]:
    """Sample numbers of all annotations: 16-bit words of a 6-bit code and a 10-bit step."""
    out: list[int] = []
    at = now = 0
    while at + 1 < len(content):
        word = content[at] | content[at + 1] << 8
        code, step = word >> 10, word & 0x3FF
        at += 2
        if code == 0 and step == 0:
            break
        if code == SKIP:
            high, low = (int.from_bytes(content[at + k : at + k + 2], "little") for k in (0, 2))
            jump = high << 16 | low
            now += jump - (1 << 32) if jump >> 31 else jump
            at += 4
        elif code == AUX:
            at += step + (step & 1)
        elif code not in (NUM, SUB, CHN):
            now += step
            out.append(now)
    return out


def read_beats(spark: SparkSession, folder: str, extension: str = "qrs") -> DataFrame:
    """(record_id, beat_index, sample, fs) from the .hea and annotation files in a folder, a file for each record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{hea,{extension}}}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select(F.substring_index(name, ".", 1).alias("record_id"), F.substring_index(name, ".", -1).alias("kind"), "content")
    both = parts.groupBy("record_id").agg(F.max(F.when(F.col("kind") == "hea", F.col("content"))).alias("hea"), F.max(F.when(F.col("kind") == extension, F.col("content"))).alias("ann"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                samples = annotation_samples(bytes(r.ann))
                yield pd.DataFrame({"record_id": r.record_id, "beat_index": range(len(samples)), "sample": samples, "fs": sampling_rate(bytes(r.hea or b""))})

    return both.where("ann IS NOT NULL").mapInPandas(run, "record_id string, beat_index long, sample long, fs int")


BEATS = "record_id string, beat_index long, sample long, fs int, error string"


@dataclass
class Records(InputPartition):
    """Names of the records that one task reads."""

    names: list[str]


class BeatSource(DataSource):
    """``spark.read.format("wfdb").load(folder)`` after ``register``: beats of all records in a folder.

    Options: ``extension`` of annotation files (qrs), ``records_per_task`` (16). The driver lists names only; each
    task reads its records' files, one record at a time, from any file system that Arrow can open. A record that
    cannot be read (broken header, missing header, unreadable file) is one row with its ``error`` and null beats; the
    others are not touched. A record without annotations has no rows; a folder without records is an empty table.
    """

    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        return BEATS

    def reader(self, schema) -> DataSourceReader:
        return BeatReader(self.options)


class BeatReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.extension = options.get("extension", "qrs")
        self.per_task = int(options.get("records_per_task", "16"))

    def partitions(self) -> list[Records]:
        system, root = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(root))
        names = sorted(f.base_name.rsplit(".", 1)[0] for f in found if f.is_file and f.base_name.endswith(f".{self.extension}"))
        return [Records(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [Records([])]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("beat_index", pa.int64()), ("sample", pa.int64()), ("fs", pa.int32()), ("error", pa.string())])
        system, root = fs.FileSystem.from_uri(self.folder)

        def content(name: str, extension: str) -> bytes:
            with system.open_input_stream(f"{root}/{name}.{extension}") as file:
                return file.read()

        for name in partition.names:
            try:
                rate, samples = sampling_rate(content(name, "hea")), annotation_samples(content(name, self.extension))
                n = len(samples)
                columns = [[name] * n, list(range(n)), samples, [rate] * n, [None] * n]
            except Exception as error:  # any failure of one record is that record's row
                columns = [[name], [None], [None], [None], [f"{type(error).__name__}: {error}"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BeatSource)
