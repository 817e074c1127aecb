"""CSV files as a stream whose offsets are places in files.

A small source plans byte ranges: its offset is the name of a file and a byte in it, so that a restart goes on where
the last batch ended. Ranges are dealt to the executors, which read them with pyarrow's file systems and split them
into lines; a byte is read once, but for the ends of the lines that cross a range's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

RANGES = "path string, file_no long, start long, stop long"
#: Bits of a line's number that its place in the file takes; the file's number is above them.
PLACE_BITS = 42
#: Bytes after a range's end that are read at once to find the end of its last line.
TAIL = 1 << 16


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a folder by name; names that start with ``_`` or ``.`` don't count."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def batch_of(path: str, size: int, most: int, batches: int) -> int:
    """Ranges of a micro-batch: ``most``, or as many as it takes to read the folder in ``batches``."""
    return max(most, -(-sum(-(-length // size) for _, length in files_of(path)) // batches)) if batches else most


class RangeReader(SimpleDataSourceStreamReader):
    """Rows of RANGES. Files are taken by name; one that comes later must have a name after those that are there.

    With ``batches`` a micro-batch takes more than ``most`` ranges if all that is there wouldn't be read in so many.
    """

    def __init__(self, path: str, size: int, most: int, batches: int = 0):
        self.path, self.size, self.most, self.batches = path, size, most, batches

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def _ranges(self, start: dict) -> Iterator[tuple[tuple, dict]]:
        for k, (name, length) in enumerate(files_of(self.path)):
            at = start["byte"] if name == start["file"] else 0 if name > start["file"] else length
            while at < length:
                stop = min(at + self.size, length)
                yield (name, k, at, stop), {"file": name, "byte": stop}
                at = stop

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end, most = [], start, batch_of(self.path, self.size, self.most, self.batches)
        for row, after in self._ranges(start):
            if len(out) == most:
                break
            out.append(row)
            end = after
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for row, after in self._ranges(start):
            if (after["file"], after["byte"]) > (end["file"], end["byte"]):
                return
            yield row


class CsvRanges(DataSource):
    """Options: path, range_bytes (of a task), batch_ranges (of a micro-batch), batches (0: any number; else batch_ranges gives way)."""

    @classmethod
    def name(cls) -> str:
        return "barograph_csv_ranges"

    def schema(self) -> str:
        return RANGES

    def simpleStreamReader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)), int(self.options.get("batch_ranges", 64)), int(self.options.get("batches", 0)))


def lines_of(path: str, start: int, stop: int) -> tuple[bytes, int]:
    """The lines that begin in [start, stop), and where the first of them does."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(at) as f:
        size = f.size()
        first = max(start - 1, 0)
        data = f.read_at(min(stop, size) - first, first)
        if start:
            cut = data.find(b"\n")
            if cut < 0:
                return b"", stop  # all of it is a line that began before
            data, first = data[cut + 1 :], first + cut + 1
        if first >= stop:
            return b"", first
        parts, end = [data], first + len(data)
        while end < size and not parts[-1].endswith(b"\n"):
            more = f.read_at(min(TAIL, size - end), end)
            cut = more.find(b"\n")
            parts.append(more[: cut + 1] if cut >= 0 else more)
            end += len(parts[-1])
        return b"".join(parts), first


def rows_of(path: str, file_no: int, start: int, stop: int, header: list[str], sep: str = ",") -> pa.RecordBatch | None:
    """Columns of the range's lines as text, and seq, which grows with files and lines. The first line of a file is its header."""
    data, first = lines_of(path, start, stop)
    if not start:
        skip = data.find(b"\n") + 1 or len(data)
        data, first = data[skip:], first + skip
    raw = np.frombuffer(data, np.uint8)
    begins = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    lengths = np.diff(np.append(begins, len(raw) + 1)) - 1
    lengths -= (lengths > 0) & (raw[np.clip(begins + lengths - 1, 0, max(len(raw) - 1, 0))] == 13) if len(raw) else 0
    begins = begins[lengths > 0]
    if not len(begins):
        return None
    table = csv.read_csv(
        BytesIO(data),
        read_options=csv.ReadOptions(column_names=header, use_threads=False, block_size=max(len(data) + 1, 1 << 16)),
        parse_options=csv.ParseOptions(delimiter=sep),
        convert_options=csv.ConvertOptions(column_types=dict.fromkeys(header, pa.string()), strings_can_be_null=False),
    )
    if table.num_rows != len(begins):
        raise ValueError(f"{path}: {table.num_rows} rows in {len(begins)} lines from byte {first}; values must not hold line ends")
    seq = pa.array((file_no << PLACE_BITS) + first + begins.astype(np.int64))
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), seq], [*header, "_seq"])


def stream_text(spark: SparkSession, path: str, header: list[str], range_bytes: int = 16 << 20, batch_ranges: int = 64, sep: str = ",", batches: int = 0) -> DataFrame:
    """A stream of the rows of a CSV file or folder: all columns as text and ``_seq``, which grows in file order.

    A micro-batch has at most ``batch_ranges`` ranges of ``range_bytes``; a task holds one range at a time. With ``batches`` it
    has more if the folder couldn't be read in so many, since each costs seconds of its own, whatever it holds. A file's last
    line may lack its end. What comes to a folder later is read if its name is after the others'.
    """
    spark.dataSource.register(CsvRanges)
    ranges = spark.readStream.format(CsvRanges.name()).option("path", path).option("range_bytes", range_bytes).option("batch_ranges", batch_ranges).option("batches", batches).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = rows_of(r["path"], r["file_no"], r["start"], r["stop"], header, sep)
                if rows is not None:
                    yield rows

    columns = ", ".join(f"`{c}` string" for c in header)
    return ranges.repartition(min(batch_of(path, range_bytes, batch_ranges, batches), 4 * spark.sparkContext.defaultParallelism), F.xxhash64("path", "start")).mapInArrow(run, f"{columns}, _seq long")
