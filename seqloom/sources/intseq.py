"""Flat files of fixed-width little-endian unsigned integers, as a Python data source, and their writer."""

from __future__ import annotations

import logging
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.order import numbered
from ..plans.sequence import Sequence, from_table

WIDTHS = (1, 2, 4, 8)
SPLIT_BYTES = 32_000_000
#: Values of a written file.
FILE_VALUES = 8_000_000
_log = logging.getLogger(__name__)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


class _Range(InputPartition):
    """Records ``begin`` to ``end`` of a file, whose first one has the position ``first``."""

    def __init__(self, path: str, begin: int, end: int, first: int):
        self.path, self.begin, self.end, self.first = path, begin, end, first


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width, self.split = options["path"], int(options.get("width", 4)), int(options.get("splitbytes", SPLIT_BYTES))
        if self.width not in WIDTHS:
            raise ValueError(f"width must be one of {WIDTHS}")

    def partitions(self):
        from pyarrow import fs as pafs

        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        files = [info]
        if info.type == pafs.FileType.Directory:
            files = sorted((x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.base_name)
        parts, first, step = [], 0, max(1, self.split // self.width)
        for x in files:
            if x.size % self.width:
                _log.warning("%s: the last %d bytes don't fill a record and are ignored", x.path, x.size % self.width)
            n = x.size // self.width
            parts += [_Range(x.path, a, min(n, a + step), first) for a in range(0, n, step)]
            first += n
        return parts or [_Range(path, 0, 0, 0)]

    def read(self, part):
        if part.end == part.begin:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(part.path) as f:
            for a in range(part.begin, part.end, 1_000_000):
                n = min(1_000_000, part.end - a)
                f.seek(a * self.width)
                values = np.frombuffer(f.read(n * self.width), dtype=f"<u{self.width}")
                if self.width == 8:  # beyond a long: the lower half of a 128-bit decimal
                    halves = np.zeros((n, 2), dtype="<u8")
                    halves[:, 0] = values
                    column = pa.Array.from_buffers(pa.decimal128(20, 0), n, [None, pa.py_buffer(halves.tobytes())])
                else:
                    column = pa.array(values.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + a, part.first + a + n)), column], names=["pos", "val"])


class IntSequenceSource(DataSource):
    """spark.read.format("intseq").option("width", 4).load(path): (pos, val) of a file or of a folder's files by name."""

    @classmethod
    def name(cls):
        return "intseq"

    def schema(self):
        return "pos long, val decimal(20,0)" if int(self.options.get("width", 4)) == 8 else "pos long, val long"

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_ints(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    spark.dataSource.register(IntSequenceSource)
    return spark.read.format("intseq").option("width", width).load(path)


def sequence_of(spark: SparkSession, path: str, width: int = 4) -> Sequence:
    return from_table(read_ints(spark, path, width), ["pos"], "val")


def write_ints(values: np.ndarray, path: str, width: int = 4) -> None:
    """A small sequence from the driver, such as a generated one."""
    fs, at = _open(path)
    with fs.open_output_stream(at) as f:
        f.write(values.astype(f"<u{width}").tobytes())


def save_ints(df: DataFrame, folder: str, width: int = 4, file_values: int = FILE_VALUES) -> int:
    """Write (pos, val) as a folder of flat files of ``file_values`` values each, in place of what it held; the number of values.

    Files get their names when they are whole, and a task that runs again writes the same ones.
    """
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    fs.delete_dir_contents(path)

    def run(batches):
        own, at = _open(folder)
        out, now, done, temporary = None, None, 0, f"{at}/_temporary-{TaskContext.get().taskAttemptId()}"

        def close():
            if out is not None:
                out.close()
                own.move(temporary, f"{at}/part-{now:012d}")

        for b in batches:
            files = b.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)] if len(files) else []
            for begin, end in zip([0, *ends], ends):
                if files[begin] != now:
                    close()
                    now, out = int(files[begin]), own.open_output_stream(temporary)
                values = b.column(1).slice(begin, end - begin)
                if pa.types.is_decimal(values.type):
                    values = pa.array([int(x) for x in values.to_pylist()], pa.uint64())
                out.write(values.to_numpy(zero_copy_only=False).astype(f"<u{width}").tobytes())
            done += b.num_rows
        close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["n"])

    rows = df.select(F.expr(f"pos div {file_values}").alias("file"), "pos", "val")
    dealt = rows.repartition("file").sortWithinPartitions("file", "pos").select("file", "val")
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_patterns(spark: SparkSession, path: str, max_value: int = (1 << 64) - 1) -> DataFrame:
    """(pid, p) of a text file: a pattern a line, whitespace-separated decimals; pid is the line number, from 0.

    Lines are numbered by a range sort on where they stand, blank ones and other splits included. A line's numbers end at its first bad token; lines without a number give no row. Negative tokens are
    bad tokens here.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines, _ = numbered(lines, ["file", "block", "row"], "at")
    tokens = F.filter(F.split("value", r"\s+"), lambda t: t != "")
    good = lambda t: t.rlike(r"^\+?\d+$") & (F.try_to_number(t, F.lit("9" * 38)) <= F.lit(str(max_value)).cast("decimal(38,0)"))
    flags = F.transform(tokens, lambda t: F.coalesce(good(t), F.lit(False)))
    keep = F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)) - 1, F.size(tokens)).cast("int")
    kept = lines.select("at", F.slice(tokens, 1, keep).alias("t"))
    return kept.where("size(t) > 0").select(F.col("at").alias("pid"), F.transform("t", lambda t: t.cast("decimal(20,0)")).alias("p"))


def write_counts(counts: DataFrame, path: str) -> None:
    """One decimal count a line, in pattern order."""
    counts.orderBy("pid").select(F.col("n_occ").cast("string").alias("value")).write.mode("overwrite").text(path)
