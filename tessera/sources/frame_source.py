"""Python data sources: frames with their detections from growing files of JSON lines, and a tree of label files by split.

`frames` reads every file below a folder; a line is a frame as an object with stream, frame_index and, as far as there are any,
seconds, rate, width, height, boxes (a list of four corners each), classes, labels, confidences, u, v, foreground. Any detector
that writes such lines can be plugged in. Offsets are bytes of whole lines, so a stream that is started again reads on where
its checkpoint ends; a line that isn't finished yet waits. Large files are cut into ranges of bytes, read in parallel; a line
belongs to the range in which it begins.

Options: path; max_frames (frames from this index on are left out); fallback_rate (frames a second where a line's rate is
missing, not finite or not above 0); start (seconds since 1970 of a stream's first frame); range_bytes.

`label_tree` writes one text file for each row, path/<split>/labels/<name>.txt, from columns split, name and text. All go to a
folder beside the path, which takes its place when the job is committed: a failed job leaves nothing, and nobody sees half a
tree. An existing tree is replaced only in mode overwrite. Files are written under another name and renamed, so a task that
is run again or twice does no harm.
"""

from __future__ import annotations

import io
import json
import math
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.streaming.frames import INPUT

_TAIL = 1 << 16


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is one of the machine's own."""
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def _whole(system: fs.FileSystem, path: str, size: int) -> int:
    """Bytes of a file up to the end of its last whole line."""
    with system.open_input_file(path) as f:
        while size > 0:
            low = max(0, size - _TAIL)
            found = f.read_at(size - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            size = low
    return 0


class FrameFiles:
    """The files below a folder and how their lines become rows."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.most = int(options["max_frames"]) if "max_frames" in options else None
        self.rate, self.start, self.bytes = float(options.get("fallback_rate", 25)), float(options.get("start", 0)), int(options.get("range_bytes", 16 << 20))
        if not self.rate > 0 or self.bytes < 1:
            raise ValueError("fallback_rate and range_bytes must be above 0")

    def sizes(self) -> dict[str, int]:
        system, root = _opened(self.uri)
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
        return {f.path: _whole(system, f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}

    def ranges(self, before: dict[str, int], now: dict[str, int]) -> list[Range]:
        return [Range(path, a, min(a + self.bytes, end)) for path, end in sorted(now.items()) for a in range(before.get(path, 0), end, self.bytes)]

    def row(self, line: dict) -> tuple | None:
        index = int(line["frame_index"])
        if self.most is not None and index >= self.most:
            return None
        rate = line.get("rate")
        rate = float(rate) if rate is not None and math.isfinite(float(rate)) and float(rate) > 0 else self.rate
        seconds = float(line["seconds"]) if line.get("seconds") is not None else index / rate
        floats = lambda name: None if line.get(name) is None else [float(x) for x in line[name]]
        boxes = None if line.get("boxes") is None else [float(x) for box in line["boxes"] for x in box]
        return (
            str(line["stream"]), index, datetime.fromtimestamp(self.start + seconds, timezone.utc), seconds, int(line.get("width") or 1), int(line.get("height") or 1), boxes,
            None if line.get("classes") is None else [int(x) for x in line["classes"]], line.get("labels"), floats("confidences"), floats("u"), floats("v"), floats("foreground"),
        )

    def rows(self, part: Range) -> Iterator[tuple]:
        system, _ = _opened(self.uri)
        with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as f:
            at = max(part.begin - 1, 0)  # a range that begins inside a line leaves that line to the one before
            f.seek(at)
            if part.begin:
                at += len(f.readline())
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                at += len(line)
                if line.strip() and (row := self.row(json.loads(line))) is not None:
                    yield row


class _Batch(DataSourceReader):
    def __init__(self, files: FrameFiles):
        self.files = files

    def partitions(self) -> list[Range]:
        return self.files.ranges({}, self.files.sizes())

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.files.rows(partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, files: FrameFiles):
        self.files = files

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.files.sizes()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.files.ranges(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.files.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return INPUT

    def reader(self, schema) -> DataSourceReader:
        return _Batch(FrameFiles(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(FrameFiles(self.options))


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Tree(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        missing = {"split", "name", "text"} - set(columns)
        if missing:
            raise ValueError(f"a label tree needs columns {', '.join(sorted(missing))}")
        self.uri, self.overwrite = options["path"].rstrip("/"), overwrite
        system, root = _opened(self.uri)
        if not overwrite and system.get_file_info(root).type != fs.FileType.NotFound:
            raise ValueError(f"{root} exists already")
        self.staged = f"{posixpath.dirname(root)}/.{posixpath.basename(root)}-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, _ = _opened(self.uri)
        made, n = set(), 0
        for row in iterator:
            name, split = str(row["name"]), str(row["split"])
            if not name or not split or "/" in name or "/" in split or name.startswith(".") or split.startswith("."):
                raise ValueError(f"neither split {split!r} nor name {name!r} may be empty, begin with a dot or hold a slash")
            folder = f"{self.staged}/{split}/labels"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as f:
                f.write((row["text"] or "").encode())
            system.move(draft, f"{folder}/{name}.txt")
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        system, root = _opened(self.uri)
        system.create_dir(self.staged, recursive=True)  # of no rows, an empty tree
        if system.get_file_info(root).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{root} exists already")
            old = f"{self.staged}-old"
            system.move(root, old)
            system.move(self.staged, root)
            system.delete_dir(old)
        else:
            system.move(self.staged, root)

    def abort(self, messages: list) -> None:
        system, _ = _opened(self.uri)
        if system.get_file_info(self.staged).type != fs.FileType.NotFound:
            system.delete_dir(self.staged)


class LabelTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_tree"

    def schema(self) -> str:
        return "split string, name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Tree(self.options, [f.name for f in schema], overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(Frames)
    spark.dataSource.register(LabelTree)


def write_label_tree(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    """samples: split, name (unique within a split) and text; one file each, dealt to all cores, as small tables are one split."""
    spark = samples.sparkSession
    register(spark)
    dealt = samples.select("split", "name", "text").repartition(3 * spark.sparkContext.defaultParallelism, "split", "name")
    dealt.write.format("label_tree").option("path", path).mode("overwrite" if overwrite else "append").save()


#: Bytes of texts (one text at least) and the most names that a batch holds.
BATCH_BYTES, BATCH_NAMES = 4 << 20, 10_000


def _label_files(system: fs.FileSystem, folder: str) -> Iterator[str]:
    """Names of a folder's label files; on a machine's own disk they are never held at once."""
    if not isinstance(system, fs.LocalFileSystem):
        found = ((f.base_name, f.type == fs.FileType.File) for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
    else:
        found = ((e.name, e.is_file()) for e in os.scandir(folder)) if os.path.isdir(folder) else iter(())
    return (name[:-4] for name, is_file in found if is_file and name.endswith(".txt") and not name.startswith("."))


def read_label_tree(spark: SparkSession, path: str) -> DataFrame:
    """(split, name, text) of a tree. A task lists a split's names; they are dealt to all cores, which read the files."""
    system, root = _opened(path.rstrip("/"))
    splits = [f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and not f.base_name.startswith(".")]
    uri = path.rstrip("/")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(uri)
        for split in (s for batch in batches for s in batch.column(0).to_pylist()):
            for names in batched(_label_files(system, f"{root}/{split}/labels"), BATCH_NAMES):
                yield pa.RecordBatch.from_arrays([pa.array([split] * len(names), pa.string()), pa.array(names, pa.string())], ["split", "name"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(uri)
        for batch in batches:
            begin, held, size = 0, [], 0
            for n, (split, name) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                with system.open_input_file(f"{root}/{split}/labels/{name}.txt") as f:
                    held.append(f.readall())
                size += len(held[-1])
                if size >= BATCH_BYTES or n == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], ["split", "name", "content"])
                    begin, held, size = n + 1, [], 0

    folders = spark.createDataFrame([(s,) for s in splits], "split string").repartition(max(1, len(splits)), "split")
    files = folders.mapInArrow(listed, "split string, name string").repartition(3 * spark.sparkContext.defaultParallelism, "split", "name")
    return files.mapInArrow(texts, "split string, name string, content binary").select("split", "name", F.col("content").cast("string").alias("text"))
