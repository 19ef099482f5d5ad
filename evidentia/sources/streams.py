"""Token streams as a streaming source, and a log of events as a streaming sink.

`register(spark)` makes both known as formats. Paths are folders that the driver and the executors share, as local paths
or as addresses of a file system that pyarrow knows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

EVENT_ROW = "request_id string, seq long, event string"
#: Where an event ends: a blank line, in each way of ending lines.
END = re.compile(rb"(?<=\n)\n|(?<=\r\n)\r\n|(?<=\r)\r")
#: Bytes of a file that one task reads, and of a step back to where an event began.
RANGE_BYTES = 16 << 20
STEP_BACK = 1 << 16
DATA, MARKS = "data", "committed"


def register(spark: SparkSession) -> None:
    """Make `token_stream` and `event_log` known to a session."""
    ship(spark)
    for source in (TokenStream, EventLog):
        spark.dataSource.register(source)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _names(files: fs.FileSystem, folder: str) -> dict[str, int]:
    """Sizes of the files in a folder by name, without hidden ones."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {x.base_name: x.size for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._"}


def _published(files: fs.FileSystem, folder: str) -> dict[str, int] | None:
    """Sizes of the files that a log's marks name, below `folder`; None where it is no log."""
    if files.get_file_info(f"{folder}/{MARKS}").type != fs.FileType.Directory:
        return None
    out = {}
    for name in sorted(_names(files, f"{folder}/{MARKS}")):
        with files.open_input_file(f"{folder}/{MARKS}/{name}") as mark:
            out |= {f"{DATA}/{x['name']}": x["bytes"] for x in json.loads(mark.read())["files"]}
    return out


def _request(event: bytes, name: str) -> str:
    for line in event.split(b"\n"):
        if line.startswith(b"id:"):
            return line[3:].strip().decode("utf-8", "replace")
    return name.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Range(InputPartition):
    """The bytes of a file of which a task reads the events that end there; `rest`: what is left at its end is one too."""

    name: str
    begin: int
    end: int
    rest: bool


class _Events:
    """Reads recorded streams. An event belongs to the range in which its blank line ends, so ranges can be cut anywhere,
    a range gives the same events whenever it is read, and one that is still being written waits for its end."""

    def __init__(self, options: dict) -> None:
        self.path, self.complete = options["path"], str(options.get("complete", "false")).lower() == "true"
        self.step = int(options.get("range_bytes", RANGE_BYTES))

    def sizes(self) -> dict[str, int]:
        files, folder = _opened(self.path)
        logged = _published(files, folder)
        return _names(files, folder) if logged is None else logged

    def ranges(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in sorted(end.items()):
            at = start.get(name, 0)
            while at < size:
                stop = min(size, at + self.step)
                out.append(Range(name, at, stop, self.complete and stop == size))
                at = stop
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, folder = _opened(self.path)
        with files.open_input_file(f"{folder}/{part.name}") as stream:
            back = min(part.begin, 4)  # a blank line may lie across the cut
            data = stream.read_at(part.end - part.begin + back, part.begin - back)
            ends = [m.end() + part.begin - back for m in END.finditer(data)]
            ends = [e for e in ends if e > part.begin]
            if part.rest and (not ends or ends[-1] < part.end):
                ends.append(part.end)
            if not ends:
                return
            first = part.begin - back
            while first > 0 and not any(m.end() + first <= part.begin for m in END.finditer(data)):
                more = min(first, STEP_BACK)
                first -= more
                data = stream.read_at(more, first) + data
        begin = max([0, *(e for m in END.finditer(data) if (e := m.end() + first) <= part.begin)])
        rows = []
        for end in ends:
            event = data[begin - first : end - first].replace(b"\r\n", b"\n").replace(b"\r", b"\n").strip(b"\n")
            if event.strip():
                rows.append((_request(event, part.name), begin, event.decode("utf-8", "replace")))
            begin = end
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["request_id", "seq", "event"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.events = _Events(options)

    def partitions(self):
        return self.events.ranges({}, self.events.sizes()) or [Range("", 0, 0, False)]

    def read(self, partition: Range):
        if partition.name:
            yield from self.events.read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the bytes of each file that were read."""

    def __init__(self, options: dict) -> None:
        self.events = _Events(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.events.sizes()

    def partitions(self, start: dict, end: dict):
        return self.events.ranges(start, end)

    def read(self, partition: Range):
        yield from self.events.read(partition)

    def commit(self, end: dict) -> None:
        """Recorded streams stay where they are."""


class TokenStream(DataSource):
    """Recorded token streams (server-sent events) in a folder: request_id, seq and event, for batches and streams.

    Each file is appended to, by one recorder. An event names its request in an `id:` line; without one, the file's name
    does. `seq` is the byte where the event begins, so events of a request are in order. What stands behind the last blank
    line is read once it has one; with the option `complete` all files are closed and it is an event.
    """

    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return EVENT_ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int


class _Log:
    """Two steps: tasks write files that nobody sees, each under a name of its own; a mark for the batch, which is renamed
    into place once, names those that count."""

    def __init__(self, options: dict) -> None:
        self.path, self.form = options["path"], options.get("form", "json")

    def _line(self, row) -> bytes:
        if self.form == "sse":
            data = "".join(f"data: {x}\n" for x in (row["data"] or "").split("\n"))
            return f"id: {row['request_id']}\n{data}\n".encode()
        return json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n"

    def write(self, iterator) -> Written:
        files, folder = _opened(self.path)
        files.create_dir(f"{folder}/{DATA}")
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.{self.form}"
        rows = size = 0
        try:
            with files.open_output_stream(f"{folder}/{DATA}/{name}") as out:
                for row in iterator:
                    line = self._line(row)
                    out.write(line)
                    rows, size = rows + 1, size + len(line)
        except BaseException:
            self._drop([Written(name, 0, 0)])
            raise
        return Written(name, rows, size)

    def _drop(self, messages: list) -> None:
        files, folder = _opened(self.path)
        for one in messages:
            if one is not None and files.get_file_info(f"{folder}/{DATA}/{one.name}").type == fs.FileType.File:
                files.delete_file(f"{folder}/{DATA}/{one.name}")

    def publish(self, messages: list, key: str) -> bool:
        """Whether these files count; a batch that has its mark already drops them."""
        files, folder = _opened(self.path)
        mark = f"{folder}/{MARKS}/{key}.json"
        files.create_dir(f"{folder}/{MARKS}")
        if files.get_file_info(mark).type == fs.FileType.File:
            self._drop(messages)
            return False
        kept = [m for m in messages if m is not None and m.rows]
        with files.open_output_stream(held := f"{folder}/{MARKS}/.{uuid.uuid4().hex}") as out:
            out.write(json.dumps({"files": [{"name": m.name, "rows": m.rows, "bytes": m.bytes} for m in kept]}).encode())
        files.move(held, mark)
        self._drop([m for m in messages if m is not None and not m.rows])
        return True


class _StreamLog(DataSourceStreamWriter):
    def __init__(self, options: dict) -> None:
        self.log = _Log(options)

    def write(self, iterator) -> Written:
        return self.log.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.log.publish(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self.log._drop(messages)


class _BatchLog(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.log, self.key = _Log(options), options.get("key") or f"write-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        return self.log.write(iterator)

    def commit(self, messages: list) -> None:
        self.log.publish(messages, self.key)

    def abort(self, messages: list) -> None:
        self.log._drop(messages)


class EventLog(DataSource):
    """An append-only log of rows as JSON lines, or of (request_id, data) as server-sent events (`form` = `sse`).

    A batch of a stream counts once, under its number: a killed one leaves nothing that is read, a repeated one nothing
    more. One log belongs to one streaming query and its checkpoint. Batches without a stream are told apart by the option
    `key`. `token_stream` reads a log of events, `read_log` one of rows.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamLog(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchLog(dict(self.options))


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a log of JSON lines that its marks name."""
    files, folder = _opened(path)
    names = sorted(_published(files, folder) or {})
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json([f"{path.rstrip('/')}/{n}" for n in names])
