"""Logs and subtitles as Python data sources whose files split by byte ranges, in batches and as streams.

``log_nodes`` gives ``path, offset, tag, record`` for each complete node of a log, ``subtitle_blocks`` gives ``path, offset, record``
for each block between blank lines. A record belongs to the range that holds its first byte: a reader starts at the first one that
begins in its range and reads on past the end for the last one's rest, so one large file spreads over many tasks and no range needs
another. Small files share a task, and so do many small ranges. Only the bounds of records are found in Python; what is in them is parsed by expressions
(:func:`read_log_rows`, :func:`read_subtitle_rows`).

Filters on ``path`` and ``tag`` (``=`` and ``in``) reach the readers where ``spark.sql.python.filterPushdown.enabled`` is set: other files are not opened and other nodes not
decoded. A stream's offset holds for each file how far its records are complete, so a node that is still being written comes
with the batch after its end, and no record comes twice.

Defined results: a node that another one starts in, or that has no end, is no record (logs that were cut short end so); of a stream's
subtitle file the last block comes once a blank line ends it; files with a UTF-16 mark do not split; a record is UTF-8, GB 18030 or Big5, by the
first that fits; files whose names start with ``_`` or ``.`` are skipped; lines may end in LF or CRLF, not in CR alone. Options:
``path`` (a file or folder of any store that pyarrow opens), ``partitionBytes``, ``pushFilters`` (as the session is set).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..functions.scalars import decode_bytes
from .formats import log_fields, subtitle_fields

PARTITION_BYTES, CHUNK, TASKS = 64 << 20, 4 << 20, 512
# The nodes of a log.
START = re.compile(rb"<(d|gift|sc|guard)\b")
NODE = re.compile(rb"<(d|gift|sc|guard)\b[^>]*?(?:/>|>.*?</\1>)", re.DOTALL)
BLANK = re.compile(rb"\n[ \t\r]*\n")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of each file in a folder, or of the file itself."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    inside = lambda f: f.path[len(at) :].split("/")
    head = path[: len(path) - len(at)] if path.endswith(at) else path[: path.find(":") + 3] if ":" in path else ""
    return {head + f.path: f.size for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in inside(f))}


class ByteRange(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


def ranges(bounds: dict[str, tuple[int, int]], width: int) -> list[ByteRange]:
    """Ranges of up to ``width`` bytes; those of small files together, and beyond ``TASKS`` of them several to a task (of ``PARTITION_BYTES`` at most, or one)."""
    total = sum(max(0, high - low) for low, high in bounds.values())
    task = max(1, min(PARTITION_BYTES, total // TASKS) // width) * width
    out, held, used = [], [], 0
    for path, (low, high) in sorted(bounds.items()):
        while low < high:
            take = min(width - used % width, high - low)
            held.append((path, low, low + take))
            low, used = low + take, used + take
            if used == task:
                out.append(ByteRange(held))
                held, used = [], 0
    return [*out, ByteRange(held)] if held else out


def steps(low: int, high: int) -> Iterator[int]:
    """How much to read next: first the range itself, then twice as much each time, so that a small range of a large file does not read all that follows."""
    step = max(1 << 12, high - low)
    while True:
        yield min(CHUNK, step)
        step *= 2


def nodes_in(file, low: int, high: int) -> Iterator[tuple[int, str, bytes]]:
    """Complete nodes that start in [low, high): (offset, tag, bytes)."""
    file.seek(low)
    held, at, more, step = b"", low, True, steps(low, high)
    while more:
        chunk = file.read(next(step))
        more = bool(chunk)
        held += chunk
        starts = list(START.finditer(held))
        done = 0
        for i, s in enumerate(starts):
            if at + s.start() >= high:
                return
            last = i + 1 == len(starts)
            node = NODE.match(held, s.start(), len(held) if last else starts[i + 1].start())
            if node:
                yield at + s.start(), s[1].decode(), node[0]
                done = node.end()
            elif last and more:
                done = s.start()  # it may go on in the next chunk
                break
            else:
                done = s.end()
        else:
            done = max(done, len(held) - 8)  # a start may be cut by the end of the chunk
        at, held = at + done, held[done:]
        if at >= high and not START.match(held):
            return


def blocks_in(file, low: int, high: int) -> Iterator[tuple[int, str, bytes]]:
    """Blocks whose first line starts in [low, high): (offset, "", bytes)."""
    back, before = 4096, b""
    while low:
        first = max(0, low - back)
        file.seek(first)
        before = file.read(low - first)
        if first == 0 or before.count(b"\n") >= 2:
            break
        back *= 2
    # lines from the start of the file, or from the first whole one before the range
    at = low - len(before)
    if at > 0:
        skip = before.index(b"\n") + 1
        at, before = at + skip, before[skip:]
    blank, block, begin = at == 0, [], 0
    file.seek(low)
    held, more, step = before, True, steps(low, high)
    while more:
        chunk = file.read(next(step))
        more = bool(chunk)
        held += chunk
        lines = held.split(b"\n")
        held = lines.pop() if more else b""
        for line in lines:
            if not line.strip(b" \t\r"):
                if block:
                    yield begin, "", b"\n".join(block)
                blank, block = True, []
            elif block:
                block.append(line)
            elif blank:
                if at >= high:
                    return
                if at >= low:
                    block, begin = [line], at
                blank = False
            at += len(line) + 1
    if block:
        yield begin, "", b"\n".join(block)


def nodes_until(file, low: int, size: int) -> int:
    """Up to where nodes are complete: the end, or the start of a last node that has none yet."""
    back = 1 << 16
    while True:
        first = max(low, size - back)
        file.seek(first)
        tail = file.read(size - first)
        starts = list(START.finditer(tail))
        if starts or first == low:
            break
        back *= 4
    if starts and not NODE.match(tail, starts[-1].start()):
        return first + starts[-1].start()
    opened = tail.rfind(b"<", max(starts[-1].end() if starts else 0, len(tail) - 8))
    return first + opened if opened >= 0 and b">" not in tail[opened:] else size


def blocks_until(file, low: int, size: int) -> int:
    """The start of the last block that no blank line ends."""
    back = 1 << 16
    while True:
        first = max(low, size - back)
        file.seek(first)
        tail = file.read(size - first)
        ends = list(BLANK.finditer(tail))
        if ends or first == low:
            return first + ends[-1].end() if ends else low
        back *= 4


class _Files(DataSource):
    TAGS = False

    @classmethod
    def columns(cls) -> list[tuple[str, pa.DataType]]:
        return [("path", pa.string()), ("offset", pa.int64()), *([("tag", pa.string())] if cls.TAGS else []), ("record", pa.string())]

    def schema(self) -> str:
        return ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in self.columns())

    def reader(self, schema):
        options = dict(self.options)
        pushes = str(options.get("pushFilters", options.get("pushfilters", "false"))).lower() == "true"
        return (_Pushed if pushes else _Batch)(type(self), options)

    def streamReader(self, schema):
        return _Stream(type(self), dict(self.options))


class LogNodes(_Files):
    """Complete nodes of logs."""

    TAGS, inside, until = True, staticmethod(nodes_in), staticmethod(nodes_until)

    @classmethod
    def name(cls) -> str:
        return "log_nodes"


class SubtitleBlocks(_Files):
    """Blocks of subtitle files."""

    inside, until = staticmethod(blocks_in), staticmethod(blocks_until)

    @classmethod
    def name(cls) -> str:
        return "subtitle_blocks"


class _Ranges:
    """What batch and stream readers share."""

    def __init__(self, source: type[_Files], options: dict):
        self.source, self.path = source, options["path"]
        self.width = int(options.get("partitionBytes", options.get("partitionbytes", PARTITION_BYTES)))
        self.only: dict[str, list[str]] = {}

    def _records(self, part: tuple[str, int, int]) -> Iterator[tuple[int, str, bytes]]:
        import io

        path, low, high = part
        store, at = _store(path)
        with store.open_input_file(at) as file:
            if file.read(2) in (b"\xff\xfe", b"\xfe\xff"):
                if low == 0:
                    file.seek(0)
                    raw = file.read().decode("utf-16").encode()
                    yield from self.source.inside(io.BytesIO(raw), 0, len(raw))
                return
            yield from self.source.inside(file, low, high)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        columns = self.source.columns()
        tags = set(self.only["tag"]) if "tag" in self.only else None
        rows, held = [], 0
        for part in partition.parts:
            for offset, tag, raw in self._records(part):
                if tags is None or tag in tags:
                    rows.append((part[0], offset, *([tag] if self.source.TAGS else []), decode_bytes(raw)))
                    held += len(raw)
                if len(rows) >= 10_000 or held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])


class _Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        bounds = {p: (0, n) for p, n in sizes(self.path).items() if p in self.only.get("path", (p,))}
        return ranges(bounds, self.width) or [ByteRange([])]


class _Pushed(_Batch):
    """A session that does not push filters refuses readers that take them, so this is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("path",), ("tag",)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                name = f.attribute[0]
                self.only[name] = [v for v in values if v in self.only[name]] if name in self.only else values
            else:
                yield f


class _Stream(_Ranges, DataSourceStreamReader):
    def __init__(self, source: type[_Files], options: dict):
        super().__init__(source, options)
        self.known: dict[str, int] = {}
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for path, size in sizes(self.path).items():
            if size != self.seen.get(path):
                store, at = _store(path)
                with store.open_input_file(at) as file:
                    self.known[path] = self.source.until(file, self.known.get(path, 0), size)
                self.seen[path] = size
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        done, upto = json.loads(start["files"]), json.loads(end["files"])
        return ranges({p: (done.get(p, 0), n) for p, n in upto.items() if n > done.get(p, 0)}, self.width) or [ByteRange([])]

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    for source in (LogNodes, SubtitleBlocks):
        spark.dataSource.register(source)


def read_records(spark: SparkSession, kind: str, path: str, partition_bytes: int = PARTITION_BYTES, stream: bool = False) -> DataFrame:
    register(spark)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.readStream if stream else spark.read
    return reader.format(kind).option("partitionBytes", partition_bytes).option("pushFilters", pushes).load(path)


def read_log_rows(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES, stream: bool = False) -> DataFrame:
    """``path, at, t, kind, user_id, user_name, text, gift, count, price``: a log's rows, ``at`` by place in the file; as a batch or a stream."""
    nodes = read_records(spark, "log_nodes", path, partition_bytes, stream)
    return log_fields(nodes.select("path", F.col("offset").alias("at"), F.col("record").alias("n")), ["path", "at"])


def read_subtitle_rows(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES, stream: bool = False) -> DataFrame:
    """``path, at, start_ms, end_ms, text`` of the blocks with a time stamp."""
    blocks = read_records(spark, "subtitle_blocks", path, partition_bytes, stream)
    return subtitle_fields(blocks.select("path", F.col("offset").alias("at"), F.regexp_replace(F.regexp_replace("record", "^﻿", ""), "\r\n?", "\n").alias("b")), ["path", "at"])


def by_time(rows: DataFrame, *order: str) -> DataFrame:
    """Numbers a file's rows in time order from 0, for those who need it; a file is one sorted run of one task here."""
    return rows.withColumn("ord", (F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1).cast("long"))
