"""Mail files read by byte ranges: mailboxes and archives of mails of any size, spread over tasks.

A table of files ``(path, length)`` becomes a table of ranges, which Spark deals to tasks; a task
opens its file where its range starts. Nothing is listed or held in the driver, and no task
holds more than one message beside its buffer. The same functions stand behind the data
source ``lettermill-mbox``, for ``spark.read`` and ``spark.readStream``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: bytes of a range, and of one read inside it
SPLIT_BYTES = 64 << 20
_READ = 4 << 20
#: a batch of messages leaves a task once it holds so many rows or bytes
_ROWS, _BYTES = 500, 8 << 20


def open_file(path: str) -> pa.NativeFile:
    """A file, by path as Spark's listing of binary files gives it, for reads at any place."""
    system, place, _ = _placed(path)
    return system.open_input_file(place)


def _placed(path: str) -> tuple[pafs.FileSystem, str, str]:
    """A file system, the place in it, and what goes before places to make paths again."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path), ""
    system, place = pafs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system, place, path.removesuffix(place)


def list_files(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    """``(path, length)`` of the files below a folder whose names match a glob pattern; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return found.load(folder).select("path", "length")


def _tasks(files: DataFrame, size: int, most: int = 100_000) -> int:
    """A task for every ``size`` bytes of files. Rows that name places are small and work is not, so
    adaptive execution, which joins small partitions, is given a number to keep."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return max(1, min(most, -(-total // size)))


def ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, start, stop)``: files cut into ranges of ``split_bytes``, one range a row, dealt evenly. An empty file has none."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    cut = files.where("length > 0").select("path", "length", at.alias("start"))
    stop = F.least(F.col("start") + split_bytes, F.col("length"))
    return cut.select("path", "start", stop.alias("stop")).repartition(_tasks(files, split_bytes), "path", "start")


# mailboxes


def records(file: Any, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, bytes)`` of the records of a mailbox that start in ``[start, stop)``, with their ``From `` lines.

    A record starts where a line starts with ``From ``; what stands before the first one is no record. The
    last record of a range is read to its end, wherever that lies.
    """
    mark = b"\nFrom "
    base = max(0, start - 1)  # a record at ``start`` is seen by the line end before it
    file.seek(base)
    held = b"\n" if base == start else b""
    base -= len(held)
    begun, scanned = None, 0
    while True:
        more = file.read(_READ)
        held += more
        while (found := held.find(mark, scanned)) >= 0:
            if begun is not None:
                yield base + begun, held[begun : found + 1]
            begun = found + 1
            if base + begun >= stop:
                return
            scanned = found + 1
        if not more:
            if begun is not None:
                yield base + begun, held[begun:]
            return
        if begun is None and base + len(held) - len(mark) >= stop:
            return
        # what is done with goes; a mark may lie across two reads
        keep = begun if begun is not None else max(0, len(held) - len(mark) + 1)
        held, base, scanned = held[keep:], base + keep, max(0, len(held) - len(mark) + 1 - keep)
        begun = 0 if begun is not None else None


def message(record: bytes) -> bytes:
    """A record without its ``From `` line, and its quoted ``>From `` lines with one ``>`` less."""
    return re.sub(rb"(?m)^>(>*From )", rb"\1", record.partition(b"\n")[2])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= _ROWS or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_MAIL = pa.schema([("file_path", pa.string()), ("ordinal", pa.int64()), ("raw", pa.binary())])


def _mails(path: str, start: int, stop: int) -> Iterator[tuple[str, int, bytes]]:
    with open_file(path) as file:
        for offset, record in records(file, start, stop):
            yield path, offset, message(record)


def read_mbox_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file_path, ordinal, raw)`` of the messages of mailboxes ``(path, length)``, in one pass over the files.

    ``ordinal`` is the byte at which a message's record starts, so it is the same for any split size.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(_mails(path, start, stop), _MAIL)

    return ranges(files, split_bytes).mapInArrow(kernel, "file_path string, ordinal long, raw binary")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _cut(path: str, start: int, stop: int, split_bytes: int) -> list[_Range]:
    return [_Range(path, at, min(at + split_bytes, stop)) for at in range(start, stop, split_bytes)]


def _sizes(folder: str, pattern: str) -> dict[str, int]:
    """Bytes by path of a folder's files, or of the one file."""
    system, place, prefix = _placed(folder)
    found = system.get_file_info(place)
    infos = [found] if found.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(place, recursive=True, allow_not_found=True))
    return {prefix + x.path: x.size for x in infos if x.type == pafs.FileType.File and re.search(pattern, x.base_name)}


class _MboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Range]:
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        sizes = _sizes(self.options["path"], self.options.get("pattern", r"(?i)\.mbox$|^mbox$"))
        return [r for path in sorted(sizes) for r in _cut(path, 0, sizes[path], split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(_mails(partition.path, partition.start, partition.stop), _MAIL)


class _MboxStream(DataSourceStreamReader):
    """Offsets are the bytes of each mailbox that have been read. A mailbox that grows is read on from
    there: of a last record that may still grow only whole ones are taken, those with another behind them,
    unless ``closed`` says that files are complete when they appear."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.closed = options.get("closed", "true").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sizes = _sizes(self.options["path"], self.options.get("pattern", r"(?i)\.mbox$|^mbox$"))
        return sizes if self.closed else {path: _last_record(path, size) for path, size in sizes.items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        return [r for path in sorted(end) for r in _cut(path, start.get(path, 0), end[path], split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(_mails(partition.path, partition.start, partition.stop), _MAIL)


def _last_record(path: str, size: int) -> int:
    """Where the last record of a mailbox starts; 0 where there is none."""
    with open_file(path) as file:
        stop = size
        while stop > 0:
            start = max(0, stop - _READ)
            file.seek(start)
            at = file.read(min(size, stop + 6) - start).rfind(b"\nFrom ")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


class MboxSource(DataSource):
    """``spark.read.format("lettermill-mbox").load(folder)`` and its ``readStream``; options ``splitBytes``,
    ``pattern`` (of file names) and ``closed``."""

    @classmethod
    def name(cls) -> str:
        return "lettermill-mbox"

    def schema(self) -> str:
        return "file_path string, ordinal long, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return _MboxReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _MboxStream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(MboxSource)
    return spark


# archives of mails

#: Fixed values of the zip format: marks of the directory's end, of its large form, and of entries.
_END, _END64_PLACE, _END64, _ENTRY = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2"


def zip_directory(file: Any, length: int) -> Iterator[tuple[int, str, int, int, int, int, int]]:
    """``(ordinal, name, offset, packed, size, method, crc)`` of the entries of an archive.

    Only the directory at the archive's end is read, piece by piece. Raises ``ValueError`` where there is none.
    """
    file.seek(max(0, length - 65_557))  # the end's record and the longest comment
    tail = file.read()
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no directory")
    count, span, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    own = length - len(tail) + at  # where the end's record stands
    if at >= 20 and tail[at - 20 : at - 16] == _END64_PLACE:
        file.seek(struct.unpack("<Q", tail[at - 12 : at - 4])[0])
        large = file.read(56)
        if large[:4] != _END64:
            raise ValueError("no large directory")
        count, span, start = struct.unpack("<QQQ", large[32:56])
        own -= 76
    shift = max(0, own - span - start)  # bytes before the archive, of a self-extracting one
    file.seek(start + shift)
    held = b""
    for ordinal in range(count):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack("<HHH", held[28:34])):
            more = file.read(_READ)
            if not more:
                raise ValueError("directory ends early")
            held += more
        if held[:4] != _ENTRY:
            raise ValueError("directory is broken")
        flags, method = struct.unpack("<HH", held[8:12])
        crc, packed, size, n_name, n_extra, n_note = struct.unpack("<IIIHHH", held[16:34])
        (offset,) = struct.unpack("<I", held[42:46])
        name = held[46 : 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = held[46 + n_name : 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # numbers that need 64 bits, in this order, those alone that do
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                size = next(values, size) if size == 0xFFFFFFFF else size
                packed = next(values, packed) if packed == 0xFFFFFFFF else packed
                offset = next(values, offset) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        held = held[46 + n_name + n_extra + n_note :]
        yield ordinal, name, offset + shift, packed, size, -1 if flags & 1 else method, crc


_ENTRIES = "path string, ordinal long, name string, offset long, packed long, size long, method int, crc long"


def list_entries(archives: DataFrame) -> DataFrame:
    """``(path, ordinal, name, offset, packed, size, method, crc)`` of the entries of archives ``(path, length)``.

    A task reads directories only. A file that is no archive has no entries; ``method`` is -1 where an
    entry is encrypted.
    """
    names = [x.split()[0] for x in _ENTRIES.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), *((n, pa.int64()) for n in names[3:6]), ("method", pa.int32()), ("crc", pa.int64())])
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    with open_file(path) as file:
                        for entry in zip_directory(file, length):
                            rows.append((path, *entry))
                            if len(rows) >= 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                                rows = []
                except (ValueError, struct.error):
                    pass  # what was read of a directory before it broke stays
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("path", "length").repartition("path").mapInArrow(kernel, _ENTRIES)


def inflate(file: Any, offset: int, packed: int, size: int, method: int, crc: int) -> bytes | None:
    """One entry's bytes by reads of its own range; None where it is encrypted, packed otherwise or broken."""
    file.seek(offset)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4" or method not in (0, 8):
        return None
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    file.seek(offset + 30 + n_name + n_extra)
    body = file.read(packed)
    if method == 8:
        try:
            body = zlib.decompressobj(-15).decompress(body, size + 1)
        except zlib.error:
            return None
    return body if len(body) == size and zlib.crc32(body) == crc else None


def read_eml_archives(archives: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """``(file_path, source_path, ordinal, raw)`` of the ``.eml`` entries of archives ``(path, length)``.

    Entries are dealt by ``block_bytes`` of their archive, so one large archive is work for many tasks,
    each reading its own ranges. ``ordinal`` is an entry's place in the directory, ``source_path`` its folder.
    Folders, resource forks, encrypted and broken entries are left out.
    """
    mails = list_entries(archives).where(F.lower("name").endswith(".eml") & ~F.col("name").startswith("__MACOSX/"))
    dealt = mails.withColumn("block", (F.col("offset") / block_bytes).cast("long")).repartition(_tasks(archives, block_bytes), "path", "block").sortWithinPartitions("path", "offset")
    schema = pa.schema([("file_path", pa.string()), ("source_path", pa.string()), ("ordinal", pa.int64()), ("raw", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, str, int, bytes]]:
            at, file = None, None
            for batch in batches:
                for path, ordinal, name, *place in zip(*(batch.column(c).to_pylist() for c in ("path", "ordinal", "name", "offset", "packed", "size", "method", "crc"))):
                    if path != at:
                        if file is not None:
                            file.close()
                        at, file = path, open_file(path)
                    raw = inflate(file, *place)
                    if raw is not None:
                        yield path, name.rpartition("/")[0], ordinal, raw
            if file is not None:
                file.close()

        yield from _batches(rows(), schema)

    return dealt.mapInArrow(kernel, "file_path string, source_path string, ordinal long, raw binary")


def write_eml_archives(mails: DataFrame, folder: str) -> None:
    """Writes ``(name, raw)`` as zip archives in a folder, one a partition; a repeated task replaces its own."""
    import uuid
    import zipfile

    run = uuid.uuid4().hex

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place, _ = _placed(f"{folder}/{TaskContext.get().partitionId():05d}-{run}.zip")
        system.create_dir(place.rpartition("/")[0], recursive=True)
        n = 0
        with system.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    archive.writestr(name, raw.as_py())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    mails.select("name", "raw").where("raw is not null").mapInArrow(kernel, "n long").agg(F.sum("n")).first()
