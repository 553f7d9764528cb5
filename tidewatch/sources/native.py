"""Python data sources: sections between markers, records of XML in archives, and pages of a list that resumes where it stopped.

They read streams in chunks, so a task holds a chunk and what it keeps, however long a file is. Paths are what pyarrow's file systems open
(local ones and those with a scheme of theirs).
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tidewatch.session import ship

TITLE = b"<TITLE"
#: What is kept to look for a title before the first marker, once more than the limit was read without one.
BEFORE = 8 * 1024
#: Files up to this much together are one partition.
TOGETHER = 64 << 20
#: Rows of an Arrow batch.
ROWS = 10_000


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub("^file:/*", "/", path))


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files of a folder and those below it, in order."""
    from pyarrow import fs

    where, base = _open(path)
    scheme = path[: path.index("://")] if "://" in path else "file"
    info = where.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f"{scheme}://{f.path}", f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def streams(path: str) -> Iterator[tuple[str | None, io.BufferedIOBase]]:
    """(entry, stream) of a file, or of each entry of an archive, unpacked as it is read."""
    where, base = _open(path)
    with where.open_input_file(base) as f:
        if f.read(2) == b"PK":
            f.seek(0)
            with zipfile.ZipFile(f) as z:
                for entry in z.infolist():
                    if not entry.is_dir():
                        with z.open(entry) as stream:
                            yield entry.filename, stream
        else:
            f.seek(0)
            yield None, f


class Paths(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def packed(found: list[tuple[str, int]]) -> list[Paths]:
    """Files in their order, put together up to TOGETHER bytes."""
    out: list[list[str]] = []
    room = 0
    for path, size in found:
        if size > room or not out:
            out.append([])
            room = TOGETHER
        out[-1].append(path)
        room -= size
    return [Paths(p) for p in out]


# ------------------------------------------------------------------ sections


class Section:
    """Collects what lies between two markers of a stream that comes in chunks.

    The section begins at the last title before the first marker (where there is none, as far back as is kept) and ends before
    the last title in front of the next one, or at that one; if it has not ended when a chunk takes it beyond ``most`` bytes, it is cut there. Only what a chunk adds is searched, with as much
    of what came before as a marker may reach back.
    """

    def __init__(self, start: bytes, end: bytes, most: int):
        self.start, self.end, self.most = start, end, most
        self.held, self.found, self.done, self.truncated, self.searched = bytearray(), False, False, False, 0

    def feed(self, chunk: bytes) -> bool:
        """Take a chunk; whether the section is whole."""
        self.held += chunk
        if not self.found:
            at = self.held.find(self.start, max(0, self.searched - len(self.start) + 1))
            if at < 0:
                title = self.held.rfind(TITLE)
                if title > 0:
                    del self.held[:title]
                if len(self.held) > self.most:
                    del self.held[: len(self.held) - min(BEFORE, self.most)]
                self.searched = len(self.held)
                return False
            self.found = True
            title = max(0, self.held.rfind(TITLE, 0, at + len(TITLE) - 1))
            del self.held[:title]
            self.searched = at - title + len(self.start) + len(self.end) - 1
        at = self.held.find(self.end, max(0, self.searched - len(self.end) + 1))
        self.searched = len(self.held)
        if at >= 0:
            title = self.held.rfind(TITLE, 0, at)
            del self.held[title if title > 0 else at :]
            self.done = True
        elif len(self.held) > self.most:
            del self.held[self.most :]
            self.done = self.truncated = True
        return self.done


def section(stream, start: bytes, end: bytes, most: int, scan: int, chunk: int) -> tuple[Section, int]:
    """The section of a stream and how many bytes were read; ValueError where more than ``scan`` would be."""
    found, read = Section(start, end, most), 0
    while data := stream.read(chunk):
        read += len(data)
        if read > scan:
            raise ValueError(f"no end within {scan} bytes")
        if found.feed(data):
            break
    return found, read


class SectionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.end = options["start"].encode("ascii"), options["end"].encode("ascii")
        self.most, self.scan, self.chunk = (int(options.get(k, d)) for k, d in (("most", 4 << 20), ("scan", 120 << 20), ("chunk", 1 << 20)))

    def partitions(self):
        return packed(files(self.path))

    def read(self, partition):
        for path in partition.paths:
            kept, entry_of, read, error = None, None, 0, None
            try:
                for entry, stream in streams(path):
                    found, n = section(stream, self.start, self.end, self.most, self.scan - read, self.chunk)
                    read += n
                    if found.found:
                        kept, entry_of = found, entry
                        break
            except (ValueError, zipfile.BadZipFile) as e:
                error = str(e)
            if read or error:
                yield path, entry_of, None if kept is None else bytes(kept.held), kept is not None and kept.truncated, read, error


class SectionSource(DataSource):
    """Sections of files and of entries of archives: options path, start, end; most, scan, chunk in bytes.

    Of an archive the first entry counts that has the first marker. A file that holds more than ``scan`` bytes before its section
    ends, or a damaged archive, has an error instead of a section.
    """

    @classmethod
    def name(cls):
        return "tidewatch_sections"

    def schema(self):
        return "path string, entry string, section binary, truncated boolean, scanned long, error string"

    def reader(self, schema):
        return SectionReader(self.options)


# ------------------------------------------------------------------- records


def records(stream, record: str, fields: list[str], chunk: int = 1 << 16) -> Iterator[tuple]:
    """The texts of the named children of each element ``record``, as they come; blank ones are null.

    Document types are refused, so that there are no entities to expand or to fetch.
    """
    parser = expat.ParserCreate()
    parser.buffer_text = True
    done: list[tuple] = []
    state: dict = {"row": None, "name": None, "text": []}

    def refuse(*_):
        raise ValueError("a document type is not allowed")

    def start(tag, _):
        if tag == record:
            state["row"] = {}
        elif state["row"] is not None:
            state["name"], state["text"] = tag, []

    def end(tag):
        row = state["row"]
        if tag == record and row is not None:
            done.append(tuple(row.get(f) for f in fields))
            state["row"] = None
        elif row is not None and state["name"] == tag:
            row[tag] = "".join(state["text"]).strip() or None
            state["name"] = None

    def text(data):
        if state["name"] is not None:
            state["text"].append(data)

    parser.StartDoctypeDeclHandler, parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = refuse, start, end, text
    while data := stream.read(chunk):
        parser.Parse(data, False)
        yield from done
        done.clear()
    parser.Parse(b"", True)
    yield from done


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.path, self.record, self.fields = options["path"], options["record"], fields

    def partitions(self):
        return packed(files(self.path))

    def read(self, partition):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], self.fields)

        for path in partition.paths:
            for _, stream in streams(path):
                for row in records(stream, self.record, self.fields):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()


class RecordSource(DataSource):
    """XML records as rows of text: options path and record (the element); the schema names its children. Files may be in archives."""

    @classmethod
    def name(cls):
        return "tidewatch_records"

    def reader(self, schema: StructType):
        return RecordReader(self.options, schema.names)


# --------------------------------------------------------------------- pages


def page(path: str, number: int) -> dict | None:
    """A landed page of a list, ``<path>/<number>.json``; None if it is not there yet."""
    from pyarrow import fs

    where, base = _open(path)
    name = f"{base.rstrip('/')}/{number}.json"
    if where.get_file_info(name).type != fs.FileType.File:
        return None
    with where.open_input_stream(name) as f:
        return json.loads(f.read())


class PageReader(SimpleDataSourceStreamReader):
    """Which pages a batch has to take: a row a page, at most ``quota`` of them, so that no row of the list passes the driver.

    An offset is a page and the last receipt taken from it. The list only grows at its end: a page that was not full is taken again from behind
    that receipt, and a batch that is repeated names the same pages and receipts.
    """

    def __init__(self, options: dict):
        self.path, self.key, self.quota = options["path"], options.get("key", "rcept_no"), int(options.get("quota", 100))

    def initialOffset(self):
        return {"page": 1, "last": ""}

    def read(self, start: dict):
        end, number = dict(start), start["page"]
        for number in range(start["page"], start["page"] + self.quota):
            found = page(self.path, number)
            if found is None:
                break
            last = max((r[self.key] for r in found.get("list") or []), default="")
            end = {"page": number, "last": max(last, start["last"] if number == start["page"] else "")}
            if number >= int(found.get("total_page", number)):
                break
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        if start == end:
            return iter([])
        pages = range(start["page"], end["page"] + 1)
        return iter([(n, start["last"] if n == start["page"] else "", end["last"] if n == end["page"] else None) for n in pages])


class PageSource(DataSource):
    """A stream of pages to take: options path, key (receipt, ascending) and quota (pages in a batch)."""

    @classmethod
    def name(cls):
        return "tidewatch_pages"

    def schema(self):
        return "page int, after string, upto string"

    def simpleStreamReader(self, schema):
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known to the session and the package to its workers."""
    ship(spark)
    for source in (SectionSource, RecordSource, PageSource):
        spark.dataSource.register(source)


def listed(spark: SparkSession, path: str, schema: str, key: str = "rcept_no", quota: int = 100) -> DataFrame:
    """A stream of the rows of a landed list, each once: at most ``quota`` pages in a batch, going on behind the last receipt taken.

    ``schema`` names the rows' fields, all text. Pages are read by the tasks.
    """
    register(spark)
    fields = [f.split()[0] for f in schema.split(", ")]

    def take(batches):
        for batch in batches:
            for number, after, upto in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                rows = [r for r in page(path, number).get("list") or [] if r[key] > after and (upto is None or r[key] <= upto)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], pa.string()) for f in fields], fields)

    pages = spark.readStream.format("tidewatch_pages").option("path", path).option("key", key).option("quota", quota).load()
    return pages.repartition(F.col("page")).mapInArrow(take, schema)
