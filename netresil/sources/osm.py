"""OSM XML as a splittable data source: ``spark.read.format("osm_xml")``.

A file is cut into byte ranges, one task each; small files share a task. An
element belongs to the range its first byte lies in, so a task skips to the first element that begins in its
range and reads on until one begins beyond it. Elements are parsed some
megabytes at a time; memory does not grow with the file or the range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "node": "id BIGINT, lat DOUBLE, lon DOUBLE",
    "way": "id BIGINT, refs ARRAY<BIGINT>, tags ARRAY<STRUCT<k: STRING, v: STRING>>",
}
ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64())]),
    "way": pa.schema([
        ("id", pa.int64()), ("refs", pa.list_(pa.int64())),
        ("tags", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))),
    ]),
}
#: Bytes of one task and of one read, and tasks that small files are spread over before one gets more than a read.
RANGE_BYTES, CHUNK_BYTES, SPREAD = 64 << 20, 4 << 20, 64
#: Where an element of the top level begins; ``<`` is escaped everywhere else.
BEGIN = re.compile(rb"<(?:node|way|relation|changeset)(?=[\s/>])")
#: Longest match of BEGIN and the byte after it.
LONGEST = len(b"<changeset ")
COMPRESSED = (".gz", ".bz2")


@dataclass
class Range:
    """Bytes ``start`` to ``end`` of a file; compressed files are one range without an end."""

    path: str
    start: int
    end: int | None


@dataclass
class Share(InputPartition):
    """What one task reads."""

    ranges: list[Range]


def files(uri: str) -> list[tuple[str, int]]:
    """Path and size of a file, of every file below a folder, or of those a pattern matches.

    Hidden files and those of unfinished or finished writes (``.x``, ``_x``) are left out.
    """
    system, path = fs.FileSystem.from_uri(uri)
    wild = re.search(r"[*?\[]", path)
    root = path[:wild.start()].rpartition("/")[0] if wild else path
    info = system.get_file_info(root or "/")
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(root or "/", recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f.path, f.size) for f in shown if not wild or fnmatch(f.path, path))


class OsmSource(DataSource):
    """Options: ``path`` (file, folder or pattern), ``element`` (``node`` or ``way``), ``rangeBytes``.

    Files are read by pyarrow's file systems, so ``path`` is a local path or a
    URI of one of them (file, hdfs, s3, gs). Text is UTF-8, as OSM writes it.
    Comments must not hold elements. A missing or malformed number is null. Compressed files
    (``.gz``, ``.bz2``) cannot be cut and take one task each.
    """

    @classmethod
    def name(cls) -> str:
        return "osm_xml"

    def element(self) -> str:
        kind = self.options.get("element", "node")
        if kind not in SCHEMAS:
            raise ValueError(f"element must be one of {sorted(SCHEMAS)}, not {kind!r}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self.element()]

    def reader(self, schema) -> DataSourceReader:
        return OsmReader(self.options["path"], self.element(), int(self.options.get("rangeBytes", RANGE_BYTES)))


class OsmReader(DataSourceReader):
    def __init__(self, uri: str, element: str, step: int):
        if step < 1:
            raise ValueError("rangeBytes must be positive")
        self.uri, self.kind, self.step = uri, element, step

    def partitions(self) -> list[Share]:
        found = files(self.uri)
        most = min(self.step, max(CHUNK_BYTES, sum(size for _, size in found) // SPREAD))
        out, held = [], 0
        for path, size in found:
            # a compressed file is one range of unknown length, and its task's only one
            whole = path.endswith(COMPRESSED)
            for at in [0] if whole else range(0, size, self.step):
                part = Range(path, at, None if whole else min(at + self.step, size))
                length = self.step if whole else part.end - at
                if not out or held + length > most:
                    out.append(Share([]))
                    held = 0
                out[-1].ranges.append(part)
                held += length
        return out or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for span in partition.ranges:
            yield from self._read(span)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.uri)[0]
        for text in elements(system, partition):
            try:
                top = ElementTree.fromstring(b"<osm>" + text + b"</osm>")
            except ElementTree.ParseError as e:
                raise ValueError(f"{partition.path}, bytes from {partition.start}: {e}") from e
            rows = list(map(ROW[self.kind], top.iterfind(self.kind)))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW[self.kind])


def elements(system: fs.FileSystem, span: Range) -> Iterator[bytes]:
    """Whole elements that begin in the range, some megabytes of them at a time."""
    if span.end is None:
        stream = system.open_input_stream(span.path, compression="detect")
    else:
        stream = system.open_input_file(span.path)
        stream.seek(span.start)
    with stream:
        held, base, begun, last = b"", span.start, False, False  # base: where ``held`` begins in the file
        while not last:
            more = stream.read(CHUNK_BYTES)
            last = not more
            seen = max(0, len(held) - LONGEST)
            held += more
            if not begun:
                first = BEGIN.search(held)
                if first is None:
                    keep = 0 if last else min(len(held), LONGEST)
                    base, held = base + len(held) - keep, held[len(held) - keep:]
                    if span.end is not None and base >= span.end:
                        return
                    continue
                base, held, begun, seen = base + first.start(), held[first.start():], True, 0
                if span.end is not None and base >= span.end:
                    return
            # the last begin held; what follows it may be unfinished
            cut = 0
            for m in BEGIN.finditer(held, seen):
                if m.start() == 0:
                    continue
                cut = m.start()
                if span.end is not None and base + cut >= span.end:
                    yield held[:cut]
                    return
            if cut:
                yield held[:cut]
                base, held = base + cut, held[cut:]
        if begun:
            close = re.search(rb"</osm(?:Change)?\s*>\s*\Z", held)
            yield held[:close.start()] if close else held


def _number(kind, text: str | None):
    try:
        return None if text is None else kind(text)
    except ValueError:
        return None


def _node(e) -> dict:
    return {"id": _number(int, e.get("id")), "lat": _number(float, e.get("lat")), "lon": _number(float, e.get("lon"))}


def _way(e) -> dict:
    return {
        "id": _number(int, e.get("id")), "refs": [_number(int, n.get("ref")) for n in e.iterfind("nd")],
        "tags": [{"k": t.get("k"), "v": t.get("v")} for t in e.iterfind("tag")],
    }


ROW = {"node": _node, "way": _way}
