"""Binary containers: POD archives, IDICOMP payloads, ISO 9660 images, ZIP files.

``entries`` and ``zip_members`` read whole files through Spark's ``binaryFile``,
so any file system that Spark reads will do; ``PodSource`` is a Python data
source for folders that every executor sees, with one partition for each run of
entries of an archive.
"""

from __future__ import annotations

import io
import mmap
import os
import stat
import struct
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the formats.
POD1, POD2 = b"POD BAY\x01\x00", b"BAY POD\x02\x00"
PACKED = b"\x01IDICOMP"
HISTORY, CHUNK = 4098, 16384
SECTORS = ((2048, 0), (2352, 16), (2352, 24), (2448, 16), (2448, 24))
SECTOR = 2048
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_"


class FormatError(ValueError):
    """Bytes that are not what their format says."""


@dataclass(frozen=True)
class Entry:
    name: str
    offset: int
    size: int


def _letters(numbers: list[int]) -> str:
    """Symbols 1 to 37; zeros pad the end only."""
    while numbers and not numbers[-1]:
        numbers.pop()
    if any(not 1 <= n <= len(LETTERS) for n in numbers):
        raise FormatError("name has an unknown or misplaced symbol")
    return "".join(LETTERS[n - 1] for n in numbers)


def short_name(packed: bytes) -> str:
    """The 8.3 name in eight bytes: eight symbols of six bits, then three in base 38."""
    head, tail = int.from_bytes(packed[:6], "big"), int.from_bytes(packed[6:8], "big")
    stem = _letters([head >> (42 - 6 * k) & 63 for k in range(8)])
    extension = _letters([tail // 1444, tail // 38 % 38, tail % 38])
    if not stem:
        raise FormatError("name is empty")
    return stem + ("." + extension if extension else "")


def pod_entries(data: bytes) -> list[Entry]:
    """Entries of an archive of either version, all bounds checked."""
    if data[:9] == POD2:
        if len(data) < 17:
            raise FormatError("header is cut off")
        count, names_size = struct.unpack_from("<II", data, 9)
        names_at = 17 + 16 * count
        names = data[names_at : names_at + names_size]
        if len(names) < names_size:
            raise FormatError("header is cut off")
        found = []
        for at, size, offset, length in struct.iter_unpack("<IIII", data[17:names_at]):
            found.append(Entry(names[at : at + size].split(b"\0")[0].decode("latin-1"), offset, length))
        return found
    if data[:9] != POD1:
        raise FormatError("not a POD archive of a known version")
    count = int.from_bytes(data[9:13], "little")
    following = 13 + 15 * count
    if len(data) < max(13, following):
        raise FormatError("record table is cut off")
    found, seen = [], set()
    for record in range(count):
        raw = data[13 + 15 * record : 28 + 15 * record]
        one = Entry(short_name(raw[:8]), int.from_bytes(raw[8:12], "little"), int.from_bytes(raw[12:15], "little"))
        if one.name.lower() in seen:
            raise FormatError(f"name is repeated: {one.name}")
        if one.offset != following or not one.size or one.offset + one.size > len(data):
            raise FormatError(f"payload is out of place: {one.name}")
        seen.add(one.name.lower())
        following += one.size
        found.append(one)
    if following != len(data):
        raise FormatError("bytes follow the last payload")
    return found


def _expand(window: bytearray, chunk: bytes) -> None:
    """Append what one compressed chunk stands for; ``window`` is all output so far."""
    source, size = iter(chunk), len(chunk)
    used = 0

    def take() -> int:
        nonlocal used
        used += 1
        return next(source)

    try:
        while size - used >= 2:
            flags = take() | take() << 8
            for bit in range(15, -1, -1):
                if not flags >> bit & 1:
                    window.append(take())
                    continue
                first, second = take(), take()
                kind, field = first >> 4, second << 4 | first & 15
                if kind == 0:
                    window.extend(bytes([second]) * ((first & 15) + 3))
                elif kind == 1:
                    window.extend(bytes([take()]) * (field + 19))
                else:
                    length, back = (take() + 16 if kind == 2 else kind), field + 3
                    if back > len(window):
                        raise FormatError("match reaches back too far")
                    seed = bytes(window[len(window) - back :][:length])
                    window.extend((seed * (length // len(seed) + 1))[:length])
    except StopIteration:
        return


def unpack(data: bytes, strict: bool = False) -> bytes:
    """The contents of a payload; ``strict`` holds every chunk but the last to its size."""
    if data[:8] != PACKED:
        raise FormatError("payload isn't IDICOMP")
    window, at = bytearray(HISTORY), 9
    while len(data) - at >= 2:
        size = int.from_bytes(data[at : at + 2], "little", signed=True)
        at += 2
        if not size:
            break
        chunk, before = data[at : at + abs(size)], len(window)
        at += abs(size)
        if size < 0:
            window.extend(chunk)
        else:
            _expand(window, chunk)
        made = len(window) - before
        more = len(data) - at >= 2 and data[at : at + 2] != b"\0\0"
        if strict and (made > CHUNK or (made < CHUNK and more)):
            raise FormatError(f"chunk has {made} bytes")
    return bytes(window[HISTORY:])


def contents(data: bytes, entry: Entry) -> bytes:
    raw = data[entry.offset : entry.offset + entry.size]
    if len(raw) < entry.size:
        raise FormatError(f"payload is cut off: {entry.name}")
    return unpack(raw) if raw[:8] == PACKED else raw


class Image:
    """A disc image as logical sectors, whatever its sector layout."""

    def __init__(self, data: bytes):
        self.data = data
        for self.stride, self.skip in SECTORS:
            at = 16 * self.stride + self.skip
            if data[at : at + 6] == b"\x01CD001":
                break
        else:
            raise FormatError("no volume descriptor in any known sector layout")
        first = self.read(16, SECTOR)
        self.label = first[40:72].decode("latin-1").strip() or "(unlabelled)"
        self.root = struct.unpack_from("<I", first, 158)[0], struct.unpack_from("<I", first, 166)[0]

    def read(self, sector: int, size: int) -> bytes:
        count = -(-size // SECTOR)
        starts = ((sector + k) * self.stride + self.skip for k in range(count))
        return b"".join(self.data[s : s + SECTOR].ljust(SECTOR, b"\0") for s in starts)[:size]

    def walk(self, depth: int = 8) -> Iterator[tuple[str, int, int, bool]]:
        """(path, sector, size, is_directory) of everything on the disc."""
        waiting = [("", *self.root, 0)]
        while waiting:
            prefix, sector, size, level = waiting.pop()
            listing, at = self.read(sector, size), 0
            while at < len(listing):
                length = listing[at]
                if not length:  # records don't cross sectors
                    at = (at // SECTOR + 1) * SECTOR
                    continue
                record = listing[at : at + length]
                at += length
                if len(record) < 33 or record[32] == 1 and record[33:34] in (b"\0", b"\1"):
                    continue
                name = prefix + record[33 : 33 + record[32]].decode("latin-1").split(";")[0]
                place, bytes_ = struct.unpack_from("<I", record, 2)[0], struct.unpack_from("<I", record, 10)[0]
                folder = bool(record[25] & 2)
                yield name, place, bytes_, folder
                if folder and level < depth:
                    waiting.append((name + "/", place, bytes_, level + 1))


def _entry_rows(path: str, data: bytes, payloads: bool) -> Iterator[tuple]:
    try:
        for one in pod_entries(data):
            try:
                yield path, one.name, one.offset, one.size, contents(data, one) if payloads else None, None
            except FormatError as stopped:
                yield path, one.name, one.offset, one.size, None, str(stopped)
    except FormatError as stopped:
        yield path, None, None, None, None, str(stopped)


ENTRY_SCHEMA = "archive string, name string, offset bigint, size bigint, content binary, error string"
_ENTRY_NAMES = [part.split()[0] for part in ENTRY_SCHEMA.split(", ")]


def entries(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each entry of each archive below ``path``; what can't be read is a row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[aA][rR][cC]").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place, data in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for row in _entry_rows(place, bytes(data), payloads):
                    rows.append(row)
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=_ENTRY_NAMES)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_ENTRY_NAMES)

    return files.select("path", "content").mapInPandas(run, ENTRY_SCHEMA)


def disc_entries(spark: SparkSession, path: str) -> DataFrame:
    """(image, label, path, size, is_directory) of every disc image below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = ["image", "label", "path", "size", "is_directory", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    image = Image(bytes(data))
                    rows = [(place, image.label, name, size, folder, None) for name, _, size, folder in image.walk()]
                except FormatError as stopped:
                    rows = [(place, None, None, None, None, str(stopped))]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "image string, label string, path string, size bigint, is_directory boolean, error string")


MOST_RATIO = 1000


def zip_rows(place: str, data: bytes, most_bytes: int = 1 << 30) -> Iterator[tuple]:
    """(archive, name, size, content, error) of a ZIP file's members, by their raw names."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, zipfile.LargeZipFile) as stopped:
        yield place, None, None, None, f"cannot be opened: {stopped}"
        return
    with archive:
        for info in archive.infolist():
            name, problem, content = info.orig_filename, None, None
            if info.is_dir():
                continue
            if info.flag_bits & 1:
                problem = "encrypted"
            elif stat.S_ISLNK(info.external_attr >> 16):
                problem = "symbolic link"
            elif info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                problem = "compression method"
            elif info.file_size > most_bytes:
                problem = "too large"
            elif info.file_size > MOST_RATIO * max(1, info.compress_size):
                problem = "compression ratio"
            else:
                try:
                    content = archive.read(info)
                except (zipfile.BadZipFile, OSError, EOFError) as stopped:
                    problem = f"damaged: {stopped}"
                if content is not None and len(content) != info.file_size:
                    content, problem = None, "size differs"
            yield place, name, info.file_size, content, problem


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """A row for each member of each ZIP file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place, data in zip(frame["path"], frame["content"], strict=True):
                for row in zip_rows(place, bytes(data)):
                    yield pd.DataFrame([row], columns=["archive", "name", "size", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "archive string, name string, size bigint, content binary, error string")


@contextmanager
def _mapped(path: str | Path):
    """A file's bytes, of which only what is looked at is read."""
    with open(path, "rb") as file:
        if not os.fstat(file.fileno()).st_size:
            yield b""
            return
        with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield data


class _Run(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class PodReader(DataSourceReader):
    """Plans runs of entries from the archives' tables; payloads are read by the tasks alone, each its own.

    The driver reads record tables and nothing else; a task reads its archive's
    table and seeks to its entries. Archives lie in folders that all machines see.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.run = int(options.get("entriesPerPartition", 256))

    def partitions(self):
        found = []
        for path in sorted(Path(self.path).rglob("*")):
            if path.suffix.lower() == ".arc":
                with _mapped(path) as data:
                    count = len(pod_entries(data))
                found += [_Run(str(path), k, min(count, k + self.run)) for k in range(0, count, self.run)]
        return found

    def read(self, partition: _Run):
        with _mapped(partition.path) as data:
            for one in pod_entries(data)[partition.first : partition.last]:
                try:
                    yield partition.path, one.name, one.offset, one.size, contents(data, one), None
                except FormatError as stopped:
                    yield partition.path, one.name, one.offset, one.size, None, str(stopped)


class PodSource(DataSource):
    """``spark.dataSource.register(PodSource)``, then ``spark.read.format("podarc").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "podarc"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> PodReader:
        return PodReader(self.options)
