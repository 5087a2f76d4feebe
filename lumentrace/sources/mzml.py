"""A data source of mzML files in byte ranges: ``spark.read.format("mzml")`` after ``register``.

A plain file is cut into ranges of ``splitBytes``; a task reads the spectra whose
start tag lies in its range, to their ends, so each spectrum is read once however
the cuts fall.  Gzip cannot be cut: such a file is one task's, as a stream.  A
task holds one spectrum, one chunk of the file and one batch of rows.

A file that is cut off is an error, whatever its kind: gzip streams by their own
end, others by the closing tag that the task of the last range looks for.  In
files of several ranges spectra must carry ``index``, as the format demands; in
files of one range those without are counted.  Tags must have no prefix.  Params
may be given by reference to the groups in the file's head.

Paths are what ``pyarrow.fs`` reads: local ones, or URIs of a store; a folder
stands for all mzML files under it.
"""

from __future__ import annotations

import gzip
import re
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 4 << 20
#: A batch of rows is let go at so many spectra or peaks.
BATCH_SPECTRA, BATCH_PEAKS = 200, 200_000
#: Bytes that are enough for a closing tag with the white space after it.
TAIL = 4096
OPENS, CLOSES = re.compile(rb"<spectrum[\s>]"), b"</spectrum>"
WHOLE = re.compile(rb"</(indexed)?mzML>\s*$")
INDEX = re.compile(rb'^<spectrum[^>]*?\sindex\s*=\s*["\'](\d+)["\']')
GROUP = re.compile(rb"<referenceableParamGroup\s.*?</referenceableParamGroup>", re.S)
#: Single bytes of any encoding that holds ASCII parse as this; nothing but ASCII is read from them.
HEAD = b'<?xml version="1.0" encoding="ISO-8859-1"?>'


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int


def elements(read, begin: int, end: float):
    """(start, bytes) of the spectra that start in [begin, end) of a stream at ``begin``, each to its own end."""
    held, at, place, done = b"", begin, 0, False  # ``held`` begins at byte ``at``, ``place`` in it is looked at next
    while True:
        opening = OPENS.search(held, place)
        if opening is not None and at + opening.start() >= end:
            return
        stop = held.find(CLOSES, opening.end()) if opening is not None else -1
        if stop >= 0:
            place = stop + len(CLOSES)
            yield at + opening.start(), held[opening.start() : place]
            continue
        # What is behind goes, but for a start tag that the chunk's end may have cut.
        keep = opening.start() if opening is not None else max(place, len(held) - 16)
        if opening is None and at + keep >= end:
            return
        if done:
            if opening is not None:
                raise ValueError(f"a spectrum without an end at byte {at + opening.start()}")
            return
        # The end of a long spectrum is looked for in the new chunk only, with a tag's length before it.
        pieces, last = [held[keep:]], held[-len(CLOSES) :]
        while True:
            chunk = read(CHUNK)
            pieces.append(chunk)
            done = not chunk
            if done or opening is None or CLOSES in last + chunk:
                break
            last = (last + chunk)[-len(CLOSES) :]
        held, at, place = b"".join(pieces), at + keep, 0


class _Watched:
    """A stream that remembers the last bytes it gave, and the head up to the first spectra."""

    def __init__(self, stream):
        self.stream, self.tail, self.head, self.open = stream, b"", b"", True

    def read(self, n: int) -> bytes:
        got = self.stream.read(n)
        self.tail = (self.tail + got)[-TAIL:]
        if self.open:
            self.head += got
            found = self.head.find(b"<spectrumList")
            if found >= 0:
                self.head, self.open = self.head[:found], False
        return got


def groups_in(head: bytes) -> dict[str, list]:
    """The params of each group that a file's head defines."""
    parsed = [ElementTree.fromstring(HEAD + g) for g in GROUP.findall(head)]
    return {g.get("id"): list(g) for g in parsed}


def _resolved(element, groups: dict[str, list]):
    """``element`` with the params of groups in place of references to them."""
    for held in list(element.iter()):
        for at, child in reversed(list(enumerate(held))):
            if child.tag == "referenceableParamGroupRef":
                held[at : at + 1] = groups.get(child.get("ref"), [])
    return element


class MzmlReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", 128 << 20))
        self.level = int(options["level"]) if options.get("level") else None

    def _store(self, path: str):
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self):
        store, inner = self._store(self.path)
        about = store.get_file_info(inner)
        if about.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [about] if about.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
        found = sorted((i for i in listed if i.is_file and (about.is_file or re.search(r"(?i)\.mzml(\.gz)?$", i.path))), key=lambda i: i.path)
        ranges = []
        for info in found:
            step = info.size if self.split <= 0 or info.path.lower().endswith(".gz") else self.split
            ranges += [Range(info.path, b, min(b + step, info.size), info.size) for b in range(0, max(1, info.size), max(1, step))]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        from lumentrace.sources import files

        if not partition.path:
            return
        store, _ = self._store(self.path)
        name, rows, held = files.name_of(partition.path), [], 0
        for row in self._spectra(store, partition):
            rows.append(row | {"run": name})
            held += len(row["peaks"])
            if len(rows) == BATCH_SPECTRA or held >= BATCH_PEAKS:
                yield files.batch_of(rows)
                rows, held = [], 0
        if rows:
            yield files.batch_of(rows)

    def _spectra(self, store, part: Range):
        with store.open_input_file(part.path) as raw:
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            if packed:
                if part.begin:
                    return  # a packed file under a plain name is its first range's
                watched = _Watched(gzip.GzipFile(fileobj=raw))
                yield from self._parsed(watched.read, 0, float("inf"), watched, True)
                while watched.read(CHUNK):
                    pass
                if not WHOLE.search(watched.tail):
                    raise ValueError(f"{part.path} is cut off")
                return
            if part.end == part.size:
                raw.seek(max(0, part.size - TAIL))
                if not WHOLE.search(raw.read()):
                    raise ValueError(f"{part.path} is cut off, or no mzML")
            raw.seek(0)
            watched = _Watched(raw)
            if part.begin:
                while watched.open and watched.read(1 << 16):
                    pass
                raw.seek(part.begin)
            yield from self._parsed(watched.read, part.begin, part.end, watched, part.begin == 0 and part.end == part.size)

    def _parsed(self, read, begin, end, watched: _Watched, whole: bool):
        from lumentrace.sources import files

        groups = None
        for place, (start, held) in enumerate(elements(read, begin, end)):
            groups = groups_in(watched.head) if groups is None else groups
            found = INDEX.search(held)
            if found is None and not whole:
                raise ValueError(f"the spectrum at byte {start} has no index: read with splitBytes 0")
            element = _resolved(ElementTree.fromstring(HEAD + held), groups)
            if self.level is None or files.level_of(element) == self.level:
                yield files.spectrum_row(element, int(found[1]) if found else place)


class MzmlSource(DataSource):
    """Options: path, splitBytes (128 MB; 0 cuts nothing), level (spectra of other levels are not decoded)."""

    @classmethod
    def name(cls):
        return "mzml"

    def schema(self):
        from lumentrace.sources import files

        return files.SPECTRA

    def reader(self, schema):
        return MzmlReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MzmlSource)
