"""Data sources for record formats that aren't lines of text: BAM, after the public SAM/BAM
specification, FASTQ, and FASTA in chunks.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").load("folder or file")

A path is a file or a folder (its files whose name starts with a letter or digit), in any
file system that pyarrow reaches. Files are read as streams, so a task holds a batch of
records however large the file is. A BAM file beside which its BAI index stands is split at
places that the index names. With the option ``narrow`` (true), in a session that sets
``spark.sql.python.filterPushdown.enabled``, only its blocks that can hold records that
filters on ``rname`` and ``pos`` ask for are read. Other files are one partition each, since
records can't be found from the middle of a file without an index.
"""

from __future__ import annotations

import gzip
import io
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

BATCH = 5000
#: Fixed values of the BAM specification: bases by 4-bit code, CIGAR operations by number,
#: and the sizes of the types of tags and arrays.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TYPES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_PAIRS = [BASES[i >> 4] + BASES[i & 15] for i in range(256)]


#: Compressed bytes of a partition of an indexed file, about, and bytes read at once.
SPLIT, READ = 64 << 20, 1 << 20
#: Fixed values of the BAI format: the bin of its statistics, and by level of bins the first
#: one and the power of two of its size.
STATISTICS, LEVELS = 37_450, ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))


@dataclass
class FilePartition(InputPartition):
    path: str
    #: Virtual file offsets (of a block << 16 | within it) of the first record and of the
    #: first one that isn't of this partition; None: from the first record, to the end.
    start: int | None = None
    end: int | None = None


class _FileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def paths(self) -> list[str]:
        files, at = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else fs_path(self.path))
        root = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [root + at]
        found = files.get_file_info(fs.FileSelector(at))
        some = [f for f in found if f.type == fs.FileType.File and f.base_name[:1].isalnum() and not f.base_name.endswith(self.BESIDE)]
        return [root + f.path for f in sorted(some, key=lambda f: f.path)]

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(path) for path in self.paths()]

    #: Ends of names of files that stand beside others and aren't read as such.
    BESIDE: tuple[str, ...] = ()

    def records(self, data: BinaryIO) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(partition.path)
        with files.open_input_stream(at, compression=None) as raw:
            yield from self.batches(self.records(_plain(raw)))

    def batches(self, records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in records:
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows, self.SCHEMA)
                rows = []
        if rows:
            yield _batch(rows, self.SCHEMA)


def fs_path(path: str) -> str:
    return "file://" + os.path.abspath(path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _plain(raw) -> BinaryIO:
    """The stream, unpacked if it is gzip (BGZF is gzip in many members)."""
    buffered = io.BufferedReader(raw, 1 << 20)
    return gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered


class Blocks:
    """The uncompressed stream of a BGZF file from one virtual offset to another."""

    def __init__(self, file, start: int = 0, end: int | None = None):
        self.file, self.size, self.end = file, file.size(), end
        self.held, self.held_at = b"", 0
        self.at, self.next, self.data, self.place = start >> 16, start >> 16, b"", 0
        self._load()
        self.place = start & 0xFFFF

    def _bytes(self, at: int, n: int) -> bytes:
        if not (self.held_at <= at and at + n <= self.held_at + len(self.held)):
            self.held_at, self.held = at, self.file.read_at(max(n, min(READ, self.size - at)), at)
        return self.held[at - self.held_at : at - self.held_at + n]

    def _load(self) -> bool:
        """The next block that isn't empty."""
        self.data, self.place = b"", 0
        while not self.data:
            self.at = self.next
            if self.at >= self.size:
                return False
            head = self._bytes(self.at, 12)
            (extra,) = struct.unpack_from("<H", head, 10)
            fields, k, length = self._bytes(self.at + 12, extra), 0, None
            while k < extra:
                tag, (n,) = fields[k : k + 2], struct.unpack_from("<H", fields, k + 2)
                if tag == b"BC":
                    (length,) = struct.unpack_from("<H", fields, k + 4)
                k += 4 + n
            if head[:4] != b"\x1f\x8b\x08\x04" or length is None:
                raise ValueError(f"no BGZF block at byte {self.at}")
            body = self._bytes(self.at + 12 + extra, length + 1 - 20 - extra)
            self.data, self.next = zlib.decompress(body, -15), self.at + length + 1
        return True

    def over(self) -> bool:
        """Whether the end, or that of the file, is reached."""
        if self.place == len(self.data) and not self._load():
            return True
        return self.end is not None and (self.at << 16 | self.place) >= self.end

    def read(self, n: int) -> bytes:
        out = self.data[self.place : self.place + n]
        self.place += len(out)
        while len(out) < n and self._load():
            more = self.data[: n - len(out)]
            self.place = len(more)
            out += more
        return out


@dataclass
class Index:
    """Of a BAI file, by number of the contig: chunks by bin, and the linear index."""

    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[list[int]]

    @classmethod
    def parse(cls, data: bytes) -> Index:
        if data[:4] != b"BAI\x01":
            raise ValueError("no BAI file")
        (contigs,), at, bins, linear = struct.unpack_from("<i", data, 4), 8, [], []
        for _ in range(contigs):
            (n,) = struct.unpack_from("<i", data, at)
            at, own = at + 4, {}
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", data, at)
                places = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
                at += 8 + 16 * chunks
                if number != STATISTICS:
                    own[number] = list(zip(places[::2], places[1::2], strict=True))
            (n,) = struct.unpack_from("<i", data, at)
            bins.append(own)
            linear.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n
        return cls(bins, linear)

    def starts(self) -> list[int]:
        """Places of records, in order."""
        found = {a for own in self.bins for chunks in own.values() for a, _ in chunks}
        return sorted(found | {a for own in self.linear for a in own if a})

    def chunks(self, contig: int, first: int, last: int) -> list[tuple[int, int]]:
        """Ranges that have all records of a contig that begin at 0-based ``first`` to
        ``last``, in order and apart."""
        if not 0 <= contig < len(self.bins):
            return []
        linear = self.linear[contig]
        least = linear[min(first >> 14, len(linear) - 1)] if linear else 0
        wanted = {n + k for n, power in LEVELS for k in range(first >> power, (last >> power) + 1)} if last >> 14 < 1 << 15 else set(self.bins[contig])
        out: list[tuple[int, int]] = []
        for a, z in sorted(c for n, chunks in self.bins[contig].items() if n in wanted for c in chunks):
            if z <= least:
                continue
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(z, out[-1][1])
            else:
                out.append((a, z))
        return out


class BamReader(_FileReader):
    BESIDE = (".bai",)

    def __init__(self, path: str):
        super().__init__(path)
        self.contig: str | None = None
        self.first, self.last = 0, (1 << 29) - 1  # 0-based

    def partitions(self) -> list[FilePartition]:
        out = []
        for path in self.paths():
            files, at = fs.FileSystem.from_uri(path)
            beside = next((x for x in (at + ".bai", at.removesuffix(".bam") + ".bai") if files.get_file_info(x).type == fs.FileType.File), None)
            if beside is None:
                out.append(FilePartition(path))
                continue
            with files.open_input_stream(beside, compression=None) as f:
                index = Index.parse(f.read())
            if self.contig not in (None, "*"):
                with files.open_input_file(at) as f:
                    names = _contigs(Blocks(f))
                if self.contig in names and self.first <= self.last:
                    ranges = index.chunks(names.index(self.contig), max(self.first, 0), self.last)
                    out += [FilePartition(path, a, z) for lo, hi in ranges for a, z in _split(index.starts(), lo, hi)]
                continue
            out += [FilePartition(path, a, z) for a, z in _split(index.starts(), None, None)]
        return out

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition.start is None and partition.end is None:
            yield from super().read(partition)
            return
        files, at = fs.FileSystem.from_uri(partition.path)
        with files.open_input_file(at) as f:
            head = Blocks(f)
            names = _contigs(head)
            part = head if partition.start is None else Blocks(f, partition.start)
            part.end = partition.end
            yield from self.batches(_bam_records(part, names))

    SCHEMA = pa.schema(
        [("qname", pa.string()), ("flag", pa.int64()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int64()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]
    )

    def records(self, data: BinaryIO) -> Iterator[tuple]:
        names = _contigs(data)
        while size := data.read(4):
            yield _bam_record(data.read(*struct.unpack("<i", size)), names)


def _contigs(data) -> list[str]:
    """Reads a BAM file's header."""
    if data.read(4) != b"BAM\x01":
        raise ValueError("no BAM file")
    data.read(*struct.unpack("<i", data.read(4)))
    names = []
    for _ in range(*struct.unpack("<i", data.read(4))):
        (size,) = struct.unpack("<i", data.read(4))
        names.append(data.read(size)[:-1].decode())
        data.read(4)
    return names


def _bam_records(data: Blocks, names: list[str]) -> Iterator[tuple]:
    while not data.over():
        yield _bam_record(data.read(*struct.unpack("<i", data.read(4))), names)


def _split(starts: list[int], lo: int | None, hi: int | None) -> list[tuple[int | None, int | None]]:
    """The range of records, at those ``starts`` that are about ``SPLIT`` bytes apart."""
    cuts, last = [lo], (lo or 0) >> 16
    for s in starts:
        if (lo is None or s > lo) and (hi is None or s < hi) and (s >> 16) - last >= SPLIT:
            cuts.append(s)
            last = s >> 16
    return list(zip(cuts, [*cuts[1:], hi], strict=True))


def _bam_record(b: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
    at = 32
    qname = b[at : at + n_name - 1].decode()
    at += n_name
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", b, at))
    at += 4 * n_cigar
    seq = "".join([_PAIRS[x] for x in b[at : at + (n_seq + 1) // 2]])[:n_seq]
    at += (n_seq + 1) // 2
    quals = b[at : at + n_seq]
    qual = "*" if not n_seq or quals[0] == 0xFF else bytes(q + 33 for q in quals).decode()
    at += n_seq
    tags = {}
    while at < len(b):
        tag, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        if kind in "ZH":
            end = b.index(0, at)
            value, at = b[at:end].decode(), end + 1
        elif kind == "B":
            inner, count = chr(b[at]), struct.unpack_from("<I", b, at + 1)[0]
            values = struct.unpack_from(f"<{count}{TYPES[inner]}", b, at + 5)
            value, at = ",".join([inner, *map(str, values)]), at + 5 + struct.calcsize(f"<{count}{TYPES[inner]}")
        else:
            (v,) = struct.unpack_from("<" + TYPES[kind], b, at)
            value, at = v.decode() if kind == "A" else str(v), at + struct.calcsize("<" + TYPES[kind])
            kind = kind if kind in "Af" else "i"
        tags[f"{tag}:{kind}"] = value
    name = names[ref] if ref >= 0 else "*"
    mate = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
    return qname, flag, name, pos + 1, mapq, cigar or "*", mate, next_pos + 1, tlen, seq or "*", qual, list(tags.items())


class NarrowBamReader(BamReader):
    """Spark wants no ``pushFilters`` in a reader unless the session allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """What is wanted of ``rname`` and ``pos`` narrows what is read; Spark still applies
        every filter, since blocks hold other records too."""
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("rname",) and isinstance(f, EqualTo):
                self.contig = value
            elif at == ("pos",) and isinstance(value, int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, value - 1 + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(self.last, value - 1 - isinstance(f, LessThan))
            yield f


class FastqReader(_FileReader):
    SCHEMA = pa.schema([("name", pa.string()), ("description", pa.string()), ("seq", pa.string()), ("qual", pa.string())])

    def records(self, data: BinaryIO) -> Iterator[tuple]:
        while head := data.readline():
            if not head.strip():
                continue
            seq, plus, qual = (data.readline().rstrip(b"\r\n").decode() for _ in range(3))
            if head[:1] != b"@" or plus[:1] != "+" or len(seq) != len(qual):
                raise ValueError(f"no FASTQ record: {head[:80]!r}")
            name, _, rest = head[1:].rstrip(b"\r\n").decode().partition(" ")
            yield name, rest, seq, qual


class FastaReader(_FileReader):
    SCHEMA = pa.schema([("name", pa.string()), ("description", pa.string()), ("start", pa.int64()), ("sequence", pa.string())])

    def __init__(self, path: str, width: int):
        super().__init__(path)
        self.width = width

    def records(self, data: BinaryIO) -> Iterator[tuple]:
        name, rest, start, held = None, "", 0, b""
        for line in data:
            if line[:1] == b">":
                if name is not None and (held or not start):
                    yield name, rest, start, held.decode()
                name, _, rest = line[1:].decode().strip().partition(" ")
                rest, start, held = rest.strip(), 0, b""
            elif name is not None:
                held += b"".join(line.split())
                while len(held) >= self.width:
                    yield name, rest, start, held[: self.width].decode()
                    start, held = start + self.width, held[self.width :]
        if name is not None and (held or not start):
            yield name, rest, start, held.decode()


class FastaSource(DataSource):
    """(name, description, start, sequence): chunks of ``width`` bases (an option, 65,536 if
    not given), from ``start``, 0-based. A record without bases has one empty chunk; lines
    before the first record are left out; a file may be gzip."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, description string, start long, sequence string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"], int(self.options.get("width", 65_536)))


class BamSource(DataSource):
    """The fields of SAM (pos 1-based, ``*`` for what is missing) and ``tags``. With the
    option ``narrow``, filters on ``rname`` and ``pos`` narrow what is read of indexed files."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "qname string, flag long, rname string, pos long, mapq long, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"

    def reader(self, schema) -> BamReader:
        narrow = self.options.get("narrow", "false").lower() == "true"
        return (NarrowBamReader if narrow else BamReader)(self.options["path"])


class FastqSource(DataSource):
    """(name, description, seq, qual); a record has four lines, a file may be gzip."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, description string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options["path"])
