"""Token-id files with a shared zstandard dictionary.

A folder holds ``dictionary-<hash>`` and one file for each shard; shards are ranges of
ascending doc_id. A file is

    magic (8 bytes), dictionary hash (16)
    the documents' frames, each compressed on its own
    per document: doc_id (int64), has an id (1), offset of its frame (uint64), ids (uint64)
    documents (uint64), offset of the table before (uint64), bytes of an id (uint64)

all little-endian, so one document is read with three small ranged reads. Folders are
reached through pyarrow's file systems, so they can be local, HDFS or an object store that
all executors see. A shard is written under a name of its own and then renamed: an attempt
that is lost or runs twice leaves one whole file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.llm import textbuf
from sievemill.llm.common import cut, shared_dir, texts_by_hash
from sievemill.llm.tokens import encoder

MAGIC = b"SIEVETK1"
#: The dictionary: its size, and a sample of so many texts of at most so many characters.
DICTIONARY_BYTES, SAMPLE_TEXTS, SAMPLE_CHARS = 65_536, 2000, 16_384
LEVEL = 3
#: Bytes of a shard that are read at once.
READ = 4 << 20


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def settle(fs, own: str, final: str) -> None:
    """The attempt's file takes its name. Some stores don't replace: then another attempt
    of the task was first, with the same rows."""
    try:
        fs.move(own, final)
    except OSError:
        if fs.get_file_info(final).type != FileType.File:
            raise
        fs.delete_file(own)


def dictionary_hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """From a bounded sample in the order of a hash; empty if there is nothing to learn."""
    import zstandard

    rows = texts_by_hash(docs, SAMPLE_TEXTS, F.length("text") <= SAMPLE_CHARS).orderBy("text").collect()
    samples = [_narrow(i + end_id.to_bytes(4, "little"), width) for i in encoder(tokenizer).ids([r["text"] for r in rows])]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they serve as they are
        return b"".join(samples)[:DICTIONARY_BYTES]


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _writer(folder: str, tokenizer: str, dictionary, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        data = dictionary.value
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data)).compress
        encode = encoder(tokenizer).batch
        fs, at = filesystem(folder)
        context = TaskContext.get()
        shard = context.partitionId()
        own, final = f"{at}/.{shard:08d}-{uuid.uuid4().hex}", f"{at}/shard-{shard:08d}"
        ids_, offsets, counts, place, out = [], [], [], len(MAGIC) + 16, None
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                if out is None:
                    out = fs.open_output_stream(own)
                    out.write(MAGIC + dictionary_hash(data))
                flat, first = encode(textbuf.of(part, "text"))
                for k, i in enumerate(part.column(0).to_pylist()):
                    ids = np.append(flat[first[k] : first[k + 1]], np.uint32(end_id))
                    frame = compress(ids.astype(f"<u{width}").tobytes())
                    out.write(frame)
                    ids_.append(i)
                    offsets.append(place)
                    counts.append(len(ids))
                    place += len(frame)
        if out is None:
            return
        out.write(np.array([i or 0 for i in ids_], "<i8").tobytes())
        out.write(np.array([i is not None for i in ids_], "u1").tobytes())
        out.write(np.array(offsets, "<u8").tobytes())
        out.write(np.array(counts, "<u8").tobytes())
        out.write(np.array([len(ids_), place, width], "<u8").tobytes())
        out.close()
        settle(fs, own, final)
        name = final.rsplit("/", 1)[1]
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int64()), "file": pa.array([name]), "documents": pa.array([len(ids_)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64())}
        )

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """Writes ``docs`` to ``folder`` (a path or URI all executors share) and returns its
    manifest: (shard, file, documents, tokens, start), one row for each shard, ``start``
    being the ids before it.

    Ids go in ascending doc_id order, rows without an id first, rows that repeat an id by
    a hash of the text. A null or empty text has the end id alone. An empty table writes
    no shard. Other columns are not looked at. Very long texts are encoded alone and whole.
    ``width``: bytes of an id, 2 or 4; a ValueError tells that a vocabulary or the end id
    doesn't fit.
    """
    largest = max(encoder(tokenizer).largest, end_id)
    if width not in (2, 4) or end_id < 0 or largest >= 256**width:
        raise ValueError(f"ids up to {largest} don't fit into {width} bytes")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    data = train_dictionary(source, tokenizer, end_id, width)
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary-{dictionary_hash(data).hex()}") as f:
        f.write(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    manifest = cut(
        ordered.mapInArrow(
            _writer(folder, tokenizer, shared, end_id, width), "shard long, file string, documents long, tokens long"
        )
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


class Shard:
    """Random access to one file."""

    def __init__(self, folder: str, name: str, dictionaries: dict[bytes, bytes] | None = None):
        import zstandard

        fs, at = filesystem(folder)
        self.file = fs.open_input_file(f"{at}/{name}")
        size = self.file.size()
        n, place, self.width = (int(x) for x in np.frombuffer(self.file.read_at(24, size - 24), "<u8"))
        head = self.file.read_at(len(MAGIC) + 16, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is no token file")
        key = head[len(MAGIC) :]
        if dictionaries is None or key not in dictionaries:
            with fs.open_input_file(f"{at}/dictionary-{key.hex()}") as f:
                data = f.read()
            if dictionary_hash(data) != key:
                raise ValueError("the dictionary doesn't have the hash that the file names")
            if dictionaries is not None:
                dictionaries[key] = data
        else:
            data = dictionaries[key]
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress
        table = self.file.read_at(size - 24 - place, place)
        ids, has = np.frombuffer(table, "<i8", n), np.frombuffer(table, "u1", n, 8 * n)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has, strict=True)]
        self.offsets = np.append(np.frombuffer(table, "<u8", n, 9 * n), np.uint64(place)).astype(np.int64)
        self.counts = np.frombuffer(table, "<u8", n, 17 * n).astype(np.int64)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        lo, hi = int(self.offsets[k]), int(self.offsets[k + 1])
        return self._expand(self.file.read_at(hi - lo, lo))

    def every(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """The ids of all documents, some at a time, from ranges of about ``READ`` bytes: (the
        first's place, ids of each)."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            z = min(max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + READ, "right")) - 1), n, k + 1000)
            at = self.offsets[k : z + 1].tolist()
            data = memoryview(self.file.read_at(at[-1] - at[0], at[0]))
            yield k, [self._expand(data[lo - at[0] : hi - at[0]]) for lo, hi in zip(at, at[1:], strict=False)]
            k = z

    def _expand(self, data) -> np.ndarray:
        return np.frombuffer(self.decompress(data), f"<u{self.width}").astype("<u4")


def _reader(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[bytes, bytes] = {}
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name, dictionaries)
                begin = start + np.cumsum(shard.counts) - shard.counts
                for lo, ids in shard.every():
                    at = range(lo, lo + len(ids))
                    if any(len(x) != shard.counts[k] for k, x in zip(at, ids, strict=True)):
                        raise ValueError(f"{name} has other ids than its table says")
                    cols = [
                        pa.array(shard.doc_ids[lo : at[-1] + 1], pa.int64()),
                        pa.array(begin[lo : at[-1] + 1]),
                        pa.array(shard.counts[lo : at[-1] + 1]),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    files = cut(manifest.select("file", "start", "shard"))
    spread = files.repartitionByRange(max(1, min(files.count(), 10_000)), "shard").select("file", "start")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spread.mapInArrow(_reader(folder, with_ids), kind)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
