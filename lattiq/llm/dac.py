"""Token ids as directly addressable codes, and tables of files in that format (operator 10).

An id is split into chunks of eight bits.  Level 0 holds the lowest chunk of every id and a bit
per id that says whether it goes on; level 1 holds the next chunk of those that do; and so on.
A directory of ranks (ones before each block of 512 bits) turns position ``i`` of a level into
the position of its continuation in the next, so any id is read without decoding others.

File: magic ``LQDAC1``, pad to 8, then int64 counts ``n_docs, n_ids, n_levels``, the document ids
(int64), whether each is null (bytes, padded to 8), the offsets of documents (int64, n_docs + 1),
and per level an int64 length, the chunks, the bitmap (little bit order) and the directory
(int64), each padded to 8 bytes.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lattiq import scratch

from . import base
from .bpe import encoder
from .words import slices

MAGIC = b"LQDAC1\0\0"
BLOCK = 512
#: A file is closed once it holds so many ids, or so many documents.
FILE_IDS, FILE_DOCS = 2_000_000, 50_000


def _padded(x: bytes) -> bytes:
    return x + b"\0" * (-len(x) % 8)


def pack(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """One file.  ``offsets``: where each document starts in ``ids``, and the end."""
    out, rest = [], ids.astype(np.uint32)
    while not out or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<i8")
        chunk = (rest & np.uint32(0xFF)).astype(np.uint8)
        out.append(b"".join([np.int64(len(rest)).tobytes(), _padded(chunk.tobytes()), _padded(bits.tobytes()), ranks.tobytes()]))
        rest = rest[more] >> np.uint32(8)
    head = np.array([len(doc_ids), len(ids), len(out)], "<i8").tobytes()
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    nulls = _padded(bytes(x is None for x in doc_ids))
    return b"".join([MAGIC, head, names, nulls, offsets.astype("<i8").tobytes(), *out])


class Reader:
    """Random access to a file: to its bytes, or to an open file of which only what is asked for is
    read (``seek`` and ``read``; see :func:`opened`)."""

    def __init__(self, source):
        self.source = source
        if self._bytes(0, 8) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_ids, n_levels = map(int, self._take("<i8", 3, 8))
        self.names_at = 32
        self.nulls_at = self.names_at + 8 * self.n_docs
        self.offsets_at = self.nulls_at + self.n_docs + -self.n_docs % 8
        at = self.offsets_at + 8 * (self.n_docs + 1)
        #: Per level: its ids, and where its chunks, its bitmap and its directory begin.
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take("<i8", 1, at)[0])
            m = (n + 7) // 8
            chunks, bits = at + 8, at + 8 + n + -n % 8
            ranks = bits + m + -m % 8
            self.levels.append((n, chunks, bits, ranks))
            at = ranks + 8 * ((n + BLOCK - 1) // BLOCK + 1)

    def _bytes(self, at: int, n: int) -> bytes:
        if isinstance(self.source, (bytes, memoryview)):
            return bytes(self.source[at : at + n])
        self.source.seek(at)
        return self.source.read(n)

    def _take(self, kind, n: int, at: int) -> np.ndarray:
        if isinstance(self.source, bytes):
            return np.frombuffer(self.source, kind, n, at)
        return np.frombuffer(self._bytes(at, n * np.dtype(kind).itemsize), kind)

    @property
    def doc_ids(self) -> list[int | None]:
        names, nulls = self._take("<i8", self.n_docs, self.names_at), self._take(np.uint8, self.n_docs, self.nulls_at)
        return [None if z else int(x) for x, z in zip(names, nulls, strict=True)]

    @property
    def offsets(self) -> np.ndarray:
        return self._take("<i8", self.n_docs + 1, self.offsets_at)

    def _rank(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a level: those before its block, and those of its block."""
        _, _, bits_at, ranks_at = self.levels[level]
        block, byte = i // BLOCK, i // 8
        first = block * BLOCK // 8
        bits = self._take(np.uint8, byte - first + (i % 8 > 0), bits_at + first)
        whole = int(np.bitwise_count(bits[: byte - first]).sum())
        part = int(bits[byte - first] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0
        return int(self._take("<i8", 1, ranks_at + 8 * block)[0]) + whole + part

    def token(self, i: int) -> int:
        """The id at position ``i`` of the file, from one chunk, one bit and one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= int(self._take(np.uint8, 1, chunks + i)[0]) << shift
            if not self._take(np.uint8, 1, bits + i // 8)[0] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def span(self, i: int, j: int) -> np.ndarray:
        """The ids at positions ``i`` to ``j - 1``; only their own chunks are read."""
        out = np.zeros(j - i, np.uint32)
        where = np.arange(j - i)
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            if i >= j:
                break
            out[where] |= self._take(np.uint8, j - i, chunks + i).astype(np.uint32) << np.uint32(8 * level)
            own = self._take(np.uint8, (j + 7) // 8 - i // 8, bits + i // 8)
            more = np.unpackbits(own, bitorder="little")[i % 8 : i % 8 + j - i].astype(bool)
            where = where[more]
            i = self._rank(level, i) if len(where) else 0
            j = i + len(where)
        return out

    def document(self, d: int) -> np.ndarray:
        i, j = self._take("<i8", 2, self.offsets_at + 8 * d)
        return self.span(int(i), int(j))


def opened(path: str) -> Reader:
    """A reader of a stored file, by its path or address; nothing but its counts is read yet."""
    fs, at = FileSystem.from_uri(path)
    return Reader(fs.open_input_file(at))


def write(docs: DataFrame, path: str, end_id: int | None = 2, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Encode ``docs`` and write files in ascending order of ``key``; returns the table of files.

    Files lie in ``folder`` (by default one of its own in the shared folder), as they are described
    above, so an id can be read at its offset.  The table (``part int, seq int, n_docs long,
    n_ids long, path string``) is in the order of ``part, seq``.  ``end_id`` is appended to each
    document.  Order: null keys first, rows with equal keys by text (null as empty); every row
    is a document of its own.  Range partitions split the key space evenly, and a file holds at
    most about ``FILE_IDS`` ids, so memory is bounded by one file and one batch.  A file is moved
    to its name when it is whole; a task that runs again writes the same files.
    """
    folder = folder or f"{scratch.shared_dir(docs.sparkSession)}/lattiq/dac-{uuid.uuid4().hex}"
    rows = docs.select(key, base.text_or_empty(text).alias("text"))
    ordered = rows.repartitionByRange(base.partitions(docs), key).sortWithinPartitions(key, "text")

    def make():
        enc = encoder(path)
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, attempt, state = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), {"seq": 0}
        names, ids, sizes = [], [], []

        def closed():
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            name = f"part-{part:06d}-{state['seq']:06d}.dac"
            with fs.open_output_stream(f"{root}/.{name}.{attempt}") as f:
                f.write(pack(names, offsets, np.concatenate(ids)))
            fs.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            row = [[part], [state["seq"]], [len(names)], [int(offsets[-1])], [f"{folder}/{name}"]]
            state["seq"] += 1
            names.clear(), ids.clear(), sizes.clear()
            return row

        def rows(columns):
            keys, raw = columns[0].to_pylist(), base.raw_texts(columns[1])
            for i, j in slices([len(x) for x in raw]):
                got, n = enc.encode_many(raw[i:j])
                for k, x in zip(keys[i:j], np.split(got, np.cumsum(n)[:-1]), strict=True):
                    names.append(k)
                    ids.append(x if end_id is None else np.append(x, np.uint32(end_id)))
                    sizes.append(len(ids[-1]))
                if sum(sizes) >= FILE_IDS or len(names) >= FILE_DOCS:
                    yield closed()

        return rows, lambda: [closed()] if names else []

    files = _mapped_with_end(ordered, make, "part int, seq int, n_docs long, n_ids long, path string")
    return scratch.written(files, "dac")


def _mapped_with_end(df: DataFrame, make, ddl: str) -> DataFrame:
    import pyarrow as pa

    schema, arrow = base.arrow_schema(ddl)

    def batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        rows, end = make()
        for b in batches:
            if b.num_rows:
                yield from map(batch, rows(b.columns))
        yield from map(batch, end())

    return base.arrow_mapped(df, run, schema)


def bases(files: DataFrame) -> DataFrame:
    """``part, seq, base``: how many ids stand in all files before each.

    Sums by partition first: the only window over everything has a row per range partition.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    each = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part"))
    return each.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("in_part")).alias("base"))


def read(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start long, n_tokens long, ids_crc32 long`` of each document, from the files.

    Only the table of files is dealt out; each file is read by the task that has its row.  ``key``
    is null where it was null; an empty document has its end id only, or nothing.
    """

    def make():
        def rows(columns):
            for path, start in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
                fs, at = FileSystem.from_uri(path)
                with fs.open_input_stream(at) as f:
                    file = Reader(f.read())
                offsets = file.offsets
                n = np.diff(offsets)
                crc = [zlib.crc32(file.document(d).astype("<u4").tobytes()) for d in range(len(n))]
                yield [file.doc_ids, offsets[:-1] + start, n, crc]

        return rows

    with_base = files.join(bases(files), ["part", "seq"]).select("path", "base")
    dealt = with_base.repartition(base.partitions(files), "path")
    return base.mapped(dealt, make, f"{key} long, start long, n_tokens long, ids_crc32 long")
