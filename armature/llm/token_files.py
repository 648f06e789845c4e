"""Token files with Elias-Fano document boundaries (operator 7).

A file holds the concatenated ids of consecutive documents (2 or 4 bytes each,
by the greatest id) and two Elias-Fano sequences: the documents' ends in that
array and their ids.  A sequence of n values below u takes about
``n * (2 + log2(u / n))`` bits: the low bits of each value side by side, and the
high bits as gaps in unary.  ``EliasFano.get`` finds value i by a select over the
unary part; a 32-bit sample every 256 values bounds the search.  Documents are read through it.

Writing: documents are range-partitioned by id; each task writes files of
bounded size into the shared folder under a temporary name and moves them, so a
repeated task replaces its own files.  Reading goes through Spark's
``binaryFile`` source.  A file states the tokens before it in its part; the parts'
offsets are a prefix sum over one row per part, which is broadcast.

File layout (little-endian): magic ``EFTOKEN1``; u64 documents, tokens, null
ids, tokens of the same part's files before; i64 smallest id; u32 bytes of an id; the two
sequences, each as ``EliasFano.to_bytes``; the ids.

Defined results: null text counts as empty; null ids come first; rows that
repeat an id are separate documents, in the order of their texts.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import NULL_ID, id_key, id_value, shared_folder, shuffle_partitions, stage, text_bytes

MAGIC = b"EFTOKEN1"
SAMPLE = 256
_HEAD = "<QQQQqI"
FILE_BYTES = 16 << 20


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n == 0:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, empty, empty, np.zeros(0, "<u4"))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def values(self) -> np.ndarray:
        """All values (uint64)."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = np.zeros(self.n, np.uint64)
        for j in range(self.low_bits):
            low |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return high | low

    def get(self, i: int) -> int:
        """Value i: a select from the nearest sample before it."""
        at = int(self.samples[i // SAMPLE])
        skip, byte = i % SAMPLE, at >> 3
        left = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := left.bit_count()) <= skip:
            skip -= ones
            byte += 1
            left = int(self.high[byte])
        for _ in range(skip):
            left &= left - 1
        at = byte * 8 + (left & -left).bit_length() - 1
        value, first = at - i, i * self.low_bits
        for j in range(self.low_bits - 1, -1, -1):
            value = value << 1 | (int(self.low[(first + j) >> 3]) >> ((first + j) & 7) & 1)
        return value

    def to_bytes(self) -> bytes:
        return struct.pack("<QIQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) \
            + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_buffer(cls, data: bytes, at: int) -> tuple["EliasFano", int]:
        n, low_bits, a, b, c = struct.unpack_from("<QIQQQ", data, at)
        at += struct.calcsize("<QIQQQ")
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + 4 * c


def pack_file(ids: list[int], arrays: list[np.ndarray], before: int = 0) -> bytes:
    """One file's bytes; ``ids`` ascending, ``NULL_ID`` for null; ``before``: tokens of the part's earlier files."""
    ends = np.cumsum([len(a) for a in arrays], dtype=np.uint64)
    nulls = sum(i == NULL_ID for i in ids)
    least = ids[nulls] if nulls < len(ids) else 0
    tokens = np.concatenate(arrays) if arrays else np.zeros(0, "<u4")
    width = 2 if not len(tokens) or int(tokens.max()) < 1 << 16 else 4
    return b"".join([
        MAGIC, struct.pack(_HEAD, len(ids), len(tokens), nulls, before, least, width),
        EliasFano.of(ends).to_bytes(),
        EliasFano.of(np.array([i - least for i in ids[nulls:]], dtype=np.uint64)).to_bytes(),
        tokens.astype(f"<u{width}").tobytes()])


class TokenFile:
    """Reader of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.tokens, self.nulls, self.before, self.least, width = struct.unpack_from(_HEAD, data, 8)
        self.ends, at = EliasFano.from_buffer(data, 8 + struct.calcsize(_HEAD))
        self.keys, at = EliasFano.from_buffer(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.tokens, at)

    def doc_ids(self) -> list[int]:
        return [NULL_ID] * self.nulls + [self.least + int(x) for x in self.keys.values()]

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, by two selects."""
        return self.ids[self.ends.get(i - 1) if i else 0: self.ends.get(i)]


def _save(folder: str, name: str, data: bytes) -> None:
    import os
    import uuid

    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder)
    draft = f"{path}/_draft-{os.getpid()}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every document's ids plus ``end_id`` in ascending order of ids; return the files' manifest.

    Manifest: (part, file, documents, tokens), staged in the shared folder.
    """
    spark = docs.sparkSession
    target = f"{folder}/files"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(target)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = K.encoder(K.LibraryBpe, tokenizer)
        end = np.array([end_id], dtype="<u4")
        ids: list[int] = []
        arrays: list[np.ndarray] = []
        rows, size = [], 0

        def save():
            before = sum(r[3] for r in rows)
            _save(target, f"part-{part:06d}-{len(rows):06d}.eft", pack_file(ids, arrays, before))
            rows.append((part, len(rows), len(ids), sum(map(len, arrays))))
            ids.clear()
            arrays.clear()

        for batch in K.row_slices(batches, encodes=True):
            for k, a in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1).to_pylist())):
                ids.append(k)
                arrays.append(np.concatenate((a, end)))
                size += 4 * len(arrays[-1])
                if size >= file_bytes:
                    save()
                    size = 0
        if ids:
            save()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "file", "documents", "tokens"), r)) for r in rows],
            schema=pa.schema([(n, pa.int64()) for n in ("part", "file", "documents", "tokens")]))

    rows = (docs.select(id_key(id_col).alias("k"), text_bytes(text_col).alias("text"))
            .repartitionByRange(shuffle_partitions(spark), "k").sortWithinPartitions("k", "text"))
    return stage(rows.mapInArrow(run, "part long, file long, documents long, tokens long"), folder, "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files, ``start`` counted over all files in order."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = int(path.rsplit("/", 1)[1].split("-")[1])
                f = TokenFile(content.as_py())
                keys, lo = f.doc_ids(), 0
                step = max(1, int(f.documents * (2 << 20) / max(1, f.tokens)))
                for at in range(0, f.documents, step):
                    starts, ids = [], []
                    for i in range(at, min(at + step, f.documents)):
                        hi = f.ends.get(i)          # a select; no table of all ends is built
                        starts.append(f.before + lo)
                        ids.append(f.ids[lo:hi].astype("<u4").tobytes())
                        lo = hi
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(ids), pa.int64()), pa.array(keys[at:at + step], pa.int64()),
                         pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["part", "k", "at", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").load(f"{folder}/files")
    rows = files.select("path", "content").mapInArrow(run, "part long, k long, at long, ids binary")
    # one row per partition reaches the driver: as many as the writing job had tasks
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()
    sums, total = [], 0
    for r in parts:
        sums.append((r["part"], total))
        total += r["tokens"]
    bases = spark.createDataFrame(sums, "part long, base long")
    return rows.join(F.broadcast(bases), "part").select(
        id_value("k").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "ids")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` as token files in a new shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    return read(spark, folder, write(docs, folder, tokenizer, end_id))
