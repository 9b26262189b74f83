"""Token ids of documents in wavelet-matrix files, one per shard.

A shard holds whole documents in ascending order of doc_id, SHARD_TOKENS ids or one document. Its file has a directory
(document ids, lengths) and a wavelet matrix of 16 bit-planes over all ids, from which single ids, counts of an id and
places of its occurrences are read without decoding the rest. Files are rows of a Parquet table below the shared
folder, so that executors need no file system of their own; repeated keys keep their order of text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import forget, only, released, scratch_path, tune, written
from corpuscope.llm.encoder import LEVELS, encoder, tokenizer_path
from corpuscope.llm.wavelet import WaveletMatrix

END = 2
SHARD_TOKENS = 1 << 20
MAGIC = b"TOKS"


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The file of a shard: MAGIC, number of documents, deflated directory, wavelet matrix."""
    null = np.array([d is None for d in doc_ids], dtype="u1")
    key = np.array([d or 0 for d in doc_ids], dtype="<i8")
    size = np.array([len(x) for x in ids], dtype="<i8")
    head = zlib.compress(null.tobytes() + key.tobytes() + size.tobytes(), 1)
    matrix = WaveletMatrix.build(np.concatenate(ids) if ids else np.zeros(0, dtype="<u2"), LEVELS)
    return MAGIC + struct.pack("<II", len(doc_ids), len(head)) + head + matrix.to_bytes()


class Shard:
    """A shard's file, read back."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        n, n_head = struct.unpack_from("<II", blob, 4)
        head = zlib.decompress(blob[12 : 12 + n_head])
        null = np.frombuffer(head, dtype="u1", count=n)
        key = np.frombuffer(head, dtype="<i8", count=n, offset=n)
        self.doc_ids = [None if x else int(k) for x, k in zip(null, key, strict=True)]
        self.lengths = np.frombuffer(head, dtype="<i8", count=n, offset=9 * n)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])) if n else np.zeros(0, dtype=np.int64)
        self.matrix = WaveletMatrix.from_bytes(blob[12 + n_head :])

    def token(self, document: int, i: int) -> int:
        """Id number i of a document (both from 0), from the bit-planes alone."""
        return int(self.matrix.access(np.array([self.starts[document] + i]))[0][0])

    def count(self, token: int) -> int:
        return self.matrix.count(token)

    def occurrences(self, token: int) -> list[tuple[int, int]]:
        """(document, place in it) of every occurrence of an id."""
        at = self.matrix.select(token, np.arange(self.count(token)))
        doc = np.searchsorted(self.starts, at, side="right") - 1
        return list(zip(doc.tolist(), (at - self.starts[doc]).tolist(), strict=True))


_FILES = "part int, first bigint, n_tokens bigint, file binary"


def _encoded(docs: DataFrame, key: str, text: str, end: int, file: str) -> DataFrame:
    """(id, ids as uint16 bytes with the end id) of every row."""
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    tail = np.array([end], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for b in batches:
            ids = [x.tobytes() + tail for x in enc.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary())], names=["id", "ids"])

    return base.mapInArrow(released(run), "id bigint, ids binary")


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END, tokenizer: str | None = None) -> None:
    """Encode docs in ascending order of key and write the shards' files to path.

    Null texts are empty documents (the end id alone); null keys come first; an empty table writes no shard. Texts are
    encoded where they lie, and only their ids are shuffled. The range partitioner spreads equal numbers of rows: a hash of
    the ids is the second key, so rows of one key, or of none, may take several partitions. A shard starts anew with each.
    """
    spark = tune(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = written(_encoded(docs, key, text, end, tokenizer or tokenizer_path()), "token-ids", "zstd")
    salted = coded.withColumn("salt", F.xxhash64("ids"))
    dealt = salted.repartitionByRange(n, "id", "salt").sortWithinPartitions("id", "salt").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = first = part = 0

        def shard() -> pa.RecordBatch:
            nonlocal held, first, keys, ids
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([held]), pa.array([shard_bytes(keys, ids)], pa.binary())], names=["part", "first", "n_tokens", "file"])
            first, held, keys, ids = first + held, 0, [], []
            return out

        for b in batches:
            for i, x, p in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(x, dtype="<u2")
                if ids and held + len(x) > SHARD_TOKENS:
                    yield shard()
                part = p
                keys.append(i)
                ids.append(x)
                held += len(x)
        if ids:
            yield shard()

    dealt.mapInArrow(released(run), _FILES).write.option("compression", "zstd").parquet(path)
    forget(coded)


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    start adds the totals of the partitions before, one row each, to the place within the partition.
    """
    files = tune(spark).read.schema(_FILES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, first, f in zip(b.column("part"), b.column("first"), b.column("file"), strict=True):
                s = Shard(f.as_py())
                ids = s.matrix.decode()
                sums = [crc(ids[a : a + n]) for a, n in zip(s.starts.tolist(), s.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.as_py()] * len(sums), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts + first.as_py(), pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(released(run), "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files_query(spark, sf_dir: str) -> DataFrame:
    """op5: per document, read back from the files, its start, tokens and their checksum."""
    path = scratch_path(spark, "token-files")
    write_token_files(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), path)
    return read_token_files(spark, path)
