"""Packing documents into sequences by linear grouping.

Pieces go to shards by hash. In a shard, lengths above capacity / SMALL are sorted and cut into equal-cardinality groups,
each rounded up to its largest; a linear program over configurations of these few sizes (columns generated by a
knapsack) gives the number of bins of each configuration; actual pieces take their groups' places; what rounding leaves
over goes by best fit, and so do the small pieces at last. Configurations leave each bin its share of the small pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import only, released, tune, written
from corpuscope.llm.encoder import encoder, tokenizer_path
from corpuscope.llm.token_files import crc

CAPACITY = 4096
END = 1
SHARD_PIECES = 1 << 15
GROUPS = 48
SMALL = 8
#: Parts of the small pieces' share of a bin that configurations leave to them, in the order in which they are tried.
RESERVES = (1.0, 0.75, 0.5, 0.25, 0.0)


class _Bins:
    """Open bins by room left; the tightest that fits is the lowest set bit from the length up."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.n = 0

    def put(self, number: int, room: int) -> None:
        self.by_room[room].append(number)
        self.mask |= 1 << room

    def new(self, room: int) -> int:
        self.n += 1
        self.put(self.n - 1, room)
        return self.n - 1

    def best_fit(self, length: int) -> int:
        up = self.mask >> length
        if not up:
            return self.new(self.capacity - length)
        room = length + (up & -up).bit_length() - 1
        number = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        self.put(number, room - length)
        return number


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Most valuable multiset of sizes (all above capacity / SMALL) within capacity, as counts."""
    best = np.zeros(capacity + 1)
    picks: list[np.ndarray] = []
    for _ in range(capacity // int(sizes.min())):
        now, pick = best.copy(), np.full(capacity + 1, -1, dtype=np.int64)
        for j, (s, v) in enumerate(zip(sizes.tolist(), value.tolist(), strict=True)):
            if v > 0:
                new = best[: capacity + 1 - s] + v
                up = new > now[s:] + 1e-12
                now[s:][up] = new[up]
                pick[s:][up] = j
        picks.append(pick)
        if (pick < 0).all():
            break
        best = now
    counts = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    for pick in reversed(picks):  # a pick of round t extends a multiset of round t - 1
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """(counts per size, whole bins of that configuration): the linear program's solution, rounded down.

    Revised simplex over a basis of as many configurations as sizes; new columns come from the knapsack at the duals.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    good = basis.copy()
    for _ in range(40 * m):
        try:
            dual = np.linalg.solve(basis.T, np.ones(m))
        except np.linalg.LinAlgError:  # rounding made the basis singular: the last one that was not
            basis = good
            break
        good = basis.copy()
        column = _knapsack(sizes, dual, capacity).astype(float)
        if column @ dual <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, np.stack((demand.astype(float), column), axis=1)).T
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    x = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].astype(np.int64), int(x[j] + 1e-6)) for j in range(m) if x[j] >= 1 - 1e-6]


def linear_grouping(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, reserve: int = 0) -> tuple[np.ndarray, int]:
    """Bin of every length, and the number of bins; configurations leave `reserve` of the capacity to small pieces."""
    out = np.full(len(lengths), -1, dtype=np.int64)
    bins = _Bins(capacity)
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > capacity // SMALL]
    alone = large[lengths[large] > capacity - reserve - 1]
    for i in alone.tolist():
        out[i] = bins.new(capacity - int(lengths[i]))
    large = large[len(alone) :]
    if len(large):
        parts = [p for p in np.array_split(large, min(groups, len(large))) if len(p)]
        sizes: list[int] = []
        pool: list[list[int]] = []
        for p in parts:  # groups of one rounded size are one
            top = int(lengths[p[0]])
            if sizes and sizes[-1] == top:
                pool[-1] += p.tolist()
            else:
                sizes.append(top)
                pool.append(p.tolist())
        for counts, n in configurations(np.array(sizes), np.array([len(p) for p in pool]), capacity - reserve):
            for _ in range(n):
                taken = [pool[g].pop() for g in np.repeat(np.arange(len(sizes)), counts).tolist() if pool[g]]
                if taken:
                    number = bins.new(capacity - int(lengths[taken].sum()))
                    out[taken] = number
        for i in sorted((i for p in pool for i in p), key=lambda i: (-int(lengths[i]), i)):
            out[i] = bins.best_fit(int(lengths[i]))
    for i in order[lengths[order] <= capacity // SMALL].tolist():
        out[i] = bins.best_fit(int(lengths[i]))
    return out, bins.n


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of every length (1 to capacity) by linear grouping.

    Where small pieces have the volume, configurations need not be full: they leave each bin its share of the small ones,
    or a part of it. The best of RESERVES stays; none is tried after one that reaches the least number of bins.
    """
    total = int(lengths.sum())
    least = -(-total // capacity)
    share = int(lengths[lengths <= capacity // SMALL].sum()) // max(1, least)
    best, most = np.zeros(0, dtype=np.int64), len(lengths) + 1
    for reserve in dict.fromkeys(min(int(part * share), capacity // 2) for part in RESERVES):
        number, n = linear_grouping(lengths, capacity, reserve=reserve)
        if n < most:
            best, most = number, n
        if n <= least:
            break
    return best


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = END, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Ids of every document and the end id, cut into pieces of capacity where there are more."""
    file = tokenizer or tokenizer_path()
    tail = np.array([end], dtype="<u2")
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for b in batches:
            rows: list[tuple] = []
            for i, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids = np.concatenate((x, tail))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((i, k, at, len(part), crc(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    tune(docs.sparkSession)
    return base.mapInArrow(released(run), _PIECES)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = END, capacity: int = CAPACITY, shard: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in a sequence).

    A null or empty text is the end id alone. Repeated rows are packed each for itself; a null key stays null. Only
    documents longer than capacity are cut. An empty table gives an empty one; other columns are not read. A shard has
    about `shard` pieces, whatever the input, so a shard's bins are short of full by a bin or two in some thousands.
    """
    cut = written(pieces(docs, key, text, end, capacity), "pieces")
    n = max(1, -(-cut.count() // shard))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        number = pack(pdf["length"].to_numpy(dtype=np.int64), capacity)
        order = np.argsort(number, kind="stable")
        size, b = pdf["length"].to_numpy(dtype=np.int64)[order], number[order]
        total = np.cumsum(size) - size
        first = np.concatenate(([True], b[1:] != b[:-1]))
        offset = np.zeros(len(b), dtype=np.int64)
        offset[order] = total - np.repeat(total[first], np.diff(np.concatenate((np.flatnonzero(first), [len(b)]))))
        pdf["sequence_id"] = (pdf["shard"].to_numpy(dtype=np.int64) << 32) + number
        pdf["offset"] = offset
        return pdf.drop(columns="shard")

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("bigint"))
    return dealt.groupBy("shard").applyInPandas(fit, f"{_PIECES}, sequence_id bigint, offset bigint")


def packing_query(spark, sf_dir: str) -> DataFrame:
    """op8: every piece of every document with its place."""
    return pack_documents(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
