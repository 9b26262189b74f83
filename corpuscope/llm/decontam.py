"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of document words, at most SHARD_WORDS at a time, as symbols of the benchmark's vocabulary. Words that
no benchmark text has separate segments. Over the segments stands an FM-index: suffix array by prefix doubling (each
separator its own smallest symbol), Burrows-Wheeler transform in a wavelet matrix, suffix positions sampled. Windows of
the test phrases are searched backward all at once; occurrences are walked back to sampled positions and merged to spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import ALNUM_ONLY, only, released, tune, written
from corpuscope.llm.wavelet import WaveletMatrix

WINDOW = 13
SHARD_WORDS = 600_000
SAMPLE = 8
#: Rows, and bytes of rows, that a task holds back until their shard is searched.
HELD_ROWS, HELD_BYTES = 1 << 14, 32 << 20
#: Bytes of benchmark text whose vocabulary and windows are sent to the executors at once; more go in several passes.
BLOCK_BYTES = 8 << 20

HITS = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of [0-9a-z] and all characters from 0x80 on; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_ONLY).split() if text else []


class Phrases:
    """Windows of benchmark items over their own vocabulary; equal windows once, with the items that have them."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.items: list[str] = []
        place: dict[str, int] = {}
        for key, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            if not ids:
                continue
            at = -1
            if key is not None:
                at = place.setdefault(key, len(self.items))
                if at == len(self.items):
                    self.items.append(key)
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1):
                owners.setdefault(ids[i : i + m], set()).add(at)
        self.length = np.array([len(w) for w in owners], dtype=np.int64)
        self.symbols = np.zeros((len(owners), max(self.length, default=0)), dtype=np.int32)  # aligned right
        for row, w in enumerate(owners):
            self.symbols[row, self.symbols.shape[1] - len(w) :] = w
        sets = [sorted(x - {-1}) for x in owners.values()]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int64)
        self.owner = np.array([i for x in sets for i in x], dtype=np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols; a 0 is a separator, and separators are distinct, in order of position, before all else.

    Prefix doubling that sorts again only the suffixes whose rank is still shared.
    """
    n = len(s)
    rank = s.astype(np.int64)
    seps = np.flatnonzero(s == 0)
    rank = rank + len(seps)  # symbols after all separators
    rank[seps] = np.arange(len(seps))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = start  # a suffix's rank: where its group begins
    size = np.diff(np.concatenate((np.flatnonzero(head), [n])))
    todo = np.flatnonzero(np.repeat(size, size) > 1)  # places in order
    step = 1
    while len(todo):
        suffix = order[todo]
        after = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        key = rank[suffix] * np.int64(n + 1) + after
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[todo] = suffix
        head = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.maximum.accumulate(np.where(head, np.arange(len(todo)), 0))
        rank[suffix] = todo[begin]
        size = np.diff(np.concatenate((np.flatnonzero(head), [len(todo)])))
        todo = todo[np.repeat(size, size) > 1]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over a shard's symbols (0 separates)."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.n = len(s)
        order = suffix_array(s)
        before = s[order - 1]  # the symbol before each suffix; before the first one stands the last, a separator
        self.bwt = WaveletMatrix.build(before, max(1, int(sigma).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma + 1))))
        marked = (before == 0) | (order % SAMPLE == 0)  # a walk never crosses a separator
        words = np.zeros(self.n // 64 + 1, dtype=np.uint64)
        packed = np.packbits(marked, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.marks, self.before_mark = words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern number, low, high) of the patterns (aligned right) that occur."""
        who = np.arange(len(patterns))
        lo, hi = np.zeros(len(who), dtype=np.int64), np.full(len(who), self.n, dtype=np.int64)
        width = patterns.shape[1] if patterns.ndim == 2 else 0
        for k in range(1, width + 1):
            on = length[who] >= k
            c = patterns[who, width - k].astype(np.int64)
            lo2, hi2 = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
            lo, hi = np.where(on, lo2, lo), np.where(on, hi2, hi)
            keep = lo < hi
            who, lo, hi = who[keep], lo[keep], hi[keep]
            if not len(who):
                break
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Shard positions of suffix-array rows, by steps back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            w = row >> 6
            at = (row & 63).astype(np.uint64)
            hit = ((self.marks[w] >> at) & np.uint64(1)).astype(bool)
            r = self.before_mark[w] + np.bitwise_count(self.marks[w] & ((np.uint64(1) << at) - np.uint64(1)))
            out[left[hit]] = self.sampled[r[hit]] + steps
            left, row = left[~hit], row[~hit]
            symbol, rank = self.bwt.access(row)
            row, steps = self.first[symbol] + rank, steps + 1
        return out


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans that are sorted by start."""
    out: list[list[int]] = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search_shard(pieces: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """pieces: (document number, first word, symbols). By document number: starts, ends and items of occurrences."""
    gap = np.zeros(1, dtype=np.int32)
    s = np.concatenate([x for _, _, ids in pieces for x in (gap, ids)] + [gap])
    keep = (s != 0) | np.concatenate(([True], s[:-1] != 0))  # runs of other words: one separator
    where = np.flatnonzero(keep)
    index = FMIndex(s[keep], len(phrases.vocabulary))
    who, lo, hi = index.search(phrases.symbols, phrases.length)
    if not len(who):
        return {}
    n = hi - lo
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    window = np.repeat(who, n)
    place = where[index.locate(rows)]
    starts = np.cumsum([0] + [len(ids) + 1 for _, _, ids in pieces])[:-1] + 1
    piece = np.searchsorted(starts, place, side="right") - 1
    number, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    doc, a = number[piece], place - starts[piece] + offset[piece]
    b = a + phrases.length[window]
    by = np.lexsort((a, doc))
    doc, a, b, window = doc[by], a[by], b[by], window[by]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return {int(d[0]): (x, y, np.unique(w)) for d, x, y, w in zip(*(np.split(v, cuts) for v in (doc, a, b, window)), strict=True)}


def _scan(phrases: Phrases, text: str, window: int, out_schema: pa.Schema):
    get = phrases.vocabulary.get

    def flush(batch: pa.RecordBatch, pieces: list, found: dict[int, list]) -> None:
        for number, (a, b, w) in search_shard(pieces, phrases).items() if pieces else ():
            found.setdefault(number, []).append((a, b, w))
        pieces.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        pieces: list[tuple[int, int, np.ndarray]] = []
        found: dict[int, list] = {}
        total = first = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal first
            for batch, counts in held:
                spans, items = [], []
                for k in range(batch.num_rows):
                    parts = found.get(first + k)
                    if not parts:
                        spans.append([])
                        items.append([])
                        continue
                    a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    by = np.argsort(a, kind="stable")
                    spans.append([{"start": x, "end": y} for x, y in _merged(a[by], b[by])])
                    w = np.unique(np.concatenate([p[2] for p in parts]))
                    own = np.unique(np.concatenate([phrases.owner[phrases.first[x] : phrases.first[x + 1]] for x in w.tolist()]))
                    items.append([phrases.items[x] for x in own.tolist()])
                first += batch.num_rows
                extra = [pa.array(counts, pa.int64()), pa.array(spans, out_schema.field("spans").type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=out_schema)
            held.clear()
            found.clear()

        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            number = first + sum(b.num_rows for b, _ in held)
            held.append((batch, counts))
            for k, t in enumerate(batch.column(text)):
                words = words_of(t.as_py())
                counts[k] = len(words)
                ids = np.array([get(w, 0) for w in words], dtype=np.int32)
                # a text longer than a shard goes in pieces that overlap by a window less one word
                for at in range(0, max(1, len(ids) - window + 1), SHARD_WORDS):
                    part = ids[at : at + SHARD_WORDS + window - 1]
                    pieces.append((number + k, at, part))
                    total += len(part)
                    if total >= SHARD_WORDS:
                        flush(batch, pieces, found)
                        total = 0
            if not pieces:
                yield from rows()
            elif sum(b.num_rows for b, _ in held) >= HELD_ROWS or sum(b.nbytes for b, _ in held) >= HELD_BYTES:  # a shard of its own
                flush(batch, pieces, found)
                total = 0
                yield from rows()
        if held:
            flush(held[-1][0], pieces, found)
            yield from rows()

    return run


def find_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (merged, half-open, in words; what to remove) and items (ids whose windows occur).

    Null, empty and wordless texts have no words, spans or items. Items without words match nothing; an item of fewer
    words than the window is one window. Items of null id mark words but are not listed; rows of equal id are one item.
    Repeated rows each get their own result, an empty table gives an empty one, other columns of docs come through;
    columns of docs named as the new ones are replaced. The benchmark goes to the executors in blocks of BLOCK_BYTES.
    """
    spark = tune(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("k"), F.col(f"`{item_text}`").alias("t"))
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = docs.drop("n_words", "spans", "items")
    kept = docs.columns
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == k)
        phrases = Phrases([(r.k, r.t) for r in part.collect()], window)
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        base = out.select(*[F.col(f"`{c}`") for c in kept]) if k == 0 else out
        names = {"n_words": f"_n{k}", "spans": f"_s{k}", "items": f"_i{k}"}
        schema = StructType(base.schema.fields + StructType.fromDDL(HITS).fields)
        scanned = base.mapInArrow(released(_scan(phrases, text, window, to_arrow_schema(schema))), schema)
        out = scanned.withColumnsRenamed(names)
        if blocks > 1:
            out = written(out, "decontam")
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_n0").alias("n_words"),
        _union_spans([f"_s{k}" for k in range(blocks)]).alias("spans"),
        F.array_distinct(F.concat(*[f"_i{k}" for k in range(blocks)])).alias("items"),
    )


def _union_spans(names: list[str]) -> Column:
    """Spans of several passes, merged again."""
    if len(names) == 1:
        return F.col(names[0])

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), merged).otherwise(F.concat(acc, F.array(x)))

    every = F.array_sort(F.concat(*names))
    return F.aggregate(every, F.slice(every, 1, 0), add)


def n_hit() -> Column:
    """Words in the spans."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))


def remove_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs of find_spans with the words of their spans cut from the text (offsets are in bytes of words as split here)."""

    def cut(t: str | None, spans: list | None) -> str | None:
        if t is None or not spans:
            return t
        raw = t.encode("utf-8", "surrogatepass")
        clean = np.frombuffer(raw.translate(ALNUM_ONLY), dtype=np.uint8) != 32
        edge = np.diff(np.concatenate(([0], clean.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out, at = [], 0
        for s in spans:
            out.append(raw[at : begin[s["start"]]])
            at = int(end[s["end"] - 1])
        return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text)
            new = pa.array([cut(t.as_py(), s.as_py()) for t, s in zip(b.column(text), b.column("spans"), strict=True)], b.schema.field(k).type)
            yield b.set_column(k, b.schema.field(k), new)

    return docs.mapInArrow(released(run), docs.schema)


def decontam_query(spark, sf_dir: str) -> DataFrame:
    """op1: per document its words, hit words, hit items and whether it is contaminated."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = n_hit()
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((hits > 0) & (20 * hits >= F.col("n_words"))).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.m = bw.m),
pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
