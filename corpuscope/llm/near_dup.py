"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Texts become sets of 64-bit shingle hashes. One hash permutation is cut into BINS bins; a bin's smallest hash is its
signature value, and an empty bin borrows from a bin that a universal hash of (bin, attempt) names (optimal
densification). ROWS bins make a band; equal bands meet in a bucket. Documents of equal sets are one class. A bucket links
its members to its smallest one (a star: n - 1 candidates for n members), candidates are confirmed on the full sets,
and components are formed. Only buckets that still hold several components are then compared member by member, in blocks
and without a pair leaving its task, so that no link is lost where the star's centre is not itself similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import ASCII_LOWER, components, mix64, only, released, tune, written

SHINGLE = 5
BINS = 128
ROWS = 6
#: Pairs whose signatures agree on a smaller share are not confirmed: at a true share of 0.85 that is four deviations off.
SLACK = 4.0
#: Documents of a bucket, and bytes of their sets, that are compared as one block.
BLOCK = 1024
BLOCK_BYTES = 32 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class _WordHash(dict):
    """64-bit hashes of words, kept for the words seen last (blake2b: no adversarial collisions)."""

    def __missing__(self, word: bytes) -> int:
        from hashlib import blake2b

        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is one shingle; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([hashes[x] for x in words], dtype=np.uint64)
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _donors() -> np.ndarray:
    """donors[attempt, bin]: the bin to borrow from."""
    a = np.arange(64, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)[None, :]
    return (mix64(a + np.uint64(0x51ED270B)) % np.uint64(BINS)).astype(np.int64)


_DONORS = _donors()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x BINS signature values of non-empty sets."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    h = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets), dtype=np.int64) * BINS, size) + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    head = np.concatenate(([True], cell[1:] != cell[:-1]))  # sets are sorted, so the first of a bin is its smallest
    sig = np.full(len(sets) * BINS, _EMPTY, dtype=np.uint64)
    sig[cell[head]] = h[head]
    sig = sig.reshape(len(sets), BINS)
    full = np.zeros(sig.shape, dtype=bool)
    full.reshape(-1)[cell[head]] = True
    row, column = np.nonzero(~full)
    for attempt in range(len(_DONORS)):
        if not len(row):
            break
        donor = _DONORS[attempt, column]
        ok = full[row, donor]
        sig[row[ok], column[ok]] = sig[row[ok], donor[ok]]
        row, column = row[~ok], column[~ok]
    if len(row):  # no attempt met a full bin: the next full one round the circle
        first = np.argmax(full[row], axis=1)
        sig[row, column] = sig[row, first]
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """len(sig) x (BINS // rows) bucket keys; the band's number is part of the key."""
    n = BINS // rows
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(sig), n)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : n * rows : rows])
    return key


def _sketch(key: str, text: str, schema: pa.Schema, rows: int = ROWS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for b in batches:
            sets = [shingles(t.as_py(), hashes) for t in b.column(text)]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            on = np.flatnonzero(n)
            sig = signatures([sets[i] for i in on]) if len(on) else np.zeros((0, BINS), dtype=np.uint64)
            # two independent sums over the set stand for it: equal sets, equal sums
            a, c = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
            for i in on:
                a[i], c[i] = mix64(sets[i]).sum(dtype=np.uint64).view(np.int64), mix64(sets[i] ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).view(np.int64)
            keys: list = [None] * len(sets)
            brief: list = [None] * len(sets)
            for i, x, s in zip(on, bands(sig, rows).view(np.int64), mix64(sig).astype(np.uint8), strict=True):
                keys[i], brief[i] = x, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(n), pa.array(a), pa.array(c), pa.array(keys, pa.list_(pa.int64())), pa.array(brief, pa.binary())], schema=schema
            )

    return run


def _sets(text: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for b in batches:
            sets = [shingles(t.as_py(), hashes) for t in b.column(text)]
            sums = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sums, pa.int64())], schema=schema)

    return run


def jaccard_at_least(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x and y| >= num * |x or y| for sorted distinct arrays."""
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(x) + len(y) - common)


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard_at_least(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64), num, den) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _agreement(num: int, den: int) -> int:
    """Equal signature bytes that a pair needs to be confirmed."""
    t = num / den
    return max(0, int(BINS * (t - SLACK * (t * (1 - t) / BINS) ** 0.5)))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """Tables of the groups (bucket, i, j) of rows sorted by them; a group may lie across batches."""
    held: list[pa.Table] = []
    last = None

    def split(t: pa.Table) -> list[pa.Table]:
        key = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        edge = [0, *cut.tolist(), t.num_rows]
        return [t.slice(x, y - x) for x, y in zip(edge[:-1], edge[1:], strict=True) if y - x > 1]

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        key = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
        now = tuple(int(k[-1]) for k in key)
        start = int(np.argmax(np.all([k == k[-1] for k in key], axis=0)))
        if start or now != last:
            held.append(t.slice(0, start))
            whole = pa.concat_tables(held).combine_chunks()
            if whole.num_rows:
                yield split(whole)
            held = []
        held.append(t.slice(start))
        last = now
    if held:
        yield split(pa.concat_tables(held).combine_chunks())


def _candidates(g: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a group, a block with itself or with another, whose signatures agree and that meet here first."""
    side, ids, root = (g.column(c).to_numpy() for c in ("side", "id", "root"))
    if (root == root[0]).all():
        return
    own = g.column("i")[0] == g.column("j")[0]
    x, y = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    keys = np.array(g.column("keys").to_pylist(), dtype=np.int64)
    bucket = g.column("bucket")[0].as_py()
    for r in range(0, len(x), 32):
        u = x[r : r + 32]
        differ = root[u][:, None] != root[y][None, :]
        if own:
            differ &= ids[u][:, None] < ids[y][None, :]
        p, q = np.nonzero(differ)
        for k in range(0, len(p), 8192):
            m, n = u[p[k : k + 8192]], y[q[k : k + 8192]]
            ok = (sig[m] == sig[n]).sum(axis=1) >= least
            m, n = m[ok], n[ok]
            first = (keys[m] == keys[n]).argmax(axis=1)
            ok = keys[m, first] == bucket
            yield m[ok], n[ok]


def _with_candidates(least: int):
    """Rows of (bucket, i, j, ...) that have a candidate in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole_groups(batches):
            for g in groups:
                on = np.zeros(g.num_rows, dtype=bool)
                for m, n in _candidates(g, least):
                    on[m] = on[n] = True
                if on.any():
                    yield from g.filter(pa.array(on)).to_batches()

    return run


def _links_within(least: int, num: int, den: int):
    """Confirmed links of a group that join its components: at most one for each member but one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole_groups(batches):
            out: list[tuple[int, int]] = []
            for g in groups:
                ids, root = g.column("id").to_numpy(), g.column("root").to_pylist()
                sets = [np.frombuffer(x, dtype=np.uint64) for x in g.column("s").to_pylist()]
                parent = {r: r for r in root}

                def find(r: int, parent: dict = parent) -> int:
                    while parent[r] != r:
                        parent[r] = r = parent[parent[r]]
                    return r

                for m, n in _candidates(g, least):
                    for a, b in zip(m.tolist(), n.tolist(), strict=True):
                        x, y = find(root[a]), find(root[b])
                        if x != y and jaccard_at_least(sets[a], sets[b], num, den):
                            parent[max(x, y)] = min(x, y)
                            out.append((int(ids[a]), int(ids[b])))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 85, den: int = 100, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row of docs; links are set pairs with den * common >= num * union.

    component_id: smallest key that links reach, itself included; kept: key = component_id. A null, empty or blank text
    has no shingles and links with nothing (its key is its component). A row of null key links with nothing: its
    component is null and it is kept. Repeated rows of one key are one document and get the same component each, also
    where their texts differ: links of any of them count. Ties go to the smallest key. An empty table gives an empty one; other columns are not read, so their names cannot clash. Bands have `rows` bins: a pair of
    similarity s meets in no bucket with a chance of (1 - s ** rows) ** (BINS // rows).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = tune(docs.sparkSession)
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = StructType.fromDDL("id bigint, n bigint, ha bigint, hb bigint, keys array<bigint>, sig binary")
    sketch = written(base.mapInArrow(released(_sketch("id", "text", to_arrow_schema(schema), rows)), schema), "sketch")

    # classes of equal sets: one row each under their smallest key
    some = sketch.where("n > 0 and id is not null")
    classes = written(some.groupBy("n", "ha", "hb").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    alone = sketch.select("id", "n", "ha", "hb")
    member = written(alone.join(classes.select("n", "ha", "hb", "rep"), ["n", "ha", "hb"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "members")

    reps = some.join(classes.where("m > 1").select(F.col("rep").alias("id"), "n", "ha", "hb"), ["id", "n", "ha", "hb"], "left_semi").unionByName(
        some.join(classes.where("m = 1").select("n", "ha", "hb"), ["n", "ha", "hb"], "left_semi")
    )
    reps = written(reps.dropDuplicates(["id", "n", "ha", "hb"]).select("id", "n", "keys", "sig"), "reps")
    keyed = reps.select("id", "n", F.explode("keys").alias("bucket"))
    full = written(keyed.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("m")).where("m > 1"), "buckets")
    inside = written(keyed.join(full, "bucket"), "bucketed")
    stars = inside.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()

    sigs = reps.select("id", "sig")
    least = _agreement(num, den)

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures agree enough."""
        two = pairs.join(sigs.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(sigs.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

        return two.mapInArrow(released(run), "a bigint, b bigint")

    def full_sets(nodes: DataFrame, name: str) -> DataFrame:
        """Sets of the documents in nodes (id), made again from their texts."""
        nodes = written(nodes.distinct(), name + "-nodes")
        ddl = StructType.fromDDL("id bigint, s binary, h bigint")
        texts = base.where("id is not null and text is not null").join(nodes, "id", "left_semi")
        return written(texts.mapInArrow(released(_sets("text", to_arrow_schema(ddl))), ddl).dropDuplicates(["id", "h"]).drop("h"), name + "-sets")

    pairs = written(close(stars), "stars")
    sets = full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "stars")
    two = pairs.join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b").join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").select("a", "b", "sa", "sb")
    # a key of several texts is one document: its classes are linked
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a != hi").select("id", "a")
    several = member.join(several, "id").where("rep != a").select("a", F.col("rep").alias("b"))
    links = written(two.mapInArrow(released(_confirm(num, den)), "a bigint, b bigint").unionByName(several).distinct(), "stars-links")
    root = components(links, "cc1")

    # what the stars leave open: buckets that hold more than one component
    labelled = inside.join(root.withColumnsRenamed({"node": "id"}), "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    labelled = written(labelled, "labelled")
    opened = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("size")).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(8 * F.col("size") / BLOCK_BYTES))
    opened = written(opened.select("bucket", blocks.cast("int").alias("nb")), "open")
    parts = labelled.join(opened, "bucket").withColumn("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    parts = parts.select("bucket", "id", "root", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), F.when((F.col("k") <= F.col("o")), 0).otherwise(1).alias("side"))
    parts = parts.join(reps.drop("n"), "id").select("bucket", "i", "j", "side", "id", "root", "keys", "sig")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = "bucket bigint, i int, j int, side int, id bigint, root bigint, keys array<bigint>, sig binary"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "id")

    rest = written(dealt(parts).mapInArrow(released(_with_candidates(least)), held), "rest")
    sets = full_sets(rest.select("id"), "rest")
    more = written(dealt(rest.join(sets, "id")).mapInArrow(released(_links_within(least, num, den)), "a bigint, b bigint"), "rest-links")
    if more.limit(1).count():
        root = components(links.unionByName(more), "cc2")

    out = member.join(root.withColumnsRenamed({"node": "rep"}), "rep", "left")
    label = F.coalesce("root", "rep")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))


def near_dup_query(spark, sf_dir: str) -> DataFrame:
    """op4: per document its shingles, component and whether it is the one kept."""
    return near_duplicates(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], chr(1))) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""
