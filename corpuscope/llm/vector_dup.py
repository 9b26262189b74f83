"""Near-duplicate embeddings over a robust-pruned flat graph.

Equal vectors are one class. Classes go to the shards of their OVERLAP nearest centres, large clusters in several
shards by hash. In each shard a graph is built: every vector's nearest candidates, pruned robustly (a neighbour goes if one
kept before is ALPHA times closer to it), with edges back. A vector's adjacency lists from its shards are united to
one flat graph. Every vector is then searched in it, a shard of queries at a time: a task holds its shard and, with their
lists, the vectors outside of it that united edges lead to, but for those too far off to be in range together. The search is greedy best-first from medoids until the beam
settles, and as long as vectors in range turn up, the range expands through their neighbours. Links are confirmed in double precision and
counted in the one shard that is first for both. A sample drawn by hash, whatever was found, is compared with all vectors
and audits the recall; where the last overlap still falls short, all vectors are compared block by block instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import components, only, released, tune, written

COSINE = 0.9
SHARD = 2048
OVERLAP = 2
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 24
#: Entry rows besides the medoids of the graph's parts.
SPREAD = 32
#: Centres at most, of a sample of so many vectors each.
CENTRES = 4096
SAMPLE_PER_CENTRE = 24
#: Vectors audited: so many at first, eight times as many until AUDIT_LINKED of few links are among them, AUDIT_MOST at most.
AUDIT = 512
AUDIT_LINKED = 64
AUDIT_MOST = 16_384
#: Vectors of at most so many links are judged apart from those of dense groups.
FEW = 8
RECALL = 0.9
#: Rows of a search task: vectors of its shard, queries of another shard of its cluster, vectors outside that edges lead to.
HELD, ASKED, OUTSIDE = range(3)
#: Vectors that the comparison of all sends at a time.
EXACT_BLOCK = 16_384


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every row (n x degree, -1 where fewer), nearest first, for all rows at once."""
    n = len(x)
    c = min(candidates, n - 1)
    if c <= 0:
        return np.full((n, degree), -1, dtype=np.int32)
    out = np.full((n, degree), -1, dtype=np.int32)
    for a in range(0, n, 256):
        sims = x[a : a + 256] @ x.T
        rows = np.arange(len(sims))
        sims[rows, a + rows] = -np.inf
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1)
        v = x[near]
        own = 1 - s  # distance to the row
        alive = np.ones(near.shape, dtype=bool)
        for k in range(degree):
            pick = np.where(alive.any(axis=1), alive.argmax(axis=1), -1)
            on = pick >= 0
            if not on.any():
                break
            at = np.where(on, pick, 0)
            out[a + rows[on], k] = near[rows[on], at[on]]
            between = 1 - np.einsum("rcd,rd->rc", v, v[rows, at])
            alive &= ~(alpha * between <= own) | ~on[:, None]
            alive[rows[on], at[on]] = False
    return out


def _pad(lists: list[np.ndarray]) -> np.ndarray:
    width = max((len(x) for x in lists), default=0) or 1
    out = np.full((len(lists), width), -1, dtype=np.int32)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def with_back_edges(out: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists with every edge both ways."""
    n = len(out)
    a, k = np.nonzero(out >= 0)
    b = out[a, k].astype(np.int64)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    return np.split((pairs % n).astype(np.int32), np.searchsorted(pairs // n, np.arange(1, n)))


def medoids_of(x: np.ndarray, graph: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Where searches begin: the medoid of every part that the graph falls into, and rows spread out farthest first."""
    n = len(x)
    a, k = np.nonzero(graph >= 0)
    b = graph[a, k]
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    mean = np.zeros_like(x)
    np.add.at(mean, label, x)
    fit = np.einsum("nd,nd->n", x, mean[label])
    order = np.lexsort((-fit, label))
    entry = order[np.concatenate(([True], label[order][1:] != label[order][:-1]))]
    near = (x @ x[entry].T).max(axis=1)
    more = []
    for _ in range(min(spread, n - len(entry))):
        i = int(np.argmin(near))
        more.append(i)
        near = np.maximum(near, x @ x[i])
    return np.unique(np.concatenate((entry, np.array(more, dtype=np.int64))))


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> list[np.ndarray]:
    """Rows of x within range (similarity >= least) of every query: greedy from the medoids, then range expansion.

    All queries of a block move at once. A query's pool is a similarity row (unseen: -inf); a step expands its best
    unexpanded member if that is among the beam's best or in range.
    """
    n = len(x)
    entry = medoids_of(x, graph)
    found = []
    for a in range(0, len(queries), 128):
        q = queries[a : a + 128]
        rows = np.arange(len(q))
        sims = np.full((len(q), n), -np.inf)
        todo = np.full((len(q), n), -np.inf)  # the unexpanded
        sims[:, entry] = todo[:, entry] = q @ x[entry].T
        active = rows
        while len(active):
            at = todo[active].argmax(axis=1)
            value = todo[active, at]
            cut = sims[active] if n <= beam else -np.partition(-sims[active], beam - 1, axis=1)[:, beam - 1]
            floor = np.full(len(active), -np.inf) if n <= beam else np.minimum(cut, least)
            go = (value > -np.inf) & (value >= floor)
            active, at = active[go], at[go]
            if not len(active):
                break
            todo[active, at] = -np.inf
            near = graph[at]
            r, k = np.nonzero(near >= 0)
            who, v = active[r], near[r, k]
            new = np.isneginf(sims[who, v])
            who, v = who[new], v[new]
            s = np.einsum("nd,nd->n", q[who], x[v])
            sims[who, v] = s
            todo[who, v] = s
        found += [np.flatnonzero(s >= least) for s in sims]
    return found


class Groups:
    """Union-find over 0..n-1 that joins a whole array at a time."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.label = np.arange(n)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, one: int, others: np.ndarray) -> None:
        roots = {self.find(i) for i in np.unique(self.label[others]).tolist()} | {self.find(int(self.label[one]))}
        low = min(roots)
        for r in roots:
            self.parent[r] = low
        self.label[others] = low
        self.label[one] = low

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in self.label.tolist()], dtype=np.int64)


def centres_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres of unit vectors by spherical k-means from evenly spread starts; deterministic."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def _matrix(rows: DataFrame) -> np.ndarray:
    """Unit rows of a bounded table's vectors (v), sent to the driver as Arrow."""
    column = rows.select("v").toArrow().column("v").combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vector: str):
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; links are other rows with cosine >= least, in double precision.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths do
    not link, those of each length are searched by themselves. Ties in similarity change no link. Equal vectors are linked with each other and share their links. Repeated keys count as
    rows of their own but share a component; rows of null key link with nothing, have a null component and are kept. An empty table gives an empty one; other columns are not read.
    The recall audit compares a sample with all vectors; below RECALL the search runs again with more overlap, and after
    the last one all vectors are compared with all.
    """
    spark = tune(table.sparkSession)
    base = table.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    base = base.withColumn("ok", _valid("v") & F.col("id").isNotNull())
    base = base.withColumn("h", F.when(F.col("ok"), F.xxhash64("v")))
    classes = base.where("ok").groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = written(classes, "vec-classes")
    found = [_linked(classes.where(F.size("v") == r["d"]), r["n"], overlap, least) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    if not found:
        return table.select(F.col(f"`{key}`"), F.lit(0).cast("bigint").alias("n_links"), F.col(f"`{key}`").cast("bigint").alias("component_id"), F.coalesce(F.col(f"`{key}`").isNotNull(), F.lit(True)).alias("kept"))
    counts, stars = found[0]
    for more in found[1:]:
        counts, stars = counts.unionByName(more[0]), stars.unionByName(more[1])
    # rows of one key are one document, so the classes that hold it are joined
    twice = base.where("ok").groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("id")
    twice = base.where("ok").join(twice, "id").join(classes.select("h", "v", "rep"), ["h", "v"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    root = components(stars.unionByName(twice), "vec-cc")
    member = classes.select("h", "v", "rep", "m").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    member = written(member.select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "vec-member")
    out = base.join(member, ["h", "v"], "left")
    label = F.coalesce("root", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))


def _linked(classes: DataFrame, n: int, overlap: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Links of n classes of vectors of one length: (id, links) with copies counted, and edges (a, b) that span what is linked."""
    k = max(1, min(CENTRES, -(-n // (SHARD // 2))))
    draw = F.pmod(F.xxhash64("rep", F.lit(41)), F.lit(1 << 24)) / float(1 << 24)
    drawn = classes.where(draw < min(1.0, 2 * k * SAMPLE_PER_CENTRE / n)).orderBy("rep").limit(2 * k * SAMPLE_PER_CENTRE)
    drawn = _matrix(drawn)
    if len(drawn) < k:
        drawn = _matrix(classes.orderBy("rep").limit(k))
    centres = centres_of(drawn, k)
    for t in (overlap, 2 * overlap, 4 * overlap):
        counts, stars = _search(classes, centres, min(t, k), least)
        good = _audit(classes, counts, n, least) >= RECALL
        if good or t >= k:
            break
    if not good:
        counts, stars = _compare_all(classes, n, least)
    return counts, stars


def _search(classes: DataFrame, centres: np.ndarray, overlap: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) with copies counted, and edges (a, b) that span what is linked."""
    wide = 2 * least * least - 1 - 1e-9  # two vectors in range of one are no further apart than this

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit_rows(b.column("v").to_pylist()) if b.num_rows else np.zeros((0, centres.shape[1]))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("m"), b.column("v"), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["id", "m", "v", "own"])

    placed = written(classes.select("rep", "m", "v").mapInArrow(released(assign), "id bigint, m bigint, v array<double>, own array<int>"), "vec-placed")
    rows = placed.select("id", "m", "v", "own", F.explode("own").alias("c"))
    size = written(rows.groupBy("c").agg(F.count("*").alias("n")).select("c", F.ceil(F.col("n") / SHARD).cast("int").alias("parts")), "vec-sizes")
    rows = rows.join(F.broadcast(size), "c")  # one row a centre, CENTRES at most
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "vec-rows")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), unit_rows(pdf["v"].tolist())
        lists = with_back_edges(robust_prune(x))
        close = [near[x[near] @ x[k] >= wide] for k, near in enumerate(lists)]
        return pd.DataFrame({"id": ids, "near": [ids[x].tolist() for x in lists], "close": [ids[x].tolist() for x in close]})

    lists = rows.groupBy("c", "part").applyInPandas(build, "id bigint, near array<bigint>, close array<bigint>")
    united = [F.array_distinct(F.flatten(F.collect_list(x))).alias(x) for x in ("near", "close")]
    union = written(lists.groupBy("id").agg(*united), "vec-graph")

    # blocks of queries against blocks of a cluster's graph: one of each for clusters of a shard
    graph = rows.join(union, "id").select("id", "m", "v", "own", "near", "c", F.col("part").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), F.lit(HELD).alias("kind"))
    asks = rows.where("parts > 1").select("id", "m", "v", "own", F.array().cast("array<bigint>").alias("near"), "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g"), F.col("part").alias("q"), F.lit(ASKED).alias("kind"))
    # where close united edges lead out of a shard's cluster: those vectors with their lists
    out_edges = rows.select("id", "c", "part").join(union, "id").select("c", F.col("part").alias("g"), F.explode("close").alias("id")).distinct()
    whole = placed.join(union, "id")
    halo = out_edges.join(whole, "id").where(~F.array_contains("own", F.col("c"))).select("id", "m", "v", "own", "near", "c", "g", F.col("g").alias("q"), F.lit(OUTSIDE).alias("kind"))
    tasks = graph.unionByName(asks.where("g != q")).unionByName(halo)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        c, kind = int(pdf["c"].iloc[0]), pdf["kind"].to_numpy()
        own_shard = int(pdf["g"].iloc[0]) == int(pdf["q"].iloc[0])
        mine = pd.concat((pdf[kind == HELD], pdf[kind == OUTSIDE]))
        ask = pdf[kind == (HELD if own_shard else ASKED)]
        if not (kind == HELD).any() or not len(ask):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        ids, m, x = mine["id"].to_numpy(), mine["m"].to_numpy(), unit_rows(mine["v"].tolist())
        place = {i: k for k, i in enumerate(ids.tolist())}
        graph = _pad([np.array([place[i] for i in near if i in place], dtype=np.int32) for near in mine["near"]])
        asked, aown = ask["id"].to_numpy(), np.array(ask["own"].tolist(), dtype=np.int64)
        hown = np.array(mine["own"].tolist(), dtype=np.int64)
        links = np.zeros(len(ask), dtype=np.int64)
        every = ids if own_shard else np.concatenate((ids, asked))
        groups = Groups(len(every))
        for k, near in enumerate(range_search(x, graph, unit_rows(ask["v"].tolist()), least)):
            near = near[ids[near] != asked[k]]
            if len(near):
                groups.join(k if own_shard else len(ids) + k, near)
                # the first cluster that both are in counts the pair; where there is none, the one nearest to the query
                both = (hown[near][:, :, None] == aown[k][None, None, :]).any(axis=2)
                first = np.where(both, hown[near], np.iinfo(np.int64).max).min(axis=1)
                first = np.where(both.any(axis=1), first, aown[k][0]) == c
                links[k] = int(m[near[first]].sum())
        least_id = np.full(len(every), np.iinfo(np.int64).max)
        label = groups.labels()
        np.minimum.at(least_id, label, every)
        counted = np.concatenate((links, np.zeros(len(ids) - len(links), dtype=np.int64)) if own_shard else (np.zeros(len(ids), dtype=np.int64), links))
        return pd.DataFrame({"id": every, "links": counted, "root": least_id[label]})

    got = written(tasks.groupBy("c", "g", "q").applyInPandas(search, "id bigint, links bigint, root bigint"), "vec-links")
    counts = written(got.groupBy("id").agg(F.sum("links").alias("links")), "vec-counts")
    return counts, got.where("root != id").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()


def _compare_all(classes: DataFrame, n: int, least: float) -> tuple[DataFrame, DataFrame]:
    """As _search, without a graph: every block of vectors is sent once and compared with all. No link is missed."""
    blocks = -(-n // EXACT_BLOCK)
    dealt = written(classes.select("rep", "m", "v").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(53)), F.lit(blocks))), "vec-dealt")

    def against(ids: np.ndarray, m: np.ndarray, x: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = Groups(len(ids))
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column("rep").to_numpy()
                hit = (unit_rows(b.column("v").to_pylist()) @ x.T >= least) & (own[:, None] != ids[None, :])
                on = np.flatnonzero(hit.any(axis=1))
                for k in on:
                    near = np.flatnonzero(hit[k])
                    groups.join(int(near[0]), near)
                to = ids[hit[on].argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(own[on]), pa.array(hit[on] @ m), pa.array(to)], names=["id", "links", "root"])
            label = ids[groups.labels()]
            on = label != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(np.zeros(int(on.sum()), dtype=np.int64)), pa.array(label[on])], names=["id", "links", "root"])

        return run

    passes = []
    for i in range(blocks):
        rows = dealt.where(F.col("block") == i).select("rep", "m", "v").collect()
        if rows:
            held = np.array([r["rep"] for r in rows], dtype=np.int64), np.array([r["m"] for r in rows], dtype=np.int64), unit_rows([r["v"] for r in rows])
            passes.append(written(dealt.select("rep", "v").mapInArrow(released(against(*held)), "id bigint, links bigint, root bigint"), "vec-all"))
    got = passes[0]
    for p in passes[1:]:
        got = got.unionByName(p)
    counts = written(classes.select(F.col("rep").alias("id"), F.lit(0).cast("bigint").alias("links")).unionByName(got.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links")), "vec-counts")
    return counts, got.select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()


def _audit(classes: DataFrame, counts: DataFrame, n: int, least: float) -> float:
    """Recall by a sample drawn by hash, against all vectors: the mean over linked vectors of the share of their links found.

    Vectors of up to FEW links and those of dense groups are judged each for themselves; the lower mean counts. The sample
    grows until AUDIT_LINKED vectors of few links are in it, or all vectors, or AUDIT_MOST.
    """
    rows = AUDIT
    while True:
        order = F.xxhash64("rep", F.lit(47))
        chosen = classes.select(F.col("rep").alias("id"), "v", order.alias("o")).orderBy("o", "id").limit(rows)
        chosen = chosen.join(counts, "id", "left").select("id", "v", F.coalesce("links", F.lit(0)).alias("links")).collect()
        found, true, near = np.array([r["links"] for r in chosen], dtype=np.int64), *_true_links(classes, chosen, least)
        few, dense = (true > 0) & (near <= FEW), near > FEW
        if few.sum() >= AUDIT_LINKED or rows >= min(n, AUDIT_MOST):
            return min((float(np.minimum(1.0, found[on] / true[on]).mean()) for on in (few, dense) if on.any()), default=1.0)
        rows = min(8 * rows, AUDIT_MOST)


def _true_links(classes: DataFrame, chosen: list, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of every chosen vector (id, v), by comparison with all: its links with copies counted, and the classes linked."""
    ids, x = np.array([r["id"] for r in chosen], dtype=np.int64), unit_rows([r["v"] for r in chosen])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(ids)), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                hit = unit_rows(b.column("v").to_pylist()) @ x.T >= least
                r, k = np.nonzero(hit)
                m, own = b.column("m").to_numpy(), b.column("rep").to_numpy()
                r, k = r[own[r] != ids[k]], k[own[r] != ids[k]]
                np.add.at(total[0], k, m[r])
                np.add.at(total[1], k, 1)
        on = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[0, on]), pa.array(total[1, on])], names=["k", "n", "near"])

    sums = classes.select("rep", "m", "v").mapInArrow(released(block), "k bigint, n bigint, near bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))
    out = np.zeros((2, len(ids)), dtype=np.int64)
    for r in sums.collect():
        out[:, r["k"]] = r["n"], r["near"]
    return out[0], out[1]


def vector_dup_query(spark, sf_dir: str) -> DataFrame:
    """op2: per vector its links, component and whether it is the one kept."""
    return near_vectors(only(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id != y.vec_id WHERE array_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT a AS x, b AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(least(x, y)) AS m FROM r GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, v.vec_id) AS component_id, coalesce(c.m, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.x = v.vec_id
"""
