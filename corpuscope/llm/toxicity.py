"""Toxicity by a weighted finite-state pattern grammar.

The lexicon transducer reads words and writes their classes with weights: insults are learned from labelled rows as words
and word beginnings (longest entry wins, so that a harmless word under a bad beginning has its own weight), threats are a
short list with learned weights, targets, negations and reporting words are short lists. It is composed with the clause
machine of `grammar`, and the heaviest path of a clause gives its matches. A logistic regression on sums over matched
clauses turns them into a score. Lexicon and regression are fitted on two halves of the training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm import grammar
from corpuscope.llm.common import crc_mod, only, released, tune, written

#: Training rows of each label, about: the bound of the sample that lexicon and regression are fitted on.
TRAIN_ROWS = 6000
#: Rows of the sample's half that an entry needs.
LEAST_ROWS = 3
PREFIXES = range(4, 9)
#: Weight of a threat that too few labelled rows hold.
THREAT_WEIGHT = 1.0

# closed classes, in the languages of the corpus
TARGETS = "you your yours u they them he she him her these those people du dich dir ihr euch sie er tu te toi vous ils elle lui tú usted ustedes ellos él ella".split()
NEGATIONS = "not no never isn't aren't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say quoted quote reported claimed called wrote sagte sagt schrieb zitierte dit disait écrit dijo dice escribió".split()
THREATS = "kill hurt destroy beat punch shoot stab burn hunt töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()

_KIND = {k: i for i, k in enumerate(grammar.KINDS)}
FEATURES = 3 * len(_KIND) + 5

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;\n]")
_ENDS = frozenset(".!?;\n")


class Lexicon(dict):
    """word -> weighted classes, or nothing for words that no machine minds: a transducer of one state, composed on the fly.

    A learned word counts before a learned beginning, a longer beginning before a shorter one. Hits may also be read as
    other words, at weight 0, so a hit whose marks outweigh it leaves no match. Words once read are kept up to a bound.
    """

    def __init__(self, entries: dict[str, float], starts: dict[str, float], threats: dict[str, float]):
        super().__init__()
        self.entries, self.starts, self.threats = entries, starts, threats
        self.closed = {w: c for c, ws in ((grammar.TARGET, TARGETS), (grammar.NEGATION, NEGATIONS), (grammar.REPORT, REPORTS)) for w in ws}

    def __missing__(self, word: str) -> list[tuple[str, float]]:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = self.read(word)
        return out

    def read(self, word: str) -> list[tuple[str, float]]:
        w = self.entries.get(word)
        if w is None:
            w = next((x for k in reversed(PREFIXES) if len(word) > k and (x := self.starts.get(word[:k])) is not None), 0.0)
        hits = [(grammar.INSULT, w)] if w > 0 else []
        if (t := self.threats.get(word, 0.0)) > 0:
            hits.append((grammar.THREAT, t))
        if word in self.closed:
            return [*hits, (self.closed[word], 0.0)]
        return [*hits, (grammar.OTHER, 0.0)] if hits else []


def matches(text: str | None, lexicon: Lexicon) -> tuple[list[list[tuple[str, float, str]]], int]:
    """Matches (kind, weight, word) of every clause that has one, and the number of words."""
    found: list[list[tuple[str, float, str]]] = []
    clause: list[tuple[int, str]] = []
    hit = False
    total = before = 0

    def close() -> None:
        if hit and (got := grammar.read_clause(clause, lexicon.__getitem__)[1]):
            found.append(got)

    for word in _WORDS.findall(text.lower()) if text else ():
        if word in _ENDS:
            close()
            clause, hit, before = [], False, 0
            continue
        total += 1
        classes = lexicon[word]
        if classes:
            clause.append((before, word))
            before = 0
            hit = hit or classes[0][0] in grammar.HITS
        else:
            before += 1
    close()
    return found, total


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Sums over matched clauses: by kind their number, weight and greatest weight; then the weight of all."""
    found, total = matches(text, lexicon)
    sums = np.zeros((len(grammar.KINDS), 3))
    for clause in found:
        for kind, weight, _ in clause:
            k = _KIND[kind]
            sums[k] += (1.0, weight, 0.0)
            sums[k, 2] = max(sums[k, 2], weight)
    every = [m for clause in found for m in clause]
    weight = sum(w for _, w, _ in every)
    distinct: dict[str, float] = {}
    for _, w, word in every:
        distinct[word] = max(w, distinct.get(word, 0.0))
    rest = [math.log1p(weight), math.log1p(sum(distinct.values())), math.log1p(100 * weight / (total + 20)), math.log1p(len(found)), 1.0 if found else 0.0]
    return np.concatenate((np.log1p(sums).ravel(), rest))


@dataclass
class Grammar:
    """Learned entries and the regression over clause sums."""

    entries: dict[str, float]
    starts: dict[str, float]
    threats: dict[str, float]
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def lexicon(self) -> Lexicon:
        return Lexicon(self.entries, self.starts, self.threats)

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        z = float((features(text, lexicon) - self.centre) / self.scale @ self.weight + self.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each label that hold a word, or a word's beginning, of one task's rows."""
    pos: Counter = Counter()
    neg: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(pos.keys() | neg.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["entry", "pos", "neg"])

    for b in batches:
        for t, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            words = {w for w in _WORDS.findall((t.as_py() or "").lower()) if w not in _ENDS}
            found = {"=" + w for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) > k}
            (pos if y else neg).update(found)
        if len(pos) + len(neg) > 400_000:
            yield out()
            pos.clear()
            neg.clear()
    yield out()


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0; without both labels nothing is toxic.

    The sample is bounded by `rows` of each label, about; null ids and labels other than 0 and 1 teach nothing, and
    of rows that label one document alike one counts. The lexicon holds every entry that is significant in the sample.
    """
    spark = tune(docs.sparkSession)
    own = labels.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    seen = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = Grammar({}, {}, {}, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), -4.0)
    if not seen.get(0) or not seen.get(1):
        return nothing
    # a bounded sample: rows whose hash is below the share wanted of their label
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, rows / seen[1])).otherwise(min(1.0, rows / seen[0]))
    chosen = own.where(draw < share).limit(3 * rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2)))
    sample = written(sample, "toxic-train")
    size = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 4:
        return nothing
    p, n = size[0, 1], size[0, 0]
    counts = sample.where("half = 0").select("text", "toxic").mapInArrow(released(_counts), "entry string, pos bigint, neg bigint")
    threat = F.col("entry").isin(["=" + w for w in THREATS])
    counts = counts.groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where((F.col("pos") >= LEAST_ROWS) | threat)
    odds = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (n + 1.0))
    spread = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    counts = written(counts.withColumn("odds", odds).withColumn("z", odds / spread), "toxic-counts")
    best = counts.where((F.col("pos") >= LEAST_ROWS) & (F.col("z") > 2.5) & (F.col("odds") > 1.0)).select("entry", "odds").collect()
    starts = {r["entry"]: float(r["odds"]) for r in best if r["entry"][0] != "="}
    entries = {r["entry"][1:]: float(r["odds"]) for r in best if r["entry"][0] == "="}
    seen_threats = counts.where(threat & (F.col("pos") + F.col("neg") >= LEAST_ROWS)).select("entry", "odds").collect()
    threats = dict.fromkeys(THREATS, THREAT_WEIGHT) | {r["entry"][1:]: max(0.0, float(r["odds"])) for r in seen_threats}
    if starts:  # words under a bad beginning that are themselves harmless
        under = F.substring(F.substring("entry", 2, 1 << 20), 1, min(PREFIXES)).isin(sorted({s[: min(PREFIXES)] for s in starts}))
        for r in counts.where(F.col("entry").startswith("=") & (F.col("odds") <= 1.0) & under).select("entry").collect():
            entries.setdefault(r["entry"][1:], 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries, starts, threats)
        for b in batches:
            x = [features(t.as_py(), lexicon).tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.where("half = 1").select("text", "toxic").mapInArrow(released(measure), "y int, x array<double>").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float)
    weight = np.where(y == 1, seen[1] / max(1, y.sum()), seen[0] / max(1, (1 - y).sum()))  # back to the labels' shares
    weight *= len(y) / weight.sum()
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    b = logistic((x - centre) / scale, y, weight)
    return Grammar(entries, starts, threats, centre, scale, b[:-1], float(b[-1]))


def score(docs: DataFrame, learned: Grammar, text: str = "text") -> DataFrame:
    """docs with score (0 to 1); null, empty and wordless texts have no matched clause and get the score of none.

    Whole texts are read; repeated rows get the same score and equal scores are left equal; an empty table gives an empty
    one; other columns come through, and a column named score is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    tune(docs.sparkSession)
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = learned.lexicon()
        for b in batches:
            s = pa.array([learned.score(t.as_py(), lexicon) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], schema=arrow)

    return docs.mapInArrow(released(run), schema)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    """op10: per document its score and the label that it predicts."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
