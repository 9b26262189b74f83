"""Language identification with string kernels.

A text's blended spectrum is the set of its n-grams of 1 to MAX_N letters (others become one space), hashed into D
buckets; the presence kernel of two texts is the number of buckets in both, normalised by the geometric mean of their
own. LANDMARKS training texts span a Nystroem map; one-versus-rest kernel ridge regression in it gives a value per
language. Texts are scored in batches by matrix products of presence rows, landmarks and the regression's weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import crc_mod, only, released, tune

MAX_N = 3
BITS = 16
D = 1 << BITS
#: Training rows of each language, about (the bound of the sample), and landmarks of each.
TRAIN_ROWS = 240
LANDMARKS = 24
RIDGE = 1e-2
#: Turns regression values into a distribution.
SHARPNESS = 6.0
UNKNOWN = "und"

_OTHERS = re.compile(r"[\W\d_]+")
# \w also holds numerals that are no letters; a class beyond 16 bits would be searched one by one
_NUMERALS = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
_SCALE = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def spectrum(text: str | None) -> np.ndarray | None:
    """Presence of every bucket; None for a text without a letter."""
    if not text:
        return None
    if not text.isascii() and _NUMERALS.search(text):
        text = _NUMERALS.sub(" ", text)
    clean = _OTHERS.sub(" ", text.lower())
    if not any(map(str.isalpha, clean)):
        return None
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    seen = np.zeros(D, dtype=bool)
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(MAX_N):
        h = (h[: len(c) - n] ^ (c[n:] + np.uint32(n))) * _SCALE[n % 3]
        seen[h >> np.uint32(32 - BITS)] = True
    return seen


@dataclass
class KernelModel:
    """Landmarks over the buckets that any of them has, and the weights that map kernels to languages."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray  # columns x landmarks, presence
    own: np.ndarray  # kernel of each landmark with itself
    weights: np.ndarray  # landmarks + 1 x languages

    def values(self, rows: list[np.ndarray]) -> np.ndarray:
        """Regression values, one row per spectrum: two matrix products for the batch."""
        size = np.array([max(1, int(np.count_nonzero(r))) for r in rows], dtype=np.float64)
        x = np.stack([r[self.columns] for r in rows]).astype(np.float32)
        k = (x @ self.landmarks).astype(np.float64) / np.sqrt(size[:, None] * self.own[None, :])
        return np.hstack((k, np.ones((len(k), 1)))) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        spectra = [spectrum(t) for t in texts]
        at = [i for i, s in enumerate(spectra) if s is not None]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if at and self.languages:
            v = SHARPNESS * self.values([spectra[i] for i in at])
            e = np.exp(v - v.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            for i, best, p in zip(at, e.argmax(axis=1), e.max(axis=1), strict=True):
                names[i], scores[i] = self.languages[best], float(p)
        return names, scores


def fit(rows: list[tuple[str, np.ndarray]], languages: list[str], landmarks: int = LANDMARKS) -> KernelModel:
    """Nystroem landmarks (the first rows of each language) and one-versus-rest ridge regression."""
    by = {lang: [s for name, s in rows if name == lang] for lang in languages}
    chosen = np.stack([s for lang in languages for s in by[lang][:landmarks]])
    columns = np.flatnonzero(chosen.any(axis=0))
    own = chosen.sum(axis=1).astype(np.float64)
    z = chosen[:, columns].T.astype(np.float32)
    kmm = (z.T.astype(np.float64) @ z.astype(np.float64)) / np.sqrt(own[:, None] * own[None, :])
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    raw = KernelModel(languages, columns, z, own, np.eye(len(own) + 1))
    x = np.concatenate([raw.values([s for _, s in rows[i : i + 128]]) for i in range(0, len(rows), 128)])[:, :-1] @ whiten
    y = np.array([[1.0 if name == lang else -1.0 for lang in languages] for name, _ in rows])
    share = np.array([1.0 / len(by[name]) for name, _ in rows])
    share *= len(rows) / share.sum()  # every language weighs the same
    x = np.hstack((x, np.ones((len(x), 1))))
    penalty = RIDGE * len(rows) / len(languages) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve((x * share[:, None]).T @ x + penalty, (x * share[:, None]).T @ y)
    return KernelModel(languages, columns, z, own, np.vstack((whiten @ w[:-1], w[-1:])))


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> KernelModel:
    """Fit on rows of non-null lang whose crc32(doc_id as text) mod 3 is not 1; a bounded sample of each language.

    Spectra are made on the executors; the driver gets 8 kB a sampled row. Without training rows nothing is learned.
    """
    tune(docs.sparkSession)
    own = docs.where((crc_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
    seen = own.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not seen:
        return KernelModel([], np.zeros(0, int), np.zeros((0, 0)), np.zeros(0), np.zeros((1, 0)))
    share = F.lit(0.0)
    for r in seen:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 1.5 * rows / r["n"])).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 24)) / float(1 << 24)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [None if (s := spectrum(t.as_py())) is None else np.packbits(s).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), pa.array(bits, pa.binary())], names=["lang", "draw", "bits"])

    drawn = own.withColumn("draw", draw).where(F.col("draw") < share).select("lang", "draw", "text")
    got = drawn.mapInArrow(released(run), "lang string, draw double, bits binary").where("bits is not null").collect()
    got.sort(key=lambda r: (r["draw"], r["lang"]))
    kept: dict[str, list[np.ndarray]] = {}
    for r in got:
        if len(held := kept.setdefault(r["lang"], [])) < rows:
            held.append(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)).astype(bool))
    languages = sorted(kept)
    return fit([(lang, s) for lang in languages for s in kept[lang]], languages) if languages else KernelModel([], np.zeros(0, int), np.zeros((0, 0)), np.zeros(0), np.zeros((1, 0)))


def identify(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language; "und" for null texts and texts without a letter) and score (0 to 1).

    Whole texts count; "und" has score 0; repeated rows get equal results; ties go to the first language by name; an empty
    table gives an empty one. Columns named as the new ones are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = StructType(docs.schema.fields + StructType.fromDDL("lang_pred string, score double").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=arrow)

    return docs.mapInArrow(released(run), schema)


def langid_query(spark, sf_dir: str) -> DataFrame:
    """op3: per document the predicted language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(only(docs, "doc_id", "text", "lang"))
    out = identify(only(docs, "doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
