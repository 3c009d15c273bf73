"""Language identification by nearest centroids.

A text becomes hashed byte n-grams (2 to 4 bytes of its letters, lower-cased, words set apart), its counts a TF-IDF vector of length 1. Each
language has CLUSTERS centroids, by spherical k-means over its training vectors. A text takes the language of the centroid
with the greatest cosine; if even that is below the language's rejection distance, the text is marked as rejected.

Training reads a bounded sample of labelled documents: for each language the PER_LANGUAGE distinct ones (doc_id and text) with the least
hashes among those outside the held-out fold, or all if fewer; counts per language come from all labels. Vectors are made on the executors; the driver
gets the sample's vectors (PER_LANGUAGE x languages x DIMS floats), never texts. Prediction is a map over whole texts.

Nulls: a text that is null or has no letter is `und`, score 0, and rejected. With no labels at all every text is `und`. A null
doc_id is in the fold that crc32 of an empty text gives. Repeated rows predict alike. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.common import Carried, session, texts

DIMS = 4096
CLUSTERS = 3
#: Bound of the training sample for each language.
PER_LANGUAGE = 400
FOLDS = 5
UNKNOWN = "und"
#: The share of training vectors that a language's rejection distance keeps, and a factor that widens it.
KEPT, SLACK = 0.995, 0.6
#: Below so many n-grams the rejection distance is eased with their root: few n-grams are far from any centroid.
ENOUGH = 400
SEED = 5

#: Bytes of letters in UTF-8: ASCII letters lower-cased, and everything from 0x80 on; other bytes part words.
_FOLD = np.full(256, 0, np.uint32)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of the text's hashed n-grams."""
    b = _FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(b) + 1, bool)  # runs of bytes that aren't letters shrink to one
    b = np.concatenate((b, [0])).astype(np.uint32)
    keep[1:] = (b[1:] != 0) | (b[:-1] != 0)
    b = np.concatenate(([np.uint32(0)], b[keep]))
    out = np.zeros(DIMS, np.int64)
    gram = b.copy()
    for n in range(2, 5):
        gram = gram[:-1] * np.uint32(257) + b[n - 1 :]
        mixed = gram * np.uint32(2654435761) + np.uint32(n)
        out += np.bincount((mixed ^ mixed >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(20), minlength=DIMS)
    return out


def vector(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found) * idf
    return v / max(np.linalg.norm(v), 1e-12)


def eased(n: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, np.sqrt(np.maximum(n, 1) / ENOUGH))


def held_out(doc_id: str = "doc_id", folds: int = FOLDS):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == 0


class Centroids:
    """languages, idf (DIMS), centroids (n x DIMS), their languages, and the least cosine that each accepts."""

    def __init__(self, labels: list[str], found: np.ndarray, clusters: int = CLUSTERS, seed: int = SEED):
        self.languages = sorted(set(labels))
        self.idf = np.log((1 + len(found)) / (1 + (found > 0).sum(0))) + 1 if len(found) else np.ones(DIMS)
        m = np.log1p(found) * self.idf
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        of = np.array([self.languages.index(x) for x in labels], int)
        self.centroids, self.of, self.least = [], [], []
        for k in range(len(self.languages)):
            mine = m[of == k]
            centers = self._means(mine, min(clusters, len(mine)), seed)
            near = (mine @ centers.T).max(1) / eased(found[of == k].sum(1))
            self.centroids += list(centers)
            self.of += [k] * len(centers)
            self.least += [SLACK * float(np.quantile(near, 1 - KEPT))] * len(centers)
        self.centroids = np.array(self.centroids).reshape(-1, DIMS).astype(np.float32)

    @staticmethod
    def _means(m: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
        rng = np.random.default_rng(seed)
        centers = m[rng.choice(len(m), k, replace=False)]
        for _ in range(rounds):
            near = (m @ centers.T).argmax(1)
            sums = np.array([m[near == j].sum(0) if (near == j).any() else centers[j] for j in range(k)])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        return centers

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score (the greatest cosine), and if the text is rejected."""
        if not len(self.centroids) or not has_letter(text):
            return UNKNOWN, 0.0, True
        found = counts(text)
        cosines = self.centroids @ vector(found, self.idf).astype(np.float32)
        best = int(cosines.argmax())
        least = self.least[best] * eased(found.sum())
        return self.languages[self.of[best]], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < least)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = FOLDS) -> Centroids:
    """docs: doc_id, text, lang."""
    session(docs)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id", folds))
    n = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    if not n:
        return Centroids([], np.zeros((0, DIMS)))
    # a hash bound that twice as many distinct documents pass as are wanted; copies pass together and are one
    rate = F.create_map(*(x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, 2 * per_language / v)))))
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 2)
    some = labelled.where(F.col("text").isNotNull()).withColumn("mark", mark).where(F.col("mark") < rate[F.col("lang")] * F.lit(float(1 << 62)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id"))
    sample = some.dropDuplicates(["lang", "mark"]).withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([counts(t).astype("<u4").tobytes() for t in texts(b)], pa.binary())], ["doc_id", "lang", "found"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, lang string, found binary").collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, r["found"]))
    return Centroids([r["lang"] for r in rows], np.array([np.frombuffer(r["found"], "<u4") for r in rows], float).reshape(-1, DIMS))


def predicted(docs: DataFrame, model: Centroids, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with _lang, _score and _rejected; the text alone decides."""
    from pyspark.sql import types as T

    shared = session(docs).sparkContext.broadcast(model)  # bounded: CLUSTERS x languages x DIMS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in texts(b, text)]
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *more], [*keep, "_lang", "_score", "_rejected"])

    rows = docs.select(*dict.fromkeys([*keep, text]))
    more = [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_rejected", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *more]))


def identify(docs: DataFrame, model: Centroids | None = None, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs (doc_id, text, lang)."""
    model = model or train(docs, folds=folds)
    rows = predicted(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out("doc_id", folds).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def accepted(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """docs without the rows that are rejected."""
    c = Carried(docs)
    return c.back(predicted(c.rows, train(docs, folds=folds), c.own, c["text"]).where(~F.col("_rejected")))


def op3_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
