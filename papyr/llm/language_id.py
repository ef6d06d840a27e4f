"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family (one against the rest)
chooses the family; inside it, one-versus-one linear machines vote between the
closely related languages.  Features are hashed byte n-grams of the lower-cased
whole text (runs of ASCII characters but letters become one space).

Models are fitted on a bounded sample of labelled rows: PER_LANGUAGE documents
of each language, fewer where all languages together would exceed MOST_ROWS
(parameters); those with the smallest hashes, so the sample is the same on any
cluster.  Rows whose hash cannot be among them are left where they are, so what
is shuffled does not grow with the table.  Predictions cover every row.

Defined results: `und` with score 0 for a text that is null or has no letter,
or when no labelled row exists; one learnt language gives that language; an
undecided machine votes for the later of its two languages in alphabetical
order, and of languages with equal votes the first is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from papyr.llm.common import read, share, slices

BUCKETS = 1 << 13
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 256
#: Rows of the sample in all; bounds what the driver fits on (33 KB a row, and their Gram matrix).
MOST_ROWS = 4096
UNDETERMINED = "und"

#: ISO 639-1 codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru pl cs sk uk bg sr hr sl mk be bs".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "cy ga gd br".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi ur bn mr gu pa ne si".split(),
    "semitic": "ar he am mt".split(),
}

_BLANK = np.full(256, 32, np.uint8)
_BLANK[97:123] = np.arange(97, 123)
_BLANK[128:] = np.arange(128, 256)
_NOT_LETTERS = re.compile(rb" {2,}")
_TABLE = bytes(_BLANK)


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """Rows of unit length: square roots of the shares of hashed byte n-grams."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        raw = b" " + _NOT_LETTERS.sub(b" ", text.lower().encode("utf-8", "replace").translate(_TABLE)) + b" "
        data = np.frombuffer(raw, np.uint8).astype(np.uint32)
        counts = np.zeros(BUCKETS, np.int64)
        code = np.zeros(len(data), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(data) < n:
                break
            code = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :]
            if n in GRAMS:
                slot = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(19)
                counts += np.bincount(slot, minlength=BUCKETS)
        row = np.sqrt(counts)
        out[i] = row / max(np.sqrt((row * row).sum()), 1e-9)
    return out


def fit_svm(gram: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Linear machine with squared hinge loss and balanced classes, by accelerated gradient steps; y is +-1.

    The weights stay in the span of the training rows, so the steps are made on
    the rows' coefficients, which are returned: gram is X X' (with the bias as
    a constant feature) and the weights are X' times the result.
    """
    n = len(y)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost
    # largest curvature: 1 (regulariser) + 2 * top eigenvalue of the weighted Gram matrix
    root = np.sqrt(weight)
    v = np.ones(n) / np.sqrt(n)
    for _ in range(12):
        v = root * (gram @ (root * v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    rate = 1 / (1 + 2.2 * top)
    a = look = np.zeros(n)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (gram @ look))
        new = look - rate * (look - 2 * weight * slack * y)
        look = new + k / (k + 3) * (new - a)
        a = new
    return a


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    #: One column per family, then one per pair of languages of a family.
    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[int, int]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score in 0..1) of every row."""
        margin = x @ self.weights + self.bias
        names = sorted(set(self.families))
        k = len(names) if len(names) > 1 else 0
        chance = 1 / (1 + np.exp(-4 * margin))
        fam = margin[:, :k].argmax(1) if k else np.zeros(len(x), np.int64)
        sure = chance[:, :k].max(1) if k else np.ones(len(x))
        votes = np.zeros((len(x), len(self.languages)))
        for j, (a, b) in enumerate(self.pairs):
            p = chance[:, k + j]
            votes[:, a] += (p > 0.5) + 0.001 * p
            votes[:, b] += (p <= 0.5) + 0.001 * (1 - p)
        member = np.array([[f == n for f in self.families] for n in names])
        votes = np.where(member[fam], votes, -1)
        best = votes.argmax(1)
        least = np.ones(len(x))
        for j, (a, b) in enumerate(self.pairs):
            p = chance[:, k + j]
            least = np.where(best == a, np.minimum(least, p), np.where(best == b, np.minimum(least, 1 - p), least))
        return best, np.clip(np.minimum(sure, least), 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    languages = sorted(set(langs))
    families = [family(v) for v in languages]
    names = sorted(set(families))
    at = np.array([languages.index(v) for v in langs])
    fam = np.array([names.index(families[i]) for i in at])
    gram = (x @ x.T).astype(np.float64) + 1
    columns = []
    if len(names) > 1:
        columns += [fit_svm(gram, np.where(fam == k, 1.0, -1.0)) for k in range(len(names))]
    pairs = [(a, b) for a in range(len(languages)) for b in range(a + 1, len(languages)) if families[a] == families[b]]
    for a, b in pairs:
        own = np.flatnonzero((at == a) | (at == b))
        c = np.zeros(len(x))
        c[own] = fit_svm(gram[np.ix_(own, own)], np.where(at[own] == a, 1.0, -1.0))
        columns.append(c)
    c = np.stack(columns, 1) if columns else np.zeros((len(x), 0))
    return Model(languages, families, x.T @ c.astype(np.float32), c.sum(0).astype(np.float32), pairs)


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most per_language rows (text, lang) of each language, and about MOST_ROWS in all: those with the smallest hashes."""
    hashed = labelled.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    # rows that differ, within some hundredths: however often a row repeats, it is one
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    languages = counts.count()
    each = max(1, min(per_language, MOST_ROWS // max(1, languages)))
    # the smallest `each` of n hashes lie below this share of all with near certainty: its mean and ten deviations more, and a fifth for the estimate
    share = 1.2 * (each + 10 * each**0.5) / F.col("n")
    span = float(1 << 62)
    limit = counts.select("lang", F.least(F.lit(span), share * span).alias("limit"))
    # a row for each language; as many as the models have
    near = hashed.join(F.broadcast(limit) if languages <= MOST_ROWS else limit, "lang").where("h <= limit")
    # repeated rows once, before they are counted in order
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    w = W.partitionBy("lang").orderBy("h")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each).select("text", "lang")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on the sample; only its feature vectors, a bounded number, come to the driver."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            rows = [(t, v) for t, v in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if has_letter(t)]
            if rows:
                x = features([t for t, _ in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v for _, v in rows]), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"]
                )

    got = training_sample(labelled, per_language).mapInArrow(vectors, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist(), strict=True))  # whatever the order of tasks
    x = np.stack([np.frombuffer(v, np.float32) for _, v in rows])
    return fit(x, [v for v, _ in rows])


def predict(docs: DataFrame, model: Model | None, lang: str = "lang_pred", sure: str = "score") -> DataFrame:
    """All columns of `docs`, then the language and the score under the names given; uses nothing but the text.

    Columns of `docs` that have those names are replaced: name others to keep them.
    """
    spark = docs.sparkSession
    shared = share(spark, model)
    docs = docs.select(*(c for c in docs.columns if c not in (lang, sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        for batch in slices(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            found, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if has_letter(t)] if m else []
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                best, p = m.predict(features([texts[i] for i in part]))
                for i, b, s in zip(part, best, p, strict=True):
                    found[i], score[i] = m.languages[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, lang, sure])

    out = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(sure, T.DoubleType())])
    return docs.mapInArrow(run, out)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows with crc32(doc_id) mod 4 = 2 are held out of training."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    model = train(base.where("not held_out and lang is not null and text is not null"))
    return predict(base.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    A null or letterless text is `und` with score 0; a null doc_id is not held
    out and stays null; repeated rows give repeated results; an empty table
    gives none.
    """
    return identify(read(spark, sf_dir, "documents"))
