"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Counts of all words of all training documents come from one distributed
aggregation and grow with the corpus.  They give the base score, the noise and
the probability of a word within its class.  The neural model predicts one of
OUTPUTS outcomes: the most frequent words, each by itself, and classes of all
other words, told by a word's last three bytes, so that an unseen word has a
class too.  A word's probability is that of its outcome after the CONTEXT words
before it, times that of the word among the words of its class.  Both are
normalised, the first by a softmax over all outcomes that batched matrix
products give, the second by add-one smoothing with one unseen word a class.

The model is log-bilinear: the vectors of the words before, each weighted by
the vector of its position, are added, and an outcome's score is the product
with its own vector plus a bias.  Each training document is seen once a pass.
In a round every task trains on its own share of that round's documents from
the same parameters by noise-contrastive steps in which a batch shares its
noise words; the parameters are then averaged, each row by how often tasks
touched it, in an aggregation with map-side combine.  Only parameters and the
HEAD most frequent words, bounded numbers, pass through the driver.

Defined results: a null text is empty and has one token, the end; a null doc_id
counts as not held out and stays null; repeated rows are documents of their
own; without training documents all counts are zero and the base score is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import Tables, read, share, slices
from papyr.llm.textunits import WORD_BYTES, mix, token_array

#: The end of a text; no word holds a line feed.  Words of over LONG bytes are known by a digest behind one.
END, LONG = b"\n", 64
#: Words whose counts are sent to all tasks; those that have a vector of their own as context; those that are outcomes.
HEAD, INPUTS, SINGLE = 131_072, 8192, 160
CLASSES = 96
OUTPUTS = SINGLE + CLASSES
#: Codes of words before: INPUTS words, classes, the start of a text.
START = INPUTS + CLASSES
CONTEXT, DIMENSION = 3, 16
#: Steps: rounds a pass, tokens a batch, noise words a batch, rate.
ROUNDS, BATCH, NOISE, RATE = 4, 2048, 96, 0.15
SLICE_BYTES = 4_000_000


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def word_classes(words: pa.Array) -> np.ndarray:
    """The class of each word: a hash of its last three bytes."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.empty(0, np.uint8)
    value = np.zeros(len(words), np.uint64)
    for k in range(1, 4):
        has = at[1:] - at[:-1] >= k
        value[has] += (data[at[1:][has] - k].astype(np.uint64) + np.uint64(1)) << np.uint64(9 * k)
    return (mix(value) % np.uint64(CLASSES)).astype(np.int32)


def keyed(words: pa.Array) -> pa.Array:
    """The words, each of over LONG bytes replaced by a digest."""
    long = np.flatnonzero(pc.binary_length(words).to_numpy() > LONG)
    if not len(long):
        return words
    digests = [END + hashlib.sha256(words[int(i)].as_py()).hexdigest().encode() for i in long]
    mask = np.zeros(len(words), bool)
    mask[long] = True
    return pc.replace_with_mask(words, pa.array(mask), pa.array(digests, pa.large_binary()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, c): every distinct token of the texts, the end included, with the number of its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            words, _ = token_array(batch.column("text"), WORD_BYTES, True)
            coded = words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            names = pa.concat_arrays([keyed(coded.dictionary), pa.array([END], pa.large_binary())])
            yield pa.RecordBatch.from_arrays(
                [names.cast(pa.binary()), pa.array(np.append(word_classes(coded.dictionary), -1), pa.int32()), pa.array(np.append(n, batch.num_rows), pa.int64())],
                names=["word", "class", "c"],
            )

    return docs.select("text").mapInArrow(run, "word binary, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts that all tasks know: the head words, the end first, and sums of the classes."""

    words: pa.Array
    counts: np.ndarray
    classes: np.ndarray
    total: int
    types: int
    class_total: np.ndarray
    class_types: np.ndarray

    @property
    def outcome(self) -> np.ndarray:
        """The outcome that each code of a word stands for."""
        own = np.where(np.arange(INPUTS) < SINGLE, np.arange(INPUTS), 0)
        own[SINGLE : len(self.classes)] = SINGLE + self.classes[SINGLE:INPUTS]
        return np.concatenate((own, SINGLE + np.arange(CLASSES), [0])).astype(np.int64)

    @property
    def unigram(self) -> np.ndarray:
        """Smoothed shares of the outcomes."""
        n = np.ones(OUTPUTS)
        own = self.counts[:SINGLE]
        n[: len(own)] += own
        n[SINGLE:] += self.class_total
        return n / n.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From all counts; at most HEAD words of at most LONG + 1 bytes come to the driver."""
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    end = counts.where(F.col("class") < 0).first()
    most = counts.where(F.col("class") >= 0).orderBy(F.desc("c"), "word").limit(HEAD - 1).toArrow()
    words = pa.concat_arrays([pa.array([END], pa.large_binary()), *(c.cast(pa.large_binary()) for c in most.column("word").chunks)])
    c = np.append(end["c"] if end else 0, most.column("c").to_numpy()).astype(np.int64)
    classes = np.append(-1, most.column("class").to_numpy()).astype(np.int32)
    sums = counts.where(F.col("class") >= 0).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_total, class_types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums:
        class_total[r["class"]], class_types[r["class"]] = r["n"], r["v"]
    single = slice(1, SINGLE)
    np.subtract.at(class_total, classes[single], c[single])
    np.subtract.at(class_types, classes[single], 1)
    return Vocabulary(words, c, classes, row["n"] or 0, row["v"] or 0, class_total, class_types)


CODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, codes binary, tail array<struct<word:binary,class:int,n:int>>"


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Each document (doc_id, held_out, text) as codes of its tokens, sums over its head words, and its other words with their numbers."""
    shared = share(docs.sparkSession, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared()
        base = np.log10((v.counts + 1) / (v.total + v.types + 1))
        within = np.zeros(len(v.counts))
        k = v.classes[SINGLE:]
        within[SINGLE:] = np.log10((v.counts[SINGLE:] + 1) / (v.class_total[k] + v.class_types[k] + 1))
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = batch.num_rows
            words, n = token_array(batch.column("text"), WORD_BYTES, True)
            coded = words.dictionary_encode()
            names, code = keyed(coded.dictionary), coded.indices.to_numpy()
            kind = word_classes(coded.dictionary)
            at = pc.fill_null(pc.index_in(names, v.words), -1).to_numpy(zero_copy_only=False)
            own = np.where((at >= 0) & (at < INPUTS), at, INPUTS + kind).astype(np.uint16)
            doc = np.repeat(np.arange(rows), n)
            head = at[code]
            inside = head >= 0
            sums = [np.bincount(doc[inside], x[head[inside]], rows).astype(np.float64) for x in (base, within)]
            known = np.bincount(doc[inside], minlength=rows)
            # words out of the head: a row for each document and word
            far = np.flatnonzero(~inside)
            cell, times = np.unique(doc[far].astype(np.int64) * max(1, len(names)) + code[far], return_counts=True)
            which = cell % max(1, len(names))
            cuts = np.searchsorted(cell, np.arange(rows + 1) * max(1, len(names)))
            tail = pa.StructArray.from_arrays([names.take(pa.array(which)).cast(pa.binary()), pa.array(kind[which], pa.int32()), pa.array(times, pa.int32())], ["word", "class", "n"])
            # a text's codes end with that of its end
            stops = np.cumsum(n)
            codes = np.insert(own[code], stops, 0)
            offsets = np.concatenate(([0], (stops + np.arange(1, rows + 1)) * 2)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1, pa.int64()), pa.array(known + (v.counts[0] > 0), pa.int64()),
                    pa.array(sums[0] + base[0]), pa.array(sums[1]),
                    pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(codes.astype("<u2").tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tail),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "within", "codes", "tail"],
            )

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(run, CODED)


class Model:
    """Vectors of words before, positions and outcomes, with biases, as rows of one matrix and their AdaGrad sums."""

    def __init__(self, rows: np.ndarray, grown: np.ndarray):
        self.rows, self.grown = rows, grown
        self.touched = np.zeros(len(rows))

    @classmethod
    def first(cls, unigram: np.ndarray) -> Model:
        """Small random vectors; biases that give the shares of the outcomes."""
        rng = np.random.default_rng(13)
        rows = rng.normal(0, 0.1, (START + 1 + CONTEXT + OUTPUTS, DIMENSION + 1)).astype(np.float32)
        rows[START + 1 : START + 1 + CONTEXT, :DIMENSION] += 1
        rows[:, DIMENSION] = 0
        rows[-OUTPUTS:, DIMENSION] = np.log(unigram)
        return cls(rows, np.full(rows.shape, 0.01, np.float32))

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = DIMENSION
        return self.rows[: START + 1, :d], self.rows[START + 1 : START + 1 + CONTEXT, :d], self.rows[-OUTPUTS:, :d], self.rows[-OUTPUTS:, d]

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The predicted vector after each row of codes of the words before."""
        words, place, _, _ = self.parts
        return sum(words[before[:, i]] * place[i] for i in range(CONTEXT))

    def log10(self, before: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each outcome after its words, by one matrix product a batch."""
        _, _, out, bias = self.parts
        value, one = np.empty(len(outcome)), np.ones(OUTPUTS, np.float32)
        for at in range(0, len(outcome), BATCH):
            score = self.predicted(before[at : at + BATCH]) @ out.T
            score += bias
            own = score[np.arange(len(score)), outcome[at : at + BATCH]].astype(np.float64)
            top = max(0.0, float(score.max()) - 60)  # far from the end of the range of exp
            np.exp(score - np.float32(top) if top else score, out=score)
            value[at : at + BATCH] = (own - top - np.log(score @ one)) / np.log(10)
        return value

    def _step(self, at: np.ndarray, gradient: np.ndarray, columns: slice) -> None:
        """AdaGrad on the rows `at`, repeated ones summed."""
        order = np.argsort(at.astype(np.uint16), kind="stable")  # by radix; there are fewer rows than 65,536
        at = at[order]
        head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        total = np.add.reduceat(gradient[order], head, axis=0)
        own = at[head]
        grown = self.grown[own, columns] + total * total
        self.grown[own, columns] = grown
        self.rows[own, columns] -= RATE * total / np.sqrt(grown)
        self.touched[own] += np.diff(np.append(head, len(at)))

    def train(self, before: np.ndarray, outcome: np.ndarray, unigram: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive steps; a batch shares its noise outcomes."""
        words, place, out, bias = self.parts
        d, first = slice(0, DIMENSION), len(self.rows) - OUTPUTS
        shift = np.log(NOISE * unigram).astype(np.float32)
        edges = np.cumsum(unigram)
        order = rng.permutation(len(outcome))
        for low in range(0, len(order), BATCH):
            b, y = before[order[low : low + BATCH]], outcome[order[low : low + BATCH]]
            noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), OUTPUTS - 1)
            near = [words[b[:, i]] for i in range(CONTEXT)]
            h = sum(near[i] * place[i] for i in range(CONTEXT))
            mine = out[y]
            delta = np.einsum("ij,ij->i", h, mine) + (bias - shift)[y]
            own = -1 / (1 + np.exp(np.minimum(delta, 60)))
            other = 1 / (1 + np.exp(-np.maximum(h @ out[noise].T + (bias - shift)[noise], -60)))
            # means over the batch times its root, so that the rate suits batches of any size
            scale = np.float32(1 / np.sqrt(len(y)))
            own, other = own * scale, other * scale
            back = own[:, None] * mine + other @ out[noise]
            grad_out = np.concatenate((own[:, None] * h, other.T @ h))
            grad_bias = np.concatenate((own, other.sum(axis=0)))[:, None]
            grad_place = np.stack([np.einsum("ij,ij->j", back, x) for x in near])
            grad_words = np.concatenate([back * place[i] for i in range(CONTEXT)])
            self._step(first + np.concatenate((y, noise)), np.concatenate((grad_out, grad_bias), axis=1), slice(0, DIMENSION + 1))
            self._step(START + 1 + np.arange(CONTEXT), grad_place, d)
            self._step(b.T.ravel().astype(np.int64), grad_words, d)


def contexts(codes: list[bytes], outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the CONTEXT words before each token, nearest first, outcomes, tokens of each text)."""
    each = [np.frombuffer(c, "<u2") for c in codes]
    n = np.array([len(c) for c in each], np.int64)
    pad = np.full(CONTEXT, START, np.uint16)
    flat = np.concatenate([x for c in each for x in (pad, c)]) if each else np.empty(0, np.uint16)
    own = np.arange(n.sum()) + np.repeat(np.arange(1, len(n) + 1) * CONTEXT, n)
    return flat[own[:, None] - np.arange(1, CONTEXT + 1)], outcome[flat[own]], n


def trained(table: DataFrame, v: Vocabulary) -> Model:
    """The model after one pass over the training documents of an encoded table, in ROUNDS rounds."""
    spark = table.sparkSession
    model = Model.first(v.unigram)
    columns = [f"v{i}" for i in range(2 * (DIMENSION + 1))]
    schema = "i int, w double, " + ", ".join(f"{c} double" for c in columns)
    for k in range(ROUNDS):
        shared = share(spark, (model, v.unigram, v.outcome))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            start, unigram, outcome = shared()
            own, rng = Model(start.rows.copy(), start.grown.copy()), np.random.default_rng(k)
            for batch in slices(batches, "codes", SLICE_BYTES):
                before, y, _ = contexts(batch.column("codes").to_pylist(), outcome)
                own.train(before, y, unigram, rng)
            i = np.flatnonzero(own.touched)
            if len(i):
                values = np.concatenate((own.rows[i], own.grown[i]), axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(own.touched[i]), *(pa.array(values[:, c]) for c in range(values.shape[1]))], names=["i", "w", *columns])

        own = table.where(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k)).select("codes")
        mean = own.mapInArrow(run, schema).groupBy("i").agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in columns)).toArrow()
        at = mean.column("i").to_numpy()
        values = np.stack([mean.column(c).to_numpy() for c in columns], axis=1).astype(np.float32) if len(at) else np.empty((0, len(columns)), np.float32)
        model = Model(model.rows.copy(), model.grown.copy())
        model.rows[at], model.grown[at] = values[:, : DIMENSION + 1], values[:, DIMENSION + 1 :]
    return model


def model_scores(table: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """The columns of an encoded table but codes and tail, and `model`: the sum of log10 probabilities of all outcomes."""
    shared = share(table.sparkSession, (model, v.outcome))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, outcome = shared()
        for batch in slices(batches, "codes", SLICE_BYTES // 4):
            before, y, n = contexts(batch.column("codes").to_pylist(), outcome)
            value = np.add.reduceat(model.log10(before, y), np.cumsum(n) - n)
            at = batch.schema.get_field_index("codes")
            yield batch.set_column(at, "model", pa.array(value))

    kept = table.drop("tail")
    return kept.mapInArrow(run, ", ".join(f"{n} {t}" if n != "codes" else "model double" for n, t in kept.dtypes))


def tail_sums(table: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """(row, tail_known, tail_base, tail_within): sums over the words of each document that are not in the head."""
    far = table.select("row", F.inline("tail")).join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    size = F.get(F.array(*(F.lit(float(t + n + 1)) for t, n in zip(v.class_total, v.class_types, strict=True))), F.col("class"))
    return far.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(v.total + v.types + 1)))).alias("tail_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / size)).alias("tail_within"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    counts = tables.settle(word_counts(docs.where("not held_out")))
    v = vocabulary(counts)
    table = tables.settle(encoded(docs, v))
    model = trained(table, v)
    out = model_scores(table, v, model).join(tail_sums(table, counts, v), "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("known", "tail_known").cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        plus("base", "tail_base").alias("base_score"), (plus("model", "tail_within") + F.col("within")).alias("score"),
    )


def op13_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    A null or empty text is its end alone; an empty table gives no rows.
    """
    return score_documents(read(spark, sf_dir, "documents"))
