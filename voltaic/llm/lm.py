"""Masked pseudo-likelihood scoring of documents (operator 9).

A token is a white-space word (A-Z lower-cased) hashed to one of ``VOCABULARY`` ids. Its probability given the words on
both sides is ``p(class | two words before, two after) * p(id | class)``: classes part the ids by frequency into
``CLASSES`` of about equal mass, counted over all documents; the first factor is a small window network
(position-wise embeddings, one hidden layer, softmax) trained in numpy. Every token of every text is masked and
predicted once; a document's score is the sum of the log-probabilities.

Training is data-parallel: in each of ``ROUNDS`` rounds every task fits a copy on its share of the texts, every text that is
not null, and the copies are averaged by tokens in two levels, so no task gathers all of them. The broadcast
model has a fixed size.

A null or wordless text has no tokens, a sum of 0 and a null mean. An empty corpus gives a uniform model. Repeated
rows are scored each. Texts are read whole, in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm import hashing as H

VOCABULARY = 1 << 16
CLASSES = 64
CONTEXT = 1 << 12          # context embeddings: ids modulo this, and one for "outside the text"
WINDOW = (-2, -1, 1, 2)
HIDDEN = 16
ROUNDS = 2
BATCH = 4096
RATE = 0.1
SLICE = 4096               # numbers a row when copies of the network are averaged
U64 = np.uint64
F32 = np.float32


class Network:
    """Parameters in one flat vector: embeddings (window x context x hidden), bias, output matrix and bias."""

    SHAPES = ((len(WINDOW), CONTEXT + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, at = np.ascontiguousarray(flat, F32), 0
        views = []
        for s in self.SHAPES:
            n = int(np.prod(s))
            views.append(self.flat[at:at + n].reshape(s))
            at += n
        self.emb, self.bias, self.out, self.out_bias = views
        self.top = self.flat[-(HIDDEN + 1) * CLASSES:].reshape(HIDDEN + 1, CLASSES)      # out and out_bias as one matrix

    @classmethod
    def fresh(cls, class_mass: np.ndarray) -> "Network":
        net = cls(np.random.default_rng(17).normal(0, 0.1, cls.SIZE).astype(F32))
        net.bias[:] = 0
        net.out_bias[:] = np.log(np.maximum(class_mass, 1e-9))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.emb[0].take(context[0], 0)
        for j in range(1, len(WINDOW)):
            h += self.emb[j].take(context[j], 0)
        h += self.bias
        out = np.ones((len(h), HIDDEN + 1), F32)                # the last column meets out_bias
        np.tanh(h, out=out[:, :HIDDEN])
        return out

    def logits(self, h: np.ndarray) -> np.ndarray:
        """(classes x tokens) logits less each token's largest: sums over classes then run along whole rows."""
        z = self.top.T @ h.T
        z -= z.max(0)
        return z

    def log_class(self, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log-probability of each token's class."""
        z = self.logits(self.hidden(context))
        own = z[classes, np.arange(len(classes))]
        return own - np.log(np.exp(z, out=z).sum(0))

    def train(self, context: np.ndarray, classes: np.ndarray, sq: "Network") -> None:
        """One Adagrad step; ``sq`` holds the running squares of the gradients."""
        h = self.hidden(context)
        z = self.logits(h)
        np.exp(z, out=z)
        z *= 1 / (z.sum(0) * F32(len(classes)))
        z[classes, np.arange(len(classes))] -= F32(1 / len(classes))
        back = self.out @ z
        g = (z @ h).T
        sq.top += g * g
        self.top -= F32(RATE) * g / (np.sqrt(sq.top) + F32(1e-8))
        h = h[:, :HIDDEN].T
        back *= 1 - h * h
        g = back.sum(1)
        sq.bias += g * g
        self.bias -= F32(RATE) * g / (np.sqrt(sq.bias) + F32(1e-8))
        weights, columns = np.ascontiguousarray(back.T, np.float64).ravel(), np.arange(HIDDEN)
        for j in range(len(WINDOW)):
            rows = np.flatnonzero(np.bincount(context[j], minlength=CONTEXT + 1))
            cell = (context[j] * HIDDEN)[:, None] + columns
            g = np.bincount(cell.ravel(), weights, (CONTEXT + 1) * HIDDEN).reshape(-1, HIDDEN).take(rows, 0).astype(F32)
            seen = sq.emb[j].take(rows, 0)
            seen += g * g
            sq.emb[j][rows] = seen
            np.sqrt(seen, out=seen)
            seen += F32(1e-8)
            g /= seen
            g *= F32(RATE)
            self.emb[j][rows] = self.emb[j].take(rows, 0) - g


def token_ids(words: np.ndarray) -> np.ndarray:
    return (words >> U64(48)).astype(np.int64)


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(window x tokens) context slots; ``first``: index of the first token of each text."""
    n = len(ids)
    lengths = np.diff(first)
    begin, end = np.repeat(first[:-1], lengths), np.repeat(first[1:], lengths)
    at = np.arange(n)
    out = np.empty((len(WINDOW), n), np.int64)
    for j, d in enumerate(WINDOW):
        other = at + d
        inside = (other >= begin) & (other < end)
        out[j] = np.where(inside, ids[np.clip(other, 0, max(n - 1, 0))] & (CONTEXT - 1), CONTEXT)
    return out


def _texts(batch):
    raw, off = H.string_buffers(batch.column("text"))
    for lo, hi in H.batches_by_bytes(off):
        words, first = H.hash_words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], H.SPACE_WORDS)
        yield lo, hi, token_ids(words), first


def _count(batches):
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for _, _, ids, _ in _texts(batch):
            total += np.bincount(ids, minlength=VOCABULARY)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])


class Vocabulary:
    """Class of every id and log p(id | class), from the counts of the whole corpus."""

    def __init__(self, counts: np.ndarray):
        mass = counts + 0.5
        order = np.argsort(-mass, kind="stable")
        upto = np.cumsum(mass[order])
        self.classes = np.empty(VOCABULARY, np.int64)
        self.classes[order] = np.minimum((upto - mass[order] / 2) / upto[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        self.class_mass = np.bincount(self.classes, mass, CLASSES)
        self.within = np.log(mass / self.class_mass[self.classes])
        self.class_mass /= self.class_mass.sum()


def _train(shared):
    def run(batches):
        vocabulary, flat = shared.value
        net, squares, seen = Network(flat.copy()), Network(np.zeros(Network.SIZE, F32)), 0
        for batch in batches:
            for _, _, ids, first in _texts(batch):
                context, classes = contexts(ids, first), vocabulary.classes[ids]
                for p in range(0, len(ids), BATCH):
                    net.train(np.ascontiguousarray(context[:, p:p + BATCH]), classes[p:p + BATCH], squares)
                seen += len(ids)
        if seen:
            cut = range(0, Network.SIZE, SLICE)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(cut)), pa.int32()), pa.array([int(net.flat[:64].view(np.uint32).sum())] * len(cut), pa.int64()),
                pa.array([float(seen)] * len(cut), pa.float64()),
                pa.array([net.flat[c:c + SLICE] for c in cut], pa.list_(pa.float32()))],
                names=["part", "copy", "weight", "values"])
    return run


AVERAGED = "part int, copy long, weight double, values array<float>"


def _average(table: pa.Table) -> pa.Table:
    weight = table["weight"].to_numpy()
    values = np.stack([np.asarray(v.as_py(), np.float64) for v in table["values"]])
    mean = (weight[:, None] * values).sum(0) / weight.sum()
    return pa.table({"part": table["part"][:1], "copy": table["copy"][:1], "weight": pa.array([weight.sum()]),
                     "values": pa.array([mean.astype(F32)], pa.list_(pa.float32()))})


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray]:
    sc = docs.sparkSession.sparkContext
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    sums = texts.mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(VOCABULARY)
    counts[sums["id"].to_numpy()] = sums["n"].to_numpy()
    vocabulary = Vocabulary(counts)
    flat = Network.fresh(vocabulary.class_mass).flat
    for _ in range(ROUNDS):
        shared = sc.broadcast((vocabulary, flat))
        copies = texts.mapInArrow(_train(shared), AVERAGED)
        some = copies.withColumn("copy", F.pmod("copy", F.lit(256))).groupBy("part", "copy").applyInArrow(_average, AVERAGED)
        mean = some.groupBy("part").applyInArrow(_average, AVERAGED).toArrow().sort_by("part")
        if mean.num_rows:
            flat = np.concatenate([np.asarray(v.as_py(), F32) for v in mean["values"]])
    return vocabulary, flat


def token_log_probs(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary, net: Network) -> np.ndarray:
    context, classes = contexts(ids, first), vocabulary.classes[ids]
    out = vocabulary.within[ids].copy()
    for p in range(0, len(ids), BATCH):
        out[p:p + BATCH] += net.log_class(context[:, p:p + BATCH], classes[p:p + BATCH])
    return out


def _score(shared):
    def run(batches):
        vocabulary, flat = shared.value
        net = Network(flat)
        for batch in batches:
            for lo, hi, ids, first in _texts(batch):
                upto = np.concatenate([np.zeros(1), np.cumsum(token_log_probs(ids, first, vocabulary, net))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(upto[first[1:]] - upto[first[:-1]])], names=["id", "n_tokens", "log_prob"])
    return run


def score_documents(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, log_prob, mean_log_prob) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_score(shared), "id long, n_tokens long, log_prob double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_prob",
                      F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
