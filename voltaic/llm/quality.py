"""Quality classifier: nearest-neighbour voting in a latent semantic space (operator 4).

Terms of a text are its words, hashed, the hashed character n-grams of its shape (letters fold to one lower and one
upper class, digits to one, other ASCII characters stay) and marks for a word that repeats the one before or a passage
of four words seen earlier in the text. A text's vector holds the square roots of its relative term counts times the terms'
inverse document frequencies, the words together as long as the shape on average; a truncated singular value
decomposition of the labelled vectors (by subspace iteration) gives ``RANK`` latent directions.

``PER_CLASS`` labelled rows of each class at most, in the order of a seeded hash, are the neighbours: a documented bound
on what is collected and broadcast, whatever the corpus. Every text is compared with all of them by exact cosine, in
blocks of matrix products; its ``NEIGHBOURS`` nearest vote with their similarity, each class weighted by how many
labelled rows one of its neighbours stands for. ``score`` is the weighted share of label 1.

A text without terms (null or empty) scores the share of label 1 among the labelled rows, as does every text if
only one class or none was learned (then 0.5). Labels that are null or contradict each other for one id are not learned from.
Long texts are read whole, in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm import hashing as H
from voltaic.llm.langid import pieces
from voltaic.llm.ranks import seeded

PER_CLASS = 2000
SHAPES = 2046         # slots of character n-grams
WORDS = 2048          # slots of words
_MARKS = 2            # last slots: repeated word, repeated passage
TERMS = SHAPES + WORDS + _MARKS
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 4         # a vote weighs cosine ** SHARPNESS
ORDERS = (1, 2, 3)
U32, U64 = np.uint32, np.uint64
_MUL = (H.MIX[8:16] & U64(0xFFFFFFFF)).astype(U32)


def _shape() -> np.ndarray:
    shape = np.arange(256, dtype=U32)
    shape[97:123] = 97
    shape[65:91] = 65
    shape[48:58] = 48
    shape[128:] = 97
    return shape


_SHAPE = _shape()


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x TERMS) term counts of a batch; character terms of a long text are counted in pieces."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    for lo, hi, a, b in pieces(offsets, 1 << 20):
        part, off = _SHAPE[raw[a:b]], np.clip(offsets[lo:hi + 1] - a, 0, b - a)
        rows = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(off))
        stop = len(part) if b == offsets[hi] else len(part) - (max(ORDERS) - 1)
        got = np.zeros((hi - lo) * SHAPES, np.int64)
        for k in ORDERS:
            count = min(stop, len(part) - k + 1)
            if count <= 0:
                continue
            h = np.full(count, k * 0x85EBCA6B & 0xFFFFFFFF, U32)
            for j in range(k):
                h = (h ^ part[j:j + count]) * _MUL[j] + (h >> U32(15))
            inside = rows[:count] == rows[k - 1:k - 1 + count]
            slot = (h >> U32(8)).astype(np.int64) % SHAPES
            got += np.bincount((rows[:count] * SHAPES + slot)[inside], minlength=len(got))
        out[lo:hi, :SHAPES] += got.reshape(hi - lo, SHAPES)
    for lo, hi in H.batches_by_bytes(offsets):
        part, off = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        words, first = H.hash_words(part, off, H.ALNUM_WORDS)
        cell = np.repeat(np.arange(hi - lo), np.diff(first)) * WORDS + (words >> U64(32)).astype(np.int64) % WORDS
        out[lo:hi, SHAPES:SHAPES + WORDS] = np.bincount(cell, minlength=(hi - lo) * WORDS).reshape(hi - lo, WORDS)
        words, first = H.hash_words(part, off, H.SPACE_WORDS)
        same = np.r_[False, words[1:] == words[:-1]]
        grams = H.gram_hashes(words, 4)
        for i in range(hi - lo):
            p, q = first[i], first[i + 1]
            out[lo + i, TERMS - 2] = same[p + 1:q].sum()
            if q - p > 4:
                g = grams[p:q - 3]
                out[lo + i, TERMS - 1] = len(g) - len(np.unique(g))
    return out


def spread(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative counts: character terms and the two marks relative to the character terms, words to
    the words."""
    chars = counts[:, :SHAPES].sum(1, keepdims=True)
    x = counts / np.maximum(chars, 1)
    words = counts[:, SHAPES:SHAPES + WORDS]
    x[:, SHAPES:SHAPES + WORDS] = words / np.maximum(words.sum(1, keepdims=True), 1)
    np.sqrt(x, out=x)
    x[:, TERMS - _MARKS:] *= 4
    return x


def directions(x: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of ``x`` as columns, zero beyond its rank."""
    q = np.random.default_rng(23).standard_normal((x.shape[1], RANK + 16)).astype(np.float32)
    for _ in range(24):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, size, turn = np.linalg.svd((x @ q).astype(np.float64), full_matrices=False)
    turn[size < 1e-5 * size[0]] = 0
    return (q @ turn.T.astype(np.float32))[:, :RANK]


class LatentVotes:
    """Fitted model: idf, latent directions, labelled latent vectors, their labels and weights."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, totals: dict[int, int]):
        both = sum(totals.values())
        self.prior = totals.get(1, 0) / both if both else 0.5
        self.ready = len(set(labels.tolist())) == 2
        if not self.ready:
            return
        x = spread(counts)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(1)
        words = slice(SHAPES, SHAPES + WORDS)
        length = [np.linalg.norm(x[:, c] * self.idf[c], axis=1).mean() for c in (slice(SHAPES), words)]
        self.idf[words] *= np.float32(length[0] / length[1] if length[1] else 1)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        self.axes = directions(x)
        self.known = self.latent(x)
        self.labels = labels
        sampled = {c: int((labels == c).sum()) for c in (0, 1)}
        self.weight = np.where(labels == 1, totals[1] / sampled[1], totals[0] / sampled[0]).astype(np.float32)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(1))
        if not self.ready or not len(some):
            return out
        x = spread(counts[some]) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        cosine = self.latent(x) @ self.known.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** SHARPNESS * self.weight[near]
        out[some] = (vote * (self.labels[near] == 1)).sum(1) / vote.sum(1)
        return np.clip(out, 0.0, 1.0)


def _counts(batches):
    for batch in batches:
        raw, off = H.string_buffers(batch.column("text"))
        for lo, hi in H.batches_by_bytes(off):
            for p in range(lo, hi, 256):
                q = min(hi, p + 256)
                got = term_counts(raw[off[p]:off[q]], off[p:q + 1] - off[p])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(p, q - p), H.lists(got.ravel(), [TERMS] * (q - p), pa.float32())],
                    names=["label", "counts"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> LatentVotes:
    """Fits on at most ``PER_CLASS`` labelled rows of either class for which ``learn`` (on the id) holds."""
    known = (labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
             .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("top"))
             .where("label = top and id is not null").select("id", "label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(seeded("quality", "id"), "id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
            .join(F.broadcast(chosen), "id").select("label", "text"))       # at most 2 * PER_CLASS ids
    got = rows.mapInArrow(_counts, "label int, counts array<float>").toArrow().combine_chunks()
    labels_ = got["label"].to_numpy().astype(int)
    flat = got["counts"].combine_chunks() if got.num_rows else None
    counts = flat.flatten().to_numpy().reshape(-1, TERMS) if got.num_rows else np.zeros((0, TERMS), np.float32)
    order = np.lexsort((counts[:, :64].sum(1), counts.sum(1), labels_)) if len(labels_) else slice(0)
    return LatentVotes(counts[order], labels_[order], totals)


def _vote(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            raw, off = H.string_buffers(batch.column("text"))
            for lo, hi in H.batches_by_bytes(off):
                for p in range(lo, hi, 512):
                    q = min(hi, p + 512)
                    score = model.score(term_counts(raw[off[p]:off[q]], off[p:q + 1] - off[p]))
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(p, q - p), pa.array(score, pa.float64())],
                                                     names=["id", "score"])
    return run


def score_quality(docs: DataFrame, model: LatentVotes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_vote(shared), "id long, score double").select(F.col("id").alias(id_col), "score")
