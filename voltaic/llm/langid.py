"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 8).

Texts are folded to letters: A-Z count as a-z, every other ASCII character as a space; non-ASCII characters
stay as their UTF-8 bytes. Runs of 1 to 3 bytes are hashed to ``FEATURES`` slots. Each task sums the
n-grams of its rows per language; the sums of all rows meet as (language, slot, count). The matrix of
smoothed log-probabilities (languages x slots: its size depends on the number of languages alone) is
broadcast, and every text is scored by a sparse product in numpy.

``lang_pred`` is a learned language, or ``und`` with score 0 when the text is null or holds no letter, or when
nothing was learned. ``score`` is the posterior of the prediction. Ties go to the first language in
alphabetical order. Rows with a null language or text are not learned from; long texts are read whole, in
pieces. Copies count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm import hashing as H

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
U32 = np.uint32
_MUL = (H.MIX[:8] & np.uint64(0xFFFFFFFF)).astype(U32)


def _fold() -> np.ndarray:
    fold = np.full(256, 32, U32)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    return fold


_FOLD = _fold()


def slots(raw: np.ndarray, offsets: np.ndarray):
    """Per order: (slot of the n-gram at each byte, whether it lies within its text)."""
    folded = _FOLD[raw]
    for n in ORDERS:
        count = len(raw) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, U32)
        for j in range(n):
            h = (h ^ folded[j:j + count]) * _MUL[j] + (h >> U32(15))
        inside = np.ones(count, bool)
        for j in range(1, n):
            cut = offsets[1:-1] - j
            inside[cut[(cut >= 0) & (cut < count)]] = False
        yield (h >> U32(32 - FEATURES.bit_length() + 1)).astype(np.int32), inside


def pieces(offsets: np.ndarray, most: int):
    """(first row, last row + 1, first byte, last byte) of parts of bounded bytes; a longer text is cut,
    consecutive parts overlapping by the longest n-gram less one byte."""
    for lo, hi in H.batches_by_bytes(offsets, most):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * most:
            yield lo, hi, a, b
        else:                                  # a single long text
            for p in range(a, b, most):
                yield lo, hi, p, min(b, p + most + max(ORDERS) - 1)


def _part_offsets(offsets, lo, hi, a, b):
    return np.clip(offsets[lo:hi + 1] - a, 0, b - a)


def _grams(raw, offsets, lo, hi, a, b, end):
    """(slots, row of each) of one part. In a cut text, n-grams that begin in the overlap belong to the
    next part."""
    part, off = raw[a:b], _part_offsets(offsets, lo, hi, a, b)
    stop = len(part) if b == end else len(part) - (max(ORDERS) - 1)
    rows = np.repeat(np.arange(hi - lo), np.diff(off))
    for s, inside in slots(part, off):
        inside = inside[:stop]
        yield s[:stop][inside], rows[:len(inside)][inside]


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, off = H.string_buffers(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi, a, b in pieces(off, 2 << 20):
            names, which = np.unique(langs[lo:hi], return_inverse=True)
            for s, row in _grams(raw, off, lo, hi, a, b, off[hi]):
                group = which[row]
                for i, name in enumerate(names):
                    got = np.bincount(s if len(names) == 1 else s[group == i], minlength=FEATURES)
                    sums[name] = sums[name] + got if name in sums else got
    for name, got in sums.items():
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(got[at].astype(np.int64))], names=["lang", "slot", "n"])


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[list, np.ndarray]:
    """(languages, log-probabilities by slot and language) from the rows where ``learn`` holds."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = (rows.mapInArrow(_count, "lang string, slot int, n long")
            .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(sums["lang"].to_pylist()))
    counts = np.full((FEATURES, len(names)), SMOOTH)
    if names:
        column = {x: i for i, x in enumerate(names)}
        which = np.array([column[x] for x in sums["lang"].to_pylist()])
        counts[sums["slot"].to_numpy(), which] += sums["n"].to_numpy()
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def _predict(model, keep: list[str]):
    def run(batches):
        names, logp = model.value
        most = max(1 << 16, (16 << 20) // max(1, 4 * len(names)) // 4)
        for batch in batches:
            n = batch.num_rows
            raw, off = H.string_buffers(batch.column("text"))
            total = np.zeros((n, len(names)))
            if names:
                for lo, hi, a, b in pieces(off, most):
                    for s, row in _grams(raw, off, lo, hi, a, b, off[hi]):
                        if len(s):
                            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                            total[lo + row[starts]] += np.add.reduceat(logp[s], starts, axis=0, dtype=np.float64)
            letter = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(
                zero_copy_only=False) & bool(names)
            best = total.argmax(1) if names else np.zeros(n, int)
            odds = np.exp(total - total.max(1, keepdims=True)).sum(1) if names else np.ones(n)
            pred = [names[i] if ok else "und" for i, ok in zip(best, letter)]
            score = np.where(letter, 1 / odds, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(pred, pa.string()),
                                                                               pa.array(score, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: tuple[list, np.ndarray], text_col: str = "text",
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in names)
    out = rows.mapInArrow(_predict(shared, names), f"{schema}, lang_pred string, score double")
    return out.select(*[F.col(x).alias(c) for c, x in zip(keep, names)], "lang_pred", "score")


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
