"""Benchmark decontamination by winnowing (operator 7).

A benchmark item is the windows of ``window`` consecutive words it holds; a shorter item is one window. Of the
``K``-gram hashes in every window of ``window`` words the minimum is kept (all places of a tie), on the
item's side and the document's. Equal windows keep equal minima at the same place, so every shared span of
``window`` words is met by at least one common fingerprint. Each meeting is extended word by word in both
directions; spans that hold a whole window are hits. Items shorter than a window are met through one K-gram
(or the whole item, if shorter), looked up among all of a document's grams.

The benchmark is collected in blocks of at most ``BLOCK_BYTES`` of text, each a broadcast of bounded size
and a pass over the documents; documents are never shuffled unless there are several blocks, and then only
the rows of documents that were hit are. Words: A-Z lower-cased, runs of ASCII letters and digits and all
non-ASCII characters. Null or wordless texts have no words and no hits; null or wordless items are not
looked for; an item without an id counts under the empty id. Repeated items count once, repeated rows each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm import hashing as H

K = 5
BLOCK_BYTES = 8 << 20
U64 = np.uint64
SCHEMA = "id long, text_key long, n_words long, starts array<long>, ends array<long>, items array<string>"


def winnowed(grams: np.ndarray, ends_after: np.ndarray, per: int) -> np.ndarray:
    """Which grams are a minimum of some run of ``per`` grams; ``ends_after[i]``: a run may begin at i."""
    n = len(grams) - per + 1
    keep = np.zeros(len(grams), bool)
    if n <= 0:
        return keep
    low = grams[:n].copy()
    for d in range(1, per):
        np.minimum(low, grams[d:d + n], out=low)
    ok = ends_after[:n]
    for d in range(per):
        keep[d:d + n] |= (grams[d:d + n] == low) & ok
    return keep


class Fingerprints:
    """Index of one benchmark block: fingerprint -> places in the block's words."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        raw, off = H.string_buffers(pa.array(texts, pa.string()))
        self.words, self.first = H.hash_words(raw, off, H.ALNUM_WORDS)
        self.ids, self.window = ids, window
        k = min(K, window)
        places: dict[int, dict[int, list]] = {k: {}}
        self.short: set[int] = set()
        for i in range(len(ids)):
            lo, hi = int(self.first[i]), int(self.first[i + 1])
            m = hi - lo
            if m == 0:
                continue
            if m >= window:
                g = H.gram_hashes(self.words[lo:hi], k)
                keep = winnowed(g, np.ones(len(g), bool), window - k + 1)
                for p in np.flatnonzero(keep):
                    places[k].setdefault(int(g[p]), []).append((i, lo + int(p)))
            else:
                n = min(k, m)
                g = H.gram_hashes(self.words[lo:hi], n)
                p = int(np.argmin(g))
                self.short.add(n)
                places.setdefault(n, {}).setdefault(int(g[p]), []).append((i, lo + p))
        self.places, self.k = places, k
        self.known = {n: np.array(sorted(d), U64) for n, d in places.items()}
        self.sieve = {n: np.zeros(1 << 16, bool) for n in places}
        for n, d in places.items():
            self.sieve[n][(self.known[n] & U64(0xFFFF)).astype(np.int64)] = True

    def meetings(self, words: np.ndarray, first: np.ndarray):
        """(place in words, gram length) of the fingerprints that the documents share with the block."""
        last = np.repeat(first[1:], np.diff(first))           # end of the document of each word
        at = np.arange(len(words))
        for n in sorted(self.places):
            if len(self.known[n]) == 0 or len(words) < n:
                continue
            g = H.gram_hashes(words, n)
            inside = (at + n <= last)[:len(g)]
            if n == self.k and n not in self.short:
                inside &= winnowed(g, (at + self.window <= last)[:len(g)], self.window - n + 1)
            p = np.flatnonzero(inside)
            p = p[self.sieve[n][(g[p] & U64(0xFFFF)).astype(np.int64)]]
            for q in p[np.isin(g[p], self.known[n])]:
                yield int(q), self.places[n][int(g[q])]

    def spans(self, words: np.ndarray, first: np.ndarray):
        """Per document that was hit: (row, sorted spans, item ids)."""
        found: dict[int, tuple[set, set]] = {}
        done: dict[tuple[int, int], int] = {}
        for p, places in self.meetings(words, first):
            row = int(np.searchsorted(first, p, "right")) - 1
            a, b = int(first[row]), int(first[row + 1])
            for item, q in places:
                if done.get((item, p - q), -1) > p:            # within a span already extended
                    continue
                lo, hi = int(self.first[item]), int(self.first[item + 1])
                n = min(b - p, hi - q)
                same = words[p:p + n] == self.words[q:q + n]
                right = n if same.all() else int(np.argmin(same))
                n = min(p - a, q - lo)
                same = (words[p - n:p] == self.words[q - n:q])[::-1]
                left = n if same.all() else int(np.argmin(same))
                done[(item, p - q)] = p + max(right, 1)
                if left + right >= min(self.window, hi - lo):
                    s, i = found.setdefault(row, (set(), set()))
                    s.add((p - left - a, p + right - a))
                    i.add(self.ids[item])
        return found


def _match(block, window: int, all_rows: bool):
    def run(batches):
        index = Fingerprints(*block.value, window)
        for batch in batches:
            raw, off = H.string_buffers(batch.column("text"))
            for lo, hi in H.batches_by_bytes(off):
                words, first = H.hash_words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], H.ALNUM_WORDS)
                found = index.spans(words, first)
                rows = range(hi - lo) if all_rows else sorted(found)
                spans = [sorted(found[r][0]) if r in found else [] for r in rows]
                take = pa.array([lo + r for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(take), batch.column("text_key").take(take),
                    pa.array([int(first[r + 1] - first[r]) for r in rows], pa.int64()),
                    pa.array([[x[0] for x in s] for s in spans], pa.list_(pa.int64())),
                    pa.array([[x[1] for x in s] for s in spans], pa.list_(pa.int64())),
                    pa.array([sorted(found[r][1]) if r in found else [] for r in rows], pa.list_(pa.string()))],
                    names=["id", "text_key", "n_words", "starts", "ends", "items"])
    return run


def benchmark_blocks(bench: DataFrame, id_col: str, text_col: str):
    """(ids, texts) of the benchmark in blocks of bounded bytes, one at a time."""
    items = bench.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow()
        yield rows["id"].to_pylist(), rows["text"].to_pylist()


def benchmark_hits(docs: DataFrame, bench: DataFrame, window: int = 13, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, text_key, n_words, n_hit, spans, items) per row: merged spans of hit words and the items found."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).alias("text"))
    base, more = None, None
    for block in benchmark_blocks(bench, item_col, item_text):
        shared = sc.broadcast(block)
        part = rows.mapInArrow(_match(shared, window, base is None), SCHEMA)
        if base is None:
            base = part
        else:
            more = part if more is None else more.unionByName(part)
    if more is not None:                           # hits of further blocks depend on the text alone
        extra = more.dropDuplicates(["text_key", "starts", "ends", "items"]).groupBy("text_key").agg(
            F.flatten(F.collect_list("starts")).alias("s2"), F.flatten(F.collect_list("ends")).alias("e2"),
            F.flatten(F.collect_list("items")).alias("i2"))
        none = F.array().cast("array<long>")
        base = base.join(extra, "text_key", "left").select(
            "id", "text_key", "n_words", F.concat("starts", F.coalesce("s2", none)).alias("starts"),
            F.concat("ends", F.coalesce("e2", none)).alias("ends"),
            F.concat("items", F.coalesce("i2", F.array().cast("array<string>"))).alias("items"))
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    merged = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["upto"], x["ends"]).alias("upto"),
                                (acc["n"] + F.greatest(x["ends"] - F.greatest(x["starts"], acc["upto"]),
                                                       F.lit(0).cast("long"))).alias("n")), lambda acc: acc["n"])
    return base.select(F.col("id").alias(id_col), "text_key", "n_words", merged.alias("n_hit"),
                       spans.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def is_contaminated():
    """One word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
