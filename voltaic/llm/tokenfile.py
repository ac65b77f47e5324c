"""Token-ID files (operator 13): frequency-ranked ids in byte-aligned variable-length coding.

File format, a folder of two Parquet datasets:

* ``vocabulary`` (rank, id): the ids that occur, most frequent first (ties: smaller id).
* ``tokens`` (shard, slot, before, doc_id, n_tokens, control, data): a row per document, in files of one key range
  each. ``data`` holds the ids' ranks in 1 to 4 little-endian bytes, ``control`` two bits per id with the byte count
  less one, four ids a byte from the low bits up, each document padded to a whole control byte. ``shard`` and
  ``slot`` number files and rows in document order, ``before`` counts the ids of the shard's earlier documents.

Frequent ids take one byte, so a stream is shorter than fixed 16-bit ids. Decoding looks up the four lengths of each
control byte in a 256-row table and gathers the ranks with numpy, a few MB at a time.

Documents stand in ascending ``doc_id`` order (rows without an id first; repeated ids by a hash of their ids, then
by the ids), whatever the input's files. A null text is encoded like an empty one: just the end id. An empty table
gives files without rows. Texts are encoded whole by the ``tokenizers`` library. Where the tokenizer cuts at every single
space between two other characters (byte-level BPE without normaliser), the distinct words between such spaces are
encoded once for many texts and put together again; texts with other spacing, and other tokenizers, are handed over in one
piece.

Every step is a Spark job over stored rows: tokenise, count ids, sort by range, encode. The driver holds
the vocabulary's counts (bounded by the tokenizer's vocabulary) and nothing per document.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaic.llm.graph import small_side
from voltaic.session import cut_lineage, scratch_path

SLICE_BYTES = 4 << 20          # ids of about so many bytes are coded at once
TEXT_SLICE = 16 << 20          # bytes of texts whose distinct words are encoded together
WORDS_IN_TEXT, TEXTS_AT_ONCE = 100, 200     # words in a text, texts handed to the tokenizer at once
IDS_AT_ONCE = 1 << 19          # ids put together at once
KNOWN_WORDS = 150_000          # words a Python worker keeps; beyond that it starts again
LONGEST_KNOWN = 64             # bytes of a word that is kept
_SPACE = "\u0120"               # how byte-level vocabularies write a space
_THRESHOLDS = np.array([1 << 8, 1 << 16, 1 << 24], np.int64)
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def cuts_at_spaces(tokenizer_json: str) -> bool:
    """Whether no token of this tokenizer spans a single space and the characters on both sides of it."""
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
                        for t in spec.get("added_tokens", [])))


def _encoder(tokenizer_json: str, width: np.dtype):
    """A function from an Arrow array of texts to (their ids in a row, how many each has)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"            # a task has one core
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(tokenizer_json)

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, width) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def piecewise(texts: pa.Array):
        ids = whole(texts.to_pylist())
        return np.concatenate([np.zeros(0, width), *ids]), np.array([len(i) for i in ids], np.int64)

    if not cuts_at_spaces(tokenizer_json):
        return piecewise
    spaced = np.zeros(tok.get_vocab_size(), bool)
    spaced[[i for t, i in tok.get_vocab().items() if t.startswith(_SPACE)]] = True

    def learn(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each has) of words with a space in front, encoded many in one text."""
        ids, sizes = [np.zeros(0, width)], [np.zeros(0, np.int32)]
        for lo in range(0, len(words), TEXTS_AT_ONCE * WORDS_IN_TEXT):
            some = pa.concat_arrays([words.slice(lo, TEXTS_AT_ONCE * WORDS_IN_TEXT)])
            bounds = np.append(np.arange(0, len(some), WORDS_IN_TEXT), len(some)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), some), " ").to_pylist()
            got = np.concatenate(whole([" " + t for t in joined]))
            cut = np.flatnonzero(spaced[got])
            n = np.diff(np.append(cut, len(got)))
            if len(cut) != len(some):                         # a word that holds such a token further on
                each = whole([" " + w for w in some.to_pylist()])
                got, n = np.concatenate(each), np.array([len(e) for e in each])
            ids.append(got)
            sizes.append(n.astype(np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    # words met more than once in earlier texts: (words, their ids in a row, how many each has)
    known = [pa.array([], pa.string()), np.zeros(0, width), np.zeros(0, np.int32)]

    def by_words(texts: pa.Array):
        parts = pc.split_pattern(texts, " ")
        first = parts.offsets.to_numpy()[:-1]
        coded = parts.flatten().dictionary_encode()
        of, words = coded.indices.to_numpy().copy(), coded.dictionary
        per_text = np.diff(np.append(first, len(of)))
        del parts, coded
        # no cut where a part is empty or has white space at an end: such texts are encoded whole
        odd = ~pc.equal(words, pc.utf8_trim_whitespace(words)).to_numpy(zero_copy_only=False) | (pc.binary_length(words).to_numpy() == 0)
        whole_text = np.bitwise_or.reduceat(odd[of], first) if len(of) else np.zeros(0, bool)
        heads = whole([t.as_py() if w else t.as_py().partition(" ")[0] for t, w in zip(texts, whole_text.tolist())])
        hit = pc.fill_null(pc.index_in(words, value_set=known[0]), -1).to_numpy()
        new = np.flatnonzero((hit < 0) & ~odd)
        ids, sizes = learn(words.take(pa.array(new)))
        # entries: known words, new ones, each text's head, then nothing (for the words of a text encoded whole)
        length = np.concatenate([known[2], sizes, [len(h) for h in heads], [0]]).astype(np.int32)
        start = (np.cumsum(length) - length).astype(np.int32)
        flat = np.concatenate([known[1], ids, *heads])
        entry = hit.astype(np.int32)
        entry[new] = len(known[2]) + np.arange(len(new))
        entry[odd] = len(length) - 1
        twice = new[np.bincount(of, minlength=len(words))[new] > 1]
        of = entry[of]
        of[np.repeat(whole_text, per_text)] = len(length) - 1
        of[first] = len(known[2]) + len(new) + np.arange(len(first))
        per_ids = np.add.reduceat(length[of], first, dtype=np.int64) if len(of) else np.zeros(0, np.int64)
        out, bounds = np.empty(int(per_ids.sum()), width), np.append(first, len(of))
        done = 0
        for lo, hi in _slices(per_ids, IDS_AT_ONCE):
            some = of[bounds[lo]:bounds[hi]]
            n = length[some]
            ends = np.cumsum(n, dtype=np.int32)
            at = np.repeat(start[some] - (ends - n), n)
            at += np.arange(len(at), dtype=np.int32)
            out[done:done + len(at)] = flat[at]
            done += len(at)
        twice = twice[pc.binary_length(words.take(pa.array(twice))).to_numpy() <= LONGEST_KNOWN]
        if len(known[2]) + len(twice) > KNOWN_WORDS:
            known[:] = known[0].slice(0, 0), known[1][:0], known[2][:0]
        kept = np.concatenate([np.arange(len(known[2])), entry[twice]])
        sizes = length[kept]
        places = np.repeat(start[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        known[:] = pa.concat_arrays([known[0], words.take(pa.array(twice))]), flat[places], sizes
        del words
        pa.default_memory_pool().release_unused()
        return out, per_ids
    return by_words


def _kept_encoder(tokenizer_json: str, width: np.dtype):
    """The encoder of this Python worker, which Spark reuses for many tasks: the tokenizer is built, and a common word encoded,
    once a worker. What it keeps is bounded and never changes a result."""
    home = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    key = hashlib.sha256(tokenizer_json.encode()).digest(), str(width)
    if getattr(home, "key", None) != key:
        home.key, home.encode = key, _encoder(tokenizer_json, width)
    return home.encode


def _slices(weights, most: int):
    """(from, to) runs of rows of at most ``most`` in sum, or of one row."""
    lo, total = 0, 0
    for i, w in enumerate(weights):
        if total + w > most and i > lo:
            yield lo, i
            lo, total = i, 0
        total += w
    if len(weights) > lo:
        yield lo, len(weights)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: ``data`` cut at the byte offsets ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return raw, off - off[0]


def _tokenise(shared, end_id: int, width: np.dtype):
    def run(batches):
        encode = _kept_encoder(shared.value, width)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for lo, hi in _slices(pc.binary_length(texts).to_numpy(), TEXT_SLICE):
                ids, n = encode(texts.slice(lo, hi - lo))
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n + 1),
                     _binary(ids.view(np.uint8), (ends + np.arange(1, hi - lo + 1)) * width.itemsize)],
                    names=["doc_id", "n_tokens", "ids"])
    return run


def _count(width):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = _bytes_of(batch.column("ids"))
            if len(raw):
                n = np.bincount(raw.view(width))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])
    return run


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Streams of documents with ``counts`` ids each -> (control, ends of control, data, ends of data)."""
    code = np.zeros(len(ranks), np.uint8)
    for bound in _THRESHOLDS:
        if len(ranks) and ranks.max() >= bound:
            code += ranks >= bound
    control_ends = np.cumsum((counts + 3) // 4)
    slots = _slots(counts, control_ends)
    padded = np.zeros((int(control_ends[-1]) if len(counts) else 0) * 4, np.uint8)
    padded[slots] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    at = np.cumsum(code + np.int64(1))
    data = np.zeros(int(at[-1]) if len(at) else 0, np.uint8)
    first = at - code - 1
    data[first] = ranks & 255
    for j in range(1, int(code.max(initial=0)) + 1):
        has = np.flatnonzero(code >= j)
        data[first[has] + j] = ranks[has] >> 8 * j & 255
    return control, control_ends, data, np.concatenate([[0], at])[np.cumsum(counts)]


def _slots(counts: np.ndarray, control_ends: np.ndarray) -> np.ndarray:
    """Place of every id among the places of all control bytes (four a byte)."""
    starts = np.cumsum(counts) - counts
    shift = 4 * (control_ends - (counts + 3) // 4) - starts
    return np.arange(int(counts.sum())) + np.repeat(shift, counts)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents in a row (inverse of :func:`pack`)."""
    lengths = _LENGTHS[control].ravel()[_slots(counts, np.cumsum((counts + 3) // 4))]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    ranks = data[at].astype(np.int64)
    for j in range(1, int(lengths.max(initial=1))):
        has = np.flatnonzero(lengths > j)
        ranks[has] |= data[at[has] + j].astype(np.int64) << 8 * j
    return ranks


def _write(ranks, width):
    def run(batches):
        rank_of, shard, slot, before = ranks.value, TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            raw, off = _bytes_of(batch.column("ids"))
            ids, off = raw.view(width), off // width.itemsize
            for lo, hi in _slices(np.diff(off) * 4, SLICE_BYTES):
                counts = np.diff(off[lo:hi + 1])
                control, control_ends, data, data_ends = pack(rank_of[ids[off[lo]:off[hi]]], counts)
                ends = before + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, shard), pa.int32()), pa.array(slot + np.arange(hi - lo)), pa.array(ends - counts),
                     batch.column("doc_id").slice(lo, hi - lo), pa.array(counts), _binary(control, control_ends),
                     _binary(data, data_ends)],
                    names=["shard", "slot", "before", "doc_id", "n_tokens", "control", "data"])
                slot, before = slot + hi - lo, int(ends[-1])
    return run


def _read(ids_by_rank):
    def run(batches):
        table = ids_by_rank.value
        for batch in batches:
            control, c_off = _bytes_of(batch.column("control"))
            data, d_off = _bytes_of(batch.column("data"))
            counts = batch.column("n_tokens").to_numpy()
            for lo, hi in _slices(counts * 4, SLICE_BYTES):
                ranks = unpack(control[c_off[lo]:c_off[hi]], data[d_off[lo]:d_off[hi]], counts[lo:hi])
                ids = table[ranks].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in ("shard", "slot", "before", "doc_id", "n_tokens")],
                     _binary(ids.view(np.uint8), 4 * np.cumsum(counts[lo:hi]))],
                    names=["shard", "slot", "before", "doc_id", "n_tokens", "ids"])
    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the token files of ``docs`` and returns their folder (by default a fresh one in the shared folder)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1)
    width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged = scratch_path(spark, "token-ids")
    (rows.mapInArrow(_tokenise(spark.sparkContext.broadcast(spec), end_id, width), "doc_id long, n_tokens long, ids binary")
     .write.option("compression", "zstd").parquet(staged))
    tokens = spark.read.parquet(staged)
    counts = (tokens.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "id").collect())                       # at most the vocabulary
    order = np.array([r.id for r in counts], np.int64)
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(order)], "rank long, id long").write.mode("overwrite").parquet(
        os.path.join(path, "vocabulary"))
    rank_of = np.zeros(size, np.int64)
    rank_of[order] = np.arange(len(order))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = tokens.withColumn("tie", F.xxhash64("ids"))
    (keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
     .mapInArrow(_write(spark.sparkContext.broadcast(rank_of), width),
                 "shard int, slot long, before long, doc_id long, n_tokens long, control binary, data binary")
     .write.mode("overwrite").parquet(os.path.join(path, "tokens")))
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, slot, start, n_tokens, ids) of every document of the files; ``start`` counts the ids of all earlier
    documents, ``ids`` holds the decoded ids as little-endian unsigned 32-bit integers."""
    by_rank = spark.read.parquet(os.path.join(path, "vocabulary")).orderBy("rank").collect()       # at most the vocabulary
    table = spark.sparkContext.broadcast(np.array([r.id for r in by_rank], np.int64))
    stored = spark.read.parquet(os.path.join(path, "tokens"))
    shards = stored.groupBy("shard").agg(F.max(F.col("before") + F.col("n_tokens")).alias("held"))
    # one row per file: few enough for one running sum, and to be sent to every task (checked)
    starts = small_side(cut_lineage(shards.select("shard", (F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy("shard"))
                                                            - F.col("held")).alias("first")), "file-starts"))
    rows = stored.mapInArrow(_read(table), "shard int, slot long, before long, doc_id long, n_tokens long, ids binary")
    return rows.join(starts, "shard").select("doc_id", "shard", "slot", (F.col("first") + F.col("before")).alias("start"),
                                             "n_tokens", "ids")
