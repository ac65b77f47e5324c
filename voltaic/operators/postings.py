"""The stored search index (R3) and search with score bounds over it.

Layout under an index folder:

* ``blocks`` (bucket, token, level, block, n, cf, max_tf, min_dl, postings): the postings of a token (doc_id, chunk_id,
  tf, dl, attributes..) in blocks of about ``BLOCK_SIZE``. A block holds one impact level (a sixteenth of the term-frequency
  part of BM25) and stands with its largest ``tf`` and smallest ``dl``: together they bound what any of its postings can
  add to a score, whatever subset of the chunks is searched. Partitioned by a hash bucket of the token.
* ``chunk_stats`` (doc_id, chunk_id, dl, attributes..): lengths, for the corpus size and mean length of a subset.

Search reads block heads first (no postings). With a query's terms ordered by their best possible contribution, a
chunk whose strongest matching term is ``t`` scores at most ``t``'s block bound plus the bounds of all weaker
terms. So once some ``k`` chunks are known to reach a score, every block below it is skipped; common words usually open no
block at all. A chunk met in opened blocks scores at most the sum of what they say plus, for every other term of the query,
the best of the skipped blocks: few chunks are left, and these are scored exactly. The known score runs up in
steps: exact scores of the chunks that stand best in each query's most promising blocks, then of those that stand best in
all opened blocks. Nothing is approximate: a skipped chunk can't reach the first ``k``, equal scores included.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaic.operators.relational import top_n_per_group
from voltaic.operators.search import CHUNK_SIZE, build_index, chunk, query_terms, token_bucket
from voltaic.operators.text import BROADCAST_MAX_ROWS, small
from voltaic.session import checkpoint_dir, cut_lineage, delete_path, dropping_scratch, scratch_path, shuffles_freed, spread

BLOCK_SIZE = 128
LIST_SIZE = 16_384              # postings of one token and level that are listed together
LARGE_MAX_ROWS = 1_000_000      # lists that are dealt out, sent to every task (at least LIST_SIZE postings stand behind each)
TASK_POSTINGS = 1_000_000       # postings a task sorts: some 100 MB
SLICE_TOKENS = 16_000_000       # tokens behind a slice of the postings, at least
SLICES = 16                     # slices at most: a task that stages postings writes a file for each
DOCS_BROADCAST_MAX_ROWS = 2_000_000     # ids of documents, sent to every task (some 80 MB) to spare a shuffle of texts or postings
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}      # a quarter less than snappy, for little more time
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
LEVELS = 16             # impact levels per unit of the term-frequency part
SEED_BLOCKS = 16        # blocks a query opens to find its first bound
CLOSE = 2e-6            # scores are rounded to six digits
DIRECT = 20_000_000     # (query, posting) pairs up to which scoring all of them is cheaper than the steps of the bounded plan


def tf_part(tf, dl, avgdl, k1: float, b: float):
    """What a posting adds to a score, without the weight of its term."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def corpus_size(stats: DataFrame) -> tuple[int, float]:
    """Number of chunks and their mean length."""
    r = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("s")).first()
    return r.n, (r.s or 0) / r.n if r.n else 0.0


def to_blocks(postings: DataFrame, avgdl: float, keep: tuple[str, ...] = (), k1: float = 1.2, b: float = 0.75,
              buckets: int = 64) -> DataFrame:
    """Blocks of stored ``postings``, with their bucket. The few levels with over ``LIST_SIZE`` postings are counted first and
    dealt by a hash of the chunk, so no task sorts or holds a common token. There is one shuffle: a task gets about
    ``TASK_POSTINGS`` postings of one bucket (or of a few small ones), makes lists of them and cuts these into blocks."""
    return _blocks_of(postings, avgdl, keep, k1, b, buckets, 0, buckets, 0)[0]


def _blocks_of(postings: DataFrame, avgdl: float, keep: tuple[str, ...], k1: float, b: float, buckets: int, lowest: int, width: int,
               first: int) -> tuple[DataFrame, int]:
    """Blocks of postings whose buckets are the ``width`` from ``lowest`` on, numbered as behind ``first`` other tasks, and the
    number of tasks."""
    level = F.floor(tf_part(F.col("tf"), F.col("dl"), F.lit(avgdl or 1.0), k1, b) * LEVELS).cast("int")
    p = postings.withColumn("level", level)
    large = small(cut_lineage(p.groupBy("token", "level").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIST_SIZE)
                              .select("token", "level", F.ceil(F.col("_n") / LIST_SIZE).alias("_cuts"))), LARGE_MAX_ROWS)
    lists = p.join(large, ["token", "level"], "left").withColumn(
        "_cut", F.coalesce(F.pmod(F.xxhash64("doc_id", "chunk_id"), F.col("_cuts")), F.lit(0))).drop("_cuts")
    tasks = max(1, -(-postings.count() // TASK_POSTINGS))
    each = -(-tasks // width)                                       # tasks a bucket is dealt to
    tasks = min(tasks, width) * each if each == 1 else width * each
    place = (F.col("bucket") - lowest) * each + F.pmod(F.hash("token", "level", "_cut"), F.lit(each))
    lists = lists.withColumn("bucket", token_bucket("token", buckets)).withColumn(
        "_task", F.floor(place * tasks / (width * each)).cast("int"))
    lists = lists.repartitionById(tasks, "_task").groupBy("_task", "bucket", "token", "level", "_cut").agg(
        F.collect_list(F.struct("doc_id", "chunk_id", "tf", "dl", *keep)).alias("_l"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / BLOCK_SIZE).cast("int")),
                        lambda i: F.slice("_l", i * BLOCK_SIZE + 1, BLOCK_SIZE))
    tfs = F.col("postings")["tf"]
    return lists.select("bucket", "token", "level", F.explode(parts).alias("postings")).select(
        "bucket", "token", "level", F.size("postings").cast("long").alias("n"),
        F.aggregate(tfs, F.lit(0).cast("long"), lambda a, x: a + x).alias("cf"), F.array_max(tfs).alias("max_tf"),
        F.array_min(F.col("postings")["dl"]).alias("min_dl"), "postings",
        (F.monotonically_increasing_id() + (first << 33)).alias("block")), tasks


def write_blocks(postings: DataFrame, tokens: int, avgdl: float, path: str, keep: tuple[str, ...] = (), buckets: int = 64) -> None:
    """Writes the blocks of ``postings`` (of ``tokens`` tokens in all) to ``path``, partitioned by bucket.

    Postings are staged in slices, ranges of buckets, and a slice is deleted when its blocks are written, as are the files of its
    shuffle: next to the blocks there are never more than the staged postings and one slice's shuffle, which holds a posting in
    several times the bytes of a stored one."""
    spark = postings.sparkSession
    least = max(SLICE_TOKENS, TASK_POSTINGS * spark.sparkContext.defaultParallelism)
    slices = min(SLICES, buckets, max(1, -(-tokens // least)))
    cuts = [-(-buckets * i // slices) for i in range(slices + 1)]
    staged = scratch_path(spark, "postings")
    with shuffles_freed(spark), dropping_scratch(spark):
        at_once = spark.conf.get(_WRITERS, "0")
        spark.conf.set(_WRITERS, str(slices))             # else a task sorts its postings by slice before it writes them
        try:
            postings.withColumn("_slice", F.floor(token_bucket("token", buckets) * slices / buckets).cast("int")).write.partitionBy("_slice").parquet(staged)
        finally:
            spark.conf.set(_WRITERS, at_once)
        schema, first = postings.schema, 0
        delete_path(spark, path)                          # of a batch that is replayed
        for i in range(slices):
            part = f"{staged}/_slice={i}"
            rows = spark.read.schema(schema).parquet(part) if _exists(spark, part) else spark.createDataFrame([], schema)
            blocks, tasks = _blocks_of(rows, avgdl, keep, 1.2, 0.75, buckets, cuts[i], cuts[i + 1] - cuts[i], first)
            blocks.write.mode("append").options(**PACKED).partitionBy("bucket").parquet(path)
            first += tasks
            delete_path(spark, part)
    delete_path(spark, staged)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_index(postings: DataFrame, stats: DataFrame, path: str, buckets: int = 64, keep: tuple[str, ...] = ()) -> None:
    """Writes an index to a fresh ``path``, partitioned by bucket: readers prune by it."""
    spark = stats.sparkSession
    stats.write.mode("overwrite").parquet(f"{path}/chunk_stats")
    n, avgdl = corpus_size(spark.read.parquet(f"{path}/chunk_stats"))
    write_blocks(postings, round(n * avgdl), avgdl, f"{path}/blocks", keep, buckets)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings (token, doc_id, chunk_id, tf, dl, attributes..) of a stored index."""
    return spark.read.parquet(f"{path}/blocks").select("token", F.explode("postings").alias("p")).select("token", "p.*")


def stored_term_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per token: chunk and collection frequency, from the block heads alone."""
    return spark.read.parquet(f"{path}/blocks").groupBy("token").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def _files(docs: DataFrame) -> list[str]:
    """Path, length and modification time of every file behind a plain scan: one listing per folder."""
    jvm, conf = docs.sparkSession.sparkContext._jvm, docs.sparkSession.sparkContext._jsc.hadoopConfiguration()
    wanted = set(docs.inputFiles())
    found = []
    for folder in sorted({os.path.dirname(f) for f in wanted}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        for s in path.getFileSystem(conf).listStatus(path):
            found.append((os.path.basename(s.getPath().toString()), folder, s.getLen(), s.getModificationTime()))
    names = {(os.path.basename(f), os.path.dirname(f)) for f in wanted}
    return sorted(f"{folder}/{name}|{size}|{time}" for name, folder, size, time in found if (name, folder) in names)


def build_stored_index(docs: DataFrame, keep: tuple[str, ...] = ("lang", "source"), buckets: int = 64) -> str:
    """Writes an index of ``docs`` to a fresh folder of the shared storage and returns it."""
    path = os.path.join(checkpoint_dir(docs.sparkSession), f"search-index-{uuid.uuid4().hex[:16]}")
    postings, stats = build_index(chunk(spread(docs.select("doc_id", "text", *keep)), keep=list(keep)), keep=keep)
    write_index(postings, stats, path, buckets, keep)
    return path


def stored_index(docs: DataFrame, keep: tuple[str, ...] = ("lang", "source"), buckets: int = 64) -> str:
    """The folder of the index over ``docs`` (a plain scan of stored files), built on first use.

    An index is written to a folder of its own and published by renaming a small pointer file, named after the
    table's files, lengths and modification times: a changed table gets a new index, and of two sessions that
    build at once each reads a whole index.
    """
    spark = docs.sparkSession
    state = hashlib.sha256(repr((keep, buckets, CHUNK_SIZE, _files(docs))).encode()).hexdigest()[:24]
    base = checkpoint_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(os.path.join(base, f"search-index-{state}.current"))
    fs = pointer.getFileSystem(conf)
    if not fs.exists(pointer):
        path = build_stored_index(docs, keep, buckets)
        fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.pointer")
        out = fs.create(fresh, True)
        out.write(bytearray(path.encode()))
        out.close()
        fs.rename(fresh, pointer)
    return spark.read.text(pointer.toString()).first()[0]


def alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """``rows(doc_id, seg, ..)`` without documents that a later batch replaced: ``dead(doc_id, until)`` ends the versions in
    segments before ``until``."""
    if dead is None:
        return rows
    d = dead.select(F.col("doc_id").alias("_dead"), "until")
    return rows.join(small(d, DOCS_BROADCAST_MAX_ROWS), (F.col("doc_id") == F.col("_dead")) & (F.col("seg") < F.col("until")), "left_anti")


def _open(blocks: DataFrame, cols: list[str], where, dead: DataFrame | None) -> DataFrame:
    """The postings of blocks, one a row, that are searched."""
    rows = blocks.select(*cols, "seg", F.explode("postings").alias("_p")).select(*cols, "seg", "_p.*")
    return alive(rows if where is None else rows.where(where), dead)


def _exact(hit: DataFrame, worth: DataFrame, pairs: DataFrame, qid: str, part) -> DataFrame:
    """Scores of (query, chunk) pairs: the postings of the pairs' chunks, met with the queries' terms."""
    return _summed(hit.select("token", "doc_id", "chunk_id", part.alias("_part")).join(pairs, ["doc_id", "chunk_id"])
                   .join(worth.select(qid, "token", "idf"), [qid, "token"]), qid)


def _summed(rows: DataFrame, qid: str) -> DataFrame:
    return (rows.groupBy(qid, "doc_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("_part")).alias("_s"))
            .withColumn("score", F.round("_s", 6)).drop("_s"))


def _best(scored: DataFrame, qid: str, k: int) -> DataFrame:
    return top_n_per_group(scored, [qid], [F.desc("score"), F.asc("doc_id"), F.asc("chunk_id")], k)


def _kth(scored: DataFrame, qid: str, score: str, k: int, name: str) -> DataFrame:
    """The k-th best score of every query that has so many."""
    best = top_n_per_group(scored, [qid], [F.desc(score), F.asc("doc_id"), F.asc("chunk_id")], k)
    return best.where(F.col("rank") == k).select(qid, F.col(score).alias(name))


def wanted_buckets(terms: DataFrame, buckets: int) -> list:
    return [r[0] for r in terms.select(token_bucket("token", buckets)).distinct().collect()]       # at most ``buckets``


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, buckets: int = 64, qid_col: str = "query_id",
                 qtext_col: str = "query", k1: float = 1.2, b: float = 0.75, where=None, plan: dict | None = None,
                 direct: int = DIRECT) -> DataFrame:
    """Top ``k`` chunks per query by BM25 -> ``(query_id, rank, doc_id, chunk_id, score)``.

    Scores, rounding and ties are those of :func:`voltaic.operators.search.bm25`. ``where`` filters by
    attributes before anything is counted, so frequencies and lengths are those of the filtered chunks. Only
    the buckets of the query terms are read. The postings that the queries' terms have in all are known from the block heads;
    up to ``direct`` they are scored at once, beyond it under bounds, with the same result. ``plan`` receives the staged
    DataFrames of the bounded plan, for inspection.
    """
    qt, terms, _ = query_terms(queries, qid_col, qtext_col)
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin(wanted_buckets(terms, buckets)))
    stats = spark.read.parquet(f"{path}/chunk_stats")
    blocks = blocks.join(terms, "token", "left_semi").withColumn("seg", F.lit(0).cast("long"))
    n, avgdl = corpus_size(stats if where is None else stats.where(where))
    return search_blocks(blocks, n, avgdl, qt, k, qid_col, k1, b, where=where, plan=plan, direct=direct)


def search_blocks(blocks: DataFrame, n: int, avgdl: float, qt: DataFrame, k: int, qid_col: str, k1: float, b: float, where=None,
                  dfreq: DataFrame | None = None, dead: DataFrame | None = None, plan: dict | None = None,
                  direct: int = DIRECT) -> DataFrame:
    """The search over ``blocks(token, seg, block, n, max_tf, min_dl, postings)`` of the query terms ``qt(query id, token)``.

    ``n`` and ``avgdl`` are those of the chunks searched, ``dfreq(token, df)`` the terms' chunk frequencies (by default
    counted). Postings outside ``where`` and of ``dead`` documents don't count; bounds that include them hold all the
    same. Work on the way (term weights, bounds, candidates: all far smaller than the matched postings) is staged in
    shared storage.
    """
    order = ["doc_id", "chunk_id"]
    avgdl = avgdl or 1.0
    bound = tf_part(F.col("max_tf"), F.col("min_dl"), F.lit(avgdl), k1, b)
    part = tf_part(F.col("tf"), F.col("dl"), F.lit(avgdl), k1, b)
    heads = blocks.select("token", "block", bound.alias("bound"))
    if dfreq is None and where is None and dead is None:
        dfreq = blocks.groupBy("token").agg(F.sum("n").alias("df"))
    elif dfreq is None:
        dfreq = _open(blocks, ["token"], where, dead).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # one row per query term: weight, best contribution, and the most that all weaker terms add
    idf = F.ln(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tokens = heads.groupBy("token").agg(F.max("bound").alias("best")).join(dfreq.select("token", "df").where("df > 0"), "token").select(
        "token", "df", idf.alias("idf"), (idf * F.col("best")).alias("ub"))
    weaker = Window.partitionBy(qid_col).orderBy("ub", "token").rowsBetween(Window.unboundedPreceding, -1)
    worth = cut_lineage(qt.join(tokens, "token").withColumn("below", F.coalesce(F.sum("ub").over(weaker), F.lit(0.0))), "terms")
    size = worth.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    near = F.broadcast if size.terms <= BROADCAST_MAX_ROWS else (lambda df: df)     # sides of at most a row per query term
    hit = _open(blocks, ["token"], where, dead)
    if size.postings <= direct:
        return _best(_summed(hit.select("token", *order, part.alias("_part")).join(near(worth.select(qid_col, "token", "idf")), "token"),
                             qid_col), qid_col, k)
    # a first bound: what the postings of each query's best blocks add up to
    lead = top_n_per_group(heads, ["token"], [F.desc("bound"), F.asc("block")], 2).select("token", "block", "bound")
    opened = top_n_per_group(near(worth).join(lead, "token").withColumn("_w", F.col("idf") * F.col("bound")), [qid_col],
                             [F.desc("_w"), F.asc("block")], SEED_BLOCKS).select(qid_col, "block", "idf")
    first = (_open(blocks.drop("n").join(near(opened), "block"), [qid_col, "idf"], where, dead)
             .groupBy(qid_col, *order).agg(F.sum(F.col("idf") * part).alias("known")))
    first = cut_lineage(top_n_per_group(first, [qid_col], [F.desc("known"), *map(F.asc, order)], 4 * k), "first")
    seeds = _exact(hit, near(worth), small(first.select(qid_col, *order)), qid_col, part)
    known = cut_lineage(_kth(seeds, qid_col, "score", k, "known"), "known")
    # blocks that can still reach it, and the most that the others of their term add
    reach = F.coalesce(F.col("known") - CLOSE, F.lit(0.0))
    goal = worth.join(near(known), qid_col, "left").withColumn("live", F.col("ub") + F.col("below") >= reach)
    asked = heads.join(near(goal.where("live")), "token").select(
        qid_col, "token", "block", "idf", (F.col("idf") * F.col("bound")).alias("most"),
        (F.col("idf") * F.col("bound") + F.col("below") >= reach).alias("kept"))
    asked = cut_lineage(asked, "blocks")
    shut = asked.groupBy(qid_col, "token").agg(F.coalesce(F.max(F.when(~F.col("kept"), F.col("most"))), F.lit(0.0)).alias("shut"))
    shut = cut_lineage(goal.join(shut, [qid_col, "token"], "left").withColumn("shut", F.when(F.col("live"), F.coalesce("shut", F.lit(0.0)))
                                                                              .otherwise(F.col("ub"))), "shut")
    # a chunk adds up what its opened postings say, plus the most of every term it was not seen with
    rest = shut.groupBy(qid_col).agg(F.sum("shut").alias("rest"))
    kept = asked.where("kept").join(near(shut.select(qid_col, "token", "shut")), [qid_col, "token"]).select(qid_col, "block", "idf", "shut")
    met = _open(blocks.drop("n").join(small(kept), "block"), [qid_col, "idf", "shut"], where, dead)
    sums = cut_lineage(met.groupBy(qid_col, *order).agg(F.sum(F.col("idf") * part).alias("said"), F.sum(F.col("idf") * part - F.col("shut")).alias("seen")),
                       "sums")
    # the best of these raise the known score, which few other chunks can reach
    best = top_n_per_group(sums, [qid_col], [F.desc("said"), *map(F.asc, order)], 4 * k).select(qid_col, *order)
    raised = _kth(_exact(hit, near(worth), small(cut_lineage(best, "best")), qid_col, part), qid_col, "score", k, "raised")
    goal = cut_lineage(rest.join(near(known), qid_col, "left").join(near(raised), qid_col, "left").select(
        qid_col, "rest", F.greatest("known", "raised").alias("known")), "goals")
    pairs = cut_lineage(sums.join(near(goal), qid_col).where(F.col("seen") + F.col("rest") >= reach).select(qid_col, *order), "pairs")
    if plan is not None:
        plan |= {"worth": worth, "known": known, "kept": kept, "met": met, "pairs": pairs, "hit": hit}
    return _best(_exact(hit, near(worth), small(pairs), qid_col, part), qid_col, k)
