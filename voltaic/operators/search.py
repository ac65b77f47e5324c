"""Document search (R1-R7): fixed-size chunking, postings, BM25 top-k, exact and approximate vector search.

Postings are ``(doc_id, chunk_id, token, tf, dl, attributes..)``, chunk statistics ``(doc_id, chunk_id, dl,
attributes..)``. :mod:`voltaic.operators.postings` stores them as an index and searches it with score bounds; the
functions here rank straight from postings or chunks, without an index.

Query plan without an index: query terms are joined to postings on the token (broadcast behind a check of
their size); only the matched postings are aggregated. Top-k per query is ``row_number() <= k``, which Spark
plans with a partial ``WindowGroupLimit`` before the shuffle, so a query matching a hot term ships at
most ``k`` rows per map task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voltaic.operators.relational import top_n_per_group
from voltaic.operators.text import BROADCAST_MAX_ROWS, TOKEN_PATTERN, small, word_counts
from voltaic.session import cut_lineage

# Chunk size, characters per page and the section label of the domain's chunk table.
CHUNK_SIZE = 2000
CHARS_PER_PAGE = 3000
SECTION_LABEL = "Sezione "


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_SIZE,
          min_len: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Fixed-size chunks of the *whole* text (no chunk cap).

    ``chunk_id`` 1..n per document, ``section`` = ``'Sezione ' || chunk_id``,
    ``page = ceil(chunk_id * size / 3000)``; chunks of ``min_len`` characters or fewer are dropped.
    The chunk count comes from the text length, and the generator runs per row (no join, no shuffle).
    """
    n = F.ceil(F.length(F.col(text_col)) / size)
    idx = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    keep = keep or []
    c = docs.select(id_col, *keep, text_col, F.explode(idx).alias("_i"))
    cid = (F.col("_i") + 1).cast("long")
    out = c.select(id_col, *keep, cid.alias("chunk_id"),
                   F.concat(F.lit(SECTION_LABEL), cid.cast("string")).alias("section"),
                   F.ceil(cid * size / CHARS_PER_PAGE).cast("long").alias("page"),
                   F.substring(F.col(text_col), F.col("_i") * size + 1, size).alias("content"))
    return out.where(F.length("content") > min_len)


def section(chunk_id: str):
    """The section label of a chunk number."""
    return F.concat(F.lit(SECTION_LABEL), F.col(chunk_id).cast("string"))


def build_index(chunks: DataFrame, id_cols: tuple[str, str] = ("doc_id", "chunk_id"),
                text_col: str = "content", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(postings, chunk_stats)`` from chunks, both with the attribute columns ``keep``.

    ``postings(doc_id, chunk_id, token, tf, dl)``; ``chunk_stats(doc_id, chunk_id, dl)`` with ``dl`` the
    token count of the chunk (0 for a chunk without tokens, so it still counts in ``N``).
    """
    ids = [*id_cols, *keep]
    arr = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)
    # tokenise once into a column: an inline expression would be evaluated for every exploded token
    toks = chunks.select(*ids, arr.alias("tokens")).select(*ids, "tokens", F.size("tokens").cast("long").alias("dl"))
    stats = chunks.select(*ids, F.size(arr).cast("long").alias("dl"))
    # a chunk's words are counted where it is read; only chunks whose ids stand more than once are brought together
    again = cut_lineage(chunks.groupBy(*id_cols).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in id_cols]), "again")
    if again.isEmpty():
        return chunk_postings(toks, tuple(ids)), stats
    again, same = small(again), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in id_cols])
    merged = (toks.join(again, same, "left_semi").select(*ids, "dl", F.explode("tokens").alias("token"))
              .groupBy(*id_cols, "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), *[F.first(c).alias(c) for c in keep]))
    return chunk_postings(toks.join(again, same, "left_anti"), tuple(ids)).unionByName(merged), stats


def chunk_postings(chunks: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """``(ids.., token, tf, dl)`` of ``chunks(ids.., tokens, dl)``, without a shuffle (:func:`text.word_counts`). Rows are
    taken one by one: ids must be unique."""
    return word_counts(chunks, [*ids, "dl"]).select(*ids, "token", "tf", "dl")


def term_stats(postings: DataFrame) -> DataFrame:
    """Per token: document (chunk) frequency and collection frequency. Map-side partial aggregation
    makes hot tokens cheap: each map task sends one row per token."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def token_bucket(c, buckets: int):
    return F.pmod(F.xxhash64(c), F.lit(buckets))


def query_terms(queries: DataFrame, qid_col: str, qtext_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(query and token, token, whether the tokens are few enough to broadcast)."""
    qt = (queries.select(qid_col, F.explode(F.regexp_extract_all(F.lower(F.col(qtext_col)),
                                                                  F.lit(TOKEN_PATTERN), 0)).alias("token"))
          .distinct())
    terms = qt.select("token").distinct()
    few = terms.limit(BROADCAST_MAX_ROWS + 1).count() <= BROADCAST_MAX_ROWS
    return small(qt), F.broadcast(terms) if few else terms, few


def _score(hit: DataFrame, qt: DataFrame, few: bool, corpus, qid_col: str, id_list: list[str], k: int,
           k1: float, b: float) -> DataFrame:
    """``hit(ids.., token, tf, dl)`` restricted to query terms -> top-k per query."""
    dfreq = hit.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # at most one row per query term
    n, avgdl = corpus["n"], corpus["avgdl"]
    idf = F.ln(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    # what a posting is worth does not depend on the query: computed once, before it meets the queries
    worth = hit.join(F.broadcast(dfreq) if few else dfreq, "token").select(*id_list, "token", part.alias("_p"))
    scored = (worth.join(qt, "token").groupBy(qid_col, *id_list).agg(F.sum("_p").alias("_s"))
              .withColumn("score", F.round("_s", 6)).drop("_s"))
    return top_n_per_group(scored, [qid_col], [F.desc("score"), *[F.asc(c) for c in id_list]], k)


def bm25(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 5,
         qid_col: str = "query_id", qtext_col: str = "query", k1: float = 1.2, b: float = 0.75,
         ids: tuple[str, str] = ("doc_id", "chunk_id")) -> DataFrame:
    """R4, K4 over a built index: top ``k`` chunks per query by BM25
    -> ``(query_id, rank, doc_id, chunk_id, score)``.

    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``; score rounded to 6 digits; ties by ids. Only the
    postings of query terms go on (semi join); ``N`` and mean length are one scalar subquery over the
    chunk statistics.
    """
    id_list = list(ids)
    qt, terms, few = query_terms(queries, qid_col, qtext_col)
    hit = postings.join(terms, "token", "left_semi")
    corpus = stats.select(F.struct(F.count(F.lit(1)).alias("n"),
                                   (F.sum("dl").cast("double") / F.count(F.lit(1))).alias("avgdl"))).scalar()
    return _score(hit, qt, few, corpus, qid_col, id_list, k, k1, b)


def bm25_chunks(chunks: DataFrame, queries: DataFrame, k: int = 5, qid_col: str = "query_id",
                qtext_col: str = "query", k1: float = 1.2, b: float = 0.75,
                ids: tuple[str, str] = ("doc_id", "chunk_id"), text_col: str = "content",
                checkpoint: bool = True) -> DataFrame:
    """R4 without a stored index: the same ranking straight from chunks, in one tokenising pass.

    Each chunk is tokenised once; its token count rides along with every token, tokens are cut to
    the query terms (broadcast semi join) *before* the (chunk, token) aggregation, so the shuffle
    carries only matching postings.
    """
    id_list = list(ids)
    qt, terms, few = query_terms(queries, qid_col, qtext_col)
    arr = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)
    # tokenise once into a column; size and explode both read it (an inline expression would be
    # re-evaluated for every exploded token)
    toks = (chunks.select(*id_list, arr.alias("_t"))
            .select(*id_list, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("token")))
    hit = (toks.join(terms, "token", "left_semi").groupBy(*id_list, "token")
           .agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))
    if checkpoint:
        # read twice below (document frequency, scoring): cut lineage once into shared storage
        hit = cut_lineage(hit)
    corpus = chunks.select(F.struct(F.count(F.lit(1)).alias("n"),
                                    (F.sum(F.size(arr)).cast("double") / F.count(F.lit(1))).alias("avgdl"))).scalar()
    return _score(hit, qt, few, corpus, qid_col, id_list, k, k1, b)


def cosine(a, b):
    """Exact cosine of two numeric arrays with Spark higher-order functions (no UDF)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return dot / (na * nb)


QUERY_BLOCK = 1_024     # query vectors multiplied in one pass over the corpus


def has_direction(vector):
    """Whether an array has a cosine: not null or empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)             # no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors_by_length(column):
    """(rows, matrix) per vector length of an Arrow list column without nulls, from its flat buffer."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    off = column.offsets.to_numpy()
    off, sizes = off[:-1] - off[0], np.diff(off)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[off[rows][:, None] + np.arange(dim)]


def query_block(rows: list) -> dict:
    """Collected (id, vector) rows as {dimension: (ids, normalised matrix)}."""
    by_dim: dict[int, list] = {}
    for qid, v in rows:
        by_dim.setdefault(len(v), []).append((qid, v))
    return {d: ([q for q, _ in g], normal(np.array([v for _, v in g], np.float64))) for d, g in by_dim.items()}


def best_rows(queries: np.ndarray, vectors: np.ndarray, k: int):
    """Per query the ``k`` best rows by (cosine rounded to 6 digits, row): (row indices, cosines)."""
    got = np.round(queries @ normal(vectors).T, 6)
    best = np.argsort(-got, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(got, best, 1)


def _block_cosines(shared, k: int, names: list[str], qid_type):
    def run(batches):
        queries = shared.value
        for batch in batches:
            for rows, vectors in vectors_by_length(batch.column(1)):
                if vectors.shape[1] not in queries:
                    continue
                ids, unit = queries[vectors.shape[1]]
                key = batch.column(0).take(pa.array(rows))
                by_id = pa.compute.sort_indices(key).to_numpy()
                best, got = best_rows(unit, vectors[by_id], k)
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(by_id[best].ravel())), pa.array([q for q in ids for _ in range(best.shape[1])], qid_type),
                     pa.array(got.ravel())], names=names)
    return run


def query_blocks(queries: DataFrame, qid_col: str, qvec_col: str):
    """The query vectors that have a direction, in lists of about ``QUERY_BLOCK`` rows."""
    q = queries.where(has_direction(F.col(qvec_col))).select(qid_col, F.col(qvec_col).cast("array<double>").alias(qvec_col))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64(qid_col), F.lit(blocks)) == b).collect()
        if rows:
            yield [(r[0], r[1]) for r in rows]


def search_schema(corpus: DataFrame, queries: DataFrame, id_col: str, qid_col: str) -> str:
    return ", ".join(f"{n} {f[c].dataType.simpleString()}" for n, f, c in
                     ((id_col, corpus.schema, id_col), (qid_col, queries.schema, qid_col))) + ", cosine double"


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                  vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "qvec") -> DataFrame:
    """Exact cosine top ``k`` per query vector -> ``(query_id, rank, vec_id, cosine)``.

    Null, empty and zero vectors and those with null or non-finite components have no cosine: as rows they are never found,
    as queries they find nothing. Vectors of different length never meet. Any number of query vectors: they
    are broadcast in blocks of about ``QUERY_BLOCK``, each block one pass over the corpus. A task normalises both
    sides once, multiplies whole Arrow batches and keeps the ``k`` best rows per query and batch, so only those
    are shuffled.
    """
    sc = corpus.sparkSession.sparkContext
    qid_type = to_arrow_type(queries.schema[qid_col].dataType)
    schema = search_schema(corpus, queries, id_col, qid_col)
    rows = corpus.where(has_direction(F.col(vec_col))).select(id_col, vec_col)
    out = None
    for block in query_blocks(queries, qid_col, qvec_col):
        shared = sc.broadcast(query_block(block))
        part = rows.mapInArrow(_block_cosines(shared, k, [id_col, qid_col, "cosine"], qid_type), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], schema)
    return top_n_per_group(out, [qid_col], [F.desc("cosine"), F.asc(id_col)], k)


def centroids(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """Mean vector per key: ``posexplode`` + ``avg`` per (key, position), re-assembled in order."""
    e = df.select(key, F.posexplode(vec_col).alias("_p", "_x"))
    g = e.groupBy(key, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_v")).select(
        key, F.transform("_v", lambda x: x["_m"]).alias("qvec"))
