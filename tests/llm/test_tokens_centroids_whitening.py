"""Token files, centroid clustering and whitening against plain versions and on the awkward cases of their docstrings."""
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from voltaic.llm import centroids, queries, registry, tokenfile, whitening

tokenizer_files = pytest.importorskip("public_tokenizers")
NAN, INF = float("nan"), float("inf")


def test_query_names():
    assert all(n.startswith("op") and n[2:].split("_")[0].isdigit() for n in registry.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))
    assert set(registry.QUERIES) < set(E.queries()) and queries


# -- token files

ALPHABET = " \n\t  \x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b abZ'1ſé中😀.,​́st<|endoftext|>"


def encoded(spec, texts):
    ids, n = tokenfile._encoder(spec, np.dtype("<u2"))(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    return [ids[a:b].tolist() for a, b in zip(ends - n, ends)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_like_whole_texts(name):
    path = tokenizer_files.path(name)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    assert tokenfile.cuts_at_spaces(spec) == name.startswith("byte")
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a<|endoftext|> b", " <|endoftext|> 's 'll x", "x" * 30_000 + " y", "plain words only here", "one"]
    tok = Tokenizer.from_file(path)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(spec, texts) == want
    assert encoded(spec, texts[-3:]) == want[-3:]
    assert encoded(spec, []) == []


@pytest.mark.parametrize("most", [3, 256, 65_537, 1 << 24, 1 << 32])
def test_streams_round_trip(most):
    rng = np.random.default_rng(most)
    counts = np.array([0, 1, 3, 4, 5, 0, 987, 0])
    ranks = rng.integers(0, most, counts.sum())
    ranks[:4] = most - 1
    control, control_ends, data, data_ends = tokenfile.pack(ranks, counts)
    assert (tokenfile.unpack(control, data, counts) == ranks).all()
    assert control_ends.tolist() == np.cumsum((counts + 3) // 4).tolist() and data_ends[-1] == len(data)
    lengths = [1 if r < 1 << 8 else 2 if r < 1 << 16 else 3 if r < 1 << 24 else 4 for r in ranks.tolist()]
    assert data_ends.tolist() == [sum(lengths[:e]) for e in np.cumsum(counts)]
    one = ranks[4:8]                                             # the fourth document: a control byte of its own
    assert control[2] == sum(length - 1 << 2 * i for i, length in enumerate(lengths[4:8])) and len(one) == 4


def plain_tokens(rows, end=0):
    tok = Tokenizer.from_file(tokenizer_files.path("byte_bpe_50k.json"))
    coded = [(i, tok.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]
    return [(i, np.array(ids, "<u4").tobytes()) for i, ids in coded]


def test_token_files_of_awkward_rows(spark):
    path = tokenizer_files.path("byte_bpe_50k.json")
    rows = [(3, "same id"), (3, "same id, other text"), (3, "same id"), (None, "no id"), (1, None), (2, ""), (-5, "  odd  spaces \n"),
            (4, "long " * 50_000), (7, "copy of a text"), (6, "copy of a text")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, shard int, ids string, start int")
    files = tokenfile.write_token_files(df.repartition(4), path)
    got = tokenfile.read_token_files(spark, files).orderBy("start").collect()
    order = [r.doc_id for r in got]
    assert order == [None, -5, 1, 2, 3, 3, 3, 4, 6, 7]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), b) for i, b in plain_tokens(rows))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    ranks = spark.read.parquet(files + "/vocabulary").orderBy("rank").collect()
    counts = {}
    for r in got:
        for i in np.frombuffer(r.ids, "<u4").tolist():
            counts[i] = counts.get(i, 0) + 1
    assert [r.id for r in ranks] == sorted(counts, key=lambda i: (-counts[i], i))
    assert [(r.doc_id, r.start) for r in tokenfile.read_token_files(spark, tokenfile.write_token_files(df, path)).orderBy("start").collect()] == [
        (r.doc_id, r.start) for r in got]
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(df.limit(0), path)).collect() == []


def test_token_query_matches_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for i, ids in plain_tokens([tuple(r) for r in docs]):
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = registry.QUERIES["op13_token_files"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [t for _, t in got.dtypes] == ["bigint"] * 4
    assert sorted(map(tuple, got.collect())) == want


# -- centroid clustering

def plain_clusters(rows, k, rounds, dim, scale, seed):
    ok = lambda v: v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v))
    kept = [(i, [max(-centroids.HELD, min(centroids.HELD, math.floor(x * scale))) if abs(x) < 1e300 else int(math.copysign(centroids.HELD, x))
                 for x in v], v) for i, v in rows if ok(v)]
    drawn = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, q) for i, q, v in kept if i is not None)
    centres = [q for _, _, q in drawn[:k]]

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centres]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        groups = {}
        for _, q, _ in kept:
            groups.setdefault(nearest(q)[0], []).append(q)
        centres = [[sum(col) // len(groups[c]) for col in zip(*groups[c])] if c in groups else centres[c] for c in range(len(centres))]
    placed = [(i, *nearest(q)) for i, q, _ in kept] if centres else []
    per = {}
    for _, c, d in placed:
        per[c] = per.get(c, 0) + d
    return sorted(((i, c, d, per[c], sum(per.values()), tuple(centres[c])) for i, c, d in placed), key=str)


def clusters(df, **more):
    return sorted(((*tuple(r)[:5], tuple(r.centroid)) for r in centroids.cluster_vectors(df, **more).collect()), key=str)


def vector_rows(n, dim, seed=1):
    rng = random.Random(seed)
    base = [[rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(dim)] for _ in range(n // 3)]
    return [(i, list(rng.choice(base)) if rng.random() < 0.6 else [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("entries", [0, 40, 1 << 17])
def test_clusters_are_exact_with_any_dictionary(spark, entries):
    rows = vector_rows(300, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_clusters(rows, 12, 4, 8, 256.0, 2)
    assert clusters(df, k=12, rounds=4, dim=8, entries=entries) == want
    assert clusters(df.repartition(7), k=12, rounds=4, dim=8, entries=entries) == want


def test_clusters_of_awkward_rows(spark):
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [-0.5, 0.25]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [NAN, 0.0]), (6, [INF, 0.0]),
            (7, []), (None, [9.0, 9.0]), (8, [1e300, -1e300]), (9, [-0.0, 0.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")
    for k in (1, 3, 40):
        assert clusters(df, k=k, dim=2) == plain_clusters(rows, k, 5, 2, 256.0, 2)
    assert clusters(df.where("vec_id = 2"), dim=2) == [] and clusters(df.limit(0), dim=2) == []
    renamed = centroids.cluster_vectors(df.withColumnRenamed("vec_id", "distance"), dim=2, id_col="distance")
    assert renamed.columns == ["distance", "cluster", "distance_", "cluster_inertia", "inertia", "centroid"]


def test_cluster_query_matches_a_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = [(*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in plain_clusters(rows, 40, 5, 64, 256.0, 2)]
    got = registry.QUERIES["op11_subvector_clusters"](spark, sf_dir).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# -- whitening

def plain_whitening(rows, components, scale):
    ints = np.array([[math.floor(scale * x) for x in v] for _, v in rows], np.int64)
    fit = np.unique(ints, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, ((n * ints - sums) ** 2).sum(1), (ints - sums / n) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def compare(got, rows, components, scale=256.0):
    """Repeated ids must have equal vectors here, so that rows can be set against each other by (id, component)."""
    got, rows = sorted(got, key=lambda r: r[:2]), sorted(rows)
    n, deviation, white, explained = plain_whitening(rows, components, scale)
    want = sorted((i, c + 1, int(deviation[j]), float(white[j, c])) for j, (i, _) in enumerate(rows) for c in range(components))
    assert [(r[0], r[1], r[3]) for r in got] == [w[:3] for w in want] and {r[2] for r in got} == {n}
    for c in range(1, components + 1):
        mine, theirs = (np.array([r[k] for r in side if r[1] == c]) for side, k in ((got, 4), (want, 3)))
        assert np.abs(mine - theirs * np.sign((mine * theirs).sum())).max() < 1e-9
        assert np.allclose([r[5] for r in got if r[1] == c], explained[c - 1], rtol=1e-10)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


@pytest.mark.parametrize("n,dim,parts", [(300, 8, 1), (300, 8, 40), (60, 64, 3)])
def test_whitening_matches_a_plain_version(spark, n, dim, parts):
    rows = vector_rows(n, dim, seed=dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)                # 40 spectra: more than one tree of FAN_IN
    try:
        compare(map(tuple, whitening.whiten(df).collect()), rows, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rank_one_updates_with_equal_eigenvalues_and_no_change():
    rng = np.random.default_rng(4)
    for dim in (1, 2, 5, 30):
        values, vectors, total = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
        updates = [*rng.integers(-3, 4, (40, dim)).astype(float), *np.eye(dim), *np.eye(dim), np.zeros(dim)]
        for i, w in enumerate(updates):
            values, vectors = whitening.rank_one(values, vectors, w, 1.0 + i % 3)
            total += (1.0 + i % 3) * np.outer(w, w)
            scale = max(1.0, np.abs(total).max())
            assert np.abs(values - np.linalg.eigvalsh(total)).max() < 1e-11 * scale
            assert np.abs(vectors @ np.diag(values) @ vectors.T - total).max() < 1e-11 * scale
            assert np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-11


def test_whitening_of_awkward_rows(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-1.0, 3.0]), (3, [0.0, -0.0]), (4, [70.0, 2.0 ** 30])]
    dropped = [(5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [NAN, 1.0]), (10, [INF, 1.0]), (11, [1.0, 2.0, 3.0])]
    schema = "vec_id long, embedding array<double>, component int, id string"
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows[:4] + dropped], schema)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(map(tuple, out.collect()), rows[:4], 2)
    big = whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], schema)).where("vec_id = 4").first()
    exact = [math.floor(256 * x) for x in rows[4][1]]
    sums = [sum(math.floor(256 * v[d]) for _, v in rows[1:]) for d in range(2)]
    assert big.n == 4 and big.deviation is None and sum((4 * x - s) ** 2 for x, s in zip(exact, sums)) >= 1 << 63
    same = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    assert whitening.whiten(df.where("vec_id > 4 and vec_id < 7")).collect() == []
    assert whitening.whiten(df.limit(0)).collect() == []
    line = whitening.whiten(df.where("vec_id in (1, 2)")).where(F.col("component") == 2).collect()
    assert all(r.whitened is None and r.explained < 1e-12 and r.identity_error < 1e-9 for r in line)


def test_whitening_query_matches_a_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = registry.QUERIES["op12_incremental_whitening"](spark, sf_dir)
    compare(map(tuple, got.collect()), rows, 4)
