"""routing keys travel once and packed; a large routed component is parted by sketches before sets are dealt to block pairs."""
import numpy as np
import pytest

from voltaic.llm import jaccard as J

from . import brute


def random_set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))


def test_sketches_lose_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 3, 8, 9, 30, 64, 200, 500, 900):
        s = random_set(rng, n)
        for share in (0, 0.05, 0.1, 0.15, 0.2, 0.3):
            k = int(len(s) * share)
            sets += [s[rng.permutation(len(s))[k:]], np.concatenate([s[k:], random_set(rng, k)])]
    sets = [np.unique(s) for s in sets if len(s)]
    n, maps = np.array([len(s) for s in sets]), [np.frombuffer(J.parity_sketch(s), np.uint64) for s in sets]
    found = set(zip(*(c.tolist() for c in J.sketch_pairs(n, maps, n[::-1], maps[::-1], 80, 100))))
    last = len(sets) - 1
    linked = {(i, last - j) for i, a in enumerate(sets) for j, b in enumerate(sets)
              if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    assert linked <= found and len(found) < len(sets) ** 2 / 3


def test_packed_keys_give_the_links_of_all_keys():
    rng = np.random.default_rng(4)
    keys, owners = rng.integers(0, 400, 3000).astype(np.uint64) << np.uint64(55), rng.integers(-50, 50, 3000)
    parts, rows = 5, []
    for lo in range(0, 3000, 700):
        rows += J._packed(keys[lo:lo + 700], owners[lo:lo + 700], parts).to_pylist()
    import pyarrow as pa
    a, b = [], []
    for p in range(parts):
        mine = [r for r in rows if r["part"] == p]
        batch = pa.RecordBatch.from_pylist(mine, pa.schema([("part", pa.int32()), ("linked", pa.bool_()), ("x", pa.binary()), ("y", pa.binary())]))
        for out in J._meet()([batch]):
            a += out.column("a").to_pylist()
            b += out.column("b").to_pylist()
    groups = lambda x, y: J.local_groups(100, np.array(x) + 50, np.array(y) + 50).tolist()
    _, least, _ = J._links_of(keys, owners)
    hub = {k: o for k, o in zip(np.unique(keys).tolist(), least.tolist())}
    assert groups(a, b) == groups([hub[k] for k in keys.tolist()], owners.tolist())


@pytest.mark.parametrize("cell", [4, 4096])
def test_a_common_passage_does_not_deal_sets_to_many_blocks(spark, monkeypatch, cell):
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "CELL", cell)
    staged, cut = {}, J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df, name: staged.setdefault(name, cut(df, name)))
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(12))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(6)] + [(200, rows[0][1]), (201, "short"), (202, None)]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, n, c, k) for i, n, c, k in brute.jaccard(rows, 5, 80, 100))
    routed = staged["routed"].groupBy("comp").count().agg({"count": "max"}).first()[0]
    assert routed > 20 and staged["members"].agg({"blocks": "max"}).first()[0] == 1
