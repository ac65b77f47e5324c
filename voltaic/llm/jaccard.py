"""N-gram Jaccard join with signature trees (operator 1).

Documents are sets of distinct word shingles; two link when ``den * |A and B| >= num * |A or B|``.

1. **Sets.** One pass over the texts hashes every shingle to 64 bits and writes, per document, the size
   and a 128-bit hash of its set. Equal sets are one class from here on.
2. **Routing (which documents share a forest).** Two sets over the threshold differ in at most D
   shingles, D known from their sizes. The sets of a size class are cut into the same k > D slices of the
   hash space, so two linked sets have k - D equal slices at least (pigeonhole). A set gives all but its
   k - D - 1 smallest slices as keys; the largest equal slice of a linked pair is a key of both, so no
   link is lost. Keys hold three or four shingles each, so a passage or line that many documents share
   seldom fills one and does not bring those documents together. Classes with an equal key are connected.
   Components of over ``BLOCK`` classes are parted by parity sketches: sets that differ in d shingles have sketches that
   differ in d bits at most, so classes with sketches too far apart can't link, and no link is lost.
3. **Signature trees.** Each connected part is split into blocks of about ``BLOCK`` classes. For every pair
   of blocks a task builds one tree over either block: leaves carry token bitmaps, inner nodes the OR of
   their children's bitmaps with ranges of size. A dual traversal from both roots drops a pair of nodes
   when even the largest overlap their bitmaps allow, or their size ranges, cannot reach the
   threshold; surviving leaf pairs are compared exactly. A task gives one row per linked class (number
   of links, its local group), never the pairs.
4. **Components** of the local groups, by contraction (:mod:`voltaic.llm.graph`).

Null, empty and blank texts have no words: size 0, no links, their own component. A row without an id is
returned without component or links. Rows that repeat an id count as documents of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm import hashing as H
from voltaic.llm.graph import connected_components, met_ids, small_side
from voltaic.session import cut_lineage

BLOCK = 256           # classes per block: bounds the rows of one task's group to two blocks
SEEN = 100_000        # set hashes a task remembers, to give the routing keys of a repeated set once
PACK = 1 << 18        # routing keys a task packs at once
PART_SHINGLES = 8_000_000    # shingles whose routing keys (a third of them, or fewer) meet in one task
CELL = 2048           # classes per cell, of which two meet in a task: sketches are small
SKETCH_BITS = 1 << 15
FANOUT = 8
U64 = np.uint64
I64 = np.int64


def size_classes(num: int, den: int, upto: int) -> np.ndarray:
    """Lower bounds of the size classes that cover sets of up to ``upto`` shingles.

    The first is the smallest size whose set can link to an unequal one."""
    bounds = [-(-den // (den - num))]
    while bounds[-1] <= upto:
        bounds.append(max(bounds[-1] + 6, -(-bounds[-1] * 7 // 5)))
    return np.array(bounds, I64)


def slice_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Routing keys of one sorted set of shingle hashes.

    In a size class all sets are cut into the same ``k`` slices. A set of ``n`` shingles shares at least
    ``k - differ(n)`` equal slices with any partner, so it may leave out fewer slices than that: the
    smallest. The largest equal slice of a pair is then a key of both sets.
    """
    n = len(s)
    bounds = size_classes(num, den, 2 * n + 20)
    own = int(np.searchsorted(bounds, n, "right")) - 1
    classes = [own] if own >= 0 else []
    if den * n >= num * int(bounds[own + 1]):       # a larger partner may be of the next class
        classes.append(own + 1)
    if not classes:
        return np.zeros(0, U64)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(H.finalise(s ^ H.MIX[3]), dtype=U64)])
    out = []
    for j in classes:
        top = int(bounds[j + 1]) - 1
        most = (den - num) * 2 * top // (den + num)
        differ = (den - num) * (n + min(top, den * n // num)) // (den + num)
        k = most + 1 + most // 4
        cuts = np.searchsorted((s >> U64(32)) * U64(k) >> U64(32), np.arange(k + 1).astype(U64), "left")
        held = np.diff(cuts)
        least = np.partition(held, k - differ - 1)[k - differ - 1]     # fewer than k - differ are below it
        keep = np.flatnonzero(held >= least)
        out.append(H.finalise((total[cuts[keep + 1]] - total[cuts[keep]]) + held[keep].astype(U64) * H.MIX[0]
                              + keep.astype(U64) * H.MIX[1] + np.full(len(keep), j, U64) * H.MIX[2]))
    return np.concatenate(out)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    one = int(H.finalise(s).sum(dtype=U64)) if len(s) else 0
    two = int(H.finalise(s * H.MIX[5] + H.MIX[6]).sum(dtype=U64)) if len(s) else 0
    return tuple(int(np.array(x, U64).view(I64)) for x in (one, two))


def _texts(batch, column: str, shingle: int):
    """(row ranges, sets) of a batch, in pieces of bounded bytes."""
    raw, off = H.string_buffers(batch.column(column))
    for lo, hi in H.batches_by_bytes(off):
        words, first = H.hash_words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], H.SPACE_WORDS)
        yield lo, hi, [H.shingle_set(words[first[i]:first[i + 1]], shingle) for i in range(hi - lo)]


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit per place, flipped by each shingle whose hash falls there; at least as many places as shingles (a power of two, up
    to ``SKETCH_BITS``). Sets that differ in d shingles differ in d bits at most. A sketch folds to half its places by XOR."""
    bits = 64
    while bits < min(len(s), SKETCH_BITS):
        bits *= 2
    odd = (np.bincount((H.finalise(s) & U64(bits - 1)).astype(I64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _sign(shingle: int):
    """Size, set hash and parity sketch of every document."""
    def run(batches):
        for batch in batches:
            for lo, hi, sets in _texts(batch, "text", shingle):
                hashes = [set_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()),
                     pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())],
                    names=["id", "n", "h1", "h2", "sk"])
    return run


def _links_of(keys: np.ndarray, owners: np.ndarray):
    """Of (key, set) rows: the distinct keys, ascending, the least set of each, and the distinct (least set, other set) links."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = owners[first]
    hub = least[np.cumsum(first) - 1]
    other = hub != owners
    return keys[first], least, np.unique(np.stack([hub[other], owners[other]]), axis=1)


def _packed(keys: np.ndarray, owners: np.ndarray, parts: int) -> pa.RecordBatch:
    """Routing keys as rows (part, linked, x, y), a row per range of the key space: its distinct keys, byte by byte in order of
    their weight (sorted keys start alike, so this packs well), and the least set of each. Sets that share a key here are linked
    here and travel as links (``linked``: hubs and sets)."""
    keys, least, links = _links_of(keys, owners)
    cuts = np.searchsorted((keys >> U64(32)) * U64(parts) >> U64(32), np.arange(parts + 1).astype(U64), "left")
    part = np.flatnonzero(np.diff(cuts))
    rows = [(int(p), False, keys[cuts[p]:cuts[p + 1]].astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes(),
             least[cuts[p]:cuts[p + 1]].tobytes()) for p in part]
    if links.shape[1]:
        place = int(H.finalise(links.view(U64)).sum(dtype=U64)) % parts
        rows.append((place, True, links[0].tobytes(), links[1].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(
        (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["part", "linked", "x", "y"])


def _route(shingle: int, num: int, den: int, parts: int):
    """Packed routing keys (:func:`_packed`) of the sets; a set that the task has met before is left out."""
    def run(batches):
        seen: dict = {}
        keys, owners, held = [], [], 0
        for batch in batches:
            for _, _, sets in _texts(batch, "text", shingle):
                for s in sets:
                    h = set_hash(s)
                    if len(s) and h not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[h] = None
                        keys.append(slice_keys(s, num, den))
                        owners.append(np.full(len(keys[-1]), h[0], I64))
                        held += len(keys[-1])
                if held >= PACK:
                    yield _packed(np.concatenate(keys), np.concatenate(owners), parts)
                    keys, owners, held = [], [], 0
        if held:
            yield _packed(np.concatenate(keys), np.concatenate(owners), parts)
    return run


def _meet():
    """Links (a, b) of the sets that share a key, from the packed rows of one range of the key space."""
    def pairs(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        keys, owners = [], []
        for batch in batches:
            for linked, x, y in zip(*(batch.column(c).to_pylist() for c in ("linked", "x", "y"))):
                if linked:
                    yield pairs(np.frombuffer(x, I64), np.frombuffer(y, I64))
                else:
                    keys.append(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel().astype(U64))
                    owners.append(np.frombuffer(y, I64))
        if keys:
            links = _links_of(np.concatenate(keys), np.concatenate(owners))[2]
            if links.shape[1]:
                yield pairs(links[0], links[1])
    return run


def sketch_pairs(n: np.ndarray, maps: list, m: np.ndarray, others: list, num: int, den: int):
    """Pairs (x, y) of two lists of sizes and sketches (as words) whose sets may link: sets over the threshold differ in at most
    ``(den - num) / (den + num)`` of their shingles. No linked pair is lost."""
    found = [(np.zeros(0, I64), np.zeros(0, I64))]
    wide, high = np.array([len(w) for w in maps]), np.array([len(w) for w in others])
    for a in np.unique(wide):
        for b in np.unique(high):
            x, y, least = np.flatnonzero(wide == a), np.flatnonzero(high == b), min(a, b)
            x, y = x[np.argsort(n[x], kind="stable")], y[np.argsort(m[y], kind="stable")]
            p, q = (np.bitwise_xor.reduce(np.stack([side[i] for i in at]).reshape(len(at), -1, least), 1)
                    for at, side in ((x, maps), (y, others)))
            step = max(1, (8 << 20) // (8 * least * len(y)))
            for at in range(0, len(x), step):
                own = n[x[at:at + step]]
                lo = int(np.searchsorted(den * m[y], num * own[0], "left"))
                hi = int(np.searchsorted(num * m[y], den * own[-1], "right"))
                if lo < hi:
                    apart = np.bitwise_count(p[at:at + step, None] ^ q[None, lo:hi]).sum(2, dtype=I64)
                    i, j = np.nonzero((den + num) * apart <= (den - num) * (own[:, None] + m[y[lo:hi]][None]))
                    found.append((x[at + i], y[lo + j]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _sketch_links(num: int, den: int):
    """Groups (comp, i, j) of sketches arrive sorted, each of at most two cells: (set, least set of its local group) rows."""
    def group(rows: list) -> pa.RecordBatch | None:
        rows = list({r[0]: r for r in rows}.values())                 # a repeated row is one class
        left, right = ([r for r in rows if r[3] == r[c]] for c in (4, 5))
        one = rows[0][4] == rows[0][5]
        if not left or not right:
            return None
        n, m = (np.array([r[1] for r in side], I64) for side in (left, right))
        x, y = sketch_pairs(n, [r[2] for r in left], m, [r[2] for r in right], num, den)
        y = y if one else y + len(left)
        members = left if one else left + right
        h1 = np.array([r[0] for r in members], I64)
        low = local_groups(len(members), x, y)
        least = np.full(len(members), np.iinfo(I64).max)
        np.minimum.at(least, low, h1)
        linked = np.flatnonzero(least[low] != h1)
        return pa.RecordBatch.from_arrays([pa.array(h1[linked]), pa.array(least[low][linked])], names=["a", "b"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("comp", "i", "j", "h1", "n", "sk", "cell")]
            for comp, i, j, h1, n, sk, cell in zip(*cols):
                if (comp, i, j) != now:
                    if rows and (out := group(rows)) is not None:
                        yield out
                    now, rows = (comp, i, j), []
                rows.append((h1, n, np.frombuffer(sk, U64), cell, i, j))
        if rows and (out := group(rows)) is not None:
            yield out
    return run


def _refined(spark, signed: DataFrame, classes: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """``comps(h1, comp)`` with the large components parted: there, only classes whose sketches are near enough stay connected.

    A common passage fills a routing key now and then, so components grow faster than the corpus, and all sets of one would be
    dealt to all its pairs of blocks. Sketches are a fiftieth of the sets' bytes and are dealt in larger cells."""
    sizes = comps.groupBy("comp").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    large = cut_lineage(comps.join(small_side(cut_lineage(sizes, "sizes")), "comp").select("h1", "comp", F.ceil(F.col("_n") / CELL).cast("int").alias("cells")), "large")
    if large.isEmpty():
        return comps
    held = cut_lineage(classes.join(small_side(large), "h1").select("h1", "h2", F.col("rep").alias("id"), "comp", "cells"), "held")
    dealt = (signed.select("id", "h1", "h2", "n", "sk").join(small_side(held), ["h1", "h2", "id"])
             .withColumn("cell", F.pmod(F.xxhash64("h1"), F.col("cells")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
             .select("comp", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "h1", "n", "sk"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = cut_lineage(dealt.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
                       .mapInArrow(_sketch_links(num, den), "a long, b long"), "near")
    parted = connected_components(near, "a", "b").select(F.col("node").alias("h1"), F.col("root").alias("comp"))
    return cut_lineage(comps.join(small_side(large.select("h1")), "h1", "left_anti").select("h1", "comp").unionByName(parted), "parted")


def _sets(shingle: int):
    """Shingle sets of the member documents; a row whose text is not the member's (a repeated id) goes."""
    def run(batches):
        for batch in batches:
            h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            for lo, hi, sets in _texts(batch, "text", shingle):
                keep = [i for i in range(hi - lo) if set_hash(sets[i]) == (h1[lo + i], h2[lo + i])]
                rows = batch.slice(lo, hi - lo).take(pa.array(keep, pa.int64()))
                flat = np.concatenate([sets[i] for i in keep]) if keep else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in ("comp", "blocks", "id", "copies")]
                    + [H.lists(flat.view(I64), [len(sets[i]) for i in keep], pa.int64())],
                    names=["comp", "blocks", "id", "copies", "s"])
    return run


class SignatureTree:
    """Bottom-up tree over sets: level 0 are the sets' bitmaps, each further level ORs ``FANOUT`` nodes."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], I64)
        low = np.array([s[0] for s in sets], U64)
        self.order = np.lexsort((low, sizes))                    # neighbours in the tree are alike
        maps = np.zeros((len(sets), bits // 64), U64)
        for row, i in enumerate(self.order):
            at = sets[i] & U64(bits - 1)
            np.bitwise_or.at(maps[row], (at >> U64(6)).astype(I64), U64(1) << (at & U64(63)))
        sizes = sizes[self.order]
        spare = sizes - np.bitwise_count(maps).sum(1, dtype=I64)  # shingles beyond the bits they set
        self.levels = [(maps, sizes, sizes, spare)]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, sp = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at)))


def _possible(a, b, x, y, num: int, den: int) -> np.ndarray:
    """Which node pairs (a[x], b[y]) may hold a link: size ranges, then the most overlap the bitmaps allow."""
    (ma, la, ha, sa), (mb, lb, hb, sb) = a, b
    ok = (den * ha[x] >= num * lb[y]) & (den * hb[y] >= num * la[x])
    keep = np.flatnonzero(ok)
    step = max(1, (8 << 20) // (ma.shape[1] * 8))
    for p in range(0, len(keep), step):
        k = keep[p:p + step]
        most = np.bitwise_count(ma[x[k]] & mb[y[k]]).sum(1, dtype=I64) + np.minimum(sa[x[k]], sb[y[k]])
        ok[k] = (num + den) * most >= num * (la[x[k]] + lb[y[k]])
    return ok


def dual_traversal(a: SignatureTree, b: SignatureTree, num: int, den: int):
    """Pairs of sets (positions in either block) that the trees cannot rule out."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    x, y = np.zeros(1, I64), np.zeros(1, I64)
    while True:
        ok = _possible(a.levels[la], b.levels[lb], x, y, num, den)
        x, y = x[ok], y[ok]
        if not len(x) or la == lb == 0:
            return a.order[x] if len(x) else x, b.order[y] if len(y) else y
        for side in ("a", "b"):
            level, tree = (la, a) if side == "a" else (lb, b)
            if level == 0:
                continue
            v, w = (x, y) if side == "a" else (y, x)
            below = len(tree.levels[level - 1][1])
            child = (v[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            other = np.repeat(w, FANOUT)
            fits = child < below
            child, other = child[fits], other[fits]
            x, y = (child, other) if side == "a" else (other, child)
            if side == "a":
                la -= 1
            else:
                lb -= 1


def exact_links(sa: list, sb: list, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Exact test of the candidate pairs: few pairs by merging, many by products of incidence blocks."""
    na, nb = np.array([len(s) for s in sa], I64), np.array([len(s) for s in sb], I64)
    if len(x) <= 2 * (len(np.unique(x)) + len(np.unique(y))):
        both = np.array([len(np.intersect1d(sa[i], sb[j], True)) for i, j in zip(x, y)], I64)
    else:
        rows = [sa[i] for i in range(len(sa))] + [sb[j] for j in range(len(sb))]
        tokens, at = np.unique(np.concatenate(rows), return_inverse=True)
        who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        inter = np.zeros((len(sa), len(sb)))
        for lo in range(0, len(tokens), 4096):
            p, q = np.searchsorted(at, [lo, lo + 4096])
            block = np.zeros((len(rows), min(4096, len(tokens) - lo)), np.float32)
            block[who[p:q], at[p:q] - lo] = 1
            inter += block[:len(sa)] @ block[len(sa):].T
        both = inter[x, y].astype(I64)
    return den * both >= num * (na[x] + nb[y] - both)


def link_blocks(left: list, right: list | None, num: int, den: int):
    """Linked pairs within ``left`` (``right`` None) or between the two blocks."""
    sets = left + (right or [])
    bits = 64
    while bits < min(1 << 16, 16 * max(len(s) for s in sets)):
        bits *= 2
    a = SignatureTree(left, bits)
    b = a if right is None else SignatureTree(right, bits)
    x, y = dual_traversal(a, b, num, den)
    if right is None:
        x, y = x[x < y], y[x < y]
    if not len(x):
        return x, y
    ok = exact_links(left, left if right is None else right, x, y, num, den)
    return x[ok], y[ok]


def local_groups(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component in a graph of ``n`` nodes held in memory."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link(num: int, den: int):
    """Groups (comp, i, j) arrive sorted; each is at most two blocks."""
    def group(rows: list) -> list:
        seen: dict = {}
        for r in rows:                                   # a repeated row is one class
            seen.setdefault(r[0], r)
        rows = sorted(seen.values(), key=lambda r: r[0])
        i, j = rows[0][4], rows[0][5]
        left = [r for r in rows if r[3] == i]
        right = None if i == j else [r for r in rows if r[3] == j]
        if not left or (right is not None and not right) or len(rows) < 2:
            return []
        x, y = link_blocks([r[2] for r in left], None if right is None else [r[2] for r in right], num, den)
        if not len(x):
            return []
        if right is not None:
            y = y + len(left)
        members = left + (right or [])
        copies = np.array([r[1] for r in members], I64)
        links = np.zeros(len(members), I64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        ids = np.array([r[0] for r in members], I64)
        low = local_groups(len(members), x, y)
        least = np.full(len(members), np.iinfo(I64).max)
        np.minimum.at(least, low, ids)
        return [(int(ids[m]), int(least[low[m]]), int(links[m])) for m in np.flatnonzero(links)]

    def run(batches):
        now, rows, out = None, [], []
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "i", "j", "blk", "id", "copies")}
            s = batch.column("s")
            flat = s.flatten().to_numpy(zero_copy_only=False).view(U64)
            off = s.offsets.to_numpy() - s.offsets[0].as_py() if len(s) else []
            for r in range(batch.num_rows):
                key = (cols["comp"][r], cols["i"][r], cols["j"][r])
                if key != now:
                    if rows:
                        out += group(rows)
                    now, rows = key, []
                rows.append((int(cols["id"][r]), int(cols["copies"][r]), flat[off[r]:off[r + 1]].copy(),
                             cols["blk"][r], cols["i"][r], cols["j"][r]))
            if len(out) > 5000:
                yield _rows(out)
                out = []
        if rows:
            out += group(rows)
        yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)],
                                          names=["id", "low", "links"])
    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                 num: int = 80, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, n_links) of every row of ``docs``.

    ``n_links`` counts the other documents linked directly, copies included.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(texts.mapInArrow(_sign(shingle), "id long, n long, h1 long, h2 long, sk binary"), "signed")
    classes = cut_lineage(signed.where("n > 0 and id is not null").groupBy("h1", "h2")
                          .agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shingles = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(parts, -(-shingles // PART_SHINGLES))
    # the keys are the bulk of what is stored on the way: they are shuffled once, packed, and only the links are staged
    keys = texts.where("id is not null and text is not null").select("text").mapInArrow(
        _route(shingle, num, den, ranges), "part int, linked boolean, x binary, y binary")
    routed = connected_components(keys.repartitionById(ranges, "part").mapInArrow(_meet(), "a long, b long"), "a", "b")
    comps = cut_lineage(routed.select(F.col("node").alias("h1"), F.col("root").alias("comp")), "routed")
    comps = _refined(spark, signed, classes, comps, num, den)
    blocks = comps.groupBy("comp").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = cut_lineage(classes.join(comps, "h1").join(blocks, "comp")
                          .select("comp", "blocks", "h1", "h2", F.col("rep").alias("id"), "copies"), "members")

    sets = met_ids(texts.where("text is not null"), members, "id").mapInArrow(
        _sets(shingle), "comp long, blocks int, id long, copies long, s array<long>")
    dealt = (sets.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("comp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"),
                     "blk", "id", "copies", "s"))
    linked = cut_lineage(dealt.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
                         .mapInArrow(_link(num, den), "id long, low long, links long"), "linked")

    groups = connected_components(linked, "id", "low")
    links = linked.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    found = (classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
             .where("copies > 1 or links is not null")
             .select("h1", "h2", F.coalesce("root", "rep").alias("comp"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    return signed.drop("sk").join(found, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("comp", "id")).otherwise(F.col("id")))
        .alias("component_id"),
        F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
        .alias("n_links"))
