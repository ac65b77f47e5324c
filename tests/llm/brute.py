"""Plain Python versions of the operators' contracts, for small inputs."""
import re
from collections import defaultdict


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def space_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s))


def alnum_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard(rows, shingle, num, den):
    """rows (id, text), ids not null -> sorted (id, size, component, links)."""
    sets = []
    for _, t in rows:
        w = space_words(t)
        k = min(shingle, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, pairs = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    comp = components(len(rows), pairs)
    least = defaultdict(lambda: 1 << 62)
    for (i, _), c in zip(rows, comp):
        least[c] = min(least[c], i)
    return sorted((i, len(s), least[c], n) for (i, _), s, c, n in zip(rows, sets, comp, links))


def hits(rows, items, window):
    """rows (id, text), items (item, text) -> {id: (words, hit, items)}."""
    wins = defaultdict(set)
    for item, t in items:
        w = alnum_words(t)
        n = min(window, len(w))
        if n:
            for k in range(len(w) - n + 1):
                wins[tuple(w[k:k + n])].add("" if item is None else str(item))
    out = {}
    for i, t in rows:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out
