"""Plain Python versions that the operators are held against."""

import hashlib
import itertools
import re

LOWER = {c: chr(c + 32) for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width):
    parts = words(text)
    if len(parts) < width:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + width]) for i in range(len(parts) - width + 1)}


def near_components(docs, width, percent):
    """{id: smallest id reachable} by comparing every pair."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, epochs=2.0, seed="mix"):
    """{id: (target, words taken)} by clamping and sharing anew until nothing is above."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = sum(sizes.values()) * share, set(order)
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > sizes[s] * epochs}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = sizes[s] * epochs
            left -= target[s]
        open_ -= over
    out = {}
    for source in order:
        own = [(hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, len(words(t)))
               for i, t, s in docs if s == source]
        repeats = int(target[source] // sizes[source]) if sizes[source] else 0
        need, done = target[source] - repeats * sizes[source], 0
        for _, i, n in sorted(own):
            out[i] = (target[source], n * (repeats + (done + n / 2 <= need)))
            done += n
    return out


def best_fit(items, capacity):
    """Bin of each (size, source, cluster): the tightest that fits, looked for in all bins."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [
            (left, n) for n, (left, sources, clusters) in enumerate(bins)
            if left >= size and source not in sources and cluster not in clusters
        ]
        if fit:
            n = min(fit)[1]
        else:
            n = len(bins)
            bins.append([capacity, set(), set()])
        bins[n][0] -= size
        bins[n][1] |= {source} - {None}
        bins[n][2] |= {cluster} - {None}
        out.append(n)
    return out
