"""Small graphs, one month each, and plain definitions of the metrics to compare with."""

import datetime as dt
import itertools
import random

DAY = dt.date(2021, 1, 1)
HAND = {
    "loop_only": [("a", "a", 2)],
    "single": [("a", "b", 1)],
    "reciprocal": [("a", "b", 1), ("b", "a", 3)],
    "cycle": [("a", "b", 1), ("b", "c", 1), ("c", "a", 1)],
    "triple": [("a", "b", 1), ("b", "c", 1), ("a", "c", 1)],
    "star_in": [(x, "hub", 1) for x in "abcd"],
    "star_out": [("hub", x, 1) for x in "abcd"],
    "chain": [("a", "b", 1), ("b", "c", 2), ("c", "d", 1), ("d", "e", 1)],
    "k4": [(x, y, 1) for x in "abcd" for y in "abcd" if x < y],
    "bridge": [(x, y, 5) for g in ("abcd", "wxyz") for x in g for y in g if x != y] + [("d", "w", 1)],
    "sink": [("a", "b", 1), ("c", "b", 2), ("c", "a", 1)],
    "two_parts": [("a", "b", 1), ("c", "d", 1), ("d", "c", 1)],
    "diamond": [("a", "b", 1), ("a", "c", 1), ("b", "d", 2), ("c", "d", 2), ("a", "d", 3)],
}


def random_graphs(count=4, seed=7):
    rng = random.Random(seed)
    for i in range(count):
        names = [f"n{j:02d}" for j in range(rng.randint(6, 14))]
        arcs = {(rng.choice(names), rng.choice(names)): rng.randint(1, 4) for _ in range(rng.randint(8, 34))}
        yield f"random{i}", [(a, b, w) for (a, b), w in sorted(arcs.items())]


GRAPHS = {**HAND, **dict(random_graphs())}


def rows():
    return [(name, DAY, a, b, w, round(0.1 * w * (1 + len(a)), 3), 0.1) for name, arcs in GRAPHS.items() for a, b, w in arcs]


def nodes_of(arcs):
    return sorted({x for a, b, _ in arcs for x in (a, b)})


def shortest(arcs, weighted):
    """All pairs, Floyd and Warshall."""
    nodes, far = nodes_of(arcs), float("inf")
    d = {(a, b): 0 if a == b else far for a in nodes for b in nodes}
    for a, b, w in arcs:
        if a != b:
            d[a, b] = min(d[a, b], w if weighted else 1)
    for k, a, b in itertools.product(nodes, repeat=3):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return {p: v for p, v in d.items() if v < far}


def components(arcs, strong):
    d = shortest(arcs if strong else arcs + [(b, a, w) for a, b, w in arcs], False)
    return {a: min(b for b in nodes_of(arcs) if (a, b) in d and (b, a) in d) for a in nodes_of(arcs)}


def neighbours(arcs):
    n = {x: set() for x in nodes_of(arcs)}
    for a, b, _ in arcs:
        if a != b:
            n[a].add(b)
            n[b].add(a)
    return n


def triangles(arcs):
    n = neighbours(arcs)
    return {v: sum(b in n[a] for a, b in itertools.combinations(sorted(n[v]), 2)) for v in n}


def clustering(arcs):
    n, t = neighbours(arcs), triangles(arcs)
    return {v: 2 * t[v] / (len(n[v]) * (len(n[v]) - 1)) if len(n[v]) > 1 else 0.0 for v in n}


def directed_clustering(arcs):
    have = {(a, b) for a, b, _ in arcs if a != b}
    s = lambda a, b: ((a, b) in have) + ((b, a) in have)
    out = {}
    for v in nodes_of(arcs):
        others = [x for x in nodes_of(arcs) if x != v]
        t = sum(s(v, j) * s(j, k) * s(v, k) for j, k in itertools.permutations(others, 2))
        total = sum(s(v, x) for x in others)
        both = sum(s(v, x) == 2 for x in others)
        out[v] = t / (2 * (total * (total - 1) - 2 * both)) if t else 0.0
    return out


def transitivity(arcs):
    have = {(a, b) for a, b, _ in arcs if a != b}
    out = {v: [b for a, b in have if a == v] for v in nodes_of(arcs)}
    closed = sum((w, x) in have for v in out for w, x in itertools.permutations(out[v], 2))
    return closed / sum(len(x) * (len(x) - 1) for x in out.values()) if closed else 0.0


def cores(arcs):
    n, core, k = neighbours(arcs), {}, 0
    while n:
        low = [v for v in n if len(n[v]) <= k]
        if not low:
            k += 1
        for v in low:
            core[v] = k
            for x in n.pop(v):
                if x in n:
                    n[x].discard(v)
    return core


def rich_club(arcs):
    n = neighbours(arcs)
    values = []
    for d in range(max(map(len, n.values()), default=0)):
        rich = [v for v in n if len(n[v]) > d]
        if len(rich) > 1:
            values.append(sum(b in n[a] for a, b in itertools.combinations(rich, 2)) * 2 / (len(rich) * (len(rich) - 1)))
    return sum(values) / len(values) if values else None


def pagerank(arcs, rounds=200):
    nodes = nodes_of(arcs)
    out = {v: sum(w for a, _, w in arcs if a == v) for v in nodes}
    x = {v: 1 / len(nodes) for v in nodes}
    for _ in range(rounds):
        loose = sum(x[v] for v in nodes if not out[v])
        x = {v: 0.85 * (sum(x[a] * w / out[a] for a, b, w in arcs if b == v) + loose / len(nodes)) + 0.15 / len(nodes) for v in nodes}
    return x


def path_counts(arcs, d, weighted):
    """Number of shortest paths for every pair, by falling back along tight arcs."""
    counts = {}
    for s in nodes_of(arcs):
        for t in sorted((t for a, t in d if a == s), key=lambda t: d[s, t]):
            counts[s, t] = 1 if s == t else sum(counts[s, a] for a, b, w in arcs if b == t and a != b and (s, a) in d
                                                and abs(d[s, a] + (w if weighted else 1) - d[s, t]) < 1e-9)
    return counts


def betweenness(arcs, weighted):
    """Exact, since the graphs have fewer nodes than the smallest sample."""
    nodes, d = nodes_of(arcs), shortest(arcs, weighted)
    c, n = path_counts(arcs, d, weighted), len(nodes_of(arcs))
    out = {}
    for v in nodes:
        total = sum(c[s, v] * c[v, t] / c[s, t] for s, t in d if v not in (s, t) and s != t and (s, v) in d and (v, t) in d
                    and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-9)
        out[v] = total / ((n - 1) * (n - 2)) if n > 2 else total
    return out


def closeness(arcs, weighted):
    nodes, d = nodes_of(arcs), shortest(arcs, weighted)
    out = {}
    for v in nodes:
        far = [x for (a, b), x in d.items() if b == v]
        out[v] = (len(far) - 1) / sum(far) * (len(far) - 1) / (len(nodes) - 1) if sum(far) and len(nodes) > 1 else 0.0
    return out


def sparse_graphs(count=12, seed=3):
    """Trees with few further links, rings on a stem, and loose parts."""
    rng = random.Random(seed)
    for i in range(count):
        size = rng.randint(5, 40)
        tree = [(f"v{j:02d}", f"v{rng.randrange(max(0, j - 1 - i), j):02d}", 1) for j in range(1, size) if rng.random() > 0.05]
        more = [(f"v{rng.randrange(size):02d}", f"v{rng.randrange(size):02d}", 1) for _ in range(rng.randint(0, size // 4))]
        names = [f"v{j:02d}" for j in range(size)]
        shuffled = dict(zip(names, rng.sample(names, size)))
        yield [(shuffled[a], shuffled[b], w) for a, b, w in dict.fromkeys(tree + more)] or [("a", "a", 1)]


def removal(arcs):
    drops = removal_drops(arcs).values()
    return sum(drops) / len(drops), max(drops)


def removal_drops(arcs):
    largest = lambda labels: max((list(labels.values()).count(x) for x in labels.values()), default=0)
    n, whole = neighbours(arcs), largest(components(arcs, False))
    drops = {}
    for gone in n:
        left, size = set(n) - {gone}, 0
        while left:
            todo, part = [left.pop()], 1
            while todo:
                near = n[todo.pop()] & left
                left -= near
                part += len(near)
                todo += near
            size = max(size, part)
        drops[gone] = (whole - size) / whole
    return drops


def modularity(arcs, part):
    pairs = {}
    for a, b, w in arcs:
        if a != b:
            key = (min(a, b), max(a, b))
            pairs[key] = max(pairs.get(key, 0), w)
    m = sum(pairs.values())
    if not m:
        return None
    degree = {v: sum(w for p, w in pairs.items() if v in p) for v in nodes_of(arcs)}
    inside = sum(w for (a, b), w in pairs.items() if part[a] == part[b])
    return inside / m - sum((sum(degree[v] for v in degree if part[v] == c) / (2 * m)) ** 2 for c in set(part.values()))
