"""Sequential versions of what the library does by tables, to hold it against."""

from __future__ import annotations

import math


def tree_of(ids, vectors, min_samples):
    """The least spanning tree of mutual reachability by (w, a, b), over exact whole numbers: each edge in order that joins two parts."""
    d = [[sum((x - y) ** 2 for x, y in zip(u, v, strict=True)) for v in vectors] for u in vectors]
    core = [sorted(row[:k] + row[k + 1 :])[: min_samples][-1] if len(row) > 1 else 0 for k, row in enumerate(d)]
    edges = sorted((max(d[i][j], core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for w, a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((w, a, b))
    return out


def labels_of(ids, tree, min_size):
    """The clusters of most excess of mass, from the whole dendrogram, merged edge by edge."""
    node = {i: (1, None, None, None) for i in ids}  # size, edge, left, right
    top, root = {i: i for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, (w, a, b) in enumerate(tree):
        x, y = find(a), find(b)
        node["n", k] = (node[top[x]][0] + node[top[y]][0], w, top[x], top[y])
        root[x] = y
        top[y] = ("n", k)
    lam = lambda w: 1 / math.sqrt(max(w, 1))
    clusters, of = [], {}  # a cluster: parent, birth, stability; of: the cluster in which a point is last

    def members(n):
        stack, out = [n], []
        while stack:
            x = stack.pop()
            if node[x][1] is None:
                out.append(x)
            else:
                stack += node[x][2:]
        return out

    if len(ids) < min_size or not tree:
        return dict.fromkeys(ids, -1)
    stack = [(("n", len(tree) - 1), None, 0.0)]
    while stack:
        n, parent, birth = stack.pop()
        me, mass = len(clusters), 0.0
        clusters.append([parent, birth, 0.0])
        while True:
            size, w, left, right = node[n]
            big = [x for x in (left, right) if node[x][0] >= min_size]
            out = [x for x in (left, right) if node[x][0] < min_size]
            for x in out:
                mass += node[x][0] * (lam(w) - birth)
                of.update(dict.fromkeys(members(x), me))
            if len(big) == 1:
                n = big[0]
                continue
            if len(big) == 2:
                mass += size * (lam(w) - birth)
                stack += [(x, me, lam(w)) for x in big]
            break
        clusters[me][2] = mass
    beneath = [[c for c, x in enumerate(clusters) if x[0] == k] for k in range(len(clusters))]
    worth, chosen = [x[2] for x in clusters], set()
    for c in sorted(range(len(clusters)), key=lambda c: -c):  # parents come before their children
        under = sum(worth[x] for x in beneath[c])
        if beneath[c] and (under > worth[c] or c == 0):
            worth[c] = under
        elif c:
            chosen.add(c)

    def up(c):
        found = None
        while c is not None:
            found = c if c in chosen else found
            c = clusters[c][0]
        return found

    where = {i: up(of[i]) for i in ids}
    groups = {}
    for i in sorted(ids):
        groups.setdefault(where[i], []).append(i)
    groups.pop(None, None)
    number = {c: k for k, (c, x) in enumerate(sorted(groups.items(), key=lambda g: (-len(g[1]), g[1][0])))}
    return {i: number.get(where[i], -1) for i in ids}
