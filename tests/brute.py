"""Plain-Python answers the operators are compared with."""

import heapq
import math
from collections import defaultdict


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def kruskal(nodes, base, cands):
    comp = components(nodes, base)
    taken = []
    for score, i, j in sorted(cands, key=lambda t: (-t[0], t[1], t[2])):
        if comp[i] != comp[j]:
            old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
            comp = {n: (new if c == old else c) for n, c in comp.items()}
            taken.append((i, j))
    return set(taken)


def cores(nodes, edges):
    adj = defaultdict(set)
    for u, v in edges:
        if u != v:
            adj[u].add(v)
            adj[v].add(u)
    left = {n: len(adj[n]) for n in nodes}
    out, k = {}, 0
    while left:
        n = min(left, key=left.get)
        k = max(k, left[n])
        out[n] = k
        del left[n]
        for m in adj[n]:
            if m in left:
                left[m] -= 1
    return out


def dijkstra(edges, src, closed=lambda u, v: False):
    adj = defaultdict(list)
    for u, v, w in edges:
        if not closed(u, v):
            adj[u].append((v, w))
            adj[v].append((u, w))
    dist, heap = {src: 0.0}, [(0.0, src)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in adj[u]:
            if d + w < dist.get(v, math.inf):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def segment_distance(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / n))
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def betweenness(nodes, edges):
    """Exact, by counting shortest paths between all pairs (integer weights)."""
    adj = defaultdict(dict)
    for u, v, w in edges:
        for a, b in ((u, v), (v, u)):
            adj[a][b] = min(w, adj[a].get(b, math.inf))
    flat = [(u, v, w) for u in adj for v, w in adj[u].items() if u < v]
    score = {n: 0.0 for n in nodes}
    for s in nodes:
        dist = dijkstra(flat, s)
        order = sorted(dist, key=dist.get)
        sigma = {n: 0.0 for n in dist}
        sigma[s] = 1.0
        for v in order:
            for u, w in adj[v].items():
                if dist.get(u, math.inf) + w == dist[v]:
                    sigma[v] += sigma[u]
        delta = {n: 0.0 for n in dist}
        for v in reversed(order):
            for u, w in adj[v].items():
                if dist.get(u, math.inf) + w == dist[v]:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                score[v] += delta[v]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}
