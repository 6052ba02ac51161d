"""Small labelled graphs in plain Python: hashes, components, isomorphism, fragments.

A graph is a list of labels and a list of edges (u, v).  Molecules hold tens of
atoms, so these run inside one row of an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

Edge = tuple[int, int]


def neighbours(n: int, edges: list[Edge]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for u, v in edges:
        out[u].append(v)
        out[v].append(u)
    return out


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def wl_hash(labels: list[str], edges: list[Edge], rounds: int = 3) -> str:
    """Equal for isomorphic graphs: label refinement, and the counts of labels of every round."""
    near, now, seen = neighbours(len(labels), edges), list(labels), []
    for _ in range(rounds):
        now = [_digest(now[i] + "|" + ",".join(sorted(now[j] for j in near[i]))) for i in range(len(now))]
        seen += sorted(Counter(now).items())
    return _digest(repr(seen))


def components(nodes: list[int], edges: list[Edge]) -> list[list[int]]:
    up = {x: x for x in nodes}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for x in nodes:
        out.setdefault(root(x), []).append(x)
    return [out[k] for k in sorted(out)]


def part_hash(labels: dict[int, str], nodes: list[int], edges: list[Edge]) -> str:
    """The hash of the part of a graph on some of its nodes."""
    at = {x: i for i, x in enumerate(nodes)}
    return wl_hash([labels[x] for x in nodes], [(at[u], at[v]) for u, v in edges if u in at and v in at])


def star_counts(labels: dict[int, str], edges: list[Edge]) -> dict[str, int]:
    """How often each neighbourhood occurs: an atom, its neighbours, and bonds among these."""
    near: dict[int, list[int]] = {x: [] for x in labels}
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    return dict(Counter(part_hash(labels, sorted({x, *near[x]}), edges) for x in labels))


def bond_counts(labels: dict[int, str], edges: list[Edge]) -> dict[str, int]:
    return dict(Counter("-".join(sorted((labels[u], labels[v]))) for u, v in edges))


def fragments(labels: dict[int, str], edges: list[Edge]) -> list[dict]:
    """The whole graph, and what each single bond's removal leaves."""

    def record(rest: list[Edge], broken: list[Edge]) -> dict:
        parts = components(sorted(labels), rest)
        return {
            "n_frag": len(parts), "n_broken": len(broken), "bonds_broken": [{"u": u, "v": v} for u, v in broken],
            "hashes": [part_hash(labels, p, rest) for p in parts],
        }

    if not labels:
        return []
    return [record(edges, []), *(record([e for e in edges if e != b], [b]) for b in edges)]


def ring_fragments(labels: dict[int, str], edges: list[Edge]) -> list[dict]:
    """Pairs of ring bonds one ring bond apart whose removal cuts the graph in pieces."""
    nodes = sorted(labels)
    whole = len(components(nodes, edges))
    ring = [e for e in edges if len(components(nodes, [x for x in edges if x != e])) == whole]
    held, out = {frozenset(e) for e in ring}, []
    for a, b in combinations(ring, 2):
        if set(a) & set(b) or not any(frozenset((x, y)) in held for x in a for y in b):
            continue
        rest = [e for e in edges if e not in (a, b)]
        parts = components(nodes, rest)
        if len(parts) > whole:
            out.append({
                "n_frag": len(parts), "n_broken": 2, "bonds_broken": [{"u": u, "v": v} for u, v in (a, b)],
                "hashes": [part_hash(labels, p, rest) for p in parts],
            })
    return out


def isomorphic(a_labels: list[str], a_edges: list[Edge], b_labels: list[str], b_edges: list[Edge]) -> bool:
    """Exact test: candidates by refined labels, then search in order of scarcity."""
    if Counter(a_labels) != Counter(b_labels) or len(a_edges) != len(b_edges):
        return False
    n = len(a_labels)
    na, nb = neighbours(n, a_edges), neighbours(n, b_edges)
    colour = lambda labels, near: [(labels[i], tuple(sorted(labels[j] for j in near[i]))) for i in range(n)]
    ca, cb = colour(a_labels, na), colour(b_labels, nb)
    if Counter(ca) != Counter(cb):
        return False
    ea, eb = Counter(map(frozenset, a_edges)), Counter(map(frozenset, b_edges))
    scarce = Counter(ca)
    order, used = sorted(range(n), key=lambda i: (scarce[ca[i]], -len(na[i]))), [False] * n
    match: dict[int, int] = {}

    def place(k: int) -> bool:
        if k == n:
            return True
        i = order[k]
        for j in range(n):
            if used[j] or ca[i] != cb[j] or any(ea[frozenset((i, x))] != eb[frozenset((j, y))] for x, y in match.items()):
                continue
            used[j], match[i] = True, j
            if place(k + 1):
                return True
            used[j] = False
            del match[i]
        return False

    return place(0)
