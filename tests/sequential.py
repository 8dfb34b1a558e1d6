"""Definitions of the graph operators, spelled out for comparison on small data."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def similarities(vectors, digits=6):
    matrix = np.asarray(vectors, dtype=float)
    size = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(size == 0, 1, size)[:, None]
    return np.round(unit @ unit.T, digits)


def graph(sim, theta, labels=None):
    """{node: {neighbour: similarity}}, and the nodes in the order of the cover.

    The edges are the pairs of equal label at or above theta.  A node is ordered by its
    least neighbour below it if it has one (nearest to that neighbour first), and by
    itself, before all others of that rank, if not.
    """
    nodes = range(len(sim))
    same = [(i, j) for i, j in combinations(nodes, 2) if labels is None or labels[i] == labels[j]]
    edges = {(i, j): float(sim[i][j]) for i, j in same if sim[i][j] >= theta}
    links = {i: {} for i in nodes}
    for (i, j), value in edges.items():
        links[i][j] = links[j][i] = value

    def place(node):
        first = min(links[node], default=node)
        return (first, 1, -links[node][first], node) if first < node else (node, 0, 0.0, node)

    return links, sorted(nodes, key=place)


def cap(links, limit):
    """What is left when, by id, every node keeps its ``limit`` best edges that are left.

    Edge by edge: an edge goes if, at the turn of one of its ends, ``limit`` better edges
    of that end are still there.
    """
    gone = set()
    for node in sorted(links):
        there = [j for j in links[node] if frozenset((node, j)) not in gone]
        for j in there:
            better = sum((-links[node][i], i) < (-links[node][j], j) for i in there)
            if better >= limit:
                gone.add(frozenset((node, j)))
    return {i: {j: s for j, s in near.items() if frozenset((i, j)) not in gone} for i, near in links.items()}


def cover(links, order, k):
    """[(node, gain)] in pick order."""
    reach = {v: {v} | set(links[v]) for v in order}
    covered, picks = set(), []
    while len(picks) < k and len(covered) < len(order):
        best = min((v for v in order if v not in covered),
                   key=lambda v: (-len(reach[v] - covered), order.index(v)))
        picks.append((best, len(reach[best] - covered)))
        covered |= reach[best]
    return picks


def search(sim, k, coverage, limit, labels=None, lower=0, slack=None):
    """Probes [(theta, coverage)] and the last picks: a walk down the tree of midpoints."""
    tolerance = 50 / len(sim) if slack is None else slack

    def walk(left, right):
        middle = (left + right) / 2
        links, order = graph(sim, middle / 1000, labels)
        picks = cover(cap(links, limit), order, k)
        share = sum(gain for _, gain in picks) / len(sim)
        enough = share >= coverage
        early = enough and coverage == 1.0 and len(picks) < k
        near = abs((0.0 if early else share) - coverage) <= tolerance
        half = (middle, right) if enough else (left, middle)
        if near or half[1] - half[0] <= 1:
            return [(middle / 1000, share)], picks
        probes, last = walk(*half)
        return [(middle / 1000, share), *probes], last

    return walk(lower, 1000)
