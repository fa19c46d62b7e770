"""Two-label energies as minimum cuts.

``labels(scores, edges)`` minimises the sum of |score| over nodes labelled against the sign of their
score plus the capacity of every edge whose ends differ.  The scores are the capacities from the source
(positive) and to the sink (negative), the edges are the capacities between nodes.
"""

from __future__ import annotations

from collections import deque

EPS = 1e-9


def labels(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (ties: the smaller source side)."""
    near = [[] for _ in scores]
    for a, b, cap in edges:
        if a != b and cap > 0:
            near[a].append((b, cap))
            near[b].append((a, cap))
    side, left = settle(list(scores), near)
    todo = [i for i, s in enumerate(side) if s is None]
    if todo:
        number = {n: i for i, n in enumerate(todo)}
        rest = [(number[a], number[b], cap) for a, b, cap in edges
                if a != b and a in number and b in number and cap > 0]
        for n, s in zip(todo, max_flow([left[n] for n in todo], rest)):
            side[n] = s
    return side


def settle(scores: list[float], near: list[list[tuple[int, float]]]):
    """Labels that every minimum cut has: a node whose score outweighs all its undecided edges follows
    its sign, and its edges then pull its neighbours.  Returns the labels (None: open) and the scores
    left to the open nodes."""
    side = [None] * len(scores)
    room = [sum(c for _, c in n) for n in near]
    queue = deque(range(len(scores)))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(scores[i]) <= room[i] + EPS and near[i] and room[i] > EPS:
            continue
        side[i] = scores[i] > EPS
        for j, cap in near[i]:
            if side[j] is None:
                scores[j] += cap if side[i] else -cap
                room[j] -= cap
                queue.append(j)
    return side, scores


def max_flow(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's blocking flows from the source through the edges to the sink; the source side of the cut
    is what the source still reaches."""
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(a, b, forth, back):
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            add(source, i, s, 0.0)
        elif s < 0:
            add(i, sink, -s, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] > EPS and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(cap[e] for e in path)
                first = len(path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cap[e] <= EPS and k < first:
                        first = k
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while place[v] < len(head[v]):
                e = head[v][place[v]]
                if cap[e] > EPS and level[to[e]] == level[v] + 1:
                    break
                place[v] += 1
            if place[v] < len(head[v]):
                path.append(head[v][place[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]
