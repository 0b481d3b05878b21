"""Hierarchical navigable small-world graph over unit vectors, searched for many queries in step.

Layer t holds the nodes whose random level is at least t; layers are built from the top, each entered through the one
above.  All steps of a beam search run as array operations over a block of queries."""

from __future__ import annotations

import io

import numpy as np

LINKS, BASE_LINKS, BUILD_BEAM, BLOCK = 16, 32, 64, 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms, scaled by their largest component first so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes found for each query (-1 where fewer) and their cosines, not in order.

    ``links`` has a row of neighbours for each node (-1: none), ``entry`` the first nodes of each query."""
    n_queries, fan = len(queries), links.shape[1]
    ids = np.full((n_queries, width + fan), -1, np.int32)
    sims = np.full((n_queries, width + fan), -np.inf, np.float32)
    todo = np.zeros((n_queries, width + fan), bool)
    seen = np.zeros((n_queries, len(x)), bool)
    every = np.arange(n_queries)
    first = entry[:, :width]
    ids[:, :first.shape[1]], todo[:, :first.shape[1]] = first, True
    sims[:, :first.shape[1]] = np.einsum("qkd,qd->qk", x[first], queries)
    seen[every[:, None], first] = True
    live = every
    while len(live):
        ahead = np.where(todo[live], sims[live], -np.inf)
        pick = ahead.argmax(1)
        going = ahead[np.arange(len(live)), pick] > -np.inf
        live, pick = live[going], pick[going]
        if not len(live):
            break
        todo[live, pick] = False
        near = links[ids[live, pick]]
        new = near >= 0
        near = np.where(new, near, 0)
        new &= ~seen[live[:, None], near]
        rows, columns = np.nonzero(new)
        seen[live[rows], near[rows, columns]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[rows, columns] = np.einsum("kd,kd->k", x[near[rows, columns]], queries[live[rows]])
        own_sims = np.concatenate([sims[live, :width], found], 1)
        best = np.argpartition(-own_sims, width - 1, 1)[:, :width]
        at = np.arange(len(live))[:, None]
        own_ids = np.concatenate([ids[live, :width], np.where(new, near, -1)], 1)[at, best]
        own_todo = np.concatenate([todo[live, :width], new], 1)[at, best]
        ids[live, :width], sims[live, :width], todo[live, :width] = own_ids, own_sims[at, best], own_todo & (own_ids >= 0)
    return ids[:, :width], sims[:, :width]


def both_ways(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in either direction as (where each node's begin, their ends): a node that others dropped from their
    lists still links to them."""
    n, at = len(links), np.flatnonzero(links >= 0)
    a, b = at // links.shape[1], links.ravel()[at]
    pairs = np.empty(2 * len(at), np.int64)
    pairs[:len(at)], pairs[len(at):] = a * n + b, b.astype(np.int64) * n + a
    del a, b, at
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[:len(pairs)]]
    return np.searchsorted(pairs, np.arange(n + 1) * n), (pairs % n).astype(np.int32)


def reach(x: np.ndarray, edges: tuple[np.ndarray, np.ndarray], queries: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
    """Widen found sets to all nodes of at least the cosine that a path of such nodes joins to them.

    ``start`` and the result are queries by nodes, true where a node belongs to the query."""
    n, found, seen, front = len(x), start.copy(), start.copy(), start
    begin, ends = edges
    while front.any():
        rows, nodes = np.nonzero(front)
        front = np.zeros_like(start)
        for k in range(0, len(rows), 4096):
            own = nodes[k:k + 4096]
            sizes = begin[own + 1] - begin[own]
            shift = np.cumsum(sizes) - sizes
            near = ends[np.repeat(begin[own] - shift, sizes) + np.arange(sizes.sum())]
            keys = np.repeat(rows[k:k + 4096], sizes) * n + near
            keys = np.unique(keys[~seen.ravel()[keys]])
            r, c = keys // n, keys % n
            seen[r, c] = True
            good = np.einsum("kd,kd->k", x[c], queries[r]) >= least
            front[r[good], c[good]] = True
        found |= front
    return found


def diverse(x: np.ndarray, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours of each row of ``base`` from candidates: first those nearer to it than to any chosen
    one, which keeps groups of near copies tied to the rest, then the nearest others."""
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    twin = np.zeros(ids.shape, bool)
    twin[:, 1:] = ids[:, 1:] == ids[:, :-1]
    valid = (ids >= 0) & ~twin
    own = x[np.where(valid, ids, 0)]
    between = own @ own.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        closest = np.where(chosen, between[:, c], -np.inf).max(1)
        chosen[:, c] = valid[:, c] & (sims[:, c] > closest) & (chosen.sum(1) < most)
    rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), 1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1).astype(np.int32)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def _layer(x: np.ndarray, nodes: np.ndarray, upper: "Graph | None", most: int) -> np.ndarray:
    """Link rows of one layer over ``nodes`` (rows of x; those of the layer above come first)."""
    own = x[nodes]
    links = np.full((len(nodes), most), -1, np.int32)
    done = 0
    while done < len(nodes):
        more = np.arange(done, min(len(nodes), done + max(32, min(BLOCK, done))))
        sims = own[more] @ own[more].T
        np.fill_diagonal(sims, -np.inf)
        k = min(BUILD_BEAM, len(more))
        best = np.argpartition(-sims, k - 1, 1)[:, :k]
        cosines = np.take_along_axis(sims, best, 1)
        found = np.where(cosines > -np.inf, more[best], -1)
        if done:
            entry = upper.descend(own[more])[:, None] if upper is not None else np.zeros((len(more), 1), np.int64)
            ids, near = beam(own[:done], links[:done], own[more], np.where(entry < done, entry, 0), BUILD_BEAM)
            found, cosines = np.concatenate([found, ids], 1), np.concatenate([cosines, near], 1)
        links[more] = diverse(own, more, found, np.where(found >= 0, cosines, -np.inf), most)
        _link_back(own, links, more)
        done = more[-1] + 1
    return links


def _link_back(x: np.ndarray, links: np.ndarray, more: np.ndarray) -> None:
    """Make the links of new nodes go both ways; a row that overflows keeps its diverse neighbours."""
    source = np.repeat(more, links.shape[1])
    target = links[more].ravel()
    known = target >= 0
    source, target = source[known], target[known]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rows, first, sizes = np.unique(target, return_index=True, return_counts=True)
    for k in range(0, len(rows), BLOCK):
        some, begin, size = rows[k:k + BLOCK], first[k:k + BLOCK], sizes[k:k + BLOCK]
        extra = np.full((len(some), size.max()), -1, np.int64)
        where = np.arange(size.max())[None, :] < size[:, None]
        extra[where] = source[(begin[:, None] + np.arange(size.max()))[where]]
        ids = np.concatenate([links[some], extra], 1)
        sims = np.einsum("qkd,qd->qk", x[np.where(ids >= 0, ids, 0)], x[some])
        links[some] = diverse(x, some, ids, np.where(ids >= 0, sims, -np.inf), links.shape[1])


class Graph:
    """Layers from the top; in each, nodes are numbered as in ``vectors``, whose first rows are the top's nodes."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    def descend(self, queries: np.ndarray) -> np.ndarray:
        """The nearest node that the layers of this graph lead each query to."""
        at = np.zeros((len(queries), 1), np.int64)
        for links in self.layers:
            ids, sims = beam(self.vectors[:len(links)], links, queries, at, 4)
            at = np.take_along_axis(ids, sims.argmax(1)[:, None], 1).astype(np.int64)
        return at[:, 0]

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        upper = Graph(self.vectors, self.layers[:-1])
        entry = upper.descend(queries)[:, None]
        base = self.layers[-1]
        return beam(self.vectors[:len(base)], base, queries, entry, min(width, len(base)))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> "Graph":
        parts = np.load(io.BytesIO(data))
        return Graph(parts["vectors"], [parts[f"layer{i}"] for i in range(len(parts.files) - 1)])


def levels(n: int, seed: int = 7) -> np.ndarray:
    """Random levels, geometric with ratio 1 / LINKS, sorted down; the same for every build."""
    chance = np.random.default_rng(seed).random(n)
    return np.sort(np.floor(-np.log(1 - chance) / np.log(LINKS)).astype(int))[::-1]


def build(vectors: np.ndarray) -> Graph:
    """Graph over unit vectors (float32); the caller's order decides the levels, so it should be arbitrary."""
    level, graph = levels(len(vectors)), None
    for t in range(level[0], -1, -1):
        size = int((level >= t).sum())
        links = _layer(vectors, np.arange(size), graph, BASE_LINKS if t == 0 else LINKS)
        graph = Graph(vectors, [*(graph.layers if graph else []), links])
    return graph
