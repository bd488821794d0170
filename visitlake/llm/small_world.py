"""A hierarchical navigable small-world graph over one shard of vectors; searches run for many queries at once."""
from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: neighbours a node chooses and as many that chose it; candidates among which it chooses
DEGREE, BUILD_BEAM = 12, 48
#: nodes inserted, and queries of a narrow beam searched, together
BLOCK = 512
#: pairs that a task holds at a time, queries of its first slice, and audited queries compared with a whole shard at once
PAIRS, FIRST_SLICE, AUDITED = 500_000, 64, 32
#: numbers of vectors that are copied at a time
VALUES = 4_000_000
#: bytes of a node's links in one layer
LINK_BYTES = 4 * (2 * DEGREE + 2)
#: each layer has about one node of so many of the layer below
SHRINK = 24
#: single precision finds candidates a little below the threshold, double precision decides
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled by a power of two first, which is exact, so squares neither overflow nor vanish
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the rows i of a and j of b; the rows are copied a part at a time."""
    out, step = np.empty(len(i), a.dtype), max(1, VALUES // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        out[at:at + step] = np.einsum("kd,kd->k", a[i[at:at + step]], b[j[at:at + step]])
    return out


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nodes of the graph found nearest to each query, with cosines, best first; -1 and -2 where fewer were met."""
    b = len(queries)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -2.0, np.float32)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, len(x)), bool)
    start = np.sort(entry[:, :beam], axis=1)
    start[:, 1:][start[:, 1:] == start[:, :-1]] = -1  # a node given twice counts once
    k = start.shape[1]
    ids[:, :k] = start
    sims[:, :k] = np.where(start >= 0, np.einsum("bkd,bd->bk", x[start], queries), -2)
    done[:, :k] = start < 0
    r, c = np.nonzero(start >= 0)
    seen[r, start[r, c]] = True
    first = np.argsort(-sims[:, :k], axis=1, kind="stable")
    for a in (ids, sims, done):
        a[:, :k] = np.take_along_axis(a[:, :k], first, 1)
    active = np.arange(b)
    while len(active):
        # the best entries that have not been expanded; entries are kept in order
        waiting = ~done[active]
        order = np.argsort(~waiting, axis=1, kind="stable")[:, :max(4, beam // 8)]
        chosen = np.take_along_axis(waiting, order, 1)
        live = chosen.any(axis=1)
        active, order, chosen = active[live], order[live], chosen[live]
        if not len(active):
            break
        done[active[:, None], order] = True
        heads = np.where(chosen, ids[active[:, None], order], -1)
        near = np.where((heads >= 0)[:, :, None], links[heads], -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        # a node reached from two heads counts once
        near_sorted = np.sort(np.where(fresh, near, -1), axis=1)
        fresh = near_sorted >= 0
        fresh[:, 1:] &= near_sorted[:, 1:] != near_sorted[:, :-1]
        near = np.where(fresh, near_sorted, 0)
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        got = np.full(near.shape, -2.0, np.float32)
        got[r, c] = _dots(x, near[r, c], queries, active[r])
        all_sims = np.concatenate([sims[active], got], axis=1)
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[active], ids[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_sims, all_ids, all_done))
    return ids, sims


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` neighbours of each node: candidates, best first, that are nearer to it than to any chosen before."""
    vectors = x[np.maximum(ids, 0)]
    between = np.einsum("bcd,bed->bce", vectors, vectors)
    kept = np.zeros(ids.shape, bool)
    closest = np.full(ids.shape, -2.0, np.float32)  # to the chosen
    for c in range(ids.shape[1]):
        take = (ids[:, c] >= 0) & (sims[:, c] > closest[:, c]) & (kept.sum(axis=1) < degree)
        kept[:, c] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, c]), closest)
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    out = np.full((len(ids), degree), -1, np.int64)
    out[:, :order.shape[1]] = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(ids, order, 1), -1)
    return out


def layer(x: np.ndarray) -> np.ndarray:
    """Links of one layer, its nodes inserted in order in growing blocks: chosen, chosen by, and the two next in line.

    The line goes through all nodes, so a beam as wide as the layer reaches everything. It follows the tree in which each node hangs
    on the nearest one before it, so it also runs through a tight cluster, whose nodes choose few of their like.
    """
    n = len(x)
    line = np.stack([np.arange(n) - 1, np.where(np.arange(n) + 1 < n, np.arange(n) + 1, -1)], axis=1)
    links = np.full((n, 2 * DEGREE + 2), -1, np.int64)
    links[:, :2] = line
    back = np.full((n, DEGREE), -2.0, np.float32)  # cosine of those that chose a node
    parent = np.full(n, -1)
    done = 0
    while done < n:
        size = min(BLOCK, max(16, done), n - done)
        new = np.arange(done, done + size)
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -2)
        k = min(BUILD_BEAM, size)
        mates = np.argsort(-own, axis=1)[:, :k]
        ids, sims = new[mates], np.take_along_axis(own, mates, 1)
        if done:
            line_before = links[:done, :2].copy()
            entry = np.tile(np.linspace(0, done - 1, min(4, done)).astype(np.int64), (size, 1))
            view = links[:done].copy()
            view[view >= done] = -1
            view[:, :2] = np.where(line_before >= done, -1, line_before)
            old, old_sims = beam_search(x[:done], view, x[new], entry, BUILD_BEAM)
            ids, sims = np.concatenate([ids, old], axis=1), np.concatenate([sims, old_sims], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        ids = np.where(sims > -2, ids, -1)
        links[new, 2:2 + DEGREE] = choice = choose(x, ids, sims, DEGREE)
        # the nearest of those before it: old ones, or earlier ones of the same block
        before = np.where((ids >= 0) & (ids < new[:, None]), sims, -3)
        parent[new] = np.where(before.max(axis=1) > -3, np.take_along_axis(ids, before.argmax(axis=1)[:, None], 1)[:, 0], new - 1)
        u, c = np.nonzero(choice >= 0)
        v, u = choice[u, c], new[u]
        met = np.unique(v)
        old_u = links[met, 2 + DEGREE:]
        ov, oc = np.nonzero(old_u >= 0)
        all_v = np.concatenate([v, met[ov]])
        all_u = np.concatenate([u, old_u[ov, oc]])
        all_s = np.concatenate([np.einsum("kd,kd->k", x[u], x[v]), back[met[ov], oc]])
        order = np.lexsort((-all_s, all_v))
        all_v, all_u, all_s = all_v[order], all_u[order], all_s[order]
        place = np.arange(len(all_v)) - np.searchsorted(all_v, all_v)
        stay = place < DEGREE
        links[met, 2 + DEGREE:] = -1
        back[met] = -2
        links[all_v[stay], 2 + DEGREE + place[stay]] = all_u[stay]
        back[all_v[stay], place[stay]] = all_s[stay]
        done += size
    order = walk(parent)
    links[:, :2] = -1
    links[order[1:], 0], links[order[:-1], 1] = order[:-1], order[1:]
    return links


def walk(parent: np.ndarray) -> np.ndarray:
    """The nodes of a tree, each before what hangs on it and that before its own siblings; `parent` is smaller than the node."""
    children: list[list[int]] = [[] for _ in parent]
    for node in range(len(parent) - 1, 0, -1):
        children[parent[node]].append(node)
    out, stack = [], [0]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += children[node]
    return np.array(out, np.int64)


@dataclass
class Graph:
    """A shard: ids, vectors, and its layers from the bottom; a layer is the first nodes in order, so it needs no names."""
    ids: np.ndarray
    vectors: np.ndarray
    layers: list[np.ndarray]

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        """Nodes in a seeded random order of their ids; the upper layers are ever shorter beginnings of it."""
        order = np.random.default_rng(len(ids)).permutation(len(ids))
        ids, vectors = ids[order], vectors[order]
        x = unit(vectors).astype(np.float32)
        sizes = [len(ids)]
        while sizes[-1] > 4 * SHRINK:
            sizes.append(sizes[-1] // SHRINK)
        return cls(ids, vectors, [layer(x[:n]) for n in sizes])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, **{f"layer{k}": v.astype(np.int32) for k, v in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as parts:
            return cls(parts["ids"], parts["vectors"], [parts[f"layer{k}"].astype(np.int64) for k in range(len(parts.files) - 2)])

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Ids, vectors and links of the nodes in order, some at a time: what `of_rows` makes the graph of again."""
        packed = [v.astype("<i4") for v in self.layers]
        for at in range(0, len(self.ids), 1_000):
            end = min(at + 1_000, len(self.ids))
            yield self.ids[at:end], self.vectors[at:end], [b"".join(v[k].tobytes() for v in packed if k < len(v)) for k in range(at, end)]

    @classmethod
    def of_rows(cls, ids: np.ndarray, vectors: np.ndarray, links: list[bytes]) -> Graph:
        """A layer is the first nodes in order, so a node's layers are counted by the length of its links."""
        height = np.array([len(x) // LINK_BYTES for x in links])
        sizes = [int((height > k).sum()) for k in range(height.max(initial=0))]
        parts = [b"".join(x[k * LINK_BYTES:(k + 1) * LINK_BYTES] for x in links[:n]) for k, n in enumerate(sizes)]
        return cls(ids, vectors, [np.frombuffer(x, "<i4").reshape(n, -1) for x, n in zip(parts, sizes)])

    def __post_init__(self):
        # in double precision vectors are scaled when they are asked for
        self.x = np.empty(self.vectors.shape, np.float32)
        for at, part in self._scaled():
            self.x[at:at + len(part)] = part

    def _scaled(self) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, VALUES // max(1, self.vectors.shape[-1]))
        for at in range(0, len(self.vectors), step):
            yield at, unit(self.vectors[at:at + step])

    def _beam(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int64)
        for links in self.layers[:0:-1]:
            entry, _ = beam_search(self.x[:len(links)], links, queries, entry, 4)
            entry = np.where(entry < 0, 0, entry)
        return beam_search(self.x, self.layers[0], queries, entry, beam)

    def within(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, node) of cosine at least `threshold`; a query whose whole beam is that near is asked again with a wider one."""
        found_q, found_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        q64 = unit(queries)
        todo, width = np.arange(len(queries)), min(beam, len(self.ids))
        while len(todo):
            again, block = [], max(8, BLOCK * 64 // max(64, width))  # fewer together the wider the beam
            for at in range(0, len(todo), block):
                rows = todo[at:at + block]
                ids, sims = self._beam(q64[rows].astype(np.float32), width)
                full = (sims[:, -1] >= threshold - SLACK) & (width < len(self.ids))
                r, c = np.nonzero((sims >= threshold - SLACK) & ~full[:, None])
                r, n = rows[r], ids[r, c]
                exact = self._cosines(q64, r, n) >= threshold
                found_q.append(r[exact])
                found_n.append(n[exact])
                again.append(rows[full])
            todo, width = np.concatenate(again), min(4 * width, len(self.ids))
        return np.concatenate(found_q), np.concatenate(found_n)

    def _cosines(self, q64: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(rows)), max(1, VALUES // max(1, q64.shape[1]))
        for at in range(0, len(rows), step):
            out[at:at + step] = np.einsum("kd,kd->k", q64[rows[at:at + step]], unit(self.vectors[nodes[at:at + step]]))
        return out

    def audit(self, queries: np.ndarray, threshold: float, beam: int, recall: float, every: int) -> int:
        """The beam, doubled until the pairs found for every `every`-th query are at least `recall` of all, by brute force."""
        sample = np.arange(0, len(queries), every)
        asked = unit(queries[sample])
        truth = sum(np.count_nonzero(asked[at:at + AUDITED] @ part.T >= threshold) for _, part in self._scaled() for at in range(0, len(sample), AUDITED))
        while beam < len(self.ids) and sum(len(got) for got, _ in self.slices(queries[sample], threshold, beam)) < recall * truth:
            beam *= 2
        return beam

    def slices(self, queries: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`within`, slice by slice of the queries; a slice is as long as its pairs are expected to keep to `PAIRS`."""
        at, size = 0, FIRST_SLICE
        while at < len(queries):
            q, n = self.within(queries[at:at + size], threshold, beam)
            yield q + at, n
            at += size
            size = int(max(FIRST_SLICE // 4, min(4 * size, PAIRS * size // max(1, len(q)))))
