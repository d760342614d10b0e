"""Hierarchical navigable small-world graph over the unit vectors of one shard, searched many queries at a time.

Nodes stand in a fixed random order and level l holds the first n / 16**l of them, so levels are nested and every
one is a table of neighbours.  A batch of nodes is linked by searching what stands so far from the level above and
choosing neighbours that are nearer to the node than to each other, before the nearest of the rest.
"""

from __future__ import annotations

import numpy as np

LEVEL = 16
BATCH = 256
#: Nodes of a beam whose neighbours are read in one step.
STRIDE = 4
#: Share of nearest neighbours that a search has to meet where an audit draws no pair.
NEIGHBOURS = 0.9


def choose(near: np.ndarray, among: np.ndarray, valid: np.ndarray, most: int) -> np.ndarray:
    """Columns of up to ``most`` neighbours per row.  ``near``: similarity to the node, falling; ``among``: to each other."""
    rows, width = near.shape
    kept = np.zeros((rows, width), dtype=bool)
    for c in range(width):
        kept[:, c] = valid[:, c] & ~(kept[:, :c] & (among[:, c, :c] > near[:, c:c + 1])).any(axis=1)
    place = np.arange(width)[None, :]
    rank = np.where(kept, place, np.where(valid, place + width, place + 2 * width))
    return np.argsort(rank, axis=1, kind="stable")[:, :most]


class Graph:
    def __init__(self, unit: np.ndarray, links: int = 24, beam: int = 48):
        self.unit, self.links, self.build_beam, self.beam = unit, links, beam, beam
        sizes = [len(unit)]
        while sizes[-1] > 4 * LEVEL:
            sizes.append(-(-sizes[-1] // LEVEL))
        self.levels: list[np.ndarray] = []
        for size in reversed(sizes):  # the smallest level first
            self.levels.append(self._build(size))

    def _similar(self, nodes: np.ndarray) -> np.ndarray:
        vectors = self.unit[nodes]
        return np.matmul(vectors, vectors.transpose(0, 2, 1))

    def _build(self, size: int) -> np.ndarray:
        table = np.full((size, self.links), -1, dtype=np.int32)
        done = 0
        while done < size:
            new = np.arange(done, min(size, done + min(BATCH, max(done, 2 * self.links))))
            vectors = self.unit[new]
            inside = vectors @ vectors.T
            np.fill_diagonal(inside, -2)
            take = min(len(new) - 1, self.links if not done else self.links // 2)
            mates = np.argsort(-inside, axis=1)[:, :take]
            nodes, near = new[mates], np.take_along_axis(inside, mates, axis=1)
            if done:
                found, seen = self.search(vectors, self.build_beam, table, entries=self._enter(vectors, done))[:2]
                nodes, near = np.concatenate((found, nodes), axis=1), np.concatenate((seen, near), axis=1)
            order = np.argsort(-near, axis=1, kind="stable")
            nodes, near = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(near, order, axis=1)
            valid = (nodes >= 0) & (near > -1.5)
            column = choose(near, self._similar(np.maximum(nodes, 0)), valid, self.links // 2)
            picked = np.where(np.take_along_axis(valid, column, axis=1), np.take_along_axis(nodes, column, axis=1), -1)
            table[new, :picked.shape[1]] = picked
            self._back(table, np.repeat(new, picked.shape[1]), picked.ravel())
            done = new[-1] + 1
        return table

    def _back(self, table: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Add the links target -> source, choosing anew where a row is full."""
        keep = target >= 0
        source, target = source[keep], target[keep]
        known = (table[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        added = np.full((len(nodes), count.max()), -1, dtype=np.int64)
        row = np.repeat(np.arange(len(nodes)), count)
        added[row, np.arange(len(target)) - np.repeat(first, count)] = source
        for begin in range(0, len(nodes), 512):
            part = slice(begin, begin + 512)
            all_of = np.concatenate((table[nodes[part]], added[part]), axis=1)
            near = np.einsum("rcd,rd->rc", self.unit[np.maximum(all_of, 0)], self.unit[nodes[part]])
            near[all_of < 0] = -2
            order = np.argsort(-near, axis=1, kind="stable")[:, :max(self.links, int((all_of >= 0).sum(axis=1).max()))]
            all_of, near = np.take_along_axis(all_of, order, axis=1), np.take_along_axis(near, order, axis=1)
            valid = all_of >= 0
            full = valid.sum(axis=1) > self.links
            kept = np.where(valid, all_of, -1)[:, :self.links]
            if full.any():
                column = choose(near[full], self._similar(np.maximum(all_of[full], 0)), valid[full], self.links)
                kept[full] = np.take_along_axis(all_of[full], column, axis=1)
            table[nodes[part]] = kept

    def _enter(self, queries: np.ndarray, limit: int | None = None) -> np.ndarray:
        """Entry nodes for the lowest level, or for one of which ``limit`` nodes stand so far."""
        entries = np.tile(np.arange(min(8, limit or 8, *map(len, self.levels or [self.unit])), dtype=np.int64), (len(queries), 1))
        for table in self.levels[:-1] if limit is None else self.levels:
            if limit is None or len(table) <= limit:
                entries = self.search(queries, 8, table, entries)[0][:, :4]
                entries = np.where(entries >= 0, entries, 0)
        return entries

    def search(self, queries: np.ndarray, beam: int, table: np.ndarray, entries: np.ndarray, least: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, similarity) of the beam, nearest first, and (query, node) of everything met at ``least`` or more."""
        rows = np.arange(len(queries))
        visited = np.zeros((len(queries), len(table)), dtype=np.uint8)
        nodes = np.full((len(queries), beam), -1, dtype=np.int64)
        near = np.full((len(queries), beam), -2, dtype=np.float32)
        opened = np.ones((len(queries), beam), dtype=bool)
        met_query, met_node = [], []

        def offer(active: np.ndarray, fresh: np.ndarray) -> None:
            ok = fresh >= 0
            ok &= visited[active[:, None], np.maximum(fresh, 0)] == 0
            line, place = np.nonzero(ok)
            visited[active[line], fresh[line, place]] = place + 1
            first = visited[active[line], fresh[line, place]] == place + 1  # a node may stand twice in a row
            ok[line[~first], place[~first]] = False
            line, place = line[first], place[first]
            close = np.full(fresh.shape, -2, dtype=np.float32)
            close[line, place] = np.einsum("ij,ij->i", self.unit[fresh[line, place]], queries[active[line]])
            if least <= 1:
                hit = close[line, place] >= least
                met_query.append(active[line[hit]])
                met_node.append(fresh[line[hit], place[hit]])
            all_near = np.concatenate((near[active], close), axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[active] = np.take_along_axis(all_near, order, axis=1)
            nodes[active] = np.take_along_axis(np.concatenate((nodes[active], np.where(ok, fresh, -1)), axis=1), order, axis=1)
            opened[active] = np.take_along_axis(np.concatenate((opened[active], ~ok), axis=1), order, axis=1)

        for column in range(entries.shape[1]):
            offer(rows, entries[:, column:column + 1].astype(np.int64))
        active = rows
        while True:
            closed = ~opened[active]
            some = closed.any(axis=1)
            active, closed = active[some], closed[some]
            if not len(active):
                break
            best = np.argsort(~closed, axis=1, kind="stable")[:, :STRIDE]
            usable = np.take_along_axis(closed, best, axis=1)
            opened[active[:, None], best] |= usable
            fresh = table[nodes[active[:, None], best]].astype(np.int64)
            fresh[~usable] = -1
            offer(active, fresh.reshape(len(active), -1))
        met = (np.concatenate(met_query), np.concatenate(met_node)) if met_query else (rows[:0], rows[:0])
        return nodes, near, *met

    def similar(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs met with similarity ``least`` or more.

        A query whose whole beam is that similar asks again with four times the beam; where that would pass an
        eighth of the graph, and wherever the audit set the beam to 0, it is compared to all nodes.
        """
        out_query, out_node = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        waiting, beam = np.arange(len(queries)), self.beam
        while len(waiting):
            wide = not beam or 8 * beam > len(self.unit)
            again = []
            for begin in range(0, len(waiting), BATCH):
                rows = waiting[begin:begin + BATCH]
                part = queries[rows]
                if wide:
                    query, node = np.nonzero(part @ self.unit.T >= least)
                else:
                    _, near, query, node = self.search(part, beam, self.levels[-1], self._enter(part), least)
                    full = near[:, -1] >= least
                    again.append(rows[full])
                    keep = ~full[query]
                    query, node = query[keep], node[keep]
                out_query.append(rows[query])
                out_node.append(node)
            waiting, beam = (np.concatenate(again), 4 * beam) if again else (rows[:0], beam)
        return np.concatenate(out_query), np.concatenate(out_node)

    def audit(self, least: float, sample: int, wanted: float, others: np.ndarray | None = None, neighbours: float = NEIGHBOURS) -> float:
        """Widen the beam until enough true pairs are met; return the recall reached.

        Queries are ``sample`` nodes drawn from all levels, without the pair of a node and itself, and ``others``:
        vectors that stand in no node.  Where they have no pair, the share of them whose nearest neighbour is met
        is the recall, and ``neighbours`` of it is enough.  A graph without a second node has nothing to miss.
        """
        drawn = np.random.default_rng(11).permutation(len(self.unit))[:sample]
        queries, own = self.unit[drawn], drawn
        if others is not None and len(others):
            queries, own = np.concatenate((queries, others)), np.concatenate((drawn, np.full(len(others), -1)))
        true, best = 0, []
        for i in range(0, len(queries), BATCH):
            near = queries[i:i + BATCH] @ self.unit.T
            mine = own[i:i + BATCH]
            near[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -2
            true += int((near >= least).sum())
            best.append(near.max(axis=1, initial=-2))
        nearest = np.concatenate(best) if best else np.zeros(0)
        while True:
            if true:
                query, node = self.similar(queries, least)
                reached = int((own[query] != node).sum()) / true
            else:
                reached = self._neighbours_met(queries, own, nearest)
            if reached >= (wanted if true else min(wanted, neighbours)) or not self.beam:
                return reached
            self.beam = 2 * self.beam if 8 * self.beam < len(self.unit) else 0

    def _neighbours_met(self, queries: np.ndarray, own: np.ndarray, nearest: np.ndarray) -> float:
        """Share of the queries for which a search meets a node as near as the nearest one, itself left out."""
        if not self.beam or not (nearest > -2).any():
            return 1.0
        met = 0
        for i in range(0, len(queries), BATCH):
            nodes, near, *_ = self.search(queries[i:i + BATCH], self.beam, self.levels[-1], self._enter(queries[i:i + BATCH]))
            near = np.where((nodes < 0) | (nodes == own[i:i + BATCH, None]), -2, near)
            met += int((near.max(axis=1) >= nearest[i:i + BATCH] - 1e-6).sum())
        return met / len(queries)
