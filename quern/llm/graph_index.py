"""Robust-pruned directed graph over unit vectors, vectorised with numpy.

One graph serves one shard.  Points enter in doubling batches: a greedy beam search through the
graph built so far proposes neighbours, relaxed distance pruning keeps a diverse few of them, and
reverse edges are pruned the same way.  All steps work on whole batches of points.
"""

from __future__ import annotations

import numpy as np

NEG = np.float32(-3.0)


class ShardGraph:
    """Graph over the rows of ``x`` (n x d, unit length, float32).

    degree   out-edges kept per point
    beam     points a search keeps in view
    alpha    relaxation: a candidate is dropped once a kept neighbour is ``alpha`` times nearer to it
    """

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 24, alpha: float = 1.2, width: int = 3):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.n = len(self.x)
        self.degree, self.beam, self.alpha2, self.width = degree, beam, np.float32(alpha * alpha), width
        self.out = np.full((self.n, degree), -1, dtype=np.int32)
        self.sim = np.full((self.n, degree), NEG, dtype=np.float32)
        self.entries = np.zeros(0, dtype=np.int32)

    def build(self, collect: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Insert all points; returns the nearest ``collect`` earlier points met by each insertion."""
        found = np.full((self.n, collect), -1, dtype=np.int32)
        close = np.full((self.n, collect), NEG, dtype=np.float32)
        first = min(self.n, 2 * self.beam)
        if not first:
            return found, close
        s = self.x[:first] @ self.x[:first].T
        np.fill_diagonal(s, NEG)
        ids = np.broadcast_to(np.arange(first, dtype=np.int32), (first, first))
        order = np.argsort(-s, axis=1, kind="stable")[:, : max(self.beam, collect)]
        self._link(np.arange(first), np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1))
        k = min(collect, order.shape[1])
        found[:first, :k], close[:first, :k] = order[:, :k], np.take_along_axis(s, order[:, :k], 1)
        found[close <= NEG] = -1
        self.entries = np.arange(first, dtype=np.int32)
        done = first
        while done < self.n:
            upto = min(self.n, 2 * done, done + 512)
            batch = np.arange(done, upto)
            ids, sims = self.search(self.x[batch], self.beam, limit=done)
            k = min(collect, ids.shape[1])
            found[batch, :k], close[batch, :k] = ids[:, :k], sims[:, :k]
            # points of one batch don't see each other in the graph; their nearest join the candidates
            s = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(s, NEG)
            m = min(4, len(batch))
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            peer, peer_sim = (near + done).astype(np.int32), np.take_along_axis(s, near, 1)
            if collect:
                both = np.concatenate([found[batch], peer], 1), np.concatenate([close[batch], peer_sim], 1)
                top = np.argsort(-both[1], axis=1, kind="stable")[:, :collect]
                found[batch], close[batch] = np.take_along_axis(both[0], top, 1), np.take_along_axis(both[1], top, 1)
            self._link(batch, np.concatenate([ids, peer], 1), np.concatenate([sims, peer_sim], 1))
            done = upto
        return found, close

    def search(self, q: np.ndarray, k: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of each row of ``q``; ids and cosines of the best ``k``, best first, -1 where none."""
        ids = np.full((len(q), k), -1, dtype=np.int32)
        sims = np.full((len(q), k), NEG, dtype=np.float32)
        for at in range(0, len(q), 512):
            part = self._search(q[at : at + 512], max(self.beam, k), limit or self.n)
            m = min(k, part[0].shape[1])
            ids[at : at + 512, :m], sims[at : at + 512, :m] = part[0][:, :m], part[1][:, :m]
        ids[sims <= NEG] = -1
        return ids, sims

    def _search(self, q: np.ndarray, keep: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        b, rows = len(q), np.arange(len(q))[:, None]
        entries = self.entries[self.entries < limit]
        seen = np.zeros((b, self.n), dtype=bool)
        seen[:, entries] = True
        sims = q @ self.x[entries].T
        ids = np.broadcast_to(entries, (b, len(entries)))
        fresh = np.ones_like(sims, dtype=bool)
        ids, sims, fresh = self._best(ids, sims, fresh, keep)
        live = np.arange(b)
        for _ in range(4 * keep):
            rank = np.where(fresh[live], sims[live], NEG)
            w = min(self.width, rank.shape[1])
            pick = np.argpartition(-rank, w - 1, axis=1)[:, :w]
            usable = np.take_along_axis(rank, pick, 1) > NEG
            going = usable.any(1)
            if not going.any():
                break
            live, pick, usable = live[going], pick[going], usable[going]
            fresh[live[:, None], pick] = False
            hop = np.where(usable, ids[live[:, None], pick], -1)
            nb = np.where(hop[:, :, None] >= 0, self.out[hop], -1).reshape(len(live), -1)
            r, c = np.nonzero(nb >= 0)
            v = nb[r, c]
            new = ~seen[live[r], v]
            r, v = r[new], v[new]
            if not len(v):
                continue
            flat = np.unique(r.astype(np.int64) * self.n + v)
            r, v = flat // self.n, (flat % self.n).astype(np.int32)
            seen[live[r], v] = True
            s = np.einsum("ij,ij->i", self.x[v], q[live[r]])
            floor = sims[live, -1] if sims.shape[1] >= keep else np.full(len(live), NEG)
            good = s > floor[r]
            r, v, s = r[good], v[good], s[good]
            if not len(v):
                continue
            start = np.searchsorted(r, np.arange(len(live)))
            slot = np.arange(len(r)) - start[r]
            wide = int(slot.max()) + 1
            add_i = np.full((len(live), wide), -1, dtype=np.int32)
            add_s = np.full((len(live), wide), NEG, dtype=np.float32)
            add_i[r, slot], add_s[r, slot] = v, s
            i, s2, f = self._best(
                np.concatenate([ids[live], add_i], 1),
                np.concatenate([sims[live], add_s], 1),
                np.concatenate([fresh[live], add_i >= 0], 1),
                keep,
            )
            if i.shape[1] > ids.shape[1]:
                grow = i.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=NEG)
                fresh = np.pad(fresh, ((0, 0), (0, grow)))
            ids[live], sims[live], fresh[live] = i, s2, f
        return ids, sims

    @staticmethod
    def _best(ids, sims, fresh, keep):
        order = np.argsort(-sims, axis=1)[:, :keep]
        return (np.take_along_axis(ids, order, 1).astype(np.int32), np.take_along_axis(sims, order, 1), np.take_along_axis(fresh, order, 1))

    def _prune(self, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Robust pruning of each row's candidates to at most ``degree``, best first."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        vec = self.x[np.maximum(ids, 0)]
        gap = 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))  # squared distances between candidates
        own = 2 - 2 * sims
        alive = sims > NEG
        rows = np.arange(len(ids))
        out_i = np.full((len(ids), self.degree), -1, dtype=np.int32)
        out_s = np.full((len(ids), self.degree), NEG, dtype=np.float32)
        for k in range(self.degree):
            best = np.argmax(alive, axis=1)  # candidates are sorted: the first alive is the nearest
            ok = alive[rows, best]
            if not ok.any():
                break
            out_i[:, k] = np.where(ok, ids[rows, best], -1)
            out_s[:, k] = np.where(ok, sims[rows, best], NEG)
            alive &= ~((self.alpha2 * gap[rows, best] <= own) & ok[:, None])
            alive[rows, best] = False
        return out_i, out_s

    def _link(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        sims = np.where((ids < 0) | (ids == points[:, None]), NEG, sims)
        self.out[points], self.sim[points] = self._prune(ids, sims)
        u = np.repeat(points.astype(np.int32), self.degree)
        v, s = self.out[points].ravel(), self.sim[points].ravel()
        keep = v >= 0
        u, v, s = u[keep], v[keep], s[keep]
        # reverse edges, the most similar first, at most twice the degree of them a point and batch
        order = np.lexsort((-s, v))
        u, v, s = u[order], v[order], s[order]
        heads, start = np.unique(v, return_index=True)
        slot = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
        keep = slot < 2 * self.degree
        row = np.searchsorted(heads, v)
        wide = int(slot[keep].max()) + 1 if keep.any() else 0
        if not wide:
            return
        add_i = np.full((len(heads), wide), -1, dtype=np.int32)
        add_s = np.full((len(heads), wide), NEG, dtype=np.float32)
        add_i[row[keep], slot[keep]], add_s[row[keep], slot[keep]] = u[keep], s[keep]
        add_s[(add_i[:, :, None] == self.out[heads][:, None, :]).any(2)] = NEG
        room = (self.out[heads] < 0).sum(1)
        fits = (add_s > NEG).sum(1) <= room
        for sel, prune in ((fits, False), (~fits, True)):
            if not sel.any():
                continue
            h = heads[sel]
            ci = np.concatenate([self.out[h], add_i[sel]], 1)
            cs = np.concatenate([self.sim[h], add_s[sel]], 1)
            if prune:
                self.out[h], self.sim[h] = self._prune(ci, cs)
            else:
                top = np.argsort(-cs, axis=1, kind="stable")[:, : self.degree]
                i, s2 = np.take_along_axis(ci, top, 1), np.take_along_axis(cs, top, 1)
                self.out[h], self.sim[h] = np.where(s2 > NEG, i, -1), s2
