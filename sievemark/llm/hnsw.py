"""Hierarchical navigable small-world graphs over unit vectors, many vectors at a time in numpy."""

from __future__ import annotations

import io

import numpy as np


class Graph:
    """Layers of links; a vector is on layer l with probability `links` ** -l. Vectors must be unit length, float32."""

    def __init__(self, x: np.ndarray, links: int = 12, beam: int = 48, seed: int = 7):
        self.x, self.links, self.beam = np.ascontiguousarray(x, np.float32), links, beam
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(np.int32), 6)
        self.adj = [np.full((n, links * 2 if l == 0 else links), -1, np.int32) for l in range(int(self.level.max(initial=0)) + 1)]
        self.tops: list[np.ndarray] = []
        done, size = 0, 1
        while done < n:
            self._insert(np.arange(done, min(n, done + size)))
            done += size
            size = min(256, done)

    # -- building
    def _insert(self, new: np.ndarray) -> None:
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -2)
        top = len(self.adj) - 1
        entry = self._entries(new[0])
        for layer in range(top, -1, -1):
            here = self.level[new] >= layer
            old = self.adj[layer]
            exists = new[0] > 0 and (self.level[: new[0]] >= layer).any()
            ids = np.full((len(new), 0), -1, np.int64)
            sims = np.full((len(new), 0), -2, np.float32)
            if exists:
                ids, sims = self._search(self.x[new], entry, layer, self.beam, new[0])
                entry = ids[:, :4]
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            near = np.argsort(-own[np.ix_(rows, rows)], axis=1, kind="stable")[:, : min(self.beam, len(rows) - 1)]
            both = np.concatenate([ids[rows], new[rows][near]], axis=1)
            sim = np.concatenate([sims[rows], np.take_along_axis(own[np.ix_(rows, rows)], near, 1)], axis=1)
            if both.shape[1] == 0:
                continue
            picked = self._diverse(both, sim, self.links)
            old[new[rows], : picked.shape[1]] = picked
            self._back(layer, new[rows], picked)

    def _entries(self, n: int) -> np.ndarray:
        """A node of the highest layer among the first n."""
        return np.array([[int(np.argmax(self.level[:n])) if n else 0]])

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row the nearest candidates that aren't nearer to one already taken; the rest fills up by nearness."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(self.beam, most)]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        good = (ids >= 0) & (sims > -2)
        vec = self.x[np.maximum(ids, 0)]
        among = np.einsum("bid,bjd->bij", vec, vec, optimize=True)
        closest = np.full(sims.shape, -2, np.float32)
        taken = np.zeros(sims.shape, bool)
        count = np.zeros(len(ids), np.int64)
        for j in range(ids.shape[1]):
            ok = good[:, j] & (closest[:, j] <= sims[:, j]) & (count < most)
            taken[:, j] = ok
            count += ok
            closest[ok] = np.maximum(closest[ok], among[ok, j])
        rank = np.where(taken, 0, np.where(good, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(np.where(good, ids, -1), pick, 1)
        return out.astype(np.int32)

    def _back(self, layer: int, source: np.ndarray, picked: np.ndarray) -> None:
        """Links back from what was picked; full lists are thinned to the most diverse."""
        adj = self.adj[layer]
        t, s = picked.ravel(), np.repeat(source, picked.shape[1])
        keep = t >= 0
        t, s = t[keep], s[keep]
        order = np.argsort(t, kind="stable")
        t, s = t[order], s[order]
        nodes, start, count = np.unique(t, return_index=True, return_counts=True)
        if not len(nodes):
            return
        extra = np.full((len(nodes), int(count.max())), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(t)) - np.repeat(start, count)] = s
        both = np.concatenate([adj[nodes].astype(np.int64), extra], axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both[both == nodes[:, None]] = -1
        width = adj.shape[1]
        fits = (both >= 0).sum(1) <= width
        if fits.any():
            adj[nodes[fits]] = -np.sort(-both[fits], axis=1)[:, :width]
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), 256):
            rows = full[at : at + 256]
            ids = both[rows]
            sims = np.einsum("bcd,bd->bc", self.x[np.maximum(ids, 0)], self.x[nodes[rows]], optimize=True)
            adj[nodes[rows]] = self._diverse(ids, np.where(ids >= 0, sims, -2), width)

    # -- searching
    def _search(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int, n: int):
        """Beam search of all rows of q at once on one layer: ids and similarities, best first."""
        adj, rows = self.adj[layer], len(q)
        entry = np.broadcast_to(entry, (rows, entry.shape[1]))
        seen = np.zeros((rows, n), bool)
        ids = np.full((rows, ef), -1, np.int64)
        sims = np.full((rows, ef), -2, np.float32)
        first = entry[:, : min(ef, entry.shape[1])]
        ids[:, : first.shape[1]] = first
        sims[:, : first.shape[1]] = np.where(first >= 0, np.einsum("bcd,bd->bc", self.x[np.maximum(first, 0)], q, optimize=True), -2)
        seen[np.arange(rows)[:, None], np.maximum(first, 0)] = True
        done = ids < 0
        live = np.arange(rows)
        while len(live):
            score = np.where(done[live], -3, sims[live])
            best = score.argmax(1)
            more = score[np.arange(len(live)), best] > -3
            live, best = live[more], best[more]
            if not len(live):
                break
            done[live, best] = True
            near = adj[ids[live, best]].astype(np.int64)
            fresh = (near >= 0) & (near < n)
            near = np.where(fresh, near, 0)
            fresh &= ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            s = np.where(fresh, np.einsum("bcd,bd->bc", self.x[near], q[live], optimize=True), -2).astype(np.float32)
            all_s = np.concatenate([sims[live], s], axis=1)
            order = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), order, 1)
            sims[live] = np.take_along_axis(all_s, order, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def near(self, q: np.ndarray, least: float, ef: int) -> list[np.ndarray]:
        """For each row of q the nodes found with similarity of at least `least`.

        After the beam, everything found is widened along the links as long as that finds more such nodes, so that
        large groups of near copies don't need a beam of their size.
        """
        n, out = len(self.x), []
        q = np.ascontiguousarray(q, np.float32)
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            entry = self._entries(n)
            for layer in range(len(self.adj) - 1, 0, -1):
                entry = self._search(part, entry, layer, 8, n)[0][:, :4]
            ids, sims = self._search(part, entry, 0, min(ef, n), n)
            for row, i, s in zip(part, ids, sims):
                hits = i[(s >= least) & (i >= 0)]
                if len(hits):
                    seen = np.zeros(n, bool)
                    seen[i[i >= 0]] = True
                    edge = hits
                    while len(edge):
                        step = np.unique(self.adj[0][edge])
                        step = step[step >= 0]
                        step = step[~seen[step]]
                        seen[step] = True
                        edge = step[self.x[step] @ row >= least]
                        hits = np.concatenate([hits, edge])
                out.append(hits)
        return out

    # -- sending
    def dump(self) -> bytes:
        with io.BytesIO() as f:
            np.savez(f, x=self.x, level=self.level, **{f"adj{i}": a for i, a in enumerate(self.adj)})
            return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        g = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            g.x, g.level = z["x"], z["level"]
            g.adj = [z[f"adj{i}"] for i in range(len(z.files) - 2)]
        g.links, g.beam = g.adj[0].shape[1] // 2, 48
        return g
