"""A causal attention network over subword ids in numpy, with a Huffman tree of softmaxes for its output.

Every id is a leaf of a tree whose nodes have up to ``RADIX`` children (a Huffman code by corpus frequency, so that
frequent ids are few steps from the root). A node is a softmax over its children; an id's probability is the product
along its path, so the probabilities of all ids sum to one and each costs a few small softmaxes. The tree's biases are
the logarithms of the corpus shares below each child: without any training the network gives the smoothed frequencies
of the ids. Places are sorted by their target's leaf, so that a node's softmax is one product over a run of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIM = 16
BLOCK = 16
RADIX = 16
SLAB = 8192  # blocks
STEP = 256  # blocks
_GROUP = 24  # fewer rows of a node go in small pieces
_ROWS = 4096
_PIECES = ((8, 1, _GROUP), (_ROWS, _GROUP, 1 << 62))  # rows a piece, for nodes of so many rows
_Q, _K, _V, _R = (slice(i * DIM, (i + 1) * DIM) for i in range(4))
_DISTANCE = np.clip(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :], 0, 2 * BLOCK - 1)
_ONES = np.ones(RADIX, np.float32)
_PLACES = np.ones(2 * BLOCK, np.float32)
_ROW = np.ones((1, _ROWS), np.float32)
_FIRST = np.arange(2 * _ROWS) * RADIX
_PAST = np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK


class Tree:
    """The shape of the output: leaves are ids, inner nodes are numbered from the deepest to the root."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        order = np.argsort(weights, kind="stable").tolist()
        mass = weights[order].astype(np.float64).tolist()
        inner: list[float] = []
        rows: list[list[int]] = []
        shares: list[list[float]] = []
        i = j = 0
        take = min(n, (n - 2) % (RADIX - 1) + 2) if n > 1 else n
        while not rows or (n - i) + (len(inner) - j) > 1:
            kids, sizes = [], []
            while len(kids) < take and (i < n or j < len(inner)):
                if i < n and (j >= len(inner) or mass[i] <= inner[j]):
                    kids.append(order[i])
                    sizes.append(mass[i])
                    i += 1
                else:
                    kids.append(n + j)
                    sizes.append(inner[j])
                    j += 1
            rows.append(kids + [-1] * (RADIX - len(kids)))
            shares.append(sizes + [0.0] * (RADIX - len(kids)))
            inner.append(sum(sizes))
            take = RADIX
        self.n_ids, self.root = n, len(rows) - 1
        self.child = np.array(rows)
        self.inner = [[(c, kid - n) for c, kid in enumerate(kids) if kid >= n] for kids in rows]  # by node: place and node of its inner children
        share = np.array(shares)
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(share / share.sum(axis=1, keepdims=True)), -1e9).astype(np.float32)
        # leaves in depth-first order, and where the leaves of every child begin in it
        leaves = np.ones(n + len(rows), dtype=np.int64)
        width = np.zeros((len(rows), RADIX), dtype=np.int64)
        for k in range(len(rows)):
            width[k] = np.where(self.child[k] >= 0, leaves[self.child[k]], 0)
            leaves[n + k] = width[k].sum()
        begin = np.zeros(n + len(rows), dtype=np.int64)
        self.edge = np.zeros((len(rows), RADIX + 1), dtype=np.int64)
        for k in range(self.root, -1, -1):
            self.edge[k] = begin[n + k] + np.concatenate(([0], np.cumsum(width[k])))
            real = self.child[k] >= 0
            begin[self.child[k][real]] = self.edge[k, :-1][real]
        self.rank = begin[:n].astype(np.uint16 if n <= 1 << 16 else np.uint32)
        self.paths()

    def paths(self) -> None:
        """``path`` and ``digit``: by depth and leaf in depth-first order, the node on the way to it (-1 below the leaf) and
        its child there."""
        rank, at = np.arange(self.n_ids), np.full(self.n_ids, self.root)
        self.path, self.digit = [], []
        while len(rank):
            digit = (self.edge[at, 1:] <= rank[:, None]).sum(axis=1)
            path, digits = np.full(self.n_ids, -1, np.int32), np.zeros(self.n_ids, np.int8)
            path[rank], digits[rank] = at, digit
            self.path.append(path)
            self.digit.append(digits)
            at = self.child[at, digit] - self.n_ids
            rank, at = rank[at >= 0], at[at >= 0]

    def walk(self, u: np.ndarray, b: np.ndarray, h: np.ndarray, goal: np.ndarray, weight: np.ndarray | None = None, safe: bool = False):
        """Natural log probabilities of the ids ``goal`` at states ``h``; with ``weight``, the gradients of their
        weighted negative sum too: by ``h``, and ``(nodes, by u, by b)``. ``safe`` says that no exponent overflows.

        Each depth is one pass. A node of many rows has a product of its own; the rows of the others are cut into pieces of
        one length, filled up with row n, which weighs nothing, for one product of many small matrices.
        """
        n = len(goal)
        rank = self.rank[goal]
        order = _order(rank)
        rank = rank[order]
        hs = np.zeros((n + 1, h.shape[1]), np.float32)
        h.take(order, axis=0, out=hs[:n], mode="clip")
        prob = np.ones(n + 1)
        ws = dh = None
        if weight is not None:
            ws, dh = np.zeros(n + 1, np.float32), np.zeros_like(hs)
            ws[:n] = weight[order]
        nodes, du, db = [np.empty(0, np.int64)], [np.empty((0, *u.shape[1:]), np.float32)], [np.empty((0, b.shape[1]), np.float32)]

        def softmax(z: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
            """Of logits z at ``rows``, whose child is ``own``: multiplies ``prob``, and turns z into its gradient."""
            np.exp(z if safe else np.minimum(z, 80, out=z), out=z)
            total, own = z @ _ONES, _FIRST[: len(rows)] + own
            prob[rows] *= z.reshape(-1).take(own) / total
            if ws is not None:
                share = ws.take(rows)
                z *= (share / total)[:, None]
                z.reshape(-1)[own] -= share

        live = np.arange(n)
        for path, digits in zip(self.path, self.digit, strict=True):
            node = path.take(rank)
            if len(below := np.flatnonzero(node >= 0)) < len(node):
                live, node, rank = live[below], node[below], rank[below]
            if not len(live):
                break
            digit = np.append(digits.take(rank), 0)
            begin = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1))
            count = np.diff(np.append(begin, len(node)))
            rows_of = np.append(live, n)
            for size, least, most in _PIECES:
                runs = np.flatnonzero((count >= least) & (count < most))
                if not len(runs):
                    continue
                pieces = -(-count[runs] // size)
                first = np.cumsum(pieces) - pieces
                lo = np.repeat(begin[runs] - first * size, pieces) + np.arange(int(pieces.sum())) * size
                hi = np.minimum(lo + size, np.repeat(begin[runs] + count[runs], pieces))
                of = node[begin[runs]]
                k = np.repeat(of, pieces)
                if ws is not None:
                    su, sb = np.empty((len(k), *u.shape[1:]), np.float32), np.empty((len(k), b.shape[1]), np.float32)
                few = size < _ROWS
                # about so many rows at a time as stay in a core's cache
                cuts = np.flatnonzero(np.diff((np.cumsum(hi - lo) - 1) // _ROWS)) + 1 if not few else np.arange(_ROWS // size, len(k), _ROWS // size)
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                    if few:
                        at = lo[s:e, None] + np.arange(size)
                        at = np.where(at < hi[s:e, None], at, len(live)).ravel()
                        rows = rows_of.take(at)
                        x, w = hs.take(rows, axis=0).reshape(e - s, size, -1), u.take(k[s:e], axis=0)
                        z = np.matmul(x, w)
                        z += b.take(k[s:e], axis=0)[:, None]
                        softmax(z.reshape(-1, RADIX), rows, digit.take(at))
                        if ws is not None:
                            np.matmul(x.transpose(0, 2, 1), z, out=su[s:e])
                            np.matmul(_ROW[:, :size], z, out=sb[s:e, None])
                            dh[rows] += np.matmul(z, w.transpose(0, 2, 1)).reshape(len(rows), -1)
                        continue
                    n_rows = hi[s:e] - lo[s:e]
                    to = np.cumsum(n_rows)
                    at = np.arange(int(to[-1])) + np.repeat(lo[s:e] - to + n_rows, n_rows)
                    rows = rows_of.take(at)
                    z = b.take(np.repeat(k[s:e], n_rows), axis=0)
                    # a node's rows lie together
                    each = list(zip(range(s, e), k[s:e].tolist(), live[lo[s:e]].tolist(), (live[lo[s:e]] + n_rows).tolist(), (to - n_rows).tolist(), to.tolist(), strict=True))
                    for _, j, p, q, y, t in each:
                        z[y:t] += hs[p:q] @ u[j]
                    softmax(z, rows, digit.take(at))
                    if ws is not None:
                        for i, j, p, q, y, t in each:
                            np.dot(hs[p:q].T, z[y:t], out=su[i])
                            np.dot(_ROW[0, : t - y], z[y:t], out=sb[i])
                            dh[p:q] += z[y:t] @ u[j].T
                if ws is not None:
                    nodes.append(of)
                    for sums, x in ((du, su), (db, sb)):
                        sums.append(x if len(x) == len(of) else np.add.reduceat(x, first, axis=0))
        out = np.empty(n)
        out[order] = np.log(np.maximum(prob[:n], 1e-300))
        if ws is None:
            return out
        by_h = np.empty_like(dh[:n])
        by_h[order] = dh[:n]
        return out, by_h, tuple(np.concatenate(x) for x in (nodes, du, db))


def _greatest(a: np.ndarray) -> np.ndarray:
    """The maxima of the last axis, whose size is a power of two, by halves: numpy is slow on short rows."""
    while (half := a.shape[-1] // 2) > 0:
        a = np.maximum(a[..., :half], a[..., half:])
    return a


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order of keys of at most 32 bits, by their halves: numpy sorts 16 bits by digits."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where each key begins in it."""
    order = _order(keys)
    s = keys[order]
    return order, np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))


class Blocks:
    """The windows of sequences: ``body`` holds their ids one after another, ``lens`` of them each. A window is a block
    of ``BLOCK`` targets whose places see the inputs of their block so far and of the block before it; an input is the
    id before its target, the end id at first. Every id is a target once."""

    def __init__(self, body: np.ndarray, lens: np.ndarray, end: int):
        self.body, self.end = body, end
        n = -(-lens // BLOCK)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.start = np.repeat(np.cumsum(lens) - lens, n) + inside * BLOCK
        self.size = np.minimum(BLOCK, np.repeat(lens, n) - inside * BLOCK)
        self.first = inside == 0

    def __len__(self) -> int:
        return len(self.start)

    def at(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(inputs, targets, live, first)`` of the blocks from lo to hi; dead places hold the end id."""
        place = np.arange(BLOCK)
        live = place < self.size[lo:hi, None]
        at = np.where(live, self.start[lo:hi, None] + place, 0)
        first = self.first[lo:hi]
        x = self.body[np.maximum(at - 1, 0)].astype(np.int64)
        x[first, 0] = self.end
        x[~live] = self.end
        goal = np.where(live, self.body[at], self.end) if len(self.body) else np.full(live.shape, self.end)
        return x, goal.astype(np.int64), live, first


class Network:
    """One causal head over id embeddings; the output is a tree."""

    def __init__(self, tree: Tree, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tree = tree
        self.p = {
            "e": (rng.standard_normal((tree.n_ids, DIM)) * 0.3).astype(np.float32),
            "w": (rng.standard_normal((DIM, 4 * DIM)) / np.sqrt(DIM)).astype(np.float32),
            "far": np.zeros(2 * BLOCK, np.float32),
            "u": np.zeros((len(tree.child), DIM, RADIX), np.float32),
            "b": tree.bias.copy(),
        }

    def freeze(self, final: bool = False) -> None:
        """Cache queries, keys, values and residuals of all ids, and the exponentiated biases of distances; ``final`` gives
        the embeddings up for them."""
        t = self.p["e"] @ self.p["w"]
        t[:, _Q] /= np.sqrt(np.float32(DIM))
        self.q, self.k, self.v, self.r = (np.ascontiguousarray(t[:, s]) for s in (_Q, _K, _V, _R))
        self.p["e"] = self.p["e"][:0] if final else self.p["e"]
        # states are within 1, so this bounds all exponents
        self.safe = float((np.abs(self.p["u"]).sum(axis=1) + np.maximum(self.p["b"], 0)).max(initial=0)) < 80
        self.near = np.where(_PAST, np.exp(self.p["far"])[_DISTANCE], 0).astype(np.float32)

    def states(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The states after blocks of inputs; the block before the first one given is taken for its own past only if
        ``first`` says so. ``freeze`` comes before."""
        q, k, v, h = (t.take(x, axis=0) for t in (self.q, self.k, self.v, self.r))
        past = np.empty((2, len(x), 2 * BLOCK, DIM), np.float32)
        for c, t in zip(past, (k, v), strict=True):
            c[1:, :BLOCK], c[:1, :BLOCK], c[:, BLOCK:] = t[:-1], t[:1], t
        a = np.matmul(q, past[0].transpose(0, 2, 1))
        np.exp(np.clip(a, -60, 60, out=a), out=a)
        a *= self.near
        a[first, :, :BLOCK] = 0
        o = np.matmul(a, past[1]).reshape(-1, DIM)
        o /= (a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, np.float32))[:, None]
        o += h.reshape(-1, DIM)
        return np.tanh(o, out=o)

    def log_probs(self, blocks: Blocks, slab: int = SLAB, step: int = STEP) -> Iterator[np.ndarray]:
        """Natural log probabilities of all targets in their order, a slab of blocks after another."""
        for s in range(0, len(blocks), slab):
            e = min(len(blocks), s + slab)
            h, goals = [], []
            for lo in range(s, e, step):
                hi, back = min(e, lo + step), int(lo > 0)  # with the block before
                x, goal, live, first = blocks.at(lo - back, hi)
                some = live[back:].ravel()
                h.append(self.states(x, first)[back * BLOCK :][some])
                goals.append(goal[back:].ravel()[some])
            yield self.tree.walk(self.p["u"], self.p["b"], np.concatenate(h), np.concatenate(goals), safe=self.safe)

    def gradient(self, blocks: Blocks, lo: int, hi: int) -> tuple[float, int, dict[str, tuple[np.ndarray | None, np.ndarray]]]:
        """Summed loss and ids of the blocks from lo to hi, and by weight ``(rows, gradient of the mean loss)``."""
        p, back, scale = self.p, int(lo > 0), np.float32(1 / np.sqrt(DIM))
        x, goal, live, first = blocks.at(lo - back, hi)
        live[:back] = False
        flat = x.ravel()
        e = p["e"].take(flat, axis=0)
        t = (e @ p["w"]).reshape(len(x), BLOCK, 4 * DIM)
        q, k, v = t[:, :, _Q], t[:, :, _K], t[:, :, _V]
        past = np.empty((2, len(x), 2 * BLOCK, DIM), np.float32)
        for c, own in zip(past, (k, v), strict=True):
            c[1:, :BLOCK], c[:1, :BLOCK], c[:, BLOCK:] = own[:-1], own[:1], own
        q = q * scale
        a = np.matmul(q, past[0].transpose(0, 2, 1))
        # where no exponent can overflow or all of a row vanish, the maxima need not be taken off
        bounded = max(a.max(), -a.min()) + np.abs(p["far"]).max() < 60
        a += np.where(_PAST, p["far"][_DISTANCE], np.float32(-1e9))
        a[first, :, :BLOCK] = -1e9
        if not bounded:
            a -= _greatest(a)
        np.exp(a, out=a)
        a /= (a.reshape(-1, 2 * BLOCK) @ _PLACES).reshape(len(x), BLOCK, 1)
        o = np.matmul(a, past[1])
        h = o + t[:, :, _R]
        np.tanh(h, out=h)
        some = live.ravel()
        n = int(some.sum())
        weight = np.full(n, 1 / max(1, n), np.float32)
        logs, by_h, (nodes, by_u, by_b) = self.tree.walk(p["u"], p["b"], h.reshape(-1, DIM)[some], goal.ravel()[some], weight)
        dt = np.empty_like(t)
        dh = np.zeros((len(flat), DIM), np.float32)
        dh[some] = by_h
        dh = dh.reshape(h.shape)
        h *= h
        dh *= np.subtract(1, h, out=h)
        dv = np.matmul(a.transpose(0, 2, 1), dh)
        # a softmax's gradient: the sum of da * a is that of dh * o, over half as many numbers
        dz = np.matmul(dh, past[1].transpose(0, 2, 1))
        o *= dh
        dz -= (o.reshape(-1, DIM) @ _PLACES[:DIM]).reshape(len(x), BLOCK, 1)
        dz *= a
        far = np.bincount(_DISTANCE.ravel(), weights=np.ones(len(x), np.float32) @ dz.reshape(len(x), -1), minlength=2 * BLOCK).astype(np.float32)
        dk = np.matmul(dz.transpose(0, 2, 1), q)
        np.multiply(np.matmul(dz, past[0]), scale, out=dt[:, :, _Q])
        dt[:, :, _R] = dh
        for s, d in ((_K, dk), (_V, dv)):
            np.add(d[:-1, BLOCK:], d[1:, :BLOCK], out=dt[:-1, :, s])
            dt[-1:, :, s] = d[-1:, BLOCK:]
        dt = dt.reshape(-1, 4 * DIM)
        by, starts = _runs(flat)
        de = np.add.reduceat((dt @ p["w"].T).take(by, axis=0), starts, axis=0)
        grads = {"e": (flat[by][starts], de), "w": (None, e.T @ dt), "far": (None, far), "u": (nodes, by_u), "b": (nodes, by_b)}
        return -float(logs.sum()), n, grads

    def scales(self) -> dict[str, np.ndarray]:
        """AdaGrad's sums of squares, one for each row of a weight table, one number for the others."""
        return {k: np.zeros(len(w) if k in ("e", "u", "b") else 1, np.float32) for k, w in self.p.items()}

    def descend(self, blocks: Blocks, scales: dict[str, np.ndarray], rate: float, batch: int, rng: np.random.Generator) -> tuple[float, int, dict[str, np.ndarray]]:
        """One pass of AdaGrad over all blocks, in batches of neighbours: summed loss, ids, and touches by row."""
        touched = {k: np.zeros(len(s), np.float32) for k, s in scales.items()}
        total, seen = 0.0, 0
        starts = np.arange(0, len(blocks), batch)
        for lo in rng.permutation(starts).tolist():
            loss, n, grads = self.gradient(blocks, lo, min(len(blocks), lo + batch))
            total += loss
            seen += n
            for k, (rows, g) in grads.items():
                at = slice(None) if rows is None else rows
                flat = g.reshape(len(g) if rows is not None else 1, -1)
                square = np.einsum("ij,ij->i", flat, flat) / np.float32(flat.shape[1])
                scales[k][at] += square
                touched[k][at] += 1
                size = np.float32(rate) / (np.sqrt(scales[k][at]) + np.float32(1e-10))
                flat *= size[:, None]
                self.p[k][at] -= g
        return total, seen, touched
