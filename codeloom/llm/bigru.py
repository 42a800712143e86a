"""A bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Every position of a text gets the probabilities of the classes. Hidden states start at zero in
both directions; padding is masked by carrying the state unchanged.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGRU:
    """Weights of both directions and the output layer; float32 throughout."""

    VERSION = 2  # of the arithmetic below; kept weights of another one aren't used
    NAMES = ("xf", "uf", "xb", "ub", "w", "b")

    def __init__(self, classes: int, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.classes = h, classes
        self.p = {
            "xf": rng.normal(0, 0.3, (256, 3 * h)), "uf": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "xb": rng.normal(0, 0.3, (256, 3 * h)), "ub": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "w": rng.normal(0, 0.3, (2 * h, classes)), "b": np.zeros(classes),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def state(self) -> dict[str, np.ndarray]:
        return dict(self.p)

    @classmethod
    def from_state(cls, p: dict[str, np.ndarray]) -> ByteGRU:
        net = cls.__new__(cls)
        net.p, net.hidden, net.classes = p, p["uf"].shape[0], p["b"].shape[0]
        return net

    def _run(self, ids: np.ndarray, mask: np.ndarray, x: np.ndarray, u: np.ndarray, keep: bool):
        """Hidden states (T, B, h) of one direction over ids (T, B)."""
        T, B = ids.shape
        h = self.hidden
        if not keep:
            return self._forward(ids, mask, x, u), []
        out = np.empty((T, B, h), dtype=np.float32)
        saved = []
        s = np.zeros((B, h), dtype=np.float32)
        full = mask.all(axis=1)
        for t in range(T):
            a = x[ids[t]]
            g = s @ u
            zr = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (s - n)
            if not full[t]:
                new = np.where(mask[t][:, None], new, s)
            if keep:
                saved.append((s, z, r, n, g[:, 2 * h :]))
            out[t] = s = new
        return out, saved

    def _forward(self, ids: np.ndarray, mask: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The states of _run without what backpropagation needs, in buffers that are used again."""
        T, B = ids.shape
        h = self.hidden
        out = np.empty((T, B, h), dtype=np.float32)
        # gates apart, so that every operation runs over contiguous memory; a sigmoid is a tanh of half its argument
        xz, xr, xn = (np.ascontiguousarray(x[:, i * h : (i + 1) * h] * k) for i, k in enumerate((0.5, 0.5, 1)))
        uz, ur, un = (np.ascontiguousarray(u[:, i * h : (i + 1) * h] * k) for i, k in enumerate((0.5, 0.5, 1)))
        xz, xr, xn, uz, ur, un = (v.astype(np.float32) for v in (xz, xr, xn, uz, ur, un))
        s = np.zeros((B, h), dtype=np.float32)
        z, r, n, g = (np.empty((B, h), dtype=np.float32) for _ in range(4))
        full = mask.all(axis=1)
        for t in range(T):
            at = ids[t]
            for gate, xg, ug in ((z, xz, uz), (r, xr, ur)):
                np.take(xg, at, axis=0, out=gate, mode="clip")
                np.matmul(s, ug, out=g)
                gate += g
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            np.matmul(s, un, out=g)
            r *= g
            np.take(xn, at, axis=0, out=n, mode="clip")
            n += r
            np.tanh(n, out=n)
            new = out[t]
            np.subtract(s, n, out=new)
            new *= z
            new += n
            if not full[t]:
                off = ~mask[t]
                new[off] = s[off]
            s = new
        return out

    def _back(self, ids, mask, x, u, saved, dout):
        """Gradients of one direction's tables for the gradients dout (T, B, h) of its states."""
        T, B = ids.shape
        h = self.hidden
        dx, du = np.zeros_like(x), np.zeros_like(u)
        ds = np.zeros((B, h), dtype=np.float32)
        for t in range(T - 1, -1, -1):
            s, z, r, n, gn = saved[t]
            d = dout[t] + ds
            on = mask[t][:, None]
            d_on = d * on
            dn = d_on * (1 - z) * (1 - n * n)
            dz = d_on * (s - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(dx, ids[t], da)
            du += s.T @ dg
            ds = d_on * z + dg @ u.T + d * ~on
        return dx, du

    def probabilities(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, B, classes) for byte ids (T, B), left-aligned, mask true where there is a byte."""
        hf, _ = self._run(ids, mask, self.p["xf"], self.p["uf"], False)
        hb, _ = self._run(ids[::-1], mask[::-1], self.p["xb"], self.p["ub"], False)
        y = hf @ self.p["w"][: self.hidden] + hb[::-1] @ self.p["w"][self.hidden :] + self.p["b"]
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=2, keepdims=True)
        return y

    def gradients(self, ids, mask, labels):
        """(mean loss, gradients) by labels (B,), one class for all positions of a sequence, or (T, B), one for each."""
        p, h = self.p, self.hidden
        hf, sf = self._run(ids, mask, p["xf"], p["uf"], True)
        hb, sb = self._run(ids[::-1], mask[::-1], p["xb"], p["ub"], True)
        both = np.concatenate([hf, hb[::-1]], axis=2)
        y = both @ p["w"] + p["b"]
        y -= y.max(axis=2, keepdims=True)
        y = np.exp(y)
        y /= y.sum(axis=2, keepdims=True)
        weight = mask / np.maximum(mask.sum(axis=0), 1)[None, :] / ids.shape[1]  # every sequence counts the same
        at = (np.arange(ids.shape[0])[:, None], np.arange(ids.shape[1])[None, :], labels if labels.ndim == 2 else labels[None, :])
        loss = float(-(np.log(y[at] + 1e-9) * weight).sum())
        d = y
        d[at] -= 1
        d = (d * weight[:, :, None]).astype(np.float32)
        g = {"w": np.tensordot(both, d, axes=([0, 1], [0, 1])), "b": d.sum(axis=(0, 1))}
        dboth = d @ p["w"].T
        g["xf"], g["uf"] = self._back(ids, mask, p["xf"], p["uf"], sf, dboth[:, :, :h])
        g["xb"], g["ub"] = self._back(ids[::-1], mask[::-1], p["xb"], p["ub"], sb, dboth[::-1, :, h:])
        return loss, g

    def train(self, texts: list[bytes], labels: np.ndarray | list[np.ndarray], epochs: int, batch: int = 128, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over batches of texts of similar length, labelled as a whole or (a list of arrays) byte by byte; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        lens = np.array([len(t) for t in texts])
        for epoch in range(epochs):
            order = np.argsort(lens + rng.uniform(0, 12, len(texts)), kind="stable")
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(groups)
            total = 0.0
            for g in groups:
                ids, mask = pack([texts[i] for i in g])
                if isinstance(labels, list):
                    y = np.zeros(ids.shape, dtype=np.int64)
                    for j, i in enumerate(g):
                        y[: len(labels[i]), j] = labels[i]
                else:
                    y = labels[g]
                loss, grad = self.gradients(ids, mask, y)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
                scale = min(1.0, 1.0 / (norm + 1e-9))
                lr = rate * (1 - 0.9 * epoch / max(epochs, 1))
                for k, x in grad.items():
                    x = x * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.99 * v2[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                total += loss * len(g)
            losses.append(total / max(len(texts), 1))
        return losses


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids and mask, (longest, number of texts)."""
    T = max(1, max((len(t) for t in texts), default=1))
    ids = np.zeros((T, len(texts)), dtype=np.uint8)
    mask = np.zeros((T, len(texts)), dtype=bool)
    for j, t in enumerate(texts):
        ids[: len(t), j] = np.frombuffer(t, dtype=np.uint8)
        mask[: len(t), j] = True
    return ids, mask
