"""A bidirectional gated recurrent network over bytes in numpy: forward pass, backpropagation through time, Adam."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class ByteGRU:
    """Each direction: z, r = sigmoid(E[byte] + h U), c = tanh(E[byte] + (r h) V), h' = z h + (1 - z) c.
    E is a table of 256 rows that embedding and input weights have been joined to. Both directions' states at a
    position give its label probabilities. The two directions run side by side: the backward one reads each row from
    its end, so all parameters and states have a first axis of two."""

    def __init__(self, n_labels: int, hidden: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"W": r.normal(0, 0.3, (2 * hidden, n_labels)), "b": np.zeros(n_labels), "E": r.normal(0, 0.3, (2, 256, 3 * hidden)), "U": r.normal(0, 0.2, (2, hidden, 2 * hidden)), "V": r.normal(0, 0.2, (2, hidden, hidden))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (length, 2, rows, hidden) of bytes (2, rows, length) after each byte, from zero, and what the steps
        computed, for backpropagation."""
        k, (_, rows, length) = self.hidden, x.shape
        table, u, v = self.p["E"].reshape(512, 3 * k), self.p["U"], self.p["V"]
        at = x.transpose(2, 0, 1).astype(np.int64) + np.array([[0], [256]])
        h = np.zeros((2, rows, k), table.dtype)
        states, trace = np.empty((length, 2, rows, k), table.dtype), []
        for t in range(length):
            e = table.take(at[t], 0)
            zr = sigmoid(e[:, :, : 2 * k] + h @ u)
            z, r = zr[:, :, :k], zr[:, :, k:]
            c = np.tanh(e[:, :, 2 * k :] + (r * h) @ v)
            trace.append((h, z, r, c))
            h = states[t] = c + z * (h - c)
        return states, trace

    def _states_only(self, x: np.ndarray) -> np.ndarray:
        """The same states, in place, gate by gate: sigmoid and tanh are written by exp, with its signs and factors in
        the weights."""
        k, (_, rows, length) = self.hidden, x.shape
        table = self.p["E"].reshape(512, 3 * k)
        e_z, e_r, e_c = (np.ascontiguousarray(f * table[:, i * k : (i + 1) * k]) for i, f in enumerate((-1, -1, -2)))
        u_z, u_r, v = np.ascontiguousarray(-self.p["U"][:, :, :k]), np.ascontiguousarray(-self.p["U"][:, :, k:]), -2 * self.p["V"]
        at = np.ascontiguousarray(x.transpose(2, 0, 1).astype(np.int64) + np.array([[0], [256]]))
        z, r, c, own = np.empty((4, 2, rows, k), np.float32)
        states = np.empty((length + 1, 2, rows, k), np.float32)
        states[0] = 0
        with np.errstate(over="ignore"):
            for t in range(length):
                h, new = states[t], states[t + 1]
                np.matmul(h, u_r, out=r)
                r += e_r.take(at[t], 0, out=own, mode="clip")
                np.exp(r, out=r)
                r += 1
                np.divide(h, r, out=r)
                np.matmul(h, u_z, out=z)
                z += e_z.take(at[t], 0, out=own, mode="clip")
                np.exp(z, out=z)
                z += 1
                np.matmul(r, v, out=c)
                c += e_c.take(at[t], 0, out=own, mode="clip")
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                np.subtract(h, c, out=new)
                new /= z
                new += c
        return states[1:]

    def sums(self, rows: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(rows, labels): the label probabilities of the positions from begin to end of each row of bytes, added up.
        Rows of any lengths run together; what lies behind a row's end comes after all its positions."""
        n, size = len(rows), np.array([len(r) for r in rows])
        longest, k = int(size.max()), self.hidden
        x = np.zeros((2, n, longest), np.uint8)
        for i, r in enumerate(rows):
            x[0, i, : len(r)] = r
            x[1, i, : len(r)] = r[::-1]
        s = self._states_only(x)
        place = np.arange(longest)[:, None]
        back = np.ascontiguousarray((s[:, 1] @ self.p["W"][k:])[np.maximum(size - 1 - place, 0), np.arange(n)].transpose(2, 0, 1))
        p = np.ascontiguousarray((s[:, 0] @ self.p["W"][:k] + self.p["b"]).transpose(2, 0, 1))
        p += back
        p -= p.max(0)
        np.exp(p, out=p)
        p *= ((place >= begin) & (place < end)) / p.sum(0)
        return p.sum(1).T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions of rows of equal length, each labelled as its row, and its gradients."""
        k, (rows, length) = self.hidden, x.shape
        both = np.stack([x, x[:, ::-1]])
        states, trace = self._states(both)
        s = np.concatenate([states[:, 0], states[::-1, 1]], 2)
        p = softmax(s @ self.p["W"] + self.p["b"])
        at = (slice(None), np.arange(rows), y)
        loss = float(-np.log(np.maximum(p[at], 1e-12)).mean())
        p[at] -= 1
        p /= rows * length
        g = {"W": np.tensordot(s, p, ((0, 1), (0, 1))), "b": p.sum((0, 1))}
        back = p @ self.p["W"].T
        back = np.stack([back[:, :, :k], back[::-1, :, k:]], 1)
        u, v = self.p["U"], self.p["V"]
        gu, gv = np.zeros_like(u), np.zeros_like(v)
        inputs = np.empty((length, 2, rows, 3 * k), u.dtype)
        dh = np.zeros((2, rows, k), u.dtype)
        for t in range(length - 1, -1, -1):
            h, z, r, c = trace[t]
            dh = dh + back[t]
            dc = dh * (1 - z) * (1 - c * c)
            drh = dc @ v.transpose(0, 2, 1)
            dzr = np.concatenate([dh * (h - c) * z * (1 - z), drh * h * r * (1 - r)], 2)
            gv += (r * h).transpose(0, 2, 1) @ dc
            gu += h.transpose(0, 2, 1) @ dzr
            inputs[t] = np.concatenate([dzr, dc], 2)
            dh = dh * z + drh * r + dzr @ u.transpose(0, 2, 1)
        ge = np.zeros((512, 3 * k), u.dtype)
        byte = (both.transpose(2, 0, 1).astype(np.int64) + np.array([[0], [256]])).ravel()
        order = np.argsort(byte, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(byte[order]) > 0))
        ge[byte[order][first]] = np.add.reduceat(inputs.reshape(-1, 3 * k)[order], first)
        return loss, g | {"U": gu, "V": gv, "E": ge.reshape(2, 256, 3 * k)}

    def fit(self, batches: Iterable[tuple[np.ndarray, np.ndarray]], rate: float = 0.01) -> ByteGRU:
        """batches: (bytes, labels), rows of equal length. Adam."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i, (x, y) in enumerate(batches, 1):
            _, g = self.gradients(x, y)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        return self
