"""A bidirectional LSTM over characters with a CRF on top, in numpy: training by gradients, decoding of many windows at once."""

from __future__ import annotations

import numpy as np

#: Codes of characters: ASCII as it is, one for all others, one for the place after the end.
OTHER, PAD, CODES = 128, 129, 130
NEVER = np.float32(-1e4)


def encode(windows: list[str], width: int) -> np.ndarray:
    """(windows, width) codes."""
    out = np.full((len(windows), width), PAD, np.int16)
    for row, w in zip(out, windows, strict=True):
        points = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        row[: len(points)] = np.minimum(points, OTHER)
    return out


def allowed(kinds: int) -> np.ndarray:
    """Transitions of the labels 0 (outside), 2 k + 1 (first of kind k), 2 k + 2 (further of kind k): further only after the same kind."""
    n = 2 * kinds + 1
    out = np.ones((n, n), bool)
    for k in range(kinds):
        inside = 2 * k + 2
        out[:, inside] = False
        out[[inside - 1, inside], inside] = True
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class BiLstmCrf:
    """Gates in the order input, forget, output (logistic) and candidate (tanh); both directions are stacked in axis 0."""

    def __init__(self, kinds: int, hidden: int = 16, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.kinds, self.hidden, self.labels = kinds, hidden, 2 * kinds + 1
        self.barred = np.where(allowed(kinds), np.float32(0), NEVER)
        scale = 1 / np.sqrt(hidden)
        draw = lambda *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"x": draw(2, CODES, 4 * hidden), "u": draw(2, hidden, 4 * hidden), "w": draw(2 * hidden, self.labels), "c": np.zeros(self.labels, np.float32), "t": np.zeros((self.labels, self.labels), np.float32), "s": np.zeros(self.labels, np.float32)}
        self.p["x"][:, :, hidden : 2 * hidden] += 1  # remember at first

    def _gates(self, z: np.ndarray) -> np.ndarray:
        """All four gates with one tanh: the logistic function is tanh of half, halved and moved."""
        cut = 3 * self.hidden
        z[..., :cut] *= np.float32(0.5)
        np.tanh(z, out=z)
        z[..., :cut] *= np.float32(0.5)
        z[..., :cut] += np.float32(0.5)
        return z

    def _run(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, batch, width, hidden) in reading order of each direction."""
        n, width = codes.shape
        d, (x, u) = self.hidden, (self.p["x"], self.p["u"])
        h = c = np.zeros((2, n, d), np.float32)
        out = np.empty((2, n, width, d), np.float32)
        for t in range(width):
            now = np.stack([x[0][codes[:, t]], x[1][codes[:, width - 1 - t]]])
            now += h @ u
            g = self._gates(now)
            before = c
            c = g[..., d : 2 * d] * c + g[..., :d] * g[..., 3 * d :]
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, g, tc))
            h = g[..., 2 * d : 3 * d] * tc
            out[:, :, t] = h
        return out

    def emissions(self, codes: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(batch, width, labels), and the states they come from (batch, width, 2 hidden). Places after the end are outside."""
        both = self._run(codes, keep)
        states = np.concatenate([both[0], both[1][:, ::-1]], axis=2)
        out = states @ self.p["w"] + self.p["c"]
        out[codes == PAD] = NEVER
        out[codes == PAD, 0] = 0
        return out, states

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (batch, width), and the probability of each; it is 1 throughout rows without a label."""
        e, _ = self.emissions(codes)
        n, width, labels = e.shape
        t = self.p["t"] + self.barred
        score = e[:, 0] + self.p["s"] + self.barred_first()
        back = np.empty((n, width, labels), np.int8)
        for i in range(1, width):
            ways = score[:, :, None] + t
            back[:, i] = best = ways.argmax(axis=1)
            score = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + e[:, i]
        out = np.empty((n, width), np.int8)
        out[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for i in range(width - 1, 0, -1):
            out[:, i - 1] = back[rows, i, out[:, i]]
        sure, some = np.ones((n, width), np.float32), np.flatnonzero(out.any(axis=1))
        if len(some):
            alpha, beta, z = self._both_ways(e[some])
            sure[some] = np.exp(np.take_along_axis(alpha + beta, out[some][:, :, None].astype(np.int64), 2)[:, :, 0] - z[:, None])
        return out, sure

    def _both_ways(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums of all label rows up to each place and after it, and of all."""
        width, t = e.shape[1], self.p["t"] + self.barred
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.p["s"] + self.barred_first()
        for i in range(1, width):
            alpha[:, i] = _logsumexp(alpha[:, i - 1][:, :, None] + t, 1) + e[:, i]
        for i in range(width - 2, -1, -1):
            beta[:, i] = _logsumexp(t + (beta[:, i + 1] + e[:, i + 1])[:, None, :], 2)
        return alpha, beta, _logsumexp(alpha[:, -1], 1)

    def barred_first(self) -> np.ndarray:
        out = np.zeros(self.labels, np.float32)
        out[2::2] = NEVER
        return out

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of label rows ``y``, and its gradients."""
        steps: list = []
        e, states = self.emissions(codes, steps)
        n, width, labels = e.shape
        rows, t = np.arange(n), self.p["t"] + self.barred
        first = self.p["s"] + self.barred_first()
        alpha, beta, z = self._both_ways(e)
        d_e = np.exp(alpha + beta - z[:, None, None])
        pairs = np.zeros((labels, labels), np.float64)
        for i in range(1, width):
            pairs += np.exp(alpha[:, i - 1][:, :, None] + t + (e[:, i] + beta[:, i] - z[:, None])[:, None, :]).sum(axis=0)
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        gold = e[rows[:, None], np.arange(width), y].sum(axis=1) + first[y[:, 0]] + t[y[:, :-1], y[:, 1:]].sum(axis=1)
        d_e[rows[:, None], np.arange(width), y] -= 1
        d_e /= n
        d_s = d_e[:, 0].sum(axis=0)
        d_e[codes == PAD] = 0
        g = {"t": (pairs / n).astype(np.float32), "s": d_s, "w": states.reshape(-1, states.shape[2]).T @ d_e.reshape(-1, labels), "c": d_e.sum(axis=(0, 1))}
        g |= self._back(codes, steps, d_e @ self.p["w"].T)
        return float((z - gold).mean()), g

    def _back(self, codes: np.ndarray, steps: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through time of both directions."""
        d, width = self.hidden, codes.shape[1]
        d_out = np.stack([d_states[:, :, :d], d_states[:, ::-1, d:]])
        d_x, d_u = np.zeros_like(self.p["x"]), np.zeros_like(self.p["u"])
        d_h = d_c = np.zeros_like(steps[0][0])
        u_t = self.p["u"].transpose(0, 2, 1)
        for t in range(width - 1, -1, -1):
            h, c, g, tc = steps[t]
            i, f, o, new = g[..., :d], g[..., d : 2 * d], g[..., 2 * d : 3 * d], g[..., 3 * d :]
            d_h = d_h + d_out[:, :, t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z = np.concatenate([d_c * new * i * (1 - i), d_c * c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - new * new)], axis=2)
            d_u += h.transpose(0, 2, 1) @ d_z
            for side, at in ((0, t), (1, width - 1 - t)):
                np.add.at(d_x[side], codes[:, at], d_z[side])
            d_h, d_c = d_z @ u_t, d_c * f
        return {"x": d_x, "u": d_u}

    def fit(self, codes: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.05, seed: int = 0) -> BiLstmCrf:
        """Adam on random batches, its rate falling to nothing."""
        r = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            rows = r.integers(0, len(codes), batch)
            _, g = self.gradients(codes[rows], y[rows])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * (1 - (step - 1) / steps)
            for k, v in g.items():
                v = v * np.float32(min(1.0, 5.0 / max(norm, 1e-6)))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self
