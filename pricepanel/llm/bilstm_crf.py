"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Sequences have one length and are worked on together, one step of all of them at a time. Tags: 0 outside,
then a first and an inner tag for each kind of span.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EMBED, HIDDEN = 12, 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _log_product(x: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Logarithm of exp(x) times a matrix, row by row."""
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.exp(x - top) @ chances)


@dataclass
class Tagger:
    params: dict[str, np.ndarray]

    @classmethod
    def create(cls, signs: int, tags: int, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (signs, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, tags)), "out_bias": np.zeros(tags),
             "move": np.zeros((tags, tags)), "first": np.zeros(tags)}
        for side in "fb":
            p[side + "x"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            p[side + "h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p[side + "bias"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _lstm(self, x: np.ndarray, side: str, keep: bool):
        """Outputs (steps, rows, hidden) of one direction, and what its gradient needs."""
        p, (steps, rows, _) = self.params, x.shape
        pre = x @ p[side + "x"] + p[side + "bias"]
        h = c = np.zeros((rows, HIDDEN), np.float32)
        out, saved = np.empty((steps, rows, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ p[side + "h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if keep:
                saved.append((t, i, f, o, g, s, before, h_before))
        return out, saved

    def _lstm_back(self, x, saved, grad, side: str, grads: dict):
        p = self.params
        dx, dh, dc = np.zeros_like(x), 0.0, 0.0
        for t, i, f, o, g, s, before, h_before in reversed(saved):
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads[side + "x"] += x[t].T @ dz
            grads[side + "h"] += h_before.T @ dz
            grads[side + "bias"] += dz.sum(axis=0)
            dx[t] = dz @ p[side + "x"].T
            dh, dc = dz @ p[side + "h"].T, dc * f
        return dx

    def emissions(self, signs: np.ndarray) -> np.ndarray:
        """Tag scores (rows, steps, tags) of sequences given as sign numbers (rows, steps)."""
        p = self.params
        x = p["embed"][signs.T]
        both = np.concatenate([self._lstm(x, side, False)[0] for side in "fb"], axis=2)
        return (both @ p["out"] + p["out_bias"]).transpose(1, 0, 2)

    def loss_and_gradient(self, signs: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.params
        rows, steps = signs.shape
        x = p["embed"][signs.T]
        sides = {side: self._lstm(x, side, True) for side in "fb"}
        both = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        e = (both @ p["out"] + p["out_bias"]).astype(np.float64)
        move, first = p["move"].astype(np.float64), p["first"].astype(np.float64)
        chances = np.exp(move)
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = first + e[0]
        for t in range(1, steps):
            ahead[t] = _log_product(ahead[t - 1], chances) + e[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = _log_product(e[t + 1] + behind[t + 1], chances.T)
        total = _log_sum(ahead[-1], 1)
        y, every = tags.T, np.arange(rows)
        at = np.arange(steps)[:, None]
        gold = first[y[0]] + e[at, every, y].sum(axis=0) + move[y[:-1], y[1:]].sum(axis=0)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        de = np.exp(ahead + behind - total[None, :, None])
        de[at, every, y] -= 1
        top = ahead[:-1].max(axis=2, keepdims=True)
        left, right = np.exp(ahead[:-1] - top), np.exp(e[1:] + behind[1:] + top - total[None, :, None])
        n = move.shape[0]
        met = np.bincount((y[:-1] * n + y[1:]).ravel(), minlength=n * n).reshape(n, n)
        grads["move"] += (chances * (left.reshape(-1, n).T @ right.reshape(-1, n)) - met).astype(grads["move"].dtype)
        grads["first"] += de[0].sum(axis=0).astype(np.float32)
        de = de.astype(np.float32)
        grads["out"] += both.reshape(-1, both.shape[2]).T @ de.reshape(-1, n)
        grads["out_bias"] += de.sum(axis=(0, 1))
        db = de @ p["out"].T
        dx = self._lstm_back(x, sides["f"][1], db[:, :, :HIDDEN], "f", grads) + self._lstm_back(x, sides["b"][1], db[:, :, HIDDEN:], "b", grads)
        np.add.at(grads["embed"], signs.T, dx)
        return float((total - gold).mean()), {k: v / rows for k, v in grads.items()}

    def train(self, signs: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over shuffled batches, at a rate that falls to a twentieth; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(x) for k, x in self.params.items()}
        step, losses = 0, []
        every = epochs * -(-len(signs) // batch)
        for _ in range(epochs):
            order, seen = rng.permutation(len(signs)), []
            for lo in range(0, len(order), batch):
                loss, grads = self.loss_and_gradient(signs[order[lo : lo + batch]], tags[order[lo : lo + batch]])
                seen.append(loss)
                step += 1
                now = rate * max(0.05, 1 - step / every)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.params[k] = (self.params[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (rows, steps) of padded sequences; places beyond a length get tag 0."""
        rows, steps, tags = emissions.shape
        move = self.params["move"]
        back = np.zeros((steps, rows, tags), np.int8)
        score = self.params["first"] + emissions[:, 0]
        for t in range(1, steps):
            sums = score[:, :, None] + move
            back[t] = sums.argmax(axis=1)
            inside = (t < lengths)[:, None]
            back[t] = np.where(inside, back[t], np.arange(tags))
            score = np.where(inside, sums.max(axis=1) + emissions[:, t], score)
        best, out = score.argmax(axis=1), np.zeros((rows, steps), np.int8)
        for t in range(steps - 1, -1, -1):
            out[:, t] = np.where(t < lengths, best, 0)
            best = back[t][np.arange(rows), best]
        return out
