"""A bidirectional gated recurrent network with attention pooling, forward and backward, in numpy.

Inputs are one vector per word, built from word evidence and character n-gram evidence; see toxicity.py.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return np.reciprocal(1 + np.exp(-np.clip(x, -30, 30)))


def new_parameters(inputs: int, hidden: int, attention: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {}
    for side in "fb":
        out[f"W{side}"] = draw(inputs, 3 * hidden)
        out[f"U{side}"] = draw(hidden, 3 * hidden)
        out[f"c{side}"] = np.zeros(3 * hidden, np.float32)
    return out | {"A": draw(2 * hidden, attention), "v": draw(attention), "w": draw(2 * hidden), "b": np.zeros(1, np.float32)}


def recur(x, mask, u, reverse: bool, keep: list | None):
    """Hidden states, steps x batch x hidden, from projected inputs (steps x batch x 3 hidden)."""
    steps, batch, hidden = x.shape[0], x.shape[1], u.shape[0]
    h = np.zeros((batch, hidden), np.float32)
    out = np.empty((steps, batch, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        hu = h @ u
        gates = sigmoid(x[t, :, : 2 * hidden] + hu[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        n = np.tanh(x[t, :, 2 * hidden :] + r * hu[:, 2 * hidden :])
        new = (n + z * (h - n)) * mask[t][:, None]
        if keep is not None:
            keep.append((t, h, hu[:, 2 * hidden :], z, r, n))
        h = out[t] = new
    return out


def recur_back(d_out, mask, u, kept):
    """Gradients of the projected inputs and of u."""
    hidden = u.shape[0]
    d_x = np.zeros((*d_out.shape[:2], 3 * hidden), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    for t, h, hn, z, r, n in reversed(kept):
        d = (d_out[t] + d_h) * mask[t][:, None]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * hn * r * (1 - r)
        d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ d_hu
        d_h = d * z + d_hu @ u.T
    return d_x, d_u


def pool(p, states, mask):
    """Attention over steps: (logits, weights, tanh layer, pooled states)."""
    u = np.tanh(states @ p["A"])
    s = np.where(mask > 0, u @ p["v"], np.float32(-1e9))
    e = np.exp(s - s.max(axis=0))
    a = e / e.sum(axis=0)
    c = np.einsum("tb,tbh->bh", a, states)
    return c @ p["w"] + p["b"][0], a, u, c


def logits(p, xf, xb, mask):
    """Scores of a batch of windows from inputs that are already projected for either direction."""
    states = np.concatenate([recur(xf, mask, p["Uf"], False, None), recur(xb, mask, p["Ub"], True, None)], axis=2)
    return pool(p, states, mask)[0]


def gradients(p, x, mask, target, weight):
    """Loss of weighted cross-entropy over windows, gradients of the parameters and of x (steps x batch x inputs)."""
    kept = {"f": [], "b": []}
    states = np.concatenate([recur(x @ p[f"W{s}"] + p[f"c{s}"], mask, p[f"U{s}"], s == "b", kept[s]) for s in "fb"], axis=2)
    out, a, u, c = pool(p, states, mask)
    prob = sigmoid(out)
    loss = -(weight * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).mean()
    d = (weight * (prob - target) / len(out)).astype(np.float32)
    g = {"w": c.T @ d, "b": np.array([d.sum()], np.float32)}
    d_c = d[:, None] * p["w"]
    d_a = np.einsum("bh,tbh->tb", d_c, states)
    d_states = a[:, :, None] * d_c
    d_s = a * (d_a - (a * d_a).sum(axis=0))
    g["v"] = np.einsum("tb,tbk->k", d_s, u)
    d_u = d_s[:, :, None] * p["v"] * (1 - u * u)
    g["A"] = np.einsum("tbh,tbk->hk", states, d_u)
    d_states = d_states + d_u @ p["A"].T
    hidden, d_inputs = p["Uf"].shape[0], np.zeros_like(x)
    for side, part in (("f", d_states[:, :, :hidden]), ("b", d_states[:, :, hidden:])):
        d_x, g[f"U{side}"] = recur_back(part, mask, p[f"U{side}"], kept[side])
        g[f"W{side}"] = np.einsum("tbi,tbo->io", x, d_x)
        g[f"c{side}"] = d_x.sum(axis=(0, 1))
        d_inputs += d_x @ p[f"W{side}"].T
    return loss, g, d_inputs


class Adam:
    def __init__(self, p, rate: float = 0.01):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p, g) -> None:
        self.step += 1
        for k in g:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.s[k] += 0.001 * (g[k] * g[k] - self.s[k])
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.s[k] / (1 - 0.999**self.step)) + 1e-8)).astype(p[k].dtype)
