"""Gated recurrent cells in numpy, with samples in columns."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.negative(x, out=out)
    np.minimum(out, 60.0, out=out)
    np.exp(out, out=out)
    out += 1.0
    return np.reciprocal(out, out=out)


def init_cell(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    return {"U": rng.normal(0, 0.4 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)}


def step(U: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The next state. x (3H, B): input part of the update, reset and new gates; h (H, B)."""
    H = len(h)
    a = U @ h
    gates = a[: 2 * H]
    gates += x[: 2 * H]
    sigmoid(gates, out=gates)
    new = a[2 * H :]
    new *= gates[H:]
    new += x[2 * H :]
    np.tanh(new, out=new)
    d = h - new
    d *= gates[:H]
    d += new
    return d


def forward(U: np.ndarray, xs: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """States (T, H, B) after each input of xs (T, 3H, B). keep (T, B): 0 where a state starts anew before the input."""
    H = len(h)
    states, cache = np.empty((len(xs), *h.shape), dtype=xs.dtype), []
    for t, x in enumerate(xs):
        if keep is not None:
            h = h * keep[t]
        a = U @ h
        z, r = sigmoid(a[:H] + x[:H]), sigmoid(a[H : 2 * H] + x[H : 2 * H])
        n = np.tanh(x[2 * H :] + r * a[2 * H :])
        cache.append((h, z, r, n, a[2 * H :]))
        h = n + z * (h - n)
        states[t] = h
    return states, cache


def backward(U: np.ndarray, cache: list, d_states: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by inputs (T, 3H, B) and by U, from those by states. Nothing flows past the first input."""
    T, H, B = d_states.shape
    d_xs = np.empty((T, 3 * H, B), dtype=d_states.dtype)
    d_U = np.zeros_like(U)
    d_h = np.zeros((H, B), dtype=d_states.dtype)
    for t in range(T - 1, -1, -1):
        h, z, r, n, an = cache[t]
        d = d_h + d_states[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * an * r * (1 - r)
        d_x = d_xs[t]
        d_x[:H], d_x[H : 2 * H], d_x[2 * H :] = d_z, d_r, d_n
        d_a = np.concatenate((d_z, d_r, d_n * r))
        d_U += d_a @ h.T
        d_h = d * z + U.T @ d_a
        if keep is not None:
            d_h = d_h * keep[t]
    return d_xs, d_U


class Adam:
    """Steps for a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, clip / max(norm, 1e-9))
        size = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (size * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)
