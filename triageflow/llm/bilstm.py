"""Bidirectional LSTM in numpy: forward, backward through time, Adam.

Arrays are time-major: (T, B, ...). ``mask`` (T, B) is 1 on real steps; a masked
step keeps the state, so padding never leaks into a sequence.
"""

from __future__ import annotations

import numpy as np


def _gates(z: np.ndarray, h: int) -> tuple[np.ndarray, ...]:
    s = 0.5 + 0.5 * np.tanh(0.5 * z[:, :3 * h])
    return s[:, :h], s[:, h:2 * h], s[:, 2 * h:], np.tanh(z[:, 3 * h:])


def run(x: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction; ``x`` holds the input part of the gates."""
    steps, rows, wide = x.shape
    h = wide // 4
    out = np.zeros((steps, rows, h), x.dtype)
    state, cell = np.zeros((rows, h), x.dtype), np.zeros((rows, h), x.dtype)
    for t in range(steps):
        i, f, o, g = _gates(x[t] + state @ wh, h)
        m = mask[t][:, None]
        new = f * cell + i * g
        squashed = np.tanh(new)
        if keep is not None:
            keep.append((i, f, o, g, cell, state, squashed, m))
        cell = np.where(m > 0, new, cell)
        state = np.where(m > 0, o * squashed, state)
        out[t] = state
    return out


def back(dout: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' input part and of ``wh``."""
    steps, rows, h = dout.shape
    dx, dwh = np.zeros((steps, rows, 4 * h), dout.dtype), np.zeros_like(wh)
    dstate, dcell = np.zeros((rows, h), dout.dtype), np.zeros((rows, h), dout.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, cell, state, squashed, m = kept[t]
        dh = (dout[t] + dstate)
        dc = dcell + m * dh * o * (1 - squashed ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], 1) * m
        dx[t] = dz
        dwh += state.T @ dz
        dstate = dz @ wh.T + (1 - m) * dh
        dcell = np.where(m > 0, dc * f, dcell)
    return dx, dwh


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            up = (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)
            self.params[k] -= ((rate or self.rate) * up).astype(self.params[k].dtype)


def start(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * (0.5 / np.sqrt(max(1, shape[0])))).astype(np.float32)
