"""A bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def new_params(n_in: int, hidden: int, attention: int, rng: np.random.Generator) -> Params:
    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)

    return {
        "W": small(2, n_in, 3 * hidden),
        "U": small(2, hidden, 3 * hidden),
        "b": np.zeros((2, 1, 3 * hidden), np.float32),
        "Wa": small(2 * hidden, attention),
        "ba": np.zeros(attention, np.float32),
        "v": small(attention),
        "wo": small(2 * hidden),
        "bo": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: Params, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows. inputs: a row for each kind of word; at: (steps, windows), the
    word at each step; mask: which steps a window has. keep: gets what `backward` needs."""
    steps, n = at.shape
    h = p["U"].shape[1]
    gates = np.matmul(inputs[None], p["W"]) + p["b"]
    out = np.empty((steps, n, 2 * h), np.float32)
    trace = []
    for d in range(2):
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g, u = gates[d][at[t]], state @ p["U"][d]
            zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
            m = mask[t][:, None]
            after = state + m * (1 - z) * (new - state)
            if keep is not None:
                trace.append((d, t, state, z, r, new, u[:, 2 * h :]))
            state = out[t, :, d * h : (d + 1) * h] = after
    lean = np.tanh(out @ p["Wa"] + p["ba"])
    weight = np.where(mask, lean @ p["v"], -1e9)
    weight = np.exp(weight - weight.max(0)) * mask
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, out)
    if keep is not None:
        keep |= {"out": out, "trace": trace, "lean": lean, "weight": weight, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"]


def backward(p: Params, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, kept: dict, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters and of the inputs."""
    h = p["U"].shape[1]
    out, weight, lean = kept["out"], kept["weight"], kept["lean"]
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    grad["wo"], grad["bo"] = kept["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["wo"]
    d_out = weight[:, :, None] * d_pooled[None]
    d_weight = np.einsum("nh,tnh->tn", d_pooled, out)
    d_lean = weight * (d_weight - (weight * d_weight).sum(0))
    grad["v"] = np.einsum("tn,tna->a", d_lean, lean)
    d_pre = d_lean[:, :, None] * p["v"] * (1 - lean**2)
    grad["Wa"], grad["ba"] = np.einsum("tnh,tna->ha", out, d_pre), d_pre.sum((0, 1))
    d_out = d_out + d_pre @ p["Wa"].T
    d_gates = np.zeros((2, len(inputs), 3 * h), np.float32)
    d_state = [np.zeros((at.shape[1], h), np.float32) for _ in range(2)]
    for d, t, state, z, r, new, u in reversed(kept["trace"]):
        total = d_state[d] + d_out[t, :, d * h : (d + 1) * h]
        step = total * mask[t][:, None]
        d_new = step * (1 - z) * (1 - new**2)
        d_z = step * (state - new) * z * (1 - z)
        d_r = d_new * u * r * (1 - r)
        d_g = np.concatenate([d_z, d_r, d_new], 1)
        d_u = np.concatenate([d_z, d_r, d_new * r], 1)
        np.add.at(d_gates[d], at[t], d_g)
        grad["U"][d] += state.T @ d_u
        d_state[d] = total - step * (1 - z) + d_u @ p["U"][d].T
    grad["W"] = np.matmul(inputs.T[None], d_gates)
    grad["b"] = d_gates.sum(1, keepdims=True)
    return grad, np.matmul(d_gates, p["W"].transpose(0, 2, 1)).sum(0)


class Adam:
    """decay: of parameters by name; others decay by 1e-4."""

    def __init__(self, rate: float, decay: dict[str, float] | None = None):
        self.rate, self.decay, self.n, self.m, self.s = rate, decay or {}, 0, {}, {}

    def step(self, p: Params, grad: Params) -> None:
        self.n += 1
        for k, g in grad.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            s = self.s[k] = 0.999 * self.s.get(k, 0) + 0.001 * g**2
            p[k] -= self.rate * (m / (1 - 0.9**self.n) / (np.sqrt(s / (1 - 0.999**self.n)) + 1e-8) + self.decay.get(k, 1e-4) * p[k])
