"""Forward passes of the two models over event tensors, in NumPy, with weights from a file of arrays.

Both encode each agent by itself: an LSTM by its last state, a Transformer by a token of its own before the frames. Two heads of one hidden
layer read the ego with the mean of its neighbours (conflict) and with each neighbour (target); slots without a neighbour score -inf.
Weights carry the names and shapes that the usual deep-learning library gives them, so a checkpoint saved as arrays can be used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Weights = dict[str, np.ndarray]
Scores = tuple[np.ndarray, np.ndarray]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def heads(w: Weights, h: np.ndarray, agents: np.ndarray) -> Scores:
    """(conflict logits [B], target logits [B, A - 1]) of encoded agents [B, A, H]."""
    def head(name: str, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(x @ w[f"{name}.0.weight"].T + w[f"{name}.0.bias"], 0)
        return (hidden @ w[f"{name}.2.weight"].T + w[f"{name}.2.bias"])[..., 0]

    ego, others, there = h[:, 0], h[:, 1:], agents[:, 1:].astype(bool)
    share = there[..., None].astype(h.dtype)
    pooled = (others * share).sum(1) / np.maximum(share.sum(1), 1e-6)
    conflict = head("conflict_head", np.concatenate([ego, pooled], -1))
    target = head("target_head", np.concatenate([np.repeat(ego[:, None], others.shape[1], 1), others], -1))
    return conflict, np.where(there, target, -np.inf)


def lstm(w: Weights, x: np.ndarray, agents: np.ndarray, blocked: np.ndarray | None = None, channels: np.ndarray | None = None) -> Scores:
    """x [B, A, T, F]; this model knows no masks, so masked values are read as zeros."""
    if channels is not None:
        x = np.where(channels, 0, x)
    if blocked is not None:
        x = np.where(blocked[..., None], 0, x)
    b, a, t, f = x.shape
    seq, size = x.reshape(b * a, t, f), w["encoder.weight_hh_l0"].shape[1]
    h = c = np.zeros((b * a, size))
    for k in range(t):
        i, forget, g, o = np.split(seq[:, k] @ w["encoder.weight_ih_l0"].T + h @ w["encoder.weight_hh_l0"].T + w["encoder.bias_ih_l0"] + w["encoder.bias_hh_l0"], 4, -1)
        c = sigmoid(forget) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
    return heads(w, h.reshape(b, a, size), agents)


def _norm(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    mean = x.mean(-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + 1e-5) * w[f"{name}.weight"] + w[f"{name}.bias"]


def transformer(w: Weights, x: np.ndarray, agents: np.ndarray, blocked: np.ndarray | None = None, channels: np.ndarray | None = None, n_heads: int = 4) -> Scores:
    """Masked values are zeros with a bit beside them; frames that are blocked, or masked in every channel, are not attended to."""
    b, a, t, f = x.shape
    if t > w["pos_embed"].shape[1]:
        raise ValueError(f"{t} frames, but the model has places for {w['pos_embed'].shape[1]}")
    bits = np.zeros(x.shape, bool) if channels is None else channels.astype(bool)
    away = bits.all(-1) if channels is not None else np.zeros(x.shape[:3], bool)
    if blocked is not None:
        bits, away = bits | blocked[..., None], away | blocked
    emb = np.concatenate([np.where(bits, 0, x), bits.astype(x.dtype)], -1) @ w["input_proj.weight"].T + w["input_proj.bias"] + w["pos_embed"][0, :t]
    size = emb.shape[-1]
    if size % n_heads:
        raise ValueError(f"{size} values cannot be dealt to {n_heads} heads")
    z = np.concatenate([np.repeat(w["cls_token"], b * a, 0), emb.reshape(b * a, t, size)], 1)
    unseen = np.concatenate([np.zeros((b * a, 1), bool), away.reshape(b * a, t)], 1)[:, None, None, :]
    layer = 0
    while f"encoder.layers.{layer}.linear1.weight" in w:
        name = f"encoder.layers.{layer}"
        q, k, v = np.split(z @ w[f"{name}.self_attn.in_proj_weight"].T + w[f"{name}.self_attn.in_proj_bias"], 3, -1)
        q, k, v = (m.reshape(b * a, t + 1, n_heads, -1).transpose(0, 2, 1, 3) for m in (q, k, v))
        score = np.where(unseen, -np.inf, q @ k.transpose(0, 1, 3, 2) / np.sqrt(size / n_heads))
        score = np.exp(score - score.max(-1, keepdims=True))
        mixed = (score / score.sum(-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(b * a, t + 1, size)
        z = _norm(w, f"{name}.norm1", z + mixed @ w[f"{name}.self_attn.out_proj.weight"].T + w[f"{name}.self_attn.out_proj.bias"])
        inner = np.maximum(z @ w[f"{name}.linear1.weight"].T + w[f"{name}.linear1.bias"], 0)
        z = _norm(w, f"{name}.norm2", z + inner @ w[f"{name}.linear2.weight"].T + w[f"{name}.linear2.bias"])
        layer += 1
    return heads(w, z[:, 0].reshape(b, a, size), agents)


MODELS: dict[str, Callable[..., Scores]] = {}


def register_model(name: str, forward: Callable[..., Scores]) -> None:
    MODELS[name] = forward


def build_model(name: str) -> Callable[..., Scores]:
    if name not in MODELS:
        raise KeyError(f"no model {name}; available: {sorted(MODELS)}")
    return MODELS[name]


for _name, _forward in (("baseline", lstm), ("baseline_binary", lstm), ("transformer", transformer)):
    register_model(_name, _forward)


def seeded_weights(name: str, features: int = 4, hidden: int = 16, frames: int = 80, layers: int = 2, seed: int = 0) -> Weights:
    """Weights drawn at random, for tests and examples; no trained model ships with this package."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape)
    w: Weights = {}
    for head in ("conflict_head", "target_head"):
        w |= {f"{head}.0.weight": draw(hidden, 2 * hidden), f"{head}.0.bias": draw(hidden), f"{head}.2.weight": draw(1, hidden), f"{head}.2.bias": draw(1)}
    if name != "transformer":
        return w | {"encoder.weight_ih_l0": draw(4 * hidden, features), "encoder.weight_hh_l0": draw(4 * hidden, hidden), "encoder.bias_ih_l0": draw(4 * hidden), "encoder.bias_hh_l0": draw(4 * hidden)}
    w |= {"input_proj.weight": draw(hidden, 2 * features), "input_proj.bias": draw(hidden), "cls_token": draw(1, 1, hidden), "pos_embed": draw(1, frames, hidden)}
    for k in range(layers):
        n = f"encoder.layers.{k}"
        w |= {f"{n}.self_attn.in_proj_weight": draw(3 * hidden, hidden), f"{n}.self_attn.in_proj_bias": draw(3 * hidden), f"{n}.self_attn.out_proj.weight": draw(hidden, hidden), f"{n}.self_attn.out_proj.bias": draw(hidden)}
        w |= {f"{n}.linear1.weight": draw(4 * hidden, hidden), f"{n}.linear1.bias": draw(4 * hidden), f"{n}.linear2.weight": draw(hidden, 4 * hidden), f"{n}.linear2.bias": draw(hidden)}
        w |= {f"{n}.norm{j}.{p}": np.full(hidden, float(p == "weight")) for j in (1, 2) for p in ("weight", "bias")}
    return w


def checkpoint_name(tag: str = "") -> str:
    return f"{tag}_best_model.pt" if tag else "best_model.pt"
