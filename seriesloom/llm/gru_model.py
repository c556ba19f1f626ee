"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A token's input is its word vector, a vector for its first ``HEAD_BYTES`` bytes
and the last states of a bidirectional gated layer over all its bytes. A second bidirectional gated layer
runs over the tokens of a window; attention pools its states for a logistic
output.
"""

from __future__ import annotations

import numpy as np

WORD, HEAD, CHAR, CHAR_STATE, STATE, ATTEND = 8, 4, 6, 6, 8, 8
HEAD_BYTES = 4
#: Bytes of one token; longer words are cut into several.
TOKEN_BYTES = 16
WINDOW, STRIDE = 48, 32
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """All runs of letters, digits and non-ASCII bytes, lower-cased."""
    found = text.translate(_LETTERS).split()
    if found and max(map(len, found)) > TOKEN_BYTES:
        found = [w[i : i + TOKEN_BYTES] for w in found for i in range(0, len(w), TOKEN_BYTES)]
    return found


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n tokens; the last ends with them."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def gru(p: np.ndarray, u: np.ndarray, mask: np.ndarray | None, reverse: bool, keep: bool = False):
    """States (B, T, H) for input projections p (B, T, 3H); masked steps carry the state on."""
    b, t, h3 = p.shape
    n = h3 // 3
    h = np.zeros((b, n), np.float32)
    out, caches = np.empty((b, t, n), np.float32), []
    for i in range(t - 1, -1, -1) if reverse else range(t):
        a = h @ u
        zr = sigmoid(p[:, i, : 2 * n] + a[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(p[:, i, 2 * n :] + r * a[:, 2 * n :])
        new = c + z * (h - c)
        if mask is not None:
            new = np.where(mask[:, i, None], new, h)
        if keep:
            caches.append((i, h, z, r, c, a[:, 2 * n :]))
        h = new
        out[:, i] = h
    return out, caches


def gru_back(d: np.ndarray, u: np.ndarray, mask: np.ndarray | None, caches) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projections and of u from those of the states."""
    b, t, n = d.shape
    dp, du, dh = np.zeros((b, t, 3 * n), np.float32), np.zeros_like(u), np.zeros((b, n), np.float32)
    for i, h, z, r, c, an in reversed(caches):
        g = dh + d[:, i]
        live = g if mask is None else np.where(mask[:, i, None], g, 0)
        dc = live * (1 - z) * (1 - c * c)
        dz = live * (h - c) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        dp[:, i] = np.concatenate([dz, dr, dc], axis=1)
        du += h.T @ da
        dh = da @ u.T + live * z + (0 if mask is None else np.where(mask[:, i, None], 0, g))
    return dp, du


class Model:
    def __init__(self, vocabulary: dict[bytes, int], heads: dict[bytes, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        x = WORD + HEAD + 2 * CHAR_STATE
        self.vocabulary, self.heads = vocabulary, heads
        self.p = {
            "word": (rng.standard_normal((len(vocabulary) + 1, WORD)) * 0.1).astype(np.float32), "head": (rng.standard_normal((len(heads) + 1, HEAD)) * 0.1).astype(np.float32), "char": make(256, CHAR) * 4,
            "v": make(ATTEND), "wa": make(2 * STATE, ATTEND), "ba": np.zeros(ATTEND, np.float32), "wo": make(2 * STATE), "bo": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"cw{d}": make(CHAR, 3 * CHAR_STATE), f"cu{d}": make(CHAR_STATE, 3 * CHAR_STATE), f"cb{d}": np.zeros(3 * CHAR_STATE, np.float32)}
            self.p |= {f"w{d}": make(x, 3 * STATE), f"u{d}": make(STATE, 3 * STATE), f"b{d}": np.zeros(3 * STATE, np.float32)}

    def encode(self, words: list[bytes], keep: bool = False):
        """Inputs (U, x) of distinct tokens."""
        p = self.p
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        heads = np.array([self.heads.get(w[:HEAD_BYTES], 0) for w in words], np.int64)
        size = np.array([len(w) for w in words], np.int64)
        t = int(size.max(initial=1))
        data = np.frombuffer(b"".join(w.ljust(t, b"\0") for w in words), np.uint8).reshape(len(words), t)
        mask = np.arange(t)[None, :] < size[:, None]
        last, caches = [], []
        for d in "fb":
            q = (p["char"] @ p[f"cw{d}"] + p[f"cb{d}"])[data]
            states, cache = gru(q, p[f"cu{d}"], mask, d == "b", keep)
            last.append(states[:, -1] if d == "f" else states[:, 0])
            caches.append(cache)
        return np.concatenate([p["word"][ids], p["head"][heads], *last], axis=1), (ids, heads, data, mask, caches)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]

    def windows(self, pf: np.ndarray, pb: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Probability of each window of token rows ``at`` (B, T)."""
        p = self.p
        f, cf = gru(pf[at], p["uf"], mask, False, keep)
        b, cb = gru(pb[at], p["ub"], mask, True, keep)
        h = np.concatenate([f, b], axis=2)
        k = np.tanh(h @ p["wa"] + p["ba"])
        e = k @ p["v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = (h * alpha[..., None]).sum(axis=1)
        y = sigmoid(pooled @ p["wo"] + p["bo"][0])
        return y, (cf, cb, h, k, alpha, pooled)

    def gradients(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        x, (ids, heads, data, cmask, caches) = self.encode(words, keep=True)
        pf, pb = self.project(x)
        out, (cf, cb, h, k, alpha, pooled) = self.windows(pf, pb, at, mask, keep=True)
        d = ((out - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * p["wo"][None, :]
        dalpha = (h * dpool[:, None, :]).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
        dk = de[..., None] * p["v"] * (1 - k * k)
        g["v"] = np.tensordot(de, k, ([0, 1], [0, 1]))
        g["wa"], g["ba"] = np.tensordot(h, dk, ([0, 1], [0, 1])), dk.sum(axis=(0, 1))
        dh = alpha[..., None] * dpool[:, None, :] + dk @ p["wa"].T
        dx = np.zeros_like(x)
        order = np.argsort(at.ravel(), kind="stable")
        row, first = np.unique(at.ravel()[order], return_index=True)
        for name, dd, cache in (("f", dh[..., :STATE], cf), ("b", dh[..., STATE:], cb)):
            dp, g[f"u{name}"] = gru_back(dd, p[f"u{name}"], mask, cache)
            per = np.zeros((len(x), 3 * STATE), np.float32)
            per[row] = np.add.reduceat(dp.reshape(-1, 3 * STATE)[order], first)
            g[f"w{name}"], g[f"b{name}"] = x.T @ per, per.sum(axis=0)
            dx += per @ p[f"w{name}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], ids, dx[:, :WORD])
        g["head"] = np.zeros_like(p["head"])
        np.add.at(g["head"], heads, dx[:, WORD : WORD + HEAD])
        g["char"] = np.zeros_like(p["char"])
        for i, name in enumerate("fb"):
            ds = np.zeros((len(x), data.shape[1], CHAR_STATE), np.float32)
            ds[:, -1 if name == "f" else 0] = dx[:, WORD + HEAD + i * CHAR_STATE : WORD + HEAD + (i + 1) * CHAR_STATE]
            dp, g[f"cu{name}"] = gru_back(ds, p[f"cu{name}"], cmask, caches[i])
            flat = dp.reshape(-1, 3 * CHAR_STATE)
            per = np.stack([np.bincount(data.ravel(), weights=flat[:, j], minlength=256) for j in range(flat.shape[1])], axis=1).astype(np.float32)
            g[f"cw{name}"], g[f"cb{name}"] = p["char"].T @ per, per.sum(axis=0)
            g["char"] += per @ p[f"cw{name}"].T
        return g

    def adam(self, g: dict[str, np.ndarray], rate: float) -> None:
        if not hasattr(self, "moments"):
            self.moments, self.steps = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        self.steps += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, x in g.items():
            m, v = self.moments[k]
            m += 0.1 * (x * scale - m)
            v += 0.001 * ((x * scale) ** 2 - v)
            self.p[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)).astype(np.float32)


def batch_of(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, their rows (B, T) and the mask of a batch of windows."""
    index: dict[bytes, int] = {}
    t = max(len(w) for w in windows)
    at, mask = np.zeros((len(windows), t), np.int64), np.zeros((len(windows), t), bool)
    for i, w in enumerate(windows):
        at[i, : len(w)] = [index.setdefault(x, len(index)) for x in w]
        mask[i, : len(w)] = True
    return list(index), at, mask


def _odds(sets: list[tuple[int, set[bytes]]], most: int, least: int) -> dict[bytes, float]:
    """Smoothed log odds of the keys that at least ``least`` documents have."""
    seen: dict[bytes, list[int]] = {}
    for y, keys in sets:
        for k in keys:
            seen.setdefault(k, [0, 0])[y] += 1
    n1 = sum(y for y, _ in sets)
    n0 = len(sets) - n1
    common = sorted((k for k, (a, b) in seen.items() if a + b >= least), key=lambda k: (-sum(seen[k]), k))[:most]
    return {k: float(np.clip(np.log((seen[k][1] + 0.5) / (n1 + 1)) - np.log((seen[k][0] + 0.5) / (n0 + 1)), -3, 3)) for k in common}


def train(bags: list[tuple[int, list[list[bytes]]]], steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 7, most: int = 20_000, least: int = 3, odds_start: bool = True) -> Model | None:
    """Fit on (label, windows) bags. A toxic document teaches by its likeliest window only, all windows compete.

    ``steps`` is the least number of updates, in whole passes over the bags; of
    a clean document two windows, drawn anew in each pass, are shown. Words (and
    word beginnings) that at least ``least`` bags have, the ``most`` commonest of
    them, have vectors of their own; others are known by their bytes. With
    ``odds_start`` word vectors start, in one place, with the smoothed log odds
    of the word among the labelled documents, and so do those of word beginnings.
    Without both labels there is no model.
    """
    bags = [b for b in bags if b[1]]
    if len({y for y, _ in bags}) < 2:
        return None
    words_of = [(y, {x for w in windows for x in w}) for y, windows in bags]
    odds = _odds(words_of, most, least)
    head_odds = _odds([(y, {x[:HEAD_BYTES] for x in words}) for y, words in words_of], most, least)
    model = Model({w: i + 1 for i, w in enumerate(odds)}, {w: i + 1 for i, w in enumerate(head_odds)}, seed)
    if odds_start:
        model.p["word"][1:, 0] = list(odds.values())
        model.p["head"][1:, 0] = list(head_odds.values())
    rng = np.random.default_rng(seed)
    flat = [(i, w) for i, (y, windows) in enumerate(bags) if y for w in windows]
    per_epoch = -(-(sum(y for y, _ in bags) + sum(min(2, len(w)) for y, w in bags if not y)) // batch)
    epochs = max(2, -(-steps // per_epoch))
    for epoch in range(epochs):
        best: dict[int, tuple[float, list[bytes]]] = {}
        for a in range(0, len(flat), 1024):
            part = flat[a : a + 1024]
            words, at, mask = batch_of([w for _, w in part])
            if epoch:
                score = model.windows(*model.project(model.encode(words)[0]), at, mask)[0]
            else:  # by log odds, before anything is learnt
                value = np.array([odds.get(w, 0.0) + head_odds.get(w[:HEAD_BYTES], 0.0) for w in words])
                score = np.where(mask, value[at], -9).max(axis=1)
            for (i, w), s in zip(part, score.tolist(), strict=True):
                if i not in best or s > best[i][0]:
                    best[i] = (s, w)
        chosen = [(1, w) for _, w in best.values()]
        for y, windows in bags:
            if not y:
                chosen += [(0, windows[j]) for j in rng.permutation(len(windows))[:2]]
        order = rng.permutation(len(chosen))
        for a in range(0, len(order), batch):
            part = [chosen[i] for i in order[a : a + batch]]
            words, at, mask = batch_of([w for _, w in part])
            model.adam(model.gradients(words, at, mask, np.array([y for y, _ in part], np.float32)), rate / (1 + 4 * epoch / epochs))
    del model.moments
    return model
