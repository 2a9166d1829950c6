"""A character-level bidirectional LSTM with CRF transitions in numpy: training and decoding.

Gates and units are piecewise linear (clipped), which costs a few plain operations a character.
"""

from __future__ import annotations

import numpy as np

MARKS = " .,@-_+()%:;='/[]\n\t#&*\"<>|!?"
_CODE = {c: 28 + i for i, c in enumerate(MARKS)}
VOCABULARY = 28 + len(MARKS) + 2
#: Fixed classes by code point below 128: letters one by one, capitals, digits, marks, the rest.
_ASCII = np.array([ord(chr(c)) - 97 if "a" <= chr(c) <= "z" else 26 if "A" <= chr(c) <= "Z" else 27 if chr(c).isdigit() else _CODE.get(chr(c), VOCABULARY - 2) for c in range(128)], np.uint8)


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _ASCII[np.minimum(code, 127)], np.uint8(VOCABULARY - 1))


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """tags: 0 is outside. Gates are clip(z + 1/2, 0, 1), units clip(z, -1, 1)."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, tags
        g = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"W0": g(VOCABULARY, 4 * hidden), "U0": g(hidden, 4 * hidden), "W1": g(VOCABULARY, 4 * hidden), "U1": g(hidden, 4 * hidden), "O": g(2 * hidden, tags), "c": np.zeros(tags, np.float32), "A": g(tags, tags), "s": np.zeros(tags, np.float32)}
        for w in ("W0", "W1"):
            self.p[w][:, hidden : 2 * hidden] += 0.25  # forget less at first

    def _lstm(self, x: np.ndarray, side: int, keep: bool):
        """Hidden states of x (time, batch); side 1 runs backwards."""
        w, u, h_ = self.p[f"W{side}"].copy(), self.p[f"U{side}"], self.h
        w[:, : 3 * h_] += w.dtype.type(0.5)
        t, b = x.shape
        hs, cache = np.empty((t, b, h_), w.dtype), []
        h, c = np.zeros((b, h_), w.dtype), np.zeros((b, h_), w.dtype)
        for i in range(t)[:: -1 if side else 1]:
            z = h @ u
            z += w.take(x[i], axis=0)
            g, n = z[:, : 3 * h_], z[:, 3 * h_ :]
            np.clip(g, 0, 1, out=g)
            np.clip(n, -1, 1, out=n)
            old, before = c, h
            c = g[:, h_ : 2 * h_] * c
            c += g[:, :h_] * n
            tc = np.clip(c, -1, 1)
            h = np.multiply(g[:, 2 * h_ :], tc, out=hs[i])
            if keep:
                cache.append((i, g, n, old, before, tc))
        return hs, cache

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emission scores (time, batch, tags) of x (time, batch)."""
        o, h_ = self.p["O"], self.h
        return self._lstm(x, 0, False)[0] @ o[:h_] + self._lstm(x, 1, False)[0] @ o[h_:] + self.p["c"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """The mean negative log likelihood of tags y and its gradients."""
        p, h_, (t, b) = self.p, self.h, x.shape
        sides = [self._lstm(x, 0, True), self._lstm(x, 1, True)]
        both = np.concatenate([sides[0][0], sides[1][0]], 2)
        e = both @ p["O"] + p["c"]
        a = np.zeros_like(e)
        a[0] = e[0] + p["s"]
        for i in range(1, t):
            a[i] = e[i] + _lse(a[i - 1][:, :, None] + p["A"], 1)
        z = _lse(a[-1], 1)
        back = np.zeros_like(e)
        for i in range(t - 2, -1, -1):
            back[i] = _lse(p["A"] + (e[i + 1] + back[i + 1])[:, None, :], 2)
        de = np.exp(a + back - z[:, None])
        at = np.arange(b)
        gold = p["s"][y[0]] + sum(e[i, at, y[i]] for i in range(t)) + sum(p["A"][y[i - 1], y[i]] for i in range(1, t))
        da = np.zeros_like(p["A"])
        for i in range(1, t):
            da += np.exp(a[i - 1][:, :, None] + p["A"] + (e[i] + back[i])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(da, (y[i - 1], y[i]), -1)
        de[np.arange(t)[:, None], at, y] -= 1
        g = {"A": da, "s": de[0].sum(0), "c": de.sum((0, 1)), "O": np.einsum("tbh,tbk->hk", both, de)}
        dboth = de @ p["O"].T
        for side in (0, 1):
            w, u = np.zeros_like(p[f"W{side}"]), np.zeros_like(p[f"U{side}"])
            dh, dc = np.zeros((b, h_), e.dtype), np.zeros((b, h_), e.dtype)
            for i, s, n, old, before, tc in reversed(sides[side][1]):
                dh = dh + dboth[i, :, side * h_ : (side + 1) * h_]
                gi, gf, go = s[:, :h_], s[:, h_ : 2 * h_], s[:, 2 * h_ :]
                dc = dc + dh * go * (np.abs(tc) < 1)
                live = np.concatenate([(s > 0) & (s < 1), np.abs(n) < 1], 1)
                dz = np.concatenate([dc * n, dc * old, dh * tc, dc * gi], 1) * live
                np.add.at(w, x[i], dz)
                u += before.T @ dz
                dh, dc = dz @ p[f"U{side}"].T, dc * gf
            g |= {f"W{side}": w, f"U{side}": u}
        return float((z - gold).mean()), {k: v / b for k, v in g.items()}

    def train(self, batches, rate: float = 0.02) -> list[float]:
        """Adam over (x, y) batches; the rate falls to a tenth."""
        batches = list(batches)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for n, (x, y) in enumerate(batches, 1):
            loss, g = self.gradients(x, y)
            losses.append(loss)
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            scale, now = min(1.0, 5 / (norm + 1e-9)), rate * (1 - 0.9 * n / len(batches))
            for k in self.p:
                d = g[k] * scale
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.99 * v2[k] + 0.01 * d * d
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v2[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return losses

    def best(self, e: np.ndarray) -> np.ndarray:
        """The best tags (time, batch) for emission scores (time, batch, tags), all of the batch together."""
        t, b, _ = e.shape
        e, a = np.ascontiguousarray(e.transpose(0, 2, 1)), self.p["A"][:, :, None]
        v, back = e[0] + self.p["s"][:, None], np.zeros((t, self.k, b), np.uint8)
        for i in range(1, t):
            top = v[0] + a[0]
            for k in range(1, self.k):
                new = v[k] + a[k]
                np.copyto(back[i], k, where=new > top)
                np.maximum(top, new, out=top)
            v = np.add(top, e[i], out=top)
        out, at = np.zeros((t, b), np.uint8), np.arange(b)
        out[-1] = v.argmax(0)
        for i in range(t - 1, 0, -1):
            out[i - 1] = back[i][out[i], at]
        return out
