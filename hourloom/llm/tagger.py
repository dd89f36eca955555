"""A character-level bidirectional LSTM with CRF transitions in NumPy: training, and decoding of long stretches.

A stretch is read in overlapping windows. Where windows overlap, their emissions are averaged with weights that fall
towards a window's edge, and one pass of the CRF over the whole stretch reconciles them into one tagging.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class TaggerConfig:
    window: int = 64
    stride: int = 32
    embed: int = 12
    hidden: int = 16
    steps: int = 200
    batch: int = 48
    rate: float = 0.01
    seed: int = 11


CODES = 98


def char_codes(text: str) -> np.ndarray:
    """Printable ASCII by itself, white space as one, everything else as one; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where((points > 32) & (points < 127), points - 31, np.where((points == 32) | ((points >= 9) & (points <= 13)), 1, 97))


def _sig(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """`tags` BIO tags: 0 outside, 1 + 2k begins and 2 + 2k continues kind k."""

    def __init__(self, kinds: int, config: TaggerConfig = TaggerConfig()):
        rng = np.random.default_rng(config.seed)
        self.config, self.tags = config, 1 + 2 * kinds
        d, h, k = config.embed, config.hidden, self.tags
        self.p = {
            "embed": rng.normal(0, 0.3, (CODES, d)),
            "cell0": rng.normal(0, 0.25, (d + h, 4 * h)),
            "bias0": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]),
            "cell1": rng.normal(0, 0.25, (d + h, 4 * h)),
            "bias1": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]),
            "out": rng.normal(0, 0.25, (2 * h, k)),
            "level": np.zeros(k),
            "move": np.zeros((k, k)),
        }
        self.barred = np.zeros((k, k))
        self.barred_start = np.zeros(k)
        for kind in range(kinds):
            self.barred[:, 2 + 2 * kind] = -1e4
            self.barred[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = 0.0
            self.barred_start[2 + 2 * kind] = -1e4

    # --- network ----------------------------------------------------------------------------------------------------

    def _run(self, x, cell, bias, keep):
        """One direction over x (time, batch, size)."""
        steps, batch, _ = x.shape
        hidden = self.config.hidden
        h, c = np.zeros((batch, hidden)), np.zeros((batch, hidden))
        seen = x @ cell[: x.shape[2]] + bias
        recurrent = cell[x.shape[2] :]
        out, saved = np.empty((steps, batch, hidden)), []
        for t in range(steps):
            z = seen[t] + h @ recurrent
            gates, g = _sig(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                saved.append((before, i, f, o, g, tc))
        return out, saved

    def _run_back(self, x, cell, saved, dout):
        hidden, size = self.config.hidden, x.shape[2]
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dz = np.empty((len(dout), dout.shape[1], 4 * hidden))
        recurrent, drec = cell[size:], np.zeros((hidden, 4 * hidden))
        for t in range(len(dout) - 1, -1, -1):
            (h0, c0), i, f, o, g, tc = saved[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc**2)
            z = dz[t]
            z[:, :hidden] = dc * g * i * (1 - i)
            z[:, hidden : 2 * hidden] = dc * c0 * f * (1 - f)
            z[:, 2 * hidden : 3 * hidden] = dh * tc * o * (1 - o)
            z[:, 3 * hidden :] = dc * i * (1 - g**2)
            drec += h0.T @ z
            dh, dc = z @ recurrent.T, dc * f
        flat = dz.reshape(-1, 4 * hidden)
        dcell = np.concatenate([x.reshape(-1, size).T @ flat, drec])
        return dcell, flat.sum(axis=0), dz @ cell[:size].T

    def emissions(self, codes: np.ndarray, keep: bool = False):
        """(time, batch, tags) for codes (batch, time)."""
        x = self.p["embed"][codes.T]
        ahead, saved0 = self._run(x, self.p["cell0"], self.p["bias0"], keep)
        back, saved1 = self._run(x[::-1], self.p["cell1"], self.p["bias1"], keep)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        e = both @ self.p["out"] + self.p["level"]
        return (e, x, both, saved0, saved1) if keep else e

    # --- CRF --------------------------------------------------------------------------------------------------------

    def _posteriors(self, e: np.ndarray, lengths: np.ndarray | None = None):
        """Log partition, tag posteriors and summed pair posteriors of emissions (time, batch, tags)."""
        move = self.p["move"] + self.barred
        steps, batch, k = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.barred_start
        for t in range(1, steps):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
            if lengths is not None:
                alpha[t] = np.where((t < lengths)[:, None], alpha[t], alpha[t - 1])
        whole = _logsum(alpha[-1], 1)
        pairs = np.zeros((k, k))
        for t in range(steps - 2, -1, -1):
            after = (e[t + 1] + beta[t + 1])[:, None, :] + move
            beta[t] = _logsum(after, 2)
            if lengths is not None:
                beta[t] = np.where((t + 1 < lengths)[:, None], beta[t], 0.0)
            else:
                pairs += np.exp(alpha[t][:, :, None] + after - whole[:, None, None]).sum(axis=0)
        return whole, np.exp(alpha + beta - whole[None, :, None]), pairs

    def _best_path(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        move = self.p["move"] + self.barred
        steps, batch, k = e.shape
        score, came = e[0] + self.barred_start, np.zeros((steps, batch, k), dtype=np.int8)
        for t in range(1, steps):
            options = score[:, :, None] + move
            came[t] = options.argmax(axis=1)
            moved = options.max(axis=1) + e[t]
            inside = (t < lengths)[:, None]
            score = np.where(inside, moved, score)
            came[t] = np.where(inside, came[t], np.arange(k))
        path = np.empty((steps, batch), dtype=np.int8)
        path[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = came[t][np.arange(batch), path[t]]
        return path

    # --- training ---------------------------------------------------------------------------------------------------

    def gradients(self, codes: np.ndarray, tags: np.ndarray):
        """Loss and its gradients for windows (batch, time) of codes and tags."""
        e, x, both, saved0, saved1 = self.emissions(codes, keep=True)
        y = tags.T
        steps, batch = y.shape
        whole, post, pairs = self._posteriors(e)
        move = self.p["move"] + self.barred
        gold = np.take_along_axis(e, y[:, :, None], 2).sum(axis=(0, 2)) + move[y[:-1], y[1:]].sum(axis=0) + self.barred_start[y[0]]
        de = post.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de /= batch
        dmove = pairs / batch
        np.add.at(dmove, (y[:-1].ravel(), y[1:].ravel()), -1.0 / batch)
        g = {"out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, self.tags), "level": de.sum(axis=(0, 1)), "move": dmove * (self.barred == 0)}
        dboth = de @ self.p["out"].T
        h = self.config.hidden
        g["cell0"], g["bias0"], dx0 = self._run_back(x, self.p["cell0"], saved0, dboth[:, :, :h])
        g["cell1"], g["bias1"], dx1 = self._run_back(x[::-1], self.p["cell1"], saved1, dboth[::-1, :, h:])
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], codes.T, dx0 + dx1[::-1])
        return float((whole - gold).mean()), g

    def fit(self, codes: np.ndarray, tags: np.ndarray) -> list[float]:
        """Adam over random batches of windows; returns the losses."""
        c, losses = self.config, []
        rng = np.random.default_rng(c.seed + 1)
        first, second = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        for step in range(1, c.steps + 1):
            own = rng.choice(len(codes), min(c.batch, len(codes)), replace=False)
            loss, g = self.gradients(codes[own], tags[own])
            losses.append(loss)
            scale = min(1.0, 5.0 / (np.sqrt(sum((v**2).sum() for v in g.values())) + 1e-9))
            rate = c.rate * min(1.0, 2.0 * (1.0 - step / (c.steps + 1)))
            for n, v in g.items():
                v = v * scale
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.999 * second[n] + 0.001 * v**2
                self.p[n] = self.p[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        return losses

    # --- decoding ---------------------------------------------------------------------------------------------------

    def stretch_emissions(self, stretches: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """Emissions (length, tags) of every stretch, averaged over its overlapping windows."""
        size, stride = self.config.window, self.config.stride
        places = [(s, a) for s, codes in enumerate(stretches) for a in range(0, max(1, len(codes) - size + stride), stride)]
        weight = 1.0 + np.minimum(np.arange(size), np.arange(size)[::-1])
        sums = [np.zeros((len(c), self.tags)) for c in stretches]
        mass = [np.zeros(len(c)) for c in stretches]
        for low in range(0, len(places), batch):
            own = places[low : low + batch]
            codes = np.zeros((len(own), size), dtype=np.int64)
            for row, (s, a) in enumerate(own):
                part = stretches[s][a : a + size]
                codes[row, : len(part)] = part
            e = self.emissions(codes)
            for row, (s, a) in enumerate(own):
                n = min(size, len(stretches[s]) - a)
                sums[s][a : a + n] += e[:n, row] * weight[:n, None]
                mass[s][a : a + n] += weight[:n]
        return [s / m[:, None] for s, m in zip(sums, mass)]

    def decode(self, stretches: list[np.ndarray], batch: int = 256) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, mean posterior) of the tagged spans of every stretch."""
        out: list[list] = [[] for _ in stretches]
        order = sorted(range(len(stretches)), key=lambda s: len(stretches[s]))
        for low in range(0, len(order), batch):
            own = [s for s in order[low : low + batch] if len(stretches[s])]
            if not own:
                continue
            emitted = self.stretch_emissions([stretches[s] for s in own])
            lengths = np.array([len(x) for x in emitted])
            e = np.zeros((lengths.max(), len(own), self.tags))
            for row, x in enumerate(emitted):
                e[: len(x), row] = x
            path = self._best_path(e, lengths)
            sure = np.take_along_axis(self._posteriors(e, lengths)[1], path[:, :, None].astype(np.int64), 2)[:, :, 0]
            for row, s in enumerate(own):
                out[s] = _spans(path[: lengths[row], row], sure[: lengths[row], row])
        return out


def _spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    spans = []
    for start in np.flatnonzero(tags % 2 == 1).tolist():
        end = start + 1
        while end < len(tags) and tags[end] == tags[start] + 1:
            end += 1
        spans.append((int(tags[start]) // 2, start, end, float(sure[start:end].mean())))
    return spans
