"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are word types: a vector of the word, if it is known, beside the mean of vectors of its
character n-grams. All windows of a batch advance together, both directions at once.
"""

from __future__ import annotations

import numpy as np

from .common import MULT, mix64

#: Sizes: word and character vectors, hidden state of a direction, places of n-grams.
WORD, CHAR, HIDDEN, NGRAMS = 8, 12, 8, 1 << 14
#: Words of a window and between the starts of two; windows that advance together.
WINDOW, STRIDE, BATCH = 48, 24, 2048
#: Words that are hashed and texts whose n-grams are counted at once, for memory.
WORDS, TEXTS = 1 << 16, 50

# ASCII characters other than letters, digits and those over 127 separate words; A-Z become a-z.
_LETTER = np.array([chr(i).isalnum() or i > 127 for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


class Types:
    """The distinct words of some texts: hashes, n-grams, and the type and text of every word."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
        letter = _LETTER[data]
        edge = np.flatnonzero(np.diff(letter))
        start, end = edge[0::2] + 1, edge[1::2] + 1
        # A word's hash is the sum of its characters' hashes by place, so 64 bits are mixed at each.
        length, h = end - start, np.zeros(len(start), np.uint64)
        for i in range(0, len(start), WORDS):
            begin, n = start[i:i + WORDS], length[i:i + WORDS]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first, n)
            each = mix64((place.astype(np.uint64) << np.uint64(8) | data[np.repeat(begin, n) + place]) * MULT)
            h[i:i + WORDS] = mix64(np.add.reduceat(each, first))
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])[:len(h)]
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1
        one = order[new]
        self.hashes = h[one]
        begins = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(start, begins)
        # N-grams of 3 and 4 bytes, with the separators on both sides as one mark.
        start, length = start[one], length[one] + 2
        marked = np.where(letter, data, np.uint8(0))
        grams, owners = [], []
        for n in (3, 4):
            count = np.maximum(0, length - n + 1)
            at = np.repeat(start - 1 - (np.cumsum(count) - count), count) + np.arange(count.sum())
            g = sum(marked[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(n)) + np.uint64(n << 40)
            grams.append((mix64(g * MULT) >> np.uint64(32)).astype(np.int64) % NGRAMS)
            owners.append(np.repeat(np.arange(len(one)), count))
        self.grams, self.owner = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(self.owner, kind="stable")
        self.grams, self.owner = self.grams[order], self.owner[order]
        self.n_grams = np.bincount(self.owner, minlength=len(one))


def windows(first: np.ndarray, of: np.ndarray, window: int = WINDOW, stride: int = STRIDE):
    """All overlapping windows of texts: (text, types by place, places in use).

    They start every ``stride`` words until one reaches the end; a text without words has none.
    """
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * stride
    place = start[:, None] + np.arange(window)
    used = place < n[row][:, None]
    return row, np.where(used, of[np.minimum(first[row][:, None] + place, max(0, len(of) - 1))] if len(of) else 0, 0), used


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; ``known`` holds the hashes of words that have a vector, sorted."""

    def __init__(self, known: np.ndarray, seed: int = 3):
        rng, h, d = np.random.default_rng(seed), HIDDEN, WORD + CHAR
        normal = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.known, self.scale = known, (1.0, 0.0)
        self.p = {"word": normal(len(known) + 1, WORD, scale=0.1), "char": normal(NGRAMS, CHAR, scale=0.1),
                  "wx": normal(2, d, 3 * h), "bx": np.zeros((2, 1, 3 * h), np.float32), "u": normal(2, h, 3 * h),
                  "a": normal(2 * h, h), "a0": np.zeros(h, np.float32), "v": normal(h),
                  "w": normal(2 * h), "w0": np.array([-2.0], np.float32)}

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of known words; 0 is for all others."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def inputs(self, types: Types):
        """Vectors of all types, and their share in the gates of both directions."""
        p, ids = self.p, self.word_ids(types.hashes)
        chars = np.zeros((len(ids), CHAR), np.float32)
        if len(types.grams):
            begin = np.searchsorted(types.owner, np.arange(len(ids)))
            step = 20_000  # types at a time, for memory
            for i in range(0, len(ids), step):
                j = min(i + step, len(ids))
                stop = begin[j] if j < len(ids) else len(types.grams)
                chars[i:j] = np.add.reduceat(p["char"][types.grams[begin[i]:stop]], begin[i:j] - begin[i])
            chars /= np.maximum(1, types.n_grams)[:, None]
        x = np.concatenate([p["word"][ids], chars], axis=1)
        return ids, x, x @ p["wx"] + p["bx"]

    def forward(self, gates: np.ndarray, of: np.ndarray, used: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Logits of windows. ``gates`` come from ``inputs``; ``trace`` gathers what ``backward`` needs."""
        p, h_, (n, t_) = self.p, HIDDEN, of.shape
        h = np.zeros((2, n, h_), np.float32)
        states = np.empty((t_, n, 2 * h_), np.float32)
        for t in range(t_):
            s = t_ - 1 - t
            g = np.stack([gates[0, of[:, t]], gates[1, of[:, s]]])
            m = np.stack([used[:, t], used[:, s]])[..., None]
            u = h @ p["u"]
            zr = _sigmoid(g[..., :2 * h_] + u[..., :2 * h_])
            z, r = zr[..., :h_], zr[..., h_:]
            c = np.tanh(g[..., 2 * h_:] + r * u[..., 2 * h_:])
            new = np.where(m, c + z * (h - c), h)
            if trace is not None:
                trace.append((h, z, r, c, u[..., 2 * h_:], m))
            h = new
            states[t, :, :h_], states[s, :, h_:] = h[0], h[1]
        e = np.tanh(states @ p["a"] + p["a0"])
        weight = np.where(used.T, e @ p["v"], -np.inf)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if trace is not None:
            trace.append((states, e, weight, pooled))
        return pooled @ p["w"] + p["w0"]

    def backward(self, trace: list, dlogit: np.ndarray, of: np.ndarray, n_types: int):
        """Gradients of the parameters after the gates, and of the gates of all types."""
        p, h_ = self.p, HIDDEN
        *steps, (states, e, weight, pooled) = trace
        t_, n = weight.shape
        grad = {"w": pooled.T @ dlogit, "w0": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["w"]
        dweight = np.einsum("nk,tnk->tn", dpooled, states)
        dstates = weight[..., None] * dpooled
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        grad["v"] = np.einsum("tn,tnk->k", dscore, e)
        de = dscore[..., None] * p["v"] * (1 - e * e)
        grad["a"] = np.einsum("tni,tnj->ij", states, de)
        grad["a0"] = de.sum(axis=(0, 1))
        dstates = dstates + de @ p["a"].T
        grad["u"] = np.zeros_like(p["u"])
        every = np.empty((2, t_, n, 3 * h_), np.float32)
        dh = np.zeros((2, n, h_), np.float32)
        for t in range(t_ - 1, -1, -1):
            s = t_ - 1 - t
            h, z, r, c, un, m = steps[t]
            dh[0] += dstates[t, :, :h_]
            dh[1] += dstates[s, :, h_:]
            dnew = dh * m
            dc = dnew * (1 - z) * (1 - c * c)
            dz = dnew * (h - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=-1)
            dg = np.concatenate([dz, dr, dc], axis=-1)
            every[0, t], every[1, s] = dg[0], dg[1]
            grad["u"] += h.transpose(0, 2, 1) @ du
            dh = dh * ~m + dnew * z + du @ p["u"].transpose(0, 2, 1)
        flat = of.T.ravel()
        order = np.argsort(flat, kind="stable")
        some, begin = np.unique(flat[order], return_index=True)
        dgates = np.zeros((2, n_types, 3 * h_), np.float32)
        dgates[:, some] = np.add.reduceat(every.reshape(2, -1, 3 * h_)[:, order], begin, axis=1)
        return grad, dgates

    def gradients(self, types: Types, of: np.ndarray, used: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Weighted log loss of windows and its gradients; types of the windows are those of ``types``."""
        ids, x, gates = self.inputs(types)
        trace: list = []
        logit = self.forward(gates, of, used, trace)
        prob = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())
        grad, dgates = self.backward(trace, ((prob - label) * weight / weight.sum()).astype(np.float32), of, len(ids))
        grad["wx"], grad["bx"] = x.T @ dgates, dgates.sum(axis=1, keepdims=True)
        dx = (dgates @ self.p["wx"].transpose(0, 2, 1)).sum(axis=0)
        grad["word"], grad["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(grad["word"], ids, dx[:, :WORD])
        if len(types.grams):
            order = np.argsort(types.grams, kind="stable")
            some, begin = np.unique(types.grams[order], return_index=True)
            share = dx[:, WORD:] / np.maximum(1, types.n_grams)[:, None]
            grad["char"][some] = np.add.reduceat(share[types.owner[order]], begin, axis=0)
        return loss, grad

    def logits(self, types: Types) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows: text, logit; and each text's largest logit, or the bias if it has no window."""
        out = np.full(len(types.first) - 1, float(self.p["w0"][0]))
        row, of, used = windows(types.first, types.of)
        if not len(row):
            return row, np.zeros(0), out
        gates = self.inputs(types)[2]
        logit = np.concatenate([self.forward(gates, of[i:i + BATCH], used[i:i + BATCH]) for i in range(0, len(row), BATCH)])
        some = np.unique(row)
        out[some] = np.maximum.reduceat(logit.astype(np.float64), np.searchsorted(row, some))
        return row, logit, out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The calibrated probability of each text's worst window."""
        slope, shift = self.scale
        return _sigmoid(slope * self.logits(Types(texts))[2] + shift)

    def calibrate(self, texts: list[bytes], labels: np.ndarray) -> None:
        """Fit slope and shift of the texts' logits to labels of texts that were not trained on."""
        x = self.logits(Types(texts))[2]
        n = np.bincount(labels, minlength=2)
        # Targets a little inside 0 and 1, so that classes that part cleanly have a finite slope.
        y = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        middle, spread = x.mean(), x.std() + 1e-9
        d = np.stack([(x - middle) / spread, np.ones(len(x))], axis=1)
        beta = np.zeros(2)
        for _ in range(100):
            p = np.clip(_sigmoid(d @ beta), 1e-9, 1 - 1e-9)
            hessian = (d * (p * (1 - p))[:, None]).T @ d + 1e-6 * np.eye(2)
            move = np.linalg.solve(hessian, d.T @ (y - p))
            beta += move * min(1, 2 / (np.abs(move).max() + 1e-12))
        if beta[0] > 0:
            self.scale = beta[0] / spread, beta[1] - beta[0] * middle / spread


def train(texts: list[bytes], labels: np.ndarray, steps: int = 300, seed: int = 3, least: int = 3,
          most: int = 4000, batch: int = 128) -> Network | None:
    """Fit on whole texts by their windows; None if there are not two classes.

    A text is as toxic as its worst window. The first rounds take windows with their text's
    label; later ones the worst windows of toxic texts, and of clean texts the worst and some
    others. Both classes weigh the same. A round takes at most ``most`` windows, at random, and
    rounds go on for ``steps`` batches.
    Words in fewer than ``least`` texts have no vector of their own, and those that have are left
    out at random, so n-grams are learnt too. The last fifth of the texts only calibrates.
    """
    labels = np.asarray(labels)
    mixed = np.random.default_rng(seed).permutation(len(texts))
    cut = -(-len(texts) * 4 // 5)
    kept = [texts[i] for i in mixed[cut:]], labels[mixed[cut:]]
    texts, labels = [texts[i] for i in mixed[:cut]], labels[mixed[:cut]]
    if len(set(labels.tolist())) < 2:
        return None
    types, rng = Types(texts), np.random.default_rng(seed)
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(types.first)) * (len(types.hashes) + 1) + types.of)
    often = np.bincount(pairs % (len(types.hashes) + 1), minlength=len(types.hashes)) >= least
    net = Network(np.sort(types.hashes[often]), seed)
    _start_from_counts(net, types, labels)
    row, of, used = windows(types.first, types.of)
    label = labels[row].astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, round_ = 0, 0
    while step < steps:
        if round_ < 2:
            pick = np.arange(len(row))
        else:
            order = np.lexsort((-net.logits(types)[1], row))
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(row, row[order])
            pick = np.flatnonzero(np.where(label > 0, rank < 2, (rank < 2) | (rng.random(len(row)) < 0.2)))
        rng.shuffle(pick)
        pick, round_ = pick[:most], round_ + 1
        toxic = label[pick].sum()
        weight = np.where(label > 0, len(pick) / max(1, toxic), len(pick) / max(1, len(pick) - toxic)).astype(np.float32)
        for i in range(0, len(pick), batch):
            some = pick[i:i + batch]
            here, inverse = np.unique(of[some], return_inverse=True)
            part = _subset(types, here, rng.random(len(here)) < 0.3)
            _, grad = net.gradients(part, inverse.reshape(len(some), -1), used[some], label[some], weight[some])
            step += 1
            rate = 0.01 * (0.5 if step > 0.7 * steps else 1)
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                own = rate / 10 if k in ("word", "char") else rate
                move = (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
                net.p[k] = (net.p[k] - own * move - 1e-5 * net.p[k]).astype(np.float32)
    net.calibrate(*kept)
    return net


def _start_from_counts(net: Network, types: Types, labels: np.ndarray) -> None:
    """The first component of each vector begins as how much its word or n-gram tells the classes apart.

    That is the log odds of a toxic text given it, less those of any text, with ten texts of the
    usual mixture added to its counts, so that rare ones tell little.
    """
    text = np.repeat(np.arange(len(labels)), np.diff(types.first))
    both = np.unique(text * len(types.hashes) + types.of)
    text, kind = both // len(types.hashes), both % len(types.hashes)
    total = np.bincount(labels, minlength=2)

    def telling(text, key, n):
        a, b = (np.bincount(key[labels[text] == c], minlength=n) + 10 * total[c] / total.sum() for c in (1, 0))
        return np.log(a / b) - np.log(total[1] / total[0])

    net.p["word"][1:, 0] = telling(text, net.word_ids(types.hashes)[kind], len(net.known) + 1)[1:]
    net.p["word"][0] = 0
    begin = np.searchsorted(types.owner, np.arange(len(types.hashes)))
    count = types.n_grams[kind]
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(labels), TEXTS):
        part = slice(*np.searchsorted(text, [i, i + TEXTS]))
        n = count[part]
        at = np.repeat(begin[kind[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(np.unique(np.repeat(text[part], n) * NGRAMS + types.grams[at]))
    both = np.concatenate(found)
    net.p["char"][:, 0] = telling(both // NGRAMS, both % NGRAMS, NGRAMS)


def _subset(types: Types, here: np.ndarray, hidden: np.ndarray) -> Types:
    """Some of the types; hidden ones go without their word's vector."""
    part = object.__new__(Types)
    part.hashes = np.where(hidden, np.uint64(0), types.hashes[here])
    count = types.n_grams[here]
    begin = np.searchsorted(types.owner, here)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    part.grams, part.owner, part.n_grams = types.grams[at], np.repeat(np.arange(len(here)), count), count
    return part
