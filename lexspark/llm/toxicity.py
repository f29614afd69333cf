"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of embeddings of its hash (word input) and of the hashes of
its first 3 to 6 and last 3 bytes (character input). Both directions of the network
run over every window of ``WINDOW`` words, half overlapping, up to the text's end;
attention pools a window's states, and a text scores as its most toxic window does.

Null and empty texts have one empty window. All windows of a text are scored, whatever
its length. Equal texts get equal scores; a null doc_id is not held out. Without labels
of both classes every score is the share of ones seen (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import map_batches
from lexspark.llm.labels import fold, training_rows
from lexspark.llm.tokens import Hashed, mix, spans

WINDOW, STEP = 32, 16
BITS, WIDTH, HIDDEN = 15, 12, 8
#: Input kinds of a word: the word, prefixes of 3 to 6 bytes, the suffix of 3 bytes.
KINDS = 6
PAD = 1 << BITS


def word_inputs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, KINDS) embedding rows, and the number of words before each text."""
    h = Hashed(column)
    start, end, at = h.words()
    # Punctuation and brackets around a word don't count as part of it.
    edge = np.zeros(256, bool)
    edge[[33, 34, 39, 40, 41, 42, 44, 45, 46, 58, 59, 63, 91, 93]] = True
    for _ in range(3):
        cut = (end - start > 1) & edge[h.data[end - 1]]
        end = end - cut
        cut = (end - start > 1) & edge[h.data[start]]
        start = start + cut
    runs = [(start, end), *((start, np.minimum(start + n, end)) for n in (3, 4, 5, 6)), (np.maximum(end - 3, start), end)]
    rows = np.empty((len(start), KINDS), np.int32)
    for k, (a, b) in enumerate(runs):
        rows[:, k] = (mix(h.of(a, b), k + 1) >> np.uint64(64 - BITS)).astype(np.int32)
    return rows, at


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: starts at multiples of STEP until one
    reaches the text's end."""
    count = np.diff(at)
    each = np.maximum(0, -(-(count - WINDOW) // STEP)) + 1
    owner = np.repeat(np.arange(len(count)), each)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    begin = at[:-1][owner] + k * STEP
    return owner, begin, np.minimum(WINDOW, at[1:][owner] - begin)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class BiGru:
    """Parameters and passes; gates in the order reset, update, candidate."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.normal(0, k / np.sqrt(s[0]), s)).astype(np.float32)
        h = HIDDEN
        self.p = {"e": r.normal(0, 0.1, ((1 << BITS) + 1, WIDTH)).astype(np.float32), "v": f(2 * h), "w": f(2 * h), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(WIDTH, 3 * h), f"U{d}": f(h, 3 * h, k=0.7), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p["e"][PAD] = 0
        #: Scores are sigmoid(slope * logit + shift).
        self.slope, self.shift = 1.0, 0.0

    def embed(self, rows: np.ndarray) -> np.ndarray:
        e = self.p["e"]
        x = e[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x += e[rows[:, k]]
        return x

    def _direction(self, g: np.ndarray, d: str, keep: bool):
        """g: (T, N, 3h) input parts of the gates in the order of time."""
        h, u = HIDDEN, self.p[f"U{d}"]
        t, n, _ = g.shape
        state = np.zeros((n, h), np.float32)
        out = np.empty((t, n, h), np.float32)
        saved = []
        for k in range(t):
            a = state @ u
            rz = _sigmoid(g[k, :, : 2 * h] + a[:, : 2 * h])
            c = np.tanh(g[k, :, 2 * h :] + rz[:, :h] * a[:, 2 * h :])
            new = c + rz[:, h:] * (state - c)
            if keep:
                saved.append((state, a[:, 2 * h :], rz, c))
            state = out[k] = new
        return out, saved

    def pooled(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: (T, N, 3h) by direction; mask: (T, N) real words."""
        f, sf = self._direction(gates["f"], "f", keep)
        b, sb = self._direction(gates["b"][::-1], "b", keep)
        b = b[::-1]
        h = HIDDEN
        score = f @ self.p["v"][:h] + b @ self.p["v"][h:]
        score = np.where(mask, score, np.float32(-1e9))
        score -= score.max(0)
        alpha = np.exp(score)
        alpha /= alpha.sum(0)
        value = f @ self.p["w"][:h] + b @ self.p["w"][h:]
        logit = (alpha * value).sum(0) + self.p["b"][0]
        return logit, (f, b, sf, sb, alpha, value, logit)

    def logits(self, rows: np.ndarray, begin: np.ndarray, count: np.ndarray, block: int = 4096) -> np.ndarray:
        """Of windows over the words ``rows``."""
        x = self.embed(rows)
        x = np.concatenate([x, np.zeros((1, WIDTH), np.float32)])
        parts = {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}
        out = np.empty(len(begin), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for k in range(0, len(begin), block):
            mask = steps < count[None, k : k + block]
            at = np.where(mask, begin[None, k : k + block] + steps, len(rows))
            out[k : k + block] = self.pooled({d: parts[d][at] for d in "fb"}, mask)[0]
        return out

    def back(self, rows: np.ndarray, x: np.ndarray, mask: np.ndarray, cache, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients. rows: (T, N, KINDS); x: (T, N, WIDTH); dlogit: (N,)."""
        f, b, sf, sb, alpha, value, logit = cache
        h, p = HIDDEN, self.p
        t, n = mask.shape
        dval = alpha * dlogit
        dscore = alpha * (value - (logit - p["b"][0])) * dlogit
        grads = {"b": np.array([dlogit.sum()], np.float32), "w": np.concatenate([np.einsum("tn,tnh->h", dval, f), np.einsum("tn,tnh->h", dval, b)]), "v": np.concatenate([np.einsum("tn,tnh->h", dscore, f), np.einsum("tn,tnh->h", dscore, b)])}
        dx = np.zeros_like(x)
        for d, saved, cut in (("f", sf, slice(0, h)), ("b", sb, slice(h, 2 * h))):
            ds = dval[:, :, None] * p["w"][cut] + dscore[:, :, None] * p["v"][cut]
            order = range(t - 1, -1, -1) if d == "f" else range(t)
            u, w = p[f"U{d}"], p[f"W{d}"]
            gu, dg, carry = np.zeros_like(u), np.empty((t, n, 3 * h), np.float32), np.zeros((n, h), np.float32)
            for k in order:
                state, au, rz, c = saved[k if d == "f" else t - 1 - k]
                g = carry + ds[k]
                r, z = rz[:, :h], rz[:, h:]
                dz = g * (state - c) * z * (1 - z)
                dc = g * (1 - z) * (1 - c * c)
                dr = dc * au * r * (1 - r)
                da = np.concatenate([dr, dz, dc * r], 1)
                dg[k] = np.concatenate([dr, dz, dc], 1)
                gu += state.T @ da
                carry = g * z + da @ u.T
            grads[f"U{d}"], grads[f"W{d}"], grads[f"c{d}"] = gu, x.reshape(-1, WIDTH).T @ dg.reshape(-1, 3 * h), dg.sum((0, 1))
            dx += dg @ w.T
        flatrows = rows.reshape(-1, KINDS)
        seen, backs = np.unique(flatrows, return_inverse=True)
        backs = backs.reshape(flatrows.shape)
        dx = dx.reshape(-1, WIDTH)
        grads["e"] = seen, np.stack([sum(np.bincount(backs[:, k], dx[:, j], len(seen)) for k in range(KINDS)) for j in range(WIDTH)], 1).astype(np.float32)
        return grads


def _steps(order: np.ndarray, size: np.ndarray, docs_per_step: int, windows_per_step: int):
    """``order`` in runs of at most so many texts and windows (one text at least)."""
    begin, held = 0, 0
    for k, i in enumerate(order):
        if k > begin and (k - begin == docs_per_step or held + size[i] > windows_per_step):
            yield order[begin:k]
            begin, held = k, 0
        held += size[i]
    if begin < len(order):
        yield order[begin:]


def fit(docs: list[tuple[np.ndarray, float]], prior: float, epochs: int = 7, rate: float = 0.02, docs_per_step: int = 48, windows_per_step: int = 2400, seed: int = 5) -> BiGru:
    """``docs``: (words, KINDS) inputs and the label. All windows of a text take part: its
    logit is a smooth maximum over them, so those that show the label learn it. One text
    in five is kept to calibrate the scores, by the maximum that scoring takes."""
    rng = np.random.default_rng(seed)
    net = BiGru()
    order = rng.permutation(len(docs))
    check, learn = order[: len(docs) // 5], order[len(docs) // 5 :]
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    size = np.array([len(windows(np.array([0, len(x)]))[0]) for x, _ in docs])
    steps_in = np.arange(WINDOW)[:, None]
    for epoch in range(epochs):
        rng.shuffle(learn)
        for pick in _steps(learn, size, docs_per_step, windows_per_step):
            words = np.concatenate([*(docs[i][0] for i in pick), np.full((1, KINDS), PAD, docs[pick[0]][0].dtype)])
            owner, begin, count = windows(np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in pick])]))
            mask = steps_in < count[None, :]
            rows = words[np.where(mask, begin[None, :] + steps_in, len(words) - 1)].astype(np.int32)
            first = np.searchsorted(owner, np.arange(len(pick)))
            y = np.array([docs[i][1] for i in pick], np.float32)
            mask[0] = True
            x = net.embed(rows.reshape(-1, KINDS)).reshape(WINDOW, -1, WIDTH)
            gates = {d: x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}
            logit, cache = net.pooled(gates, mask, keep=True)
            sharp = 1.0 + epoch
            top = np.maximum.reduceat(logit, first)
            weight = np.exp(sharp * (logit - top[owner]))
            weight /= np.add.reduceat(weight, first)[owner]
            doc = np.add.reduceat(weight * logit, first)
            err = (_sigmoid(doc) - y) / len(pick)
            grads = net.back(rows, x, mask, cache, (err[owner] * weight).astype(np.float32))
            step += 1
            speed = rate * (0.5 ** (epoch / 3)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for name, g in grads.items():
                a, b, p = m1[name], m2[name], net.p[name]
                at = slice(None)
                if name == "e":
                    at, g = g
                    g = g + 1e-5 * p[at]
                a[at] = 0.9 * a[at] + 0.1 * g
                b[at] = 0.99 * b[at] + 0.01 * g * g
                p[at] -= speed * a[at] / (np.sqrt(b[at]) + 1e-7)
            net.p["e"][PAD] = 0
    top, ys = [], []
    for i in check:
        _, begin, count = windows(np.array([0, len(docs[i][0])]))
        top.append(net.logits(docs[i][0].astype(np.int32), begin, count).max())
        ys.append(docs[i][1])
    net.slope, net.shift = _calibrate(np.array(top, float), np.array(ys, float), prior)
    return net


def _calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic slope and shift of the logits under the true share of ones."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    cost = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(cost * (p - y) * x).mean() + 0.02 * (a - 1), (cost * (p - y)).mean()])
        s = cost * p * (1 - p)
        hess = np.array([[(s * x * x).mean() + 0.02, (s * x).mean()], [(s * x).mean(), s.mean() + 1e-4]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -2, 2)
    return float(max(a, 0.1)), float(b)


class Constant(BiGru):
    """Scores every text alike."""

    def __init__(self, share: float):
        super().__init__()
        share = min(max(share, 0.01), 0.99)
        self.slope, self.shift = 0.0, float(np.log(share / (1 - share)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1200, longest: int = 1 << 20, **options) -> BiGru:
    """Fit on a bounded sample of labelled rows outside fold 0: ``per_class`` of each
    class, of texts of at most ``longest`` bytes, each with all of its words."""

    def run(batches):
        for batch in batches:
            for part in spans(batch):
                rows, at = word_inputs(part.column("text"))
                rows = rows.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([rows[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary()), part.column("y").cast(pa.int32())], names=["doc_id", "words", "y"])

    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= longest
    found = map_batches(training_rows(docs, labels, label, per_class).where(short), run, "doc_id long, words binary, y int").collect()
    found.sort(key=lambda r: r.doc_id)
    y = [r.y for r in found]
    if len(set(y)) < 2:
        return Constant(float(np.mean(y)) if y else 0.5)
    share = labels.where(F.col(label).isin(0, 1)).where(fold(F.col("doc_id")) != 0).agg(F.avg(label)).first()[0]
    return fit([(np.frombuffer(r.words, np.uint16).reshape(-1, KINDS), float(r.y)) for r in found], float(share), **options)


def _probabilities(column: pa.Array, net: BiGru) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, its probability, the number of its windows, and the most toxic one."""
    rows, at = word_inputs(column)
    owner, begin, count = windows(at)
    logit = net.logits(rows, begin, count)
    first = np.searchsorted(owner, np.arange(len(column) + 1))
    top = np.maximum.reduceat(logit, first[:-1]).astype(np.float64)
    hit = np.flatnonzero(logit == top[owner])
    place = hit[np.searchsorted(hit, first[:-1])] - first[:-1]
    return 1 / (1 + np.exp(-np.clip(net.slope * top + net.shift, -30, 30))), np.diff(first), place


def keep_clean(docs: DataFrame, net: BiGru, threshold: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text scores below ``threshold``."""

    def run(batches):
        for batch in batches:
            for part in spans(batch, most=1 << 20):
                yield part.filter(pa.array(_probabilities(part.column("text"), net)[0] < threshold))

    return map_batches(docs, run, docs.schema)


def score(docs: DataFrame, net: BiGru) -> DataFrame:
    """``doc_id, score, n_windows, worst_window`` (the place of the most toxic window)."""

    def run(batches):
        for batch in batches:
            for part in spans(batch, most=1 << 20):
                p, each, place = _probabilities(part.column("text"), net)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64()), pa.array(each, pa.int64()), pa.array(place, pa.int64())],
                    names=["doc_id", "score", "n_windows", "worst_window"],
                )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, n_windows long, worst_window long")


def predict(docs: DataFrame, net: BiGru, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the windows' figures."""
    return score(docs, net).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_windows",
        "worst_window",
    )
