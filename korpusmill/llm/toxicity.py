"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters with its hashed word embedding and with the largest values, place by place, of its character n-grams' hashed
embeddings; both are learned. Windows overlap by half, and a text's score is the largest over all of them. Training
takes of every text the window that counts most so far; only where it starts, this is the one with the word that speaks
most for the label in the other training texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a window, and from one window's start to the next's.
WINDOW, STRIDE = 32, 16
#: Training documents of each label at most, characters of each at most, and labelled documents looked at for one that is short enough.
TRAIN_DOCS, TRAIN_CHARS, LOOK_AT = 1500, 20_000, 4
HIDDEN, CHARS, WORDS, BUCKETS, ODDS = 8, 16, 6, 1 << 17, 1 << 18
INPUT = CHARS + WORDS
#: Passes over the training texts, and steps that they make at least; parts of the training texts whose evidence comes from the others.
EPOCHS, STEPS, FOLDS = 5, 160, 3
#: Step sizes of the network and of the embeddings, documents of a label from which on the latter is taken whole.
RATE, EMBEDDING_RATE, FULL_RATE = 0.01, 0.1, 30
#: Documents' worth of prior in the evidence of a word or n-gram.
PRIOR = 2.0
CACHE_WORDS = 300_000
LOOK_UP = 1 << 20
MARKS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’…¿¡"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def spelled(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the character 3- to 5-grams of all words, first n-gram of each word, hash of each word."""
    forms = [b"<" + t.lower().strip(MARKS).encode() + b">>" for t in tokens]
    data = np.frombuffer(b"".join(forms), np.uint8).astype(np.uint64)
    sizes = np.array([len(f) for f in forms])
    starts = np.cumsum(sizes) - sizes
    ends = np.repeat(starts + sizes, sizes)
    place = np.arange(len(data))
    grams, owner = [], []
    word = np.repeat(np.arange(len(forms)), sizes)
    h = data.copy()
    for n in range(2, 6):
        h = h[:-1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n >= 3:
            ok = place[: len(h)] + n <= ends[: len(h)]
            grams.append(_mixed(h[ok] * np.uint64(2654435761) + np.uint64(n)))
            owner.append(word[: len(h)][ok])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    grams = np.concatenate(grams)[order]
    first = np.searchsorted(owner_all[order], np.arange(len(forms)))
    power = np.uint64(0x9E3779B97F4A7C15)
    whole = np.add.reduceat(_mixed((data + np.uint64(1)) * power * (place - np.repeat(starts, sizes) + 1).astype(np.uint64)), starts)
    return grams, first, _mixed(whole)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    used, at = np.unique(rows, return_inverse=True)
    return used, np.stack([np.bincount(at, v, len(used)) for v in values.T], axis=1).astype(np.float32)


class Network:
    """Parameters by name; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.normal(size=shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"chars": small(BUCKETS, CHARS), "words": small(BUCKETS, WORDS), "A": small(2 * HIDDEN, HIDDEN), "u": small(HIDDEN, 1), "w": small(2 * HIDDEN, 1), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": small(INPUT, 3 * HIDDEN) * 3, f"U{d}": small(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, tokens: list[str]) -> tuple[np.ndarray, tuple]:
        """(words, INPUT) and what leads back to the embeddings."""
        grams, first, whole = spelled(tokens)
        n = np.diff(np.append(first, len(grams)))
        gram_rows, word_rows = (grams % np.uint64(BUCKETS)).astype(np.int64), (whole % np.uint64(BUCKETS)).astype(np.int64)
        x = np.empty((len(tokens), INPUT), np.float32)
        x[:, :CHARS] = np.maximum.reduceat(self.p["chars"][gram_rows], first)
        x[:, CHARS:] = self.p["words"][word_rows]
        return x, (gram_rows, first, n, word_rows)

    def forward(self, gx: dict[str, np.ndarray], index: np.ndarray, keep: bool = False) -> np.ndarray:
        """Logits of windows; ``gx``: gate inputs by direction and word, of which row 0 is padding; ``index``: (windows, WINDOW)."""
        p, H, mask = self.p, HIDDEN, index > 0
        states, memo = {}, {}
        for d in "fb":
            h = np.zeros((len(index), H), np.float32)
            out, steps = np.empty((WINDOW, len(index), H), np.float32), []
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, hu = gx[d][index[:, t]], h @ p[f"U{d}"]
                zr = sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                n = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
                m = mask[:, t : t + 1]
                new = np.where(m, n + z * (h - n), h)
                if keep:
                    steps.append((t, h, hu[:, 2 * H :], z, r, n, m))
                h = out[t] = new
            states[d], memo[d] = out, steps
        s = np.concatenate([states["f"], states["b"]], axis=2)  # (WINDOW, windows, 2H)
        a = np.tanh(s @ p["A"])
        e = np.where(mask.T, (a @ p["u"])[:, :, 0], -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = (e[:, :, None] * s).sum(axis=0)
        if keep:
            self.memo = (memo, s, a, e, pooled, mask, index)
        return (pooled @ p["w"])[:, 0] + p["b"][0]

    def backward(self, dlogit: np.ndarray, gx: dict[str, np.ndarray], x: np.ndarray, back: tuple) -> dict:
        """Gradients by name; those of the embeddings as (rows, gradients)."""
        p, H = self.p, HIDDEN
        memo, s, a, e, pooled, mask, index = self.memo
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("chars", "words")}
        g["w"], g["b"] = pooled.T @ dlogit[:, None], np.array([dlogit.sum()], np.float32)
        dpooled = dlogit[:, None] * p["w"].T
        ds = e[:, :, None] * dpooled
        de = (s * dpooled).sum(axis=2)
        de = e * (de - (e * de).sum(axis=0))
        da = de[:, :, None] * p["u"].T * (1 - a * a)
        g["u"] = np.einsum("twh,tw->h", a, de)[:, None]
        g["A"] = np.einsum("twk,twh->kh", s, da)
        ds += da @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            dgx, dh = np.zeros_like(gx[d]), np.zeros((len(index), H), np.float32)
            for t, h, hun, z, r, n, m in reversed(memo[d]):
                dh = dh + ds[t, :, k * H : (k + 1) * H]
                dn, dz = dh * (1 - z) * m, dh * (h - n) * m
                dh_next = np.where(m, dh * z, dh)
                dan = dn * (1 - n * n)
                dr = dan * hun
                dg = np.concatenate([dz * z * (1 - z), dr * r * (1 - r), dan], axis=1)
                dhu = np.concatenate([dg[:, : 2 * H], dan * r], axis=1)
                g[f"U{d}"] += h.T @ dhu
                np.add.at(dgx, index[:, t], dg)
                dh = dh_next + dhu @ p[f"U{d}"].T
            dgx[0] = 0
            g[f"W{d}"], g[f"c{d}"] = x.T @ dgx[1:], dgx[1:].sum(axis=0)
            dx += dgx[1:] @ p[f"W{d}"].T
        gram_rows, _, n, word_rows = back
        g["words"] = _by_row(word_rows, dx[:, CHARS:])
        largest = p["chars"][gram_rows] == np.repeat(x[:, :CHARS], n, axis=0)
        g["chars"] = _by_row(gram_rows, np.repeat(dx[:, :CHARS], n, axis=0) * largest)
        return g

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: np.vstack([np.zeros((1, 3 * HIDDEN), np.float32), x @ self.p[f"W{d}"] + self.p[f"c{d}"]]) for d in "fb"}


def windows(n: int) -> np.ndarray:
    """(windows, WINDOW) places of a text of n words, -1 beyond its end; a text without words has one empty window."""
    starts = np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


def _evidence(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log-odds of label 1 given that a word or n-gram occurs, against those of the training rows."""
    share = total / total.sum()
    return np.log(((seen[1] + PRIOR * share[1]) / (total[1] + PRIOR)) / ((seen[0] + PRIOR * share[0]) / (total[0] + PRIOR))).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Fit to whole texts: every epoch takes each text's strongest window and one at random."""
    rng, net = np.random.default_rng(seed), Network(seed)
    fold = rng.permutation(len(texts)) % FOLDS
    index: dict[tuple[int, str], int] = {}
    docs = [np.array([index.setdefault((f, w), len(index) + 1) for w in (t or "").split()], np.int64) for f, t in zip(fold.tolist(), texts, strict=True)]
    if not index or np.bincount(labels, minlength=2).min() < FOLDS:
        net.p["w"][:] = 0
        net.shift = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        return net
    tokens, fold_of = [w for _, w in index], np.array([f for f, _ in index])
    parts = []
    for i in range(0, len(tokens), 1 << 14):
        grams, first, whole = spelled(tokens[i : i + (1 << 14)])
        parts.append(((grams % np.uint64(ODDS)).astype(np.int32), np.diff(np.append(first, len(grams))), (whole % np.uint64(ODDS)).astype(np.int32)))
    gram_at, n, whole_at = (np.concatenate([x[k] for x in parts]) for k in range(3))
    first = np.cumsum(n) - n
    del parts
    seen = np.zeros((FOLDS, 2, ODDS), np.float32)
    for d, f, y in zip(docs, fold.tolist(), labels.tolist(), strict=True):
        own = np.unique(d) - 1
        seen[f, y][np.unique(np.concatenate([*(gram_at[first[k] : first[k] + n[k]] for k in own), whole_at[own]]))] += 1
    total = np.array([[((fold == f) & (labels == y)).sum() for y in (0, 1)] for f in range(FOLDS)])
    evidence = np.empty(len(tokens), np.float32)
    for f in range(FOLDS):
        own, odds = fold_of == f, _evidence(seen.sum(axis=0) - seen[f], total.sum(axis=0) - total[f])
        evidence[own] = np.maximum(np.maximum.reduceat(odds[gram_at], first), odds[whole_at])[own]
    del seen

    def inputs(which: np.ndarray) -> tuple[np.ndarray, tuple]:
        return net.inputs([tokens[k] for k in which.tolist()])

    places = [windows(len(d)) for d in docs]
    index_of = np.concatenate([np.where(at >= 0, d[np.maximum(at, 0)] if len(d) else 0, 0).astype(np.int32) for d, at in zip(docs, places, strict=True)])
    doc_of = np.repeat(np.arange(len(docs)), [len(at) for at in places])
    starts = np.searchsorted(doc_of, np.arange(len(docs)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def logits() -> np.ndarray:
        gx = {d: np.zeros((len(tokens) + 1, 3 * HIDDEN), np.float32) for d in "fb"}
        for i in range(0, len(tokens), 1 << 14):
            own = net.gates(inputs(np.arange(i, min(i + (1 << 14), len(tokens))))[0])
            for d in "fb":
                gx[d][i + 1 : i + len(own[d])] = own[d][1:]
        return np.concatenate([net.forward(gx, index_of[i : i + 2048]) for i in range(0, len(index_of), 2048)])

    epoch, few = 0, np.bincount(labels).min()
    while epoch < EPOCHS or step < STEPS:
        if epoch:
            score = logits()
        else:  # the window with the word that speaks most for the label
            x = np.append(np.float32(-9), evidence)
            score = np.concatenate([x[index_of[i : i + 65536]].max(axis=1) for i in range(0, len(index_of), 65536)])
        top = np.maximum.reduceat(score, starts)
        best = np.array([s + np.argmax(score[s : s + len(at)]) for s, at in zip(starts, places, strict=True)])
        quiet = np.flatnonzero(labels[doc_of] == 0)
        take = np.concatenate([best, rng.choice(quiet, min(len(quiet), len(best)), replace=False)])
        goal = np.concatenate([labels, np.zeros(len(take) - len(best))]).astype(np.float32)
        share = np.where(goal == 1, 0.5 / goal.sum(), 0.5 / (1 - goal).sum()) * len(goal)
        order, epoch = rng.permutation(len(take)), epoch + 1
        for i in range(0, len(take), 128):
            own = order[i : i + 128]
            at, y = index_of[take[own]], goal[own]
            used, inverse = np.unique(at, return_inverse=True)
            local = inverse.reshape(at.shape) + (used[0] != 0)
            if not used.any():
                continue
            x, back = inputs(used[used > 0] - 1)
            gx = net.gates(x)
            p = sigmoid(net.forward(gx, local, keep=True))
            grads = net.backward((share[own] * (p - y) / len(y)).astype(np.float32), gx, x, back)
            step += 1
            for k, grad in grads.items():
                rows, grad = grad if k in ("chars", "words") else (slice(None), grad)  # of embeddings the rows in use
                m, v = (x[rows] for x in moments[k])
                m = moments[k][0][rows] = m + 0.1 * (grad - m)
                v = moments[k][1][rows] = v + 0.01 * (grad * grad - v)
                rate = EMBEDDING_RATE * min(1, few / FULL_RATE) if k in ("chars", "words") else RATE  # embeddings of few texts would only remember them
                net.p[k][rows] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    top = np.maximum.reduceat(logits(), starts)
    # a line through the largest logits, at the labels' share in all rows
    weight = np.where(labels == 1, prior / (labels == 1).sum(), (1 - prior) / (labels == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(500):
        q = sigmoid(a * top + b)
        a, b = a - 0.3 * float((weight * (q - labels) * top).sum() + 0.001 * (a - 1)), b - 0.3 * float((weight * (q - labels)).sum())
    net.scale, net.shift = max(a, 0.05), b
    return net


class Scorer:
    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.gx = {d: np.zeros((1 << 16, 3 * HIDDEN), np.float32) for d in "fb"}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self._reset()
        words, sizes = [], []
        for t in texts:
            own = t.split()
            words += own
            sizes.append(len(own))
        at = np.fromiter(map(self.index.get, words, repeat(0)), np.int64, len(words))
        if len(missing := np.flatnonzero(at == 0)):
            new = list(dict.fromkeys(words[k] for k in missing.tolist()))
            lo = len(self.index) + 1
            self.index |= {w: lo + k for k, w in enumerate(new)}
            for d in "fb":
                while lo + len(new) > len(self.gx[d]):
                    self.gx[d] = np.concatenate([self.gx[d], np.zeros_like(self.gx[d])])
            for i in range(0, len(new), 1 << 14):
                gx = self.net.gates(self.net.inputs(new[i : i + (1 << 14)])[0])
                for d in "fb":
                    self.gx[d][lo + i : lo + i + len(gx[d]) - 1] = gx[d][1:]
            at[missing] = [self.index[words[k]] for k in missing.tolist()]
        places = [windows(n) for n in sizes]
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate([np.where(p >= 0, p + b, -1) for p, b in zip(places, begin, strict=True)])
        index = np.where(flat >= 0, np.append(at, 0)[flat], 0)
        logit = np.concatenate([self.net.forward(self.gx, index[i : i + 4096]) for i in range(0, len(index), 4096)])
        starts = np.cumsum([0] + [len(p) for p in places[:-1]])
        return sigmoid(self.net.scale * np.maximum.reduceat(logit, starts) + self.net.shift).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Network:
    """Train, in one task, on up to ``train_docs`` labelled documents of each label, first by a hash of the id, of up to ``TRAIN_CHARS`` characters, out of ``LOOK_AT`` times as many.

    Ids labelled more than once count by their largest label; null labels are left out. With fewer than three of a label the network is
    constant at the share of label 1.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    prior = share.get(1, 0) / max(sum(share.values()), 1)
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(LOOK_AT * train_docs) for y in (0, 1)]
    pick = picks[0].unionByName(picks[1])
    looked_at = [tuple(r) for r in pick.collect()]
    short = docs.where(F.length(F.coalesce(text_col, F.lit(""))) <= TRAIN_CHARS).select(id_col, text_col)
    table = lambda rows: F.broadcast(docs.sparkSession.createDataFrame(rows, pick.schema))
    found = {r[0] for r in short.select(id_col).join(table(looked_at), id_col).select(id_col).distinct().collect()}  # of the few looked at
    chosen = [x for y in (0, 1) for x in [r for r in looked_at if r[1] == y and r[0] in found][:train_docs]]
    rows = short.join(table(chosen), id_col).select(F.col(id_col).cast("string"), F.col(text_col), "y").limit(3 * train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((i or "", t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        net = train([t for _, t, _ in own], np.array([y for *_, y in own] or [0]), prior)
        yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(net)]})

    fitted = rows.repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(fitted[0]) if fitted else train([], np.zeros(0, np.int64), prior)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null text counts as empty, which scores as a window without words. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, i = batch.column(1), 0
            while i < len(texts):
                some, size, lo = [], 0, i
                while i < len(texts) and size < LOOK_UP:
                    some.append(texts[i].as_py() or "")
                    size += len(some[-1])
                    i += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)), pa.array(scorer(some))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == 0
