"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .decontam import words
from .quality_mil import scored, training_sample

#: Bound of the sample that the model is fitted on: labelled rows of either class, each of so many bytes at most.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16_384
#: Words are hashed to 32 bits; hashes seen in fewer documents of the sample share the zero vector.
LEAST_DOCS = 3
#: A word's embedding is the sum of those of its hash and of the hash of its first bytes.
STEM = 6
#: Words whose rows a worker remembers.
CACHE_WORDS = 400_000
CUT = 0.5
DIM, WIDTHS, FILTERS, DECAY = 12, (1, 2, 3), 8, 1e-5
#: Training: at most so many epochs (of small samples three times as many), documents of a step, the share of words blanked, rates.
EPOCHS, BATCH, DROPPED, RATE, RATE_WORDS = 8, 32, 0.3, 5e-3, 2e-2

# Function words by which a text's own words tell its language, to pick a threshold. Fixed values.
LANGUAGES = {
    "en": b"the of and to in is that it was for on are with as at be this from or by",
    "de": b"der die und das den von zu ist mit dem nicht ein eine auf auch es an als wie ich",
    "fr": b"le la les de des et un une du est pour que qui dans en au par sur avec ne",
    "es": b"el la los las de que y en un una por con no del se para al como su es",
}
_TELLS = {k: frozenset(v.split()) for k, v in LANGUAGES.items()}


def language(tokens: list[bytes]) -> str:
    """The language with most function words; "" without any."""
    seen = Counter(tokens)
    counts = {k: sum(seen[w] for w in tells) for k, tells in _TELLS.items()}
    best = max(sorted(counts), key=counts.__getitem__)
    return best if counts[best] else ""


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))


def stem_hashes(tokens: list[bytes]) -> np.ndarray:
    """Hashes of the words' first ``STEM`` bytes, apart from those of words."""
    return np.fromiter((zlib.crc32(t[:STEM], 1) for t in tokens), np.uint32, len(tokens))


class Model:
    """Embeddings of the known hashes (row 0 is for all others), filters, output weights, a threshold for each language."""

    def __init__(self, known: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        self.known = known
        self.E = np.concatenate((np.zeros((1, DIM)), r.normal(0, 0.5, (len(known), DIM)))).astype(np.float32)
        self.W = [r.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.cuts = {"": 0.0}
        self.seen: dict[bytes, int] = {}

    def _rows(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(h), np.int64)
        k = np.searchsorted(self.known, h)
        k[k == len(self.known)] = 0
        return np.where(self.known[k] == h, k + 1, 0)

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        """Rows of the embeddings of each word and of its stem, in one number: word * ``len(E)`` + stem."""
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        new = list(set(tokens).difference(self.seen))
        if new:
            self.seen.update(zip(new, (self._rows(hashes(new)) * len(self.E) + self._rows(stem_hashes(new))).tolist(), strict=True))
        return np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def layout(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all documents with blanks before, between and after, and where each document starts."""
        pad = max(WIDTHS) - 1
        sizes = np.array([len(d) + pad for d in docs])
        flat = np.zeros(int(sizes.sum()) + pad, np.int64)
        starts = np.cumsum(sizes) - sizes
        for s, d in zip(starts, docs, strict=True):
            flat[s + pad : s + pad + len(d)] = d
        return flat, starts

    def embedded(self, flat: np.ndarray) -> np.ndarray:
        word, stem = np.divmod(flat, len(self.E))
        return self.E[word] + self.E[stem]

    def forward(self, flat: np.ndarray, starts: np.ndarray):
        """Pooled filter values of each document; windows of blanks and unknown words count with the filters' bias."""
        known = np.flatnonzero(flat)
        x, pooled = self.embedded(flat), []
        for w, W in zip(WIDTHS, self.W, strict=True):
            # only windows that hold a known word can differ from the bias
            at = np.unique((known[:, None] - np.arange(w)).ravel()) if len(known) else known
            at = at[at >= 0]
            values = np.zeros((len(at), FILTERS), np.float32)
            for o in range(w):
                values += x[at + o] @ W[o]
            pooled.append((at, values))
        m = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        arg = np.full(m.shape, -1, np.int64)
        for k, (at, values) in enumerate(pooled):
            cuts = np.searchsorted(at, np.append(starts, len(flat)))
            for d in np.flatnonzero(np.diff(cuts)):
                part = values[cuts[d] : cuts[d + 1]]
                best = part.argmax(0)
                top = part[best, np.arange(FILTERS)]
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                m[d, cols] = np.maximum(top, 0)
                arg[d, cols] = np.where(top > 0, at[cuts[d] + best], -1)
        act = np.maximum(m + self.b, 0)
        return act, arg, act @ self.out + self.bias[0]

    def gradient(self, flat: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighed mean log loss, by embeddings, filter biases, output weights, output bias and filters."""
        act, arg, out = self.forward(flat, starts)
        d = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
        dact = d[:, None] * self.out * (act > 0)
        grads = [np.zeros_like(self.E), dact.sum(0), act.T @ d, np.array([d.sum()], np.float32), *(np.zeros_like(W) for W in self.W)]
        for k, w in enumerate(WIDTHS):
            who, col = np.nonzero(arg[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            at, g = arg[who, k * FILTERS + col], dact[who, k * FILTERS + col]
            for o in range(w):
                e = flat[at + o]
                np.add.at(grads[4 + k][o].T, col, g[:, None] * self.embedded(e))
                for row in np.divmod(e, len(self.E)):
                    np.add.at(grads[0], row, g[:, None] * self.W[k][o].T[col])
        grads[0][0] = 0
        return grads

    def score(self, texts: list[str | None]) -> np.ndarray:
        tokens = [words(t) for t in texts]
        flat, starts = self.layout([self.rows(t) for t in tokens])
        shift = np.array([self.cuts.get(language(t), self.cuts[""]) for t in tokens])
        return 1 / (1 + np.exp(-np.clip(self.forward(flat, starts)[2] - shift, -30, 30)))


def fit(texts: list[str | None], y: np.ndarray, seed: int = 11) -> Model:
    """Adam on documents, classes weighed alike, from random weights; the epoch of least loss on a fifth of the sample stays.

    Every second word or so is blanked in training, another each time, so no filter leans on one word alone. The same
    fifth sets the thresholds by language.
    """
    r = np.random.default_rng(seed)
    order = r.permutation(len(texts))
    tokens, y = [words(texts[k]) for k in order], y[order].astype(np.float32)
    # copies would make their own words look telling: of texts with the same least hash of a long word one is learned
    least = [int(hashes(long).min()) if (long := [w for w in t if len(w) > 8]) else -k for k, t in enumerate(tokens, 1)]
    once = sorted({(h, z): k for k, (h, z) in reversed(list(enumerate(zip(least, y, strict=True))))}.values())
    tokens, y = [tokens[k] for k in once], y[once]
    n = max(1, len(y) * 4 // 5)
    own = [np.unique(np.append(hashes(d), stem_hashes(d))) for d in map(list, map(set, tokens))]
    h, c = np.unique(np.concatenate(own[:n]), return_counts=True)
    model = Model(h[c >= LEAST_DOCS], seed)
    docs = [model.rows(t) for t in tokens]
    rest = list(range(n, len(y)) if len(y) - n >= 20 else range(len(y)))
    weight = np.where(y == 1, 0.5 / max(y[:n].mean(), 1e-3), 0.5 / max(1 - y[:n].mean(), 1e-3)).astype(np.float32)
    names = ("E", "b", "out", "bias")
    get = lambda: [getattr(model, k) for k in names] + model.W
    held = lambda: np.concatenate([model.forward(*model.layout([docs[k]]))[2] for k in rest])
    m, v, step, best = [np.zeros_like(p) for p in get()], [np.zeros_like(p) for p in get()], 0, None
    for _ in range(EPOCHS if n > 1000 else 3 * EPOCHS):
        for part in np.array_split(r.permutation(n), max(1, n // BATCH)):
            blanked = [np.where(r.random(len(docs[k])) < DROPPED, 0, docs[k]) for k in part]
            grads = model.gradient(*model.layout(blanked), y[part], weight[part])
            step += 1
            for k, (p, g) in enumerate(zip(get(), grads, strict=True)):
                g = g + DECAY * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p -= ((RATE_WORDS if k == 0 else RATE) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            model.E[0] = 0
        out = held()
        loss = float((weight[rest] * np.logaddexp(0, np.where(y[rest] == 1, -out, out))).mean())
        if best is None or loss < best[0]:
            best = loss, [p.copy() for p in get()], out
    for p, kept in zip(get(), best[1], strict=True):
        p[...] = kept
    out, spoken, truth = best[2], np.array([language(tokens[k]) for k in rest]), y[rest] == 1
    model.cuts[""] = _cut(out, truth)
    for name in LANGUAGES:
        mine = spoken == name
        if truth[mine].sum() >= 10 and (~truth[mine]).sum() >= 10:
            model.cuts[name] = _cut(out[mine], truth[mine])
    return model


def _cut(out: np.ndarray, toxic: np.ndarray, clean_weight: float = 3.0) -> float:
    """The threshold with the least weighed share of errors, in the middle of where it is so."""
    if toxic.all() or not toxic.any():
        return 0.0
    s = np.sort(out)
    cuts = np.concatenate(((s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    bad = np.array([(out[toxic] < c).mean() + clean_weight * (out[~toxic] >= c).mean() for c in cuts])
    best = cuts[bad <= bad.min() + 1e-12]
    return float(best[len(best) // 2])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold=None) -> DataFrame:
    """(id, score) for every row of ``docs``: how likely its toxic label is 1, from its whole text alone.

    Labels of rows where ``fold`` (a condition on labels) holds are learned. The language that picks the threshold is
    told from the text's words; the threshold is taken off the score's logit, so the decision is at 0.5 in every
    language. Null texts are empty and score like a text of unknown words; repeated rows score alike; null ids stay.
    Where labels lack a class the score is that of the other (0.5 with none). Other columns are not read.
    """
    score = _scorer(docs, labels, id_col, text_col, fold) or (lambda t: np.full(len(t), 0.5))
    return scored(docs, id_col, text_col, score)


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fold):
    prepare(docs.sparkSession)
    texts, y = training_sample(docs, labels, "toxic", id_col, text_col, F.lit(True) if fold is None else fold, SAMPLE_ROWS, SAMPLE_BYTES)
    if not len(y):
        return None
    if len(set(y)) == 1:
        return lambda t: np.full(len(t), float(y[0]))
    return fit(texts, y).score


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold=None) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, as they are, in whatever columns; no shuffle.

    Null texts are empty and are judged like a text of unknown words; repeated rows go or stay together; null ids and an
    empty table are like any other. Without labels of either class (score 0.5) no row can be judged and all stay.
    """
    score = _scorer(docs, labels, id_col, text_col, fold)
    if score is None:
        return docs

    @F.pandas_udf("double")
    def toxic(t: pd.Series) -> pd.Series:
        return pd.Series(score(t.tolist()))

    return docs.where(toxic(F.col(text_col).cast("string")) < CUT)
