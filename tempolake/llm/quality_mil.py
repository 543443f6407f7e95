"""Document quality by attention-based multiple-instance learning: a document is a bag of passages, labelled as a whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released

PASSAGE_BYTES = 512
#: Bound of the sample that the model is fitted on: labelled rows of either class, each of so many bytes at most.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 32_768
#: Passages of the sample that are held in memory at most: texts beyond it, in random order, are not learned from.
FIT_PASSAGES = 80_000
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 24, 16, 12, 3e-3, 1e-4
CUT = 0.7

# Byte classes: lower case, upper case, digits, blank, line end, tab, the marks below one by one, other ASCII, non-ASCII lead
# and trail bytes. Fixed values.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
_CLASSES = 8 + len(_MARKS) + 1
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c == b" " else 4 if _c == b"\n" else 5 if _c == b"\t" else 8 + _MARKS.index(_c) if _c in _MARKS else 6 if _b >= 0xC0 else 7 if _b >= 0x80 else 8 + len(_MARKS)
FEATURES = _CLASSES * _CLASSES + 4


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of every text); a text has one passage at least, null is empty.

    Features are the square roots of byte-class pair shares, and how much of the passage repeats earlier words of it,
    its mean word length, and its fill.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in raw], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.cumsum(counts) - counts
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum(sizes) - sizes
    where = np.arange(len(data)) - np.repeat(starts, sizes)
    of = np.repeat(first, sizes) + where // PASSAGE_BYTES
    n, kinds = int(counts.sum()), _CLASS[data]
    pair = kinds[:-1] * _CLASSES + kinds[1:]
    same = of[:-1] == of[1:]
    shares = np.bincount(of[:-1][same] * (FEATURES - 4) + pair[same], minlength=n * (FEATURES - 4)).reshape(n, -1).astype(np.float32)
    length = np.bincount(of, minlength=n).astype(np.float32)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :-4] = np.sqrt(shares / np.maximum(length, 1)[:, None])
    repeats, words = np.zeros(n, np.float32), np.zeros(n, np.float32)
    k = 0
    for b in raw:
        for at in range(0, max(1, len(b)), PASSAGE_BYTES):
            w = b[at : at + PASSAGE_BYTES].split()
            words[k] = len(w)
            repeats[k] = 1 - len(set(w)) / len(w) if w else 0
            k += 1
    out[:, -4] = repeats
    out[:, -3] = np.log1p(length / np.maximum(words, 1))
    out[:, -2] = length / PASSAGE_BYTES
    out[:, -1] = words == 0
    return out, first


@dataclass
class Model:
    """Encoder, gated attention and output weights, with the shift that puts the decision at ``CUT``."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    shift: float = 0.0

    def forward(self, x: np.ndarray, first: np.ndarray):
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["a"]
        sizes = np.diff(np.append(first, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, g, a, sizes, z, z @ w["c"] + w["d"][0]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, first = passages(texts)
        return 1 / (1 + np.exp(-np.clip(self.forward(self.scaled(x), first)[-1] + self.shift, -30, 30)))

    def gradient(self, x, first, y, weight):
        w = self.w
        h, t, g, a, sizes, z, out = self.forward(x, first)
        d = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / weight.sum()
        dz = np.repeat(d[:, None] * w["c"][None], sizes, axis=0)
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
        dt, dg = da[:, None] * w["a"] * g * (1 - t * t), da[:, None] * w["a"] * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ da, "c": z.T @ d, "d": np.array([d.sum()])}


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``passages`` in half precision of as many texts as ``FIT_PASSAGES`` allow, made a few texts at a time."""
    counts = np.array([max(1, -(-len((t or "").encode("utf-8", "surrogatepass")) // PASSAGE_BYTES)) for t in texts])
    ends = np.cumsum(counts)
    kept = max(1, int(np.searchsorted(ends, FIT_PASSAGES, "right")))
    x = np.empty((int(ends[kept - 1]), FEATURES), np.float16)
    first = ends[:kept] - counts[:kept]
    for k in range(0, kept, 32):
        last = min(k + 32, kept)
        x[first[k] : ends[last - 1]] = passages(texts[k:last])[0]
    return x, first


def fit(texts: list[str | None], y: np.ndarray, seed: int = 7) -> Model:
    """Adam on bags, classes weighed alike; the last fifth of the sample sets the shift, clean documents weighing more."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(texts))
    texts, y = [texts[k] for k in order], y[order].astype(np.float32)
    x, first = _bags(texts)
    y = y[: len(first)]
    sums = np.zeros((2, FEATURES))
    for k in range(0, len(x), 4096):
        part = x[k : k + 4096].astype(np.float64)
        sums += part.sum(0), (part * part).sum(0)
    mean = sums[0] / len(x)
    model = Model(mean.astype(np.float32), (np.sqrt(np.maximum(sums[1] / len(x) - mean * mean, 0)) + 1e-2).astype(np.float32), {})
    draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    model.w = {"E": draw(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
    ends = np.append(first[1:], len(x))
    n = max(1, len(y) * 4 // 5)
    weight = np.where(y == 1, 0.5 / max(y[:n].mean(), 1e-3), 0.5 / max(1 - y[:n].mean(), 1e-3)).astype(np.float32)
    m, v, step = {k: 0.0 for k in model.w}, {k: 0.0 for k in model.w}, 0
    for _ in range(max(EPOCHS, 4000 // max(1, n // 32) // 2 if n < 1500 else EPOCHS)):
        for part in np.array_split(r.permutation(n), max(1, n // 32)):
            rows = np.concatenate([np.arange(first[k], ends[k]) for k in part])
            sizes = ends[part] - first[part]
            grad = model.gradient(model.scaled(x[rows].astype(np.float32)), np.cumsum(sizes) - sizes, y[part], weight[part])
            step += 1
            for k, g in grad.items():
                g = g + DECAY * model.w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.w[k] = (model.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    held = n if len(y) - n >= 20 else 0
    out = []
    for k in range(held, len(y), 32):
        last = min(k + 32, len(y))
        out.append(model.forward(model.scaled(x[first[k] : ends[last - 1]].astype(np.float32)), first[k:last] - first[k])[-1])
    model.shift = float(np.log(CUT / (1 - CUT)) - _best_cut(np.concatenate(out), y[held:] == 1))
    return model


def _best_cut(out: np.ndarray, clean: np.ndarray, clean_weight: float = 4.0) -> float:
    """The cut with the least weighed share of errors, in the middle of where it is so."""
    if clean.all() or not clean.any():
        return float(out.min()) - 1 if clean.all() else float(out.max()) + 1
    s = np.sort(out)
    cuts = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2))
    bad = np.array([clean_weight * (out[clean] < c).mean() + (out[~clean] >= c).mean() for c in cuts])
    best = cuts[bad <= bad.min() + 1e-12]
    return float(best[len(best) // 2])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, fold, rows: int, most_bytes: int):
    """At most ``rows`` labelled (text, label) rows of either class outside the held-out fold, picked by hash of the id."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & fold).groupBy(id_col).agg(F.max(label).alias("y"))
    picked = None
    for y in (0, 1):
        some = marks.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(2 * rows)
        picked = some if picked is None else picked.union(some)
    # the sample's ids are bounded by the two limits, so they may be broadcast
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), id_col)
    texts = texts.where(F.octet_length("text") <= most_bytes)
    found = []
    for y in (0, 1):
        found += texts.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col, "text").limit(rows).select("text", "y").collect()
    return [r.text for r in found], np.array([r.y for r in found], np.int64)


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold=None) -> DataFrame:
    """(id, score) for every row of ``docs``: how likely its quality label is 1, from its whole text alone.

    Labels of rows where ``fold`` (a condition on labels) holds are learned. Null texts are empty; empty texts are one
    empty passage; repeated rows score alike; null ids stay. Where labels lack a class the score is that of the other
    (0.5 with none). Other columns are not read.
    """
    prepare(docs.sparkSession)
    texts, y = training_sample(docs, labels, "quality", id_col, text_col, F.lit(True) if fold is None else fold, SAMPLE_ROWS, SAMPLE_BYTES)
    only = None if len(set(y)) == 2 else float(y[0]) if len(y) else 0.5
    model = fit(texts, y) if only is None else None
    return scored(docs, id_col, text_col, lambda t: np.full(len(t), only) if model is None else model.score(t))


def scored(docs: DataFrame, id_col: str, text_col: str, score) -> DataFrame:
    def run(batches):
        for b in batches:
            s = score(b.column(1).to_pylist()).astype(np.float64) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(released(run), "id long, score double")
