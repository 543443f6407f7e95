"""Embedding near-duplicates over a product-quantised inverted index, with exact rerank.

Coarse lists come from k-means; a vector's residual to its list's centre is coded by subspace. Searches compare the exact
query with the codes by table lookups (asymmetric distances) and rerank what is left by exact cosine. All lists are probed
that can hold a link: the plane between list and nearest list lies within its distance. A code is passed on if its distance
is at most the link's plus the stored coding error of its vector. Neither loses a link. Of two lists one asks the other, so
a pair meets once and counts for both. Vectors of each length have lists and codes of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, prepare

COSINE = 0.95
#: Bound of the sample that lists and codes are fitted on, dealt out to the lengths; of each length so many at least.
SAMPLE, LEAST_SAMPLE = 16_384, 256
MOST_LISTS, SUBSPACES, CODES, ROUNDS = 1024, 8, 256, 6
#: Vectors of a group of lists, and queries of it, that meet in one task at most (on average).
BLOCK = 8192
#: Queries that are compared at a time, and the share of pairs from which one product of matrices is cheaper than single ones.
TURN, DENSE = 1024, 1 / 16
SLACK = 1e-6


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([_square(part, c).argmin(1) for part in np.array_split(x, max(1, len(x) // 2048))])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codebook:
    """Centres of the coarse lists, the group of each list, and the code words of each subspace of the residuals."""

    centres: np.ndarray
    groups: np.ndarray
    words: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, groups: int) -> Codebook:
        centres = _kmeans(x, lists, 1)
        rest = x - centres[_square(x, centres).argmin(1)]
        near = _square(centres, _kmeans(centres, min(groups, lists), 3)).argmin(1)
        return cls(centres, near, [_kmeans(part, CODES, 2) for part in np.array_split(rest, min(SUBSPACES, x.shape[1]), axis=1)])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([w.shape[1] for w in self.words])[:-1], axis=1)

    def encode(self, x: np.ndarray):
        """(list, codes, coding error) of each row."""
        home = _square(x, self.centres).argmin(1)
        rest = self.parts(x - self.centres[home])
        codes = np.stack([_square(p, w).argmin(1) for p, w in zip(rest, self.words, strict=True)], axis=1).astype(np.uint8)
        left = sum(((p - w[c]) ** 2).sum(1) for p, w, c in zip(rest, self.words, codes.T, strict=True))
        return home, codes, np.sqrt(left)

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> np.ndarray:
        """Whether the list can hold a vector within ``radius`` of the row and is asked by the row's (rows x lists)."""
        d = _square(x, self.centres)
        gap = np.sqrt(_square(self.centres, self.centres))
        near = d - d[np.arange(len(x)), home][:, None] <= 2 * radius * gap[home] + SLACK
        a, b = home[:, None], np.arange(len(self.centres))[None]
        return near & ((a == b) | (((a + b) % 2 == 0) == (a < b)))

    def close(self, q: np.ndarray, which: int, codes: np.ndarray, error: np.ndarray, radius: float) -> np.ndarray:
        """Whether the code may lie within ``radius`` of the query, by table lookups (codes x queries)."""
        total = np.zeros((len(codes), len(q)))
        for p, w, c in zip(self.parts(q - self.centres[which]), self.words, codes.T, strict=True):
            total += _square(w, p)[c]
        return total <= np.square(radius + error + SLACK)[:, None]


def _sent(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: as single floats where that is exact, else as doubles."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return [(s if e else d).tobytes() for s, d, e in zip(small, x, (small == x).all(1), strict=True)]


def _got(rows: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in rows])


def _cosines(q: np.ndarray, y: np.ndarray, k: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Cosines of the pairs (q[k], y[j]) of unit vectors' rows with their norms; near ``least`` always from single products."""
    (q, qn), (y, yn) = q, y

    def single(k, j):
        out = np.empty(len(k))
        for at in range(0, len(k), 65_536):
            a, b = k[at : at + 65_536], j[at : at + 65_536]
            out[at : at + 65_536] = np.einsum("ij,ij->i", q[a], y[b]) / (qn[a] * yn[b])
        return out

    if len(k) < DENSE * len(q) * len(y):
        return single(k, j)
    cos = ((q @ y.T) / (qn[:, None] * yn[None]))[k, j]
    edge = np.flatnonzero(np.abs(cos - least) < 1e-9)
    cos[edge] = single(k[edge], j[edge])
    return cos


def _cell(book: Codebook, dim: int, rows: pd.DataFrame, least: float, radius: float) -> pd.DataFrame:
    """Links of a block of queries with a block of a group of lists: a count for each vector, and a spanning forest."""
    mine, asked = rows[rows.role == 0].sort_values("home"), rows[rows.role == 1]
    empty = pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
    if not len(mine) or not len(asked):
        return empty
    y, q = _got(mine.vec, dim), _got(asked.vec, dim)
    yn, qn = np.sqrt((y * y).sum(1)), np.sqrt((q * q).sum(1))
    codes, error = np.stack([np.frombuffer(c, np.uint8) for c in mine.code]), mine.error.to_numpy()
    homes, home = mine.home.to_numpy(), asked.home.to_numpy()
    lists, starts = np.unique(homes, return_index=True)
    ends = np.append(starts[1:], len(homes))
    uy, uq, cy, cq = mine.uid.to_numpy(), asked.uid.to_numpy(), mine.copies.to_numpy(), asked.copies.to_numpy()
    ny, nq = np.zeros(len(y), np.int64), np.zeros(len(q), np.int64)
    label, us, vs = np.arange(len(y)), [], []
    for at in range(0, len(q), TURN):
        unit = q[at : at + TURN] / qn[at : at + TURN, None]
        asks, pairs = book.probes(unit, home[at : at + TURN], radius), []
        for which, a, b in zip(lists.tolist(), starts.tolist(), ends.tolist(), strict=True):
            some = np.flatnonzero(asks[:, which])
            if not len(some):
                continue
            j, k = np.nonzero(book.close(unit[some], which, codes[a:b], error[a:b], radius))
            there = at + some
            cos = _cosines((q[there], qn[there]), (y[a:b], yn[a:b]), k, j, least)
            k, j = there[k], a + j
            ok = (cos >= least) & ((home[k] != which) | (uq[k] < uy[j]))
            pairs.append((k[ok], j[ok]))
        if not pairs:
            continue
        k, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        np.add.at(ny, j, cq[k])
        np.add.at(nq, k, cy[j])
        by = np.argsort(k, kind="stable")
        k, j = k[by], j[by]
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1) if len(k) else ():
            roots, one = np.unique(label[j[part]], return_index=True)
            us += [uq[k[part[0]]]] * len(roots)
            vs += uy[j[part[one]]].tolist()
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    known = np.concatenate((uy[ny > 0], uq[nq > 0]))
    counts = np.concatenate((ny[ny > 0], nq[nq > 0]))
    us, vs = np.array(us, np.int64), np.array(vs, np.int64)
    return pd.DataFrame({"u": np.concatenate((known, us)), "v": np.concatenate((known, vs)), "links": np.concatenate((counts, np.zeros(len(us), np.int64)))}).astype("int64")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: ``n_links`` other rows have cosine >= ``cosine`` with it.

    ``component_id`` is the smallest id reachable through links, itself included. Null, zero and non-finite vectors link
    with nothing and are components of their own; vectors of different lengths don't link.
    Copies are searched once and counted for all; repeated ids are rows of their own; a null id stays and never names a
    component with other ids. Other columns are not read. An empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vec", lambda x: x != 0)
    good = F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True))
    # far from 1, components are scaled by a power of two, which is exact, so that no square overflows or vanishes
    most = F.array_max(F.transform("vec", F.abs))
    by = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(most)).cast("double"))))
    scaled = F.when((most > 1e100) | (most < 1e-100), F.transform("vec", lambda x: x * by)).otherwise(F.col("vec"))
    whole = rows.where(good).withColumn("vec", scaled)
    # an id for each distinct vector; fixed by the checkpoint
    classes = whole.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    sizes = {r.dim: r["count"] for r in classes.groupBy(F.size("vec").alias("dim")).count().collect()}
    if not sizes:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    total = sum(sizes.values())
    share = {d: max(SAMPLE * n / total, LEAST_SAMPLE) / n for d, n in sizes.items()}
    shares = F.broadcast(spark.createDataFrame([*share.items()], "dim int, share double"))
    drawn = classes.select("vec", "uid", F.size("vec").alias("dim")).join(shares, "dim").where(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    samples: dict[int, list] = {}
    for r in drawn.orderBy("uid").select("dim", "vec").collect():
        samples.setdefault(r.dim, []).append(np.array(r.vec, np.float64))

    def fitted(dim: int) -> Codebook:
        x = np.stack(samples.pop(dim))
        x /= np.sqrt((x * x).sum(1))[:, None]
        return Codebook.fit(x, int(min(MOST_LISTS, max(1, np.sqrt(sizes[dim]) / 2), len(x))), -(-sizes[dim] // BLOCK))

    book = spark.sparkContext.broadcast({dim: fitted(dim) for dim in sizes})
    radius = float(np.sqrt(2 - 2 * cosine))

    def index(batches):
        names = ["dim", "vec", "uid", "copies", "home", "at", "code", "error", "asked"]
        for b in batches:
            vecs, lengths = b.column(0).to_numpy(zero_copy_only=False), b.column(0).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                k, mine = np.flatnonzero(lengths == dim), book.value[dim]
                x = np.stack(vecs[k])
                unit = x / np.sqrt((x * x).sum(1))[:, None]
                home, codes, error = mine.encode(unit)
                asked = [np.unique(mine.groups[r]).tolist() for r in mine.probes(unit, home, radius)]
                at = pa.array(k)
                cols = [pa.array(_sent(x), pa.binary()), b.column(1).take(at), b.column(2).take(at), pa.array(home, pa.int32()), pa.array(mine.groups[home], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(asked, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), dim), pa.int32()), *cols], names=names)

    indexed = classes.select("vec", "uid", "copies").mapInArrow(index, "dim int, vec binary, uid long, copies long, home int, at int, code binary, error double, asked array<int>").checkpoint()
    held = indexed.groupBy("dim", F.col("at").alias("group")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asking = indexed.select("dim", F.explode("asked").alias("group")).groupBy("dim", "group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
    cells = F.broadcast(held.join(asking, ["dim", "group"]))  # at most MOST_LISTS rows for each length
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = ["dim", "group"]
    stored = indexed.withColumn("group", F.col("at")).join(cells, near).select(*near, own("blocks").alias("i"), every("turns").alias("j"), F.lit(0).alias("role"), "uid", "copies", "home", "vec", "code", "error")
    queries = indexed.withColumn("group", F.explode("asked")).join(cells, near).select(*near, every("blocks").alias("i"), own("turns").alias("j"), F.lit(1).alias("role"), "uid", "copies", "home", "vec", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"))
    found = stored.union(queries).groupBy(*near, "i", "j").applyInPandas(lambda k, p: _cell(book.value[int(k[0])], int(k[0]), p, cosine, radius), "u long, v long, links long").checkpoint()
    counts = found.where("links > 0").groupBy(F.col("u").alias("uid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0").select("u", "v")).withColumnRenamed("node", "uid")
    named = classes.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")).join(counts, "uid", "left")
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "root").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = whole.join(named, "vec").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
