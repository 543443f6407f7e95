"""The tables of the store: Parquet folders, upserts by key, the evaluation cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import hit_rate as rate_of
from ..operators.relational import accumulate, missing, upsert

KEYS = {"games": ["game_id"], "moves": ["game_id", "ply"], "positions": ["pos_key"], "move_themes": ["game_id", "ply", "theme"], "position_eval": ["pos_key", "depth", "multipv"]}


class Store:
    """Tables under a folder. Each write makes a new version beside the old one, so a lost write leaves the old table whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, table: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.path}/{table}")
        done = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(p.getName()[1:]) for p in done if fs.exists(path(f"{p}/_SUCCESS")))

    def read(self, table: str) -> DataFrame | None:
        found = self._versions(table)
        return self.spark.read.parquet(f"{self.path}/{table}/v{found[-1]}") if found else None

    def put(self, table: str, rows: DataFrame) -> DataFrame:
        """Upserts by the table's key; of new rows with one key the greatest stays. Columns that one side lacks are null there."""
        return self._write(table, upsert(*self._aligned(table, rows), KEYS[table]))

    def add_positions(self, rows: DataFrame) -> DataFrame:
        """Adds the ``seen_count`` of positions to what the store has; of one that is known already all else stays.

        For batches of games that come once each: adding a batch again counts it again, where ``put`` would not.
        """
        return self._write("positions", accumulate(*self._aligned("positions", rows), KEYS["positions"], "seen_count", ["ply", "fen"]))

    def _aligned(self, table: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The table's rows and the new ones, each with the columns of both."""
        old = self.read(table)
        old = rows.limit(0) if old is None else old
        fill = lambda a, b: a.withColumns({c: F.lit(None).cast(b.schema[c].dataType) for c in b.columns if c not in a.columns})
        old = fill(old, rows)
        return old, fill(rows, old)

    def _write(self, table: str, merged: DataFrame) -> DataFrame:
        """Writes the next version, over what a lost write left of it. The version before the last is removed, so that readers
        of the last one before this write aren't disturbed."""
        found = self._versions(table)
        merged.write.mode("overwrite").parquet(f"{self.path}/{table}/v{found[-1] + 1 if found else 0}")
        fs, path = self._fs()
        for v in found[:-1]:
            fs.delete(path(f"{self.path}/{table}/v{v}"), True)
        return self.read(table)

    def stats(self) -> DataFrame:
        """One row: games, moves, themes and subjects."""
        return stats(self.read("games"), self.read("moves"), self.read("move_themes"))


def stats(games: DataFrame, moves: DataFrame, themes: DataFrame, game: str = "game_id", subject: str = "subject", mark: tuple[str, ...] = ("game_id", "ply", "theme")) -> DataFrame:
    """One row (games, moves, themes, subjects): rows of games and moves, distinct marks, distinct subjects."""
    g = games.agg(F.count(F.col(game)).alias("games"), F.countDistinct(subject).alias("subjects"))
    m, t = moves.agg(F.count("*").alias("moves")), themes.agg(F.countDistinct(*mark).alias("themes"))
    return g.join(F.broadcast(m)).join(F.broadcast(t)).select("games", "moves", "themes", "subjects")  # one row each


def missing_evaluations(positions: DataFrame, cache: DataFrame, depth: int, multipv: int) -> DataFrame:
    """Positions that the cache has not at that depth and width: the engine's work list."""
    have = cache.where((F.col("depth") == depth) & (F.col("multipv") == multipv)).select("pos_key")
    return missing(positions.select("pos_key", "fen").distinct(), have, ["pos_key"])


def hit_rate(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(hits, misses, rate) of requests (pos_key, depth, multipv)."""
    return rate_of(requests, cache, KEYS["position_eval"]).drop("requests")


def fingerprint(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key): identifies the embeddings of these documents by this model; independent of the rows' order."""
    each = F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.col(text_col)), 256)
    low = lambda k: F.conv(F.substring(each, 1 + 8 * k, 8), 16, 10).cast("long")
    sums = docs.agg(*(F.coalesce(F.sum(low(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(8)), F.count("*").cast("string").alias("n"))
    return sums.select(F.substring(F.sha2(F.concat_ws("|", F.lit(model), *sums.columns), 256), 1, 16).alias("key"))
