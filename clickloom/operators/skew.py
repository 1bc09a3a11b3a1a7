"""Joins and aggregates that spread a heavy key; each gives what the plain one gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most rows, and characters of text in them, of a side that broadcast_join sends to every executor.
BROADCAST_ROWS, BROADCAST_CHARS = 1_000_000, 24 << 20


def salted_count(df: DataFrame, keys: list[str], salts: int = 10, name: str = "n") -> DataFrame:
    """Rows of each key, counted by (key, salt) first; the salt is a hash of the whole row, so a repeated task salts alike."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    return df.groupBy(*keys, salt.alias("_salt")).agg(F.count("*").alias("_part")).groupBy(*keys).agg(F.sum("_part").alias(name))


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 10) -> DataFrame:
    """Inner join in which every row of right meets each salt of left; both sides are shuffled, since Spark's size estimate leaves the copies out and would broadcast them all."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def heavy_keys(df: DataFrame, key: str, fraction: float = 0.1, n: int = 1, seed: int = 9) -> DataFrame:
    """The n keys with most rows in a sample."""
    return df.sample(fraction=fraction, seed=seed).groupBy(key).agg(F.count("*").alias("sampled")).orderBy(F.desc("sampled"), key).limit(n)


def skew_split_join(left: DataFrame, right: DataFrame, key: str, salts: int = 100, fraction: float = 0.1, n: int = 1) -> DataFrame:
    """Inner join in two branches: the heaviest keys of a sample salted, all others plain. The n keys are found once, and each side is read once a branch."""
    heavy = [r[0] for r in heavy_keys(left, key, fraction, n).collect()]  # n values
    if not heavy:
        return left.join(right, key)
    of_heavy = F.coalesce(F.col(key).isin([x for x in heavy if x is not None]), F.lit(False))
    salted = salted_join(left.where(of_heavy), right.where(of_heavy), key, salts)
    return left.where(~of_heavy).join(right, key).unionByName(salted)


def broadcast_join(left: DataFrame, right: DataFrame, key: str, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """Inner join with right on every executor if it has at most so many rows and characters, else by a shuffle."""
    texts = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in right.columns]
    n, size = right.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return left.join(F.broadcast(right) if n <= rows and size <= chars else right, key)


def materialised_sessions(actions: DataFrame, path: str) -> DataFrame:
    """Actions dealt by session and sorted by time once, and written, for jobs that read sessions in order; a session is rows on end in one file, never one array."""
    actions.repartition("session_id").sortWithinPartitions("session_id", "action_time", "action_id").write.mode("overwrite").parquet(path)
    return actions.sparkSession.read.parquet(path)
