"""A left join that stays even when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows that one task may hold of a key, and how many keys can be hot: a key is, if it also holds one in so many rows.
HOT_ROWS, HOT_KEYS = 100_000, 1_000
#: Into so many buckets keys are hashed where only their rows are counted.
BUCKETS = 1 << 13


def hot_keys(counts: DataFrame, min_rows: int = HOT_ROWS) -> dict[int, int]:
    """Hashes and numbers of salts of the hot keys, from the rows ``n`` of every hash ``h``; one pass, run at once.

    A hot key holds more than ``min_rows`` rows and more than one in ``HOT_KEYS`` of all, so there are fewer
    than ``HOT_KEYS`` of them, whatever the size of the table. What comes to the driver is one pair of numbers
    for each key with more than ``min_rows`` rows.
    """
    many = F.when(F.col("n") > min_rows, F.struct("h", "n"))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.collect_list(many).alias("many")).first()
    least = max(min_rows, row["all"] // HOT_KEYS)
    return {h: -(-n // least) for h, n in row["many"] if n > least}


def salts_of(hot: dict[int, int], keys: list[str]) -> Column:
    """How many salts a key is spread over, read from the short list of hot ones: no join, so no shuffle by the bare key."""
    hashes, salts = (F.array(*map(F.lit, x)).cast(f"array<{kind}>") for x, kind in ((hot.keys(), "long"), (hot.values(), "int")))
    place = F.array_position(hashes, F.xxhash64(*keys)).cast("int") - 1
    return F.coalesce(F.get(salts, F.nullif(place, F.lit(-1))), F.lit(1))


def in_hot_buckets(counts: DataFrame, keys: list[str], min_rows: int = HOT_ROWS) -> Column | None:
    """Whether the key of a row is hot or shares its bucket with a hot one; None when no key is hot.

    ``counts`` has rows ``n`` by key, in any number of parts. They are summed by bucket of the hashed key, at
    once: a task sends one small row for each bucket it meets, whatever the number of keys.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    hot = hot_keys(counts.select(bucket.alias("h"), "n").groupBy("h").agg(F.sum("n").alias("n")), min_rows)
    return bucket.isin(list(hot)) if hot else None


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    counts: DataFrame | None = None,
    min_rows: int = HOT_ROWS,
    spread: list[str] | None = None,
) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key.

    A hot key is spread over as many salts as it takes for each to hold about ``min_rows`` rows, by a hash
    of ``spread`` (all left columns by default); its right row is repeated as often. Each side is shuffled
    once, by key and salt; without hot keys this is a plain join by key, whose partitions later steps by
    that key use again. Results are the same as of a plain left join. The rows of every key are counted at
    once, by the hash of the key where ``counts`` does not give them.
    """
    if counts is None:
        # Keys whose hashes meet count as one: at worst one more key is spread.
        hashed = left.select(F.xxhash64(*keys).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    else:
        hashed = counts.select(F.xxhash64(*keys).alias("h"), "n")
    hot = hot_keys(hashed, min_rows)
    if not hot:
        return left.join(right, keys, "left")
    salts = salts_of(hot, keys)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*(spread or left.columns)), salts).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")
