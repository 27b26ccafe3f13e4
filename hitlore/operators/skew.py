"""Per-key results where a few keys hold most rows: equal-sized chunks of keys with exact offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_within(rows: DataFrame, key: str, seq: str, *, part_rows: int = 250_000) -> DataFrame:
    """rows with `part`, `offset` and `row_no`: the place of a row among those of its key in the order of seq, from 0.

    The input is divided into parts by seq; the rows of each key are counted per part, and the prefix sums of the counts are
    the exact offset of a key in each part. So no task sorts more of a key than stands in one part. Parts are a function of
    seq: a task that is run again after a loss numbers its rows as before. key and seq must not be NULL.
    """
    parted = rows.withColumn("part", F.floor(F.col(seq) / part_rows).cast("long"))
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy(F.col(key).alias("__k"), F.col("part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__k", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("offset"))
    placed = parted.withColumn("__place", F.row_number().over(Window.partitionBy(key, "part").orderBy(seq)))
    joined = placed.join(offsets, (F.col(key) == F.col("__k")) & (F.col("part") == F.col("__p")))
    return joined.withColumn("row_no", F.col("offset") + F.col("__place") - 1).drop("__k", "__p", "__place")


def per_key(rows: DataFrame, *, chunk_rows: int = 100_000, part_rows: int = 250_000) -> DataFrame:
    """key, n, total, errors, first_time, last_time, last_seq, error_run: results per key, no task holding more than a chunk of one.

    rows has the columns key (any grouping expression, e.g. a struct), seq (long, unique), time, amount and error
    (boolean). error_run is the longest run of consecutive errors of the key in the order of seq: it depends on order over
    chunk boundaries, so it is merged from boundary states.

    Method: keys are counted per part of the input, and prefix sums of the counts number the rows of a key (numbered_within).
    Row number / chunk_rows is a row's chunk; each chunk of a key is reduced to a state (sums, and the run of errors at its
    head, at its tail and within), and the states of a key, ordered by chunk, are merged.

    Defined cases: a NULL key or seq is left out; NULL amounts count as 0, a NULL error as no error, NULL times do not
    count; further columns are ignored; an empty table gives no rows.
    """
    clean = rows.where(F.col("key").isNotNull() & F.col("seq").isNotNull()).select(
        "key",
        "seq",
        "time",
        F.coalesce(F.col("amount"), F.lit(0)).cast("long").alias("amount"),
        F.coalesce(F.col("error"), F.lit(False)).alias("error"),
    )
    numbered = numbered_within(clean, "key", "seq", part_rows=part_rows).withColumn("chunk", F.floor(F.col("row_no") / chunk_rows))
    # A chunk lies in few parts. Runs are found within (key, part, chunk), which is where the rows are, and each such piece
    # becomes one state; row_no orders the pieces.
    piece = Window.partitionBy("key", "part").orderBy("seq")
    good = F.when(~F.col("error"), F.col("row_no"))
    runs = numbered.withColumn("since_good", F.last(good, ignorenulls=True).over(piece.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.when(F.col("error"), F.col("row_no") - F.greatest(F.coalesce(F.col("since_good"), F.lit(-1)), F.col("offset") - 1, F.col("chunk") * chunk_rows - 1))
    states = runs.withColumn("run", F.coalesce(run, F.lit(0))).groupBy("key", "part", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("total"),
        F.sum(F.col("error").cast("long")).alias("errors"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.max("seq").alias("last_seq"),
        F.min("row_no").alias("from_row"),
        F.max("run").alias("inner"),
        (F.coalesce(F.min(good), F.max("row_no") + 1) - F.min("row_no")).alias("head"),
        (F.max("row_no") - F.coalesce(F.max(good), F.min("row_no") - 1)).alias("tail"),
    )
    return merge_states(states)


def merge_states(states: DataFrame) -> DataFrame:
    """Results of keys from the states of their pieces in row order."""
    along = Window.partitionBy("key").orderBy("from_row")
    full = F.col("head") == F.col("n")
    # A run over pieces: the tail of a piece, whole pieces of errors, the head of the next. `since` numbers the stretches
    # between pieces that hold a row without error.
    broken = F.sum((~full).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    linked = states.withColumn("stretch", F.coalesce(broken, F.lit(0)))
    # A piece that is broken ends its stretch with its head and begins the next one with its tail.
    opened = F.when(~full, F.col("tail")).otherwise(F.lit(0))
    spans = linked.withColumn("lead_in", F.coalesce(F.lag(opened).over(along), F.lit(0)))
    joined = spans.groupBy("key", "stretch").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("errors").alias("errors"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.max("last_seq").alias("last_seq"),
        F.max("inner").alias("inner"),
        (F.sum("head") + F.sum("lead_in")).alias("across"),
    )
    return joined.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("errors").alias("errors"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.max("last_seq").alias("last_seq"),
        F.max(F.greatest("inner", "across")).alias("error_run"),
    )
