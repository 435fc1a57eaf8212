"""Moving-block bootstrap paths in long form.

Block starts are data: (sim, blk, start) from arithmetic that SQL can repeat, or from a numpy generator on the driver
(their number is simulations times blocks, both parameters). A simulation's blocks are cut from its series' array of
steps, so a series must be of a size that one row can hold (bars of a few decades are some thousands); the long rows
that follow stay in the simulation's partition: drawing, cumulating and reducing need one shuffle, by (series, sim).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SIM, BLOCK, SEED = 2000, 20, 12345


def steps(closes: DataFrame, kind: str = "log", order: str = "t") -> DataFrame:
    """(series_id, t, step) for t from 1: differences of logs or of prices."""
    w = Window.partitionBy("series_id").orderBy(order)
    p, before = F.col("close_price"), F.lag("close_price").over(w)
    step = F.ln(p) - F.ln(before) if kind == "log" else p - before
    return closes.select("series_id", F.col(order).alias("t"), "close_price", step.alias("step")).where("step is not null")


def series_arrays(closes: DataFrame, kind: str = "log", outcome: DataFrame | None = None) -> DataFrame:
    """One row a series: first price, steps in order, and with ``outcome(series_id, t, outcome)`` its values in order."""
    s = steps(closes, kind)
    if outcome is not None:
        s = s.join(outcome, ["series_id", "t"])
    rows = F.sort_array(F.collect_list(F.struct("t", "step", *(["outcome"] if outcome is not None else []))))
    first = closes.groupBy("series_id").agg(F.min_by("close_price", "t").alias("start_price"))
    arrays = s.groupBy("series_id").agg(rows.alias("_r")).select("series_id", F.transform("_r", lambda x: x["step"]).alias("steps"), *([F.transform("_r", lambda x: x["outcome"]).alias("outcomes")] if outcome is not None else []))
    return arrays.join(first, "series_id")


def arith_start(sim: Column, blk: Column, n: Column, length: Column) -> Column:
    return F.pmod(F.pmod(sim * F.lit(1103515245) + blk * F.lit(12820163) + F.lit(SEED), F.lit(2147483647)), n - length + 1)


def jitter(sim: Column, width: float = 50.0) -> Column:
    """A start offset in [0, width) by arithmetic."""
    return F.pmod(sim * F.lit(7919) + F.lit(SEED), F.lit(10007)) / F.lit(10007.0) * F.lit(float(width))


def numpy_starts(spark: SparkSession, n: int, n_needed: int, n_sim: int = N_SIM, block: int = BLOCK, seed: int = SEED, width: float | None = None) -> DataFrame:
    """(sim, starts) from numpy's default generator: uniform whole numbers in [0, n - block]. With ``width`` also an
    ``offset`` of the start price, uniform in [0, width) and drawn after all starts from the same stream."""
    import numpy as np

    length = min(block, n)
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, n - length + 1, size=(n_sim, -(-n_needed // length)))
    if width is not None:
        rows = zip(range(n_sim), starts.tolist(), rng.uniform(0.0, width, n_sim).tolist())
        return spark.createDataFrame(list(rows), "sim long, starts array<long>, offset double")
    return spark.createDataFrame([(i, x) for i, x in enumerate(starts.tolist())], "sim long, starts array<long>")


def draws(arrays: DataFrame, n_sim: int = N_SIM, block: int | Column = BLOCK, starts: DataFrame | None = None) -> DataFrame:
    """(series_id, start_price, sim, t, step [, outcome, offset]) with t from 1 to the number of steps. The length of blocks
    may be a column of ``arrays``; an offset comes with ``starts``."""
    n = F.size("steps")
    a = arrays.withColumn("_n", n).withColumn("_l", F.least(n, block if isinstance(block, Column) else F.lit(block))).withColumn("_k", F.ceil(F.col("_n") / F.col("_l")).cast("int"))
    a = a.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sim - 1).cast("long"))))
    if starts is None:
        a = a.withColumn("starts", F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda b: arith_start(F.col("sim"), b.cast("long"), F.col("_n"), F.col("_l")).cast("int")))
    else:
        a = a.join(starts, "sim")
    a = a.repartition("series_id", "sim")
    cut = {"step": "steps", **({"outcome": "outcomes"} if "outcomes" in arrays.columns else {})}

    def laid(values: str) -> Column:
        return F.slice(F.flatten(F.transform("starts", lambda s: F.slice(F.col(values), (s + 1).cast("int"), F.col("_l")))), F.lit(1), F.col("_n"))

    parts = {k: laid(v) for k, v in cut.items()}
    keys = ["series_id", "start_price", "sim", *(["offset"] if "offset" in a.columns else [])]
    zipped = a.select(*keys, F.arrays_zip(*[x.alias(k) for k, x in parts.items()]).alias("z"))
    rows = zipped.select(*keys, F.posexplode("z").alias("t", "z"))
    return rows.select(*keys, (F.col("t") + 1).cast("long").alias("t"), *[F.col(f"z.{k}").alias(k) for k in cut])


def paths(drawn: DataFrame, kind: str = "log", floor: float = 1.0, offset: Column | None = None) -> DataFrame:
    """(series_id, sim, t, price [, outcome]) with the start at t = 0. Additive paths stop at ``floor``."""
    offset = F.col("offset") if offset is None and "offset" in drawn.columns else offset
    start = F.col("start_price") + offset if offset is not None else F.col("start_price")
    w = Window.partitionBy("series_id", "sim").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("step").over(w)
    price = F.exp(F.ln(start) + run) if kind == "log" else F.greatest(start + run, F.lit(floor))
    more = ["outcome"] if "outcome" in drawn.columns else []
    rows = drawn.select("series_id", "sim", "t", price.alias("price"), start.alias("_s"), *more)
    # the start row is made beside the first one, in its partition
    first = F.struct(F.lit(0).cast("long").alias("t"), F.col("_s").alias("price"), *([F.lit(None).cast("double").alias("outcome")] if more else []))
    own = F.struct("t", "price", *more)
    both = F.explode(F.when(F.col("t") == 1, F.array(first, own)).otherwise(F.array(own)))
    return rows.select("series_id", "sim", both.alias("x")).select("series_id", "sim", "x.*")
