"""Rank statistics and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """rows with ``rank``: ties share their mean rank. Distinct values with their counts are ordered, not rows."""
    counts = numbered(rows.groupBy(value).agg(F.count("*").alias("_n")), [F.col(value)], "_place")
    # Values are summed up by blocks of places, then inside each block.
    block = F.floor((F.col("_place") - 1) / 100_000)
    totals = counts.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_t"))
    before = totals.select("_block", (F.sum("_t").over(Window.orderBy("_block")) - F.col("_t")).alias("_before"))  # a row a block
    upto = counts.withColumn("_block", block).join(F.broadcast(before), "_block").withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy("_block").orderBy("_place")))
    return rows.join(upto.select(value, "_n", "_to"), value).withColumn("rank", F.col("_to") - (F.col("_n") - 1) / 2.0).drop("_n", "_to")


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """groups, n, h: the Kruskal-Wallis statistic without tie correction."""
    sums = average_ranks(rows, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    total = F.sum("n")
    return sums.agg(F.count("*").alias("groups"), total.alias("n"), F.round(12.0 / (total * (total + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (total + 1), 6).alias("h"))


def permuted_kruskal(rows: DataFrame, group: str, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """h, p: the statistic and its permutation p-value (hits + 1) / (rounds + 1). Ranks are made once; a round deals the groups to
    the ranks anew, in one task a round's seed, over 12 bytes a row of ranks and groups."""
    import numpy as np

    spark = rows.sparkSession
    found = average_ranks(rows.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null"), "v")
    data = found.select("g", "rank").orderBy("g", "rank").toArrow()
    names, of = np.unique(np.array(data.column(0).to_pylist(), dtype=object), return_inverse=True)
    shared = spark.sparkContext.broadcast((of.astype(np.int32), data.column(1).to_numpy()))
    if len(of) == 0:
        return spark.createDataFrame([], "h double, p double")

    def statistic(of, ranks):
        n = np.bincount(of)
        return 12.0 / (len(of) * (len(of) + 1)) * (np.bincount(of, ranks) ** 2 / n).sum() - 3 * (len(of) + 1)

    seen = float(statistic(*shared.value))

    def run(batches):
        import numpy as np
        import pandas as pd

        of, ranks = shared.value
        for pdf in batches:
            yield pd.DataFrame({"h": [statistic(np.random.default_rng(seed + int(i)).permutation(of), ranks) for i in pdf.id]})

    return spark.range(rounds).mapInPandas(run, "h double").agg(F.lit(seen).alias("h"), ((F.count_if(F.col("h") >= seen) + 1) / (F.count("*") + 1)).alias("p"))


def resample(rows: DataFrame, group: str, value: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """p, low, high for two groups: permutation p-value of the difference of medians and the bootstrap's 2.5 % and 97.5 %
    bounds. All values are read, 8 bytes each, in an order by hash; rounds are spread over tasks by seed."""
    import numpy as np

    spark = rows.sparkSession
    found = rows.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    names = [r.g for r in found.select("g").where("g is not null").distinct().orderBy("g").limit(2).collect()]
    values = lambda name: found.where(F.col("g") == name).orderBy(F.xxhash64("g", "v")).select("v").toArrow().column(0).to_numpy()
    data = spark.sparkContext.broadcast([values(n) for n in names])

    def run(batches):
        import numpy as np
        import pandas as pd

        a, b = data.value
        both = np.concatenate([a, b])
        for pdf in batches:
            out = []
            for i in pdf.id:
                rng = np.random.default_rng(seed + int(i))
                mixed = rng.permutation(both)
                out.append((abs(np.median(mixed[: len(a)]) - np.median(mixed[len(a) :])), np.median(rng.choice(a, len(a))) - np.median(rng.choice(b, len(b)))))
            yield pd.DataFrame(out, columns=["permuted", "boot"])

    draws = spark.range(rounds).mapInPandas(run, "permuted double, boot double")
    seen = float(abs(np.median(data.value[0]) - np.median(data.value[1]))) if len(names) == 2 else 0.0
    return draws.agg(((F.count_if(F.col("permuted") >= seen) + 1) / (F.count("*") + 1)).alias("p"), F.percentile("boot", 0.025).alias("low"), F.percentile("boot", 0.975).alias("high"))
