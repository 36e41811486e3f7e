"""One score from objective, facts and tool, learned from a log of choices.

A legal pair of request and tool is described by crosses: the tool alone, with the
objective's kind, with that and the number of facts, with each fact, and with whether its
prerequisites are met; each is hashed to one of `buckets` weights. Logistic
regression fits the weights by Newton steps. Pairs that have the same crosses are one row
with how often they came and were chosen, so the log is read once; a step is one partial
aggregate over these rows, of at most buckets^2 / 2 sums, and only those reach the driver,
where a system of `buckets` equations is solved. A ridge makes the optimum unique, so
weights do not depend on how rows are split, but for the rounding of sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.steps import written

BUCKETS, RIDGE = 256, 1.0


def crosses(objective: Column, facts: Column, tool: Column, ready: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a pair's crosses, sorted, repeats kept. A null objective is one of its own, null facts are none, a null `ready` is false."""
    facts = F.coalesce(facts, F.array().cast("array<string>"))
    kind, ready = F.coalesce(objective.cast("string"), F.lit("none")), F.coalesce(ready, F.lit(False)).cast("string")
    cross = lambda what, *parts: F.concat_ws("|", F.lit(what), *parts)
    one = F.array(cross("tool", tool), cross("kind", kind, tool), cross("known", kind, F.size(facts).cast("string"), tool), cross("ready", ready, tool))
    names = F.concat(one, F.transform(facts, lambda f: cross("fact", f, tool)))
    # from MD5, which SQL engines share
    return F.array_sort(F.transform(names, lambda s: (F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")))


def logit(x: Column, weights: np.ndarray) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(x, F.lit(0.0), lambda a, i: a + F.get(w, i))


def score_joint(found: DataFrame, weights: np.ndarray, crossed: Column) -> DataFrame:
    """found with score: the chance that the tool is chosen, to six places."""
    return found.withColumn("score", F.round(1 / (1 + F.exp(-logit(crossed, weights))), scoring.PLACES))


def _sums(counted: DataFrame, weights: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and second derivatives of the penalised likelihood."""
    d = len(weights)
    z = counted.withColumn("z", logit(F.col("x"), weights)).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    entry = lambda i, j, v: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("double").alias("v"))
    spread, miss = F.col("n") * F.col("p") * (1 - F.col("p")), F.col("n") * F.col("p") - F.col("chosen")
    # log(1 + e^z), where e^z may be too large
    loss = F.col("n") * (F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))) - F.col("chosen") * F.col("z")
    second = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b >= a), lambda b: entry(a, b, spread))))
    all_ = F.concat(F.array(entry(F.lit(-1), F.lit(-1), loss)), F.transform("x", lambda a: entry(a, F.lit(-1), miss)), second)
    sums = z.select(F.explode(all_).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v")).collect()
    total, slope, curve = 0.0, ridge * weights, ridge * np.eye(d)
    for i, j, v in sums:
        if i < 0:
            total = v
        elif j < 0:
            slope[i] += v
        else:
            curve[i, j] += v
            if i != j:
                curve[j, i] += v
    return total + ridge / 2 * float(weights @ weights), slope, curve


def fit(pairs: DataFrame, buckets: int = BUCKETS, ridge: float = RIDGE, steps: int = 25, tolerance: float = 1e-9) -> np.ndarray:
    """Weights for pairs (x: crosses, chosen: boolean; a null is not chosen). All are 0 for an empty table."""
    chosen = F.coalesce(F.col("chosen"), F.lit(False)).cast("long")
    counted = written(pairs.where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"), F.sum(chosen).alias("chosen")), "learn-counted")
    weights = np.zeros(buckets)
    loss, slope, curve = _sums(counted, weights, ridge)
    for _ in range(steps):
        move = np.linalg.solve(curve, slope)
        if np.abs(move).max() <= tolerance:
            break
        while True:
            new_loss, new_slope, new_curve = _sums(counted, weights - move, ridge)
            if new_loss <= loss + 1e-9 * abs(loss) or np.abs(move).max() <= tolerance:
                break
            move = move / 2
        weights, loss, slope, curve = weights - move, new_loss, new_slope, new_curve
    return weights
