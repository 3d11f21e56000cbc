"""Action values and choice rules of a bandit, over steps(param, step, action, reward)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RATE, DECAY, FLOOR = 0.1, 0.99, 0.1
#: Numbers of steps that are ranked together.
SPAN = 100_000


def values(steps: DataFrame, rate: float = RATE, span: int = SPAN) -> DataFrame:
    """(param, action, q, n): exponential averages in closed form: the last of n rewards weighs rate, each before it (1 - rate) times less.

    Steps are ranked within spans of numbers, so that a key that holds many rows is sorted in many tasks; the spans of a
    key, a row each, then weigh by the rewards that come after them.
    """
    key, left = ["param", "action"], F.lit(1 - rate)
    part = steps.select(*key, "step", "reward", F.floor(F.col("step") / span).alias("__s"))
    rank = F.row_number().over(Window.partitionBy(*key, "__s").orderBy(F.desc("step"))) - 1
    part = part.withColumn("__k", rank).groupBy(*key, "__s").agg(F.sum(rate * F.pow(left, F.col("__k")) * F.col("reward")).alias("__q"), F.count(F.lit(1)).alias("__n"))
    later = Window.partitionBy(*key).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__after", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    return part.groupBy(*key).agg(F.sum(F.col("__q") * F.pow(left, F.col("__after"))).alias("q"), F.sum("__n").alias("n"))


def epsilon(steps: DataFrame, start: float = 1.0) -> DataFrame:
    return steps.groupBy("param").agg(F.greatest(start * F.pow(F.lit(DECAY), F.count(F.lit(1))), F.lit(FLOOR)).alias("epsilon"))


def greedy(q: DataFrame) -> DataFrame:
    return q.groupBy("param").agg(F.max_by("action", F.struct("q", -F.col("action"))).alias("action"))


def epsilon_greedy(q: DataFrame, eps: DataFrame, seed: int) -> DataFrame:
    """The greedy action, or with probability epsilon a random one; random by a hash of the seed, so reruns agree."""
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / float(1 << 30)
    pick = random_action(q, seed + 1).withColumnRenamed("action", "any")
    out = greedy(q).join(pick, "param").join(eps, "param")
    return out.select("param", F.when(draw(F.col("param")) < F.col("epsilon"), F.col("any")).otherwise(F.col("action")).alias("action"))


def random_action(q: DataFrame, seed: int) -> DataFrame:
    """(param, action): one of the actions, drawn by a hash of the seed."""
    return q.groupBy("param").agg(F.max_by("action", F.xxhash64(F.lit(seed), "param", "action")).alias("action"))


def softmax(q: DataFrame, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy("param")
    top = F.max("q").over(w)
    e = F.exp((F.col("q") - top) / temperature)
    return q.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def upper_bounds(q: DataFrame, c: float = 2.0) -> DataFrame:
    w = Window.partitionBy("param")
    return q.withColumn("ucb", F.col("q") + c * F.sqrt(F.log(F.sum("n").over(w) + 1) / (F.col("n") + 1)))


def converged(q: DataFrame, least: float = 1e-3) -> DataFrame:
    return q.groupBy("param").agg(((F.count(F.lit(1)) >= 2) & (F.var_pop("q") < least)).alias("converged"))


def policy_weights(scores: DataFrame) -> DataFrame:
    """scores(policy, score) as shares; where the sum is zero, of one."""
    total = scores.agg(F.sum("score").alias("__t"))
    return scores.join(F.broadcast(total)).select("policy", (F.col("score") / F.when(F.col("__t") == 0, 1.0).otherwise(F.col("__t"))).alias("weight"))


def thompson(q: DataFrame, seed: int) -> DataFrame:
    """(param, action): the action of the largest draw from Beta(qn + 1, (1 - q)n + 1), seeded by row."""

    @F.pandas_udf("double")
    def draw(param: pd.Series, action: pd.Series, value: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, a, v, k in zip(param, action, value, n):
            rng = np.random.default_rng([seed, int(a) & 0xFFFFFFFF, *str(p).encode()])
            v = min(max(v, 0.0), 1.0)
            out.append(rng.beta(v * k + 1, (1 - v) * k + 1))
        return pd.Series(out)

    drawn = q.withColumn("__x", draw("param", F.col("action").cast("long"), "q", "n"))
    return drawn.groupBy("param").agg(F.max_by("action", F.struct("__x", "action")).alias("action"))


def registry(defaults: DataFrame, settings: DataFrame) -> DataFrame:
    """(param, kind, value): defaults with the settings laid over them, cast to their kind and written back; bad values leave the default."""
    both = defaults.join(settings.select("param", F.col("value").alias("__v")), "param", "left")
    fits = F.when(F.col("kind") == "int", F.expr("try_cast(__v AS int)").cast("string")).when(F.col("kind") == "float", F.expr("try_cast(__v AS double)").cast("string")).otherwise(F.col("__v"))
    return both.select("param", "kind", F.coalesce(fits, "value").alias("value"))
