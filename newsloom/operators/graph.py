"""Triple patterns, paths, closures and set-valued entities over edges(subject, predicate, object)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.shared import cut, release


@dataclass(frozen=True)
class Step:
    """One edge of a predicate, from subject to object."""

    predicate: str

    def follow(self, at: DataFrame, edges: DataFrame) -> DataFrame:
        some = edges.where(F.col("predicate") == self.predicate).select(F.col("subject").alias("node"), F.col("object").alias("to"))
        return at.join(some, "node").select("start", F.col("to").alias("node")).where("node is not null").distinct()


@dataclass(frozen=True)
class Back:
    """One edge of a predicate, from object to subject."""

    predicate: str

    def follow(self, at: DataFrame, edges: DataFrame) -> DataFrame:
        turned = edges.select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"))
        return Step(self.predicate).follow(at, turned)


@dataclass(frozen=True)
class Seq:
    first: object
    then: object

    def follow(self, at: DataFrame, edges: DataFrame) -> DataFrame:
        return self.then.follow(self.first.follow(at, edges), edges)


@dataclass(frozen=True)
class Alt:
    one: object
    other: object

    def follow(self, at: DataFrame, edges: DataFrame) -> DataFrame:
        return self.one.follow(at, edges).unionByName(self.other.follow(at, edges)).distinct()


@dataclass(frozen=True)
class Star:
    """No, one or many times. A round follows what the round before found first, and only that; each is written to the shared folder."""

    inner: object

    def follow(self, at: DataFrame, edges: DataFrame) -> DataFrame:
        known = new = cut(at.distinct())
        while not new.isEmpty():
            found = self.inner.follow(new, edges)
            new = cut(found.join(known, ["start", "node"], "left_anti"))
            before, known = known, cut(known.unionByName(new))
            release(before)
        return known


def reach(starts: DataFrame, edges: DataFrame, path) -> DataFrame:
    """(start, node): where a path leads from each of starts(node). Only what can be reached from there is ever held, not all pairs."""
    at = starts.where("node is not null").select(F.col("node").alias("start"), "node").distinct()
    return path.follow(at, edges.select("subject", "predicate", "object"))


def closure(edges: DataFrame, predicate: str) -> DataFrame:
    """(subject, object): the reflexive, transitive closure of a predicate.

    Rounds join the pairs that the last round found first with all known pairs, so paths double in length and a
    path of n steps takes log n rounds; pairs known already are left out, so cycles end it. Each round is
    written to the shared folder.
    """
    step = cut(edges.where(F.col("predicate") == predicate).select("subject", "object").distinct())
    ends = step.select("subject").union(step.select("object")).distinct()
    known = ends.select("subject", F.col("subject").alias("object"))
    new = cut(step.where("subject <> object"))
    while not new.isEmpty():
        before, last = known, new
        known = cut(known.unionByName(new))
        release(before)
        far = known.where("subject <> object").toDF("object", "end")
        found = new.join(far, "object").select("subject", F.col("end").alias("object")).distinct()
        new = cut(found.join(known, ["subject", "object"], "left_anti"))
        release(last)
    return known


def optional(entities: DataFrame, facts: DataFrame, attributes: list[str]) -> DataFrame:
    """Entities with a sorted, comma-joined set for each attribute of facts(entity, attr, value); missing ones are null."""
    sets = facts.groupBy("entity").pivot("attr", attributes).agg(F.array_join(F.sort_array(F.collect_set("value")), ","))
    return entities.join(sets, "entity", "left").select("entity", *[F.nullif(F.col(a), F.lit("")).alias(a) for a in attributes])


def last_writer(*branches: DataFrame, key: str = "website", without: str | None = None) -> DataFrame:
    """Union of branches; of equal keys that of the last branch stays; keys that contain `without` are left out."""
    out = None
    for k, b in enumerate(branches):
        b = b.withColumn("__order", F.lit(k))
        out = b if out is None else out.unionByName(b)
    if without is not None:
        out = out.where(~F.contains(F.col(key), F.lit(without)))
    rest = [c for c in out.columns if c not in (key, "__order")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__order", *rest)).alias("r")).select(key, "r.*")
