"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.storage import Scratch

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _step(edges: DataFrame, large: bool, write: Scratch) -> DataFrame:
    """Links every larger (or smaller) neighbour of a node to the smallest one around it."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "component-minimum")
    pairs = both.join(low, "a")
    if large:
        out = pairs.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("a != m").select("a", F.col("m").alias("b")))
    return write(out.where("a != b").distinct(), "component-edges")


def components(edges: DataFrame, write: Scratch | None = None) -> DataFrame:
    """``edges`` has columns a and b. Returns node and root, the smallest node of its component, for nodes other than roots."""
    write = write or Scratch(edges.sparkSession)
    now = write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = _step(_step(now, True, write), False, write)
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
