"""Transitive closures of edge tables in few written rounds.

All pairs: a few single steps first, as shallow graphs end there, then doubling. Of pairs at a distance below d and those at exactly d, the
latter joined with both give all below 2 d, each shortest path split at its one middle, so rounds go with the logarithm of the depth and pairs
on a path are derived once. From a constant end: single steps, of what is reached alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import appended, written

#: Single steps before the doubling; a power of two.
STEPS = 4


class Closure:
    """Over edges s, o and the columns of extra, on which both edges of a step agree; edges without an end take no part.

    rounds: how many times what is known has grown.
    """

    def __init__(self, edges: DataFrame, extra: list[str] | None = None):
        self.extra, self.rounds = extra or [], 0
        self.by = ["s", "o", *self.extra]
        self.edges = written(edges.select(*self.by).dropna(subset=["s", "o"]).distinct())

    def onward(self, front: DataFrame, step: DataFrame) -> DataFrame:
        self.rounds += 1
        return front.withColumnRenamed("o", "m").join(step.withColumnRenamed("s", "m"), ["m", *self.extra]).select(*self.by)

    def new(self, made: DataFrame, known: list[DataFrame]) -> DataFrame:
        return written(made.distinct().join(appended(known), self.by, "left_anti"))

    def pairs(self) -> DataFrame:
        """All pairs with one step or more between them."""
        known, front = [self.edges], self.edges
        for _ in range(STEPS - 1):
            front = self.new(self.onward(front, self.edges), known)
            if front.isEmpty():
                return appended(known)
            known.append(front)
        nearer = known[:-1]
        while True:
            # front: at exactly the distance that is above all of nearer.
            farther = self.new(self.onward(front, appended(nearer)), known)
            self.rounds -= 1  # of two joins that make one round
            nearer = [*known, farther]
            front = self.new(self.onward(front, front), nearer)
            if front.isEmpty():
                return appended(nearer)
            known = [*nearer, front]

    def onward_from(self, start: str) -> DataFrame:
        """The pairs that begin at a node."""
        front = written(self.edges.where(F.col("s") == start))
        known = [front]
        while not front.isEmpty():
            front = self.new(self.onward(front, self.edges), known)
            known.append(front)
        return appended(known)
