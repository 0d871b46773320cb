"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def ends(to: DataFrame) -> DataFrame:
    """(v, p) with each p replaced by where the way from v ends; p is at most v and has a row of its own."""
    while True:
        # only what moves can lead on: a star has no such way
        on = to.where("v != p").select(F.col("v").alias("p"), F.col("p").alias("q"))
        if to.join(on, "p", "left_semi").isEmpty():
            return to
        to = written(to.join(on, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "cc-jump")


def components(links: DataFrame) -> DataFrame:
    """(v, component) of every vertex of ``links`` (a, b: long); component is its smallest vertex.

    In each round a vertex points to its smallest neighbour (or to itself), these ways are followed to
    their ends by doubling, and the links move along.  An end that nobody came to has a smaller neighbour in
    the next round, so two rounds at least halve the linked vertices: rounds grow with the logarithm of the
    vertices, and doublings with that of the longest way.
    The tables of a round are written to the shared folder; nothing but emptiness is asked by the driver."""
    edges = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    of = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "cc-move")
        to = ends(to)
        if of is None:
            of = to.select("v", F.col("p").alias("component"))
        else:
            moved = of.join(to.select(F.col("v").alias("component"), "p"), "component", "left")
            of = moved.select("v", F.coalesce("p", "component").alias("component"))
        of = written(of, "cc-of")
        a, b = to.select(F.col("v").alias("a"), F.col("p").alias("pa")), to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        next_ = edges.join(a, "a").join(b, "b").where("pa != pb")
        edges = written(next_.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-links")
    return of if of is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
