"""Connected components of a table of links, by alternating large-star and small-star steps.

Joins are merge joins by hint, so that no table of vertices, however small its file, goes whole through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.runtime import stored


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one pass over the edges."""
    turned = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.inline(turned))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its larger neighbours to the smallest vertex among its neighbours and itself."""
    both = both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its smaller neighbours and itself to the smallest of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pointed = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
    return edges.join(least.hint("merge"), "a").select(F.inline(pointed)).filter("a <> b").distinct()


def reached(links: DataFrame, rounds: int) -> DataFrame:
    """(vertex, root): the smallest vertex within `rounds` links (a, b) of each. Vertices of one root are connected."""
    # every vertex is its own neighbour too, so a round is one join and one aggregate
    loops = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])
    both = stored(links.select(F.inline(loops)).distinct(), "neighbours")
    roots = stored(both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root")), "roots")
    for _ in range(rounds - 1):
        near = both.join(roots.hint("merge"), F.col("b") == F.col("vertex")).groupBy("a").agg(F.min("root").alias("root"))
        roots = stored(near.withColumnRenamed("a", "vertex"), "roots")
    return roots


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root) of every vertex with a link, root being the smallest vertex of its component.

    A hub's many links are joined with one row, a join that Spark's adaptive execution splits. The number of rounds is
    logarithmic; each round's edges are written to the shared folder. Null ends are ignored.
    """
    one = F.greatest(F.col(a).cast("long"), F.col(b).cast("long")).alias("a")
    two = F.least(F.col(a).cast("long"), F.col(b).cast("long")).alias("b")
    edges = stored(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(one, two).filter("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(stored(_large_star(edges), "edges")), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("vertex"), "root").distinct())
