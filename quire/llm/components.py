"""Connected components of a link table, as DataFrames that never meet in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import materialise

#: A node with more links than this share of all has its links dealt over several tasks.
HOT_SHARE = 1000


def _with_least(links: DataFrame, least: DataFrame, hot: DataFrame) -> DataFrame:
    """links(src, dst) with m = least(src). Hot nodes, at most HOT_SHARE of them by their definition, are salted on both sides."""
    salted = links.join(F.broadcast(hot), "src", "left").withColumn("salt", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("dst"), F.col("k")).cast("int")))
    spread = least.join(F.broadcast(hot), "src", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.coalesce("k", F.lit(1)) - 1).cast("int"))))
    return salted.drop("k").join(spread.drop("k"), ["src", "salt"]).drop("salt")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b): any pairs of long ids. Returns (node, root) for every id in them, root the smallest in its component.

    Alternates large-star and small-star steps until no link changes; each round is written to the shared folder,
    so a lost executor costs one round at most. Self links and repeated links do no harm; null ends are ignored; an
    empty table gives an empty one. Of equal smallest ids there is one by their kind, so there are no ties.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = materialise(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "nodes")
    stars = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(stars)
    for _ in range(rounds):
        if not now[0]:
            break
        # Large star: every neighbour above a node goes to the least of the node and its neighbours.
        both = stars.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(stars.select("v", "u"))
        seen = both.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = _hot(seen, now[0])
        large = _with_least(both.where("dst > src"), seen.select("src", F.least("src", "m").alias("m")), hot)
        stars = materialise(large.select(F.col("dst").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # Small star: a node and its neighbours below go to the least of those.
        seen = stars.groupBy(F.col("u").alias("src")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(stars.select(F.col("u").alias("src"), F.col("v").alias("dst")), seen.select("src", "m"), _hot(seen, now[0]))
        stars = materialise(small.where("dst <> m").select(F.col("dst").alias("u"), F.col("m").alias("v")).union(seen.select(F.col("src").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        was, now = now, state(stars)
        if was == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(stars, nodes.node == stars.u, "left").select("node", F.coalesce("v", "node").alias("root"))


def _hot(seen: DataFrame, links: int) -> DataFrame:
    """Nodes with over 1/HOT_SHARE of the links (2,000 at least) and over how many tasks to deal them."""
    most = max(2000, 2 * links // HOT_SHARE)
    return seen.where(F.col("n") > most).select("src", F.least(F.ceil(F.col("n") / most), F.lit(2 * HOT_SHARE)).cast("int").alias("k"))
