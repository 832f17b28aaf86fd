"""Bringing the members of large lists and groups together in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.shared import settled

#: Members of each large key that meet all blocks of the first pass.
ANCHORS = 4
#: Rows of the second pass up to which they may be broadcast; a row has a few numbers, so this is about 20 MB.
FEW_ROWS = 200_000


def in_blocks(members: DataFrame, key: str, block: int) -> DataFrame:
    """Deal the members of each key into pairs of blocks (``i``, ``j``), so that any two members meet in some pair. Keys of
    up to ``block`` members have the one pair (0, 0). ``home`` marks one of the meetings of each block, the one where
    its members are to be compared among themselves; members of different blocks meet once."""
    sizes = members.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > 1)
    count = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(key)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 2, F.lit(0))))
    dealt = members.join(sizes.select(key, count.alias("blocks")), key).withColumn("own", own)
    # k counts the other blocks; with one or two blocks there is one meeting
    met = dealt.select("*", other.alias("k")).withColumn("k", F.col("k") + (F.col("k") >= F.col("own")).cast("int"))
    low, high = F.least("own", "k"), F.greatest("own", "k")
    alone = F.col("blocks") == 1
    return met.select(
        *members.columns, F.when(alone, F.lit(0)).otherwise(low).alias("i"), F.when(alone, F.lit(0)).otherwise(high).alias("j"),
        "own", (F.col("k") == F.when(F.col("own") == 0, F.lit(1)).otherwise(F.lit(0))).alias("home"),
    )


def _once(members: DataFrame, key: str, block: int) -> DataFrame:
    """``key``, ``node``, ``blocks`` and one block of each member; a few anchors of each key with several blocks are in
    all of them."""
    slot = F.pmod(F.col("node"), F.lit(ANCHORS))
    firsts = [F.min(F.when(slot == s, F.col("node"))).alias(f"anchor{s}") for s in range(ANCHORS)]
    sizes = members.groupBy(key).agg(F.count("*").alias("size"), *firsts).where(F.col("size") > 1)
    sizes = sizes.select(key, F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.array(*[f"anchor{s}" for s in range(ANCHORS)]).alias("anchors"))
    own = F.pmod(F.xxhash64("node", F.lit(key)), F.col("blocks")).cast("int")
    anchor = F.coalesce(F.array_contains("anchors", F.col("node")), F.lit(False))
    places = F.when(anchor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return members.join(sizes, key).select(key, "node", "blocks", F.explode(places).alias("i"))


def _apart(members: DataFrame, known: DataFrame, key: str, block: int) -> DataFrame:
    """Deal members of the same key into pairs of blocks so that any two of different components meet. The members of
    the component with most members of a key meet the others of that key, not each other."""
    placed = members.join(known, "node", "left").select(key, "node", F.coalesce("component", "node").alias("component"))
    per = placed.groupBy(key, "component").agg(F.count("*").alias("n"))
    split = (
        per.groupBy(key).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("total"))
        .where(F.col("most") < F.col("total"))
        .select(
            key, "main", F.ceil(F.col("most") / block).cast("int").alias("mains"),
            F.ceil((F.col("total") - F.col("most")) / block).cast("int").alias("others"),
        )
    )
    first = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("node", F.lit(key)), F.when(first, F.col("mains")).otherwise(F.col("others"))).cast("int")
    met = F.sequence(F.lit(0), F.col("others") + F.when(first, F.lit(0)).otherwise(F.col("mains")) - 1)
    dealt = placed.join(split, key).select(key, "node", "others", first.alias("first"), own.alias("own"), F.explode(met).alias("k"))
    low = F.when(F.col("first"), F.col("k")).otherwise(F.least("own", "k"))
    high = F.when(F.col("first"), F.col("others") + F.col("own")).otherwise(F.greatest("own", "k"))
    return dealt.select(key, "node", low.alias("i"), high.alias("j"))


def connect(members: DataFrame, key: str, block: int, compare: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``node`` and ``component`` of all nodes that links between members of the same key connect.

    ``compare`` takes ``key``, ``node``, ``i`` and ``j``, and whether these rows were counted to be few enough for a
    broadcast, and returns links (``a``, ``b``) that connect what the links
    among the rows of each (``key``, ``i``, ``j``) connect. Every member first meets one block and a few anchors, which is linear
    in the members and mostly joins a large group of copies; then only members of the same key that are not yet connected
    meet. No link between two components stays unseen: two members of a key that never met are connected already.
    """
    once = _once(members, key, block)
    found = components(compare(once.select(key, "node", "i", F.col("i").alias("j")), False))
    large = settled(once.where("blocks > 1").select(key, "node").distinct())
    apart = settled(_apart(large, found, key, block))
    rows = apart.count()
    if not rows:
        return found
    rest = compare(apart, rows <= FEW_ROWS)
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest))
