"""Mixing sources to target weights: blocks of equal word counts, apportioned by highest quotients, chosen by a seed.

Sources in the order of their names (code points, null last) weigh as ``weights`` says, over and over, and share the words
of all documents. A target stops at ``repeat`` times what its source has; the excess goes to the others by weight until
none is above. A source's documents are dealt into shards of about ``SHARD`` words in an order that hashes of seed, id and
text give, and each shard is cut into blocks of equal length (to a word), at most ``block`` words each.

A source's votes are its target in blocks. Sainte-Laguë gives the blocks of the mix to the sources by the highest
quotients votes / (2k + 1), and then those of a source to its shards in the same way: a whole quota for each shard. A shard
takes all its blocks as often as its quota allows, and the rest of the quota once more, in the order of a seeded hash.

Defined cases: a null text has no words and is dealt with nothing taken; rows equal in id, source and text stand one after
the other, in parts of up to ``TOGETHER`` rows that are dealt apart, and each takes its own share; null ids and a null source are as any
other; a source without words has target 0; a very long text is a shard of its own size; ties of quotients go to the first
source, then the first shard; an empty table gives an empty result; columns other than id, text and source are not looked at.

Everything is built of built-in functions. Only single rows with totals of all sources reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.ordered import div, running, spread_join
from tallyspark.llm.shared import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Words and rows of a shard, about.
SHARD = 1 << 18
#: Equal rows that are dealt as one.
TOGETHER = 64
BLOCK = 64
SEED = 11
#: Seats that compete on either side beyond those that the number of parties explains: halves, roundings and full parties.
_SLACK = 2


def _digits(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def weigh(sources: DataFrame, weights: tuple[int, ...], repeat: int) -> DataFrame:
    """``place``, ``source``, ``source_size``, ``rows`` and ``target`` of every source."""
    placed = running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = placed.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * repeat).alias("most"))
    summed = settled(running(placed, [F.col("most") / F.col("weight"), F.col("place")], {"mosts": F.col("most"), "weights": F.col("weight")}))
    total, heavy = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    whole = lambda c: c.cast("decimal(38,0)")
    # those before it, with less to give for their weight, stop at their most; what is left is shared by it and those after
    left, sharers = F.lit(total) - F.col("mosts") + F.col("most"), F.lit(heavy) - F.col("weights") + F.col("weight")
    stops = whole(F.col("most")) * whole(sharers) < whole(F.col("weight")) * whole(left)
    flagged = summed.withColumn("stops", stops)
    used, over = flagged.agg(
        F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("stops"), F.col("weight"))), F.lit(0))
    ).first()
    shared = F.col("weight").cast("double") * F.lit(float(total - used)) / F.lit(float(max(over, 1)))
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(shared)
    return flagged.select("place", "source", "source_size", "rows", target.alias("target"))


def apportion(parties: DataFrame, group: str, party: str) -> DataFrame:
    """``parties`` with their whole ``seats`` by Sainte-Laguë. Rows need ``votes`` (double), ``most`` (long, seats it can take at
    most) and ``house`` (long, seats of its group, the same in the whole group).

    With s parties, the divisor gives each at least its share less share * s / 2 seats and half a seat, and at most as much
    more. Seats below that are sure; only those in between compete by their quotients, 4 s for all parties together.
    """
    totals = parties.groupBy(group).agg(F.sum("votes").alias("_all"), F.count("*").alias("_parties"))
    known = spread_join(parties, totals, group, F.xxhash64(party))
    share = F.when(F.col("_all") > 0, F.col("votes") / F.col("_all")).otherwise(F.lit(0.0))
    middle, spread = share * F.col("house"), share * F.col("_parties") / 2
    sure = F.least(F.col("most"), F.greatest(F.lit(0), F.floor(middle - spread) - _SLACK)).cast("long")
    last = F.least(F.col("most"), F.ceil(middle + spread) + _SLACK).cast("long")
    known = settled(known.select(*parties.columns, sure.alias("_sure"), last.alias("_last")))
    places = F.explode(F.sequence(F.col("_sure"), F.col("_last") - 1))
    rivals = known.where("_last > _sure").select(group, party, "votes", places.alias("k"))
    rivals = rivals.select(group, party, (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient"))
    ranked = settled(running(rivals, [F.col(group), F.col("quotient").desc(), F.col(party)], {"rank": F.lit(1)}))
    starts = ranked.groupBy(group).agg((F.min("rank") - 1).alias("_start"))
    open_seats = known.groupBy(group).agg((F.max("house") - F.sum("_sure")).alias("_open")).join(starts, group)
    won = spread_join(ranked, open_seats, group, F.xxhash64(party)).where(F.col("rank") - F.col("_start") <= F.col("_open"))
    won = won.groupBy(group, party).agg(F.count("*").alias("_won"))
    seats = (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).alias("seats")
    return known.join(won, [group, party], "left").select(*parties.columns, seats)


def quotas(dealt: DataFrame, block: int) -> DataFrame:
    """``place``, ``shard``, ``words``, ``blocks`` and ``seats`` (blocks to take, repeats counted) of every shard with words."""
    shards = dealt.groupBy("place", "shard").agg(
        F.sum(F.col("size") * F.col("copies")).alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("repeat").alias("repeat")
    )
    shards = settled(shards.where("words > 0").withColumn("blocks", div(F.col("words") + (block - 1), F.lit(block))))
    votes = (F.col("target") / F.col("source_size") * F.col("blocks")).alias("votes")
    most = (F.col("blocks") * F.col("repeat")).alias("most")
    sources = shards.groupBy("place").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "repeat")), F.sum("blocks").alias("blocks"))
    sources = settled(sources.select(F.lit(0).alias("mix"), "place", votes, most))
    house = sources.agg(F.floor(F.sum(F.col("votes").cast("decimal(38,9)")) + F.lit(0.5).cast("decimal(2,1)"))).first()[0] or 0
    given = apportion(sources.withColumn("house", F.lit(int(house)).cast("long")), "mix", "place")
    parties = spread_join(shards, given.select("place", F.col("seats").alias("house")), "place", F.xxhash64("shard"))
    return apportion(parties.select("place", "shard", "words", "blocks", votes, most, "house"), "place", "shard")


def mix(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeat: int = 3, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD
) -> DataFrame:
    """For every document ``doc_id``, ``size`` (its words), ``source_size``, ``target``, ``pieces`` and ``taken``.

    ``pieces`` are the stretches of its words that the mix takes (``begin``, ``end``, counted in words) and how many ``times``;
    ``taken`` counts their words, repeats included.
    """
    text = F.coalesce("text", F.lit(""))
    sized = documents.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("digest"))
    runs = settled(sized.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies")))
    sources = settled(runs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows")))
    targets = settled(weigh(sources, weights, repeat))
    shards = F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("rows")) / shard_words)).alias("shards")
    parts = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("copies") - 1, F.lit(TOGETHER)))).alias("part"))
    parts = parts.withColumn("copies", F.least(F.lit(TOGETHER), F.col("copies") - TOGETHER * F.col("part")))
    key = _digits(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"), F.col("part"))
    placed = spread_join(parts.withColumn("key", key), targets.select("*", shards), "source", F.xxhash64("key"))
    shard = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("shards"))
    dealt = settled(placed.select("place", shard.alias("shard"), "key", "doc_id", "size", "copies", "source_size", "target", F.lit(repeat).alias("repeat")))

    of_block = lambda i: _digits(F.lit(seed), F.col("place"), F.col("shard"), i)
    every, rest = div(F.col("seats"), F.col("blocks")), (F.col("seats") % F.col("blocks")).cast("int")
    in_order = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), of_block))
    chosen = quotas(dealt, block).select("place", "shard", "words", "blocks", every.alias("every"), F.when(rest > 0, F.element_at(in_order, rest)).alias("until"))

    order = Window.partitionBy("place", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    span = F.col("size") * F.col("copies")
    laid = dealt.withColumn("first", F.sum(span).over(order) - span).join(chosen, ["place", "shard"], "left")
    each = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.withColumn("start", F.col("first") + F.col("copy") * F.col("size")).withColumn("stop", F.col("start") + F.col("size"))

    def piece(i: Column) -> Column:
        begin = F.greatest(div(i * F.col("words"), F.col("blocks")), F.col("start")) - F.col("start")
        end = F.least(div((i + 1) * F.col("words"), F.col("blocks")), F.col("stop")) - F.col("start")
        times = F.col("every") + F.coalesce(of_block(i) <= F.col("until"), F.lit(False)).cast("long")
        return F.struct(begin.alias("begin"), end.alias("end"), times.alias("times"))

    holding = lambda position: div((position + 1) * F.col("blocks") - 1, F.col("words"))
    blocks = F.sequence(holding(F.col("start")), holding(F.col("stop") - 1))
    nothing = F.array().cast("array<struct<begin: bigint, end: bigint, times: bigint>>")
    pieces = F.when(F.col("size") > 0, F.filter(F.transform(blocks, piece), lambda p: p["times"] > 0)).otherwise(nothing)
    found = each.select("doc_id", "size", "source_size", "target", pieces.alias("pieces"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda sum_, p: sum_ + (p["end"] - p["begin"]) * p["times"])
    return found.withColumn("taken", taken)
