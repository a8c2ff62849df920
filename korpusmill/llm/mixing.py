"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Sources get targets by weight, capped at a number of repeats of what they have. The words to take are cut into equal
blocks, which go to the sources by the highest quotients target / (2 k + 1); a source's blocks go on to its shards in the same way.
In a shard the documents lie end to end in a seeded order; every block is taken quota div blocks times, and quota mod blocks of them,
chosen by a seeded permutation, once more. Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.llm.ranks import numbered
from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: A prime above any number of blocks of a shard, so that multiplying by it permutes them.
STRIDE = 2147483629
HEX_DIGITS = 15


def word_count(text: Column) -> Column:
    """Runs of characters that are no ASCII white space; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _number(text: Column) -> Column:
    """A seeded whole number below 2^60, by md5."""
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


def apportion(rows: DataFrame, by: str, key: str, scratch: Scratch) -> DataFrame:
    """``rows`` (by, key, target, most, seats) with ``quota``: of each group's ``seats`` those of the highest quotients target / (2 k + 1), ties to the smaller key, at most ``most`` a row.

    Any divisor gives a row its rounded share, so a group's seats for a divisor are off by half its rows at most. What a row gets for
    the divisor of seats - rows / 2 is sure; only quotients between that and seats + rows / 2, a few times the
    group's rows in all, are enumerated and ranked. Groups of any size are ranked by many tasks.
    """
    rows, n = scratch.save(rows, "claims"), F.count(F.lit(1))
    group = scratch.save(rows.groupBy(by).agg(F.sum("target").alias("_all"), n.alias("_n"), n.alias("_rows")), "groups")
    rows = join_unique(rows, group, [by], "_rows", row_bytes=40)
    share = F.when(F.col("_all") > 0, F.col("target") / F.col("_all")).otherwise(0.0)
    low = F.greatest(F.lit(0), F.least("most", F.floor(share * (F.col("seats") - F.col("_n") / 2)) - 1))
    high = F.greatest(F.lit(0), F.least("most", F.ceil(share * (F.col("seats") + F.col("_n") / 2)) + 2))
    rows = scratch.save(rows.withColumns({"_low": low, "_high": high}), "bounds")
    open_ = rows.where("_high > _low AND target > 0").select(by, key, "target", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    quotient = F.col("target") / (2 * F.col("_k") + 1)
    ranked = numbered(open_.select(by, key, quotient.alias("_q")), [F.col("_q").desc(), F.col(key)], scratch, (by,), "_place")
    left = scratch.save(rows.groupBy(by).agg((F.max("seats") - F.sum("_low")).alias("_left"), n.alias("_rows")), "left")
    more = join_unique(ranked, left, [by], "_rows", row_bytes=30).where("_place <= _left").groupBy(by, key).agg(n.alias("_more"))
    return rows.join(more, [by, key], "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_all", "_n", "_low", "_high", "_more")


def targets(sources: DataFrame, percent: float, repeats: int) -> DataFrame:
    """``sources`` (weight, have) with ``target``: least(repeats * have, weight * level), the level being such that targets sum to the percentage of all that there is.

    What capped sources leave is shared again by weight until no further one is above its cap: an aggregate over the sources a round.
    """
    cap = F.col("have") * repeats
    words, weights = sources.agg(F.coalesce(F.sum("have"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total, level, capped = words * percent / 100, words * percent / 100 / max(weights, 1), -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, taken, rest = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == capped or not rest:
            return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))
        capped, level = n, (total - taken) / rest


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), percent: float = 100,
    repeats: int = 3, block_words: int = 16, shard_words: int = 1 << 14, seed: int = 2024,
) -> DataFrame:
    """(id, source, size, source_size, target, taken): of every row its words, its source's words and target, and the words that the mix takes of it.

    Sources in code point order, null last, have the ``weights`` in turn. Shards hold about ``shard_words`` words by a hash of id and text, so a source of
    any size is laid out by many tasks. A source's words taken differ from its target by about a block, and by less than ``repeats``
    blocks for every shard, whose last block has from half to one and a half times the words of the others; no row gives more than ``repeats`` times its size. All choices depend on rows and
    seed alone, so reruns agree. Null and empty texts have size 0 and give nothing; rows that are the same in id and text share a place in the order,
    and which of them comes first changes nothing but which equal row gives which words; null ids count as one id of their own; an empty table gives an empty
    result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        _number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)).alias("h"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"),
    )
    own = scratch.save(own, "sizes")
    sources = own.groupBy("key", "source").agg(F.sum("size").alias("have"), F.count(F.lit(1)).alias("rows"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], scratch, name="nth")
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int"))
    sources = scratch.save(targets(scratch.save(sources.withColumn("weight", weight), "sources"), percent, repeats), "targets")

    shards = F.greatest(F.lit(1), F.ceil(F.col("have") / shard_words))
    tagged = join_unique(own.where("size > 0"), sources.select("key", "nth", shards.alias("shards"), "rows"), ["key"], "rows", row_bytes=60)
    tagged = scratch.save(tagged.select("id", "size", "h", "key", "nth", F.pmod("h", "shards").alias("shard")), "tagged")
    parts = tagged.groupBy("nth", "shard").agg(F.sum("size").alias("words"))
    parts = scratch.save(parts.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long")), "shards")

    seats = int((sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] + 0.5) // block_words)
    most = parts.groupBy("nth").agg(F.sum(F.col("blocks") * repeats).alias("most"))
    per_source = apportion(sources.join(most, "nth").select(F.lit(0).alias("all"), "nth", "target", "most", F.lit(seats).cast("long").alias("seats")), "all", "nth", scratch)
    per_shard = parts.join(per_source.select("nth", F.col("quota").alias("seats")), "nth")
    per_shard = apportion(per_shard.select("nth", "shard", F.col("words").cast("double").alias("target"), (F.col("blocks") * repeats).alias("most"), "seats", "blocks"), "nth", "shard", scratch)
    start = F.pmod(_number(F.concat_ws(":", F.lit(seed), F.col("nth"), F.col("shard"))), "blocks")
    per_shard = per_shard.select("nth", "shard", "blocks", start.alias("start"), F.floor(F.col("quota") / F.col("blocks")).alias("times"), F.pmod("quota", "blocks").alias("more"))

    end = F.sum("size").over(Window.partitionBy("nth", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    laid = tagged.withColumn("hi", end).withColumn("lo", F.col("hi") - F.col("size")).join(per_shard, ["nth", "shard"])
    block = lambda word: F.least(F.floor(word / block_words), F.col("blocks") - 1)
    inside = lambda k: F.when(k + 1 < F.col("blocks"), F.least(F.col("hi"), (k + 1) * block_words)).otherwise(F.col("hi")) - F.greatest(F.col("lo"), k * block_words)
    again = lambda k: F.pmod(k * STRIDE + F.col("start"), "blocks") < F.col("more")
    extra = F.aggregate(F.sequence(block(F.col("lo")), block(F.col("hi") - 1)), F.lit(0).cast("long"), lambda s, k: s + F.when(again(k), inside(k)).otherwise(0))
    taken = F.col("size") * F.col("times") + F.when(F.col("more") > 0, extra).otherwise(0)
    rows = laid.select("id", "size", "key", taken.alias("taken")).unionByName(own.where("size = 0").select("id", "size", "key", F.lit(0).cast("long").alias("taken")))
    out = join_unique(rows, sources.select("key", "source", F.col("have").alias("source_size"), "target", "rows"), ["key"], "rows", row_bytes=80)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")
