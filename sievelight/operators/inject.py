"""Poisoned twins: an attack text put into a host text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.schema import draw

MARK = "\x01"
POSITIONS = ["start", "middle", "end"]


def insert(context: Column, attack: Column, position: Column, key: Column) -> Column:
    """``attack`` before, after or inside ``context``: inside, after a sentence end chosen by the key; at the end if there is none."""
    parts = F.split(F.regexp_replace(context, r"([.!?])(\s)", f"$1{MARK}$2"), MARK)

    def joined(p: Column) -> Column:
        ends = F.size(p) - 1
        cut = F.when(ends == 0, F.size(p)).otherwise(F.pmod(key, ends) + 1).cast("int")
        return F.concat_ws("\n", F.array_join(F.slice(p, F.lit(1), cut), ""), attack, F.array_join(F.slice(p, cut + 1, F.size(p) - cut), ""))

    middle = F.transform(F.array(parts), joined)[0]  # the parts are bound, so made once a text
    return F.when(position == "start", F.concat_ws("\n", attack, context)).when(position == "end", F.concat_ws("\n", context, attack)).otherwise(middle)


def twins(hosts: DataFrame, attacks: DataFrame, seed: str = "42") -> DataFrame:
    """One poisoned twin per host (id long, text): attack by ``id mod n``, position by ``id mod 3``.

    The attack list is a configuration table; its number of rows is counted and must stay small for the broadcast.
    """
    n = attacks.count()
    if n > 10_000:
        raise ValueError(f"{n} attacks: join them by key instead")
    joined = hosts.withColumn("k", F.pmod("id", F.lit(n))).join(F.broadcast(attacks), "k")
    position = F.element_at(F.array(*map(F.lit, POSITIONS)), (F.pmod(F.col("id"), F.lit(3)) + 1).cast("int"))
    return joined.withColumn("position", position).withColumn("text", insert(F.col("text"), F.col("attack"), F.col("position"), draw(F.lit(seed), F.col("id").cast("string"))))


def templates(openers: DataFrame, bodies: DataFrame, closers: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` distinct texts from opener + body + closer (an empty closer adds nothing), drawn by hash order."""
    every = openers.crossJoin(bodies).crossJoin(closers)  # three short configuration lists
    text = F.concat_ws(" ", "opener", "body", F.when(F.col("closer") != "", F.col("closer")))
    return every.select(text.alias("text")).distinct().orderBy(F.md5(F.concat(F.lit(seed), F.col("text"))), "text").limit(n)
