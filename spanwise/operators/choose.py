"""Choices without conflicts, in rounds of local best ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .checkpoints import Rounds


def independent(proposals: DataFrame, ident: str, members: str, order: list[Column | str]) -> DataFrame:
    """The proposals that taking them in order gives, where each takes its members and none may take one twice.

    Each round takes every proposal that comes first at all of its members; those that want a
    member of it go.  What is left goes on, so the number of rounds follows the longest chain
    of conflicts in order and not the number of proposals.  Proposals have distinct idents and
    at least one member.
    """
    rounds = Rounds(proposals.sparkSession)
    proposals = rounds.keep(proposals, "proposals")  # what makes them runs once
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.col(ident).alias("_ident")).alias("_rank")
    open_ = proposals.select(F.col(ident).alias("_id"), F.array_distinct(members).alias("_members"), rank)
    taken = None
    while True:
        wants = open_.select("_id", "_rank", F.explode("_members").alias("_member"))
        first = wants.groupBy("_member").agg(F.min("_rank").alias("_first"))
        # of those that want a member only its first can have won
        met = wants.join(first, "_member").groupBy("_id").agg(F.min((F.col("_rank") == F.col("_first")).cast("int")).alias("_wins"), F.collect_set("_first._ident").alias("_rivals"))
        met = rounds.keep(met, "met")
        wins = met.filter("_wins = 1").select("_id")
        taken = wins if taken is None else taken.unionByName(wins)
        gone = met.select("_id", F.explode("_rivals").alias("_rival")).join(wins.withColumnRenamed("_id", "_rival"), "_rival", "left_semi").select("_id").distinct()
        open_ = rounds.keep(open_.join(gone, "_id", "left_anti"), "open")
        if open_.isEmpty():
            return proposals.join(taken, proposals[ident] == taken["_id"], "left_semi")
