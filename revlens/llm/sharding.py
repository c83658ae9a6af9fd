"""Shards of near-equal bytes: the minimax partition of an ordered list of groups.

Documents with equal texts form one group that no cut divides. Groups stand in the
order of their text's SHA-256. The smallest capacity with which a greedy pass needs
no more than the given number of shards is found by binary search, and the list is
cut where that greedy pass cuts it.

Only DataFrame functions touch documents. The greedy pass asks one question per
shard, "the last group end within this many bytes", for many capacities at once.

Defined results: a null text counts as an empty one and joins its group; repeated
rows get slots of their own, in an order that is drawn; a null doc_id is a document like
any other; a text of any length counts by its size and hash alone and is not shuffled;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.tables import numbered, stored

SHARDS = 16
PROBES = 32  # capacities tried by one distributed greedy pass
LOCAL_ENDS = 500_000  # group ends (8 bytes each) that the driver may hold for the last steps


def _furthest(ends: DataFrame, starts: list[int], capacity: list[int]) -> list[int]:
    """For every start the last group end within its capacity; the start itself if there is none."""
    limits = [s + c for s, c in zip(starts, capacity)]
    found = (ends.where((F.col("end") > min(starts)) & (F.col("end") <= max(limits)))
             .agg(*(F.max(F.when(F.col("end") <= x, F.col("end"))).alias(f"x{i}") for i, x in enumerate(limits)))
             .first())
    return [s if x is None else max(s, x) for s, x in zip(starts, found)]


def _greedy(step, capacity: list[int], total: int, shards: int) -> list[list[int]]:
    """The cuts of a greedy pass for every capacity."""
    cuts = [[0] for _ in capacity]
    for _ in range(shards):
        if all(c[-1] >= total for c in cuts):
            break
        for c, x in zip(cuts, step([c[-1] for c in cuts], capacity)):
            c.append(x)
    return [c + [c[-1]] * (shards + 1 - len(c)) for c in cuts]


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int = SHARDS,
                 local_ends: int = LOCAL_ENDS) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the cuts, 0 and ``total`` included.

    ``ends``: a column ``end`` with each group's end in the running sum. A cut never
    moves back as the capacity grows, so all open cuts lie between those of the best
    failing and the best feasible capacity. Those ends come to the driver once they
    are few; until then the interval is narrowed by distributed passes.
    """
    def distributed(starts, capacity):
        return _furthest(ends, starts, capacity)

    base = max(largest, -(-total // shards))
    low, high = base, -(-total // shards) + largest  # a greedy shard short of the second one exceeds the mean
    cuts_low, cuts_high = _greedy(distributed, [low, high], total, shards)
    if cuts_low[-1] >= total:
        return low, cuts_low
    while high - low > 1:
        windows = [F.col("end").between(a, b) for a, b in zip(cuts_low[1:], cuts_high[1:])]
        between = windows[0]
        for w in windows[1:]:
            between = between | w
        if ends.where(between).count() <= local_ends:
            held = sorted(r.end for r in ends.where(between).collect())

            def local(starts, capacity):
                return [held[max(0, bisect.bisect_right(held, s + c) - 1)] for s, c in zip(starts, capacity)]

            while high - low > 1:
                middle = (low + high) // 2
                cuts = _greedy(local, [middle], total, shards)[0]
                if cuts[-1] >= total:
                    high, cuts_high = middle, cuts
                else:
                    low = middle
            break
        step = max(1, (high - low) // (PROBES + 1))
        probes = list(range(low + step, high, step))[:PROBES]
        for capacity, cuts in zip(probes, _greedy(distributed, probes, total, shards)):
            if cuts[-1] >= total:
                high, cuts_high = capacity, cuts
                break
            low, cuts_low = capacity, cuts
    return high, cuts_high


def shard_documents(docs: DataFrame, shards: int = SHARDS, local_ends: int = LOCAL_ENDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text + 1), text_crc32, shard, slot (gapless in the shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"),
                       F.rand(0).alias("any"))  # lets rows equal in id and text spread over tasks
    lined = stored(numbered(rows, [F.col("group"), F.col("doc_id"), F.col("any")], "size"))
    groups = lined.groupBy("group").agg(F.max("end").alias("end"), F.sum("size").alias("size"))
    groups = stored(groups.select("end", "size").repartitionByRange("end").sortWithinPartitions("end"))
    total, largest = groups.agg(F.max("end"), F.max("size")).first()
    cuts = [0] * (shards + 1) if total is None else minimax_cuts(groups, total, largest, shards, local_ends)[1]
    inner = cuts[1:shards]
    firsts = lined.agg(*(F.sum((F.col("end") <= c).cast("long")).alias(f"x{i}") for i, c in enumerate(inner))).first()
    start = F.col("end") - F.col("size")
    shard, first = F.lit(0), F.lit(0).cast("long")
    for c, n in zip(inner, firsts or []):
        shard = shard + (start >= c).cast("int")
        first = F.when(start >= c, F.lit(n or 0).cast("long")).otherwise(first)
    return lined.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row") - first).alias("slot"))
