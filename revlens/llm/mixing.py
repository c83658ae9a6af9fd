"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should appear target / source size times. The whole part
of that is certain; the fraction is rounded pairwise. Two open documents trade words:
one gains what the other loses until one of them is certain to be in or out, the
direction drawn so that neither probability changes on average. The sum of
probability x size stays what it was, so a source misses its target by less than one
document. Blocks of a source are rounded side by side; each hands at most one open
document to the next level of a tree of blocks, until one per source is left to a coin.
In the first level, where a source's fractions are equal, a document's partner is the
pool of all smaller documents of its block, which leaves a small one open.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating. They share
all words by weight; a target stops at 3 times its source's size and the excess is
shared again by weight.

Defined results: null and empty texts have size 0 and cost nothing, each gets its
expected copies by a coin of its own; a source without words has target 0; repeated
rows are separate documents; equal sizes are ordered by a hash of the row; a text of any
length counts by its number of words; an empty table gives no rows; columns other than
doc_id, text and source are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.tables import WORD, numbered, salted, stored

MOST = 3.0  # a target is at most so many times its source's size
WEIGHTS = 3
BLOCK = 4096  # documents rounded by one call; residuals per node of the tree
MANY = 1024  # repeated rows that one task may number
SEED = 20
EVEN = 1e-9  # a probability this near to 0 or 1 is certain


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, most: float = MOST, weights: int = WEIGHTS) -> DataFrame:
    """source, number, documents, source_size, target for rows of (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    sources = stored(numbered(sources, [F.col("source").isNull(), F.col("source")])
                     .withColumnRenamed("row", "number").withColumn("weight", F.col("number") % weights + 1))
    # Water level: capped sources give their cap, the others level x weight. Every round caps
    # at least one more source, and the sums are all that the driver sees.
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.col("weight") * level
        n, given, open_weight, total = sources.agg(
            F.sum(full.cast("long")), F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        if n is None or n == capped or not open_weight:
            break
        capped, level = n, (total - given) / open_weight
    return sources.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * F.lit(level)))


def _round_block(p: list[float], size: list[int], draw: Iterator[float]) -> tuple[list[float], int]:
    """Probabilities made 0 or 1, but for one at most; its place, or -1."""
    held = -1
    for i, own in enumerate(p):
        if size[i] == 0:
            p[i] = 1.0 if next(draw) < own else 0.0
            continue
        if own <= EVEN or own >= 1 - EVEN:
            p[i] = float(round(own))
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min((1 - p[held]) * a, own * b), min(p[held] * a, (1 - own) * b)
        moved = up if next(draw) * (up + down) < down else -down
        p[held], p[i] = p[held] + moved / a, own - moved / b
        open_ = [k for k in (held, i) if EVEN < p[k] < 1 - EVEN]
        for k in (held, i):
            if k not in open_:
                p[k] = float(round(p[k]))
        held = open_[0] if open_ else -1
    return p, held


def _round_pool(p: list[float], size: list[int], draw: Iterator[float]) -> tuple[list[float], int]:
    """As ``_round_block`` for equal probabilities and falling sizes.

    Each document trades with the pool of all smaller ones, whose common probability
    moves. So large documents are settled first and the one left open is small.
    """
    rest, own = sum(size), p[0] if p else 0.0
    for i, a in enumerate(size):
        if a == 0:
            p[i] = 1.0 if next(draw) < p[i] else 0.0
            continue
        rest -= a
        if own <= EVEN or own >= 1 - EVEN:
            p[i] = float(round(own))
            continue
        if rest == 0:
            p[i] = own
            settled = [1.0 if next(draw) < x else 0.0 for x in p[i + 1:]]
            return p[:i + 1] + settled, i
        up, down = min((1 - own) * a, own * rest), min(own * a, (1 - own) * rest)
        moved = up if next(draw) * (up + down) < down else -down
        p[i], own = own + moved / a, own - moved / rest
        if EVEN < p[i] < 1 - EVEN:  # it weighs more than the whole pool, which is settled now
            p[i + 1:] = [float(round(own)) if x else (1.0 if next(draw) < q else 0.0)
                         for x, q in zip(size[i + 1:], p[i + 1:])]
            return p, i
        p[i] = float(round(p[i]))
    return p, -1


def _rounder(seed: int, first: bool, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "doc_id"], ascending=False, kind="stable", ignore_index=True)
        key = f"{seed}/{rows.number.iloc[0]}/{rows.block.iloc[0]}"
        rng = np.random.default_rng(zlib.crc32(key.encode()))
        draw = iter(rng.random(2 * len(rows) + 2).tolist())
        p, held = (_round_pool if first else _round_block)(rows.p.tolist(), rows["size"].tolist(), draw)
        if held >= 0 and last:
            p[held] = 1.0 if next(draw) < p[held] else 0.0
            held = -1
        rows["p"] = p
        rows["open"] = np.arange(len(rows)) == held
        return rows
    return block


def mix(rows: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The same rows with ``copies`` for rows of (doc_id, tie, size, number, documents, x = expected copies).

    ``tie`` is a hash of the row that orders and deals it, so that reruns agree.
    """
    blocks = F.ceil(F.col("documents") / block)
    # Rows that repeat more often than a part of a block go on to the next blocks.
    rows = salted(rows, ["number", "doc_id", "tie"], max(1, block // 4))
    kind = dict(rows.dtypes)["doc_id"]
    # A null among integers would turn pandas' column into floats; text keeps every id.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    open_ = (rows.withColumn("whole", F.floor("x").cast("long")).withColumn("p", F.col("x") - F.floor("x"))
             .withColumn("block", F.pmod(F.pmod(F.xxhash64(F.lit(seed), "tie", "doc_id"), blocks) + F.col("salt"), blocks))
             .drop("salt"))
    most = rows.agg(F.max("documents")).first()[0] or 0
    left, level, done = -(-most // block), 0, None
    while True:
        last = left <= 1
        schema = open_.withColumn("open", F.lit(True)).schema
        rounded = stored(open_.groupBy("number", "block").applyInPandas(_rounder(seed + 1000 * level, level == 0, last), schema))
        settled = rounded.where(~F.col("open"))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        open_ = rounded.where("open").drop("open").withColumn("block", F.floor(F.col("block") / block))
        left, level = -(-left // block), level + 1
    copies = F.col("whole") + F.round("p").cast("long")
    return (done.withColumn("copies", copies).withColumn("doc_id", F.col("doc_id").cast(kind))
            .drop("whole", "p", "block", "open"))


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted), copies, source, tie."""
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                               F.xxhash64("text").alias("tie")))
    targets = source_targets(sized).withColumnRenamed("source", "_source")
    x = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "tie", "number", "documents", "source_size", "target", x.alias("x"))
    mixed = mix(rows, block, seed)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies", "source", "tie")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it."""
    def row_key(doc_id: Column, source: Column, tie: Column) -> Column:
        # JSON keeps nulls and separators within ids and sources apart.
        parts = [doc_id.cast("string").alias("a"), source.alias("b"), tie.cast("string").alias("c")]
        return F.md5(F.to_json(F.struct(*parts)).cast("binary")).alias("key")

    taken = (mix_documents(docs, block, seed).groupBy(row_key(F.col("doc_id"), F.col("source"), F.col("tie")))
             .agg(F.sum("copies").alias("taken"), F.count("*").alias("rows")))
    # The row travels as one column, so that its names meet none of these.
    rows = docs.select(F.struct("*").alias("doc"),
                       row_key(docs["doc_id"], docs["source"], F.xxhash64(docs["text"])))
    # Repeated rows share what they got together.
    taken = stored(taken.where("taken > 0"))
    often = taken.where(F.col("rows") > MANY)
    lined = rows.join(taken.where(F.col("rows") <= MANY), "key").withColumn(
        "nth", F.row_number().over(Window.partitionBy("key").orderBy("doc")).cast("long"))
    if not often.isEmpty():  # numbered without one task for all rows of a key
        many = numbered(rows.join(often, "key").withColumn("any", F.rand(0)), [F.col("key"), F.col("doc"), F.col("any")])
        first = stored(many.groupBy("key").agg(F.min("row").alias("first")))
        lined = lined.unionByName(many.join(first, "key").withColumn("nth", F.col("row") - F.col("first") + 1)
                                  .select(*lined.columns))
    own = F.floor(F.col("taken") / F.col("rows")) + (F.col("nth") <= F.col("taken") % F.col("rows")).cast("long")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))
    return lined.select("doc", own.alias("own")).where("own > 0").select("doc", copy).select("doc.*")
