"""Near duplicates by BagMinHash signatures, banding and exact verification.

A text is the multiset of its shingles of five words. Two texts are linked if their
multisets overlap by 0.8 or more (weighted Jaccard: sum of least counts by sum of
greatest counts); classes are the connected components of the links.

*Signature.* A shingle's weight axis, discretised to whole counts, is cut into the
intervals [0,1), [1,2), [2,4), [4,8) ... and each carries a Poisson process of marked
points whose rate is its length. A shingle of count w owns the points below w: those of
all intervals that end there, and of the interval that holds w the points whose place on
the axis lies below w. Each point falls into one of ``SLOTS`` slots, and a slot keeps the
earliest point. Two texts agree in a slot with a probability equal to their weighted
Jaccard. Points are drawn in order of time only until no later one can win.

*Bands.* Texts that agree in all ``ROWS`` slots of one of ``BANDS`` bands share a bucket.
At similarity 0.8 a pair misses all of them with probability 5e-6.

*Links.* Pairs are never all formed. Every bucket has a hub, in the first round the member that
shares most buckets with others (the middle of a group of copies), in the second one drawn
by hash. In each round a node is compared with at most ``HUBS`` hubs of its buckets, so the
pairs of a round grow with the nodes and no faster; only buckets that still hold
several components go on. A group of copies, however large, is settled so by a few
comparisons per member. What still holds several components is worked off in blocks:
whoever does not belong to a bucket's largest component is compared with all members of
the other components, so no candidate pair that could join two components is left out. A
pair is dropped by its signatures if they agree in less than ``LEAST`` of the slots (4.5
standard deviations below 0.8), and else verified on the whole texts, once, in the block
of the first bucket it shares. A block verifies the most alike pairs first, skips those
that earlier ones have joined, and gives out links alone, less than it has members: pairs
are never rows. Its work, not its rows, is quadratic for texts alike but not linked.

Defined results: equal texts, empty ones included, are one class whatever they hold; a
text of one to four words has these words as its only shingle; a text without words has
no links; a null text is alone; class_id is the class's smallest doc_id that is not null;
repeated rows get the same class, and of them the least row stays; ties between hubs go to
the smaller node; a long text is signed whole by one task, with some tens of bytes for
each of its bytes, and a block holds the shingles of about twice ``BLOCK`` texts at most; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import text_arrays as T
from revlens.llm.components import components
from revlens.llm.tables import stored

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 40
SLOTS = 480  # the first ROWS x BANDS make the bands, all together the estimate
LEAST = SIMILARITY - 4.5 * float(np.sqrt(SIMILARITY * (1 - SIMILARITY) / SLOTS))
BLOCK = 512  # members of a bucket compared at once
HUB_ROUNDS = 2
HUBS = 4  # hubs that a node is compared with in a round

_U = np.uint64
_PLACES = 64  # a band's number modulo this is its place among the BANDS
_STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), by text and shingle, for a chunk of texts."""
    start, end, doc = T.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = T.span_hash(T.prefix_hash(data), start, end)
    sizes = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]
    at = np.flatnonzero(place <= np.maximum(sizes[doc] - WORDS, 0))
    key, many = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(WORDS):
        inside = place[at] + j < sizes[doc[at]]
        key += np.where(inside, h[np.minimum(at + j, len(h) - 1)] * _U(_STEPS[j]), _U(0))
        many += inside.astype(np.uint64)
    key, doc = T.mixed(key ^ many), doc[at]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(first)
    return doc[first], key[first], np.diff(np.append(first, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """texts x SLOTS marks of the earliest points; rows of texts without shingles are 0."""
    best = np.full(texts * SLOTS, np.inf)
    mark = np.zeros(texts * SLOTS, np.uint64)
    # Interval 0 is [0, 1), interval j > 0 is [2^(j-1), 2^j).
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    own = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    doc, limit = doc[own], count[own]
    seed = T.mixed(key[own] ^ T.mixed(level.astype(np.uint64) + _U(0x2545F491)))
    rate = SLOTS * length.astype(float)
    mass = np.maximum(np.bincount(doc, weights=np.minimum(length, limit - low), minlength=texts), 1)
    step = np.maximum(1, np.ceil(SLOTS * (np.log(SLOTS) + 3) / mass)).astype(np.int64)
    time, drawn = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    alive = np.arange(len(doc))
    while len(alive):
        n = step[doc[alive]]
        first = np.cumsum(n) - n
        node = np.repeat(alive, n)
        number = (drawn[node] + np.arange(len(node)) - np.repeat(first, n)).astype(np.uint64)
        bits = T.mixed(seed[node] + number * _U(_STEPS[0]))
        uniform = ((bits >> _U(11)).astype(float) + 0.5) * 2.0 ** -53
        run = np.cumsum(-np.log(uniform) / rate[node])
        ahead = np.where(first > 0, run[first - 1], 0.0)
        at = run - np.repeat(ahead, n) + time[node]
        more = T.mixed(bits ^ _U(_STEPS[1]))
        slot = doc[node] * SLOTS + (((more >> _U(32)) * _U(SLOTS)) >> _U(32)).astype(np.int64)
        place = low[node] + ((((more & _U(0xFFFFFFFF)) * length[node].astype(np.uint64)) >> _U(32)).astype(np.int64))
        ok = np.flatnonzero((place < limit[node]) & (at < best[slot]))
        slot, at, bits = slot[ok], at[ok], bits[ok]
        np.minimum.at(best, slot, at)
        won = at == best[slot]
        mark[slot[won]] = bits[won]
        time[alive], drawn[alive] = time[alive] + run[first + n - 1] - ahead, drawn[alive] + n
        latest = best.reshape(texts, SLOTS).max(1)
        alive = alive[time[alive] < latest[doc[alive]]]
    return mark.reshape(texts, SLOTS)


_SIGNED = "key binary, marks binary, bands array<long>"


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in T.chunks(batch.column("text")):
            doc, key, count = shingles(data, offsets)
            marks = signatures(doc, key, count, end - first) & _U(0xFFFF)
            has = np.zeros(end - first, bool)
            has[doc] = True
            band = np.arange(BANDS, dtype=np.uint64)[None, :] * _U(_STEPS[2])
            for row in range(ROWS):
                band = T.mixed(band ^ marks[:, row * BANDS:(row + 1) * BANDS])
            band = (band - band % _U(_PLACES) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)[has]
            lists = pa.ListArray.from_arrays(np.arange(0, band.size + 1, BANDS, dtype=np.int32), pa.array(band.ravel()))
            short = [m.tobytes() for m in marks[has].astype("<u2")]
            keys = batch.column("key").slice(first, end - first).filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([keys, pa.array(short, pa.binary()), lists], ["key", "marks", "bands"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in enough slots."""
    for batch in batches:
        for first in range(0, batch.num_rows, 2048):
            part = batch.slice(first, 2048)
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("m", "n"))
            ok = pa.array((a == b).mean(1) >= LEAST)
            yield pa.RecordBatch.from_arrays([part.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (shingles, counts), shingles rising and distinct."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return both / total if total else 0.0


def _bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles, counts) of each text."""
    out = []
    for first, end, data, offsets in T.chunks(column):
        doc, key, count = shingles(data, offsets)
        at = np.searchsorted(doc, np.arange(end - first + 1))
        out += [(key[x:y], count[x:y]) for x, y in zip(at[:-1], at[1:])]
    return out


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            # Sums of whole counts, so the comparison with the threshold is exact up to one rounding.
            ok = pa.array([similarity(x, y) >= SIMILARITY
                           for x, y in zip(_bags(part.column("t")), _bags(part.column("u")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by (band, h, o) in batches that end where a block ends, and the blocks' borders in them."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        block = rows[["band", "h", "o"]].to_numpy()
        borders = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(1)))
        held = rows.iloc[borders[-1]:].reset_index(drop=True)  # the last block may go on
        if len(borders) > 1:
            yield rows.iloc[:borders[-1]], borders
    if held is not None:
        yield held, np.array([0, len(held)])


def _candidates(rows: pd.DataFrame, borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block the places (i, j) of candidate pairs of different components, the most alike first.

    A pair belongs to the first bucket it shares, and one of two minor members to the smaller one's block.
    """
    band, node, label, asks, minor = (rows[c].to_numpy() for c in ("band", "node", "label", "asks", "minor"))
    marks = np.frombuffer(b"".join(rows.marks), "<u2").reshape(-1, SLOTS)
    for x, y in zip(borders[:-1], borders[1:]):
        left, right = x + np.flatnonzero(asks[x:y]), x + np.flatnonzero(~asks[x:y])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in left:
            j = right[(label[right] != label[i]) & (~minor[right] | (node[right] > node[i]))]
            same = marks[j] == marks[i]
            alike = same.mean(1)
            ok = np.flatnonzero(alike >= LEAST)
            shared = same[ok, :ROWS * BANDS].reshape(-1, ROWS, BANDS).all(1)
            ok = ok[shared.argmax(1) == band[x] % _PLACES]
            found.append((np.full(len(ok), i), j[ok], alike[ok]))
        i, j, alike = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(-alike, kind="stable")
        yield i[order], j[order]


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of blocks that have a candidate pair there."""
    for rows, borders in _whole_blocks(batches):
        places = [np.concatenate(pair) for pair in _candidates(rows, borders)]
        yield rows.iloc[np.unique(np.concatenate(places))].drop(columns="marks")


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between a block's components, verified on the texts: as many as join what they join, and no more."""
    for rows, borders in _whole_blocks(batches):
        node, label, links = rows.node.to_numpy(), rows.label.to_numpy(), []
        for x, y, (left, right) in zip(borders[:-1], borders[1:], _candidates(rows, borders)):
            bag, root = _bags(pa.array(rows.text.iloc[x:y], pa.large_string())), {}

            def top(of: int) -> int:
                while (up := root.get(of, of)) != of:
                    root[of] = of = root.get(up, up)
                return of

            for i, j in zip(left.tolist(), right.tolist()):
                a, b = top(int(label[i])), top(int(label[j]))
                if a != b and similarity(bag[i - x], bag[j - x]) >= SIMILARITY:
                    root[a] = b
                    links.append((node[i], node[j]))
        yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _alike_pairs(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    return stored(pairs.join(marks.toDF("a", "m"), "a").join(marks.toDF("b", "n"), "b")
                  .mapInArrow(_alike, "a long, b long"), records=2048)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with texts that overlap enough."""
    return stored(pairs.join(texts.toDF("a", "t"), "a").join(texts.toDF("b", "u"), "b")
                  .mapInArrow(_verifier, "a long, b long"), records=512)


def _mixed(members: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(members with their labels, buckets that hold several labels with sizes and largest label)."""
    own = F.col("node").alias("label")
    labelled = (members.withColumn("label", own) if labels is None else
                members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    labelled = labelled.select("band", "node", "degree", "label")
    sizes = labelled.groupBy("band", "label").agg(F.count("*").alias("k"))
    mixed = (sizes.groupBy("band").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n"),
                                       F.count("*").alias("labels"))
             .where("labels > 1").select("band", F.col("top.label").alias("major"), "n",
                                         (F.col("n") - F.col("top.k")).alias("minors")))
    return labelled, stored(mixed)


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): one node per different text with words (key, node), and the verified links (a, b)."""
    rows = docs.where("text is not null").select(text_key(F.col("text")).alias("key"), "text")
    signed = rows.mapInArrow(_signer, _SIGNED).groupBy("key").agg(F.first("marks").alias("marks"),
                                                                  F.first("bands").alias("bands"))
    nodes = stored(signed.withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", F.explode("bands").alias("band"))
    # Stored, so that joins with a very common band have plain shuffles on both sides and can be split.
    buckets = stored(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(members.join(buckets, "band"))
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = stored(members.join(degrees, "node").select("band", "node", "degree"))
    marks = nodes.join(degrees, "node", "left_semi").select("node", "marks")
    marks = stored(marks)
    keys = nodes.select("key", "node").join(degrees, "node", "left_semi")
    texts = stored(rows.join(keys, "key").dropDuplicates(["node"]).select("node", "text"))

    edges = labels = tried = None
    for turn in range(HUB_ROUNDS):
        labelled, mixed = _mixed(members, labels)
        rank = (-F.col("degree")) if turn == 0 else F.xxhash64("node", "band", F.lit(turn))
        hubs = stored(labelled.join(mixed.select("band"), "band").groupBy("band")
                      .agg(F.min(F.struct(rank.alias("rank"), "node", "label")).alias("hub")))
        met = labelled.join(hubs, "band").where(F.col("label") != F.col("hub.label")).select(
            "node", F.col("hub.rank").alias("rank"), F.least("node", "hub.node").alias("a"),
            F.greatest("node", "hub.node").alias("b"))
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        # A node meets the first few of its buckets' hubs, so a round's pairs grow with the nodes and no faster.
        first = Window.partitionBy("node").orderBy("rank", "a", "b")
        met = met.groupBy("node", "a", "b").agg(F.min("rank").alias("rank")).withColumn("nth", F.row_number().over(first))
        pairs = stored(met.where(F.col("nth") <= HUBS).select("a", "b").distinct())
        tried = pairs if tried is None else stored(tried.union(pairs))
        found = _verified(_alike_pairs(pairs, marks), texts)
        edges = found if edges is None else edges.union(found)
        labels = components(edges)

    def dealt(side: DataFrame, own: str, others: str, n_own: str, n_others: str, asks: bool) -> DataFrame:
        return side.select(
            "band", F.pmod(F.xxhash64("node"), F.col(n_own)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_others) - 1)).alias(others),
            F.lit(asks).alias("asks"), (F.col("label") != F.col("major")).alias("minor"), "node", "label")

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition("band", "h", "o").sortWithinPartitions("band", "h", "o")

    # Buckets that hold several components still. Which members have candidates there is seen from the
    # signatures; only those travel with their texts, and only links leave a block.
    labelled, mixed = _mixed(members, labels)
    open_ = stored(labelled.join(mixed, "band").withColumns({
        "hs": F.ceil(F.col("minors") / BLOCK), "os": F.ceil(F.col("n") / BLOCK)}))
    blocks = (dealt(open_.where("label <> major"), "h", "o", "hs", "os", True)
              .unionByName(dealt(open_, "o", "h", "os", "hs", False)))
    asked = stored(in_blocks(blocks.join(marks, "node")).mapInPandas(_asked, blocks.schema))
    found = in_blocks(asked.join(marks, "node").join(texts, "node")).mapInPandas(_linked, "a long, b long")
    edges = edges.union(stored(found, records=BLOCK))
    return nodes.select("key", "node"), edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id and first (the row that stands for its class) per document."""
    nodes, edges = links(docs)
    labels = components(edges)
    classes = nodes.join(labels, "node").select("key", F.col("label").alias("class"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    texts = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    # The class of a text: its component, or the text itself.
    group = F.coalesce(F.col("class").cast("string").cast("binary"), "key")
    texts = texts.join(classes, "key", "left").withColumn("group", group)
    least = texts.groupBy("group").agg(F.min("least").alias("class_id"),
                                       F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("top"))
    texts = texts.join(least, "group").select("key", "class_id", F.col("top.key").alias("top_key"))
    out = rows.join(texts, "key", "left")
    first = F.col("key").isNull() | ((F.col("key") == F.col("top_key")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    return out.select("doc_id", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
                      .alias("class_id"), first.alias("first"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; of repeated rows (equal id and text) one stays."""
    def row_key(doc_id: Column, key: Column) -> Column:
        return F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")),
                                 F.coalesce(F.hex(key), F.lit("-"))).cast("binary")).alias("key")

    first = near_duplicates(docs).where("first").select(row_key(F.col("doc_id"), F.col("key"))).distinct()
    # The row travels as one column, so that its names meet none of these.
    rows = docs.select(F.struct("*").alias("doc"), row_key(docs["doc_id"], text_key(docs["text"])))
    once = F.row_number().over(Window.partitionBy("key").orderBy("doc"))
    return rows.join(first, "key", "left_semi").withColumn("nth", once).where("nth = 1").select("doc.*")
