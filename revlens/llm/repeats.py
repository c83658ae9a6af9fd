"""Removal of long byte strings that occur more than once, by sorting suffixes.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts anywhere else,
in the same text or another; strings are judged on the input. Matches never cross texts.

*Anchors.* Of the grams of ``GRAM`` bytes that a string of ``LENGTH`` bytes holds, the one
with the least hash (the first, among equals) is the string's anchor. That depends on
the string alone, so equal strings have equal anchors at the same place in them, and
only strings whose anchor occurs again need a closer look. An anchor owns a run of
starts; the bytes from the first owned start to the end of the last string are its context.

*Suffixes.* Equal contexts are counted first, so copies, however many, become one row; a
context counted twice is repeated as a whole. Where an anchor has several contexts, the
suffixes at the owned starts are sorted, anchor by anchor, by deep-shallow sorting, and
suffixes that agree in ``LENGTH`` bytes are neighbours. An anchor with more than
``CONTEXTS`` different contexts is not sorted in one place: its strings are counted by
128-bit checksum instead, with map-side partial counts.

Defined results: a null text counts as an empty one; texts below ``LENGTH`` bytes lose
nothing; repeated rows are texts that repeat each other, and a null doc_id is like any
other; ids are whole numbers; a long text is one row and is held whole by a task, with some
tens of bytes for each of its bytes; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import text_arrays as T
from revlens.llm.suffix_sort import repeated
from revlens.llm.tables import stored

LENGTH = 200  # a multiple of eight
GRAM = 50
CONTEXTS = 32_768  # different contexts of one anchor that are sorted together, 350 bytes each at most
SORTED_BYTES = 1 << 20  # contexts sorted by one call, but for an anchor with more

_U = np.uint64


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: block-wise running minima from both sides."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH,
            gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first owned start, last owned start, place, hash) per anchor; places count from the text's start."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    prefix = T.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    key = T.span_hash(prefix, at, at + gram)
    low = _U((1 << int(len(key)).bit_length()) - 1)
    best = (_least((key & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    runs = np.maximum(sizes - length + 1, 0)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + offsets[:-1][doc]
    place = best[start]
    first = np.ones(len(start), bool)
    first[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(start)) - 1
    doc, base = doc[first], offsets[:-1][doc[first]]
    return doc, start[first] - base, start[last] - base, place[first] - base, key[place[first]]


_ANCHORS = "doc_id long, tie long, first long, left int, owned int, gram long"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = batch.column("doc_id"), batch.column("tie")
        for a, _, data, offsets in T.chunks(batch.column("text")):
            doc, first, last, place, key = anchors(data, offsets)
            rows = pa.array(doc + a)
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), ties.take(rows), pa.array(first), pa.array((place - first).astype(np.int32)),
                 pa.array((last - first + 1).astype(np.int32)), pa.array(key.view(np.int64))],
                ["doc_id", "tie", "first", "left", "owned", "gram"])


_CONTEXTS = "doc_id long, tie long, first long, gram long, left int, print binary, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per repeated anchor its context and a 128-bit checksum of all that tells contexts apart."""
    names = [c.split()[0] for c in _CONTEXTS.split(", ")]
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            found = part.column("found")
            fields = dict(zip(("first", "left", "owned", "gram"), found.flatten().flatten()))
            row = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy())
            first, end = fields["first"].to_numpy(), fields["first"].to_numpy() + fields["owned"].to_numpy() - 1 + LENGTH
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            own = [texts[r][x:y] for r, x, y in zip(row.tolist(), first.tolist(), end.tolist())]
            marks = [hashlib.blake2b(b"%d/%d/" % (g, n) + c, digest_size=16).digest()
                     for g, n, c in zip(fields["gram"].to_pylist(), fields["left"].to_pylist(), own)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), part.column("tie").take(pa.array(row)), fields["first"],
                 fields["gram"], fields["left"], pa.array(marks, pa.binary()), pa.array(own, pa.binary())], names)


_RUNS = "print binary, runs array<struct<a:int,b:int>>"
_RUNS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram; per context the runs of owned starts whose strings occur in another context."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        grams, lefts, prints, contexts = zip(*rows)
        sizes = np.array([len(c) for c in contexts])
        base, owned = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
        own = np.repeat(np.arange(len(rows)), owned)
        start = np.arange(len(own)) - np.repeat(np.cumsum(owned) - owned, owned)
        # Equal strings have their anchor at the same place, so gram and place are a first bucket.
        group = np.unique(np.array(grams), return_inverse=True)[1]
        bucket = group[own] * (LENGTH + 1) + (np.array(lefts)[own] - start + GRAM)
        flags = repeated(np.frombuffer(b"".join(contexts), np.uint8), base[own] + start, bucket, LENGTH)
        ends = np.cumsum(owned)
        runs = [_runs(flags[e - n:e]) for e, n in zip(ends, owned)]
        keep = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays([pa.array([prints[i] for i in keep], pa.binary()),
                                           pa.array([runs[i] for i in keep], _RUNS_ARROW)], ["print", "runs"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "left", "print", "context"))):
            if size >= SORTED_BYTES and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield solve(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a context, as a checksum; for anchors with very many contexts."""
    for batch in batches:
        for gram, left, mark, own in zip(*(batch.column(c).to_pylist() for c in ("gram", "left", "print", "context"))):
            n = len(own) - LENGTH + 1
            strings = [hashlib.blake2b(b"%d/%d/" % (gram, left - i) + own[i:i + LENGTH], digest_size=16).digest()
                       for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array([mark] * n, pa.binary()),
                                              pa.array(range(n), pa.int32())], ["string", "print", "at"])


_CUTS = "doc_id long, tie long, spans array<struct<a:long,b:long>>, n_removed long, kept binary"


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tie", "spans", "n_removed", "kept"]
    for batch in batches:
        for x in range(0, batch.num_rows, 256):
            part = batch.slice(x, 256)
            found = part.column("found")
            start, end = (c.to_numpy() for c in found.flatten().flatten())
            sizes = found.value_lengths().to_numpy()
            # All spans in order; a span that begins behind all earlier ends of its text opens a new one.
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((start, row))
            start, end = start[order], end[order]
            shift = row * (int(end.max(initial=0)) + 1)
            reach = np.maximum.accumulate(end + shift) - shift
            first = np.flatnonzero(_openings(row, start, reach))
            a, b, row = start[first], reach[np.append(first[1:], len(start)) - 1], row[first]
            spans = np.searchsorted(row, np.arange(len(sizes) + 1))
            kept = []
            for i, text in enumerate(part.column("text").to_pylist()):
                text, own = (text or "").encode(), range(spans[i], spans[i + 1])
                kept.append(b"".join(text[p:q] for p, q in zip([0, *(b[k] for k in own)], [*(a[k] for k in own), len(text)])))
            removed = np.bincount(row, weights=b - a, minlength=len(sizes)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)),
                                             pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), lists, pa.array(removed),
                                              pa.array(kept, pa.binary())], names)


def _openings(row: np.ndarray, start: np.ndarray, reach: np.ndarray) -> np.ndarray:
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    return new


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on document: equal doc_id, null included, and equal text."""
    right = right.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    on = left["doc_id"].eqNullSafe(right["_id"]) & (left["tie"] == right["_tie"])
    return left.join(right, on, how).drop("_id", "_tie")


def tied(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """doc_id, tie and more columns: doc_id and tie stand for a document, up to repeated rows."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), *columns)


def repeats(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """One row per document (doc_id, tie) that loses something: spans [a, b), n_removed, kept (the remaining bytes)."""
    rows = tied(docs, "text").where(F.octet_length("text") >= LENGTH)
    found = rows.mapInArrow(_anchored, _ANCHORS)
    # Stored, so that joins with a very common gram have plain shuffles on both sides and can be split.
    again = stored(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    lists = (found.join(again, "gram").groupBy("doc_id", "tie")
             .agg(F.collect_set(F.struct("first", "left", "owned", "gram")).alias("found")))  # bounded by the text
    touched = stored(_same(rows, lists))

    members = touched.mapInArrow(_contexts, _CONTEXTS)
    different = stored(members.groupBy("gram", "left", "print", "context").agg(F.count("*").alias("n")))
    sizes = stored(different.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"))
    several = different.join(sizes, "gram").select("gram", "left", "print", "context", "k")
    runs = (several.where(F.col("k") <= contexts).drop("k").repartition("gram").sortWithinPartitions("gram")
            .mapInArrow(_sorted_runs, _RUNS))
    strings = stored(several.where(F.col("k") > contexts).mapInArrow(_strings, "string binary, print binary, at int"))
    common = stored(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string"))
    by_string = (strings.join(common, "string").groupBy("print")
                 .agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("runs")))
    whole = different.where("n > 1").select("print", F.array(F.struct(
        F.lit(0).alias("a"), (F.octet_length("context") - LENGTH).alias("b"))).alias("runs"))
    marked = stored(runs.unionByName(by_string).unionByName(whole).groupBy("print")
                    .agg(F.flatten(F.collect_list("runs")).alias("runs")))  # bounded by the context's starts
    hits = (members.select("doc_id", "tie", "first", "print").join(marked, "print")
            .select("doc_id", "tie", "first", F.explode("runs").alias("run"))
            .groupBy("doc_id", "tie").agg(F.collect_set(F.struct(
                (F.col("first") + F.col("run.a")).alias("a"), (F.col("first") + F.col("run.b") + LENGTH).alias("b"))
            ).alias("found")))
    texts = touched.select("doc_id", "tie", "text").dropDuplicates(["doc_id", "tie"])
    return stored(_same(texts, hits).mapInArrow(_cutter, _CUTS))


def cut_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = tied(docs, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cuts = repeats(docs).select("doc_id", "tie", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                F.sha2("kept", 256).alias("kept_sha"))
    zero = F.lit(0).cast("long")
    return _same(every, cuts, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept bytes as text, without the bytes of broken characters."""
    for batch in batches:
        for x in range(0, batch.num_rows, 256):
            part = batch.slice(x, 256)
            text = [kept.decode(errors="ignore") for kept in part.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(text, pa.string())],
                                             ["doc_id", "tie", "own"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the kept text; bytes of characters that were cut in two are dropped."""
    names = docs.columns
    cuts = repeats(docs).select("doc_id", "tie", "kept").mapInArrow(_decoder, "doc_id long, tie long, own string")
    # The row travels as one column, so that its names meet none of these.
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.struct("*").alias("doc"))
    text = F.when(F.col("own").isNull(), F.col("doc.text")).otherwise(F.col("own"))
    joined = _same(rows, cuts, "left").select("doc", text.alias("text"))
    return joined.select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in names))
