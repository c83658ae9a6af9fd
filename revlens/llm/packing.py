"""Packing token ids into sequences by multiway differencing.

Every document is cut into whole sequences of ``capacity`` ids and a rest, the rest into
quarters of a sequence and one shorter piece. Rests are dealt into bundles of about ``BUNDLE`` documents, and each
bundle is packed on its own by the differencing method of Karmarkar and Karp: every
piece starts as a partition of its own, and the two partitions with the largest spread
between their windows are merged so that the full windows of one meet the empty ones of
the other, until one is left. If its fullest window exceeds the capacity, the number of
windows rises and the bundle is packed again. Ids travel with their documents, coded as
the vocabulary allows, and lengths and checksums are those of the ids that come out.

Defined results: a null text counts as an empty one and is its end id alone; null
doc_ids are documents like any other; repeated rows are packed each for itself; an
empty table gives no rows; a text of any length is encoded whole by one task and cut
into pieces; ids are whole numbers; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.tables import salted
from revlens.llm.tokens import encoder, numbers

CAPACITY = 1024
PIECE = 256  # a rest is cut into pieces of so many ids and one shorter piece
BUNDLE = 768  # documents whose rests are packed together
TASK_BUNDLES = 8  # bundles that a task packs, on average
END_ID = 0
_LOCAL = 1 << 32  # sequences of a bundle are numbered from bundle x _LOCAL

_CODED = "doc_id long, tie long, salt long, doc_tokens long, ids binary"
_PIECES = "doc_id string, start long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Piece lengths of a document of n ids."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [piece] * (rest // piece) + ([rest % piece] if rest % piece else [])


def differencing(sizes: list[int], windows: int) -> tuple[list[int], list[list[int]]]:
    """Window sums, falling, and the places of the sizes in each window."""
    count = len(sizes)
    # A partition is its non-empty windows: sums (falling) and the node that holds each one's members.
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    tick = count
    while len(heap) > 1:
        (_, _, a, a_node), (_, _, b, b_node) = heapq.heappop(heap), heapq.heappop(heap)
        meet = max(0, len(a) + len(b) - windows)
        sums, nodes = [a[:len(a) - meet], b[:len(b) - meet]], [a_node[:len(a) - meet], b_node[:len(b) - meet]]
        if meet:  # the emptiest windows of one meet the fullest of these of the other
            sums.append(a[-meet:] + b[-meet:][::-1])
            nodes.append(np.arange(meet) + count + len(children))
            children.extend(zip(a_node[-meet:].tolist(), b_node[-meet:][::-1].tolist()))
        both, node = np.concatenate(sums), np.concatenate(nodes)
        order = np.argsort(-both, kind="stable")
        both, node = both[order], node[order]
        spread = int(both[0] - (both[-1] if len(both) == windows else 0))
        heapq.heappush(heap, (-spread, tick, both, node))
        tick += 1
    members = []
    for root in heap[0][3].tolist() if heap else []:
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x < count:
                found.append(x)
            else:
                todo.extend(children[x - count])
        members.append(sorted(found))
    return (heap[0][2].tolist() if heap else []), members


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The places of the sizes in each window; no window exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, members = differencing(sizes, windows)
        if not sums or sums[0] <= capacity:
            return members
        windows += 1


def _coder(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches):
        encode = encoder(path)
        end = end_id.to_bytes(encode.width, "little")
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # a few texts at a time as Python strings
                part = batch.slice(first, 256)
                ids = [encode.ids(text) + end for text in part.column("text").to_pylist()]
                sizes = pa.array([len(x) // encode.width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names[:3]), sizes, pa.array(ids, pa.binary())], names)
    return run


def _packer(capacity: int, piece: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tie", "doc_id"], kind="stable", ignore_index=True)
        cuts = [cut(n, capacity, piece) for n in rows.doc_tokens.tolist()]
        sizes = [s for c in cuts for s in c]
        whole = [i for i, s in enumerate(sizes) if s == capacity]
        rest = [i for i, s in enumerate(sizes) if s < capacity]
        sequences = [[i] for i in whole] + [[rest[i] for i in w] for w in pack([sizes[i] for i in rest], capacity)]
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for number, places in enumerate(sequences):
            at = 0
            for i in places:
                sequence[i], offset[i] = number, at
                at += sizes[i]
        start, ids = [], []
        for coded, n, lengths in zip(rows.ids, rows.doc_tokens.tolist(), cuts):
            own, at = numbers(coded, len(coded) // n).tobytes(), 0
            for length in lengths:
                start.append(at)
                ids.append(own[4 * at:4 * (at + length)])
                at += length
        of = np.repeat(np.arange(len(rows)), [len(c) for c in cuts])
        return pd.DataFrame({"doc_id": rows.doc_id.to_numpy()[of], "start": start,
                             "doc_tokens": rows.doc_tokens.to_numpy()[of],
                             "sequence_id": rows.bundle.iloc[0] * _LOCAL + sequence, "offset": offset, "ids": ids})
    return bundle


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
                   piece: int = PIECE, bundle: int = BUNDLE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    Texts are encoded where they are read, and their ids are shuffled to the bundles.
    ``ids`` has four bytes per id, little-endian; the length and the checksum are taken from it.
    """
    bundles = max(1, -(-docs.count() // bundle))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text", "doc_id").alias("tie"), "text")
    # A null among integers would turn pandas' column into floats; text keeps every id.
    # Rows that repeat more often than a part of a bundle go on to the next bundles.
    coded = (salted(texts, ["doc_id", "tie"], max(1, bundle // 4)).mapInArrow(_coder(tokenizer, end_id), _CODED)
             .withColumn("bundle", F.pmod(F.pmod(F.xxhash64("tie"), F.lit(bundles)) + F.col("salt"), F.lit(bundles)))
             .withColumn("doc_id", F.col("doc_id").cast("string")))
    # Some bundles a task, whatever the table's size; Spark could not split a task of many by itself.
    coded = coded.repartition(max(1, -(-bundles // TASK_BUNDLES)), "bundle")
    packed = coded.groupBy("bundle").applyInPandas(_packer(capacity, piece), _PIECES)
    return packed.select(
        F.col("doc_id").cast("long"), "start", F.shiftright(F.octet_length("ids"), 2).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (padded to the capacity) and n_tokens, from pieces packed with their ids."""
    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = np.frombuffer(b"".join(rows.ids), "<u4").astype(np.int64)
        padded = np.concatenate([ids, np.full(capacity - len(ids), pad_id)])
        return pd.DataFrame({"sequence_id": [rows.sequence_id.iloc[0]], "ids": [padded], "n_tokens": [len(ids)]})
    return packed.groupBy("sequence_id").applyInPandas(
        assemble, "sequence_id long, ids array<long>, n_tokens long")
