"""URL filter: a few written rules, and for all other URLs a logistic regression.

A rule names a host and the start of a path; it fits that host and all its subdomains,
and the longest rule that fits decides. URLs without a rule are judged by logistic
regression on hashed n-grams of the characters of host and path, trained from a small
table of labelled URLs.

The labelled table of the registered query holds URLs of the pages that rules decide:
at most ``SAMPLE`` distinct ones, those with the smallest hash. The bound is the only
limit; every URL is judged.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by the model; repeated rows get the same verdict; without labelled
URLs of both kinds the model says the kind that there is, else allow; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import text_arrays as T

# The rules of the contract, as (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SAMPLE = 4_000  # labelled URLs used for training
BITS = 16  # the table of weights has 2^16 entries, whatever the input
GRAMS = (2, 3, 4, 5)
ROUNDS, RATE, RIDGE = 150, 0.5, 1e-3
THRESHOLD = 0.5

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_U = np.uint64


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _CAPITALS, _CAPITALS.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ruled(rules) -> list[tuple[Column, str, str]]:
    """(fits, rule, verdict), longest rule first, over the columns host and path."""
    out = []
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        own = (F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))
        out.append((own & F.startswith(F.col("path"), F.lit(prefix)), name + prefix, verdict))
    return out


def _first(rules, which: int) -> Column:
    out = F.lit(None).cast("string")
    for fits, *values in reversed(_ruled(rules)):
        out = F.when(fits, F.lit(values[which])).otherwise(out)
    return out


def split_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and the rule's verdict (null where no rule fits)."""
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return parts.withColumns({"rule": _first(rules, 0), "ruled": _first(rules, 1)})


def labelled_by_rules(split: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The small labelled table: (host, path, label), 1 for allow."""
    return (split.where("ruled is not null")
            .select("host", "path", (F.col("ruled") == "allow").cast("int").alias("label")).distinct()
            .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(sample))


def features(hosts: pa.Array, paths: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, table entry, value) of the n-grams of every host and path, with signs for their two ends."""
    rows, entries, sizes = [], [], np.zeros(len(hosts))
    for field, column in enumerate((hosts, paths)):
        texts = [f"\x02{t or ''}\x03" for t in column.to_pylist()]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        prefix = T.prefix_hash(points)
        for n in GRAMS:
            start = np.arange(max(0, len(points) - n + 1))
            start = start[start + n <= ends[row[start]]]
            key = T.mixed(T.span_hash(prefix, start, start + n) ^ _U(1 + 16 * n + field))
            rows.append(row[start])
            entries.append((key >> _U(64 - bits)).astype(np.int64))
            sizes += np.bincount(row[start], minlength=len(texts))
    row = np.concatenate(rows)
    return row, np.concatenate(entries), 1 / np.sqrt(np.maximum(sizes, 1))[row]


def fit(row: np.ndarray, entry: np.ndarray, value: np.ndarray, label: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Weights and, last, the bias; full gradient steps with a rate of its own for every weight."""
    w, seen = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-8)
    used = np.unique(entry)
    place = np.searchsorted(used, entry)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[entry], len(label)) + w[-1], -35, 35)))
        miss = (p - label) / len(label)
        g = np.bincount(place, miss[row] * value, len(used)) + RIDGE / len(label) * w[used]
        seen[used] += g * g
        w[used] -= RATE * g / np.sqrt(seen[used])
        g = miss.sum()
        seen[-1] += g * g
        w[-1] -= RATE * g / np.sqrt(seen[-1])
    return w


def _trainer(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        label = np.array(table.column("label").to_pylist(), float) if table is not None else np.zeros(0)
        if len(set(label.tolist())) < 2:
            w = np.zeros((1 << bits) + 1)
            w[-1] = -1.0 if len(label) and label[0] == 0 else 1.0
        else:
            w = fit(*features(table.column("host"), table.column("path"), bits), label, bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["weights"])
    return run


def train(labelled: DataFrame, bits: int = BITS) -> np.ndarray:
    """The weights, from a small table (host, path, label); one task trains, a table of fixed size reaches the driver."""
    found = labelled.coalesce(1).mapInArrow(_trainer(bits), "weights binary").collect()
    w = np.frombuffer(found[0].weights, "<f4") if found else np.zeros((1 << bits) + 1, "<f4")
    return w if found else np.append(w[:-1], np.float32(1))


def _scorer(weights: np.ndarray, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                hosts = pc.fill_null(part.column("host"), "")
                row, entry, value = features(hosts, pc.fill_null(part.column("path"), ""), bits)
                total = np.bincount(row, value * weights[entry], part.num_rows) + float(weights[-1])
                p = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
                yield pa.RecordBatch.from_arrays([*part.columns, p], [*part.schema.names, "score"])
    return run


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, sample: int = SAMPLE,
          bits: int = BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, score per URL.

    ``labelled``: (host, path, label) to train from, else URLs that the rules decide.
    """
    split = split_urls(pages, rules)
    weights = train(labelled_by_rules(split, sample) if labelled is None else labelled, bits)
    rows = split.drop("url")
    scored = rows.mapInArrow(_scorer(weights, bits), rows.withColumn("score", F.lit(0.0)).schema)
    model = F.when(F.col("score") >= THRESHOLD, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "score")
