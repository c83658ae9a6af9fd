"""Streaming exact deduplication against a plain grouping."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from revlens.llm import stream_dedup
from tests.llm.data import documents, plain, texts

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    """Expected (doc_id, keep_id, group_size, text_sha256) of every row, and which texts there are."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows]


def check(got, rows):
    got = [tuple(r) for r in got.select(*COLUMNS).collect()]
    assert plain(r[:3] + r[4:] for r in got) == plain(brute(rows))
    kept = [r for r in got if r[3]]
    assert all(r[0] == r[1] for r in kept)
    assert len({r[4] for r in got}) == len(kept)  # one of each text, of rows equal in id and text as well


def few_bits(content):
    """A digest with four values."""
    return F.substring(F.hex(stream_dedup.sha256(content)), 1, 1).cast("binary").substr(1, 1)


def written(spark, tmp_path, *parts):
    path = str(tmp_path / "docs")
    for rows in parts:
        documents(spark, rows).write.mode("append").parquet(path)
    return path


def odd():
    return texts() + [(None, "twice null", "a")] * 2 + [(300, "null and id", "a"), (None, "null and id", "b")]


def test_equals_a_plain_grouping(spark, tmp_path):
    rows = odd() + [(400 + i, "hot text", "a") for i in range(60)]
    path = written(spark, tmp_path, rows[:40], rows[40:])
    got = stream_dedup.decisions(spark, path, batches=3)
    check(got, rows)


@pytest.mark.parametrize("batches", [1, 6])
def test_full_bytes_decide(spark, tmp_path, batches):
    """Digests that stand for several texts, within a micro-batch and across them."""
    rows = odd()
    path = written(spark, tmp_path, rows[:30], rows[30:])
    folder = str(tmp_path / "state")
    check(stream_dedup.decisions(spark, path, folder, batches=batches, digest=few_bits), rows)
    classes = stream_dedup.update_classes(spark, path, folder, digest=few_bits)
    assert classes.where("differ").count() > 0


def test_state_outlives_a_run(spark, tmp_path):
    first, second = odd(), [(10_000, "one two", "a"), (-1, "one two", "b"), (10_001, None, "a"), (10_002, "new", "a")]
    path, folder = written(spark, tmp_path, first), str(tmp_path / "state")
    check(stream_dedup.decisions(spark, path, folder), first)
    check(stream_dedup.decisions(spark, path, folder), first)  # nothing new
    written(spark, tmp_path, second)
    got = stream_dedup.decisions(spark, path, folder)
    check(got, first + second)
    assert {(r.doc_id, r.kept) for r in got.where("keep_id = 10000").collect()} == {
        (7, False), (8, False), (-1, False), (10_000, True)}
    assert stream_dedup.update_classes(spark, path, folder).where("differ").count() == 0


def test_text_ids_one_file_and_empty(spark, tmp_path):
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("ä", "y"), (None, "z"), (None, "z")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "name string, text string").coalesce(1).write.parquet(path)
    got = stream_dedup.decisions(spark, path, id_column="name")
    assert plain((r.name, r.keep_id, r.group_size, r.kept) for r in got.collect())[:4] == plain(
        [("a", "b", 3, False), ("b", "b", 3, True), (None, "b", 3, False), ("ä", "ä", 1, True)])[:4]
    assert sorted(r.kept for r in got.where("group_size = 2").collect()) == [False, True]
    empty = str(tmp_path / "empty")
    documents(spark, []).write.parquet(empty)
    assert stream_dedup.decisions(spark, empty).collect() == []
    with pytest.raises(TypeError):
        spark.createDataFrame([(1.5, "x")], "doc_id double, text string").write.parquet(str(tmp_path / "double"))
        stream_dedup.decisions(spark, str(tmp_path / "double"))


def test_bytes_of_older_documents_are_looked_up(spark, tmp_path):
    """A new text that shares its digest with one old text alone."""
    path, folder = written(spark, tmp_path, [(1, "first", "a"), (2, "other", "a")]), str(tmp_path / "state")
    by_first = lambda content: F.when(content == F.lit(b"other"), F.lit(b"o")).otherwise(F.lit(b"f"))
    assert stream_dedup.update_classes(spark, path, folder, digest=by_first).where("differ").count() == 0
    written(spark, tmp_path, [(3, "second", "a")])
    got = stream_dedup.decisions(spark, path, folder, digest=by_first)
    check(got, [(1, "first"), (2, "other"), (3, "second")])
    written(spark, tmp_path, [(4, "first", "a")])
    check(stream_dedup.decisions(spark, path, folder, digest=by_first), [(1, "first"), (2, "other"), (3, "second"), (4, "first")])
