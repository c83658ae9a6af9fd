"""Tables of which half are equal rows: no file, shard or task gets them all."""

import numpy as np
from pyspark.sql import functions as F

from revlens.llm import mixing, neighbours, records, sharding, tables
from tests.llm.data import documents

HOT = [(7, "the same text again and again " * 4, "a")] * 1500
OTHERS = [(100 + i, f"text number {i} of its own kind " * 4, "ab"[i % 2]) for i in range(1500)]


def test_record_files(spark, tmp_path):
    import public_tokenizers
    folder = str(tmp_path / "records")
    records.write_records(documents(spark, HOT + OTHERS), folder, public_tokenizers.path("word_bpe_49k.json"), file_bytes=40_000)
    index = records.build_index(spark, folder, str(tmp_path / "index"))
    sizes = sorted(r["count"] for r in index.groupBy("file").count().collect())
    assert sum(sizes) == 3000 and len(sizes) > 5 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = records.starts(index).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_numbering_of_shards(spark, monkeypatch):
    seen = []
    plain = sharding.numbered
    monkeypatch.setattr(sharding, "numbered", lambda df, order, size: seen.append(
        df.repartitionByRange(8, *order)) or plain(df, order, size))
    got = sharding.shard_documents(documents(spark, HOT + OTHERS)).collect()
    assert len(got) == 3000 and sorted((r.shard, r.slot) for r in got) == sorted(
        (s, n) for s in range(16) for n in range(sum(r.shard == s for r in got)))
    parts = [r["count"] for r in seen[0].groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(parts) <= 2 * np.median(parts)


def test_mix_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MANY", 50)
    docs = documents(spark, HOT + OTHERS)
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(docs).groupBy("doc_id").agg(F.sum("copies").alias("taken")).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in taken.items() if n}


def test_shards_of_vectors(spark, monkeypatch):
    same = [(5, [1.0, 2.0, 3.0])] * 600
    rng = np.random.default_rng(1)
    others = [(10 + i, [float(x) for x in rng.normal(size=3)]) for i in range(600)]
    vectors = spark.createDataFrame(same + others, "vec_id long, embedding array<double>")
    dealt = tables.salted(vectors, ["vec_id", "embedding"], 25)
    per = [r["count"] for r in dealt.where("vec_id = 5").groupBy("salt").count().collect()]
    assert max(per) <= 25 and sum(per) == 600
    got = neighbours.nearest(vectors, vectors.where("vec_id in (5, 10)"), k=700, factor=1.0, shard_rows=100).collect()
    assert sum(r.query_id == 10 and r.vec_id == 5 for r in got) == 600
    assert sum(r.query_id == 5 for r in got) == 600 and not any(r.query_id == r.vec_id for r in got)
