"""Classifier, URL filter, nearest neighbours."""

import math
import random

import numpy as np
import pytest

from revlens.llm import neighbours, quality_model, url_filter
from revlens.llm.queries import QUERIES
from tests.llm.data import documents, prose, texts

FOLDER = "/root/testdata/sf0.01"


def test_classifier_on_held_out_labels(spark):
    scored = QUERIES["op3_quality_model"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic = 0")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in rows if r.quality == 1], [r.predicted for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_training_ignores_held_out_and_unusable_labels(spark):
    rows = [(i, prose(i, 40) if i % 2 else "!!! " * 40, "a") for i in range(60)]
    docs = documents(spark, rows)
    flags = [(i, i % 2, "x") for i in range(60)]
    clean = spark.createDataFrame(flags, "doc_id long, quality int, text string")
    held = {r.doc_id for r in clean.where(quality_model.held_out()).collect()}
    assert held
    wrong = [(i, 1 - q if i in held else q, t) for i, q, t in flags] + [(None, 1, "x"), (3, None, "x"), (9999, 1, "x")]
    a = quality_model.train(docs, clean)
    b = quality_model.train(docs, spark.createDataFrame(wrong, clean.schema))
    assert (a == b).all() and np.abs(a).sum() > 0
    # The same model whatever the order of rows.
    assert (a == quality_model.train(docs.orderBy("text"), clean.orderBy("quality"))).all()


def test_scores_of_awkward_texts(spark):
    docs = documents(spark)
    none = quality_model.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_model.score(docs, none, ["doc_id", "text"])
    assert got.columns == ["doc_id", "text", "score"] and got.count() == len(texts())
    assert {r.score for r in got.collect()} == {0.5}
    weights = np.linspace(-1, 1, none.size).astype("<f4")
    got = quality_model.score(docs, weights, docs.columns, "_s")
    assert got.columns == [*docs.columns, "_s"]
    by = {r.doc_id: r._s for r in got.collect() if r.doc_id is not None}
    bias = 1 / (1 + math.exp(-1))
    assert by[4] == by[5] == by[6] == pytest.approx(bias) and by[7] == by[8] and by[1] == by[2] != bias
    assert quality_model.score(docs.where("false"), weights, ["doc_id"]).collect() == []


def test_chunks_do_not_change_features(monkeypatch):
    import pyarrow as pa

    from revlens.llm import text_arrays

    column = pa.array([t for _, t, _ in texts()])
    weights = np.random.default_rng(0).normal(size=1 << quality_model.BITS)

    def sums(most):
        out = []
        for first, end, data, offsets in text_arrays.chunks(column, most):
            doc, entry, value = quality_model.features(data, offsets)
            out += np.bincount(doc, weights[entry] * value, end - first).tolist()
        return out
    assert sums(1 << 20) == pytest.approx(sums(1), abs=1e-9)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[:min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host):]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "HTTPS://A.B.Org/x?y#z", "http://example.org/es/1",
        "http://www.example.org/en/1", "http://www.example.org/en/2", "http://notexample.org/es/", "http://myorg/x",
        "http://x.com/fr/a", "http://x.com/de/a", "http://x.com?/fr/", "http://x.com#a://b.org/", "x://y://z.org/",
        "http://É.com/ü/" + "long" * 5000, "http://a.net/\n/x", "http://a.net/\n/x"]


def test_urls_are_split_and_ruled(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(URLS):
        host, path = split(u)
        rule, verdict = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("allow" if got[i].score >= 0.5 else "block"))
    assert got[18].score == got[19].score
    assert url_filter.judge(pages.where("false")).collect() == []


def test_url_model_learns_from_labelled_urls(spark):
    rnd = random.Random(4)
    rows = [(f"h{rnd.randrange(99)}.net", f"/{'shop' if i % 2 else 'wiki'}/{rnd.randrange(9999)}", 1 - i % 2) for i in range(300)]
    labelled = spark.createDataFrame(rows, "host string, path string, label int")
    pages = spark.createDataFrame([(i, f"https://new{i}.net/{'shop' if i % 2 else 'wiki'}/x{i}") for i in range(60)], "page_id long, url string")
    got = url_filter.judge(pages, labelled).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)
    only = url_filter.judge(pages, labelled.where("label = 0")).collect()
    assert {r.verdict for r in only} == {"block"}


def brute_nearest(ids, x, asked, k):
    out = {}
    for i in asked:
        q = x[np.flatnonzero(ids == i)[0]]
        score = (x * q).sum(1)
        order = [(-score[j], ids[j]) for j in range(len(ids)) if ids[j] != i]
        out[i] = [(int(b), -a) for a, b in sorted(order)[:k]]
    return out


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)) * rng.uniform(0.1, 4, size=(700, 1))
    x[50:90], x[300:600] = x[50], x[300]  # ties, more than are asked for
    rows = spark.createDataFrame([(i, v.tolist(), "z") for i, v in enumerate(x)], "vec_id long, embedding array<double>, v string")
    asked = rows.where("vec_id % 20 = 0")
    got = neighbours.nearest(rows, asked, 10, 1.0, shard_rows=150, block_queries=9, leaf=8).collect()
    want = brute_nearest(np.arange(700), x, range(0, 700, 20), 10)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in by.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1]) for q in want for a, b in zip(by[q], want[q]))


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "unit clusters"])
def test_recall_over_several_full_shards(spark, kind):
    rng = np.random.default_rng(11)
    n, length = 20_000, 32
    x = rng.normal(size=(n, length))
    if kind != "gaussian":
        x = rng.normal(size=(200, length))[rng.integers(200, size=n)] * rng.uniform(0.5, 2, size=(n, 1)) + 0.2 * x
    if kind == "unit clusters":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, n, 500))
    got = neighbours.nearest(rows, rows.where("vec_id % 500 = 0")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(np.arange(n), x, asked, 20)
    shares = [len(found[q] & {i for i, _ in v}) / 20 for q, v in want.items()]
    assert n > 2 * neighbours.SHARD_ROWS and np.mean(shares) >= 0.95


def test_recall_with_production_parameters(spark):
    got = QUERIES["op4_neighbours"](spark, "/root/testdata/sf0.1").collect()
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    want = brute_nearest(ids, x, ids[ids % 20 == 0], 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for i, _ in v}) / 20 for q, v in want.items()]) >= 0.9
    assert set(found) == set(want)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]),
            (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [-1.0, 5.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 2, -1.0)]
    assert neighbours.nearest(df.where("false"), df).collect() == []
