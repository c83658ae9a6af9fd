"""The corpus pipeline, stage by stage, against plain versions of each stage."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from revlens.llm import mixing, quality_model, repeats
from revlens.llm.tables import stored
from revlens.session import shared_dir
from tests.llm.data import documents, plain, prose, texts
from tests.llm.test_native import WORD, brute_targets
from tests.llm.test_repeats import awkward, brute_classes
from tests.llm.test_tokens import FILES, encoded


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after every stage."""
    rows = texts() + awkward()
    rows += [(1000 + i, prose(2000 + i, 60 + i % 50), "abc"[i % 3]) for i in range(60)]
    rows += [(2000 + i, "!!## " * (40 + i), "a") for i in range(30)]
    folder = shared_dir(spark)
    docs = documents(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 2000), 0) for i, _, _ in rows if i is not None and i >= 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [("input", None)]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], folder)))
        out.append((name, frames[-1]))
    return folder, docs, frames


def triples(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_are_five_and_return_the_columns_of_documents(stages):
    _, docs, frames = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "suffix_repeats", "mixing", "packing"]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_what_the_model_does_not_reject(spark, stages):
    folder, docs, frames = stages
    weights = quality_model.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = Counter()
    for i, t, s in triples(docs):
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, at, value = quality_model.features(data, np.array([0, len(data)]))
        z = float((weights[at] * value).sum() + weights[-1])
        if 1 / (1 + np.exp(-z)) >= 0.3:
            want[i, t, s] += 1
    assert Counter(triples(frames[1])) == want
    kept = {i for i, _, _ in want}
    assert {1000 + i for i in range(60)} <= kept and not {2000 + i for i in range(30)} & kept


def test_one_document_of_each_class_stays(stages):
    before, after = triples(stages[2][1]), triples(stages[2][2])
    classes = brute_classes(before)
    keys = {c for (_, c), (_, t, _) in zip(classes, before) if t is not None and c is not None}
    got = [i for i, t, _ in after if t is not None and i is not None]
    assert sorted(got) == sorted(keys)
    assert set(after) <= set(before)


def test_repeated_strings_are_cut(spark, stages):
    before, after = triples(stages[2][2]), {(i, s): t for i, t, s in triples(stages[2][3])}
    count = Counter()
    for _, t, _ in before:
        x = (t or "").encode()
        count.update(x[k:k + repeats.LENGTH] for k in range(len(x) - repeats.LENGTH + 1))
    for i, t, s in before:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - repeats.LENGTH + 1):
            if count[x[k:k + repeats.LENGTH]] > 1:
                gone[k:k + repeats.LENGTH] = b"\1" * repeats.LENGTH
        kept = bytes(c for c, g in zip(x, gone) if not g)
        assert after[i, s] == (None if t is None else kept.decode(errors="ignore"))
    lengths = stages[2][3].where("text is not null and n_chars <> length(text)").count()
    assert lengths == 0


def test_the_mix_meets_its_targets(stages):
    before, after = triples(stages[2][3]), triples(stages[2][4])
    n = lambda t: len(WORD.findall(t or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, t, s in before:
        sizes[s] += n(t)
        largest[s] = max(largest[s], n(t))
    for _, t, s in after:
        taken[s] += n(t)
    want = brute_targets(dict(sizes))
    assert set(after) <= set(before)
    assert max(Counter(after).values()) <= mixing.MOST * max(Counter(before).values())
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)


def test_every_id_of_the_mix_is_packed_once(stages):
    before, packed = triples(stages[2][4]), stages[2][5].collect()
    want = Counter((i, len(x)) for i, x in encoded(before, FILES[1], 0))
    got, sequence = Counter(), defaultdict(list)
    for r in packed:
        got[r.doc_id, r.doc_tokens] += r.length
        sequence[r.sequence_id].append((r.offset, r.length))
    assert got == {k: k[1] * v for k, v in want.items()}
    for pieces in sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_the_mix_can_be_rebuilt_from_the_packed_ids(stages):
    want = Counter((i, x.tobytes()) for i, x in encoded(triples(stages[2][4]), FILES[1], 0))
    pieces = defaultdict(lambda: defaultdict(Counter))
    for r in stages[2][5].collect():
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id, r.doc_tokens][r.start][bytes(r.ids)] += 1
    own = Counter((i, len(x) // 4) for i, x in want)
    for (i, x), n in want.items():
        found = pieces[i, len(x) // 4]
        if own[i, len(x) // 4] > 1:  # different texts of one doc_id and length
            continue
        assert all(len(c) == 1 and set(c.values()) == {n} for c in found.values())
        assert b"".join(next(iter(found[at])) for at in sorted(found)) == x


def test_run_gives_the_rows_of_its_stages(spark, stages):
    folder, _, frames = stages
    assert plain(corpus_pipeline.run(spark, folder).collect()) == plain(frames[-1].collect())


def test_a_pipeline_of_no_documents(spark):
    folder = shared_dir(spark)
    documents(spark).where("false").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
