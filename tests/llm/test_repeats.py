"""Deep-shallow sorting, removal of repeats, near duplicates."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from revlens.llm import near_duplicates, repeats, suffix_sort, text_arrays
from tests.llm.data import documents, plain, prose, texts


@pytest.mark.parametrize("seed", range(12))
def test_order_and_equality_of_sorted_strings(seed):
    rng = np.random.default_rng(seed)
    n, length = int(rng.integers(1, 300)), int(rng.choice([8, 32, 40, 64]))
    buffer = rng.integers(0, rng.integers(1, 4) + 1, n + length).astype(np.uint8)
    if seed % 3 == 0:
        buffer = np.resize(buffer[:37], n + length)
    places, bucket = rng.permutation(n), rng.integers(0, 3, n)
    order, same = suffix_sort.deep_shallow(buffer, places, bucket, length)
    strings = [(int(bucket[i]), buffer[places[i]:places[i] + length].tobytes()) for i in order]
    assert strings == sorted(strings)
    assert same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]
    often = Counter((int(b), buffer[p:p + length].tobytes()) for p, b in zip(places, bucket))
    want = [often[int(b), buffer[p:p + length].tobytes()] > 1 for p, b in zip(places, bucket)]
    assert suffix_sort.repeated(buffer, places, bucket, length).tolist() == want


def brute_repeats(rows):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, x in data:
        count.update(x[k:k + 200] for k in range(len(x) - 199))
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if count[x[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(x)))
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def awkward():
    """Repeats within a text, periods, exact 199 and 200 byte matches, overlaps."""
    s = prose(31, 100)
    return [(300, s + s, "a"), (301, "ab" * 500, "a"), (302, "z" * 199, "a"), (303, "z" * 200, "a"), (304, "q" * 201, "a"),
            (305, "1" + s[:199] + "2", "a"), (306, "x" * 30 + s[5:205] + "y" * 30, "a"),
            (307, s[100:350] + s[300:520], "a"), (308, "Ha " * 900, "a")]


@pytest.mark.parametrize("limit", [repeats.CONTEXTS, 1])
def test_repeats_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(repeats, "SORTED_BYTES", 4000)
    rows = texts() + awkward()
    docs = documents(spark, rows)
    got = {(r.doc_id, r.tie): r for r in repeats.repeats(docs, limit).collect()}
    ties = {(r.doc_id, r.text): r.tie for r in repeats.tied(docs, "text").collect()}
    for (i, t, _), (_, n, removed, spans, sha) in zip(rows, brute_repeats(rows)):
        r = got.get((i, ties[i, t]))
        if not removed:
            assert r is None
        else:
            assert (r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == (removed, spans, sha), i
    if limit > 1:
        digest = [tuple(r) for r in repeats.cut_digest(docs).collect()]
        assert plain(digest) == plain(brute_repeats(rows))


def test_kept_texts(spark):
    docs = documents(spark, texts() + awkward())
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[1] == "" and by[4] is None and by[5] == "" and by[100] == texts()[-30][1]
    assert repeats.cut_digest(docs.where("false")).collect() == []


def test_kept_texts_keep_replacement_characters(spark):
    s = prose(33, 60)
    rows = [(320, "a\ufffdb " + s + " c\ufffd", "a"), (321, "q" + s + "\ufffd", "a"),
            (322, "é" + "z" * 199, "a"), (323, "\ufffdĩ" + "z" * 199, "a")]  # letters that share their second byte
    by = {r.doc_id: r.text for r in repeats.without_repeats(documents(spark, rows)).collect()}
    assert by == {320: "a\ufffdb  c\ufffd", 321: "q\ufffd", 322: "", 323: "\ufffd"}


def brute_classes(rows):
    bags = []
    for _, t, _ in rows:
        w = (t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in "".join(" " if c in " \t\n\r" else c for c in w).split(" ") if x]
        bags.append(Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] is None or rows[b][1] is None:
                continue
            both, all_ = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if rows[a][1] == rows[b][1] or all_ and both / all_ >= 0.8:
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for x in range(len(rows)):
        classes[find(x)].append(rows[x][0])
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in classes.items()}
    return [(rows[x][0], least[find(x)]) for x in range(len(rows))]


def near_rows():
    """A long chain whose ends are far apart, a group of near copies, one shared passage in different texts."""
    rnd, rows = random.Random(9), texts()
    words = prose(40, 150).split()
    for i in range(12):  # each differs from the one before in one word
        words[10 * i + 5] = f"step{i}"
        rows.append((400 + i, " ".join(words), "a"))
    group = prose(41, 200).split()
    for i in range(40):
        copy = list(group)
        copy[rnd.randrange(200)] = f"edit{i}"
        rows.append((450 + i, " ".join(copy), "a"))
    passage = prose(42, 70)
    rows += [(500 + i, passage + " " + prose(600 + i, 45), "a") for i in range(30)]
    return rows + [(550, "rep eat " * 100, "a"), (551, "rep eat " * 104, "b"), (552, "rep eat " * 150, "b")]


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rows = near_rows()
    out = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    assert plain((r.doc_id, r.class_id) for r in out) == plain(brute_classes(rows))


def test_rows_stay_few_where_many_texts_are_nearly_linked(spark, monkeypatch):
    rnd, core, rows = random.Random(5), prose(43, 400).split(), []
    for i in range(300):  # four edits in one half: linked to each other; six in the other half: 0.74 to 0.8 to most
        copy = list(core)
        for at in rnd.sample(range(40), 6) if i % 4 else rnd.sample(range(40, 80), 4):
            copy[5 * at + 2] = f"edit{i}at{at}"
        rows.append((700 + i, " ".join(copy), "a"))
    made, plain_stored = [], near_duplicates.stored

    def stored(df, *more, **named):
        out = plain_stored(df, *more, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_duplicates, "stored", stored)
    out = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    want = brute_classes(rows)
    assert plain((r.doc_id, r.class_id) for r in out) == plain(want) and len({c for _, c in want}) > 50
    assert max(made) <= 40 * len(rows)  # of the bands; there are 44,850 pairs, nearly all of them candidates


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_blocks_find_each_pair_once(batch):
    words = prose(44, 120).split()
    texts_ = [" ".join([*words[:k], f"edit{k}", *words[k + 1:]]) for k in range(0, 120, 10)]
    signed = pd.concat([b.to_pandas() for b in near_duplicates._signer(iter([pa.RecordBatch.from_arrays(
        [pa.array([bytes([k]) for k in range(12)]), pa.array(texts_)], ["key", "text"])]))], ignore_index=True)
    rows = [(band, 0, 0, asks, minor, n, n, row.marks, texts_[n]) for n, row in signed.iterrows() for band in row.bands
            for minor in [n > 0] for asks in ([True, False] if minor else [False])]
    rows = pd.DataFrame(rows, columns=["band", "h", "o", "asks", "minor", "node", "label", "marks", "text"])
    rows = rows.sort_values("band", kind="stable", ignore_index=True)
    pairs = []
    for part, borders in near_duplicates._whole_blocks(rows[k:k + batch] for k in range(0, len(rows), batch)):
        for i, j in near_duplicates._candidates(part, borders):
            node = part.node.to_numpy()
            pairs += map(tuple, np.sort(np.stack([node[i], node[j]], 1)).tolist())
    assert sorted(pairs) == [(a, b) for a in range(12) for b in range(a + 1, 12)]


def test_one_row_of_every_class_stays(spark):
    rows = near_rows()
    docs = documents(spark, rows)
    kept = near_duplicates.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in brute_classes(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert {i for i in got if i is not None} == {c for c in want if c is not None} and len(got) == len(set(got)) + 1
    assert near_duplicates.near_duplicates(docs.where("false")).collect() == []


def test_signatures_estimate_the_weighted_jaccard():
    rng = np.random.default_rng(2)
    key = np.arange(60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ratios = []
    for t in range(30):
        a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
        doc = np.repeat([0, 1], 60)
        salt = np.uint64(t + 1) << np.uint64(32)
        marks = near_duplicates.signatures(doc, np.tile(key ^ salt, 2), np.concatenate([a, b]), 2)
        ratios.append(((marks[0] == marks[1]).mean(), np.minimum(a, b).sum() / np.maximum(a, b).sum()))
    got, want = np.array(ratios).mean(0)
    assert abs(got - want) < 0.02


def test_words_and_spans_of_a_chunk():
    column = pa.array(["a b", None, "", "c", " d\te ", "é f"])
    found = []
    for first, end, data, offsets in text_arrays.chunks(column, 3):
        start, stop, doc = text_arrays.words(data, offsets)
        found += [(first + d, bytes(data[s:e]).decode()) for s, e, d in zip(start, stop, doc)]
    assert found == [(0, "a"), (0, "b"), (3, "c"), (4, "d"), (4, "e"), (5, "é"), (5, "f")]
