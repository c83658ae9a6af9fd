"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from revlens.llm import phrases
from tests.llm.data import documents, plain, texts

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_pieces(text):
    return [w for part in PIECE.split((text or "").translate(LOWER)) if (w := [x for x in re.split("[ \t]+", part) if x])]


def brute(rows, least, top, share=100):
    """``rows``: (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in brute_pieces(text):
            totals[lang] += len(w)
            for m in range(1, 6):
                counts[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in counts.items():
        often = {p: a for p, a in count.items() if a >= least}
        inside = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and 100 * a >= share * often[p[i:j]]}
        found = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * totals[lang] // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


def babble(seed, n, lang="en"):
    r = random.Random(seed)
    words = ["so", "Öl", "the", "THE", "de", "la", "a\x01", "a", "\x00", "x-y", "'s", "日本"]
    weights = [2 ** -i for i in range(len(words))]
    return [(lang, "".join(r.choice([" ", "  ", "\t", " ", ". ", "\n", ", "]) + w for w in r.choices(words, weights, k=40)))
            for _ in range(n)]


def frame(spark, rows):
    return documents(spark, [(i, t, "a") for i, (_, t) in enumerate(rows)]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string"), "doc_id")


@pytest.mark.parametrize("share", [100, 60])
def test_equals_a_plain_count(spark, share):
    rows = babble(1, 60) + babble(2, 25, "fr") + babble(3, 10, None) + babble(4, 5, "und") + [("en", None), ("de", ""), ("de", " .\n")]
    want = brute(rows, 4, 50, share)
    assert len({r[0] for r in want}) == 3 and max(r[1] for r in want) == 50
    for small in ({}, {"range_bytes": 1500, "chunk": 400}):  # many ranges and runs, or one
        got = phrases.collocations(frame(spark, rows), least=4, top=50, share=share, **small)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert plain(got.collect()) == plain(want)


def test_counts_of_all_phrases(spark):
    rows = babble(5, 30)
    want = Counter()
    for _, text in rows:
        for w in brute_pieces(text):
            want[""] += len(w)
            for m in range(1, 6):
                want.update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    got = phrases.frequent_phrases(frame(spark, rows), 1, range_bytes=700, chunk=300)
    assert {r.phrase: r.n for r in got.collect()} == dict(want)


def test_odd_texts_and_repeated_rows(spark):
    rows = [("en", t) for _, t, _ in texts()] * 3 + [("en", "ha " * 5000)] * 40 + [(None, "ha ha")] * 7
    assert plain(phrases.collocations(frame(spark, rows), least=5, range_bytes=20000, chunk=5000).collect()) == plain(
        brute(rows, 5, phrases.TOP))


def test_empty_table(spark):
    assert phrases.collocations(documents(spark, [])).collect() == []
    assert phrases.collocations(documents(spark, [(1, None, "a"), (2, "", "a")])).collect() == []


def test_long_text_in_segments(monkeypatch):
    r = random.Random(9)
    text = b"".join(r.choice([b"a", b"bb", b"c", b"dddddddd"]) + r.choice([b" ", b"  ", b"\t", b". "]) for _ in range(3000))
    whole = phrases.windows([(text, len(text))])
    monkeypatch.setattr(phrases, "CHUNK", 97)
    parts = list(phrases._segments(text))
    assert len(parts) > 50 and sum(own for _, own in parts) == len(text)

    def rows(vocabulary, ranks, counts):
        words = [b"", *vocabulary.to_pylist()]
        out = Counter()
        for w, n in zip(ranks, counts):
            out[tuple(words[i] for i in w)] += int(n)
        return out

    assert sum((rows(*phrases.windows([p])) for p in parts), Counter()) == rows(*whole) == rows(*phrases.windows(parts))


def test_a_common_window_is_one_row_a_chunk():
    vocabulary, ranks, counts = phrases.windows([(b"x y " * 10000, 40000)])
    assert len(vocabulary) == 2 and len(ranks) == 2 + 4 and counts.sum() == 20000


def test_exact_beyond_64_bits(spark, monkeypatch):
    counts = [("en", "", 0, 4 * 10**16), ("en", "a", 1, 10**14 + 7), ("en", "b", 1, 10**14 - 9), ("en", "a b", 2, 10**13 + 1)]
    monkeypatch.setattr(phrases, "frequent_phrases",
                        lambda *_, **__: spark.createDataFrame(counts, "lang string, phrase string, words int, n long"))
    (row,) = phrases.collocations(documents(spark, [])).collect()
    assert row.score == 1000 * (10**13 + 1) * 4 * 10**16 // ((10**14 + 7) * (10**14 - 9))


def test_runs_are_added_up_in_steps(monkeypatch):
    import pyarrow as pa
    rows = babble(12, 40) + [("en", "so the de " * 30)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in rows]), pa.array([t.encode() for _, t in rows])],
                                       ["lang", "text"])
    common = [b"so", b"the", b"unused"]

    def counts():
        runs = phrases._runs([("en", (b"de",)), ("en", (b"so", b"the"))], common, 300)(iter([batch]))
        by_range = sorted(runs, key=lambda r: (r.column("pid")[0].as_py(), r.column("lang")[0].as_py()))
        out = Counter()
        for found in phrases._merger(common, 1)(iter(by_range)):
            for phrase, n in zip(found.column("phrase").to_pylist(), found.column("n").to_pylist()):
                out[phrase.decode()] += n
        return out

    whole = counts()
    monkeypatch.setattr(phrases, "MERGED", 20)
    want = Counter()
    for _, text in rows:
        for w in brute_pieces(text):
            want[""] += len(w)
            for m in range(1, 6):
                want.update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    assert counts() == whole == want
