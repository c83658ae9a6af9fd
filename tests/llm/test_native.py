"""Quality rules, sharding and mixing."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from revlens.llm import mixing, quality_rules, sharding
from revlens.llm.oracle import ORACLE
from revlens.llm.queries import QUERIES
from tests.compare import connect, difference
from tests.llm.data import documents, plain, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_counts_equal_a_plain_count(spark):
    rows = texts() + [(200, "a b c a b c a b", "a"), (201, "x x x x", "a"), (202, "l\nl\n\n \nl", "a"), (203, "a\x85b c", "a")]
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(documents(spark, rows)).collect()}
    for doc_id, text, _ in rows:
        want = brute_counts(text)
        r = got[doc_id, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def brute_em(votes, rounds):
    share, acc = 0.8, [(0.9, 0.3)] * len(votes[0])
    for _ in range(rounds):
        post = []
        for v in votes:
            z = math.log(share / (1 - share))
            for x, (g, b) in zip(v, acc):
                z += math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) if x == -1 else 0
            post.append(1 / (1 + math.exp(-z)))
        share = (sum(post) + 1) / (len(votes) + 2)

        def ratio(j, sign, weight, start):
            right = sum(w for v, w in zip(votes, weight) if v[j] == sign)
            return min(0.998, max(0.002, (right + start) / (sum(w for v, w in zip(votes, weight) if v[j]) + 1)))

        acc = [(ratio(j, 1, post, 0.9), ratio(j, -1, [1 - p for p in post], 0.3)) for j in range(len(acc))]
    return share, acc


def test_em_equals_a_plain_one_and_finds_the_accuracies(spark):
    rnd = random.Random(3)
    truth, votes = [(0.95, 0.6), (0.9, 0.75), (0.85, 0.8), (0.97, 0.5)], []
    for _ in range(6000):
        good = rnd.random() < 0.7
        votes.append(tuple(0 if rnd.random() < 0.2 else (1 if (rnd.random() < g) else -1) if good
                           else (-1 if rnd.random() < b else 1) for g, b in truth))
    rules = ["r0", "r1", "r2", "r3"]
    df = spark.createDataFrame(votes, ", ".join(f"{r} int" for r in rules))
    share, acc = quality_rules.fit(df, rules, rounds=9)
    want_share, want = brute_em(votes, 9)
    assert share == pytest.approx(want_share, abs=1e-9)
    assert [x for r in rules for x in acc[r]] == pytest.approx([x for w in want for x in w], abs=1e-9)
    share, acc = quality_rules.fit(df, rules)
    assert abs(share - 0.7) < 0.06
    assert all(abs(x - y) < 0.08 for r, t in zip(rules, truth) for x, y in zip(acc[r], t))


def test_rules_reject_junk_and_keep_clean_documents(spark):
    folder = "/root/testdata/sf0.1"
    judged = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.995 and sum(bad) / len(bad) < 0.5


def test_rules_on_an_empty_table(spark):
    assert quality_rules.judge(documents(spark, []).where("false")).collect() == []


def brute_cuts(sizes, shards):
    def need(capacity):
        cuts, left = [0], None
        total = 0
        for s in sizes:
            if left is None or s > left:
                cuts.append(total)
                left = capacity
            total += s
            left -= s
            cuts[-1] = total
        return cuts

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(need(middle)) - 1 <= shards:
            high = middle
        else:
            low = middle + 1
    cuts = need(low)
    return low, cuts + [cuts[-1]] * (shards + 1 - len(cuts))


@pytest.mark.parametrize("local_ends", [0, 10_000])
@pytest.mark.parametrize("shape", ["even", "hot", "few", "one"])
def test_cuts_are_the_minimax_partition(spark, shape, local_ends):
    rnd = random.Random(5)
    sizes = {"even": [rnd.randint(1, 90) for _ in range(300)],
             "hot": [rnd.randint(1, 9) for _ in range(100)] + [700] + [rnd.randint(1, 9) for _ in range(100)],
             "few": [5, 1, 9], "one": [4]}[shape]
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append((total, s))
    df = spark.createDataFrame(ends, "end long, size long")
    got = sharding.minimax_cuts(df, total, max(sizes), 5, local_ends)
    assert got == brute_cuts(sizes, 5)


def test_shards_hold_whole_groups_and_gapless_slots(spark):
    got = sharding.shard_documents(documents(spark), 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in texts())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, groups, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32].add(r.shard)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert all(len(s) == 1 for s in groups.values())
    biggest = max(len((t or "").encode()) + 1 for _, t, _ in texts())
    assert max(sizes.values()) <= max(biggest, -(-sum(sizes.values()) // 4) + biggest)
    assert sharding.shard_documents(documents(spark).where("false")).collect() == []


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        rest = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] >= 3 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] for s in open_}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rows = texts() + [(500 + i, f"w{i} " * (5 + i % 7), "tiny") for i in range(3)] + [(600, " ", "nothing")]
    got = mixing.mix_documents(documents(spark, rows), block=8).collect()
    n = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n(t)
    want = brute_targets({s: sizes[s] for s in {r[2] for r in rows}})
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, n(t), s) for i, t, s in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        x = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(x - 1e-9) <= r.copies <= math.ceil(x + 1e-9)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix_documents(documents(spark, rows[::-1]), block=8).collect()
    assert plain(got) == plain(again)
    assert mixing.mix_documents(documents(spark).where("false")).collect() == []


def test_rounding_is_unbiased_and_near_the_target():
    sizes = [900, 300, 120, 60, 50, 40, 40, 30, 8, 3]
    hits, rnd = Counter(), random.Random(1)
    draws = iter(rnd.random, None)
    for _ in range(4000):
        p, held = mixing._round_pool([0.4] * len(sizes), list(sizes), draws)
        total = sum(a * b for a, b in zip(p, sizes))
        assert total == pytest.approx(0.4 * sum(sizes))
        hits.update({i: x for i, x in enumerate(p)})
        q, held = mixing._round_block([0.2, 0.7, 0.5, 0.9], [5, 9, 4, 7], draws)
        assert sum(0 < x < 1 for x in q) <= 1
        assert sum(a * b for a, b in zip(q, [5, 9, 4, 7])) == pytest.approx(15.6)
    assert all(abs(hits[i] / 4000 - 0.4) < 0.04 for i in range(len(sizes)))


def test_repeated_rows_spread_over_blocks(spark, monkeypatch):
    rows = texts() + [(None, "the same", "a")] * 150 + [(900, "one two three", "a")] * 50
    rounder = mixing._rounder

    def bounded(*args):
        block = rounder(*args)

        def run(frame):
            assert len(frame) <= 4 * 8
            return block(frame)
        return run

    monkeypatch.setattr(mixing, "_rounder", bounded)
    got = mixing.mix_documents(documents(spark, rows), block=8).collect()
    again = mixing.mix_documents(documents(spark, rows[::-1]), block=8).collect()
    assert len(got) == len(rows) and plain(got) == plain(again)


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    sums = Counter()
    for (i, s, t), k in got.items():
        sums[i, s, len(WORD.findall(t or ""))] += k
    assert sums == +want
    assert mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("key", list(ORACLE))
def test_query_agrees_with_sql(spark, key):
    folder = "/root/testdata/sf0.01"
    assert difference(spark, connect(folder), QUERIES[key], ORACLE[key], folder) is None
