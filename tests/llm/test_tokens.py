"""Token ids, records and packing against the library's plain encoding."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from revlens.llm import packing, records, tokens
from revlens.llm.queries import QUERIES
from revlens.session import shared_dir
from tests.llm.data import documents, plain, prose, texts

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
STRINGS = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "\n", "A'S don't we'LL", "x1y22 3,4", "<|endoftext|>",
           "q<|endoftext|>r <|startoftext|>", "é e\u0301 ÄÖß ΑΣ Σ", "tab\tbed", "a\u00a0b", "a\u2003b c", "\x1c x\x1cy", "a\0b c", "日本語 テキスト",
           "x\u0301 \u0301y", "İI ı", "“quoted” — dash…", "!!##$$ %%%", "a\u180e b", "end.\nStart (of) it|", "😀 😀👍🏽", "\r\n x"]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    encode, plainly = tokens.Encoder(path, kept=500), Tokenizer.from_file(path)
    rnd = random.Random(7)
    alphabet = list("ab Z\n.'1é\u0301 \t|") + ["<|endoftext|>", "word", " the"]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in STRINGS + made + real + [t for _, t, _ in texts() if t]:
        got = tokens.numbers(encode.ids(text), encode.width).tolist()
        assert got == plainly.encode(text, add_special_tokens=False).ids, text[:80]


def encoded(rows, name, end):
    plainly = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, np.array(plainly.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for i, t, _ in rows]


def test_records_round_trip(spark):
    rows = texts()
    folder = shared_dir(spark)
    records.write_records(documents(spark), f"{folder}/d", public_tokenizers.path(FILES[0]), file_bytes=20_000)
    index = records.build_index(spark, f"{folder}/d", f"{folder}/i")
    got = sorted(records.starts(index).collect(), key=lambda r: r.start)
    ids = encoded(rows, FILES[0], 1)
    assert plain((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == plain(
        (i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and len({r.file for r in got}) > 1
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    some = index.where("number % 3 = 1")
    fetched = {(r.doc_id, len(r.ids)): r.ids for r in records.read_records(spark, f"{folder}/d", some).collect()}
    assert len(fetched) == some.count()
    by = {(i, len(x)): x.tolist() for i, x in ids}
    assert all(by[k] == v for k, v in fetched.items())


def test_records_of_no_documents(spark):
    folder = shared_dir(spark)
    records.write_records(documents(spark).where("false"), f"{folder}/d", public_tokenizers.path(FILES[0]))
    assert records.starts(records.build_index(spark, f"{folder}/d", f"{folder}/i")).collect() == []


def test_a_broken_record_is_noticed():
    good = records.frame(7, b"\n\1\2\3" * 5) + b"\n" + records.frame(None, b"\5\1", 2) + b"\n"
    assert [(a, b, c, d.tolist()) for a, b, c, d in records.records(memoryview(good))] == [
        (0, 49, 7, [0x0302010A] * 5), (49, 31, None, [261])]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError, Exception)):
            list(records.records(memoryview(bytes(bad))))


def test_windows_of_multiway_differencing():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = [rnd.randint(1, 256) for _ in range(rnd.randint(0, 120))]
        windows = packing.pack(sizes)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 1024 for w in windows)
        assert len(windows) <= -(-sum(sizes) // 1024) + 2
    sums, members = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sums == [16, 14] and [sum([8, 7, 6, 5, 4][i] for i in m) for m in members] == sums  # the textbook case


def test_packing_holds_every_id_once(spark):
    rows = texts() + [(700 + i, prose(900 + i, 700), "a") for i in range(12)]
    docs = documents(spark, rows)
    path = public_tokenizers.path(FILES[1])
    packed = packing.pack_documents(docs, path, bundle=20, with_ids=True)
    got = packed.collect()
    byd, seq = defaultdict(list), defaultdict(list)
    for r in got:
        byd[r.doc_id, r.doc_tokens].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, x in encoded(rows, FILES[1], 0):
        want[i, len(x)].append(x)
    assert set(byd) == set(want)
    for k, xs in want.items():
        starts = defaultdict(list)
        for r in byd[k]:
            starts[r.start].append(r)
        at = 0
        while at < k[1]:  # repeated rows have the same pieces, each as often as the row
            assert len(starts[at]) == len(xs)
            r = starts[at][0]
            assert {zlib.crc32(x[at:at + r.length].tobytes()) for x in xs} == {p.ids_crc32 for p in starts[at]}
            at += r.length
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    tokens_in = sum(length for p in seq.values() for _, length in p)
    assert tokens_in > 0.85 * 1024 * len(seq)
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) == 1024 for r in whole) and sum(r.n_tokens for r in whole) == tokens_in
    assert packing.pack_documents(docs.where("false"), path).collect() == []


def test_lengths_and_checksums_are_those_of_the_packed_ids(spark, monkeypatch):
    folder, packer = shared_dir(spark), packing._packer
    documents(spark).write.parquet(f"{folder}/documents.parquet")

    def losing(*args):
        bundle = packer(*args)

        def run(rows):
            out = bundle(rows)
            out["ids"] = [x[4:] for x in out.ids]
            return out
        return run

    right = {(r.doc_id, r.doc_tokens, r.start): r for r in QUERIES["op10_packing"](spark, folder).collect()}
    monkeypatch.setattr(packing, "_packer", losing)
    wrong = QUERIES["op10_packing"](spark, folder).collect()
    by = {(i, len(x)): x for i, x in encoded(texts(), FILES[1], 0)}
    assert {(r.doc_id, r.doc_tokens, r.start) for r in wrong} == set(right)
    for r in wrong:
        before = right[r.doc_id, r.doc_tokens, r.start]
        own = by[r.doc_id, r.doc_tokens][r.start:r.start + before.length]
        assert before.ids_crc32 == zlib.crc32(own.tobytes())
        assert (r.length, r.ids_crc32) == (len(own) - 1, zlib.crc32(own[1:].tobytes()))


def test_repeated_rows_spread_over_bundles(spark):
    rows = texts() + [(None, "the same", "a")] * 150 + [(900, "again", "b")] * 50
    packed = packing.pack_documents(documents(spark, rows), public_tokenizers.path(FILES[1]), bundle=8).collect()
    heads = [r for r in packed if r.start == 0]
    want = Counter((i, len(x), zlib.crc32(x[:r].tobytes())) for i, x in encoded(rows, FILES[1], 0)
                   for r in [packing.cut(len(x))[0]])
    assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in heads) == want
    assert max(Counter(r.sequence_id >> 32 for r in heads).values()) <= 4 * 8


@pytest.mark.parametrize("name, normalizer", [
    ("word_bpe_49k.json", None), ("word_bpe_49k.json", {"type": "NFD"}), ("byte_bpe_50k.json", {"type": "Lowercase"})])
def test_other_normalizers_are_heeded(tmp_path, name, normalizer):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    path = str(tmp_path / "changed.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({**spec, "normalizer": normalizer}, f)
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    for text in ("Hello World", "Café  CAFÉ", "a\u0301 É x", "one two"):
        want = library.encode(text, add_special_tokens=False).ids
        assert tokens.numbers(own.ids(text), own.width).tolist() == want
