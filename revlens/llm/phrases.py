"""Phrase collocations: phrases that occur more often than their parts let expect.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at
blanks. Every position in a piece starts one window of up to five words, so the windows
hold the counts of all phrases of up to five words: a phrase's count is the number of
windows that begin with it.

*Counting.* A task sorts the windows of a chunk of text as ranks in the chunk's own sorted
vocabulary, adds up equal ones, and cuts the sorted stream at the borders of ranges of
windows that were drawn from a sample of texts (borders decide where work is done, never what
comes out). Runs are sent packed: words that are common in the sample as two bytes, others as
places in a list that goes with the run. A range's sorted runs of all chunks meet in one task, which merges them and reads
the counts of all phrases off one pass in prefix order. Phrases that the ends of a range (or
of a part of it) may cut are handed on with their partial counts and summed by Spark. Five
words tell ranges apart, so a common word or pair spreads over many ranges, and a common
window comes as one row per chunk.

*Scoring.* Parts of a frequent phrase are frequent, so only frequent phrases go on. The count
stream is kept twice, in prefix order and in suffix order. Candidates, once for each cut, meet
the first by their first part and the second by their rest in sort-merge joins, which give the
left and right counts; the same streams of parts, grouped, give for each phrase the most
frequent phrase that is one word longer to the right or left. No longer phrase is needed: what
lies between two phrases is at least as frequent as the longer one.

Defined results: null texts are empty, a null language is ``und``; a word may hold any
character but blanks and separators; scores are computed in 38-digit decimals and are exact;
ties in score go to the larger count, then to the first phrase in byte order. Repeated rows
count each. An empty table gives no rows. A task holds the distinct windows of one range, so above
``RANGES`` ranges (64 GB of text) its memory grows with the text, and more ranges are to be asked for. A long text is worked off in chunks of bounded
size, cut between words, where a window reads on into the next chunk. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.tables import stored

WORDS = 5
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases of a language
SHARE = 100  # a candidate goes if a longer one has this many per cent of its occurrences
CHUNK = 2 << 20  # bytes of text whose windows are sorted at once
RANGE = 16 << 20  # bytes of text for each range of windows
RANGES = 4096  # ranges at most; beyond RANGES x RANGE bytes of text they grow
SAMPLE = 8 << 20  # bytes of text that borders are drawn from
DRAWN = 16  # windows of the sample for each range
MERGED = 1_000_000  # rows of a range that are held before equal ones are added up
COMMON = 30_000  # words that are sent as two bytes

_RUN = "pid int, lang string, words array<binary>, sizes binary, codes binary, rare binary, counts binary"
_RARE = 65535
_PHRASE = "lang string, phrase binary, words int, n long"
_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: blank, 2: end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _segments(text: bytes) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them hold the first byte of a window) of a text, in parts of about a chunk."""
    start = 0
    while start < len(text):
        cut = start + CHUNK
        # Cut in front of a word: after the first blank or separator from here on.
        step = 1 << 12
        while cut < len(text):
            gap = np.flatnonzero(_KIND[np.frombuffer(text[cut:cut + step], np.uint8)])
            if len(gap):
                cut += int(gap[0]) + 1
                break
            cut += step
        cut, end = min(cut, len(text)), min(cut, len(text))
        # Read on until WORDS - 1 words have ended, or the piece has.
        step = 1 << 8
        while end < len(text):
            end = min(cut + step, len(text))
            kind = _KIND[np.frombuffer(text[cut:end], np.uint8)]
            ended = np.count_nonzero((kind[1:] != 0) & (kind[:-1] == 0))
            if ended >= WORDS - 1 or (kind == 2).any():
                break
            step *= 4
        yield text[start:end], cut - start
        start = cut


def _packed(ranks: np.ndarray) -> list[np.ndarray]:
    """Columns of ranks as few 64-bit keys, first column first."""
    bits = max(int(ranks.max(initial=0)).bit_length(), 1)
    fit = max(63 // bits, 1)
    keys = []
    for at in range(0, ranks.shape[1], fit):
        key = np.zeros(len(ranks), np.int64)
        for column in ranks.T[at:at + fit]:
            key = (key << bits) | column
        keys.append(key)
    return keys


def summed(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    if not len(ranks):
        return ranks, counts
    keys = _packed(ranks)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return ranks[order[first]], np.add.reduceat(counts[order], first)


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The sorted vocabulary, and each word's rank in it from 1 on (0 stands for no word)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def windows(texts: list[tuple[bytes, int]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, distinct windows as rows of ranks in order, their counts) of lower-cased segments.

    A segment's windows start in its first bytes, as many as its number says.
    """
    data = np.frombuffer(b"\n".join(t for t, _ in texts), np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(inside, prepend=False, append=False)
    border = np.flatnonzero(edge)
    start, end = border[::2], border[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    letters = data[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    vocabulary, rank = _ranked(words)
    piece = np.cumsum(kind == 2)[start] if len(start) else np.zeros(0, np.int64)
    ranks = np.zeros((len(start), WORDS), np.int32)
    for k in range(min(WORDS, len(start))):
        same = piece[k:] == piece[:len(piece) - k]
        ranks[:len(piece) - k, k] = np.where(same, rank[k:], 0)
    # Windows that start where the next segment reads again.
    base, counted = 0, np.ones(len(start), bool)
    for text, own in texts:
        if own < len(text):
            counted[np.searchsorted(start, base + own):np.searchsorted(start, base + len(text))] = False
        base += len(text) + 1
    ranks = ranks[counted]
    return vocabulary, *summed(ranks, np.ones(len(ranks), np.int64))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
    """(language, segments) with about ``size`` bytes each; what is held is bounded over all languages."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang = lang.as_py()
            for part, own in _segments(text.as_buffer().to_pybytes().translate(_LOWER)):
                held.setdefault(lang, []).append((part, own))
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= size:
                    yield lang, held.pop(lang)
                    del sizes[lang]
            if sum(sizes.values()) >= 2 * size:
                big = max(sizes, key=sizes.get)
                yield big, held.pop(big)
                del sizes[big]
    yield from held.items()


def _at_least(vocabulary: list[bytes], ranks: np.ndarray, border: tuple[bytes, ...]) -> int:
    """How many rows come before a border."""
    low, high = 0, len(ranks)
    for k in range(WORDS):
        word = border[k] if k < len(border) else None
        if word is None:
            return low
        rank = bisect_left(vocabulary, word) + 1
        column = ranks[low:high, k]
        first = low + int(np.searchsorted(column, rank, "left"))
        if rank > len(vocabulary) or vocabulary[rank - 1] != word:
            return first
        low, high = first, low + int(np.searchsorted(column, rank, "right"))
    return low


def _runs(borders: list[tuple[str, tuple[bytes, ...]]], common: list[bytes], size: int):
    """Sorted windows of chunks, cut at the borders."""
    langs: dict[str, list[tuple[int, tuple[bytes, ...]]]] = {}
    for pid, (lang, border) in enumerate(borders):
        langs.setdefault(lang, []).append((pid, border))
    names = [lang.encode() for lang, _ in borders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(common, pa.large_binary())
        for lang, texts in _chunks(batches, size):
            vocabulary, ranks, counts = windows(texts)
            if not len(ranks):
                continue
            words = vocabulary.to_pylist()
            # 0: no word, then the place among the common words from 1 on, or _RARE.
            code = pc.fill_null(pc.add(pc.index_in(vocabulary, known), 1), _RARE).to_numpy(zero_copy_only=False)
            code = np.append(0, code).astype(np.uint16)
            first = bisect_left(names, lang.encode())
            cuts = [(first, 0)] + [(pid + 1, _at_least(words, ranks, border)) for pid, border in langs.get(lang, [])]
            for (pid, low), (_, high) in zip(cuts, [*cuts[1:], (0, len(ranks))]):
                if low < high:
                    yield _run_row(pid, lang, vocabulary, code, ranks[low:high], counts[low:high])
    return run


def _packed_bytes(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([pa.compress(np.ascontiguousarray(values).astype(kind).tobytes(), "zstd", asbytes=True)])


def _run_row(pid: int, lang: str, vocabulary: pa.Array, code: np.ndarray, ranks: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A run as codes of common words, by column, the places of rare ones in its own list of words, and counts."""
    ranks = np.ascontiguousarray(ranks.T)
    codes = code[ranks]
    used, rare = np.unique(ranks[codes == _RARE], return_inverse=True)
    words = vocabulary.take(pa.array(used - 1)).cast(pa.binary())
    sizes = np.array([len(counts), len(rare)], np.int64).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([pid], pa.int32()), pa.array([lang]),
         pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([sizes]),
         _packed_bytes(codes, "<u2"), _packed_bytes(rare, "<u4"), _packed_bytes(counts, "<i8")],
        ["pid", "lang", "words", "sizes", "codes", "rare", "counts"])


def _run_of(row: list, common: int) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """(own words, ranks, counts, ``common``) of a run; ranks above ``common`` are places among its own words."""
    words, sizes, codes, rare, counts = row
    n, others = np.frombuffer(sizes.as_buffer(), np.int64).tolist()
    codes = np.frombuffer(pa.decompress(codes.as_buffer(), n * 2 * WORDS, "zstd"), "<u2").astype(np.int32)
    codes[codes == _RARE] = common + 1 + np.frombuffer(pa.decompress(rare.as_buffer(), 4 * others, "zstd"), "<u4").astype(np.int32)
    counts = np.frombuffer(pa.decompress(counts.as_buffer(), n * 8, "zstd"), "<i8")
    return words.values, np.ascontiguousarray(codes.reshape(WORDS, n).T), counts, common


def _merged(runs: list[tuple[pa.Array, np.ndarray, np.ndarray, int]], common: pa.Array
            ) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs with words of their own, beside the common ones or (0 of them) instead, as one run."""
    vocabulary, rank = _ranked(pa.concat_arrays([common, *(r[0].cast(pa.large_binary()) for r in runs)]))
    parts, at = [], len(common)
    for words, ranks, _, shared in runs:
        own = np.concatenate([np.zeros(1, np.int32), rank[:shared], rank[at:at + len(words)]])
        parts.append(own[ranks])
        at += len(words)
    ranks, counts = summed(np.concatenate(parts), np.concatenate([r[2] for r in runs]))
    # Common words that do not occur are left out.
    there = np.zeros(len(vocabulary) + 1, bool)
    there[ranks] = True
    there[0] = False
    place = np.cumsum(there, dtype=np.int32) * there
    return vocabulary.take(pa.array(np.flatnonzero(there) - 1)), place[ranks], counts


def prefix_counts(vocabulary: pa.Array, ranks: np.ndarray, counts: np.ndarray, least: int
                  ) -> Iterator[tuple[bytes, int, int]]:
    """(phrase, words, count) of what sorted windows begin with: frequent phrases, and those at the two ends.

    The ends' phrases, the empty one among them, may go on in another range.
    """
    if not len(ranks):
        return
    yield b"", 0, int(counts.sum())
    new = np.zeros(len(ranks), bool)
    new[0] = True
    for k in range(WORDS):
        column = ranks[:, k]
        new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts, first)
        there = column[first] > 0
        wanted = there & (sums >= least)
        wanted[[0, -1]] = there[[0, -1]]
        at = np.flatnonzero(wanted)
        words = vocabulary.take(pa.array(ranks[first[at], :k + 1].ravel() - 1)).to_pylist()
        for i, n in enumerate(sums[at].tolist()):
            yield b" ".join(words[i * (k + 1):(i + 1) * (k + 1)]), k + 1, n


def _merger(common: list[bytes], least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = pa.array(common, pa.large_binary()), pa.array([], pa.large_binary())
        key, held, rows, limit = None, [], 0, MERGED

        def one() -> tuple[pa.Array, np.ndarray, np.ndarray]:
            return _merged(held, known if any(shared for *_, shared in held) else none)

        def out() -> Iterator[pa.RecordBatch]:
            found = list(prefix_counts(*one(), least))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[1]] * len(found)), pa.array([f[0] for f in found], pa.binary()),
                 pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64())],
                ["lang", "phrase", "words", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                pid, lang, *run = (batch.column(c)[row] for c in range(batch.num_columns))
                if key != (pid.as_py(), lang.as_py()):
                    if held:
                        yield from out()
                    key, held, rows, limit = (pid.as_py(), lang.as_py()), [], 0, MERGED
                held.append(_run_of(run, len(known)))
                rows += len(held[-1][2])
                if rows >= limit:  # what is distinct may double before rows are added up again
                    held = [(*one(), 0)]
                    rows = len(held[0][2])
                    limit = max(MERGED, 2 * rows)
        if held:
            yield from out()
    return merge


def _common_words(texts: DataFrame, share: float) -> list[bytes]:
    """The words that a sample of the texts has most often; they are sent as two bytes."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _chunks(batches, CHUNK):
            vocabulary, ranks, counts = windows(parts)
            if len(ranks):
                n = np.bincount(ranks[:, 0], weights=counts, minlength=len(vocabulary) + 1)[1:].astype(np.int64)
                yield pa.RecordBatch.from_arrays([vocabulary.cast(pa.binary()), pa.array(n)], ["word", "n"])

    drawn = texts.sample(share, seed=1) if share < 1 else texts
    words = drawn.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in words.orderBy(F.desc("n"), "word").limit(COMMON).collect()]


def _borders(texts: DataFrame, ranges: int, share: float) -> list[tuple[str, tuple[bytes, ...]]]:
    """At most ``ranges`` - 1 borders between windows, drawn from a sample of the texts."""
    step = max(SAMPLE // 6 // (DRAWN * ranges), 1)  # a word and its blank have about six bytes

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, parts in _chunks(batches, CHUNK):
            vocabulary, ranks, counts = windows(parts)
            ends = np.cumsum(counts)
            at = np.searchsorted(ends, np.arange(step // 2, ends[-1] if len(ends) else 0, step), "right")
            words = [[vocabulary[int(r) - 1].as_py() for r in ranks[i] if r] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(words, pa.list_(pa.binary()))],
                                             ["lang", "border"])

    drawn = texts.sample(share, seed=0) if share < 1 else texts
    # About DRAWN windows a range, and there are at most RANGES.
    rows = drawn.mapInArrow(sampled, "lang string, border array<binary>").collect()
    found = sorted((r.lang.encode(), tuple(bytes(w) for w in r.border)) for r in rows)
    cuts = dict.fromkeys(found[i * len(found) // ranges] for i in range(1, ranges)) if found else {}
    return [(lang.decode(), border) for lang, border in cuts]


def frequent_phrases(docs: DataFrame, least: int = LEAST, range_bytes: int = RANGE, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of up to five words with ``least`` occurrences or more.

    The empty phrase has the number of words of its language, whatever ``least`` says.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(-(-total // range_bytes), 1), RANGES)
    borders = _borders(texts, ranges, SAMPLE / max(total, 1)) if ranges > 1 else []
    common = _common_words(texts, SAMPLE / max(total, 1))
    runs = texts.mapInArrow(_runs(borders, common, chunk), _RUN)
    merged = (runs.repartitionById(len(borders) + 1, "pid").sortWithinPartitions("pid", "lang")
              .mapInArrow(_merger(common, least), _PHRASE))
    summed_up = merged.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return (summed_up.where((F.col("n") >= least) | (F.col("words") == 0))
            .select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, **counting) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of two words or more."""
    counts = stored(frequent_phrases(docs, least, **counting))
    totals = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    single = counts.where("words > 0").select("lang", "phrase", "words", F.col("n").alias("a"))
    split = F.split("phrase", " ")
    # Each order is stored as such, so that both sides of a merge are plain sorted tables.
    prefix_order = stored(single.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
                          .select("lang", "phrase", "a"))
    suffix_order = stored(single.withColumn("back", F.reverse(split)).repartitionByRange("lang", "back")
                          .sortWithinPartitions("lang", "back").select("lang", "phrase", "a"))
    # The language's total comes first, so that nothing later is dealt by language alone.
    cuts = stored(single.where("words > 1").join(totals, "lang").withColumn("w", split)
                  .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
                  .select("lang", "phrase", "words", "a", "n", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                          F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest")))
    left = prefix_order.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = suffix_order.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    both = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])

    def digits(column: str, most: int) -> F.Column:
        return F.col(column).cast(f"decimal({most},0)")

    # Counts stay below 10^15 and 1000 a n below 10^35; div of whole decimals is exact and floors what is positive.
    score = (F.lit(1000).cast("decimal(4,0)") * (digits("a", 15) * digits("n", 18))).cast("decimal(38,0)")
    both = both.withColumn("_over", score).withColumn("_under", digits("l", 15) * digits("r", 15))
    scored = both.withColumn("score", F.expr("_over div _under"))
    lowest = (scored.groupBy("lang", "phrase", "words", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # The most frequent phrase with one word more behind, or in front.
    longer = (cuts.where(F.col("k") == F.col("words") - 1).select("lang", F.col("first").alias("phrase"), "a")
              .union(cuts.where("k = 1").select("lang", F.col("rest").alias("phrase"), "a"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longest")))
    kept = (lowest.join(longer.hint("merge"), ["lang", "phrase"], "left")
            .where(F.col("longest").isNull() | (F.lit(100).cast("long") * F.col("longest") < share * F.col("a"))))
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                       F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
