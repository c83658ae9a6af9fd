"""Small awkward tables shared by the tests of the operators."""

import random

# Names that operators use inside; as further columns of the input they must not matter.
CLASHING = ["size", "key", "score", "row", "end", "band", "node", "label", "words", "tie", "first", "found", "print",
            "h", "o", "p", "x", "number", "block", "host", "path", "_row", "_nth", "_part", "copies", "shard", "record", "_quality_score", "doc", "any", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ne", "ru", "ta", "vé", "sö"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + 11]) + "." for i in range(0, n, 11))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empties, ties, repeated rows, copies, near copies, shared passages, a long text."""
    base, passage = prose(1, 160), prose(77, 60)
    near = base.split(" ")
    near[20] = "changed"
    rows = [
        (1, base, "a"), (2, base, "b"), (3, " ".join(near), "a"), (4, None, "a"), (5, "", None), (6, " \n ", "b"),
        (7, "one two", "a"), (8, "one two", "c"), (9, prose(2, 90) + " " + passage + " " + prose(3, 90), "a"),
        (10, prose(4, 90) + " " + passage + " " + prose(5, 90), None), (11, "Ha " * 400, "b"), (12, "!!##" * 300, "a"),
        (13, prose(6, 9000), "a"), (14, "ÄÖ\0 \t x", "c"), (15, prose(8, 200), "zero"), (15, prose(8, 200), "zero"),
        (None, prose(9, 120), "a"), (None, None, None), (16, "é" * 300, "b"), (17, "café  de\r\nflore", "c"),
        (2**60 + 1, prose(10, 130), "b"), (-5, prose(11, 130), "b"), (18, "a b c d e", "a"), (19, "a b c d e f", "a"),
    ]
    return rows + [(100 + i, prose(50 + i, 60 + 13 * i), "abc"[i % 3]) for i in range(30)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", s, None if t is None else len(t), *["z"] * len(CLASHING)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def plain(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
