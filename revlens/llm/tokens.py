"""Token ids of whole texts through the tokenizers library.

Both tokenizers split a text at white space before they merge characters, so the ids
of a text are those of its pieces in a row, where a piece is what lies between single
spaces. Pieces repeat a great deal; each is encoded once per worker and kept. A text
in which white space meets white space, or any that is not known to be split there,
is encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

KEPT = 500_000  # pieces in the young half of a worker's cache, about 150 bytes each
# Letters whose case, composition and class are the same for Python and the tokenizers.
_LETTERS = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$%&#\"()]{0,3})")


class _Uncut(Exception):
    """The text cannot be cut at its single spaces."""


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stay, others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """Piece -> ids as little-endian unsigned integers of ``width`` bytes; ``ids(text)`` for whole texts.

    ``width`` is 2 where the vocabulary allows it, else 4.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.kept, self.old = Tokenizer.from_file(path), kept, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, kind = spec.get("pre_tokenizer") or {}, spec["model"]["type"]
        steps = split.get("pretokenizers", [split])
        self.leads = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        drops = (len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed"
                 and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and steps[0]["invert"])
        # What happens to a text before it is split; with any other file texts are encoded whole.
        normal = spec.get("normalizer")
        folds = [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.cut = kind == "BPE" and (self.leads and normal is None or drops and folds) and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.lower, self.letters = not self.leads, _byte_letters()
        self.model, self.marks = self.tokenizer.model, {}  # marks: runs of a few signs
        known = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if known <= 1 << 16 else 4
        self.coded = [i.to_bytes(self.width, "little") for i in range(known)]

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join([self.coded[i] for i in ids])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, part: str) -> bytes:
        if self.lower:
            part = part.lower()
        mapped = (part.replace(" ", self.letters[0x20]) if part.isascii() else
                  part.encode().decode("latin-1").translate(self.letters))
        return self._packed([t.id for t in self.model.tokenize(mapped)])

    def _piece(self, piece: str) -> bytes:
        plain = _LETTERS.fullmatch(piece)
        if plain is not None and (self.leads or not plain[1]):
            # A word and the marks behind it are merged apart, and either is met again.
            marks = plain[3]
            if not marks:
                return self._model(piece)
            if marks not in self.marks:
                self.marks[marks] = self._model(marks)
            return self[piece[:-len(marks)]] + self.marks[marks]
        core = piece[1:] if self.leads and piece[:1] == " " else piece
        if self.leads and piece == "\n":
            return self._whole(piece)
        if not core and not self.leads:
            return b""
        if not core or core[0].isspace() or core[-1].isspace() or "\u180e" in core:
            raise _Uncut
        return self._whole(piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._piece(piece)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut or "\0" in text:
            return self._whole(text)
        if self.leads:
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        else:
            pieces = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.__getitem__, pieces))
        except _Uncut:
            return self._whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def numbers(ids: bytes, width: int) -> np.ndarray:
    """Coded ids as unsigned 32-bit integers."""
    return np.frombuffer(ids, f"<u{width}").astype("<u4", copy=False)
