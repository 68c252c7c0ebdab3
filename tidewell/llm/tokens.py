"""Token ids as bytes, with a bounded cache of text units in front of a ``tokenizers`` file.

A text is cut only at places where no token of the two supported pre-tokenizers can reach
across. First at single blanks; the ids of most pieces are known by then, and a word of
letters is given to the library's model as it is. Other pieces are cut further: before ASCII
white space that follows a non-space, and between letters or digits and the marks ``.,!?;:``.
Each such unit is encoded by the library. Texts with doubled or outer blanks are cut by units
alone; units with other kinds of white space send their whole text to the library. Caches
are bounded in entries, each of which is short.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_LETTERS = "A-Za-z0-9À-ÖØ-öø-ÿ"
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_WS = " \\t\\n\\r\\f\\v"
#: White space belongs to the unit that it precedes (byte-level vocabularies keep it).
_KEEPING = re.compile(f"[{_WS}]*+[{_LETTERS}]++(?=[.,!?;:{_WS}]|\\Z)|[{_WS}]*+[^{_WS}]+|[{_WS}]+\\Z")
#: White space separates and is dropped.
_DROPPING = re.compile(f"[{_LETTERS}]++(?=[.,!?;:{_WS}]|\\Z)|[^{_WS}]+")
#: Of Latin-1 alone.
_LATIN = re.compile("[\\0-\xff]*").fullmatch
_CUT = re.compile(f"(?<=[^{_WS}])[{_WS}]")
#: The byte-level signs of all bytes: what prints stands for itself.
_SIGNS = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
_SIGNS |= {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in _SIGNS)}


class _Cache(dict):
    """Two generations of ids by text: a full one becomes the old one, from which what is still in use is taken over.

    ``find`` gives the ids of what neither knows. Only short texts are kept.
    """

    def __init__(self, find: Callable[[str], bytes], most: int, longest: int = 48):
        self.find, self.most, self.longest = find, most, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.find(text)
        if len(text) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class _Odd(Exception):
    """A piece that isn't to be cut out of its text."""


class UnitTokenizer:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers, the end id behind them.

    ``long_chars``: longer texts are read in segments of about half of it.
    """

    def __init__(self, path: str, end_id: int | None = None, cache_units: int = 500_000, long_chars: int = 1 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.folds = self.tokenizer.normalizer is not None
        self.model = self.tokenizer.model
        self.cut = (_DROPPING if self.folds else _KEEPING).findall
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.long_chars = long_chars
        self.units = _Cache(self._unit, cache_units // 4)
        self.pieces = _Cache(self._piece, cache_units)
        self.marks = {m: self._ids(m) for m in ".,!?;:"}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of Latin-1 letters behind a blank, which the model can be given as they are."""
        if self.folds:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(word if self.folds else "\u0120" + word)]).tobytes()  # the sign of a blank

    def _unit(self, unit: str) -> bytes:
        if (not unit.isascii() or min(unit) < " ") and _ODD.search(unit):
            raise _Odd
        return self._ids(unit)

    def _of_units(self, text: str) -> bytes:
        """Ids by units. Where the tokenizer folds case anyway, Latin-1 texts are folded first: fewer different units."""
        if self.folds and "<|" not in text and _LATIN(text):
            text = text.lower()
        return b"".join(map(self.units.__getitem__, self.cut(text)))

    def _piece(self, piece: str) -> bytes:
        """Ids of what stands between two blanks, the one before it included."""
        if piece.isalpha() and _LATIN(piece):
            return self._word(piece)
        mark = self.marks.get(piece[-1:])
        if mark and (word := piece[:-1]).isalpha() and _LATIN(word):
            return self.pieces[word] + mark
        if self.folds:
            return self._of_units(piece)
        if not piece or piece[-1].isspace():  # a blank next to other white space belongs to it
            raise _Odd
        return self._of_units(" " + piece)

    def _by_units(self, text: str) -> bytes:
        try:
            return self._of_units(text)
        except _Odd:
            return self._ids(text)

    def _known_piece(self, piece: str) -> bytes | None:
        try:
            return self.pieces[piece]
        except _Odd:
            return None

    def _short(self, texts: list[str]) -> list[bytes]:
        """By pieces: Arrow splits the texts and numbers the different pieces, so that Python sees each once."""
        if self.folds:  # Latin-1 texts at once: fewer different pieces
            texts = [t.lower() if "<|" not in t and (t.isascii() or _LATIN(t)) else t for t in texts]
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        numbered = lists.flatten().dictionary_encode()
        index, pieces = numbered.indices.to_numpy(zero_copy_only=False).copy(), numbered.dictionary.to_pylist()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        starts = np.r_[0, ends[:-1]]
        first, inverse = np.unique(index[starts], return_inverse=True)  # a text's first piece has no blank before it
        try:
            ids: list[bytes | None] = list(map(self.pieces.__getitem__, pieces))
        except _Odd:
            ids = list(map(self._known_piece, pieces))
        for k in first.tolist():
            try:
                ids.append(self._of_units(pieces[k]))
            except _Odd:
                ids.append(None)
        index[starts] = inverse + len(pieces)
        odd = np.zeros(0, np.int64)
        if None in ids:
            none = np.array([x is None for x in ids])
            odd = np.nonzero(np.logical_or.reduceat(none[index], starts))[0]
            ids = [x or b"" for x in ids]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        raw = memoryview(table.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False)).cast("B")
        ends = (4 * np.cumsum(np.add.reduceat(size[index], starts))).tolist()
        out = [bytes(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for k in odd.tolist():
            out[k] = self._by_units(texts[k])
        return out

    def _segments(self, text: str):
        """Bounded segments of a very long text, cut before white space that follows a non-space."""
        at = 0
        while len(text) - at > self.long_chars:
            cut = _CUT.search(text, at + self.long_chars // 2)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _long(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._ids(text)
        return b"".join(map(self._by_units, self._segments(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        short = [t for t in texts if len(t) <= self.long_chars]
        done = iter(self._short(short) if short else ())
        return [(next(done) if len(t) <= self.long_chars else self._long(t)) + self.end for t in texts]


_known: dict[tuple, UnitTokenizer] = {}


def tokenizer(path: str, end_id: int | None = None) -> UnitTokenizer:
    """One per worker process, kept across tasks."""
    if (path, end_id) not in _known:
        _known[path, end_id] = UnitTokenizer(path, end_id)
    return _known[path, end_id]


def by_bytes(texts: list[str], most: int = 1 << 22):
    """Ranges of ``texts`` of about ``most`` characters, so that a batch of long texts stays small in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
