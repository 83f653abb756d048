"""Token ids by public tokenizer files, exactly those of the tokenizers library, and quickly.

Both kinds of tokenizer split a text by a fixed pattern before merging, and merge each piece
for itself. Texts of common scripts are therefore split here, every distinct piece is encoded by the
library, and a bounded cache keeps the ids of pieces between texts. The word kind splits by the
tokenizer's pattern; the byte kind before every run of white space, where that pattern always has a border
(none of its alternatives goes on from other characters into white space), which gives fewer and larger pieces. Any other text (rare scripts, combining marks, unusual white space, strings of special tokens)
goes to the library whole. Ids are those of the library's own default: the string of a special token in a text becomes
that token. With ``special_as_text`` such strings are ordinary text instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

# fixed values: the word tokenizer file's own split pattern
_PIECES = {
    "byte": r"\s*\S+|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
}
_WHITE = frozenset(" \t\n\x0b\x0c\r")
_MARKS = ".,;:!?"
#: pieces a cache may hold; the word kind's are cheap to encode again and each executor core keeps a cache
_MOST = {"byte": 1_000_000, "word": 690_000}
#: any character outside these is left to the library: here letters, digits and spaces are beyond doubt
_ODD = {
    "byte": re.compile("[^\t-\r\x20-\x7e\xa1-ɏА-я‐-‧‰-⁞ぁ-ゔァ-ヺ一-龥]"),
    "word": re.compile("[^\t-\r\x20-\x7e\xa1-įı-ž]"),
}


class Ids:
    """Texts -> their ids as little-endian unsigned bytes of the given numpy type."""

    def __init__(self, path: str, kind: str, dtype: str = "<u4", most: int | None = None, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        # Python's own patterns are faster where no classes of letters are asked for
        pattern = re if kind == "byte" else regex
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = [x.content.lower() for x in self.library.get_added_tokens_decoder().values()]
        self.kind, self.dtype, self.most, self.known, self.stems = kind, dtype, most or _MOST[kind], {}, {}
        if kind == "byte":  # its tokens have one character for each byte
            self.n_bytes = np.zeros(max(self.library.get_vocab().values()) + 1, np.int64)
            for token, i in self.library.get_vocab().items():
                self.n_bytes[i] = len(token)
            self.marks = dict(zip(_MARKS, self._whole(list(_MARKS)), strict=True))
        self.pieces, self.odd = pattern.compile(_PIECES[kind]).findall, _ODD[kind].search

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _words(self, new: list[str], at_once: int = 4000) -> Iterator[tuple[str, bytes]]:
        """Ids of distinct pieces of the word kind: many in one call, apart by a space, which it drops."""
        for a in range(0, len(new), at_once):
            part = new[a : a + at_once]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids, words = np.array(found.ids, self.dtype), np.array(found.word_ids)
            if words[-1] != len(part) - 1:
                yield from zip(part, self._whole(part), strict=True)
                continue
            ends = (np.searchsorted(words, np.arange(len(part)), "right") * ids.itemsize).tolist()
            raw = ids.tobytes()
            yield from zip(part, (raw[x:y] for x, y in zip([0, *ends], ends, strict=False)), strict=True)

    def _runs(self, new: list[str], at_once: int = 64) -> Iterator[tuple[str, bytes]]:
        """Ids of distinct pieces of the byte kind: many in one call as they are; an id stands for a known number of bytes, which tells pieces apart."""
        # what opens a text has no white space before it, what closes one may have nothing after it
        alone, rest = [], []
        for x in new:
            (alone if x[0] not in _WHITE or x[-1] in _WHITE else rest).append(x)
        yield from zip(alone, self._whole(alone), strict=True)
        if not rest:
            return
        texts = ["".join(rest[a : a + at_once]) for a in range(0, len(rest), at_once)]
        parts = [np.array(x.ids, self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(parts)
        own = np.cumsum(np.fromiter(map(len, map(str.encode, rest)), np.int64, len(rest)))
        reached = np.cumsum(self.n_bytes[ids])
        ends = np.searchsorted(reached, own)
        if reached[-1] != own[-1] or (reached[ends] != own).any():
            yield from zip(rest, self._whole(rest), strict=True)
            return
        ends = ((ends + 1) * ids.itemsize).tolist()
        raw = ids.tobytes()
        yield from zip(rest, (raw[x:y] for x, y in zip([0, *ends], ends, strict=False)), strict=True)

    def _with_marks(self, new: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces of the byte kind. A mark between a letter and white space stands for itself, so the piece's ids are those without it and its own."""
        marked, plain = [], {}
        for x in new:
            if x[-1] in _MARKS and x[-2:-1].isalpha():
                marked.append(x)
                plain[x[:-1]] = None
            else:
                plain[x] = None
        known = self.known
        self.stems = dict(self._runs([x for x in plain if x not in known])) if plain else plain
        fresh = dict(self.stems)
        for x in marked:
            stem = x[:-1]
            fresh[x] = (fresh[stem] if stem in fresh else known[stem]) + self.marks[x[-1]]
        return fresh

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out, late, new = [], [], {}
        get = self.known.get
        for k, text in enumerate(texts):
            if not text:
                out.append(b"")
                continue
            low = text.lower()
            if self.odd(text) or any(x in low for x in self.special):
                out.append(self._whole([text])[0])
                continue
            found = self.pieces(low if self.kind == "word" else text)
            ids = list(map(get, found))
            if None in ids:
                at = [i for i, x in enumerate(ids) if x is None]
                names = [found[i] for i in at]
                new.update(dict.fromkeys(names))
                late.append((k, at, names))
                out.append(ids)
            else:
                out.append(b"".join(ids))
        fresh = dict(self._words(list(new))) if self.kind == "word" else self._with_marks(new)
        for k, at, names in late:
            ids = out[k]
            for i, x in zip(at, names, strict=True):
                ids[i] = fresh[x]
            out[k] = b"".join(ids)
        if len(self.known) <= self.most:  # full: what came early is what comes often
            self.known.update(fresh if self.kind == "word" or len(self.known) <= self.most // 2 else self.stems)
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def in_groups(column: Iterable, most: int = 128, most_chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """An Arrow text column in lists of bounded size."""
    group, size = [], 0
    for x in column:
        text = x.as_py()
        group.append(text)
        size += len(text or "")
        if len(group) >= most or size >= most_chars:
            yield group
            group, size = [], 0
    if group:
        yield group


_OPEN: dict[tuple[str, str, str], Ids] = {}


def encoder(path: str, kind: str, dtype: str = "<u4") -> Ids:
    """One encoder for each Python worker; ``kind`` is "byte" (white space is kept) or "word" (it is dropped)."""
    if (path, kind, dtype) not in _OPEN:
        _OPEN[path, kind, dtype] = Ids(path, kind, dtype)
    return _OPEN[path, kind, dtype]


def narrowest(path: str) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
