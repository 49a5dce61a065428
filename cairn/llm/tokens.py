"""Token ids of whole texts from a public tokenizer file, with each distinct word encoded once.

The tokenizer (``word_bpe_49k.json``: NFC, white space dropped, lower case, letter runs apart
from punctuation) never joins anything across white space, so a text's ids are those of its
words, one after another.  A word made of Latin letters and ASCII punctuation is further cut at
the border between the two, which the tokenizer always cuts, and its lower-cased letters go to
the library's model; any other word goes to the library's full ``encode``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
# str.split() cuts at these control characters, the tokenizer does not
_ODD = re.compile("[\x1c-\x1f]")
# texts with these, or with what may be a special token's string, are not cut by Arrow
_UNSAFE = "[\x1c-\x1f]|<\\|"
_BORDER = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
# words longer than this are encoded each time they occur
LONGEST_KEPT = 64
# bytes of text that are worked on at once, but one text at least
PART_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, every other byte for the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return out


class _Words(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes.

    Words live in two generations: a full young one becomes the old one, and what is met again
    moves back, so frequent words stay known and memory is bounded.
    """

    def __init__(self, path: str, most: int):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most, self.alphabet = self.tokenizer.model, most, _byte_alphabet()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST_KEPT:
            return self.slow(word)
        got = self.old.get(word)
        if got is None:
            m = _WORD.fullmatch(word)
            if m is None:
                got = self.slow(word)
            elif m[1] and m[2]:
                return self[m[1]] + self[m[2]]
            elif m[1] and (low := word.lower()) != word:
                got = self[low]
            else:
                shown = word if word.isascii() else "".join([self.alphabet[b] for b in word.encode()])
                got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def slow(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])


_LOADED: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """``ids(text)``: the ids of a whole text as little-endian unsigned 32-bit bytes.

    Kept per Python worker, so that words met in one task are known to the next; the kept
    words are bounded by ``most`` in each generation.
    """

    def __init__(self, path: str, most: int = 200_000):
        self.words = _Words(path, most)
        self._get = self.words.__getitem__

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self.words.slow(text)
        return b"".join(map(self._get, text.split()))

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, int, bytes, list[int]]]:
        """Ids of a whole column, some rows at a time: (first row, last row + 1, all their ids as
        little-endian unsigned 32-bit bytes, byte offset of each row's ids and of the end).

        Words are numbered by Arrow, so that each is looked up once per part of the column.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + PART_BYTES, side="right")))
            yield at, end, *self._part(texts.slice(at, end - at))
            at = end

    def _part(self, texts: pa.Array) -> tuple[bytes, list[int]]:
        odd = pc.match_substring_regex(texts, _UNSAFE)
        plain = pc.if_else(odd, "", texts)
        # letters and the punctuation after them become words of their own
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, _BORDER, r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        known = [self._get(w) if w else b"" for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        first = np.cumsum(sizes) - sizes
        word = np.asarray(coded.indices)
        n = sizes[word]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(first[word] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        places = (4 * upto[np.asarray(lists.offsets) - lists.offsets[0].as_py()]).tolist()
        if pc.any(odd).as_py():
            own = [self.ids(t) if o else ids[x:y] for t, o, x, y in
                   zip(texts.to_pylist(), odd.to_pylist(), places, places[1:])]
            return b"".join(own), [0, *np.cumsum([len(i) for i in own]).tolist()]
        return ids, places
