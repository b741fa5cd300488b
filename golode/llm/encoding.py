"""Whole-text encoding by the tokenizers library, a piece at a time.

Both vocabularies cut a text into pieces before any merge, and no cut looks across white space
(but for the blanks before a word, see ``byte_pieces``). So the ids of a text are those of its
pieces in a row; ids of pieces that were seen are kept, up to a bound in bytes, and only others go
to the library. Ids are carried as little-endian unsigned 32-bit bytes. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import re
from array import array
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from golode.llm.common import Kept

#: White space as the patterns of the vocabularies mean it (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Latin-1 letters, then ASCII signs: under either pattern one piece each, without normalising.
_SIMPLE_WORD = re.compile(f"([{LETTERS}]+)([{SIGNS}]*)")
_BYTE_PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: The same, but signs after a simple word are a piece of their own, so that a word is kept once;
#: and so for UTF-8 between ASCII blanks.
_SIGNS_APART = re.compile(f" ?[{LETTERS}]++(?=[{SIGNS}]*+(?: |[{WHITE}]|\\Z))|{_BYTE_PIECES.pattern}")
_BLANK_PIECES = re.compile(
    rb"[A-Za-z\x80-\xbf\xc3]++(?<!\xc3[\x97\xb7])(?=[%b]*+(?![^\t-\r ]))|[^\t-\r ]+" % SIGNS.encode()
)
#: A blank amid white space, or after it at the end: a byte-level pattern may take it with what is before it.
_BLANK_WITHIN = re.compile(f"[{WHITE}] (?:[{WHITE}]|\\Z)")
#: Words between blanks that can't stand in a row with others, as RE2 has it.
_OUTER_WHITE = "^$|^[{0}]|[{0}]$".format(WHITE.encode().decode("unicode_escape"))
#: New words that the library gets in one text, and bytes of words and ids kept in lists.
WORDS_AT_ONCE, LIST_BYTES = 1024, 32 << 20


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell Latin-1 letters: a printable character for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {b: chr(b) for b in plain}
    spelt |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in spelt)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_SPELT = _byte_letters()


def byte_pieces(text: str) -> list[str]:
    """Pieces of a text whose ids, in a row, are those of the text under a byte-level pattern
    that lets one blank go with the word after it and leaves other white space by itself."""
    return _BYTE_PIECES.findall(text)


def signs_apart(text: str) -> list[str]:
    """The same for a pattern that takes letters and signs apart, with ASCII signs after a simple word
    as a piece of their own."""
    return _SIGNS_APART.findall(text)


def blank_pieces(text: str) -> list[bytes]:
    """Pieces between ASCII blanks, for a vocabulary that drops white space and lower-cases."""
    raw = text.encode("utf-8", "surrogatepass")
    return _BLANK_PIECES.findall(raw.lower() if text.isascii() else raw)


class Encoder:
    """encode(text) -> bytes of the ids that the library gives for the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.lower = self.library.normalizer is not None
        self.pieces = blank_pieces if self.lower else signs_apart
        # A byte-level vocabulary has pieces of their own for each case, and with and without the blank.
        self.kept = Kept(self._of_bytes) if self.lower else Kept(self._of_text, times=2)
        vocabulary = self.library.get_vocab()
        #: Which ids begin with a blank, as byte-level vocabularies spell it.
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _of_bytes(self, piece: bytes) -> bytes:
        if piece.isalpha() and piece.islower():
            return self._model(piece.decode())
        text = piece.decode("utf-8", "surrogatepass")
        simple = _SIMPLE_WORD.fullmatch(text)
        if not simple:
            return self._whole(text)
        word, signs = simple[1], simple[2]
        if signs:
            return self.kept[word.encode()] + self.kept[signs.encode()]
        low = word.lower()
        if low != word:
            return self.kept[low.encode()]
        return self._model(word if word.isascii() else word.translate(_SPELT))

    def _of_text(self, piece: str) -> bytes:
        blank = piece[0] == " "
        if piece.isascii() and (piece[1:] if blank else piece).isalpha():
            return self._model("Ġ" + piece[1:] if blank else piece)
        simple = _SIMPLE_WORD.fullmatch(piece, 1 if blank else 0)
        if not simple:
            return self._whole(piece)
        word, signs = simple[1], simple[2]
        if signs:
            return self.kept[" " + word if blank else word] + self.kept[signs]
        word = word if word.isascii() else word.translate(_SPELT)
        return self._model("Ġ" + word if blank else word)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, self.pieces(text)))

    def encode_all(self, texts: list[str], end: bytes) -> pa.ListArray:
        """The ids of each text, with the id ``end`` after them.

        A byte-level pattern cuts before a blank unless white space stands on both sides of it. So texts are
        cut at blanks, a word with the signs at it goes to the library once, in a row with others, and the ids
        are put together by number. Texts with other blanks, and what is before a first, go through ``encode``."""
        if self.lower:
            return _lists([self.encode(t) + end for t in texts])
        apart = [_BLANK_WITHIN.search(t) is not None for t in texts]
        cut = pc.split_pattern(pa.array(["" if a else t for t, a in zip(texts, apart, strict=True)], pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        words = cut.values.dictionary_encode()
        known, known_ids = self.kept.lists or (pa.array([], pa.large_string()), _lists([]))
        at = pc.index_in(words.dictionary, value_set=known)
        new = words.dictionary.filter(at.is_null())
        found = pa.concat_arrays([known_ids, self._after_blanks(new)])
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(len(known), len(found))
        heads = [self.encode(t if a else t.partition(" ")[0]) for t, a in zip(texts, apart, strict=True)]
        numbers = at[words.indices.to_numpy()]
        numbers[bounds[:-1]] = np.arange(len(found), len(found) + len(heads))
        numbers = np.insert(numbers, bounds[1:], len(found) + len(heads))
        if known.nbytes + known_ids.nbytes < LIST_BYTES:
            self.kept.lists = pa.concat_arrays([known, new]), found
        else:  # only the words of these texts stay
            self.kept.lists = words.dictionary, found.take(pa.array(at))
        ids = pa.concat_arrays([found, _lists([*heads, end])]).take(pa.array(numbers))
        # Each text has one number more than words.
        starts = ids.offsets.to_numpy()[bounds + np.arange(len(bounds))]
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), ids.values)

    def _after_blanks(self, words: pa.LargeStringArray) -> pa.ListArray:
        """The ids of each word with a blank before it."""
        odd = pc.match_substring_regex(words, _OUTER_WHITE)
        plain = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.filter(pc.invert(odd)), pa.scalar(" ", pa.large_string()))
        found, ends = [_lists([self.encode(f" {w}") for w in words.filter(odd).to_pylist()])], 0
        for i in range(0, len(plain), WORDS_AT_ONCE):
            some = plain.slice(i, WORDS_AT_ONCE)
            a, b = np.frombuffer(some.buffers()[1], np.int64)[[some.offset, some.offset + len(some)]].tolist()
            text = some.buffers()[2][a:b].to_pybytes().decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            starts = np.append(np.flatnonzero(self.blank[ids]), len(ids))
            if len(starts) != len(some) + 1:
                raise ValueError("a word's ids begin with one blank")
            found.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        order = np.empty(len(words), np.int64)
        order[odd], order[~odd] = np.arange(odd.sum()), np.arange(odd.sum(), len(words))
        return pa.concat_arrays(found).take(pa.array(order))


def _lists(held: list[bytes]) -> pa.ListArray:
    offsets = np.fromiter(accumulate(map(len, held), initial=0), np.int64, len(held) + 1) >> 2
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(held), "<i4")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The process's encoder for a vocabulary file of public_tokenizers, or for a path; what the
    process kept for other operators is forgotten."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    _ENCODERS[name].kept.own()
    return _ENCODERS[name]
