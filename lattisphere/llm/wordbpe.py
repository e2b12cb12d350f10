"""Words of whole Arrow columns for a BPE vocabulary whose normaliser lower-cases and drops white space.

A text in Latin-1 is split as the pre-tokenizer's own pattern does, by the kinds of all its bytes at once; any other text, and
one that holds a special token's string, is cut at ASCII white space only, where neither normaliser nor pattern looks across, and the
tokenizers library does the rest. Either way the ids of a text are the ids of its pieces, one after another.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import buffer_of

# The pattern of the vocabulary's pre-tokenizer, for texts in Latin-1 (letters, digits, white space of U+0000 to U+00FF).
LETTERS, DIGITS, SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \u0085 "
PATTERN = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+)"
COARSE = re.compile("[^ \t-\r]+")
#: What marks a piece as a coarse one; no piece of the pattern holds it.
MARK = " "


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + n) for n, b in enumerate(rest)}}


def _kinds() -> np.ndarray:
    """The kind of each character of Latin-1, lower-cased: 0 white space, 1 letter, 2 digit, 3 other."""
    kinds = np.full(256, 3, np.uint8)
    for kind, own in enumerate((SPACES, LETTERS, DIGITS)):
        kinds[[k for k in range(256) if re.match(f"[{own}]", chr(k))]] = kind
    return kinds


_KINDS = _kinds()


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PATTERN's matches in lower-cased texts of Latin-1: which bytes are in one, at which one begins, and their number in each text."""
    n = len(data)
    kinds = np.frombuffer(bytearray(data).translate(_KINDS.tobytes()), np.uint8)
    leads = np.flatnonzero(data >= 0xC2)  # two bytes each
    kinds[leads] = kinds[leads + 1] = _KINDS[((data[leads] & 3) << 6) | (data[leads + 1] & 0x3F)]
    solid = kinds != 0
    begins = np.ones(n, bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = True
    digits = np.flatnonzero(kinds == 2)  # each is a piece
    begins[digits[(data[digits] & 0xC0) != 0x80]] = True
    begins &= solid
    marks = np.flatnonzero((data[:-1] == ord("'")) & (kinds[1:] == 1) & begins[:-1])  # an apostrophe between a piece's end and a letter
    if len(marks):
        ends = offsets[np.searchsorted(offsets, marks, "right")]
        one, two = data[marks + 1], data[np.minimum(marks + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (marks + 1 < ends)
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (marks + 2 < ends)
        begins[marks[short | long] + 1] = False
        after = np.concatenate([marks[short] + 2, marks[long] + 3])
        after = after[after < n]
        begins[after] = solid[after]
    return solid, begins, np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


class WordCoder:
    """Ids of single pieces, by the tokenizers library."""

    def __init__(self, path: str, held: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters, self.held = self.tokenizer.model, byte_letters(), held
        self.known: dict[str, tuple[pa.Array, pa.Array]] = {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, piece: str) -> list[int]:
        if piece.startswith(MARK):
            return self.tokenizer.encode(piece[1:], add_special_tokens=False).ids
        if piece.isascii() and piece.isprintable():  # every byte stands for itself; a piece holds no space
            return [t.id for t in self.model.tokenize(piece)]
        letters = self.letters
        return [t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode()]))]

    def coded(self, pieces: pa.Array, kind: str) -> pa.Array:
        """The ids of each distinct piece as bytes of that kind (an array's type code).

        Pieces stay known, as Arrow columns, until there are `held` of them; then only the last ones asked for do."""
        words, values = self.known.get(kind, (pa.array([], pa.large_string()), pa.array([], pa.large_binary())))
        at = pc.index_in(pieces, value_set=words)
        if at.null_count:
            ids, ends = array(kind), [0]
            for p in pieces.filter(at.is_null()).to_pylist():
                ids.extend(self.encode(p))
                ends.append(len(ids) * ids.itemsize)
            fresh = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            at = pc.fill_null(at, 0).to_numpy().copy()
            at[fresh] = np.arange(len(words), len(words) + len(fresh))
            words = pa.concat_arrays([words, pieces.take(pa.array(fresh))])
            values = pa.concat_arrays([values, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(fresh), [None, pa.py_buffer(np.array(ends, np.int64)), pa.py_buffer(ids.tobytes())])])
        own = values.take(pa.array(at))
        self.known[kind] = (words, values) if len(words) <= self.held else (pieces, own)
        return own

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, dictionary-encoded, and the number of pieces of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, offsets = buffer_of(texts)
        odd = np.zeros(len(texts), bool)
        if data.max(initial=0) >= 0xC4:  # U+0100 and above begin with C4 or more
            wide = np.concatenate([[0], np.cumsum(data >= 0xC4)])
            odd = wide[offsets[1:]] > wide[offsets[:-1]]
        whole = data.tobytes()
        for s in (*self.specials, "\u0085", " "):
            if s.encode() in whole:
                odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        data, offsets = buffer_of(pc.utf8_lower(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts))
        solid, begins, counts = pieces_of(data, offsets)
        ends = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid))
        pieces = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data[solid]))
        if odd.any():
            pieces, counts = self._with_coarse(texts, odd, pieces, counts)
        return pieces.dictionary_encode(), counts

    @staticmethod
    def _with_coarse(texts, odd, pieces, counts):
        parts, starts, new = [], np.cumsum(counts) - counts, counts.copy()
        last = 0
        for k in np.flatnonzero(odd):
            words = [MARK + w for w in COARSE.findall(texts[int(k)].as_py())]
            parts += [pieces.slice(last, starts[k] - last), pa.array(words, pieces.type)]
            last, new[k] = starts[k], len(words)
        return pa.chunked_array([*parts, pieces.slice(last)]).combine_chunks(), new


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder for each vocabulary file and worker."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def joined(values: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of values[code] for all codes, one after another, and their offsets."""
    return buffer_of(values.take(codes))
