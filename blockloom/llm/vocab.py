"""Token ids by a public tokenizer file, with bounded caches of words.

A text is cut at ASCII white space, across which this tokenizer never merges; the ids of a
word depend on the word alone, so they are kept in a cache of bounded size. The result
equals that of ``tokenizers`` on the whole text."""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import single_thread

VOCAB = "word_bpe_49k.json"
END_ID = 2
CACHE_WORDS = 300_000  # in lower case, without marks
CACHE_PIECES = 250_000  # words as they stand, of those that the tables don't settle
CACHE_KEY = 64  # longer words aren't kept, so that the cache is bounded in bytes as well


class Cache(dict):
    """A dict that fills itself with ``make(key)``. When full, its content becomes the
    older generation, from which keys in use come back. Keys of over CACHE_KEY characters
    are made anew each time, so memory is bounded by 2 * limit short keys."""

    def __init__(self, make, limit: int = CACHE_PIECES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_KEY:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the
    others as the letters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


def vocabulary_path(name: str) -> str:
    """A file by its path, or by its name among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


# What a byte, or a character of two bytes, is to the file's own splitting pattern.
LETTER, NUMBER, MARK, OTHER = range(4)  # OTHER: left to the tokenizer as a whole
WIDE = 0x130  # characters below, from U+00A1 on, are plain: lower case and normal form keep their length


class Encoder:
    """Ids of texts: bytes of little-endian unsigned ids, ``width`` bytes each.

    A batch of texts is taken apart twice: into pieces between white space, then its
    different pieces into words in lower case. Ids of its different words are put together
    again by gathers, so Python sees a word once for each batch."""

    def __init__(self, name: str):
        single_thread()
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary_path(name))
        self.width = 2 if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        kind = f"<u{self.width}"
        letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        model = self.whole.model

        def raw(ids: list[int]) -> bytes:
            return np.array(ids, kind).tobytes()

        pack = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(32)]

        def of_word(w: str) -> bytes:
            # Byte letters of ASCII are the characters themselves.
            ids = [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin1").translate(letters))]
            return pack[len(ids)](*ids) if len(ids) < len(pack) else raw(ids)

        # The file's own splitting pattern, for text in which lower case and normal form
        # are plain (ASCII, Latin-1 and part of Latin Extended-A).
        plain = re.compile(r"[!-~¡-į]*\Z").match
        split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        inner = self.words = Cache(of_word, CACHE_WORDS)

        def of_piece(p: str) -> bytes:
            if "<|" in p or not plain(p):
                return raw(self.whole.encode(p, add_special_tokens=False).ids)
            return b"".join([inner[w] for w in split(p.lower())])

        self.pieces = Cache(of_piece, CACHE_PIECES)
        self.end = raw([END_ID])
        # The same rules in tables, by byte and by character of two bytes. Contractions
        # depend on what follows, so pieces with an apostrophe go by the pattern.
        shown = [c for c in map(chr, range(WIDE)) if plain(c) and c != "'"]
        of = {c: LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else MARK for c in shown}
        self._kinds = np.array([of.get(chr(c), OTHER) for c in range(WIDE)], np.uint8)
        self._lower = np.array([ord(chr(c).lower()) if chr(c) in of else c for c in range(WIDE)], np.uint16)
        self._byte_kinds = np.where(np.arange(256) < 128, self._kinds[:256], OTHER).astype(np.uint8)
        self._byte_lower = np.where(np.arange(256) < 128, self._lower[:256], np.arange(256)).astype(np.uint8)

    def ids(self, text: str | None) -> bytes:
        return self.documents(pa.array([text], pa.string()))[0].as_py()[: -self.width]

    def documents(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Ids of each text, with the end id after them; a null text has that alone."""
        if not len(texts):
            return pa.array([], pa.binary())
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = parts.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        by_piece, order = self._of_pieces(pieces.dictionary)
        at = np.insert(order[pieces.indices.to_numpy()], ends, len(by_piece))
        ids = pa.concat_arrays([by_piece, pa.array([self.end], pa.binary())]).take(pa.array(at))
        edge = np.append(0, ends + np.arange(1, len(texts) + 1))
        return _joined(ids, edge)

    def _of_pieces(self, pieces: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """Ids of different pieces, and where in these each piece has its own."""
        pieces.validate(full=True)
        edge, data = _buffers(pieces)
        kinds = self._byte_kinds[data]
        wide = np.flatnonzero((data >= 0xC2) & (data <= 0xC4))
        char = (data[wide].astype(np.uint16) & 31) << 6 | data[wide + 1] & 63
        seen = char < WIDE
        wide, char = wide[seen], char[seen]
        kinds[wide] = kinds[wide + 1] = self._kinds[char]
        begins = np.zeros(len(data) + 1, bool)
        begins[edge] = True
        other = kinds == OTHER
        other[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|")) & ~begins[1:-1]
        if other.any():
            odd = np.zeros(len(pieces), bool)
            # The piece that holds a byte: the last that begins there or before (those
            # before it at the same place are empty).
            odd[np.searchsorted(edge, np.flatnonzero(other), "right") - 1] = True
            rest = pieces.filter(pa.array(odd)).to_pylist()
            by_piece, _ = self._of_pieces(pieces.filter(pa.array(~odd)))
            order = np.empty(len(pieces), np.int32)
            order[~odd], order[odd] = np.arange(len(by_piece)), len(by_piece) + np.arange(len(rest))
            return pa.concat_arrays([by_piece, pa.array([self.pieces[p] for p in rest], pa.binary())]), order
        # A word begins with a piece, where the kind changes, and at every number.
        changes = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        changes[wide] = False  # the second byte of a character
        begins[1:-1] |= changes
        cuts = np.flatnonzero(begins).astype(np.int32)
        low, lower = self._byte_lower[data], self._lower[char]
        low[wide], low[wide + 1] = 0xC0 | lower >> 6, 0x80 | lower & 63
        words = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(low)).dictionary_encode()
        get = self.words
        ids = pa.array([get[w] for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.binary()).take(words.indices)
        return _joined(ids, np.searchsorted(cuts, edge)), np.arange(len(pieces), dtype=np.int32)


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0 on, and bytes of an array without nulls."""
    _, offsets, data = values.buffers()
    edge = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return edge - edge[0], data[edge[0] : edge[-1]]


def _joined(values: pa.BinaryArray, edge: np.ndarray) -> pa.BinaryArray:
    """The values from each edge to the next, one after the other, as one."""
    offsets, data = _buffers(values)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(offsets[edge].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


@functools.cache
def encoder(name: str = VOCAB) -> Encoder:
    """One for each Python worker."""
    return Encoder(name)
