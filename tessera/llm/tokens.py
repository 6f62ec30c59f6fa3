"""Whole-text encoding with a public vocabulary file, one call of the library per many new words.

The vocabulary's normaliser and pre-tokeniser never join characters across a space, tab, line
feed or carriage return, so a text's ids are the ids of its pieces between those four
characters, in order. Within a piece, letters never join with ASCII punctuation around them
(apostrophes, which may start a contraction, are left alone), so a piece such as ``(Word).`` is
the ids of ``(``, ``word`` and ``).``. Corpora repeat their words: each worker keeps the bytes of
the ids of the lower-case words it has met, and of pieces that are no such words, and encodes new
words many at a time, joined by spaces; the id that ends a word tells them apart again. The memory
is bounded by twice ``CACHE_WORDS`` entries of at most ``CACHE_CHARS`` bytes, some forty bytes each;
beyond that, they are simply encoded again.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import trim

#: Entries and word length that a worker remembers; a bound on memory, without effect on results.
CACHE_WORDS = 800_000
CACHE_CHARS = 48

#: A word of letters whose lower case depends on the letter alone, between ASCII punctuation but for the apostrophe.
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_SHAPE = f"^(?P<before>{_MARKS})(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)(?P<after>{_MARKS})$"
_encoders: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Words and the bytes of their ids in two Arrow arrays: a word costs its letters, its ids and two offsets."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def ids_of(self, asked: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of different words; those that the table hasn't got are learnt, and kept if they are short."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        at = pc.index_in(asked, value_set=self.words)
        if not at.null_count:
            return self.ids.take(at)
        new = asked.filter(at.is_null())
        learnt = learn(new)
        places, missing = at.fill_null(0).to_numpy().astype(np.int64), at.is_null().to_numpy(zero_copy_only=False)
        places[missing] = len(self.ids) + np.arange(len(new))
        found = pa.concat_arrays([self.ids, learnt]).take(pa.array(places))
        short = pc.less_equal(pc.binary_length(new), CACHE_CHARS)
        self.words, self.ids = pa.concat_arrays([self.words, new.filter(short)]), pa.concat_arrays([self.ids, learnt.filter(short)])
        return found


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    """Binary values that follow each other in ``data`` and end at the given places."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


class Encoder:
    """Text to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.others = _Table(), _Table()
        vocab = self.tokenizer.get_vocab()
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _each(self, words: pa.Array) -> pa.Array:
        ids = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return _binary(4 * np.cumsum([len(x) for x in ids], dtype=np.int64), b"".join(x.tobytes() for x in ids))

    def _joined(self, words: pa.Array) -> pa.Array:
        """Ids of words of letters only, encoded as one text where the vocabulary marks the ends of words."""
        parts = []
        for at in range(0, len(words), 5_000):
            some = words.slice(at, 5_000)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some.to_pylist())], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            parts.append(self._each(some) if len(ends) != len(some) or ends[-1] != len(ids) else _binary(4 * ends, ids.tobytes()))
        return pa.concat_arrays(parts)

    def _ids(self, asked: pa.Array) -> pa.Array:
        """Ids of different pieces: a word of letters, perhaps between punctuation marks, by its word; others whole."""
        shape = pc.extract_regex(asked, _SHAPE)
        plain = shape.is_valid()
        for token in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(asked, token)))
        around = shape.filter(plain)
        del shape
        low = pc.utf8_lower(around.field("word")).dictionary_encode()
        words = self.words.ids_of(low.dictionary, self._joined).take(low.indices)
        sides = []
        for side in ("before", "after"):
            marks = around.field(side).dictionary_encode()
            sides.append(self._each(marks.dictionary).take(marks.indices))
        joined = pc.binary_join_element_wise(sides[0], words, sides[1], pa.scalar(b"", pa.large_binary()))
        others = self.others.ids_of(asked.filter(pc.invert(plain)), self._each)
        known = plain.to_numpy(zero_copy_only=False)
        back = np.where(known, np.cumsum(known) - 1, len(joined) + np.cumsum(~known) - 1)
        return pa.concat_arrays([joined, others]).take(pa.array(back))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each whole text; null is the empty text.

        Arrow splits the texts and numbers their different pieces, so a piece is looked up once a call.
        """
        column = pc.fill_null(pc.cast(texts, pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        for space in "\n\t\r":
            if pc.any(pc.match_substring(column, space)).as_py():
                column = pc.replace_substring(column, space, " ")
        split = pc.split_pattern(column, " ")
        del column
        starts, numbered = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del split
        joined = self._ids(numbered.dictionary).take(numbered.indices)
        _, offsets, data = joined.buffers()
        raw = data.to_pybytes() if data is not None else b""
        bounds = np.frombuffer(offsets, np.int64)[starts].tolist() if len(joined) else [0] * (len(texts) + 1)
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(column: pa.Array, rows: int = 4_096, size: int = 6_000_000):
    """(from, to, part) over a column of texts: at most ``rows`` rows and about ``size`` bytes at a time.

    What a slice took is given back before the next.
    """
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = int(upto[start - 1]) if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + size, side="right"))))
        yield start, end, column.slice(start, end - start)
        trim()
        start = end
