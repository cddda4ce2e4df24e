"""The word-end BPE tokenizer of a tokenizers file, for batches of texts.

Its white space is dropped and never part of a token, so a text's ids are those of its parts between ASCII white space,
one after another. The parts of a batch are made distinct first. Most are a word of Latin-1 letters with closing punctuation; these are
lower-cased and cut as columns, and their distinct words are looked up in a memory that each worker keeps, up to a bound. New words go straight to
the library's BPE model. Other parts of printable ASCII and these letters are cut into words one by one; the rest goes through the whole library tokenizer.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Letters that NFC leaves as they are and that lower-case one to one.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Signs after a word that are one piece of the pattern below.
ENDINGS = ".,;:!?"
WORD_AND_ENDINGS = f"^[{LETTERS}]*[{ENDINGS}]*$"
PLAIN = re.compile(f"[!-~{LETTERS}]*")
#: The tokenizer's own pattern, for lower-cased plain characters: fixed value.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


class Memory(dict):
    """key -> make(key), remembered. Of most entries, the half that was not asked for lately is forgotten at a time."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    def __init__(self, path: str, remember: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.words, self.parts = Memory(self.word, remember), Memory(self.part, max(1, remember // 10))
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): spell.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])}

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()  # little-endian machines, as Arrow's

    def word(self, word: str) -> bytes:
        """The ids of one lower-cased piece of plain characters; none of an empty one."""
        spelt = word if word.isascii() else word.translate(self.bytes)
        return self.pack([t.id for t in self.model.tokenize(spelt)])

    def part(self, part: str) -> bytes:
        """The ids of any part without white space."""
        if PLAIN.fullmatch(part) and not any(s in part for s in self.special):
            return b"".join(map(self.words.__getitem__, WORDS.findall(part.lower())))
        return self.pack(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def encode_batch(self, texts: pa.Array, most: int = 4 << 20) -> Iterator[bytes]:
        """Each text's ids in order; null counts as empty. So many bytes of text are worked on at a time, or one text."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield from self._encode(texts[at:stop])
            at = stop

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(texts)
        each = split.flatten().dictionary_encode()
        parts, borders = each.dictionary, np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        simple = pc.match_substring_regex(parts, WORD_AND_ENDINGS)
        told = parts.filter(simple)
        words = pc.utf8_lower(pc.utf8_rtrim(told, ENDINGS)).dictionary_encode()
        tails = pc.replace_substring_regex(told, f"^[{LETTERS}]*", "").dictionary_encode()
        simple = simple.to_numpy(zero_copy_only=False)
        others = strings(parts.filter(pa.array(~simple)))
        # The batch's pieces: distinct words, distinct endings, other parts, and nothing.
        pieces = [*map(self.words.__getitem__, strings(words.dictionary)), *map(self.words.__getitem__, strings(tails.dictionary)), *map(self.parts.__getitem__, others), b""]
        n_words, n_tails = len(words.dictionary), len(tails.dictionary)
        first, second = np.empty(len(parts), np.int64), np.full(len(parts), len(pieces) - 1)
        first[simple], second[simple] = words.indices.to_numpy(), n_words + tails.indices.to_numpy()
        first[~simple] = n_words + n_tails + np.arange(len(others))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(pieces), f"<u{self.width}")
        codes = each.indices.to_numpy()
        run = np.column_stack([first[codes], second[codes]]).ravel()
        size = lengths[run]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.arange(ends[-1]) + np.repeat(starts[run] - ends[:-1], size)]
        cuts = ends[2 * borders]
        for i in range(len(texts)):
            yield out[cuts[i] : cuts[i + 1]].tobytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch(pa.array([text])))
