"""Exact byte-level BPE in linear time, and decoding.

A sequence of tokens is what BPE would make of its bytes exactly if each two neighbours are compatible: merging their
bytes alone gives the same two. So the encoder walks through a piece with the longest token at each place (found by an Aho-Corasick automaton
over the vocabulary), steps down to shorter tokens or back where two do not go together, and never tries an end twice.
Compatibility is worked out from the merges once for each pair and kept in a table.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import small_batches

#: The published pattern of byte-level BPE pieces: fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the
    others for the code points from 256 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BacktrackingBPE:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes; decode(ids) -> text."""

    def __init__(self, path: str, remember: int = 250_000, pairs: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Rank order: the 256 bytes, then the merges; the merge's rank is its priority.
        names = letters + [a + b for a, b in merges]
        rank = {}
        for i, n in enumerate(names):
            rank.setdefault(n, i)
        self.pair = {}
        for i, (a, b) in enumerate(merges):
            self.pair.setdefault((rank[a], rank[b]), 256 + i)
        self.halves = [(i, i) for i in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.ids = [vocab[n] for n in names]
        self.content = [bytes(value[c] for c in n) for n in names]
        self.length = [len(c) for c in self.content]
        self.automaton = ahocorasick.Automaton()
        at = {}
        for i, c in enumerate(self.content):
            at.setdefault(c, i)
            self.automaton.add_word(c.decode("latin-1"), at[c])
        self.automaton.make_automaton()
        self.shorter = [next((at[c[:k]] for k in range(len(c) - 1, 0, -1) if c[:k] in at), -1) for c in self.content]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.remember, self.known, self.most_pairs, self.together = remember, {}, pairs, {}
        # Decoding: all tokens' bytes in a row, and where each begins.
        by_id = {i: c for i, c in zip(self.ids, self.content)} | {i: c.encode() for c, i in self.special.items()}
        table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(c) for c in table])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps these two tokens apart: undo their last merges in turn, the latest first; at no moment
        may the two that then touch have a merge that comes before the one just undone."""
        key = (left, right)
        known = self.together.get(key)
        if known is not None:
            return known
        limit, answer = 1 << 60, True
        while True:
            merged = self.pair.get((left, right))
            if merged is not None and merged < limit:
                answer = False
                break
            # Of two equal tokens, BPE merges the left one first, so the right one is undone first.
            undo_left = left > right
            if undo_left and left < 256 or not undo_left and right < 256:
                undo_left = not undo_left
                if (left if undo_left else right) < 256:
                    break
            if undo_left:
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]
        if len(self.together) >= self.most_pairs:
            self.together.clear()
        self.together[key] = answer
        return answer

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(data)
        if not n:
            return []
        longest = [0] * n  # by where a token starts
        length = self.length
        for end, token in self.automaton.iter(data.decode("latin-1")):
            start = end - length[token] + 1
            if length[token] >= length[longest[start]] or not longest[start]:
                longest[start] = token
        for i in range(n):
            if not longest[i]:
                longest[i] = data[i]  # byte 0 has rank 0, and so is set here
        open_end = bytearray(b"\x01" * (n + 1))
        tokens, at, token = [], 0, longest[0]
        while at < n:
            while True:
                end = at + length[token]
                if open_end[end] and (not tokens or self.compatible(tokens[-1], token)):
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:  # nothing fits here: this place is closed, and the token before is tried shorter
                    open_end[at] = 0
                    token = tokens.pop()
                    at -= length[token]
        return [self.ids[t] for t in tokens]

    def plain(self, text: str) -> bytes:
        known, found = self.known, self.pieces.findall(text)
        try:
            return b"".join([known[p] for p in found])
        except KeyError:
            new = {p for p in found if p not in known}
        if len(known) + len(new) > self.remember:
            known.clear()
            new = set(found)
        for p in new:
            known[p] = np.array(self.piece(p.encode()), "<u4").tobytes()
        return b"".join([known[p] for p in found])

    def encode(self, text: str) -> bytes:
        if self.split is None or not self.split.search(text):
            return self.plain(text)
        parts = self.split.split(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if i % 2 else self.plain(x) for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """Bytes that are not UTF-8 become replacement characters; unknown ids give nothing."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        at = at[at < len(self.offsets) - 1]
        out = []
        for i in range(0, len(at), 1 << 16):  # bounded memory for very long texts
            part = at[i : i + (1 << 16)]
            begin, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            shift = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            out.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@cache
def tokenizer(path: str, **memory: int) -> BacktrackingBPE:
    return BacktrackingBPE(path, **memory)


def encode_decode(docs: DataFrame, path: str, ids: bool = True, keep: bool = True, **memory: int) -> DataFrame:
    """docs -> (doc_id, n_tokens, ids binary, ids_sha256, decoded_sha256): one row for each row; ids are unsigned 32-bit
    little-endian, and null unless asked for. Null counts as the empty text, which has no ids. Extra columns are ignored; an empty table gives no rows.

    memory: how many pieces and pairs a worker remembers (remember, pairs of BacktrackingBPE). keep: whether a worker holds the tables for its next task."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        t = tokenizer(path, **memory)
        try:
            for b in batches:
                rows = []
                for text in b.column("text").to_pylist():
                    got = t.encode(text or "")
                    rows.append((len(got) // 4, got if ids else None, hashlib.sha256(got).hexdigest(), hashlib.sha256(t.decode(got).encode()).hexdigest()))
                columns = list(zip(*rows)) or [()] * 4
                types = (pa.int64(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, types))], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        finally:
            if not keep:
                tokenizer.cache_clear()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string")
