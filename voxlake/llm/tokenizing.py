"""Exact byte-level BPE ids by the tokenizers library, a run of texts at a time.

A byte-level BPE tokenizer splits text into pre-tokens and merges each on its own. A single
space or newline between two characters that are not white space always begins a pre-token,
so text may be cut there, and the ids of a chunk depend on the chunk alone. Arrow splits a
run of texts at its spaces and numbers the different chunks; the library encodes those that a
bounded table does not hold, many at once, and the ids of all texts are gathered by number.
Texts where white space meets white space go through the library in parts that end at safe
spaces, and those with the added tokens' strings whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from voxlake.llm.common import WordTable, gather, split_words

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = r" \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Chunks that are empty, or begin (one newline apart) or end with white space.
_ODD = rf"^$|^[\t\x0b-\r{_SPACES}]|^\n[\t-\r{_SPACES}]|[\t-\r{_SPACES}]$"
#: Bytes of new chunks that the library encodes in one call.
CALL_BYTES = 1 << 16
_LOADED: dict[str, BpeEncoder] = {}


class BpeEncoder:
    """ids of whole texts; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.plain = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None and "add_prefix_space=False" in str(self.tokenizer.pre_tokenizer)
        # an added token with white space in it could span chunks
        self.plain = self.plain and not any(c.isspace() for a in self.added for c in a)
        # the letters that byte-level vocabularies write for a space and a newline; a chunk's first token begins with one, no other does
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.begins[[i for w, i in vocabulary.items() if w[:1] in ("\u0120", "\u010a")]] = True
        self.table = WordTable()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        """ids of one text, by the library alone, in parts between safe spaces."""
        if not text:
            return np.empty(0, np.uint32)
        if not self.plain or any(a in text for a in self.added):
            return self._whole(text)
        first, *parts = _SAFE.split(text)
        out = [self._whole(first)]
        for lo in range(0, len(parts), 4096):
            out.append(self._whole(" " + " ".join(parts[lo : lo + 4096])))
        return np.concatenate(out)

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of chunks that each follow a space, or begin with a newline."""
        if not len(chunks):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        own = pa.compute.starts_with(chunks, "\n")
        led = pa.compute.binary_join_element_wise(pa.compute.if_else(own, "", " ").cast(pa.large_string()), chunks, pa.scalar("", pa.large_string()))
        sizes = np.asarray(pa.compute.binary_length(led)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // CALL_BYTES)) + 1).tolist(), len(led)]
        ids = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            text = "".join(led.slice(lo, hi - lo).to_pylist())
            ids.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32))
        flat = np.concatenate(ids)
        heads = np.flatnonzero(self.begins[flat])
        return flat, np.diff(heads, append=len(flat))

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text's followed by ``end_id``, and how many each has; null is empty."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        # a newline put before a text is one token of its own, which is dropped again
        heads, index, chunks = split_words(texts, "\n", {"\n": " \n"})
        odd = pa.compute.match_substring_regex(chunks, _ODD)
        for a in self.added:
            odd = pa.compute.or_(odd, pa.compute.match_substring(chunks, a))
        odd = np.asarray(odd) if self.plain else np.ones(len(chunks), dtype=bool)
        good = np.flatnonzero(~odd)
        begins, sizes = np.zeros((2, len(chunks)), dtype=np.int64)
        uses = np.bincount(index, minlength=len(chunks))
        flat, begins[good], sizes[good] = self.table.resolve(chunks.take(pa.array(good)), uses[good], self._new)
        at, width = begins[index], sizes[index]
        first = heads[:-1]
        slow = np.flatnonzero(np.logical_or.reduceat(odd[index], first)) if odd.any() else ()
        for i in slow:
            width[heads[i] : heads[i + 1]] = 0
        some = first[width[first] > 0]
        at[some] += 1
        width[some] -= 1
        counts = np.add.reduceat(width, first)
        out = gather(flat, at, width)
        if len(slow):
            cuts = np.concatenate([[0], np.cumsum(counts)])
            pieces, last = [], 0
            for i in slow:
                ids = self.encode(texts[int(i)].as_py())
                pieces += [out[last : cuts[i]], ids]
                last, counts[i] = cuts[i], len(ids)
            out = np.concatenate([*pieces, out[last:]])
        if end_id is None:
            return out, counts
        return np.insert(out, np.cumsum(counts), np.uint32(end_id)), counts + 1


def encoder(path: str) -> BpeEncoder:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BpeEncoder(path)
    return _LOADED[path]
