"""Count-only Viterbi for unigram vocabularies.

Aho-Corasick lists every vocabulary piece in a word, and one left-to-right pass carries, for
each end position, the best score and the piece count of the path that has it. The tie rules
are the tokenizers library's: candidates for an end are taken by ascending start, and one
replaces the other only if its score is greater; a character that is not a piece itself costs
ten less than the lowest score, and counts as its UTF-8 bytes where the vocabulary has all
byte pieces, else as one unknown piece for each run.

Words are the parts that the Metaspace pre-tokenizer makes (a space becomes U+2581, which
begins a word; one is put before a text that has none), so counts of words add up to the
count of a text. Scores are 32-bit floats and their sums are kept in double precision, as the
library does within a word.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import WordTable, map_arrow, runs, split_words, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Text whose different words are counted at once.
RUN = 8 << 20


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """Pieces with scores, the unknown id, and whether all 256 byte pieces are there, of a sentencepiece file."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    pieces = [(p.id_to_piece(i), float(np.float32(p.get_score(i)))) for i in range(p.get_piece_size())]
    names = {x for x, _ in pieces}
    return pieces, p.unk_id(), all(f"<0x{b:02X}>" in names for b in range(256))


class UnigramCounter:
    """Pieces of words and texts; a bounded table keeps those of frequent words."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int, byte_fallback: bool) -> None:
        import ahocorasick

        self.table = WordTable()
        self.byte_fallback = byte_fallback
        # the library's table of pieces keeps the last of equal strings
        best = dict(pieces)
        self.names = set(best)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == pieces[unknown_id][0]))
        self.automaton.make_automaton()

    def count(self, word: str) -> int:
        """Pieces of the best path through one word."""
        n = len(word)
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        # loose[e]: characters of the unknown run that ends at e on the best path; such a run is one piece
        matches: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            matches[end].append(match)
        for end in range(1, n + 1):
            best, at, stray, single = -math.inf, 0, False, False
            for length, value, unknown in sorted(matches[end - 1], reverse=True):
                candidate = value + score[end - length]
                if candidate > best:
                    best, at, stray = candidate, length, unknown
                single = single or length == 1
            if not single and (not at or self.unknown + score[end - 1] > best):
                best, at, stray = self.unknown + score[end - 1], 1, True
            if stray:
                run = loose[end] = loose[end - at] + at
                count[end] = count[end - run] + self._run(word[end - run : end])
            else:
                count[end] = count[end - at] + 1
            score[end] = best
        return count[n]

    def _run(self, text: str) -> int:
        if text in self.names or not self.byte_fallback:
            return 1
        return len(text.encode())

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts = [self.count(MARK + w) for w in words.to_pylist()]
        return np.array(counts, dtype=np.uint32), np.ones(len(counts), dtype=np.int64)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Pieces of each whole text; null is empty."""
        if not len(texts):
            return np.empty(0, np.int64)
        heads, index, words = split_words(texts, "", {MARK: " "})
        flat, begins, _ = self.table.resolve(words, np.bincount(index, minlength=len(words)), self._new)
        pieces = flat[begins].astype(np.int64)[index]
        first = heads[:-1]
        # the mark that begins a text is that of its first word
        pieces[first[np.asarray(pa.compute.equal(words, ""))[index[first]]]] = 0
        return np.add.reduceat(pieces, first)


_LOADED: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _LOADED:
        _LOADED[path] = UnigramCounter(*vocabulary(path))
    return _LOADED[path]


def reference(path: str):
    """The same tokenizer built with the tokenizers library; for tests."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown, fallback = vocabulary(path)
    t = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    return t


def token_counts(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens) of every row's whole text.

    A null or empty text has 0 tokens; null and repeated ids keep a row each. Other columns
    are not read, whatever their names. No shuffle: one pass over the two columns.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        for part in runs(batch, 1, RUN):
            yield table({"id": (part.column(0), None), "n_tokens": (counter(vocabulary_path).texts(part.column(1)), pa.int64())})

    out = map_arrow(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), each, f"id {kind}, n_tokens long")
    return out.withColumnRenamed("id", id_column)
