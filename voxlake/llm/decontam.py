"""Benchmark decontamination: BM25 retrieval with block-max WAND, then an overlap check.

Test items are the indexed side: each, in segments of at most 48 words, is an entry whose
BM25 weights are divided by their sum, so a score is the share of the entry that the passage
holds. Every passage of every document (64 words, one every 16, so that each segment lies
whole in one) is a query; all entries with a score of at least ``MIN_SCORE`` are retrieved.
Sums of largest weights, first of a term and then of a term within a block of entries, are
upper bounds that leave most passages and blocks; they are added up for many passages at once.
What is left runs document-at-a-time WAND with block maxima.

A retrieved item is kept if the words around the passage hold at least 0.8 of its five-word
shingles, and half of the words of its question (all but the last sentence) and of its answer
(the last sentence).

Items are read in groups of a bounded number of bytes; inverse document frequencies are those
of all items. One group's index, of flat arrays, is broadcast at a time: with several groups,
documents and what they hold are written to the shared folder between one group and the next.

Words are runs of letters and digits; scripts without spaces make a clause one word, so there an
item is found only where whole clauses are the same.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.common import WordTable, gather, map_arrow, packed, runs, split_words, table
from voxlake.session import cut, ship, stage

K1, B = 1.2, 0.75
SEGMENT = 48
CELL = 16
CELLS = 4
MIN_SCORE = 0.6
MIN_OVERLAP = 0.8
MIN_PART = 0.5
SHINGLE = 5
#: Entries of a block and blocks of an index.
BLOCK, MOST_BLOCKS = 8, 64
#: Item text in a broadcast index.
GROUP_BYTES = 8 << 20
#: Postings and block maxima that a worker keeps as lists.
LISTED = 1 << 20
#: Document text that is looked up at once.
RUN = 4 << 20

_WORDS = re.compile(r"\w+")
_LAST = re.compile(r"(?s)^(.*[.?!\n])\s*(\S.*)$")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def answer_at(text: str, n_words: int) -> int:
    """The word at which an item's last sentence or line, the answer, begins; 0 if it has one sentence only."""
    m = _LAST.match(text.rstrip().rstrip(".?!"))
    at = len(words_of(m[1])) if m else 0
    return at if at < n_words else 0


def grams(words: list[int], size: int) -> set[tuple[int, ...]]:
    """The different runs of ``size`` words."""
    return set(zip(*(words[k:] for k in range(size)), strict=False))


class BlockMaxIndex:
    """An inverted index of item segments with weights, term maxima and block maxima, in flat arrays."""

    def __init__(self, items: list[tuple[int | None, str]], document_frequency: dict[str, int], n_items: int, mean_words: float) -> None:
        self.terms: dict[str, int] = {}
        self.item_id: list[int | None] = []
        words, ends, answers = array("i"), array("q"), array("q")
        entry_item, term, entry, weight = array("i"), array("i"), array("i"), array("d")
        idf = {t: math.log(1 + (n_items - f + 0.5) / (f + 0.5)) for t, f in document_frequency.items()}
        for item_id, text in items:
            mine = words_of(text)
            if not mine:
                continue
            ids = [self.terms.setdefault(w, len(self.terms)) for w in mine]
            words.extend(ids)
            ends.append(len(words))
            answers.append(answer_at(text, len(mine)))
            self.item_id.append(item_id)
            n = -(-len(mine) // SEGMENT)
            for k in range(n):
                part = Counter(mine[len(mine) * k // n : len(mine) * (k + 1) // n])
                norm = K1 * (1 - B + B * sum(part.values()) / min(SEGMENT, max(1.0, mean_words)))
                w = [idf[t] * f * (K1 + 1) / (f + norm) for t, f in part.items()]
                total = sum(w)
                term.extend(self.terms[t] for t in part)
                entry.extend([len(entry_item)] * len(w))
                weight.extend(x / total for x in w)
                entry_item.append(len(self.item_id) - 1)
        self.words, self.ends, self.answers = (np.array(x) for x in (words, ends, answers))
        self.entry_item = np.array(entry_item)
        term_of, entry_of = np.array(term, dtype=np.int64), np.array(entry, dtype=np.int32)
        order = np.lexsort((entry_of, term_of))
        term_of, self.entries, self.weights = term_of[order], entry_of[order], np.array(weight)[order]
        n_terms, n_entries = len(self.terms), len(entry_item)
        self.heads = np.searchsorted(term_of, np.arange(n_terms + 1))
        self.block = max(BLOCK, -(-n_entries // MOST_BLOCKS))
        # a little above the true maxima, so that rounding to 32 bits never hides an entry
        self.block_max = np.zeros((max(1, n_terms), max(1, -(-n_entries // self.block))), dtype=np.float32)
        np.maximum.at(self.block_max, (term_of, self.entries // self.block), self.weights.astype(np.float32) * np.float32(1.000001))
        self.term_max = self.block_max.max(axis=1)
        self.listed: dict[int, tuple[list[int], list[float]]] = {}
        self.room = LISTED
        self.table = WordTable()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"listed": {}, "room": LISTED, "table": WordTable()}

    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.__dict__.values() if isinstance(x, np.ndarray))

    def list_of(self, term: int) -> tuple[list[int], list[float], list[float], float]:
        """A term's entries, their weights, its block maxima and its largest weight."""
        found = self.listed.get(term)
        if found is None:
            lo, hi = self.heads[term], self.heads[term + 1]
            found = self.entries[lo:hi].tolist(), self.weights[lo:hi].tolist(), self.block_max[term].tolist(), float(self.term_max[term])
            size = int(hi - lo) + len(found[2])
            if size <= self.room:
                self.room -= size
                self.listed[term] = found
        return found

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (entry, score) with a score of at least ``threshold`` for a query of distinct terms."""
        out = []
        size, kept = self.block, self.listed.get
        cursors = []  # entry, place in the list, term, its lists
        for t in terms:
            lists = kept(t) or self.list_of(t)
            cursors.append([lists[0][0], 0, t, lists])
        slack = threshold * (1 - 1e-9)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3][3]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            block = entry // size
            if sum([c[3][2][block] for c in cursors[: pivot + 1]]) >= slack:
                if cursors[0][0] == entry:
                    score = sum([c[3][1][c[1]] for c in cursors[: pivot + 1]])
                    if score >= slack:
                        out.append((entry, score))
                    target = entry + 1
                else:
                    target = entry
            else:
                # no entry up to the block's end, or up to the next list's entry, can reach the threshold
                target = (block + 1) * size
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, entry + 1)
            stay = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < target:
                    p = c[3][0]
                    at = bisect_left(p, target, c[1])
                    if at == len(p):
                        continue
                    c[0], c[1] = p[at], at
                stay.append(c)
            cursors = stay
        return out

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the words of each chunk; -1 for words that no item has."""
        get = self.terms.get
        found = [[get(w, -1) for w in words_of(c)] for c in chunks.to_pylist()]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum())).view(np.uint32), sizes

    def word_terms(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Terms of all words of the texts, one after another, and how many words each text has; words do not go over spaces."""
        heads, index, chunks = split_words(texts, "", {})
        flat, begins, sizes = self.table.resolve(chunks, np.bincount(index, minlength=len(chunks)), self._new)
        width = sizes[index]
        return gather(flat, begins[index], width).view(np.int32), np.add.reduceat(width, heads[:-1])

    def verify(self, item: int, words: np.ndarray, begin: int) -> bool:
        """Whether the words (terms of a document) around a passage that begins at ``begin`` hold the item."""
        end = int(self.ends[item])
        mine = self.words[int(self.ends[item - 1]) if item else 0 : end].tolist()
        near = words[max(0, begin - len(mine)) : begin + CELL * CELLS + len(mine)].tolist()
        size = min(SHINGLE, len(mine))
        own = grams(mine, size)
        if len(own & grams(near, size)) < MIN_OVERLAP * len(own):
            return False
        bag, cut = set(near), int(self.answers[item])
        return all(len(part & bag) >= MIN_PART * len(part) for part in (set(mine[:cut] or mine), set(mine[cut:] or mine)))

    def candidates(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(document, first word, distinct terms) of passages whose upper bounds reach the threshold in some block."""
        cells = -(-sizes // CELL)
        base = np.cumsum(cells + CELLS - 1) - (cells + CELLS - 1)
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return []
        doc = np.repeat(np.arange(len(sizes)), sizes)[known]
        place = known - (np.cumsum(sizes) - sizes)[doc]
        n_terms, n_cells = len(self.terms), int(base[-1] + cells[-1]) + CELLS
        pairs = np.unique((base[doc] + place // CELL) * n_terms + ids[known])
        cell, term = pairs // n_terms, pairs % n_terms

        def windows(x: np.ndarray) -> np.ndarray:
            return sum(x[k : len(x) - CELLS + 1 + k] for k in range(CELLS))

        bound = windows(np.bincount(cell, weights=self.term_max[term], minlength=n_cells))
        left = np.flatnonzero(bound >= MIN_SCORE * (1 - 1e-6))
        if not len(left):
            return []
        wanted = np.zeros(n_cells, dtype=bool)
        for k in range(CELLS):
            wanted[left + k] = True
        rank = np.cumsum(wanted) - 1
        mine = wanted[cell]
        heads = np.flatnonzero(np.diff(cell[mine], prepend=-1))
        sums = np.zeros((int(wanted.sum()), self.block_max.shape[1]), dtype=np.float32)
        sums[rank[cell[mine][heads]]] = np.add.reduceat(self.block_max[term[mine]], heads, axis=0)
        best = sum(sums[rank[left + k]] for k in range(CELLS)).max(axis=1)
        left = left[best >= MIN_SCORE * (1 - 1e-5)]
        out = []
        begins = np.searchsorted(cell, left), np.searchsorted(cell, left + CELLS)
        of = np.searchsorted(base, left, side="right") - 1
        for w, lo, hi, d in zip(left.tolist(), *(b.tolist() for b in begins), of.tolist(), strict=True):
            terms = np.unique(term[lo:hi])
            # a word that is in several cells counts once
            if self.block_max[terms].sum(axis=0).max() >= MIN_SCORE * (1 - 1e-5):
                out.append((d, (w - int(base[d])) * CELL, terms.tolist()))
        return out

    def find(self, texts: pa.Array) -> list[list[int | None]]:
        """Ids of the items that each text holds."""
        found: list[dict[int, None]] = [{} for _ in range(len(texts))]
        if found and self.terms:
            ids, sizes = self.word_terms(texts)
            ends = np.cumsum(sizes)
            for d, begin, terms in self.candidates(ids, sizes):
                for entry, _ in self.wand(terms, MIN_SCORE):
                    k = int(self.entry_item[entry])
                    if k not in found[d] and self.verify(k, ids[ends[d] - sizes[d] : ends[d]], begin):
                        found[d][k] = None
        return [sorted((self.item_id[k] for k in f), key=lambda i: (i is None, i)) for f in found]


def item_groups(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[BlockMaxIndex]:
    """Indexes of all items in groups of bounded size, one at a time; frequencies and means are those of all items."""
    items = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_groups = max(1, -(-total["bytes"] // GROUP_BYTES))

    def each(batch: pa.RecordBatch):
        for part in runs(batch, 0):
            rows = [words_of(t) for t in part.column(0).to_pylist()]
            counts = Counter(w for r in rows for w in set(r))
            yield table({"word": (list(counts), pa.string()), "n": (list(counts.values()), pa.int64()), "size": ([0] * len(counts), pa.int64())})
            yield table({"word": ([None], pa.string()), "n": ([sum(1 for r in rows if r)], pa.int64()), "size": ([sum(map(len, rows))], pa.int64())})

    counted = cut(map_arrow(items.select("text"), each, "word string, n long, size long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    size = counted.where("word IS NULL").first()
    n_items, mean = (size["n"], size["size"] / max(1, size["n"])) if size else (0, 1.0)
    for g in range(n_groups):
        mine = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_groups)) == g).collect()]
        vocabulary = benchmark.sparkSession.createDataFrame([(w,) for w in {w for _, t in mine for w in words_of(t)}], "w string")
        frequency = {r["word"]: r["n"] for r in counted.join(F.broadcast(vocabulary), F.col("word") == F.col("w")).select("word", "n").collect()}
        yield BlockMaxIndex(mine, frequency, n_items, mean)


def match_items(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``row`` (a struct of the carried columns) and ``item_ids``, those of the items that the whole text holds.

    A null or empty text holds none; an item without words is held by none; an item of less
    than five words is held where its words stand in order; equal items are all named;
    repeated rows are judged alike. No shuffle of documents.
    """
    spark = docs.sparkSession
    ship(spark)
    now = docs.select(packed(carry).alias("row"), F.col(text_column).alias("text"), F.array().cast("array<long>").alias("item_ids"))
    kind = T.StructType([now.schema["row"], T.StructField("text", T.StringType()), T.StructField("item_ids", T.ArrayType(T.LongType()))])
    shared = None
    for index in item_groups(benchmark, item_id, item_text):
        if shared is not None:
            now = stage(now, "matched")
            shared.destroy()
        shared = spark.sparkContext.broadcast(index)

        def each(batch: pa.RecordBatch, shared=shared):
            for part in runs(batch, 1, RUN):
                found = shared.value.find(part.column(1))
                both = [a + b for a, b in zip(part.column(2).to_pylist(), found, strict=True)]
                yield table({"row": (part.column(0), None), "text": (part.column(1), None), "item_ids": (both, pa.list_(pa.int64()))})

        now = map_arrow(now, each, kind)
    # of several groups, each has given its ids in order
    return now.select("row", F.array_sort("item_ids").alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, item_ids, n_items, contaminated, kept) of every row."""
    hit = F.size("item_ids") > 0
    out = match_items(docs, benchmark, [id_column])
    return out.select(F.col(f"row.{id_column}").alias(id_column), "item_ids", F.size("item_ids").cast("long").alias("n_items"), hit.alias("contaminated"), (~hit).alias("kept"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no item, with their own columns."""
    return match_items(docs, benchmark, docs.columns).where(F.size("item_ids") == 0).select("row.*")
