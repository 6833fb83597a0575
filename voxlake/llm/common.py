"""Arrow helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.session import ship

#: Python handles text in runs of about so many bytes, however many rows Arrow delivers.
RUN_BYTES = 4 << 20
#: A key of more than this share of all rows is joined by broadcast, at most as many keys as that allows.
HOT_SHARE = 1e-4


def runs(batch: pa.RecordBatch, column: int, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices whose text column holds about ``limit`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n or 0
    yield batch.slice(first)


def tidy() -> None:
    """Give memory that a task has freed back to the machine: workers are kept for further tasks, and two may share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` of a function from a batch to an iterator of batches."""
    ship(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)
        tidy()

    return df.mapInArrow(each, schema)


def table(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from named (values, type) pairs."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns))


def packed(names: list[str]) -> Column:
    """A struct of columns, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in names))


class WordTable:
    """Words and a list of numbers for each, found and kept by Arrow; it holds a bounded number of bytes.

    A full table keeps the half of its words that were used most, and their uses count half from
    then on. Words of more than ``LONGEST`` bytes are not kept.
    """

    #: Words and bytes of a table, and the longest word.
    WORDS, BYTES, LONGEST = 700_000, 64 << 20, 64

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.sizes, self.uses = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def resolve(self, words: pa.Array, uses: np.ndarray, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all given words one after another, where each word's begin, and how many it has; ``make`` gives those of new words."""
        at = np.array(pa.compute.index_in(words, value_set=self.words).fill_null(-1), dtype=np.int64)
        known = at >= 0
        self.uses[at[known]] += uses[known]
        new = np.flatnonzero(~known)
        missing = words.take(pa.array(new))
        flat, sizes = make(missing)
        both, all_sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        at[new] = len(self.sizes) + np.arange(len(new))
        begins = np.cumsum(all_sizes) - all_sizes
        out = both, begins[at], all_sizes[at]
        short = np.asarray(pa.compute.less_equal(pa.compute.binary_length(missing), self.LONGEST))
        held = pa.concat_arrays([self.words, missing])
        counts = np.concatenate([self.uses, uses[new]])
        keep = np.concatenate([np.ones(len(self.sizes), dtype=bool), short])
        if keep.sum() > self.WORDS or held.nbytes + both.nbytes > self.BYTES:
            most = np.argsort(np.where(keep, -counts, 1), kind="stable")[: min(int(keep.sum()), len(keep) // 2)]
            keep[:] = False
            keep[most] = True
            counts >>= 1
        if not keep.all():
            both = both[np.repeat(keep, all_sizes)]
            held = held.filter(pa.array(keep))
            all_sizes, counts = all_sizes[keep], counts[keep]
        self.words, self.flat, self.sizes, self.uses = held, both, all_sizes, counts
        return out


def split_words(texts: pa.Array, prefix: str, replace: dict[str, str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split ``prefix`` and each text, after replacements, at every space.

    Returns where each text's words begin (and the end of the last), the number of each word,
    and the different words by number. A null text is an empty one.
    """
    ready = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    for old, new in replace.items():
        ready = pa.compute.replace_substring(ready, old, new)
    ready = pa.compute.binary_join_element_wise(pa.scalar(prefix, pa.large_string()), ready, pa.scalar("", pa.large_string()))
    parts = pa.compute.split_pattern(ready, " ")
    coded = parts.flatten().dictionary_encode()
    heads = np.asarray(parts.offsets).astype(np.int64)
    return heads - heads[0], np.asarray(coded.indices), coded.dictionary


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """The stretches of ``flat`` that begin and last as given, one after another."""
    out = []
    for lo in range(0, len(begins), step):
        b, n = begins[lo : lo + step], sizes[lo : lo + step]
        ends = np.cumsum(n)
        out.append(flat[np.repeat(b - ends + n, n) + np.arange(int(ends[-1]))])
    return np.concatenate(out) if out else flat[:0]


def with_value(rows: DataFrame, key: str, spread: str, values: DataFrame, total: int) -> DataFrame:
    """Add ``value`` to rows, by ``key``; ``values`` has (of, value, n), with the number n of rows of each key.

    Keys of more than HOT_SHARE of ``total`` rows, of which there are at most 1 / HOT_SHARE, are
    joined by broadcast; their rows, and those without a key, go to the other join under ``spread``
    (of the key's type, not null) instead. The value of a key that ``values`` lacks is null.
    """
    hot = values.where(F.col("n") > HOT_SHARE * total).select(F.col("of").alias("hot_of"), F.col("value").alias("hot_value"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_of"), "left")
    dealt = marked.withColumn("dealt_by", F.when(F.col("hot_of").isNotNull() | F.col(key).isNull(), F.col(spread)).otherwise(F.col(key)))
    joined = dealt.join(values.select("of", F.col("value").alias("cold_value")), F.col("dealt_by") == F.col("of"), "left")
    return joined.select(*rows.columns, F.when(F.col(key).isNotNull(), F.coalesce("hot_value", "cold_value")).alias("value"))
