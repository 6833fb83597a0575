"""Best-fit packing by minimum bin slack, over the counts of lengths.

A piece's place depends on its length alone, so the search works on the counts of the at most
``capacity`` different lengths, which has a fixed size however many pieces there are. Each
bin starts with the largest length left; a subset-sum dynamic program over bit sets finds
the fullest combination of available lengths beside it, which is then removed. The same
combination stays the fullest while its lengths last, so it is removed as often as it fits at
once: every pattern uses up a length, and there are few patterns.

Pieces are then numbered within their length (counts by hash bucket, prefix sums of those,
and the row number in the bucket), and the number selects bin and place. A length that a
third of all pieces share is numbered by many tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.common import map_arrow, runs, table
from voxlake.llm.tokenizing import encoder
from voxlake.session import cut, ship

#: Pieces of one length and bucket, about, that are numbered together.
BUCKET_ROWS = 200_000
#: Text that is tokenized at once.
TOKEN_RUN = 8 << 20


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum of at most ``room``, as (length, times).

    Bit n of a set says that some combination sums to n. Lengths are taken from the largest;
    each can be used as often as it is there, in binary portions. Of equal sums, the one found
    back from the smallest lengths is taken.
    """
    full = (1 << (room + 1)) - 1
    sums = 1
    portions: list[tuple[int, int, int]] = []  # length, times, sums before
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most, times = min(counts[length], room // length), 1
        while most > 0:
            take = min(times, most)
            portions.append((length, take, sums))
            sums |= (sums << (length * take)) & full
            most -= take
            times *= 2
        if sums >> room & 1:
            break
    left = sums.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(portions):
        if not before >> left & 1:
            out[length] = out.get(length, 0) + take
            left -= length * take
    return sorted(out.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]) of all bins; lengths from 1 to capacity."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        largest = max(left)
        left[largest] -= 1
        rest = {x: n for x, n in left.items() if n}
        chosen = dict(fullest(rest, capacity - largest)) if largest < capacity else {}
        left[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
        out.append((times, sorted(chosen.items(), reverse=True)))
    return out


def placement(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: first numbers of its runs, and each run's (first bin, copies in a bin, offset in the bin)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for times, chosen in found:
        at = 0
        for length, copies in chosen:
            starts, rows = out.setdefault(length, ([], []))
            starts.append(used.get(length, 0))
            rows.append((first_bin, copies, at))
            used[length] = used.get(length, 0) + times * copies
            at += length * copies
        first_bin += times
    return out


def cut_points(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece, start and length of all pieces: one each, or ``capacity`` ids each with the first one shorter."""
    count = np.maximum(1, -(-sizes // capacity))
    of = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    # the pieces end at the document's end, so starts go back from there
    start = np.maximum(0, sizes[of] - (count[of] - piece) * capacity)
    end = sizes[of] - (count[of] - piece - 1) * capacity
    return of, piece, start, end - start


PIECE = "n long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n, piece, start, length, ids_crc32) of every document's pieces; its ids, then the end id. n numbers the rows."""
    ready = docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("n"), F.col(text_column).alias("text"))
    kind = ready.schema["id"].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        for part in runs(batch, 2, TOKEN_RUN):
            ids, sizes = encoder(tokenizer_path).encode_all(part.column(2), end_id)
            of, piece, start, length = cut_points(sizes, capacity)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            stops = 4 * np.cumsum(length)
            crc = [crc32(raw[a:b]) for a, b in zip((stops - 4 * length).tolist(), stops.tolist(), strict=True)]
            take = pa.array(of)
            yield table({"id": (part.column(0).take(take), None), "n": (part.column(1).take(take), None), "piece": (piece, pa.int32()), "start": (start, pa.int64()), "length": (length, pa.int64()), "ids_crc32": (crc, pa.int64())})

    return map_arrow(ready, each, f"id {kind}, {PIECE}")


def pack(table_of_pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` from 1 to capacity, which (n, piece) tell apart; the rows are read three times."""
    spark = table_of_pieces.sparkSession
    ship(spark)
    rows = table_of_pieces
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs_of = spark.sparkContext.broadcast(placement(patterns(counts, capacity)))
    buckets = max(16, -(-max(counts.values()) // BUCKET_ROWS))
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("n", "piece"), F.lit(buckets)).cast("int"))
    # numbers within a length: how many lie in lower buckets, and the row number in the bucket
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(F.col("length").alias("of_length"), F.col("bucket").alias("of_bucket"), F.coalesce(before, F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("n", "piece")
    numbered = keyed.withColumn("number", F.row_number().over(order) - 1)
    joined = numbered.join(bases, (F.col("length") == F.col("of_length")) & (F.col("bucket") == F.col("of_bucket")))
    ready = joined.select(*rows.columns, (F.col("number") + F.col("base")).alias("number"))
    kind = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [*rows.columns, "sequence_id", "offset"]
    width, at_length = len(rows.columns), names.index("length")

    def each(batch: pa.RecordBatch):
        lengths, numbers = (np.asarray(batch.column(i)) for i in (at_length, width))
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            starts, found = runs_of.value[int(length)]
            here = np.flatnonzero(lengths == length)
            if len(here) == 1:
                run = [bisect_right(starts, int(numbers[here[0]])) - 1]
            else:
                run = np.searchsorted(np.array(starts), numbers[here], side="right") - 1
            first_bin, copies, at = np.array(found)[run].T
            nth = numbers[here] - np.array(starts)[run]
            bins[here], offsets[here] = first_bin + nth // copies, at + nth % copies * length
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(bins), pa.array(offsets)], names=names)

    return map_arrow(ready, each, kind)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated and null ids are documents of their
    own; a text of any length is cut into whole pieces; an empty table gives no rows; other
    columns are not read. Texts are read once: the pieces, without ids, are checkpointed.
    """
    found = cut(pieces(docs, tokenizer_path, end_id, capacity, id_column, text_column))
    return pack(found, capacity).drop("n").withColumnRenamed("id", id_column)
