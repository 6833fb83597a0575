"""Line dedup by site-relative frequency.

For each host, the pages that have a line are divided by the host's pages; lines above the
boilerplate ratio go from that host's pages. Lines are compared without outer spaces; blank
lines stay. Only 128-bit keys of lines are counted, with partial sums before the shuffle, so
neither a hot host nor a hot line meets in one task. A host can have at most (mean lines of a
page / ratio) such lines, so its list is short; lists are broadcast below a checked size, else
joined by host and salt.

Defined cases: a null text is a page without lines and stays null; an empty text stays empty;
a page of boilerplate alone becomes empty; null hosts are one host; a host with fewer than
``min_pages`` pages loses nothing; repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import packed
from voxlake.session import cut

MAX_RATIO = 0.05
MIN_PAGES = 5
#: Lists of so many lines in all (32 MB) are broadcast.
BROADCAST_LINES = 1_000_000
SALTS = 64


def _key(line: Column) -> Column:
    """Two independent 64-bit hashes of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, pages_with_line, host_pages) of the lines above the ratio; ``pages`` has host and text."""
    lines = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), F.trim), lambda x: x != ""))
    counted = pages.select("host", F.explode(F.transform(lines, _key)).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages_with_line"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).withColumnRenamed("host", "of_host")
    often = counted.where(F.col("pages_with_line") >= min_pages)
    joined = often.join(totals, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    return joined.where(F.col("pages_with_line") / F.col("host_pages") > max_ratio)


def drop_boilerplate(docs: DataFrame, host: Column, text_column: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``row`` (a struct of all columns), ``text`` without boilerplate, n_lines and n_removed of every row."""
    ready = docs.select(packed(docs.columns).alias("row"), host.alias("host"), F.col(text_column).alias("text"))
    found = cut(boilerplate(ready.select("host", "text"), max_ratio, min_pages).select("host", "key"))
    lists = found.groupBy("host").agg(F.collect_set("key").alias("drop_keys")).withColumnRenamed("host", "of_host")
    same = F.col("host").eqNullSafe(F.col("of_host"))
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        joined = ready.join(F.broadcast(lists), same, "left")
    else:
        salted = lists.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = ready.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("of_salt")), "left")
    lines = _lines(F.col("text"))
    stay = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop_keys"), _key(F.trim(x))))
    kept = F.when(F.col("drop_keys").isNull(), lines).otherwise(stay)
    out = joined.select("row", F.col("text"), kept.alias("kept_lines"))
    n = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n)
    removed = F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept_lines"))
    return out.select("row", F.when(F.col("text").isNotNull(), F.array_join("kept_lines", "\n")).alias("text"), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, host: Column, text_column: str = "text") -> DataFrame:
    """All columns of every row, its text without the boilerplate lines of its host."""
    out = drop_boilerplate(docs, host, text_column)
    return out.select(*(F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = """
WITH keys AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS k FROM documents),
counts AS (SELECT source, k, count(*) AS n FROM keys WHERE k <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
lists AS (SELECT c.source, list(k) AS ks FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
          WHERE n >= 5 AND n::DOUBLE / total > 0.05::DOUBLE GROUP BY ALL),
kept AS (SELECT doc_id, text, CASE WHEN ks IS NULL THEN string_split(text, chr(10))
          ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(ks, trim(x))) END AS ls
         FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(ls, chr(10)), '') END AS text,
       coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(len(string_split(text, chr(10))) - len(ls), 0)::BIGINT AS n_removed
FROM kept
"""
