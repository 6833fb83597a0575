"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints of equal texts meet first, so the index holds each fingerprint once. Two
fingerprints that differ in at most three bits agree in one of four blocks of bits; they are
dealt by (block, its value), and a group that is still large is dealt again by blocks of the
bits left, so that no link is lost. In a group, fingerprints are sorted by Gray rank, where
neighbours share long patterns. Nodes over runs of them hold the bits that all below share; a
search adds up the differences from the root down, over the bits that each node adds, and
leaves a whole run once there are too many. Runs that are already in the query's component
are left as well: a dense group costs few comparisons.

Candidates of lower similarity are found in the same index over wider fingerprints, dealt by
samples of their bits: a pair meets in one of many tables with a stated probability. Their texts
are then brought together by component of candidates, and a link is one whose shingles were compared.

Each task returns, for each fingerprint, one edge to its component's first one (no pairs).
Components of these edges come from alternating large- and small-star steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.common import map_arrow, packed, runs, table, tidy, with_value
from voxlake.session import cut, release, ship, stage

RADIUS = 3
#: Blocks are one more than the radius, at each level, of the bits that the levels before have left.
BLOCKS = RADIUS + 1
#: Groups of more fingerprints are dealt again, twice at most.
LARGE_GROUP = 4096
#: Large groups' keys are broadcast up to this number (16 MB), else joined by shuffle.
BROADCAST_GROUPS = 500_000
#: Least neighbours of so many nodes at most (about 10 MB of wide fingerprints) are broadcast whole in star steps, else those of hot nodes alone.
BROADCAST_NODES = 50_000
FAN = 8
#: Fingerprints of more rows are joined apart: by broadcast below BROADCAST_GROUPS of them, else by salt.
HOT_COPIES, SALTS = 1000, 64
#: Comparisons of queries with leaves that a step of the search may have to hold.
STEP_PAIRS = 1 << 21
SHINGLE_RUN = 1 << 15
#: For near duplicates of at least this similarity (Jaccard, of distinct shingles): wide fingerprints, and the bits that those
#: of candidates may differ in. At 0.8, 39 of 256 bits are expected to differ (deviation 6), at 0.7 49 (6), without common shingles 128 (8).
MIN_SIMILARITY = 0.8
WIDE_BITS = 256
WIDE_RADIUS = 60
#: Least share of the pairs of exactly that similarity that become candidates, over all distances that they may have.
RECALL = 0.995
#: Shingle sets that one text is compared with at once; texts of candidates in a task.
COMPARED, TASK_TEXTS = 256, 20_000
#: Rows of fingerprints that a task of the index holds, about.
TASK_ROWS = 250_000
FINER_BITS, FINER_TABLES = 6, 12


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits, each set if it is set in over half the shingles' XXH64 (seed 42); 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    h = xxhash.xxh64_intdigest
    for lo in range(0, n, SHINGLE_RUN):
        hi = min(n, lo + SHINGLE_RUN)
        columns = [words[lo + k : hi + k] for k in range(min(shingle, len(words)))]
        hashes = np.array([h(b" ".join(s), 42) for s in zip(*columns, strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _shingles(text: str | None, shingle: int) -> Iterator[list[bytes]]:
    """The shingles of a text, in runs."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    for lo in range(0, n, SHINGLE_RUN):
        columns = [words[lo + k : min(n, lo + SHINGLE_RUN) + k] for k in range(min(shingle, len(words)))]
        yield [b" ".join(s) for s in zip(*columns, strict=True)]


def wide_fingerprint(text: str | None, shingle: int) -> bytes:
    """WIDE_BITS bits of the distinct shingles, by XXH3 with several seeds; zeros without words."""
    import xxhash

    h = xxhash.xxh3_128_digest
    raw = [h(s, seed) for part in _shingles(text, shingle) for s in part for seed in range(WIDE_BITS // 128)]
    if not raw:
        return bytes(WIDE_BITS // 8)
    digests = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDE_BITS // 8)
    digests = digests[np.unique(digests[:, :8].copy().view(np.uint64).ravel(), return_index=True)[1]]
    ones = sum(np.unpackbits(digests[lo : lo + SHINGLE_RUN], axis=1).sum(axis=0, dtype=np.int64) for lo in range(0, len(digests), SHINGLE_RUN))
    return np.packbits(2 * ones > len(digests)).tobytes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """XXH3 of the distinct shingles, sorted; a single zero without words."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(s) for part in _shingles(text, shingle) for s in part] or [0], dtype=np.uint64))


def with_wide_fingerprint(docs: DataFrame, text: Column, carry: Column, shingle: int) -> DataFrame:
    """``row`` (as carried) and ``fp``, the wide fingerprint as bytes, of every row."""
    ready = docs.select(carry.alias("row"), text.alias("text"))
    kind = T.StructType([ready.schema["row"], T.StructField("fp", T.BinaryType())])

    def each(batch: pa.RecordBatch):
        for part in runs(batch, 1):
            yield table({"row": (part.column(0), None), "fp": ([wide_fingerprint(t, shingle) for t in part.column(1).to_pylist()], pa.binary())})

    return map_arrow(ready, each, kind)


def with_fingerprint(docs: DataFrame, text: Column, carry: Column, shingle: int) -> DataFrame:
    """``row`` (as carried) and ``fp``, the fingerprint as a signed 64-bit integer, of every row."""
    ready = docs.select(carry.alias("row"), text.alias("text"))
    kind = T.StructType([ready.schema["row"], T.StructField("fp", T.LongType())])

    def each(batch: pa.RecordBatch):
        for part in runs(batch, 1):
            fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield table({"row": (part.column(0), None), "fp": (fps.view(np.int64), pa.int64())})

    return map_arrow(ready, each, kind)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence; words of a row (last axis) are one long code word."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    for k in range(1, out.shape[-1] if out.ndim > 1 else 0):
        out[:, k] ^= np.uint64(0) - (out[:, k - 1] & np.uint64(1))
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def link_groups(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each key, the fingerprints that differ in at most ``radius`` bits: each to its component's first.

    ``fps`` holds one 64-bit word a fingerprint, or a row of words.
    """
    wide = fps.reshape(len(fps), -1)
    ranks = gray_rank(wide)
    order = np.lexsort((*ranks.T[::-1], keys))
    keys, wide = keys[order], wide[order]
    n = len(wide)
    # levels of the index: end leaf of each node, bits set in all and in any leaf below
    leaf = np.arange(n)
    group = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0) if n else leaf
    levels = [(leaf + 1, wide, wide)]
    parents: list[np.ndarray] = []
    of = group
    while len(of) and np.any(of[1:] == of[:-1]):
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        inside = np.arange(len(of)) - np.repeat(starts, np.diff(starts, append=len(of)))
        head = np.flatnonzero(inside % FAN == 0)
        hi, every, some = levels[-1]
        parents.append(head)
        levels.append((hi[np.append(head[1:], len(of)) - 1], np.bitwise_and.reduceat(every, head), np.bitwise_or.reduceat(some, head)))
        of = of[head]
    label = np.arange(n)
    if len(levels) == 1:
        return fps[:0], fps[:0]
    shared = [~(some ^ every) for _, every, some in levels]
    size = np.bincount(group)[group]
    ends = np.cumsum(size)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + STEP_PAIRS // wide.shape[1], side="right")))
        # the component of a node's leaves, or -1 where they have several
        uniform = [label]
        for head in parents:
            low, high = np.minimum.reduceat(uniform[-1], head), np.maximum.reduceat(uniform[-1], head)
            uniform.append(np.where(low == high, low, -1))
        q = np.arange(at, upto)
        q = q[size[q] > 1]
        node = group[q]
        top = len(levels) - 1
        differ = _bits((wide[q] ^ levels[top][1][node]) & shared[top][node])
        for level in range(top, -1, -1):
            keep = (differ <= radius) & (levels[level][0][node] > q + 1) & (uniform[level][node] != label[q])
            q, node, differ = q[keep], node[keep], differ[keep]
            if level == 0 or not len(q):
                break
            head = parents[level - 1]
            begin = head[node]
            count = np.append(head[1:], len(levels[level - 1][0]))[node] - begin
            child = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            fresh = shared[level - 1][child] & ~np.repeat(shared[level][node], count, axis=0)
            q, differ = np.repeat(q, count), np.repeat(differ, count)
            differ = differ + _bits((wide[q] ^ levels[level - 1][1][child]) & fresh)
            node = child
        label = _join(label, q, node)
        at = upto
    away = np.flatnonzero(label != np.arange(n))
    out = wide if fps.ndim > 1 else wide[:, 0]
    return out[away], out[label[away]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of a[i] and b[i]; a label is the least member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _deal(rest: Column, width: int, key: Column, shift: int) -> Column:
    """An array of (key, rest): for each block of the ``width`` bits in ``rest``, its value joins the key and goes from the rest."""
    cuts = [round(width * k / BLOCKS) for k in range(BLOCKS + 1)]
    out = []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        value = F.shiftrightunsigned(rest, lo).bitwiseAND((1 << (hi - lo)) - 1)
        above = F.shiftleft(F.shiftrightunsigned(rest, hi), lo) if hi < 64 else F.lit(0).cast("long")
        below = rest.bitwiseAND((1 << lo) - 1)
        number = F.shiftleft((value * BLOCKS + k).cast("long"), shift)
        out.append(F.struct(key.bitwiseOR(number).alias("key"), above.bitwiseOR(below).alias("rest")))
    return F.array(*out)


def edges_within(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect all fingerprints ``fp`` that differ in at most RADIUS bits."""
    spark = nodes.sparkSession
    ship(spark)
    zero = F.lit(0).cast("long")
    rows = nodes.select("fp", F.explode(_deal(F.col("fp"), 64, zero, 0)).alias("d")).select("fp", "d.key", "d.rest")
    done, total = [], BLOCKS * nodes.count()
    for width, shift in ((48, 18), (36, 32)):
        large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_GROUP).select(F.col("key").alias("large_key"), "n"))
        n_large, again = large.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_large:
            break
        total += (BLOCKS - 1) * again
        right = F.broadcast(large.drop("n")) if n_large <= BROADCAST_GROUPS else large.drop("n")
        marked = rows.join(right, F.col("key") == F.col("large_key"), "left")
        done.append(marked.where(F.col("large_key").isNull()).select("fp", "key"))
        again = marked.where(F.col("large_key").isNotNull())
        rows = again.select("fp", F.explode(_deal(F.col("rest"), width, F.col("key"), shift)).alias("d")).select("fp", "d.key", "d.rest")
    rows = rows.select("fp", "key")
    for x in done:
        rows = rows.unionByName(x)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if held:
            fps, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            u, v = link_groups(keys, fps.view(np.uint64))
            for lo in range(0, len(u), 100_000):
                yield table({"u": (u[lo : lo + 100_000].view(np.int64), pa.int64()), "v": (v[lo : lo + 100_000].view(np.int64), pa.int64())})
        tidy()

    return rows.repartition(parts, "key").mapInArrow(each, "u long, v long").distinct()


def sample_plan(n: int) -> tuple[int, int]:
    """(bits, tables) for n fingerprints: keys long enough that a group stays small, and tables enough that a pair of the least
    similarity differs in at most WIDE_RADIUS bits and meets in a table with a probability of RECALL, over all distances."""
    bits = max(12, n.bit_length() - 6)
    apart = math.acos(2 * MIN_SIMILARITY / (1 + MIN_SIMILARITY)) / math.pi
    share = [math.comb(WIDE_BITS, d) * apart**d * (1 - apart) ** (WIDE_BITS - d) for d in range(WIDE_RADIUS + 1)]
    # a group that is dealt again must meet in a finer table as well; the plan holds even if every group is
    finer = [1 - (1 - math.comb(WIDE_BITS - d, FINER_BITS) / math.comb(WIDE_BITS, FINER_BITS)) ** FINER_TABLES for d in range(WIDE_RADIUS + 1)]
    agree = [f * math.comb(WIDE_BITS - d, bits) / math.comb(WIDE_BITS, bits) for d, f in enumerate(finer)]
    tables = 1
    while sum(s * (1 - (1 - a) ** tables) for s, a in zip(share, agree, strict=True)) < RECALL:
        tables += 1
    return bits, tables


def _sampled(raw: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """For each fingerprint and each table, the number that its picked bits make."""
    bits = np.unpackbits(raw, axis=1)
    weights = 1 << np.arange(picks.shape[1], dtype=np.int64)
    return np.stack([bits[:, p].astype(np.int64) @ weights for p in picks], axis=1)


def dealt_by_samples(nodes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(fp, k0, k1): a row for each wide fingerprint ``fp`` and each group that it is in, by the plan for n fingerprints; and how many rows.

    Groups of more than LARGE_GROUP are dealt again by further bits, in tables of their own.
    """
    bits, tables = sample_plan(n)
    r = np.random.default_rng(20_241)
    picks = np.stack([r.permutation(WIDE_BITS)[:bits] for _ in range(tables)])
    finer = np.stack([r.permutation(WIDE_BITS)[:FINER_BITS] for _ in range(FINER_TABLES)])

    def deal(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        fp = batch.column(0)
        raw = np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), -1)
        for lo in range(0, len(raw), 4096):
            keys = _sampled(raw[lo : lo + 4096], picks) * tables + np.arange(tables)
            yield table({"fp": (fp.slice(lo, 4096).take(pa.array(np.repeat(np.arange(len(keys)), tables))), None), "k0": (keys.ravel(), pa.int64()), "k1": (np.zeros(keys.size, np.int64), pa.int64())})

    def deal_again(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        for lo in range(0, len(raw), 4096):
            keys = _sampled(raw[lo : lo + 4096], finer) * FINER_TABLES + np.arange(FINER_TABLES) + 1
            of = pa.array(np.repeat(np.arange(len(keys)), FINER_TABLES))
            part = batch.slice(lo, 4096)
            yield table({"fp": (part.column(0).take(of), None), "k0": (part.column(1).take(of), None), "k1": (keys.ravel(), pa.int64())})

    schema = "fp binary, k0 long, k1 long"
    rows = map_arrow(nodes.select("fp"), deal, schema)
    large = cut(rows.groupBy("k0").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_GROUP).select(F.col("k0").alias("large_key"), "n"))
    n_large, n_again = large.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_large:
        right = F.broadcast(large.drop("n")) if n_large <= BROADCAST_GROUPS else large.drop("n")
        marked = rows.join(right, F.col("k0") == F.col("large_key"), "left")
        again = map_arrow(marked.where(F.col("large_key").isNotNull()).select("fp", "k0", "k1"), deal_again, schema)
        rows = marked.where(F.col("large_key").isNull()).select("fp", "k0", "k1").unionByName(again)
    return rows, n * tables + (FINER_TABLES - 1) * n_again


def edges_by_samples(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect wide fingerprints ``fp`` that differ in at most WIDE_RADIUS bits and agree in the bits of a table."""
    spark = nodes.sparkSession
    ship(spark)
    rows, total = dealt_by_samples(nodes, nodes.count())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b"".join(b.column(0).to_pylist()), np.asarray(b.column(1)), np.asarray(b.column(2))) for b in batches if b.num_rows]
        if not held:
            return
        k0, k1 = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        fps = np.frombuffer(b"".join(h[0] for h in held), ">u8").reshape(len(k0), -1).astype(np.uint64)
        order = np.lexsort((k1, k0))
        k0, k1, fps = k0[order], k1[order], fps[order]
        group = np.cumsum((np.diff(k0, prepend=k0[:1]) != 0) | (np.diff(k1, prepend=k1[:1]) != 0))
        u, v = (x.astype(">u8") for x in link_groups(group, fps, WIDE_RADIUS))
        for lo in range(0, len(u), 50_000):
            yield table({c: ([x.tobytes() for x in w[lo : lo + 50_000]], pa.binary()) for c, w in (("u", u), ("v", v))})
        tidy()

    return rows.repartition(parts, "k0", "k1").mapInArrow(each, "u binary, v binary").distinct()


def similar_links(sets: list[np.ndarray], fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all sets whose fingerprints (rows of bytes) differ in at most WIDE_RADIUS bits and whose Jaccard similarity is MIN_SIMILARITY at least.

    Each set is compared with those that no component has yet: where all are alike, that is once.
    """
    words = fps.view(np.uint64)
    sizes = np.array([len(s) for s in sets])
    rest = np.arange(len(sets))
    links = []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = rest[_bits(words[rest] ^ words[x]) <= WIDE_RADIUS]
            found = []
            for lo in range(0, len(near), COMPARED):
                part = near[lo : lo + COMPARED]
                flat = np.concatenate([sets[i] for i in part])
                at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
                common = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
                found += part[common >= MIN_SIMILARITY * (sizes[part] + sizes[x] - common) - 1e-9].tolist()
            links += [(x, i) for i in found]
            todo += found
            rest = rest[~np.isin(rest, found)]
    return links


def similar_edges(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(u, v): edges between fingerprints whose texts share MIN_SIMILARITY of their distinct shingles.

    ``nodes`` has (fp, first.n) and ``texts`` (n, fp, text). Texts meet by component of candidates;
    those of a component of more than LARGE_GROUP meet in the groups that the candidates met in.
    """
    spark = nodes.sparkSession
    roots = star_components(edges_by_samples(nodes))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    keyed = cut(members.join(nodes, F.col("node") == F.col("fp")).select("node", F.col("first.n").alias("of_n"), F.xxhash64("root").alias("k0")))
    large = cut(keyed.groupBy("k0").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") > LARGE_GROUP).select(F.col("k0").alias("large_key")))
    n_large, n_members = large.limit(BROADCAST_GROUPS + 1).count(), keyed.count()
    marked = keyed.join(F.broadcast(large) if n_large <= BROADCAST_GROUPS else large, F.col("k0") == F.col("large_key"), "left")
    marked = marked.select("node", "of_n", "k0", F.col("large_key").isNotNull().alias("again"))
    right = marked.select("of_n", "k0", "again")
    held = texts.join(F.broadcast(right) if n_members <= BROADCAST_GROUPS else right, F.col("n") == F.col("of_n"))
    rows = held.where(~F.col("again")).select("fp", "text", "k0", F.lit(-1).cast("long").alias("k1"))
    if n_large:
        dealt = dealt_by_samples(marked.where("again").select(F.col("node").alias("fp")), nodes.count())[0].withColumnRenamed("fp", "node")
        rows = rows.unionByName(held.where("again").select("fp", "text").join(dealt, F.col("fp") == F.col("node")).select("fp", "text", "k0", "k1"))

    def links(fps: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = similar_links(sets, np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1))
        return table({"u": ([fps[i] for i, _ in found], pa.binary()), "v": ([fps[j] for _, j in found], pa.binary())})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, sets = None, [], []
        for batch in batches:
            for part in runs(batch, 1) if batch.num_rows else ():
                for fp, text, *k in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if k != key:
                        if len(fps) > 1:
                            yield links(fps, sets)
                        key, fps, sets = k, [], []
                    fps.append(fp)
                    sets.append(shingle_set(text, shingle))
        if len(fps) > 1:
            yield links(fps, sets)
        tidy()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_members // TASK_TEXTS)
    return rows.repartition(parts, "k0", "k1").sortWithinPartitions("k0", "k1").mapInArrow(each, "u binary, v binary").distinct()


def _with_least(rows: DataFrame, key: str, spread: str, least: DataFrame, total: int) -> DataFrame:
    """``with_value`` of at most ``total`` keys: few are broadcast, all of them, which needs no shuffle of the rows."""
    if total > BROADCAST_NODES:
        return with_value(rows, key, spread, least, total)
    return rows.join(F.broadcast(least.select("of", "value")), F.col(key) == F.col("of"), "left").select(*rows.columns, "value")


def _both(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): each of the named pairs of columns of every row; the rows are computed once, as they would not be for a union."""
    each = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))
    return rows.select(F.explode(each).alias("pair")).select("pair.u", "pair.v")


def _star_step(now: DataFrame, total: int) -> DataFrame:
    """The edges (u, v), u > v, after a large and a small star step; ``total`` is twice their number."""

    def with_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("value"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "of")
        return _with_least(pairs, "u", "v", least, total)

    # large star: neighbours above a node point to the least of it and its neighbours
    both = _both(now, ("u", "v"), ("v", "u"))
    big = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "value").alias("v")).where("u <> v").distinct()
    # small star: a node and its lower neighbours point to the least of these
    return cut(_both(with_least(big), ("v", "value"), ("u", "value")).where("u <> v").distinct())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's least node, by alternating star steps.

    Each step's shuffle files are released before the next, so that disk holds those of one,
    however many there are.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark, total = None, 2 * now.count()
    while True:
        release(now.sparkSession)
        now = _star_step(now, total)
        seen = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if seen == mark:
            release(now.sparkSession)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, total = seen, 2 * seen[0]


def components(rows: DataFrame, edges: Callable[[DataFrame], DataFrame] = edges_within) -> DataFrame:
    """Add ``component`` to rows of (id, fp): the least id reachable by links, its own included; null ids are no candidates."""
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    roots = star_components(edges(nodes))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    firsts = members.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "first")
    firsts = cut(firsts)
    least = firsts.groupBy("root").agg(F.min("first").alias("value"), F.count(F.lit(1)).alias("n")).withColumnRenamed("root", "of")
    linked = _with_least(firsts, "root", "node", least, firsts.count()).select("node", F.col("value").alias("component"))
    named = cut(nodes.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "first").alias("component"), "copies"))
    # a fingerprint that many rows share must not bring them together in one task
    hot = named.where(F.col("copies") > HOT_COPIES).select(F.col("of_fp").alias("hot_fp"), F.col("component").alias("hot_component"))
    cold = named.where(F.col("copies") <= HOT_COPIES).drop("copies")
    n_hot = hot.limit(BROADCAST_GROUPS + 1).count()
    if not n_hot:
        return rows.join(cold, F.col("fp") == F.col("of_fp")).drop("of_fp")
    if n_hot <= BROADCAST_GROUPS:
        marked = rows.join(F.broadcast(hot), F.col("fp") == F.col("hot_fp"), "left")
    else:
        salted = hot.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        marked = rows.withColumn("salt", salt).join(salted, (F.col("fp") == F.col("hot_fp")) & (F.col("salt") == F.col("of_salt")), "left")
    done = marked.where(F.col("hot_fp").isNotNull()).select("id", "fp", F.col("hot_component").alias("component"))
    rest = marked.where(F.col("hot_fp").isNull()).select("id", "fp").join(cold, F.col("fp") == F.col("of_fp"))
    return rest.select("id", "fp", "component").unionByName(done)


def near_duplicates(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    A null or empty text has fingerprint zero and links like any other; repeated rows link to
    each other; the component of rows that all have null ids is null; an empty table gives no
    rows; a text of any length is hashed whole, in runs.
    """
    found = with_fingerprint(docs, F.col(text_column), F.struct(F.col(id_column).alias("id")), shingle)
    rows = cut(found.select("row.id", "fp"))
    out = components(rows)
    return out.select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least id (nulls last).

    Near duplicates share 0.8 or more of their distinct shingles. At that similarity 64-bit fingerprints
    differ in ten bits, not three, so wide ones give candidates, within WIDE_RADIUS bits, and the texts decide.
    Texts of equal wide fingerprints count as alike: below that similarity, that has a chance under 1e-16.
    """
    numbered = docs.select(packed(docs.columns).alias("row"), F.monotonically_increasing_id().alias("n"))
    carried = F.struct("row", "n")
    staged = stage(with_wide_fingerprint(numbered, F.col("row").getField(text_column), carried, shingle), "fingerprints")
    order = F.struct(F.col("row.row").getField(id_column).isNull().alias("none"), F.col("row.row").getField(id_column).alias("key"), F.col("row.n").alias("n"))
    texts = staged.select(F.col("row.n").alias("n"), "fp", F.col("row.row").getField(text_column).alias("text"))
    found = components(cut(staged.select(order.alias("id"), "fp")), lambda nodes: similar_edges(nodes, texts, shingle))
    kept = found.where(F.col("id.n") == F.col("component.n")).select(F.col("id.n").alias("kept_n"))
    return staged.join(kept, F.col("row.n") == F.col("kept_n"), "left_semi").select("row.row.*")
