"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters over eight bytes slide by two over the whole document. Outputs
are max-pooled in overlapping chunks of 256 bytes (a new chunk every 224), and the chunks'
vectors are combined, by maximum and by mean, into one probability. An embedded pair of bytes
meets a quarter of a filter as one row of a table, so scoring needs no matrix product.

Training: at most ``SAMPLE`` labelled rows of either class and ``TRAIN_BYTES`` of text in all (in the
order of a hash of their id; a text that does not fit is passed over, held-out rows are never used, and
of an id's rows the least text counts). Each is learned from all its chunks, by Adam on the logistic
loss. The classes count alike; the shift is then set for their shares among all labels that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import map_arrow, runs, table
from voxlake.session import cut, ship

DIM, WIDTH, STRIDE, FILTERS = 8, 8, 2, 24
#: Pooling cells of 32 bytes; a chunk is 8 cells and begins 7 after the one before.
CELL, CHUNK_CELLS, CHUNK_STEP = 32, 8, 7
CHUNK, STEP = CELL * CHUNK_CELLS, CELL * CHUNK_STEP
SAMPLE = 1200
TRAIN_BYTES = 16 << 20
EPOCHS, BATCH, RATE = 8, 48, 0.01
#: Share of the training documents that are cut short each time.
SHORTEN = 0.3
RUN = 1 << 19
#: Cells that are filtered at once (96 numbers a pair of bytes, 3 MB: larger slices leave the cache), and chunks in training.
CELLS_AT_ONCE, CHUNKS_AT_ONCE = 512, 512
THRESHOLD = 0.7


def chunks_of(raw: bytes) -> np.ndarray:
    """All chunks of a text, as rows of bytes; each goes eight bytes on, for the last filters."""
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    flat = np.frombuffer(raw.ljust((n - 1) * STEP + CHUNK + WIDTH, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH)[::STEP][:n]


class ByteNet:
    """Parameters, training and scoring."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = parameters or {
            "embed": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filter": r.normal(0, 0.2, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.table: np.ndarray | None = None

    # training

    def _loss_gradients(self, chunks: np.ndarray, of: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients over documents whose chunks (of[i]: document of chunk i, ascending) are given as bytes."""
        p, n_docs = self.p, len(label)
        positions = CHUNK // STRIDE
        blocks = range(0, len(chunks), CHUNKS_AT_ONCE)

        def windows(lo: int) -> np.ndarray:
            embedded = p["embed"][chunks[lo : lo + CHUNKS_AT_ONCE]]
            s = embedded.strides
            return np.lib.stride_tricks.as_strided(embedded, (len(embedded), positions, WIDTH * DIM), (s[0], s[1] * STRIDE, s[2]))

        where, top = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS), np.float32)
        for lo in blocks:
            z = (np.ascontiguousarray(windows(lo)).reshape(-1, WIDTH * DIM) @ p["filter"]).reshape(-1, positions, FILTERS)
            where[lo : lo + len(z)] = z.argmax(axis=1)
            top[lo : lo + len(z)] = z.max(axis=1) + p["bias"]
        pooled = np.maximum(top, 0)
        heads = np.searchsorted(of, np.arange(n_docs))
        count = np.diff(heads, append=len(of)).astype(np.float32)[:, None]
        most = np.maximum.reduceat(pooled, heads)
        mean = np.add.reduceat(pooled, heads) / count
        feature = np.concatenate([most, mean], axis=1)
        score = 1 / (1 + np.exp(-(feature @ p["out"] + p["shift"])))
        d = ((score - label) / n_docs).astype(np.float32)
        g = {"out": feature.T @ d + 1e-4 * p["out"], "shift": np.array([d.sum()], np.float32)}
        d_feature = d[:, None] * p["out"][None]
        d_pool = (d_feature[:, FILTERS:] / count)[of]
        first = pooled == most[of]
        d_pool = d_pool + np.where(first, d_feature[:, :FILTERS][of], 0)
        d_pool = np.where(top > 0, d_pool, 0).astype(np.float32)
        g["bias"] = d_pool.sum(axis=0)
        g["filter"], g["embed"] = np.zeros_like(p["filter"]), np.zeros_like(p["embed"])
        for lo in blocks:
            d_part, at = d_pool[lo : lo + CHUNKS_AT_ONCE], where[lo : lo + CHUNKS_AT_ONCE]
            row = np.arange(len(at))[:, None]
            g["filter"] += np.einsum("cf,cfk->kf", d_part, windows(lo)[row, at])
            # to the embeddings of the bytes below each maximum
            byte = chunks[lo : lo + CHUNKS_AT_ONCE][row[..., None], at[..., None] * STRIDE + np.arange(WIDTH)].ravel()
            back = (d_part[..., None] * p["filter"].T[None]).reshape(-1, DIM)
            g["embed"] += np.stack([np.bincount(byte, weights=back[:, k], minlength=256) for k in range(DIM)], axis=1).astype(np.float32)
        return g

    @staticmethod
    def _shorten(chunks: np.ndarray, r: np.random.Generator) -> np.ndarray:
        """A random beginning of one chunk, so that short texts are known as well."""
        one = chunks[r.integers(len(chunks))][None].copy()
        one[:, r.integers(12, CHUNK) :] = 0
        return one

    def fit(self, documents: list[bytes], labels: list[int], prior_log_odds: float = 0.0) -> ByteNet:
        """Adam; every epoch visits each class equally often, and the shift is then set for the classes' true shares."""
        r = np.random.default_rng(11)
        raw = [chunks_of(d) for d in documents]
        y = np.array(labels, np.float32)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):  # nothing to tell apart: every text has the one label
            self.p["shift"][:] = 3.0 if len(good) or not len(bad) else -3.0
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t = 0
        half = BATCH // 2
        steps = EPOCHS * max(8, -(-max(len(good), len(bad)) // half))
        queue = {0: np.empty(0, np.int64), 1: np.empty(0, np.int64)}
        for _ in range(steps):
            picks = []
            for c, rows in ((0, bad), (1, good)):
                while len(queue[c]) < half:
                    queue[c] = np.concatenate([queue[c], r.permutation(rows)])
                picks.append(queue[c][:half])
                queue[c] = queue[c][half:]
            pick = np.concatenate(picks)
            seen = [self._shorten(raw[i], r) if r.random() < SHORTEN else raw[i] for i in pick]
            of = np.repeat(np.arange(len(pick)), [len(x) for x in seen])
            g = self._loss_gradients(np.concatenate(seen), of, y[pick])
            t += 1
            rate = RATE * (1 - 0.9 * t / steps)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.p["shift"] += np.float32(prior_log_odds)
        return self

    # scoring

    def _table(self) -> np.ndarray:
        """For each pair of bytes, its part in all filters at each of the four places that it can have."""
        if self.table is None:
            e = self.p["embed"]
            pairs = np.arange(65536)
            both = np.concatenate([e[pairs & 255], e[pairs >> 8]], axis=1)
            parts = self.p["filter"].reshape(WIDTH // 2, 2 * DIM, FILTERS)
            self.table = np.concatenate([both @ part for part in parts], axis=1).astype(np.float32)
        return self.table

    def features(self, raws: list[bytes]) -> np.ndarray:
        """Combined chunk vectors of whole documents."""
        cells = np.array([-(-(len(x) + WIDTH) // CELL) for x in raws])
        buffer = b"".join([x.ljust(c * CELL, b"\0") for x, c in zip(raws, cells.tolist(), strict=True)])
        pairs = np.frombuffer(buffer, "<u2")
        per_cell = CELL // STRIDE
        ends = np.cumsum(cells)
        # filters that would reach into the next document
        tail = np.sort(((ends * per_cell)[:, None] - np.arange(1, WIDTH // 2)).ravel())
        z = np.empty((int(ends[-1]) + 1, FILTERS), np.float32)
        z[-1] = 0
        for lo in range(0, int(ends[-1]), CELLS_AT_ONCE):
            hi = min(lo + CELLS_AT_ONCE, int(ends[-1]))
            first, n = lo * per_cell, (hi - lo) * per_cell
            rows = np.take(self._table(), pairs[first : first + n + WIDTH // 2 - 1], axis=0)
            found = rows[:n, :FILTERS].copy()
            for k in range(1, WIDTH // 2):
                part = rows[k : n + k, k * FILTERS : (k + 1) * FILTERS]
                found[: len(part)] += part
            found[tail[slice(*np.searchsorted(tail, [first, first + n]))] - first] = -np.inf
            z[lo:hi] = found.reshape(-1, per_cell, FILTERS).max(axis=1)
        # chunks of each document: every CHUNK_STEP cells, none that the one before covers whole
        count = np.maximum(1, -(-(cells - (CHUNK_CELLS - CHUNK_STEP)) // CHUNK_STEP))
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(ends - cells, count) + nth * CHUNK_STEP
        end = np.minimum(begin + CHUNK_CELLS, np.repeat(ends, count))
        cuts = np.stack([begin, end], axis=1).ravel()
        pooled = np.maximum(np.maximum.reduceat(z, cuts)[::2] + self.p["bias"], 0)
        heads = np.cumsum(count) - count
        return np.concatenate([np.maximum.reduceat(pooled, heads), np.add.reduceat(pooled, heads) / count[:, None]], axis=1)

    def score(self, raws: list[bytes]) -> np.ndarray:
        z = self.features(raws) @ self.p["out"] + self.p["shift"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> ByteNet:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("label").isin(0, 1))
    parts = [known.where(F.col("label") == c).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_column).alias("of"), F.col(text_column).alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("of") == F.col("id"))
    found = cut(joined.groupBy("id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")))
    left, picks = TRAIN_BYTES, []
    for r in found.select("id", "label", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id", "label").collect():
        if r["size"] <= left:
            left -= r["size"]
            picks.append((r["id"], r["label"]))
    chosen = {p: k for k, p in enumerate(picks)}
    limits = F.broadcast(docs.sparkSession.createDataFrame(picks, f"pid {sample.schema['id'].dataType.simpleString()}, plabel int"))
    rows = found.join(limits, (F.col("id") == F.col("pid")) & (F.col("label") == F.col("plabel")), "left_semi").collect()
    rows.sort(key=lambda r: chosen[r["id"], r["label"]])
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = float(np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)))
    return ByteNet().fit([r["text"].encode() for r in rows], [r["label"] for r in rows], prior)


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its whole text alone.

    A null text scores like an empty one; repeated rows score alike; labels without a row, and
    rows without a label, do no harm; without labels of both kinds all rows score the same.
    """
    net = train(docs, labels, id_column, text_column)
    parameters = docs.sparkSession.sparkContext.broadcast(net.p)
    ready = docs.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))
    kind = ready.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ByteNet(parameters.value)
        for batch in batches:
            for part in runs(batch, 2, RUN):
                scores = mine.score([(t or "").encode() for t in part.column(2).to_pylist()])
                yield table({"id": (part.column(0), None), "held_out": (part.column(1), None), "score": (scores, pa.float64()), "predicted": ((scores >= THRESHOLD).astype(np.int32), pa.int32())})

    out = ready.mapInArrow(each, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_column)
