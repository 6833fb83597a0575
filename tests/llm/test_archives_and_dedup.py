import base64
import hashlib
import os
import random
import resource
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F

from voxlake.llm import decontam, queries, quality_cnn, simhash, warc
from voxlake.session import fresh_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, component string, row string"


def sha(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_archives(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twins = pages.limit(20).withColumn("page_id", F.col("page_id") + 10_000)
    odd = spark.createDataFrame([(20_001, None, None), (20_002, "http://x\r\ny", ""), (None, "u", None), (None, None, "zz"), (20_003, "u", "zz"), (20_003, "u", "zz"), (20_004, "u", "long " * 200_000)], pages.schema)
    every = pages.unionByName(twins).unionByName(odd).withColumn("payload", F.lit("clash")).cache()
    rows = every.collect()
    last: dict = {}
    for r in rows:
        p = (r.html or "").encode()
        if r.page_id is not None:
            last[p] = max(last.get(p, -1), r.page_id)
    want = Counter()
    for r in rows:
        p = (r.html or "").encode()
        refers = last.get(p) if last.get(p) != r.page_id else None
        want[(r.page_id, len(p), sha(p), "response" if refers is None else "revisit", refers)] += 1
    for most in (200_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
        got = warc.archive_round_trip(every).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert Counter(tuple(r) for r in got.collect()) == want
    assert warc.archive_round_trip(every.limit(0)).count() == 0
    every.unpersist()


def test_one_record_is_read_by_its_identifier(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").coalesce(1)
    folder = fresh_path(spark, "warc")
    (f,) = warc.write_archives(pages, folder, frame_bytes=20_000).collect()
    first = pages.orderBy("page_id").first()
    with pafs.LocalFileSystem().open_input_file(f.path) as source:
        reader = warc.BundleReader(source)
        assert len(reader.offsets) > 3 and f.n_records == pages.count()
        record = reader.record(warc.record_id(first.page_id))
        assert record.payload == first.html.encode() and record.headers["WARC-Type"] == "response"
    import zstandard

    raw = open(f.path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == pages.count()


def brute_fingerprint(text, k):
    words = []
    for w in (text or "").encode().split():
        words.append(bytes(b + 32 if 65 <= b <= 90 else b for b in w))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize(("large", "hot", "most"), [(4096, 1000, 500_000), (2, 1, 500_000), (4096, 1, 0)])
def test_components_equal_brute_force(spark, monkeypatch, large, hot, most):
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    monkeypatch.setattr(simhash, "HOT_COPIES", hot)
    monkeypatch.setattr(simhash, "BROADCAST_GROUPS", most)
    monkeypatch.setattr(simhash, "STEP_PAIRS", 500)
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    label = brute_components(fps)
    want = {rows[i][0]: (f"{fps[i]:016x}", rows[label[i]][0]) for i in range(len(rows))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_components(spark, SF).collect()}
    assert got == want


def test_index_on_random_and_dense_groups():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 100, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 4), dtype=np.uint64), axis=1) for b, k in zip(base[:20], r.integers(1, 40, 20), strict=True)]
    fps = np.unique(np.concatenate([base, *near]))
    u, v = simhash.link_groups(np.zeros(len(fps), np.int64), fps)
    at = {int(x): i for i, x in enumerate(fps)}
    label = simhash._join(np.arange(len(fps)), np.array([at[int(x)] for x in u]), np.array([at[int(x)] for x in v]))
    assert label.tolist() == brute_components([int(x) for x in fps])


def test_wide_components_link_similar_texts(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, groups = [], {}
    for g in range(40):
        base = [r.choice(vocabulary) for _ in range(200)]
        for k in range(4):
            words = list(base)
            for _ in range(k):
                words[r.randrange(200)] = r.choice(vocabulary)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    fps = simhash.with_wide_fingerprint(df, F.col("text"), F.col("doc_id"), 5).select(F.col("row").alias("id"), "fp")
    found = {x.id: x.component for x in simhash.components(fps, simhash.edges_by_samples).collect()}
    pairs = [(i, j) for i in sets for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 100 and sum(found[i] == found[j] for i, j in pairs) >= 0.98 * len(pairs)
    assert all(groups[i] == groups[c] for i, c in found.items())


def test_star_steps_split_a_large_component(spark):
    """One component of 200,000 nodes: a star, a path and a far end; no join task has a tenth of the rows."""
    n = 200_000
    edges = spark.range(1, n).select(F.col("id").alias("u"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") - 1).alias("v"))
    out = simhash.star_components(edges)
    assert out.count() == n - 1 and out.select("root").distinct().collect()[0][0] == 0
    pairs = spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("value"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "of")
    joined = simhash.with_value(pairs, "u", "v", least, n)
    assert joined.where("value = 1").count() == n - 1
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = [r["count"] for r in simhash.with_value(pairs, "u", "v", least, n).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) == 4 and max(sizes) < 1.1 * n / 4


@pytest.mark.parametrize("broadcast", [simhash.BROADCAST_NODES, 0])
def test_star_steps_equal_a_search(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_NODES", broadcast)
    r = random.Random(3)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(500)] + [(k, k - 1) for k in range(1001, 1070)] + [(2000 + k, 2000) for k in range(300)]
    near: dict = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    root: dict = {}
    for first in sorted(near):
        todo = [first]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = first
                todo += near[x]
    want = Counter((x, y) for x, y in root.items() if x != y)
    assert Counter(map(tuple, simhash.star_components(spark.createDataFrame(edges, "u long, v long")).collect())) == want


def test_star_steps_release_their_shuffle_files(spark, monkeypatch):
    """However many steps a long path takes, the files of one are on disk (those before are removed in the background)."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def on_disk():
        return {f.split("_")[1] for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    simhash.release(spark)
    time.sleep(2)
    before, left, cut = on_disk(), [], simhash.cut

    def watched(df):
        out = cut(df)
        end = time.time() + 5
        while len(on_disk() - before) > 10 and time.time() < end:
            time.sleep(0.1)
        left.append(len(on_disk() - before))
        return out

    monkeypatch.setattr(simhash, "cut", watched)
    path = spark.range(1, 2000).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert simhash.star_components(path).where("root = 0").count() == 1999
    assert len(left) > 5 and max(left) <= 10, str(left)


def test_gray_rank():
    x = np.arange(256, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(x ^ (x >> np.uint64(1))), x)


def test_near_duplicate_edges(spark):
    t = " ".join(f"w{i}" for i in range(400))
    rows = [(5, t), (3, t + " end"), (9, None), (8, ""), (None, t), (3, t + " end"), (7, "alone here"), (1, "The Quick fox"), (2, "the quick FOX")]
    df = spark.createDataFrame([(i, x, "en", "s", 1, "c", "c", "c") for i, x in rows], DOCS)
    got = sorted(((r.doc_id is not None, r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    by = {k[1]: c for k, c in got}
    assert by[9] == by[8] == 8 and by[1] == by[2] == 1 and by[7] == 7 and by[5] == by[None] and len(got) == 9
    kept = simhash.keep_one(df)
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == df.columns and ids.count(8) == 1 and 9 not in ids and ids.count(3) <= 1 and 7 in ids and 1 in ids and 2 not in ids
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_wand_and_matches_equal_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    index = next(decontam.item_groups(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text"))
    rnd = random.Random(2)
    for _ in range(200):
        words = decontam.words_of(rnd.choice([*docs.values(), *(t for _, t in items)]))[:64]
        terms = sorted({index.terms[w] for w in words if w in index.terms})
        score = Counter()
        for t in terms:
            for e, x in zip(*index.list_of(t)[:2], strict=True):
                score[e] += x
        for threshold in (0.05, 0.2, 0.6):
            assert sorted(e for e, _ in index.wand(terms, threshold)) == sorted(e for e, s in score.items() if s >= threshold * (1 - 1e-9))
    def five(t):
        w = decontam.words_of(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    shingles = {k: five(t) for k, t in items}
    want = {}
    for k, t in docs.items():
        mine = five(t)
        want[k] = sorted(i for i, s in shingles.items() if len(s & mine) >= 0.8 * len(s))
    got = {r.doc_id: (r.item_ids, r.n_items, r.contaminated, r.kept) for r in queries.op7_decontamination(spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all((v[1], v[2], v[3]) == (len(v[0]), bool(v[0]), not v[0]) for v in got.values())


def test_index_of_many_items_in_bounded_memory():
    """8 MB of made-up items, a whole group."""
    r = random.Random(1)
    pool = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(60_000)]
    items = [(k, " ".join(r.choices(pool, k=60)) + ". " + " ".join(r.choices(pool, k=6))) for k in range(16_000)]
    frequency = Counter(w for _, t in items for w in set(decontam.words_of(t)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = decontam.BlockMaxIndex(items, frequency, len(items), 66.0)
    assert sum(len(t) for _, t in items) > 7_000_000 and index.nbytes() < 70_000_000
    text = " ".join(r.choices(pool, k=300))
    found = index.find(pa.array([f"{text} {items[7][1]} {text}", text, None, items[15_999][1]]))
    assert found == [[7], [], [], [15_999]]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_decontamination_edges(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(60)) + ". What is it? The answer is forty two"
    long = "filler " * 30_000 + item.upper() + " tail"
    rows = [(1, item), (2, long), (3, None), (4, ""), (5, " ".join(item.split()[:20])), (None, item), (1, item), (6, "aa bb cc"), (7, "aa xx bb cc")]
    df = spark.createDataFrame([(i, x, "en", "s", 1, "c", "c", "c") for i, x in rows], DOCS)
    bench = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "", 1), (13, "aa bb cc", 1), (14, item, 1)], "item_id long, text string, row int")
    for size in (decontam.GROUP_BYTES, 100):
        monkeypatch.setattr(decontam, "GROUP_BYTES", size)
        got = Counter((r.doc_id, tuple(sorted(r.item_ids))) for r in decontam.contamination(df, bench).collect())
        assert got == Counter({(1, (10, 14)): 2, (2, (10, 14)): 1, (3, ()): 1, (4, ()): 1, (5, ()): 1, (None, (10, 14)): 1, (6, (13,)): 1, (7, ()): 1})
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert decontam.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def test_network_pools_every_chunk_of_the_document():
    net = quality_cnn.ByteNet(seed=3)
    net.p["out"][:] = 1
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 7, 31, 224, 256, 257, 1000, 5000)]
    together = net.features(texts)
    e, w = net.p["embed"], net.p["filter"]
    for t, got in zip(texts, together, strict=True):
        cells = -(-(len(t) + 8) // 32)
        raw = np.frombuffer(t.ljust(cells * 32, b"\0"), np.uint8)
        z = np.stack([e[raw[i : i + 8]].ravel() @ w for i in range(0, len(raw) - 7, 2)])
        n = max(1, -(-(cells - 1) // 7))
        chunks = [np.maximum(z[k * 112 : k * 112 + 128].max(axis=0) + net.p["bias"], 0) for k in range(n)]
        assert np.allclose(got, np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]), atol=1e-4)
        assert np.allclose(net.features([t])[0], got, atol=1e-5)


def test_network_gradients():
    net = quality_cnn.ByteNet(seed=1)
    r = np.random.default_rng(4)
    net.p["out"] = r.normal(0, 0.3, net.p["out"].shape).astype(np.float32)
    chunks = r.integers(0, 256, (5, quality_cnn.CHUNK + 8)).astype(np.uint8)
    of, y = np.array([0, 0, 1, 1, 1]), np.array([0.0, 1.0], np.float32)

    def loss():
        q = net.p
        x = np.stack([[q["embed"][c[i : i + 8]].ravel() for i in range(0, quality_cnn.CHUNK, 2)] for c in chunks])
        pooled = np.maximum((x @ q["filter"]).max(axis=1) + q["bias"], 0)
        f = np.stack([np.concatenate([pooled[of == d].max(axis=0), pooled[of == d].mean(axis=0)]) for d in (0, 1)]).astype(np.float64)
        s = 1 / (1 + np.exp(-(f @ q["out"] + q["shift"])))
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)) + 0.5e-4 * float((q["out"].astype(np.float64) ** 2).sum())

    g = net._loss_gradients(chunks, of, y)
    for name in ("filter", "bias", "out", "shift", "embed"):
        flat = net.p[name].reshape(-1)
        for k in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(float(g[name].reshape(-1)[k]), rel=0.1, abs=2e-4), name


def test_scores_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_network(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    import zlib

    assert [bool(h) for h in got["held_out"]] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    held = got[got["held_out"] & got["quality"].notna()]
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.93 and (good >= 0.7).mean() > 0.95


def test_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    p = quality_cnn.train(docs, labels).p
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    scores = {r.doc_id: r.score for r in queries.op8_quality_network(spark, SF).collect()}
    assert set(scores) == set(texts)
    for i in sorted(texts)[:60]:
        t = texts[i]
        cells = -(-(len(t) + 8) // 32)
        e = p["embed"][np.frombuffer(t.ljust(cells * 32, b"\0"), np.uint8)]
        z = np.stack([e[k : k + 8].ravel() @ p["filter"] for k in range(0, len(e) - 7, 2)])
        chunks = [np.maximum(z[k * 112 : k * 112 + 128].max(axis=0) + p["bias"], 0) for k in range(max(1, -(-(cells - 1) // 7)))]
        x = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ p["out"] + p["shift"][0]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-3)


def test_very_long_text_in_bounded_memory():
    net = quality_cnn.ByteNet(seed=3)
    raw = np.random.default_rng(0).integers(32, 127, 64 << 20, dtype=np.uint8).tobytes()
    net.score([raw[:1000]])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= net.score([raw])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_repeated_rows_do_not_push_out_a_class(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 4000)
    rows = [(1, "good words here")] * 3000 + [(k, ("bad %% " if k % 2 else "fine words ") * 8) for k in range(2, 40)] + [(99, "z" * 9000)]
    labels = spark.createDataFrame([(1, 1, 0), (99, 1, 0), *((k, int(k % 2 == 0), 0) for k in range(2, 40))], "doc_id long, quality int, toxic int")
    net = quality_cnn.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    good, bad = net.score([b"fine words " * 8, b"bad %% " * 8])
    assert good > 0.5 > bad


def test_score_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "abc " * 50_000), (1, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (77, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_cnn.quality_scores(df, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert quality_cnn.quality_scores(df, labels.limit(0)).count() == 5 and quality_cnn.quality_scores(df.limit(0), labels).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    docs = docs.withColumn("row", F.lit("clash"))
    for name, stage in P.STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [*columns, "row"] and 0 < docs.count() <= kept
        kept = docs.count()
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == kept
    assert sorted(map(tuple, P.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, pieces.drop("sequence_id", "offset").collect()))



@pytest.mark.parametrize("large", [4096, 3])
def test_near_duplicates_at_the_edge_of_the_contract(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    r = random.Random(11)
    pool = [f"w{i}" for i in range(50_000)]
    rows, edge, below = [], 400, 200
    # 76 of 95 distinct shingles are shared: exactly 0.8; 75 of 99: 0.76
    for k in range(edge + below):
        a = [r.choice(pool) for _ in range(89)]
        common, more = (76, (9, 10)) if k < edge else (75, (12, 12))
        for m in more:
            rows.append((len(rows), " ".join(a[: common + 4] + [r.choice(pool) for _ in range(m)])))
    # a chain: each is near the next only, and repeats do not count
    a = [r.choice(pool) for _ in range(200)]
    rows += [(5000 + k, " ".join(a[15 * k : 15 * k + 140])) for k in range(5)]
    rows += [(6000, "on and on we go " * 30), (6001, "on and on we go " * 3)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [k for k in range(edge) if 2 * k + 1 not in kept]
    assert len(linked) >= 0.98 * edge and all(2 * k in kept for k in range(edge))
    assert all(2 * k in kept and 2 * k + 1 in kept for k in range(edge, edge + below))
    assert {i for i in kept if i >= 5000} == {5000, 6000}
    n = 2**18
    bits, tables = simhash.sample_plan(n)
    assert bits == 13 and tables < 80
