import random
import resource
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.session import fresh_path
from voxlake.llm import common, packing, queries, token_bin, token_count, tokenizing

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, id long, length long, start string"
PARTS = ["a", "Bé", " ", "\n", "'s", "\t", "12", "_", "%%", "中", "\u2003", "\x1c", "<|endoftext|>", "’", "²", "ß", "e\u0301", "\xa0", " the", "don't", ".,", "▁", "<0x0A>", "<unk>", "</s>", "龘", "𐍈"]


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(4000)]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def edge_rows(spark):
    long = "word " * 6000
    return spark.createDataFrame([(3, "b c", 9, 9, "x"), (1, None, 9, 9, "x"), (2, "", 9, 9, "x"), (None, "z", 9, 9, "x"), (5, long, 9, 9, "x"), (3, "b c", 9, 9, "x"), (3, "other", 9, 9, "x")], DOCS)


def test_encoder_equals_the_library(odd, texts):
    e = tokenizing.BpeEncoder(BPE)
    rows = [*odd, None, "", "\n", " ", "a\tb c", "\tx", "\t\tx", "x\t", "a \u3000b", *texts.values()]
    random.Random(1).shuffle(rows)
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert [e.encode(t).tolist() for t in rows] == want
    for lo, hi in ((0, 7), (7, 900), (900, len(rows))):
        for _ in range(2):  # the second time from the table
            ids, sizes = e.encode_all(pa.array(rows[lo:hi], pa.string()), 7)
            cuts = np.cumsum(sizes)
            assert [x.tolist() for x in np.split(ids, cuts[:-1])] == [[*w, 7] for w in want[lo:hi]]
    assert e.encode_all(pa.array([], pa.string()))[0].tolist() == []


def test_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(common.WordTable, "WORDS", 100)
    e = tokenizing.BpeEncoder(BPE)
    r = random.Random(2)
    rows = [" ".join(r.choice(["the", "of"]) if r.random() < 0.5 else "".join(r.choices("abcdé,", k=r.randint(1, 9))) for _ in range(200)) for _ in range(60)]
    for lo in range(0, 60, 6):
        ids, _ = e.encode_all(pa.array(rows[lo : lo + 6]))
        assert ids.tolist() == [i for t in rows[lo : lo + 6] for i in e.tokenizer.encode(t, add_special_tokens=False).ids]
        assert len(e.table.words) <= 1200
    assert {"the", "of"} <= set(e.table.words.to_pylist())


def test_text_without_spaces_stays_in_bounds():
    """100,000 texts that are one word of 500 letters each: nothing of them is kept."""
    e = tokenizing.BpeEncoder(BPE)
    r = random.Random(4)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(20):
        rows = pa.array(["".join(map(chr, r.choices(range(0x4E00, 0x4F00), k=500))) for _ in range(250)])
        for _ in range(20):
            assert len(e.encode_all(rows)[0])
    assert len(e.table.words) == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_counts_equal_the_library(odd, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = token_count.counter(path), token_count.reference(path)
    rows = [None, "", " ", "  ", "▁", *odd, *texts.values()]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in rows]
    for lo, hi in ((0, 3), (3, 600), (600, len(rows)), (0, 600)):
        assert ours.texts(pa.array(rows[lo:hi])).tolist() == want[lo:hi]


def test_count_ties_and_unknown_runs():
    from tokenizers import models, pre_tokenizers

    r = random.Random(5)
    for fallback in (False, True):
        pieces = [("<unk>", 0.0), ("▁", -1.0)] + [(x, -float(r.randint(1, 4))) for x in ("a", "b", "ab", "ba", "aab", "▁a", "▁ab", "bb", "abab")]
        if fallback:
            pieces += [(f"<0x{b:02X}>", -5.0) for b in range(256)]
        library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        ours = token_count.UnigramCounter(pieces, 0, fallback)
        for _ in range(3000):
            t = "".join(r.choice("aabb cé") for _ in range(r.randint(0, 14)))
            assert ours.texts(pa.array([t])).tolist() == [len(library.encode(t).ids)], t


def test_count_query(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = token_count.reference(path)
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, SF).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    out = token_count.token_counts(edge_rows(spark), path)
    assert out.columns == ["doc_id", "n_tokens"] and out.count() == 7 and out.where("doc_id in (1, 2)").agg(F.sum("n_tokens")).first()[0] == 0
    assert token_count.token_counts(edge_rows(spark).limit(0), path).count() == 0


def test_fullest_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(1, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        got = packing.fullest(counts, room)
        assert sum(x * k for x, k in got) == max(sums) and all(k <= counts[x] for x, k in got)


def test_patterns_use_everything_once():
    r = random.Random(2)
    counts = {r.randint(1, 2048): r.randint(1, 50) for _ in range(300)}
    found = packing.patterns(dict(counts), 2048)
    used: dict[int, int] = {}
    for times, chosen in found:
        assert sum(x * k for x, k in chosen) <= 2048
        for x, k in chosen:
            used[x] = used.get(x, 0) + times * k
    assert used == counts
    total = sum(x * n for x, n in counts.items())
    assert sum(t for t, _ in found) <= -(-total // 2048) * 1.05 + 1


def check_packing(rows, texts):
    tok = Tokenizer.from_file(BPE)
    ids = [(k, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for k, t in texts]
    want = []
    for k, x in ids:
        first = len(x) if len(x) <= 2048 else (len(x) % 2048 or 2048)
        cuts = [0, *range(first, len(x) + 1, 2048)] if len(x) > 2048 else [0, len(x)]
        want += [(k, i, a, b - a, zlib.crc32(x[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda v: tuple((x is None, x) for x in v)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    return len(bins), -(-sum(r.length for r in rows) // 2048)


def test_packing_query(spark, texts, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    n, least = check_packing(queries.op2_best_fit_packing(spark, SF).collect(), list(texts.items()))
    assert n <= least * 1.05 + 1
    df = edge_rows(spark)
    out = packing.pack_documents(df, BPE)
    check_packing(out.collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert packing.pack_documents(df.limit(0), BPE).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq

    r = np.random.default_rng(1)
    for n in (2, 3, 17, 400):
        counts = r.integers(1, 1000, n)
        heap = list(map(int, counts))
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert int((counts * token_bin.code_lengths(counts, 24)).sum()) == cost
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    lengths = token_bin.code_lengths(fib, 5)
    assert lengths.max() == 5 and (2.0 ** -lengths.astype(float)).sum() <= 1
    assert token_bin.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_code_round_trip():
    r = np.random.default_rng(2)
    for n in (1, 2, 300, 50257):
        lengths = token_bin.code_lengths(r.integers(1, 10**6, n) ** 2 // 10**6 + 1)
        code = token_bin.Code(lengths)
        sizes = r.integers(1, 900, 40)
        ids = r.integers(0, n, sizes.sum())
        coded, marks = code.encode(ids, sizes)
        count, stretch = token_bin._stretches(sizes)
        bytes_ = np.array([len(c) for c in coded])
        begin = np.repeat((np.cumsum(bytes_) - bytes_) * 8, count) + np.frombuffer(b"".join(marks), "<u4").astype(np.int64)
        assert np.array_equal(code.decode(b"".join(coded), begin, stretch), ids)


def test_token_files(spark, texts, monkeypatch):
    monkeypatch.setattr(token_bin, "FILE_TOKENS", 20_000)
    monkeypatch.setattr(token_bin, "BLOCK_TOKENS", 5_000)
    tok = Tokenizer.from_file(BPE)

    def want(rows):
        at, out = 0, []
        for k, t in rows:
            x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            out.append((k, at, len(x), zlib.crc32(x.tobytes())))
            at += len(x)
        return out

    got = [tuple(r) for r in queries.op3_token_files(spark, SF).orderBy("doc_id").collect()]
    assert got == want(sorted(texts.items()))
    df = edge_rows(spark)
    out = sorted((tuple(r) for r in token_bin.token_files_round_trip(df, BPE).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None, 1, 2, 3, 3, 3, 5]
    monkeypatch.setattr(token_bin, "FILE_TOKENS", 40)
    same = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words here").alias("text")).repartition(3)
    folder = fresh_path(spark, "t")
    files = token_bin.write_token_files(same, folder, BPE, 2)
    assert files.count() > 10 and files.agg(F.max("n_docs")).first()[0] < 100
    back = sorted(r.start for r in token_bin.read_token_files(files, folder).collect())
    assert back == [4 * k for k in range(400)]
    assert sorted((r[2], r[3]) for r in out) == sorted((w[2], w[3]) for w in want([(r.doc_id, r.text) for r in df.collect()]))
    assert [r[1] for r in out] == np.cumsum([0, *(r[2] for r in out)])[:-1].tolist()
    assert token_bin.token_files_round_trip(df.limit(0), BPE).count() == 0
