"""Token files, ranked lexical search and hard negatives: round trips, brute force, odd inputs."""

import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkfield.llm import hard_negatives as hn
from larkfield.llm import lexical, token_files
from larkfield.llm.queries import ORACLES, QUERIES
from larkfield.llm.token_ids import IdEncoder, id_encoder
from tools.compare import compare, connect

CLASH = ("doc", "place", "n", "ids", "start", "number", "item", "norm", "terms", "mark", "id", "parts", "asks", "anchor", "window", "score", "rank", "size")


def clashing(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in df.columns))


# ----------------------------------------------------------------- token files

ALPHABET = [" ", "  ", "\n", "\t", "\x1c", "\x1f", " ", "　", "a", "Bc", "é", "1", "<|endoftext|>", "'s", "'ll", "!", "\r\n", "\x85", "😀", "ñó", "٣",
            "ж", "ª", "²", "×", "ɏɐ", "...", "-", "(x)", "_", "'", "\u0301", "Ⅷ", "\u200b", "ǅ", "0"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), max_size=4))
def test_chunked_ids_are_the_library_s(texts):
    encoder = id_encoder()
    assert encoder.of(texts) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(IdEncoder, "room", 5)
    texts = [f"word{i} other{i % 3} {'z' * 60}{i}" for i in range(40)]
    encoder = id_encoder()
    assert list(encoder.stream(texts, most=30)) == encoder._encoded(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70), st.sampled_from([1, 8]))
def test_planes_give_the_ids_back(ids, bits):
    ids = np.array(ids, "<u4")
    planes = token_files.planes_of(ids, bits)
    assert len(planes) == 32 // bits and (token_files.ids_of(planes, len(ids), bits) == ids).all()


def test_small_ids_leave_planes_empty():
    assert [bool(p) for p in token_files.planes_of(np.array([50256, 7], "<u4"), 8)] == [True, True, False, False]


def expected_ids(rows):
    """Per row, in order of id (null first): id, start, ids."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = id_encoder().tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, ids))
        start += len(ids)
    return out


def token_rows():
    rng = random.Random(5)
    rows = [(i * 7 - 90, " ".join(rng.choices(["alpha", "beta", "Straße", "\n", "12", "<|endoftext|>", "δ"], k=rng.randint(0, 60)))) for i in range(60)]
    return rows + [(1000, "long " * 9000), (None, "no id"), (2000, None), (2001, ""), (9 * 10**18, "far"), (-9 * 10**18, "near")]


@pytest.mark.parametrize("planes, block, roll, parts", [("byte", 64, 500, 5), ("bit", 40, 1 << 20, 3), ("byte", 1 << 16, 1, 4)])
def test_token_files_read_back(spark, tmp_path, planes, block, roll, parts):
    rows, folder = token_rows(), f"file://{tmp_path}/f"
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    manifest = token_files.write_token_files(df, folder, planes=planes, block_ids=block, roll_ids=roll, parts=parts).collect()
    expected = expected_ids(rows)
    assert sum(m.ids for m in manifest) == sum(len(x[2]) for x in expected) and sum(m.docs for m in manifest) == len(rows)
    got = token_files.read_token_files(spark, folder, ids=True).collect()
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(((r.doc_id, r.start, r.ids) for r in got), key=key) == expected
    crcs = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got}
    assert crcs == {d: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, _, i in expected}
    some = token_files.read_token_files(spark, folder, ids=True, low=0, high=100).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in some) == [x for x in expected if x[0] is not None and 0 <= x[0] <= 100]
    store = token_files.filesystems.LocalFileSystem()
    for m in manifest:
        reader = token_files.PlaneReader(store, f"{tmp_path}/f/{m.file}")
        whole = reader.ids(0, m.ids)
        for low, high in ((0, 0), (0, 1), (m.ids // 3, m.ids // 2), (m.ids - 1, m.ids)):
            assert (reader.ids(low, high) == whole[low:high]).all()


def test_repeated_ids_and_rows_all_stay(spark, tmp_path):
    rows = [(1, "same text")] * 40 + [(1, "other")] * 3 + [(0, "first")]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/f", parts=4)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/f").orderBy("start").collect()
    assert len(got) == 44 and got[0].doc_id == 0 and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_empty_table_and_broken_files(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write_token_files(empty, f"file://{tmp_path}/e").count() == 0
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0
    token_files.write_token_files(spark.createDataFrame([(1, "some words " * 50)], "doc_id long, text string"), f"file://{tmp_path}/f", parts=1)
    path = next(pathlib.Path(tmp_path, "f").glob("*.planes"))
    data = bytearray(path.read_bytes())
    data[12] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception):
        token_files.read_token_files(spark, f"file://{tmp_path}/f").collect()


def test_files_of_lost_attempts_go(spark, tmp_path):
    folder = pathlib.Path(tmp_path, "f")
    folder.mkdir()
    (folder / "ids-000000-00000-lost.planes").write_bytes(b"half")
    token_files.write_token_files(spark.createDataFrame([(1, "x")], "doc_id long, text string"), f"file://{folder}")
    assert len(list(folder.glob("*.planes"))) == 1


def test_token_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op11_plane_token_files"](spark, folder).collect()}
    assert got == {d: (s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in expected_ids(rows)}


# ------------------------------------------------------------------ ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    counts = [(d, folded(t)) for d, t in docs]
    n, total = sum(1 for _, w in counts if w), sum(len(w) for _, w in counts)
    out = []
    for item, text in items:
        rows, terms = [], set(folded(text))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in set(w) for _, w in counts) + 1))) for t in terms}
        for doc, words in counts:
            if words:
                m = 10 + 90 * len(words) * n // total
                score = sum(weight[t] * (10**9 * words.count(t) // (1000 * words.count(t) + 8 * m)) for t in terms if t in words)
                rows += [(score, doc)] * (score > 0)
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        out += [(item, i + 1, doc, score) for i, (score, doc) in enumerate(rows[:k])]
    return sorted(out)


def search_rows(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(90)] + ["Ümlaut", "ÜMLAUT", "x_y", "a-b", "É1", "日本"]
    text = lambda most: rng.choice([" ", "\n", "\t", "--"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, most)))
    docs = [(i, text(80)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, " .,! "), (n + 3, "w1 " * 3000)]
    docs += [(1000 + i, "w3 w70 w71 copy") for i in range(60)]
    return docs, [(i, text(12)) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere seen"), (93, "w70 W71 w70 copy")]


@pytest.mark.parametrize("seed, k, bucket, block", [(1, 10, 16, 100), (2, 3, 7, 4), (3, 10, 8192, 1)])
def test_ranked_search_is_exact(spark, seed, k, bucket, block):
    docs, items = search_rows(seed)
    got = lexical.ranked_search(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)),
                                clashing(spark.createDataFrame(items, "item_id long, text string")), k=k, bucket=bucket, block_items=block)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == ranked(docs, items, k)


def test_null_and_repeated_ids_of_documents(spark):
    docs, items = [(None, "rare word"), (5, "rare word"), (5, "rare word"), (3, "rare word"), (9, "else")], [(1, "rare"), (1, "rare"), (None, "word")]
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    rows = sorted(((r.item_id or 0, r.rank, r.doc_id) for r in got.collect()), key=str)
    assert rows == sorted([(i, r, d) for i in (0, 1, 1) for r, d in ((1, None), (2, 3), (3, 5))], key=str)


def test_searches_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).collect() == []


def test_impacts_beyond_64_bits():
    big = lexical.impact(np.array([5]), np.array([2]), np.array([10**9]), 10**12, 10**13)
    assert big[0] == 5 * (2 * 10**9 // (2000 + 8 * (10 + 90 * 10**21 // 10**13)))


def test_buckets_are_passed_over(monkeypatch):
    """Short vectors can't reach the floor of an item, so no bucket is built for them."""
    import pyarrow as pa
    rows = [(i, float(n), [0, 1], [n, 0]) for i, n in enumerate([100, 90, 80, 3, 2, 1])]
    cols = list(zip(*rows))
    batch = pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int64()))],
                                       ["doc", "norm", "terms", "impacts"])
    built = []
    real = lexical.Bucket.__init__
    monkeypatch.setattr(lexical.Bucket, "__init__", lambda self, *a: (built.append(1), real(self, *a))[1])
    out = list(lexical._searched([np.array([0])], [0], 2, 3, 3)(iter([batch])))[0].to_pydict()
    assert out["doc"] == [0, 1, 2] and len(built) == 1


# ----------------------------------------------------------------- hard negatives

def mined(rows, positives=5, negatives=10):
    fit = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(fit):
        if i is None or i % 100:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        others = [(score(w), j, own) for b, (j, own, w) in enumerate(fit) if b != a and len(w) == len(v)]
        for p, j, _ in sorted((o for o in others if o[2] == label), key=key)[:positives]:
            window = [o for o in others if o[2] != label and 30 * p <= 100 * o[0] <= 90 * p]
            out += [(i, j, r + 1, n, p, s) for r, (s, n, _) in enumerate(sorted(window, key=key)[:negatives])]
    return sorted(out, key=str)


def vector_rows(seed, n=500, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + rng.normal(size=dims) * 0.7], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(150)]  # copies
    rows += [(2000, None, 1), (2001, [None] * dims, 1), (2100, [float("nan")] * dims, 1), (2200, [float("inf")] + [0.0] * (dims - 1), 1),
             (2300, [0.0] * dims, 2), (2400, rows[0][1], None), (2500, [1.0, 2.0], 1), (2501, [1.0, 2.5], 1), (2502, [1.0, 1.0], 3), (2600, [], 1), (2601, [], 2),
             (None, rows[0][1], 0), (None, rows[0][1], 2)]
    return rows


@pytest.mark.parametrize("seed, block, limit", [(1, 64, 1 << 25), (2, 37, 9000), (3, 4096, 1 << 25)])
def test_hard_negatives_are_exact(spark, seed, block, limit):
    rows = vector_rows(seed)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, block=block, round_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows)


def test_very_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i * 3), float(-(2**19) + i)], i % 2) for i in range(20)]
    got = hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0, low=0, high=200)
    first = [r.negative_id for r in got.where("positive_id = 18").orderBy("rank").collect()]
    assert first == [19, 17, 15, 13, 11, 9, 7, 5, 3, 1]


def test_walks_stop_before_the_end():
    """The best rows stand out, so the threshold falls below the k-th score long before the lists end."""
    rng = np.random.default_rng(3)
    values = rng.integers(-20, 20, (2000, 4)).astype(float)
    values[:10] += 4000
    marks = np.arange(2000)
    lists, window = hn.Lists(marks, np.zeros(2000, bool), marks, marks % 3, values), hn.Window(10, None, None)
    assert lists.walk(np.array([3.0, 2.0, 1.0, 5.0]), np.ones(2000, bool), [window]) < 100 and sorted(window.id) == list(range(10))


def test_no_rows_no_negatives(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(empty, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(one, F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("name", ["op12_norm_bucket_search", "op13_threshold_hard_negatives"])
def test_search_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == ""
