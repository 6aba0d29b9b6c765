"""Training-data operators against brute force, round trips and odd inputs: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formcheck.llm import op1_bpe, op2_toxicity, op3_exact_dedup, op4_hilbert_ann, op5_minhash, op6_packing, op7_token_counts, op8_warc, op9_substring_dedup, op10_url_filter
from formcheck.llm.bpe import encoder
from formcheck.llm.components import components

random.seed(7)
LETTERS = "ab  \n\t'sté1²½_漢,.<|>　\x1cć😀Ⅷ٣ "
ODD = [None, "", " ", "x<|endoftext|> y<|endoftext|>", "a" * 3000, "ab" * 2000 + "c", " " * 1500, "\n" * 700 + "x", "thethe" * 200 + "!" * 300, "don't  stop\n \n now"]
RANDOM = ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(400)]
DOCS = "doc_id long, text string, id string, digest string, ids string, n long"


def docs(spark, texts, start=0):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(start + i, t, "x", "y", "z", i) for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def reference_bpe():
    with open(op1_bpe.MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op1_equals_library_and_round_trips(spark, reference_bpe):
    texts = ODD + RANDOM
    rows = {r.doc_id: r for r in op1_bpe.encode_digests(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference_bpe.encode_ordinary(t or ""), "<u4")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = op1_bpe.encode(docs(spark, texts[:30]))
    decoded = {r.doc_id: bytes(r.bytes) for r in op1_bpe.decode(encoded).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts[:30])}
    assert op1_bpe.encode_digests(docs(spark, texts).where("false")).count() == 0


def test_long_pre_tokens_equal_library(reference_bpe):
    known = encoder(op1_bpe.MULTI)
    for n in range(12):
        r = random.Random(n)
        t = "".join(r.choice("aeinth"[: 2 + n % 5]) for _ in range(r.randint(130, 900)))
        assert known([t])[0].tolist() == reference_bpe.encode_ordinary(t)


def test_op7_equals_library(spark):
    library = Tokenizer.from_file(op7_token_counts.JSON)
    texts = ODD + RANDOM + ["word " * 1025]
    rows = {r.doc_id: r for r in op7_token_counts.count_tokens(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def packed(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    padding = total = 0
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, total


def test_op6_pieces_and_sequences(spark):
    library = Tokenizer.from_file(op6_packing.JSON)
    texts = ODD + RANDOM + [" ".join(words(n, n)) for n in (5, 300, 900, 2500)] + ["same text"] * 40
    rows = op6_packing.pack(docs(spark, texts)).collect()
    packed(rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == set(range(len(texts)))
    for i, rs in by.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert op6_packing.pack(docs(spark, texts).where("false")).count() == 0


def test_op6_plan_uses_every_piece_with_little_padding():
    r = random.Random(3)
    histogram = collections.Counter(min(2048, 1 + int(r.expovariate(1 / 500))) for _ in range(20000))
    rows = op6_packing.plan(dict(histogram))
    taken, length_of = collections.Counter(), collections.Counter()
    for length, first, last, per, base, _ in rows:
        assert first == taken[length] and (last - first + 1) % per == 0
        taken[length] += last - first + 1
        for k in range((last - first + 1) // per):
            length_of[base + k] += per * length
    assert taken == histogram and max(length_of.values()) <= 2048
    assert sum(2048 - n for n in length_of.values() if n & (n - 1)) < 0.01 * sum(length_of.values())


def test_op3_against_brute_force_and_later_batches(spark):
    texts = ["A b", "a B", None, "", "É", "é", "x", "x", "x"]
    index = op3_exact_dedup.DigestIndex(spark)
    rows = {r.doc_id: r for r in op3_exact_dedup.mark(docs(spark, texts), index).collect()}
    norm = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    for i, t in enumerate(norm):
        same = [k for k, x in enumerate(norm) if x == t]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept, rows[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    later = {r.doc_id: (r.keep_id, r.kept) for r in op3_exact_dedup.mark(docs(spark, ["a b", "new"], start=100), index).collect()}
    assert later == {100: (1, False), 101: (101, True)}
    again = op3_exact_dedup.mark(spark.createDataFrame([(5, "t"), (5, "t"), (None, "t"), (None, "u")], "doc_id long, text string"), op3_exact_dedup.DigestIndex(spark)).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in again) == [(-1, False), (-1, True), (5, False), (5, True)]
    assert op3_exact_dedup.mark(docs(spark, texts).where("false"), op3_exact_dedup.DigestIndex(spark)).count() == 0


def test_op3_index_batches(spark):
    """Every batch meets the index; a batch tried again changes nothing; compaction leaves one file a bucket."""
    index = op3_exact_dedup.DigestIndex(spark, buckets=3)
    assert index.table().count() == 0
    first = docs(spark, ["a", "b", "b", None])
    tries = [sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in op3_exact_dedup.mark(first, index, batch="one").collect()) for _ in range(2)]
    assert tries[0] == tries[1] == [(0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert index.table().count() == 3
    for k in range(3):
        op3_exact_dedup.mark(docs(spark, [f"x{k}", "A"], start=10 * (k + 1)), index, batch=f"more-{k}").collect()
    before = sorted(index.table().collect())
    index.compact()
    files = spark.table(index.name).inputFiles()
    buckets = [re.search(r"_(\d{5})\.c", f).group(1) for f in files]
    assert sorted(index.table().collect()) == before and len(before) == 6 and len(set(buckets)) == len(buckets), files
    assert [r.kept for r in op3_exact_dedup.mark(docs(spark, ["b", "new"], start=90), index, batch="last").orderBy("doc_id").collect()] == [False, True]
    index.drop()


def test_op3_in_batches_equals_one_batch(spark):
    r = random.Random(8)
    texts = [r.choice("abcdefgh") * r.randint(0, 2) for _ in range(300)]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "a", "", "", "", 0), (None, "only", "", "", "", 0), (7, "again", "", "", "", 0), (7, "again", "", "", "", 0)], DOCS))
    one = sorted(map(str, op3_exact_dedup.mark(df, op3_exact_dedup.DigestIndex(spark)).collect()))
    for batches in (2, 5):
        index = op3_exact_dedup.DigestIndex(spark)
        assert sorted(map(str, op3_exact_dedup.mark_in_batches(df, index, batches).collect())) == one
        assert index.table().select("batch").distinct().count() > 1
    assert op3_exact_dedup.mark_in_batches(df.where("false"), op3_exact_dedup.DigestIndex(spark)).count() == 0


def test_encoder_keeps_a_bounded_number_of_bytes(monkeypatch):
    """Texts without spaces are one pre-token each: none is kept, and what is kept stays below its bound."""
    from formcheck.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_BYTES", 12_000_000)
    known = bpe.Encoder(op1_bpe.MULTI)
    r = random.Random(6)
    letters = "".join(chr(0x4E00 + k) for k in range(3000))
    for _ in range(40):
        known(["".join(r.choices(letters, k=500)) for _ in range(20)])
    assert known.text.n == known.start.n == 0
    for k in range(25):
        known([" ".join(f"w{r.randrange(10**9)}" for _ in range(9000))])
        assert known.text.n + 4 * known.ids.n + bpe.EACH * known.start.n < bpe.KEPT_BYTES + 2_000_000


def test_encoder_survives_equal_hashes(monkeypatch, reference_bpe):
    """Pre-tokens that share a hash are told apart by their bytes."""
    from formcheck.llm import bpe

    monkeypatch.setattr(bpe, "span_hashes", lambda values, start, end: (end - start).astype(np.uint64))
    texts = ["cat dog catalogue cat", "owl cat", "dog"]
    ids, sizes = bpe.Encoder(op1_bpe.MULTI)(texts)
    want = [reference_bpe.encode_ordinary(t) for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_op1_op7_repeated_rows_null_ids_and_other_patterns(spark, reference_bpe):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (3, "d e f")], "doc_id long, text string")
    counted = sorted(((r.doc_id or -1), r.n_tokens) for r in op7_token_counts.count_tokens(rows).collect())
    assert counted == sorted(((r.doc_id or -1), r.n_tokens) for r in op1_bpe.encode_digests(rows).collect()) == [(-1, 2), (-1, 2), (3, 1), (3, 1), (3, 3)]
    assert op7_token_counts.count_tokens(rows.where("false")).count() == 0
    ids, sizes = encoder(op1_bpe.MULTI, r"\\s+|\\S+".replace("\\\\", "\\"))(["two  words é", "", "x"])
    assert sizes[1] == 0 and sizes.sum() == len(ids) and encoder(op1_bpe.MULTI).decode(ids) == "two  words éx".encode()


def test_op4_recall_of_narrow_windows(spark):
    """20,000 vectors without structure, a third of them equal: windows hold a few per cent of an ordering."""
    r = np.random.default_rng(4)
    x = r.normal(size=(20000, 24))
    x[r.permutation(20000)[:6600]] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for row in op4_hilbert_ann.knn(df, F.col("vec_id") % 200 == 0).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    n, hit, asked = np.linalg.norm(x, axis=1), 0, 0
    for q in range(0, 20000, 200):
        cos = x @ x[q] / (n * n[q])
        cos[(x == x[q]).all(axis=1)] = 1
        cos[q] = -9
        want = np.lexsort((np.arange(20000), -cos))[:5].tolist()
        if (x[q] == x[0]).all():
            assert got[q] == want
        else:
            asked, hit = asked + 1, hit + len(set(got[q]) & set(want))
    assert hit / (5 * asked) >= 0.9


def test_op4_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [-1.0, 0.0])]
    out = op4_hilbert_ann.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [2, 3, 4] and out[0].score == out[1].score > 0.99 and abs(out[2].score) < 1e-12


def test_op4_recall_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 16))
    x[10:40] = x[9]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0), (2004, [1.0] * 3, 0), (2005, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query int")
    got = collections.defaultdict(list)
    for row in op4_hilbert_ann.knn(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    assert got.keys() == set(range(0, 900, 10))
    n = np.linalg.norm(x, axis=1)
    hit = 0
    for q, found in got.items():
        cos = x @ x[q] / (n * n[q])
        cos[q] = -9
        hit += len({v for v, _ in found} & set(np.lexsort((np.arange(900), -cos))[:5].tolist()))
        assert all(abs(s - cos[v]) < 1e-12 for v, s in found) and len(found) == 5
    assert hit / (5 * len(got)) >= 0.9
    assert [v for v, _ in got[20]] == [9, 10, 11, 12, 13]
    assert op4_hilbert_ann.knn(df.where("false"), F.lit(True)).count() == 0
    assert sorted((r.query_id, r.vec_id) for r in op4_hilbert_ann.knn(df.where("vec_id < 3"), F.lit(True)).collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_hilbert_keys_are_a_path():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    path = side[np.argsort(op4_hilbert_ann.hilbert(side, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def near_brute_force(texts, size):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        w = split.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


@pytest.mark.parametrize("size", [4, 5])
def test_op5_against_brute_force(spark, size):
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "x " * 4000]
    base = words(120, 1)
    for k in range(60):  # a chain and cloud of near copies
        own = list(base)
        for p in random.Random(k).sample(range(120), k % 6):
            own[p] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [" ".join(words(80, 100 + k) + base[:30]) for k in range(30)] + [" ".join(base)] * 5 + ["été à la  mer"] * 2
    rows = {r.doc_id: r for r in op5_minhash.near_duplicates(docs(spark, texts), shingle=size).collect()}
    sets, root = near_brute_force(texts, size)
    assert {i: (rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in rows} == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}


def test_op5_repeated_ids_with_different_texts(spark):
    """Each row belongs to the class of its own text; the same result in any order of the rows."""
    base, other = words(100, 1), words(100, 2)
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, " ".join([*base[:-1], "x"])), (3, " ".join(other)), (4, " ".join(words(100, 3)))]
    outs = [sorted((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in op5_minhash.near_duplicates(spark.createDataFrame(x, "doc_id long, text string")).collect()) for x in (rows, rows[::-1])]
    assert outs[0] == outs[1] and {(3, 96, 1, 1), (4, 96, 4, 4)} <= set(outs[0]) and len(outs[0]) == 5


def test_op5_empty_and_null_ids(spark):
    assert op5_minhash.near_duplicates(docs(spark, ["a"]).where("false")).count() == 0
    rows = op5_minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")).collect()
    assert [r.kept for r in rows] == [True] * 3


def test_late_links_split_blocks(spark):
    """Members of one bucket in several blocks: links across blocks are found, those within a component skipped."""
    texts = [" ".join(words(60, 5) + [f"w{k // 2}"] * (k % 3)) for k in range(24)]
    frame = docs(spark, texts).select(F.col("doc_id").alias("id"), "text")
    reps = op5_minhash.signatures(frame, 4).select("id", "s1", "s2", "signature").cache()
    full = op5_minhash.full_sets(frame, reps, reps.select("id"), 4)
    first = op5_minhash.bands(reps).groupBy("band").agg(F.collect_list("id").alias("ids")).orderBy(F.size("ids").desc(), "band").first()
    members = spark.createDataFrame([(first.band, i, i, len(first.ids)) for i in first.ids], "band long, id long, component long, size long")
    links = [(r.a, r.b) for r in op5_minhash.late_links(members, reps, full, 80, block=7).collect()]
    assert all(a < b for a, b in links)
    sets, _ = near_brute_force(texts, 4)
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in links)


def test_components(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(5, 60), (60, 61), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[k] == 10 for k in range(10, 41)) and out[61] == out[60] == out[5] == 5


def test_components_of_a_star(spark):
    """One node with 100,000 links, and one label of all of them: hot keys of both joins."""
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    out = components(star.union(spark.createDataFrame([(200_000, 200_001)], "a long, b long")))
    assert {(r.component, r["count"]) for r in out.groupBy("component").count().collect()} == {(0, 100_001), (200_000, 2)}


def test_op8_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 10, "<p>a</p>", "long " * 30000]
    rows = [(i, f"http://h/{i}\r\nX: y", h, "clash", "clash") for i, h in enumerate(html)] + [(20, None, "only", "c", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string, id string")
    path = str(tmp_path / "warc")
    op8_warc.write_archive(df, path)
    out = {r.page_id: r for r in op8_warc.archive_summary(spark, path).collect()}
    first: dict = {}
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        f = first.setdefault(data, i)
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if f == i else ("revisit", f))
    records = op8_warc.read_archive(spark, path).collect()
    assert len(records) == len(rows) and {bytes(r.content).decode() for r in records if r.content is not None} == {(h or "") for h in html} | {"only"}
    assert all(bytes(r.header).startswith(b"WARC/1.1\r\n") and bytes(r.header).endswith(b"\r\n\r\n") for r in records)
    assert spark.read.parquet(f"{path}/payloads").count() == len(first)


def test_materialise_sends_small_batches_and_restores_the_setting(spark):
    import pyarrow as pa

    from formcheck.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows] if b.num_rows else [], pa.int64())})

    before = spark.conf.get(common.BATCH_SETTING)
    rows = common.materialise(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "batches").collect()
    assert sum(r.n for r in rows) == 5000 and max(r.n for r in rows) <= common.BATCH_ROWS and spark.conf.get(common.BATCH_SETTING) == before


def test_op9_passages(spark):
    passage = words(60, 900)
    texts = [" ".join(words(90, k)) for k in range(12)]
    texts += [" ".join(words(50, 50 + k) + passage + words(40, 80 + k)) for k in range(6)]
    texts += [None, "", "w " * 30000, "short line"]
    df = docs(spark, texts)
    spans = {r.doc_id: r for r in op9_substring_dedup.duplicate_spans(df).collect()}
    assert set(spans) == set(range(13, 18)) and all(r.sources == [12] for r in spans.values())
    out = {r.doc_id: r for r in op9_substring_dedup.remove(df).collect()}
    assert len(out) == len(texts) and set(df.columns) == set(op9_substring_dedup.remove(df).columns)
    for i, t in enumerate(texts):
        if i in spans:
            assert " ".join(passage) not in out[i].text and " ".join(words(50, 50 + i - 12)) in out[i].text and " ".join(words(40, 80 + i - 12)) in out[i].text
        else:
            assert out[i].text == t
    assert op9_substring_dedup.remove(df.where("false")).count() == 0


def test_op9_against_a_plain_chunker(spark):
    """Chunks cut by a plain loop over words, copies found in a dictionary: the same spans."""
    import pyarrow as pa

    passage = words(80, 40)
    texts = [" ".join(words(60, k) + (passage[k : 60 + k] if k % 2 else []) + words(20, 70 + k)) for k in range(12)] + ["x y " * 40, None, ""]
    gear = op9_substring_dedup.GEAR.tolist()
    owner, cut = {}, []
    for i, t in enumerate(texts):
        data = (t or "").encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        value = []
        for a, b in spans:
            at = min(a + 4, b)
            value.append(sum(gear[data[at - 1 - j]] << j for j in range(min(at, op9_substring_dedup.GEAR_BYTES))) & 0xFFFFFFFF)
        begin = [0]
        for k in range(1, len(spans)):
            low = [value[j] for j in range(max(0, k - 4), k)], [value[j] for j in range(k + 1, min(len(spans), k + 5))]
            if (all(value[k] < v for v in low[0]) and all(value[k] <= v for v in low[1])) or (k - begin[-1]) % op9_substring_dedup.LONGEST == 0:
                begin.append(k)
        own = []
        for a, b in zip(begin, [*begin[1:], len(spans)], strict=True):
            if a < b:
                start, end = spans[a][0], spans[b][0] if b < len(spans) else len(data)
                own.append((start, end, b - a, data[start:end].rstrip()))
                owner.setdefault(own[-1][3], i)
        cut.append(own)
    got = op9_substring_dedup.chunk(pa.array([t or "" for t in texts]))
    assert [(int(r), int(s), int(e), int(w)) for r, _, s, e, w in zip(*got, strict=True)] == [(i, s, e, w) for i, own in enumerate(cut) for s, e, w, _ in own]
    want = {}
    for i, own in enumerate(cut):
        stretches, last = [], None
        for k, (start, end, size, content) in enumerate(own):
            if owner[content] < i:
                if last == k - 1 and stretches:
                    stretches[-1] = (stretches[-1][0], end, stretches[-1][2] + size)
                else:
                    stretches.append((start, end, size))
                last = k
        if long := [s for s in stretches if s[2] >= op9_substring_dedup.LEAST]:
            want[i] = ([s[0] for s in long], [s[1] for s in long])
    found = {r.doc_id: (r.starts, r.ends) for r in op9_substring_dedup.duplicate_spans(docs(spark, texts)).collect()}
    assert found == want and len(want) >= 4


def test_op9_chunks_do_not_depend_on_the_batch(spark):
    import pyarrow as pa

    texts = [" ".join(words(70, k)) for k in range(5)] + ["", "é à ü " * 40]
    alone = [[c.tolist() for c in op9_substring_dedup.chunk(pa.array([t]))[1:]] for t in texts]
    together = op9_substring_dedup.chunk(pa.array(texts))
    for i, one in enumerate(alone):
        mine = together[0] == i
        assert [c[mine].tolist() for c in together[1:]] == one


def test_op10_rules_and_held_out_accuracy(spark):
    r = random.Random(4)
    good, bad = ["news", "garden", "library", "school"], ["casino", "bets", "pills", "spam"]
    urls = []
    for _ in range(1500):
        listed, fine = r.random() < 0.6, r.random() < 0.5
        word = r.choice(good if fine else bad)
        host = ("good.test" if fine else "bad.test") if listed else "other.test"
        urls.append((f"https://{word}{r.randrange(50)}.{host}/{word}/{r.randrange(900)}", fine, listed))
    df = spark.createDataFrame([(i, u, "h", "t") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, host string, text string")
    rules = [("allow", "good.test", "/"), ("block", "bad.test", "/")]
    out = {x.page_id: x for x in op10_url_filter.judge(df, rules=rules).collect()}
    open_ = [i for i, (_, _, listed) in enumerate(urls) if not listed]
    assert all(out[i].rule is None for i in open_)
    assert sum((out[i].verdict == "allow") == urls[i][1] for i in open_) > 0.9 * len(open_)


def test_op10_reads_the_whole_url(spark):
    r = random.Random(11)
    words = {"allow": ["garden", "library"], "block": ["casino", "pills"]}
    urls = []
    for kind, host in (("allow", "good.test"), ("block", "bad.test")):
        for _ in range(300):
            tail = f"{r.choice('?#')}{r.choice(words[kind])}{r.randrange(90)}"
            urls.append(f"{r.choice(['https', 'http'])}://{host}/p{tail}")
    told = ["https://other.test/p?garden7", "https://other.test/p?casino7", "https://other.test/p#library8", "https://other.test/p#pills8", "other.test/garden9", "other.test/casino9"]
    pages = spark.createDataFrame(list(enumerate([*told, None, "", *urls])), "page_id long, url string")
    rows = {x.page_id: x for x in op10_url_filter.judge(pages, rules=[("allow", "good.test", "/"), ("block", "bad.test", "/")]).collect()}
    assert [rows[i].verdict for i in range(6)] == ["allow", "block"] * 3
    assert len({rows[i].score for i in range(6)}) == 6 and rows[6].score == rows[7].score == 0


def test_op10_parsing_and_longest_rule(spark):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "https://example.net/de", "https://example.com/de/1", "ftp://x.org/fr/", "nohost", None, "", "http://net", "http://h.net?x=/en/", "https://badexample.com/de/", "http://a/b://c"]
    rows = {r.page_id: r for r in op10_url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    got = [(rows[i].host, rows[i].path, rows[i].rule) for i in range(len(urls))]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/de", "net/"), ("example.com", "/de/1", "example.com/de/"), ("x.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None),
        ("", "", None), ("net", "", None), ("h.net", "", None), ("badexample.com", "/de/", None), ("a", "/b://c", None),
    ]
    assert all(r.verdict in ("allow", "block") for r in rows.values())
    assert op10_url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_op10_model_against_brute_force(spark):
    import math

    texts = [("aba", 1, 0), ("abb", 0, 1), ("ba", 2, 0)]
    order, s = 2, 2.0
    counts: dict = collections.defaultdict(lambda: [0, 0])
    for t, a, b in texts:
        padded = op10_url_filter.START * order + t
        for i in range(len(t)):
            counts[padded[i : i + order + 1]][0] += a
            counts[padded[i : i + order + 1]][1] += b
    frame = spark.createDataFrame([(g, *n) for g, n in counts.items()], "gram string, accepted long, rejected long")
    scores = {r.gram: r.score for r in op10_url_filter.window_scores(frame, order, s).collect()}
    alphabet = len({g[-1] for g in counts})

    def p(gram, kind):
        below = 1 / (alphabet + 1) if len(gram) == 1 else p(gram[1:], kind)
        n = sum(v[kind] for g, v in counts.items() if g.endswith(gram))
        m = sum(v[kind] for g, v in counts.items() if g[:-1].endswith(gram[:-1]))
        return (n + s * below) / (m + s)

    for g, v in scores.items():
        assert abs(v - (math.log(p(g, 0)) - math.log(p(g, 1)))) < 1e-9


def test_op2_held_out_and_odd_rows(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic, junk = r.random() < 0.2, r.random() < 0.1
        w = words(40, 1000 + i) + (["idiotic" + r.choice("abc"), "scum"] if toxic else []) + (["@@@ zzz"] * 3 if junk else [])
        rows.append((i, " ".join(w)))
        if i < 600:
            labels.append((i, int(not junk), int(toxic)))
        rows[-1] += (toxic,)
    docs_ = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(-1, None, "c"), (-2, "", "c"), (None, "scum scum", "c")], "doc_id long, text string, p_toxic string")
    told = spark.createDataFrame([*labels, (5, None, 1), (-1, 1, 0)], "doc_id long, quality int, toxic int")
    chain = op2_toxicity.train(spark, docs_, told)
    out = [x for x in op2_toxicity.score(docs_, chain).collect()]
    by = {x.doc_id: x for x in out}
    held = [(by[i].rejected, toxic) for i, _, toxic in rows[600:]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not by[-1].rejected and not by[-2].rejected and len(out) == 903
    nothing = op2_toxicity.train(spark, docs_, told.where("false"))
    assert not any(x.rejected for x in op2_toxicity.score(docs_, nothing).collect())


def test_op2_rare_toxic_rows(spark):
    """Telling words in fewer than a dozen texts count; a small sample holds every rare toxic row."""
    kinds = ["toxic" if i % 100 == 0 else "clean" for i in range(1000)] + ["toxic"] * 20 + ["clean"] * 80
    texts = [" ".join(words(30, 3000 + i) + (["scum", "idiotic"] if k == "toxic" else [])) for i, k in enumerate(kinds)]
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = spark.createDataFrame([(i, 1, int(kinds[i] == "toxic")) for i in range(1000)], "doc_id long, quality int, toxic int")
    for sample in (6000, 200):
        out = {x.doc_id: x.rejected for x in op2_toxicity.score(docs_, op2_toxicity.train(spark, docs_, told, sample=sample)).collect()}
        assert sum(out[i] for i in range(1000, 1020)) >= 18, sample
        assert sum(out[i] for i in range(1020, 1100)) <= 2, sample
    assert op2_toxicity.shares({"a": 10, "b": 10_000}, 100) == {"a": 1.0, "b": 0.009}


def test_op2_chain_feeds_out_of_fold_probabilities():
    """A category that is the earlier one: its model leans on the chained probability."""
    r = np.random.default_rng(0)
    sets = [sorted(set(r.integers(0, 200, 12).tolist())) for _ in range(600)]
    first = np.array([3 in s or 7 in s for s in sets])
    words_, weights, out = op2_toxicity.fit_chain(op2_toxicity.Rows.of(sets), np.column_stack([first, first]), r.integers(0, 4, 600))
    assert out.shape == (600, 2) and weights[1, len(words_)] > 0.5 and weights[0, len(words_) : -1].tolist() == [0.0, 0.0]
    assert ((out[:, 1] > 0.5) == first).mean() > 0.9
