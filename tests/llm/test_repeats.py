"""Operators 11 to 13 against brute force, and cases that earlier operators got wrong."""

import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formcheck.llm import op2_toxicity, op3_exact_dedup, op4_hilbert_ann, op5_minhash, op8_warc, op9_substring_dedup, op10_url_filter, op11_suffix_array, op12_alignment, op13_filter_audit

DOCS = "doc_id long, text string, id string, h string, d string, lang string, n long"


def docs(spark, rows):
    """(id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", ("en", "fr", None)[k % 3], k) for k, (i, t) in enumerate(rows)], DOCS)


def removed(rows, least):
    """By every window: (id, text) in order of the ids; for each row a flag of every byte."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        flags = bytearray(len(data))
        for p in range(len(data) - least + 1):
            if data[p : p + least] in seen:
                flags[p : p + least] = b"\1" * least
        out.append((data, flags))
        seen.update(data[p : p + least] for p in range(len(data) - least + 1))
    return out


def passages(seed, n):
    r = random.Random(seed)
    parts = ["".join(r.choice("abc é漢\n") for _ in range(r.randint(10, 90))) for _ in range(25)] + ["a" * 150, "ab" * 90, "="]
    return ["".join(r.choice(parts)[: r.randint(1, 200)] for _ in range(r.randint(0, 12))) for _ in range(n)]


def check_removal(spark, rows, least):
    got = {r.doc_id: r for r in op11_suffix_array.removal_digests(docs(spark, rows), least=least).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows)
    for (i, _), (data, flags) in zip(ordered, removed(ordered, least), strict=True):
        kept = bytes(c for c, f in zip(data, flags, strict=True) if not f)
        spans = (b"\0" + bytes(flags)).count(b"\0\1")
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), sum(flags), spans, hashlib.sha256(kept).hexdigest()), i


def test_op11_equals_brute_force(spark, monkeypatch):
    texts = [None, "", " ", "a" * 3000, "a" * 49, "a" * 50, *passages(3, 150)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    check_removal(spark, [(2 * i, t) for i, t in rows], 50)
    check_removal(spark, rows[:60], 20)
    # Small bins and blocks, and anchors with more snippets than a bin holds.
    monkeypatch.setattr(op11_suffix_array, "BIN", 2)
    monkeypatch.setattr(op11_suffix_array, "MOST", 3)
    monkeypatch.setattr(op11_suffix_array, "BLOCK", 64)
    monkeypatch.setattr(op11_suffix_array, "GATHERED", 200)
    check_removal(spark, rows[:80], 50)


def test_op11_odd_rows(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh") for _ in range(120))
    rows = [(3, long), (3, "x" + long), (None, long), (1, "q" + long[:70]), (None, None), (3, "alone")]
    df = docs(spark, rows)
    out = op11_suffix_array.remove(df)
    assert out.columns == df.columns and out.count() == len(rows)
    kept = sorted((r.doc_id if r.doc_id is not None else 99, r.text) for r in out.where("text IS NOT NULL").collect())
    # Of the rows with id 3 one stands before the other; the null id comes last.
    texts = {i: [t for j, t in kept if j == i] for i, _ in kept}
    assert texts[1] == ["q" + long[:70]] and texts[99] == [""] and "alone" in texts[3]
    assert sorted(texts[3]) == sorted(["alone", long[70:], "x"]) or sorted(texts[3]) == sorted(["alone", "", "x" + long[70:]])
    assert op11_suffix_array.removal_digests(df.where("false")).count() == 0
    assert op11_suffix_array.maximal_repeats(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        op11_suffix_array.maximal_repeats(df, least=8)


def test_op11_suffix_array_and_intervals():
    r = random.Random(2)
    for _ in range(30):
        data = np.array([r.choice([0, 1, 97]) for _ in range(60)], np.uint8)
        start = np.arange(60)
        end = np.minimum(60, (start // 20 + 1) * 20)
        order, lcp = op11_suffix_array.suffix_array(data, start, end)
        suffixes = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
        assert [suffixes[k] for k in order] == sorted(suffixes)
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        ordered = sorted(suffixes)
        assert lcp.tolist() == [0, *(shared(a, b) for a, b in itertools.pairwise(ordered))]
        got = set(zip(*(x.tolist() for x in op11_suffix_array.intervals(lcp, 2)), strict=True))
        expected = set()
        for a in range(60):
            for b in range(a + 1, 60):
                depth = lcp[a + 1 : b + 1].min()
                if depth >= 2 and lcp[a] < depth and (b == 59 or lcp[b + 1] < depth):
                    expected.add((int(depth), a, b))
        assert got == expected


def test_op11_maximal_repeats_hold_all_occurrences(spark):
    rows = [(i, t) for i, t in enumerate(passages(9, 40))]
    found = op11_suffix_array.maximal_repeats(docs(spark, rows)).collect()
    texts = {i: (t or "").encode() for i, t in rows}
    groups = collections.defaultdict(set)
    for r in found:
        groups[r.repeat, r.length].add((r.doc_id, r.start))
    assert groups
    for (_, length), places in groups.items():
        content = {texts[i][p : p + length] for i, p in places}
        assert len(content) == 1 and length >= 50
        assert len({i for i, _ in places}) > 1
    # Every window that two documents share lies in a group with all its occurrences in view.
    windows = collections.defaultdict(set)
    for i, data in texts.items():
        for p in range(len(data) - 49):
            windows[data[p : p + 50]].add((i, p))
    held = collections.defaultdict(set)
    for (_, length), places in groups.items():
        i, p = next(iter(places))
        for k in range(length - 49):
            held[texts[i][p + k : p + k + 50]].update((j, q + k) for j, q in places)
    for window, places in windows.items():
        if len({i for i, _ in places}) > 1:
            assert places <= held[window]


def test_op12_equals_libraries(spark):
    a = Tokenizer.from_file(op12_alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=op12_alignment.PIECES)
    one, two = op12_alignment.side(op12_alignment.BYTE_BPE), op12_alignment.side(op12_alignment.PIECES)
    token = lambda table, i: table.data[table.starts[i] : table.starts[i] + table.sizes[i]].tobytes()
    r = random.Random(4)
    texts = [None, "", " ", "   two  blanks   ", "x<|endoftext|> <s> </s> <unk>", "é漢字😀 ½²", "tab\tand\nline\r\n\x00\x01", "▁under ▁ score", "a" * 3000, " " * 100]
    texts += ["".join(r.choice(["the ", "cat", " on", "é", "漢", "  ", "\n", "ing", "X9", "'s"]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = list(enumerate([*texts, texts[-1]]))
    expected, counts = {}, collections.Counter()
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        full = (" " + (text or "")).encode()
        if b"".join(token(one.bytes, k) for k in ids_a) != full or b"".join(token(two.bytes, k) for k in ids_b) != full:
            expected[i] = None
            continue
        ends = [np.cumsum([len(token(side.bytes, k)) for k in ids]).tolist() for side, ids in ((one, ids_a), (two, ids_b))]
        spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        links = [(x, y) for x, (p, q) in zip(ids_a, spans[0], strict=True) for y, (s, t) in zip(ids_b, spans[1], strict=True) if p < t and s < q]
        counts.update(links)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        named = []
        for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
            part = lambda ids, e: ",".join(str(k) for k, x in zip(ids, e, strict=True) if low < x <= high)  # noqa: B023, E731
            named.append(f"{part(ids_a, ends[0])}|{part(ids_b, ends[1])}")
        expected[i] = (len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(named).encode()).hexdigest())
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    assert sum(v is None for v in expected.values()) >= 2 and sum(v is not None for v in expected.values()) > 100
    for row in op12_alignment.align(docs(spark, rows)).collect():
        want = expected[row.doc_id]
        got = (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256)
        if want is None:
            assert got == (0, 0, 0, 0, 0, 0, ""), row
        else:
            assert got == (*want[:3], len(want[3]), sum(counts[k] == best[k[1]] for k in want[3]), sum(counts[k] for k in want[3]), want[4]), row
    listed = collections.defaultdict(list)
    for row in op12_alignment.links(docs(spark, rows[:40])).collect():
        listed[row.doc_id].append((row.a_number, row.a_id, row.b_number, row.b_id))
    for i, _ in rows[:40]:
        assert collections.Counter((x[1], x[3]) for x in listed[i]) == collections.Counter(expected[i][3] if expected[i] else [])


def test_op12_odd_rows(spark):
    rows = [(None, "same text"), (7, "same text"), (7, "same text"), (8, None)]
    out = op12_alignment.align(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_a > 0) for r in out) == [(0, True), (7, True), (7, True), (8, False)]
    assert len({r.count_sum for r in out if r.n_a}) == 1
    assert op12_alignment.align(docs(spark, rows).where("false")).count() == 0
    assert op12_alignment.align(docs(spark, rows[3:])).collect()[0].n_links == 0


def audit_by_hand(rows, labels):
    """rows (id, text, lang) with distinct ids."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first: dict = {}
    fails = {}
    for i, text, lang in sorted(rows):
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails[i] = {k for k, on in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), text in first), strict=True) if on}
        first.setdefault(text, i)
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        ids = [i for i, _, lang in rows if (lang or "") == part]
        taken = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = set(ids)
            for step, k in enumerate(order, 1):
                gone = {i for i in left if k in fails[i]}
                out[part, "".join(order), step] = [len(left) - len(gone), len(gone), sum(k in fails[i] and i not in left for i in ids), sum(fails[i] == {k} for i in ids), len(gone & good), len(gone & toxic), k]
                taken[k] += len(gone)
                left -= gone
        for (p, *_), v in out.items():
            if p == part:
                v[6] = taken[v[6]] if isinstance(v[6], str) else v[6]
    return out


def test_op13_equals_brute_force(spark, monkeypatch):
    r = random.Random(8)
    base = [" ".join(r.choice(["one", "Two", "THREE", "x#", "word%d" % k, "é漢"]) for k in range(r.randint(0, 160))) for _ in range(40)]
    texts = [None, "", " ", "\t\n", *base, *base[:15], base[0], base[0] + " tail", base[0][:40], "A" * 5000]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    df = docs(spark, rows)
    told = [(i, r.choice([0, 1]), r.choice([0, 1])) for i, _ in rows if r.random() < 0.5]
    labels = spark.createDataFrame([*told, *told[:3], (99999, 1, 1)], "doc_id long, quality int, toxic int")
    expected = audit_by_hand([(x.doc_id, x.text, x.lang) for x in df.collect()], told)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    for trie, lengths in ((1 << 24, op13_filter_audit.LENGTHS), (300, (2, 4))):
        monkeypatch.setattr(op13_filter_audit, "TRIE", trie)
        monkeypatch.setattr(op13_filter_audit, "LENGTHS", lengths)
        got = {(x.part, x.filter_order, x.step): [x[c] for c in names] for x in op13_filter_audit.audit(op13_filter_audit.masks(df.repartition(5)), labels).collect()}
        assert got == expected and len(got) == 3 * 600


def test_op13_odd_rows(spark):
    rows = [(5, "same"), (5, "same"), (None, "same"), (2, "other"), (None, "other"), (None, None), (None, None)]
    got = collections.Counter()
    for x in op13_filter_audit.masks(docs(spark, rows)).collect():
        got[x.id, bool(x.mask & op13_filter_audit.COPY)] += x.n
    assert got == {(5, False): 2, (None, True): 2, (2, False): 1, (None, False): 2}
    empty = docs(spark, rows).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op13_filter_audit.audit(op13_filter_audit.masks(empty), labels).count() == 0
    trie = op13_filter_audit.Trie()
    words = ["romane", "romanus", "rom", "", "romulus", "rubens", "romane"]
    copies = [c for k, w in enumerate(words) for c in trie.insert(w.encode(), 10 - k, 0, "p", 1)]
    assert sorted(t.decode() for t, _ in trie.terminals()) == sorted(set(words)) and [c[0] for c in copies] == [10]


def test_op3_index_outlives_its_session(spark, tmp_path):
    path = str(tmp_path / "index")
    first = op3_exact_dedup.DigestIndex(spark, "lasting", path, 3)
    op3_exact_dedup.mark(docs(spark, [(1, "a"), (2, "b"), (3, "A")]), first, batch="one").collect()
    spark.sql("DROP TABLE lasting")  # another session's catalog does not know it; the files stay
    other = spark.newSession()
    for name, buckets in (("lasting", None), ("by_another_name", 7)):
        again = op3_exact_dedup.DigestIndex(other, name, path, buckets)
        assert again.buckets == 3 and again.table().count() == 2
    assert op3_exact_dedup.DigestIndex(other, "lasting").path.endswith("index")
    rows = {r.doc_id: (r.keep_id, r.kept) for r in op3_exact_dedup.mark(docs(other, [(7, "B"), (8, "c")]), op3_exact_dedup.DigestIndex(other, "lasting", path), batch="two").collect()}
    assert rows == {7: (2, False), 8: (8, True)}
    index = op3_exact_dedup.DigestIndex(other, "lasting", path)
    index.compact()
    assert index.table().count() == 3 and op3_exact_dedup.DigestIndex(other, "lasting").table().count() == 3
    with pytest.raises(ValueError):
        op3_exact_dedup.DigestIndex(other, "lasting", str(tmp_path / "elsewhere"))
    other.sql("DROP TABLE lasting")
    other.sql("DROP TABLE by_another_name")


@pytest.mark.parametrize("k", [1, 5, 16, 64, 149])
def test_op4_returns_as_many_as_asked(spark, k):
    random_ = np.random.default_rng(k)
    vectors = random_.normal(size=(150, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in op4_hilbert_ann.knn(df, F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in (0, 50, 100):
        close = unit @ unit[q]
        close[q] = -2
        best = np.argsort(-close)[:k]
        assert len(found[q]) == k and len(set(found[q]) & set(best.tolist())) >= 0.9 * k


def test_op2_fits_a_bounded_number_of_rows(spark, monkeypatch):
    sizes = []
    real = op2_toxicity.shares
    monkeypatch.setattr(op2_toxicity, "shares", lambda counts, sample: sizes.append(sum(counts.values())) or real(counts, sample))
    rows = docs(spark, [(1, f"text {k}") for k in range(3000)] + [(2, "other text"), (3, "good words")])
    labels = spark.createDataFrame([(1, 1, 1)] * 500 + [(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    chain = op2_toxicity.train(spark, rows, labels)
    assert chain.count() == 1 and sizes == [3]
    # What the fitting task saw was written before it: one row for each labelled id.
    assert op2_toxicity.score(rows, chain).count() == 3002


def test_op8_urls_with_other_line_ends(spark):
    urls = [f"http://a.example/{c}WARC-Refers-To: <urn:page:77>{c}WARC-Type: x" for c in (" ", " ", "\x85", "\r\n", "\n", "\r")]
    pages = spark.createDataFrame([(k + 1, u, "same") for k, u in enumerate(urls)], "page_id long, url string, html string")
    path = op8_warc.shared_path(spark, "warc-lines")
    op8_warc.write_archive(pages, path)
    rows = {r.page_id: (r.record_type, r.refers_to) for r in op8_warc.archive_summary(spark, path).collect()}
    assert rows == {1: ("response", None)} | {k: ("revisit", 1) for k in range(2, 7)}


def test_op9_rows_that_repeat_an_id(spark):
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared, alone = text(120), text(120)
    rows = [(1, shared), (2, "begin " + shared + " end"), (2, alone), (None, shared)]
    out = op9_substring_dedup.remove(docs(spark, rows)).collect()
    texts = collections.Counter((x.doc_id, x.text == alone, x.text == shared) for x in out)
    assert texts[2, True, False] == 1 and texts[1, False, True] == 1 and texts[None, False, True] == 1
    cut = next(x.text for x in out if x.doc_id == 2 and x.text != alone)
    assert len(cut.split()) < 40


def test_op5_one_lead_of_many_and_one_text_very_often(spark, monkeypatch):
    monkeypatch.setattr(op5_minhash, "LED", 4)
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(0, 200, 5)]
    rows = [(0, " ".join(words)), *((1 + k, t) for k, t in enumerate(near)), *((100 + k, " ".join(words)) for k in range(300)), (999, "quite another text of its own words here")]
    out = {x.doc_id: x.component_id for x in op5_minhash.near_duplicates(docs(spark, rows)).collect()}
    assert all(out[i] == 0 for i, _ in rows[:-1]) and out[999] == 999 and len(out) == len(rows)


def test_op10_half_of_the_urls_null(spark):
    rows = [(k, None if k % 2 else f"http://www{k}.example.net/en/page{k}") for k in range(400)] + [(1000 + k, f"http://b{k}.net/x{k}") for k in range(50)]
    out = op10_url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert out.count() == 450
    nulls = out.where("page_id < 400 AND page_id % 2 = 1").groupBy("host", "path", "rule", "score").count().collect()
    assert len(nulls) == 1 and nulls[0]["count"] == 200 and nulls[0]["rule"] is None


def test_repeat_table_of_a_bin():
    """A bin whose snippets are nested: the smallest document keeps its bytes, the others lose what they share."""
    data = [b"A" * 20 + b"b" * 10 + b"C" * 20, b"x" + b"A" * 20 + b"b" * 10 + b"C" * 20, b"y" + b"A" * 20 + b"b" * 10 + b"z" * 20]
    table = pa.table({"h": [1, 1, 1], "d": [1, 2, 3], "low": [5, 6, 7], "high": [5, 6, 7], "snippet": data})
    rows = {d: list(zip(s, e, strict=True)) for d, s, e in zip(*(op11_suffix_array._covered(table, 30).column(c).to_pylist() for c in ("d", "starts", "ends")), strict=True)}
    assert rows == {2: [(1, 51)], 3: [(1, 31)]}
