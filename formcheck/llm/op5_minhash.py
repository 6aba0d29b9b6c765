"""MinHash near-dedup with sequential Bayesian verification.

Method: documents with equal shingle sets form a class, represented by its smallest id. Bands of the
representatives' MinHash signatures give buckets. In each bucket every member is paired with the smallest
id: linear in the bucket. A pair's signatures are compared batch by batch; it is dropped as soon as the
posterior probability of a similarity at or above the threshold falls below MISS. Survivors are verified
exactly on their full shingle sets. Buckets that still hold several components are then worked through in
blocks of BLOCK members, inside the tasks: first on signatures alone, which leaves the members that may
still have a link, then exactly for these. A pair is looked at in the first band it shares, and a task
returns only links that join components, so its rows grow with the members, not with the pairs. Links,
components and sets never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.common import join_groups, materialise, read_table, release, text_or_empty
from formcheck.llm.components import components
from formcheck.llm.words import Words, bytes_of, distinct, mix, shingles, slices

#: Words of a shingle and least similarity in per cent, unless told otherwise.
SHINGLE, PERCENT = 5, 80
#: BANDS bands of ROWS values: a pair at similarity 0.8 shares none with probability (1 - 0.8^6)^40 = 5e-6.
BANDS, ROWS = 40, 6
VALUES = BANDS * ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
BATCH, MISS = 24, 1e-5
#: Members of a block in which the pairs of a bucket are screened.
BLOCK = 512
#: Pairs in which one copy of a document's set takes part, about.
LED = 256
_random = np.random.default_rng(5)
FIRST = _random.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
SECOND = _random.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)


@lru_cache
def least_matches(percent: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, least matches among the first n values) after each batch. With a uniform prior the posterior of a
    similarity >= t after m of n matches is P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(batch, VALUES + 1, batch):
        below = 0.0
        for m in range(n + 2):
            below += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
            if below >= miss:
                break
        out.append((n, m))
    return out


def likely(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Numbers of the pairs (left[a], right[b]) that no batch of their signatures rules out."""
    on, matches, low = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_matches(percent):
        for k in range(0, len(on), 65536):
            part = on[k : k + 65536]
            matches[part] += (left[a[part], low:n] == right[b[part], low:n]).sum(axis=1, dtype=np.int32)
        on, low = on[matches[on] >= least], n
    return on


def fingerprints(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, s1, s2): size and 128-bit fingerprint of the set of each row."""
    n = np.bincount(row, minlength=rows)
    some = np.flatnonzero(n)
    at = np.cumsum(n)[some] - n[some]
    s1, s2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(some):
        s1[some] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), at)
        s2[some] = np.add.reduceat(mix(value ^ np.uint64(0x14057B7EF767814F)), at)
    return n, s1.view(np.int64), s2.view(np.int64)


def signatures(df: DataFrame, shingle: int) -> DataFrame:
    """df has id and text. (id, n, s1, s2, signature): size and 128-bit fingerprint of the shingle set, and
    its MinHash values, 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                row, value = distinct(*shingles(Words(*bytes_of(part.column(1)), hashed=True), shingle))
                n, s1, s2 = fingerprints(row, value, part.num_rows)
                some = np.flatnonzero(n)
                at = np.cumsum(n)[some] - n[some]
                least = np.zeros((part.num_rows, VALUES), np.uint16)
                if len(some):
                    low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
                    for v in range(VALUES):
                        least[some, v] = np.minimum.reduceat(low * FIRST[v] + high * SECOND[v], at).astype(np.uint16)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * VALUES), part.num_rows, [None, pa.py_buffer(least.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(s1), pa.array(s2), packed], ["id", "n", "s1", "s2", "signature"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n long, s1 long, s2 long, signature binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if hasattr(column, "to_pylist") else column), np.uint16).reshape(-1, VALUES)


def band_hashes(values: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of the bands of signatures."""
    values = values.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + values[:, :, k])
    return h.view(np.int64)


def bands(reps: DataFrame) -> DataFrame:
    """(band, id): a hash of each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(band_hashes(_matrix(batch.column(1))).ravel()), ids], ["band", "id"])

    return reps.select("id", "signature").mapInArrow(run, f"band long, id {reps.schema['id'].dataType.simpleString()}")


def full_sets(docs: DataFrame, reps: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, signature, shingles) of the ids: their shingle sets, taken from the texts, as sorted 64-bit hashes.
    Of rows that repeat an id those count whose set is the representative's.

    The join is a merge join at every size: the ids grow with the corpus, so they are never broadcast."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4):
                row, value = distinct(*shingles(Words(*bytes_of(part.column(4)), hashed=True), shingle))
                _, s1, s2 = fingerprints(row, value, part.num_rows)
                own = pa.array((s1 == part.column(2).to_numpy()) & (s2 == part.column(3).to_numpy()))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                data = value.tobytes()
                sets = pa.array([data[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["id", "signature", "shingles"]).filter(own)

    wanted = reps.join(ids, "id", "left_semi")
    rows = docs.join(wanted.hint("merge"), "id").select("id", "signature", "s1", "s2", "text")
    return rows.mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, signature binary, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y), 1):
        return False
    z = np.sort(np.concatenate([x, y]), kind="stable")
    same = int((z[1:] == z[:-1]).sum())
    return 100 * same >= percent * (len(z) - same)


def verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out and whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                each = np.arange(part.num_rows)
                on = likely(_matrix(part.column(2)), _matrix(part.column(3)), each, each, percent).tolist()
                left, right = part.column(4), part.column(5)
                sure = [k for k in on if similar(np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64), percent)]
                yield part.select([0, 1]).take(pa.array(sure, pa.int64()))

    side = lambda a, s, v: full.select(F.col("id").alias(a), F.col("signature").alias(s), F.col("shingles").alias(v)).hint("merge")
    # A document that leads very many pairs comes in as many copies of its set as it has hundreds of them.
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / LED).cast("int"))
    dealt = join_groups(pairs, sizes, ["a"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part")
    leads = side("a", "s1", "v1").join(sizes.hint("merge"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("n", "parts")
    both = dealt.join(leads.hint("merge"), ["a", "part"]).join(side("b", "s2", "v2"), "b").select("a", "b", "s1", "s2", "v1", "v2")
    kind = full.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _open_pairs(table: pa.Table, percent: int, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right) row numbers of a block's pairs that are of different components, meet in this band first
    and are not ruled out; with the table's ids and components."""
    x, y, own = table["x"][0].as_py(), table["y"][0].as_py(), table["own"].to_numpy()
    ids, comp, values = table["id"].to_numpy(), table["component"].to_numpy(), _matrix(table["signature"])
    band = int(np.flatnonzero(band_hashes(values[:1])[0] == table["band"][0].as_py())[0])
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    for k in range(0, len(left), rows):
        a, b = (m.ravel() for m in np.meshgrid(left[k : k + rows], right, indexing="ij"))
        apart = (ids[a] < ids[b]) if x == y else np.ones(len(a), bool)
        apart &= comp[a] != comp[b]
        a, b = a[apart], b[apart]
        on = likely(values, values, a, b, percent)
        a, b = a[on], b[on]
        if band and len(a):
            new = np.concatenate([~(values[a[j : j + 8192], : band * ROWS] == values[b[j : j + 8192], : band * ROWS]).reshape(-1, band, ROWS).all(axis=2).any(axis=1) for j in range(0, len(a), 8192)])
            a, b = a[new], b[new]
        yield a, b, ids, comp


def late_links(members: DataFrame, reps: DataFrame, full: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different components of a bucket that join them. members: (band, id, component,
    size of the bucket). Buckets are split into blocks by hash of the id; a task sees two blocks."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "component")
    kind = reps.schema["id"].dataType.simpleString()
    columns = ["band", "x", "y", "own", "id", "component"]

    def possible(table: pa.Table) -> pa.Table:
        some = [np.concatenate([a, b]) for a, b, _, _ in _open_pairs(table, percent)]
        return table.select(columns).take(pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *some]))))

    def exact(table: pa.Table) -> pa.Table:
        parent: dict = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        found: tuple[list, list] = ([], [])
        for left, right, ids, comp in _open_pairs(table, percent):
            for a, b in zip(left.tolist(), right.tolist(), strict=True):
                ra, rb = root(comp[a]), root(comp[b])
                if ra != rb and similar(sets[a], sets[b], percent):
                    parent[max(ra, rb)] = min(ra, rb)
                    found[0].append(min(ids[a], ids[b]))
                    found[1].append(max(ids[a], ids[b]))
        return pa.table({"a": pa.array(found[0], table.schema.field("id").type), "b": pa.array(found[1], table.schema.field("id").type)})

    signed = rows.join(reps.select("id", "signature"), "id")
    kept = materialise(signed.groupBy("band", "x", "y").applyInArrow(possible, f"band long, x int, y int, own int, id {kind}, component {kind}"), "open-members")
    found = materialise(kept.join(full, "id").groupBy("band", "x", "y").applyInArrow(exact, f"a {kind}, b {kind}").distinct(), "links-late")
    release(kept)
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, class_id, component_id, kept (id = component_id).

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than `shingle` words has
    its whole sequence as one shingle; a null, empty or blank text has no shingles and is linked with
    nothing. class_id is the smallest id with the same set. Ids are integers; a null id is linked with nothing
    and kept. Of rows that repeat an id with different texts each belongs to the class of its own text; as a class's
    smallest id such an id is compared with other classes by one of its sets, that of the smallest fingerprint."""
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sketches = materialise(signatures(docs, shingle), "signatures")
    real = sketches.where("n > 0 AND id IS NOT NULL")
    classes = materialise(real.groupBy("s1", "s2", "n").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")), "classes")
    member = join_groups(real.select("id", "n", "s1", "s2"), classes, ["s1", "s2", "n"], "members").select("id", "n", "class_id")
    reps = materialise(real.join(classes.select(F.col("class_id").alias("id")).hint("merge"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("s1", "s2", "signature")).alias("least")).select("id", "least.*"), "representatives")
    banded = materialise(bands(reps), "bands")
    leads = materialise(banded.groupBy("band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    inside = materialise(join_groups(banded, leads, ["band"], "size"), "bucket-members")
    full = materialise(full_sets(docs, reps, inside.select("id").distinct(), shingle), "shingle-sets")
    pairs = inside.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(verify(pairs, full, percent), "links-first")
    found = components(links)
    # Buckets whose members are not yet one component: there every other pair is still open.
    placed = inside.select("band", "id", "size").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = materialise(placed.where("size > 2").join(open_.select("band"), "band", "left_semi"), "open-buckets")
    late = late_links(members, reps, full, percent)
    final = components(links.unionByName(late))
    # The result reads sketches, classes and the final labels alone.
    release(reps, banded, leads, inside, full, links, members, late)
    # A text of very many copies is a hot key.
    named = classes.select("class_id", "members").join(final.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", F.coalesce("component", "class_id").alias("component_id"), "members")
    named = named.groupBy("class_id").agg(F.min("component_id").alias("component_id"), F.sum("members").alias("members"))
    joined = join_groups(member, named, ["class_id"], "members").select("id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = sketches.where("n = 0 OR id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4).drop("class_id")


#: Exact links by counting shared shingles, and their closure.
OP5_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))) END AS shingles FROM w),
c AS (SELECT shingles, min(doc_id) AS rep FROM s WHERE len(shingles) > 0 GROUP BY shingles),
e AS (SELECT rep, len(shingles) AS n, unnest(shingles) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(rep, node) AS (SELECT rep, rep FROM c UNION SELECT r.rep, l.b FROM r JOIN l ON l.a = r.node),
m AS (SELECT rep, min(node) AS component FROM r GROUP BY rep)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.shingles = s.shingles LEFT JOIN m ON m.rep = c.rep
"""
