"""Audit of how document filters interact, with exact duplicates found by radix text tries.

Method: each filter is a bit of a document's mask of failures. Whether a text is that of a smaller id too is found by
compressed (radix) tries of whole texts whose terminals hold the smallest id:

1. In each task the texts at hand go into a trie; copies are flagged there, and one row for each text goes on.
2. Those are range-partitioned by text prefixes. A prefix is as long as it must be: it grows while the texts that begin
   with it make up more than 1/HOT of all bytes, so no range is hot; at most HOT prefixes of each length are that frequent.
3. Each partition, sorted by text, is put into tries and traversed: the smallest id of a text passes, the others are flagged.
   A trie that has grown to TRIE bytes is traversed and only its last text goes on, as none before can come again.

Masks are then reduced: at most 2^5 counts for each part of the corpus give every order of the filters.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formcheck.llm.common import materialise, read_table, text_or_empty
from formcheck.llm.words import slices

#: Lengths of prefixes (characters); one that is frequent at the last length is told apart by a hash of the text.
LENGTHS = (16, 64, 256, 1024, 4096)
HOT = 200
#: Bytes of text from which on a trie is traversed and begun anew.
TRIE = 1 << 24
WORD_GAP = "[\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """Mask of the conditions that a text alone decides. A: under 100 words; B: 100 * distinct words < 80 * words;
    C: 100 * letters A-Z > 10 * characters; D: holds one of #$%&*|."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    capitals = F.length(text) - F.length(F.translate(text, upper, ""))
    few, poor = F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)
    return sum((c.cast("int") * (1 << k) for k, c in enumerate((few, poor, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")))), F.lit(0))


def common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes a has in common with b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Terminal:
    """The smallest id of a text, with its mask and how many rows of each part carry it."""

    __slots__ = ("id", "mask", "parts")

    def __init__(self, id_, mask: int, part: str, n: int):
        self.id, self.mask, self.parts = id_, mask, {part: n}


def before(a, b) -> bool:
    """Order of ids; nulls come last."""
    return a is not None and (b is None or a < b)


class Trie:
    """Compressed trie of byte strings. A node is [edge, children by first byte, terminal or None]."""

    def __init__(self) -> None:
        self.root, self.size = [b"", {}, None], 0

    def insert(self, text: bytes, id_, mask: int, part: str, n: int) -> list[tuple]:
        """Add n rows of a text; the rows (id, mask, part, n) that are known to be copies by that."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                self.size += len(text) - at
                node, at = child, len(text)
                break
            edge = child[0]
            if not text.startswith(edge, at):
                cut = common(edge, text, at)
                upper = [edge[:cut], {edge[cut]: child}, None]
                child[0] = edge[cut:]
                node[1][text[at]] = upper
                child = upper
            node, at = child, at + len(child[0])
        held = node[2]
        if held is None:
            node[2] = Terminal(id_, mask, part, n)
        elif id_ == held.id:
            held.parts[part] = held.parts.get(part, 0) + n
        elif before(id_, held.id):
            node[2] = Terminal(id_, mask, part, n)
            return [(held.id, held.mask, p, k) for p, k in held.parts.items()]
        else:
            return [(id_, mask, part, n)]
        return []

    def terminals(self) -> Iterator[tuple[bytes, Terminal]]:
        stack = [(self.root, b"")]
        while stack:
            (edge, children, terminal), head = stack.pop()
            text = head + edge
            if terminal is not None:
                yield text, terminal
            stack.extend((child, text) for child in children.values())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _flagged(texts: DataFrame, kept_text: bool) -> DataFrame:
    """texts(id, part, mask, n, text): one row for each text, id and part as tries tell: mask with the bit COPY where a
    smaller id has the text. kept_text: a task's own view, and rows that are no copies there keep their text; else
    the rows are those of a partition sorted by text, and the result is final."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = Trie(), None

        def traversed(last: bytes | None = None) -> list[tuple]:
            """Rows of the terminals but that of the last text, which begins the next trie."""
            nonlocal trie
            done, trie = trie, Trie()
            rows = []
            for text, t in done.terminals():
                for part, n in t.parts.items():
                    if text == last:
                        trie.insert(text, t.id, t.mask, part, n)
                    else:
                        rows.append((t.id, part, t.mask, n, text if kept_text else None))
            return rows

        for batch in batches:
            schema = schema or pa.schema([pa.field(n, pa.binary() if n == "text" else f.type) for n, f in zip(batch.schema.names, batch.schema, strict=True)])
            for piece in slices(batch, 4, 1 << 20):
                rows = []
                for id_, part, mask, n, text in zip(*(c.to_pylist() for c in piece.columns[:4]), piece.column(4).cast(pa.large_binary()).to_pylist(), strict=True):
                    rows.extend((i, p, m | COPY, k, None) for i, m, p, k in trie.insert(text, id_, mask, part, n))
                    if trie.size > TRIE:
                        rows.extend(traversed(None if kept_text else text))
                yield _batch(rows, schema)
        if schema:
            yield _batch(traversed(), schema)

    return texts.mapInArrow(run, f"id {kind}, part string, mask int, n long, text binary")


def _dealt(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """texts (with a column text) in ranges of adaptive prefixes, sorted by text. sizes(text): what the frequency of
    prefixes is taken from."""
    prefix = lambda length: F.substring("text", 1, length)
    keys = [F.struct(F.lit(k).alias("level"), F.xxhash64(prefix(length)).alias("key")) for k, length in enumerate(LENGTHS)]
    counted = sizes.select(F.explode(F.array(*keys)).alias("p"), (F.octet_length("text") + 1).alias("bytes")).groupBy("p.level", "p.key").agg(F.sum("bytes").alias("bytes"))
    total = sizes.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # At most HOT prefixes of a length hold more than 1/HOT of all bytes each.
    frequent: dict[int, list[int]] = {}
    for r in counted.where(F.col("bytes") * HOT > F.lit(total)).select("level", "key").collect():
        frequent.setdefault(r.level, []).append(r.key)
    chosen, salt = prefix(LENGTHS[-1]), F.lit(0)
    if LENGTHS and len(LENGTHS) - 1 in frequent:
        salt = F.when(F.xxhash64(prefix(LENGTHS[-1])).isin(frequent[len(LENGTHS) - 1]), F.xxhash64("text")).otherwise(0)
    for k in range(len(LENGTHS) - 2, -1, -1):
        chosen = F.when(F.xxhash64(prefix(LENGTHS[k])).isin(frequent[k]), chosen).otherwise(prefix(LENGTHS[k])) if k in frequent else prefix(LENGTHS[k])
    keyed = texts.withColumns({"__fc_prefix": chosen, "__fc_salt": salt})
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "__fc_prefix", "__fc_salt").sortWithinPartitions("text").drop("__fc_prefix", "__fc_salt")


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): the mask of failed filters of each document; n rows have that id, part and text. A null text is
    empty, a null part the empty string. E fails where a smaller id has the same text; a null id ranks last, rows that
    repeat an id are no smaller than one another."""
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.lit(1).cast("long").alias("n"), text.alias("text"))
    # Written once, as the ranges are sampled, then dealt; copies found in a task have no text left to move.
    local = materialise(_flagged(rows, True).withColumn("text", F.col("text").cast("string")), "local-masks", "zstd")
    open_ = _dealt(local.where("text IS NOT NULL"), df.select(text.alias("text")))
    known = local.where("text IS NULL")
    return _flagged(open_, False).drop("text").unionByName(known.drop("text"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before) of all orders of the filters."""
    out = []
    for order in itertools.permutations(FILTERS):
        seen = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, seen))
            seen |= bit
    return out


def audit(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """masked(id, part, mask, n) and labels(doc_id, quality, toxic): one row for each part, order of filters and step. A
    document that several labels name is good or toxic if one of them says so."""
    named = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masked.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(named, "id", "left")
    counts = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")))
    # 2^5 masks of a part at most.
    lists = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(x).alias("seen")) for o, s, b, x in orders()))
    rows = lists.select("part", "masks", F.explode(steps).alias("s")).select("part", "masks", "s.*")
    fails = lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0
    there = lambda m: m["mask"].bitwiseAND(F.col("seen")) == 0
    total = lambda value, when: F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(when(m), value(m)).otherwise(0).cast("long"))
    n = lambda m: m["n"]
    removed = lambda m: fails(m) & there(m)
    every = math.factorial(len(FILTERS))
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~fails(m) & there(m)).alias("kept"), total(n, removed).alias("removed"), total(n, lambda m: fails(m) & ~there(m)).alias("redundant"),
        total(n, lambda m: m["mask"] == F.col("bit")).alias("unique_fails"), total(lambda m: m["good"], removed).alias("good_lost"), total(lambda m: m["toxic"], removed).alias("toxic_lost"),
        # A document that fails k filters falls to each of them in 1/k of the orders.
        total(lambda m: m["n"] * F.lit(every) / F.bit_count(m["mask"]), fails).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (SELECT doc_id, part,
             CASE WHEN len(words) < 100 THEN 1 ELSE 0 END AS a,
             CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 1 ELSE 0 END AS b,
             CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 1 ELSE 0 END AS c,
             CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
             CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS e FROM w),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, a + b + c + d + e AS k, count(*) AS n,
             sum(CASE WHEN g.good = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN g.bad = 1 THEN 1 ELSE 0 END) AS bad
      FROM f LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id) g USING (doc_id)
      GROUP BY ALL),
l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0) AS seen FROM p, range(1, 6) r(step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN mask & (bit | CAST(seen AS INTEGER)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(seen AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(seen AS INTEGER) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(seen AS INTEGER) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(seen AS INTEGER) = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & bit > 0 THEN n * 120 // k ELSE 0 END) AS BIGINT) AS shapley
FROM m, s GROUP BY part, filter_order, step
"""
