"""Repeated substrings by common-prefix interval trees over enhanced suffix arrays.

Method: all suffixes of a corpus fit no sort, so the suffix array is dealt out by content. Every window of
`least` bytes has a least hash among its 16-byte grams (its anchor); equal windows have equal anchors, so
all occurrences of a repeat meet under one anchor. Neighbouring windows of one anchor travel together as one
snippet of at most 84 bytes (for windows of 50).

1. Anchors of one document alone hold no repeat and go: one row per anchor and batch of documents is shuffled.
2. Digests and places of the other anchors' snippets are written once; equal ones are reduced to their smallest and
   largest document.
3. Where an anchor has several different snippets, their suffixes are sorted in bins (a suffix array with its
   LCP array), a scan with a stack finds the intervals of the common-prefix tree, and intervals whose left
   neighbours differ are the maximal repeats, with all their occurrences.
4. A snippet tells its fate to all its occurrences through a join; anchors and snippets that hold many rows
   are hot keys of these joins and go by broadcast (at most a fixed number of them).

A bin has a bounded number of suffixes. An anchor of more snippets than that has its windows grouped by their
bytes instead, which gives the same bytes to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formcheck.llm.bpe import ragged
from formcheck.llm.common import join_groups, keyed, materialise, read_table, release, settle, text_or_empty
from formcheck.llm.words import bytes_of, mix, slices

#: Bytes of a gram; bytes from which on a repeat counts (at least GRAM); windows hashed at a time.
GRAM, LEAST, BLOCK = 16, 50, 1 << 17
#: Anchors that a task gathers before it passes them on.
GATHERED = 1 << 19
#: Different snippets of a bin, about; an anchor that has more than MOST goes by windows.
BIN, MOST = 5_000, 20_000
#: At most this many anchors can have more than 1/HOT of all kinds each.
HOT = 200
#: Random 64-bit value of each byte, from a fixed seed.
BYTE = np.random.default_rng(20240311).integers(0, 2**64, 256, dtype=np.uint64)
FACTOR = np.uint64(0x9FB21C651E98DF25)


def least_hashes(text: np.ndarray, least: int) -> np.ndarray:
    """The least hash among the grams of each window of `least` bytes."""
    h, width = BYTE[text], 1
    while width < GRAM:
        h = h[:-width] * FACTOR + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    h = mix(h)
    count, width = least - GRAM + 1, 1
    while width * 2 <= count:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if rest := count - width:
        h = np.minimum(h[:-rest], h[rest:])
    return h


def runs(text: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, row, begin, end) of the maximal runs of windows with one anchor: windows start at bytes begin to
    end - 1 and lie within their row. Cut at BLOCK windows."""
    for at in range(0, len(text) - least + 1, BLOCK):
        part = text[at : at + BLOCK + least - 1]
        h = least_hashes(part, least)
        n = len(h)
        first, last = np.searchsorted(offsets, [at, at + n + least], "left")
        edges = offsets[first:last]
        stops = np.maximum(edges - least + 1, offsets[max(first - 1, 0)])
        inside = np.ones(n, bool)
        for stop, edge in zip((stops - at).clip(0, n).tolist(), (edges - at).clip(0, n).tolist(), strict=True):
            inside[stop:edge] = False
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (inside[1:] != inside[:-1])
        new[(edges - at)[(edges >= at) & (edges < at + n)]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n)
        kept = inside[begin]
        begin, end = begin[kept], end[kept]
        yield h[begin].view(np.int64), np.searchsorted(offsets, begin + at, "right") - 1, begin + at, end + at


def _anchors(texts: DataFrame, least: int) -> DataFrame:
    """(h, id, known) of the anchors of each document. What one task has gathered is reduced first: an anchor of one
    document there is one row; of several, one row that is not known yet to be shared elsewhere, and a known row for each."""

    def flush(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, id_ = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((id_, h))
        h, id_ = h[order], id_[order]
        first = np.append(True, h[1:] != h[:-1])
        fresh = first.copy()
        fresh[1:] |= id_[1:] != id_[:-1]
        group = np.cumsum(first)[fresh] - 1
        h, id_, first = h[fresh], id_[fresh], first[fresh]
        many = np.bincount(group)[group] > 1
        known = np.repeat([False, True], [first.sum(), many.sum()])
        return pa.RecordBatch.from_arrays([*map(pa.array, (np.concatenate([h[first], h[many]]), np.concatenate([id_[first], id_[many]]), known))], ["h", "id", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids = part.column(0).to_numpy()
                for h, row, _, _ in runs(*bytes_of(part.column(1)), least):
                    found.append((h, ids[row]))
                    size += len(h)
                if size >= GATHERED:
                    yield flush(found)
                    found, size = [], 0
        if found:
            yield flush(found)

    return texts.mapInArrow(run, "h long, id long, known boolean")


def _places(texts: DataFrame, least: int) -> DataFrame:
    """texts(id, text, hs): (h, d, id, at, size) of the snippets, the runs of windows whose anchor is in hs. d: 64 bits of a
    digest of the snippet."""
    most = least - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = hashlib.blake2b
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, (text, offsets) = part.column(0).to_numpy(), bytes_of(part.column(1))
                lists = part.column(2)
                listed = np.unique(mix(lists.flatten().to_numpy().view(np.uint64) + np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()).astype(np.uint64) * FACTOR))
                for h, row, begin, end in runs(text, offsets, least):
                    keys = mix(h.view(np.uint64) + row.astype(np.uint64) * FACTOR)
                    at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
                    kept = listed[at] == keys
                    h, row, begin, end = h[kept], row[kept], begin[kept], end[kept]
                    # A gram that repeats makes runs of any length: they are cut at `most` windows.
                    pieces = -(-(end - begin) // most)
                    h, row = np.repeat(h, pieces), np.repeat(row, pieces)
                    number = np.arange(len(h)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    start = np.repeat(begin, pieces) + number * most
                    stop = np.minimum(start + most, np.repeat(end, pieces)) + least - 1
                    data = memoryview(text)
                    d = np.frombuffer(b"".join(blake(data[x:y], digest_size=8).digest() for x, y in zip(start.tolist(), stop.tolist(), strict=True)), np.int64)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (h, d, ids[row], start - offsets[row], (stop - start).astype(np.int32)))], ["h", "d", "id", "at", "size"])

    return texts.mapInArrow(run, "h long, d long, id long, at long, size int")


def _listed(kinds: DataFrame, high: bool) -> DataFrame:
    """kinds(h, d, low, high, at, size) in lists of their smallest documents, written. high: with the largest one as well."""
    # A group is what one document has: bounded by its text.
    own = F.struct("h", "d", *(["high"] if high else []), "at", "size")
    return materialise(kinds.groupBy(F.col("low").alias("id")).agg(F.collect_list(own).alias("own")), "listed-kinds", "zstd")


def _with_bytes(texts: DataFrame, own: DataFrame) -> DataFrame:
    """The kinds of _listed() as (h, d, low, high if listed, snippet): size bytes at `at` of document low."""
    names = own.schema["own"].dataType.elementType.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                text, offsets = bytes_of(part.column(1))
                row = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
                h, d, *high, at, size = part.column(2).flatten().flatten()
                size = size.to_numpy().astype(np.int64)
                data = ragged(text, offsets[row] + at.to_numpy(), size)
                snippet = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([h, d, *high, part.column(0).take(pa.array(row)), snippet], [*names, "low", "snippet"])

    return texts.join(own.hint("merge"), "id").mapInArrow(run, ", ".join(f"{n} long" for n in (*names, "low")) + ", snippet binary")


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes data[start:end], shorter ones first among equals; lcp[k] is what order[k - 1] and
    order[k] have in common, lcp[0] = 0."""
    size = end - start
    n, width = len(size), int(size.max())
    # Each suffix, zeros after its end, and its size, which tells zeros of its own from those.
    rows = np.empty((n, width + 4), np.uint8)
    rows[:, :width] = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)[start]
    rows[:, :width][np.arange(width) >= size[:, None]] = 0
    rows[:, width:] = size[:, None].astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(rows.view(f"S{width + 4}").ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    for k in range(1, n, 1 << 15):
        a, b = order[k - 1 : min(n, k + (1 << 15)) - 1], order[k : k + (1 << 15)]
        unlike = rows[a, :width] != rows[b, :width]
        common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        lcp[k : k + len(a)] = np.minimum(common, np.minimum(size[a], size[b]))
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, first, last) of every interval of the common-prefix tree that is at least `least` deep: a scan of the LCP
    array with a stack of the open intervals."""
    depths, firsts, lasts = [], [], []
    stack: list[tuple[int, int]] = []
    at = np.flatnonzero(lcp >= least)
    # Between these places no interval is open.
    for k, common in zip([*at.tolist(), -1], [*lcp[at].tolist(), 0], strict=True):
        if stack and k != before + 1:
            for depth, first in reversed(stack):
                depths.append(depth), firsts.append(first), lasts.append(before)
            stack = []
        first = k - 1
        while stack and stack[-1][0] > common:
            depth, first = stack.pop()
            depths.append(depth), firsts.append(first), lasts.append(k - 1)
        if k >= 0 and (not stack or stack[-1][0] < common):
            stack.append((common, first))
        before = k
    return np.array(depths, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)


class Bin:
    """The suffixes of a bin's snippets in order, and the maximal repeats among them."""

    def __init__(self, table: pa.Table, least: int):
        snippets = table.column("snippet").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(snippets.buffers()[1], np.int64)[snippets.offset : snippets.offset + len(snippets) + 1]
        data = np.frombuffer(snippets.buffers()[2], np.uint8)
        count = np.diff(offsets) - least + 1
        self.owner = np.repeat(np.arange(len(snippets)), count)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[self.owner] + self.place
        self.order, lcp = suffix_array(data, start, offsets[self.owner + 1])
        self.depth, self.first, self.last = intervals(lcp, least)
        # What stands before a snippet is not known, so its first suffix counts as different on the left.
        self.left = np.where(self.place > 0, data[np.maximum(start - 1, 0)].astype(np.int64), -1)[self.order]

    def spread(self, values: np.ndarray, at: np.ndarray, by: np.ufunc) -> np.ndarray:
        """values (of the ordered suffixes) reduced over the intervals `at`, which are disjoint and in order."""
        edges = np.stack([self.first[at], self.last[at] + 1], axis=1).ravel()
        return by.reduceat(np.append(values, values[-1:]), edges)[::2]

    def levels(self) -> Iterator[tuple[int, np.ndarray]]:
        """Maximal repeats (numbers of intervals whose left neighbours differ) of each depth, deepest first."""
        for depth in np.unique(self.depth)[::-1].tolist():
            at = np.flatnonzero(self.depth == depth)
            at = at[np.argsort(self.first[at])]
            low, high = self.spread(self.left, at, np.minimum), self.spread(self.left, at, np.maximum)
            at = at[(low < 0) | (low < high)]
            if len(at):
                yield depth, at

    def members(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number within `at`, ordered suffix) of all suffixes of the intervals."""
        size = self.last[at] - self.first[at] + 1
        return np.repeat(np.arange(len(at)), size), ragged(np.arange(len(self.order)), self.first[at], size)


def _covered(table: pa.Table, least: int) -> pa.Table:
    """Which bytes of each snippet (h, d, snippet, low: its smallest document) lie in a maximal repeat that a smaller
    document has too: h, d, starts, ends."""
    own, low = Bin(table, least), table.column("low").to_numpy()
    doc = low[own.owner][own.order]
    cover = np.zeros(len(doc), np.int64)
    for depth, at in own.levels():
        number, suffix = own.members(at)
        later = (doc[suffix] > own.spread(doc, at, np.minimum)[number]) & (cover[suffix] == 0)
        cover[suffix[later]] = depth
    at = np.flatnonzero(cover)
    at = at[np.argsort(own.order[at])]
    suffix = own.order[at]
    owner, start, end = own.owner[suffix], own.place[suffix], own.place[suffix] + cover[at]
    wide = np.int64(1) << 32
    reach = np.maximum.accumulate(owner * wide + end) if len(owner) else end
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (owner[1:] * wide + start[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    stop = reach[np.append(begin[1:], len(owner)) - 1] % wide if len(owner) else end
    owner = owner[begin]
    bounds = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(bounds, len(owner)), pa.int32()), pa.array(x, pa.int32()))
    kept = table.take(pa.array(owner[bounds]))
    return pa.table([kept.column("h"), kept.column("d"), lists(start[begin]), lists(stop)], ["h", "d", "starts", "ends"])


def _groups(table: pa.Table, least: int) -> pa.Table:
    """Maximal repeats of a bin that two documents share, one row for each snippet that holds one: repeat (64 bits of a
    digest of its bytes), length, h, d, place."""
    own = Bin(table, least)
    low, high = (table.column(c).to_numpy()[own.owner][own.order] for c in ("low", "high"))
    data = table.column("snippet").to_pylist()
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for depth, at in own.levels():
        at = at[own.spread(low, at, np.minimum) < own.spread(high, at, np.maximum)]
        number, suffix = own.members(at)
        head = own.order[own.first[at]]
        names = np.array([int.from_bytes(hashlib.blake2b(data[o][p : p + depth], digest_size=8).digest(), "little", signed=True) for o, p in zip(own.owner[head].tolist(), own.place[head].tolist(), strict=True)], np.int64)
        suffix = own.order[suffix]
        for column, values in zip(out, (names[number], np.full(len(number), depth), own.owner[suffix], own.place[suffix]), strict=True):
            column.append(values)
    name, depth, owner, place = (np.concatenate(x) for x in out)
    return pa.table([pa.array(name), pa.array(depth, pa.int32()), table.column("h").take(pa.array(owner)), table.column("d").take(pa.array(owner)), pa.array(place, pa.int32())], ["repeat", "length", "h", "d", "place"])


def _shared(texts: DataFrame, least: int) -> DataFrame:
    """(id, hs): the anchors of each document that another one has as well."""
    # A row that is not known to be shared meets the others of its anchor; a known one stands alone.
    same = Window.partitionBy("h", F.when(F.col("known"), F.col("id")))
    met = _anchors(texts, least).withColumns({"low": F.min("id").over(same), "high": F.max("id").over(same)})
    return materialise(met.where("known OR low < high").groupBy("id").agg(F.collect_list("h").alias("hs")), "shared-anchors")


class Repeats:
    """Snippets of the shared anchors of texts(id long, text): tables `places` (h, d, id, at, size) and `kinds`, the different
    ones (h, d, low and high: smallest and largest document, at: a place in the smallest, size, n: rows); `sizes`: of
    each anchor with several kinds, how many (unlike). Bytes are fetched for the kinds of such anchors only."""

    def __init__(self, texts: DataFrame, least: int):
        if least < GRAM:
            raise ValueError(f"repeats of fewer than {GRAM} bytes are not looked for")
        self.texts, self.least, self.spark = texts, least, texts.sparkSession
        lists = _shared(texts, least)
        settle(self.spark)
        self.places = materialise(_places(texts.join(lists.hint("merge"), "id"), least), "places", "zstd")
        release(lists)
        settle(self.spark)
        kinds = self.places.groupBy("h", "d").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("at", "id").alias("at"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
        self.kinds = materialise(kinds, "kinds", "zstd")
        self.sizes = materialise(self.kinds.groupBy("h").agg(F.count(F.lit(1)).alias("unlike")).where("unlike > 1"), "sizes")
        self.tables = [self.places, self.kinds, self.sizes]
        del kinds
        settle(self.spark)

    def in_bins(self, step, schema: str, high: bool = False) -> DataFrame:
        """step(table, least) for the kinds (h, d, low, high if asked for, snippet) of the anchors that have several but no more than MOST:
        each task takes them in the order of their anchors, in bins of whole anchors."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            rows = 0
            for batch in batches:
                if rows + batch.num_rows >= BIN and rows:
                    # The last anchor may go on in this batch: it is kept back.
                    whole = pa.Table.from_batches(held).combine_chunks()
                    cut = int(np.searchsorted(whole.column("h").to_numpy(), whole.column("h")[-1].as_py()))
                    if cut:
                        yield from step(whole.slice(0, cut).combine_chunks(), least).to_batches()
                    held = whole.slice(cut).to_batches()
                    rows = len(whole) - cut
                held.append(batch)
                rows += batch.num_rows
            if held:
                yield from step(pa.Table.from_batches(held).combine_chunks(), least).to_batches()

        calm = self.kinds.select("h", "d", "low", *(["high"] if high else []), "at", "size").join(F.broadcast(self._hot()), "h", "left_anti")
        own = _listed(calm.join(self.sizes.where(F.col("unlike") <= MOST).select("h").hint("merge"), "h"), high)
        self.tables.append(own)
        settle(self.spark)
        some = _with_bytes(self.texts, own)
        # No partition of a repartition that is asked for by number is split or moved: an anchor stays in one task.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return some.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, schema)

    def _hot(self) -> DataFrame:
        """The anchors with more than MOST kinds and more than 1/HOT of all: at most HOT."""
        total = self.sizes.agg(F.sum("unlike")).first()[0] or 0
        return self.sizes.where((F.col("unlike") > MOST) & (F.col("unlike") * HOT > F.lit(total))).select("h")

    def windows(self) -> DataFrame | None:
        """(h, d, low, place, content, least_low, greatest_high) of the windows of the anchors with more than MOST kinds, and
        what documents have the same bytes; None where there are no such anchors."""
        large = self.sizes.where(F.col("unlike") > MOST)
        if not large.limit(1).count():
            return None
        self.tables.append(_listed(join_groups(self.kinds, large, ["h"], "unlike"), True))
        cut = _with_bytes(self.texts, self.tables[-1])
        cut = cut.select("h", "d", "low", "high", "snippet", F.explode(F.sequence(F.lit(0), F.length("snippet") - self.least)).alias("place"))
        cut = cut.select("h", "d", "low", "high", "place", F.substring("snippet", F.col("place") + 1, self.least).alias("content"))
        same = cut.groupBy("content").agg(F.min("low").alias("least_low"), F.max("high").alias("greatest_high"), F.count(F.lit(1)).alias("n"))
        return join_groups(cut, same, ["content"])

    def release(self) -> None:
        release(*self.tables)


def _texts(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), text_or_empty(text_col).alias("text"))


def repeated_spans(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """texts(id long, unique; text): per document with repeats of smaller documents: id, spans (start, end in bytes), sorted;
    together they hold every byte covered by a string of `least` bytes that a smaller document has too. Spans may overlap."""
    found = Repeats(texts, least)
    spark = texts.sparkSession
    covered = _own_losses(found)
    settle(spark)
    verdicts = _verdicts(found, covered)
    settle(spark)
    spans = _placed(found, verdicts)
    found.release()
    release(covered, verdicts)
    settle(spark)
    return spans


def _own_losses(found: Repeats) -> DataFrame:
    """h, d, starts, ends: what the smallest document of a kind loses to smaller ones."""
    covered = found.in_bins(_covered, "h long, d long, starts array<int>, ends array<int>")
    if (windows := found.windows()) is not None:
        places = windows.where("low > least_low").groupBy("h", "d").agg(F.sort_array(F.collect_list("place")).alias("starts"))
        covered = covered.unionByName(places.select("h", "d", "starts", F.transform("starts", lambda p: p + found.least).alias("ends")))
    return materialise(covered, "covered")


def _verdicts(found: Repeats, covered: DataFrame) -> DataFrame:
    """Of the kinds that some document loses: h, d, low, n, and starts and ends of what the smallest document loses."""
    verdicts = found.kinds.select("h", "d", "low", "high", "n").join(covered.hint("merge"), ["h", "d"], "left").where("low < high OR starts IS NOT NULL")
    return materialise(verdicts.drop("high"), "verdicts")


def _placed(found: Repeats, verdicts: DataFrame) -> DataFrame:
    """id, spans: what each document loses."""
    met = join_groups(found.places, verdicts, ["h", "d"])
    # All windows of a snippet that a smaller document has whole are repeats; its first document loses the covered bytes.
    own = F.arrays_zip("starts", "ends")
    spans = F.when(F.col("id") > F.col("low"), F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))))
    spans = spans.otherwise(F.transform(own, lambda s: F.struct((F.col("at") + s["starts"]).alias("start"), (F.col("at") + s["ends"]).alias("end"))))
    rows = met.select("id", F.explode(spans).alias("span"))
    # A group is what one document repeats: bounded by its text.
    return materialise(rows.groupBy("id").agg(F.sort_array(F.collect_list("span")).alias("spans")), "spans")


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Repeats of at least `least` bytes that two rows share, with all their occurrences: repeat (64 bits of a digest),
    length, id, start (bytes). A repeat is maximal within the snippets of its anchor (2 * least - 16 bytes at most), so
    a longer one comes as the chain of its parts; those of anchors with more than MOST snippets come as windows of `least`
    bytes. Null texts are empty; rows with a null id or a repeated one stand for themselves."""
    rows, key = keyed(df, id_col)
    found = Repeats(_texts(rows, key, text_col), least)
    groups = found.in_bins(_groups, "repeat long, length int, h long, d long, place int", True)
    if (windows := found.windows()) is not None:
        groups = groups.unionByName(windows.where("least_low < greatest_high").select(F.xxhash64("content").alias("repeat"), F.lit(least).alias("length"), "h", "d", "place"))
    # d is the digest that names a repeat: of a snippet that two documents share whole.
    whole = found.kinds.where("low < high").select(F.col("d").alias("repeat"), F.col("size").alias("length"), "h", "d", F.lit(0).alias("place"))
    groups = materialise(groups.unionByName(whole).distinct(), "repeat-groups")
    sizes = found.kinds.select("h", "d", "n").join(groups.groupBy("h", "d").agg(F.collect_list(F.struct("repeat", "length", "place")).alias("own")), ["h", "d"])
    met = join_groups(found.places, sizes, ["h", "d"]).select("id", "at", F.explode("own").alias("own"))
    out = met.select("own.repeat", "own.length", F.col("id").alias("__fc_key"), (F.col("at") + F.col("own.place")).alias("start")).distinct()
    return out.join(rows.select(F.col(key).alias("__fc_key"), F.col(id_col).alias("__fc_id")), "__fc_key").select("repeat", "length", F.col("__fc_id").alias(id_col), "start")


def _merged(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal covered runs of lists of (start, end), each sorted by start."""
    row = np.repeat(np.arange(len(spans)), np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    start, end = (spans.flatten().field(k).to_numpy() for k in (0, 1))
    if not len(row):
        return row, start, end
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(row * wide + end)
    new = np.append(True, (row[1:] != row[:-1]) | (row[1:] * wide + start[1:] > reach[:-1]))
    begin = np.flatnonzero(new)
    return row[begin], start[begin], reach[np.append(begin[1:], len(row)) - 1] % wide


def _with_spans(rows: DataFrame, key: str, text_col: str, least: int) -> DataFrame:
    spans = repeated_spans(_texts(rows, key, text_col), least)
    return rows.join(spans.select(F.col("id").alias("__fc_id"), F.col("spans").alias("__fc_spans")).hint("merge"), F.col(key) == F.col("__fc_id"), "left").drop("__fc_id")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The same rows and columns; from each text goes every byte that a string of `least` bytes covers which also starts in
    a row of a smaller id. Bytes of a character that is cut in two go as well. Nulls stay null. Rows that repeat an id
    stand in an order of their own; null ids come last."""
    rows, key = keyed(df, id_col)
    joined = _with_spans(rows, key, text_col, least).select(*df.columns, "__fc_spans")
    at = df.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                for k, kept in _kept(part.column(at), part.column(part.num_columns - 1)):
                    texts[k] = kept.decode(errors="ignore")
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(at).type) if k == at else part.column(k) for k in range(part.num_columns - 1)], part.schema.names[:-1])

    return joined.mapInArrow(cut, df.schema)


def _kept(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(row, remaining bytes) of the rows that lose something."""
    row, start, end = _merged(spans)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    for k in np.unique(row).tolist():
        data, out, at = texts[k].as_py().encode(), [], 0
        for a, b in zip(start[bounds[k] : bounds[k + 1]].tolist(), end[bounds[k] : bounds[k + 1]].tolist(), strict=True):
            out.append(data[at:a])
            at = b
        yield k, b"".join([*out, data[at:]])


def removal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes. A
    null text is empty. See remove()."""
    rows, key = keyed(df.select(id_col, text_col), id_col)
    joined = _with_spans(rows, key, text_col, least).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), "__fc_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                text, offsets = bytes_of(part.column(1))
                row, start, end = _merged(part.column(2))
                removed = np.bincount(row, weights=end - start, minlength=part.num_rows).astype(np.int64)
                count = np.bincount(row, minlength=part.num_rows).astype(np.int64)
                kept = dict(_kept(part.column(1), part.column(2)))
                data, bounds = text.tobytes(), offsets.tolist()
                digests = [hashlib.sha256(kept[k] if k in kept else data[bounds[k] : bounds[k + 1]]).hexdigest() for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (np.diff(offsets), removed, count, digests))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(read_table(spark, sf_dir, "documents"))
