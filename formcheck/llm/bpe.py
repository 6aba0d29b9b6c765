"""Byte-level BPE on padded numpy matrices.

Texts are cut into pre-tokens for a whole batch at once, by the classes of their characters. Pre-tokens not
met before are grouped by length into padded matrices of symbol ids. In each round every row merges its
leftmost pair of minimum rank; pair ranks come from an open-addressing hash table, and rows without a pair
left are written out and compacted away. A worker keeps the ids of short pre-tokens, up to a number of
bytes, and finds them by hash; the bytes of all pre-tokens found are then compared with the text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import regex

from formcheck.llm.words import span_hashes

NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Longest pre-token of each matrix; beyond the last, a row is merged alone.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128)
ROWS = 8192
#: Pre-tokens of more bytes than this are not kept; all kept ones take at most about so many bytes, EACH besides
#: text and ids, beyond which a worker starts anew.
LONGEST_KEPT, KEPT_BYTES, EACH = 64, 32_000_000, 96


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices values[start:start + size], one after another."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return values[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]


class HashTable:
    """Open-addressing table from 64-bit keys to numbers from 0 on; grows by doubling."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits, self.used = 10, 0
        self._clear()
        self.put(keys, values)

    def _clear(self) -> None:
        self.shift, self.mask = np.uint64(64 - self.bits), (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that the table does not hold."""
        self.used += len(keys)
        if self.used * 3 > len(self.keys):
            held = self.keys != EMPTY
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.bits = int(self.used * 4).bit_length()
            self._clear()
        at, todo = self._slot(keys), np.arange(len(keys))
        while todo.size:
            free = todo[self.keys[at[todo]] == EMPTY]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        at = np.flatnonzero((found != keys) & (found != EMPTY))
        keys, slot = keys[at], (slot[at] + 1) & self.mask
        while at.size:
            found = self.keys[slot]
            hit = found == keys
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found != EMPTY)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & self.mask
        return out


class PairTable:
    """From a pair of symbols to the rank of its merge."""

    def __init__(self, first: np.ndarray, second: np.ndarray, rank: np.ndarray):
        keys, at = np.unique(self._key(first, second), return_index=True)
        self.table = HashTable(keys, rank[at].astype(np.int32))

    @staticmethod
    def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)

    def lookup(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where no merge exists; negative symbols are padding."""
        shape = first.shape
        first, second = first.ravel(), second.ravel()
        out = np.full(first.shape, NONE, np.int32)
        at = np.flatnonzero((first >= 0) & (second >= 0))
        ranks = self.table.get(self._key(first[at], second[at]))
        out[at] = np.where(ranks < 0, NONE, ranks)
        return out.reshape(shape)


class Vocabulary:
    """Merges, ids and bytes of one tokenizer file (.tiktoken ranks or tokenizers' .json)."""

    def __init__(self, path: str):
        self.special: dict[str, int] = {}
        if path.endswith(".json"):
            self._json(path)
        else:
            self._ranks(path)
        symbols = np.full(256, -1, np.int32)
        for token, i in self.id_of.items():
            if len(token) == 1:
                symbols[token[0]] = i
        self.byte_id = symbols

    def _ranks(self, path: str) -> None:
        with open(path, "rb") as f:
            self.id_of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        pairs = [
            (a, b, rank)
            for token, rank in self.id_of.items()
            for k in range(1, len(token))
            if (a := self.id_of.get(token[:k])) is not None and (b := self.id_of.get(token[k:])) is not None
        ]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        self.merged = np.arange(max(self.id_of.values()) + 1, dtype=np.int32)
        #: A pre-token that is a token is taken whole, whatever its merges give.
        self.whole = dict(self.id_of)

    def _json(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data["model"].get("type", "BPE") != "BPE" or data.get("normalizer") or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        for token in data["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"special token with stripping: {token}")
            self.special[token["content"]] = token["id"]
        # Printable bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        vocab = data["model"]["vocab"]
        self.id_of = {as_bytes(s): i for s, i in vocab.items() if s not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        a, b, new = (np.array([vocab[x] for x in xs], np.int64) for xs in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        self.pairs = PairTable(a, b, np.arange(len(merges)))
        self.merged = new.astype(np.int32)
        self.whole = {}

    @cached_property
    def token_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and text of each token."""
        token_of = {i: token for token, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        tokens = [token_of.get(i, b"") for i in range(max(token_of) + 1)]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(tokens), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in their order, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        text = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            for k in range(0, len(rows), ROWS):
                self._matrix(text, starts, lengths, rows[k : k + ROWS], width, done)
            low = width
        for row in np.flatnonzero(lengths > low).tolist():
            ids = self._long(text[starts[row] : starts[row] + lengths[row]])
            done.append((np.array([row]), np.array([len(ids)]), ids))
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        rows, sizes, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        size, start = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        size[rows], start[rows] = sizes, np.cumsum(sizes) - sizes
        return ragged(flat, start, size), size

    def _matrix(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, width: int, done: list) -> None:
        columns = np.arange(width + 1)
        at = np.minimum(starts[rows, None] + columns, len(text) - 1)
        ids = np.where(columns < lengths[rows, None], text[at], np.int32(-1))
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                left = ids[ended]
                done.append((rows[ended], (left >= 0).sum(axis=1), left[left >= 0]))
                on = ~ended
                rows, at, best = rows[on], at[on], best[on]
                if not len(rows):
                    return
                used = int((ids[on] >= 0).sum(axis=1).max()) + 1
                ids, ranks = ids[on, :used], ranks[on, :used]
            each = np.arange(len(rows))
            ids[each, at] = self.merged[best]
            later = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            before = np.maximum(at - 1, 0)
            new = self.pairs.lookup(np.stack([ids[each, at], np.where(at > 0, ids[each, before], -1)]), np.stack([ids[each, at + 1], ids[each, at]]))
            ranks[each, at] = new[0]
            inner = np.flatnonzero(at)
            ranks[inner, before[inner]] = new[1, inner]

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long pre-token: a round merges all disjoint copies of the leftmost minimum pair, as long as
        no pair that arises on the way ranks lower; else it merges the leftmost alone."""
        ranks = self.pairs.lookup(ids[:-1], ids[1:])
        while ranks.size and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:
                kept, last = [], -2
                for p in at.tolist():
                    if p > last + 1:
                        kept.append(p)
                        last = p
                at = np.array(kept)
            new = self.merged[best]
            if len(at) > 1:
                left = np.where(at > 0, ids[at - 1], -1)
                left[1:][np.diff(at) == 2] = new
                right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                fresh = np.full(len(at), new, np.int32)
                if min(self.pairs.lookup(left.astype(np.int32), fresh).min(), self.pairs.lookup(fresh, right.astype(np.int32)).min()) < best:
                    at = at[:1]
            ids[at] = new
            ids = np.delete(ids, at + 1)
            at = at - np.arange(len(at))
            ranks = np.delete(ranks, np.minimum(at + np.arange(len(at)), len(ranks) - 1))
            for p in (at, at - 1):
                p = p[(p >= 0) & (p < len(ids) - 1)]
                ranks[p] = self.pairs.lookup(ids[p], ids[p + 1])
        return ids


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


LETTER, NUMBER, SPACE, OTHER = range(4)
APOSTROPHE, BLANK = 0x27, 0x20


@lru_cache
def character_classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    return table


def cut(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of public_tokenizers.PATTERN begin, as flags of the code points. begin: flags of the
    code points at which a text begins.

    A pre-token is a run of one class, with one blank before it if there is one. Of white space before
    something else the last character stands apart. An apostrophe that no blank precedes takes s, t, m, d, re,
    ve or ll along."""
    n = len(points)
    kind = character_classes()[points]
    new = begin.copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    over = np.ones(len(run), bool)
    over[:-1] = begin[end[:-1]]
    last = end[(kind[run] == SPACE) & ~over] - 1
    new[last] = True
    new[last[points[last] == BLANK] + 1] = False
    at = run[(points[run] == APOSTROPHE) & (end - run == 1) & ~over]
    at = at[new[at] & (kind[np.minimum(at + 1, n - 1)] == LETTER)]
    if len(at):
        first, inside = points[at + 1], at + 2 < n
        second = np.where(inside & ~begin[np.minimum(at + 2, n - 1)], points[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (first == ord(a)) & (second == ord(b))
        new[at[one | two] + 1] = False
        after = np.concatenate([at[one] + 2, at[two] + 3])
        new[after[after < n]] = True
    return new


class Buffer:
    """Array that grows by doubling."""

    def __init__(self, kind):
        self.n, self.room = 0, np.zeros(1024, kind)

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.zeros(2 * (self.n + len(values)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts."""
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


class Encoder:
    """Encodes batches of texts; keeps what it has learnt of short pre-tokens for the next batch, in `most` bytes (None: KEPT_BYTES)."""

    most: int | None = None

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = vocabulary(path)
        self.pattern = None if pattern == public_tokenizers.PATTERN else regex.compile(pattern)
        special = self.vocabulary.special
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.table = HashTable(np.zeros(0, np.uint64), np.zeros(0, np.int32))
        #: Of each kept pre-token: its bytes (text, start, length) and its ids (ids, first, count).
        self.text, self.start, self.length = Buffer(np.uint8), Buffer(np.int64), Buffer(np.int32)
        self.ids, self.first, self.count = Buffer(np.int32), Buffer(np.int64), Buffer(np.int32)

    def _specials(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special strings in the text."""
        if self.special is None or not len(text):
            return []
        return [(m.start(), m.end(), self.vocabulary.special[m.group().decode()]) for m in self.special.finditer(text)]

    def _starts(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens begin; none spans a bound."""
        lead = np.flatnonzero((text & 0xC0) != 0x80)
        points = text if len(lead) == len(text) else np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
        if self.pattern is None:
            begin = np.zeros(len(text), bool)
            begin[bounds[bounds < len(text)]] = True
            return lead[cut(points, begin[lead])]
        data, out = text.tobytes(), []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            pieces = self.pattern.findall(data[a:b].decode())
            sizes = np.array([len(p.encode()) for p in pieces], np.int64)
            out.append(a + np.cumsum(sizes) - sizes)
        return np.concatenate([np.zeros(0, np.int64), *out])

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has. One that is a token as a whole is not merged."""
        whole = self.vocabulary.whole
        if not whole:
            return self.vocabulary.encode_pieces(pieces)
        known = [whole.get(p, -1) for p in pieces]
        todo = np.array(known) < 0
        ids, sizes = self.vocabulary.encode_pieces([p for p, k in zip(pieces, known, strict=True) if k < 0])
        size = np.ones(len(pieces), np.int64)
        size[todo] = sizes
        flat, open_ = np.zeros(int(size.sum()), np.int32), np.repeat(todo, size)
        flat[open_] = ids
        flat[~open_] = [k for k in known if k >= 0]
        return flat, size

    def _learn(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Append the pre-tokens text[start:start + length]; their numbers."""
        data, begin = text.tobytes(), len(self.start.values)
        ids, sizes = self.merge([data[a : a + b] for a, b in zip(start.tolist(), length.tolist(), strict=True)])
        self.first.extend(self.ids.n + np.cumsum(sizes) - sizes)
        self.count.extend(sizes)
        self.ids.extend(ids)
        self.start.extend(self.text.n + np.cumsum(length) - length)
        self.length.extend(length)
        self.text.extend(ragged(text, start, length))
        return np.arange(begin, begin + len(start))

    def _numbers(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each pre-token; those not yet met are learnt."""
        keys = span_hashes(text, start, start + length)
        numbers = self.table.get(keys).astype(np.int64)
        short = length <= LONGEST_KEPT
        fresh = np.flatnonzero((numbers < 0) & short)
        if len(fresh):
            unique, at, back = np.unique(keys[fresh], return_index=True, return_inverse=True)
            new = self._learn(text, start[fresh[at]], length[fresh[at]])
            self.table.put(unique, new.astype(np.int32))
            numbers[fresh] = new[back]
        return numbers

    def numbered(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, ends): of the pre-tokens of all texts, and after how many of them each text ends. Numbers hold until
        the next call; special strings are learnt as pre-tokens of one id."""
        if self.text.n + 4 * self.ids.n + EACH * self.start.n > (KEPT_BYTES if self.most is None else self.most):
            self._forget()
        specials = self._specials(text)
        specials = [s for s in specials if np.searchsorted(offsets, s[0], "right") == np.searchsorted(offsets, s[1], "left")]
        bounds = np.unique(np.concatenate([offsets, [p for s in specials for p in s[:2]]]).astype(np.int64))
        start = self._starts(text, bounds)
        if specials:
            inside = np.searchsorted(start, [p for s in specials for p in s[:2]])
            keep = np.ones(len(start), bool)
            for k, (a, b) in enumerate(inside.reshape(-1, 2).tolist()):
                keep[a + 1 : b] = False
            start = start[keep]
        length = np.diff(np.append(start, len(text)))
        numbers = self._numbers(text, start, length)
        # From here on what this call alone needs: special strings, what is too long to keep, and whatever
        # shares its hash with another pre-token.
        self.kept = (self.start.n, self.ids.n, self.text.n)
        if specials:
            at = np.searchsorted(start, [s[0] for s in specials])
            for k, s in zip(at.tolist(), specials, strict=True):
                numbers[k] = self._special(text[s[0] : s[1]], s[2])
        open_ = np.flatnonzero(numbers < 0)
        if len(open_):
            numbers[open_] = self._learn(text, start[open_], length[open_])
        same = length == self.length.values[numbers]
        if not same.all() or not np.array_equal(ragged(self.text.values, self.start.values[numbers], length), text):
            data = text.tobytes()
            for k in range(len(start)):
                a = self.start.values[numbers[k]]
                if not same[k] or self.text.values[a : a + length[k]].tobytes() != data[start[k] : start[k] + length[k]]:
                    numbers[k] = self._learn(text, start[k : k + 1], length[k : k + 1])[0]
        return numbers, np.searchsorted(start, offsets[1:])

    def _special(self, text: np.ndarray, id_: int) -> int:
        number = len(self.start.values)
        for buffer, value in ((self.first, [self.ids.n]), (self.count, [1]), (self.start, [self.text.n]), (self.length, [len(text)])):
            buffer.extend(np.array(value))
        self.ids.extend(np.array([id_]))
        self.text.extend(text)
        return number

    def _drop(self) -> None:
        """Forget the pre-tokens that the table does not lead to."""
        for buffer in (self.first, self.count, self.start, self.length):
            buffer.n = self.kept[0]
        self.ids.n, self.text.n = self.kept[1:]

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        numbers, ends = self.numbered(text, offsets)
        count = self.count.values[numbers].astype(np.int64)
        ids = ragged(self.ids.values, self.first.values[numbers], count)
        total = np.concatenate([[0], np.cumsum(count)])
        self._drop()
        return ids, np.diff(total[np.concatenate([[0], ends])])

    def sizes(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        numbers, ends = self.numbered(text, offsets)
        total = np.concatenate([[0], np.cumsum(self.count.values[numbers], dtype=np.int64)])
        self._drop()
        return np.diff(total[np.concatenate([[0], ends])])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(*joined(texts))

    def decode(self, ids: np.ndarray) -> bytes:
        starts, sizes, text = self.vocabulary.token_table
        return ragged(text, starts[ids], sizes[ids]).tobytes()


class Counter(Encoder):
    """Counts tokens. A vocabulary string that is proven to encode alone as one token counts 1 at sight; only the
    other pre-tokens are merged. single: the ids of the proven strings (see single_tokens)."""

    def __init__(self, path: str, single: np.ndarray, pattern: str = public_tokenizers.PATTERN):
        self.single = single
        super().__init__(path, pattern)

    def _forget(self) -> None:
        super()._forget()
        starts, sizes, text = self.vocabulary.token_table
        start, length = starts[self.single], sizes[self.single]
        self.text.extend(ragged(text, start, length))
        self.start.extend(np.cumsum(length) - length)
        self.length.extend(length)
        self.first.extend(np.arange(len(start)))
        self.count.extend(np.ones(len(start), np.int32))
        self.ids.extend(self.single)
        keys, at = np.unique(span_hashes(self.text.values, self.start.values, self.start.values + length), return_index=True)
        self.table.put(keys, at.astype(np.int32))


@lru_cache(maxsize=4)
def single_tokens(path: str, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    """Ids of the vocabulary strings that are one pre-token and encode alone as that token, proven by merging each."""
    own = Encoder(path, pattern)
    tokens = {}
    for token, i in own.vocabulary.id_of.items():
        try:
            tokens[token.decode()] = i
        except UnicodeDecodeError:
            continue
    text, offsets = joined(list(tokens))
    start = own._starts(text, offsets)
    alone = np.diff(np.searchsorted(start, offsets)) == 1
    strings, ids = [s for s, k in zip(tokens, alone.tolist(), strict=True) if k], np.array(list(tokens.values()))[alone]
    merged, sizes = own.merge([s.encode() for s in strings])
    one = sizes == 1
    return ids[one][merged[np.cumsum(sizes)[one] - 1] == ids[one]]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """The worker's encoder, kept between tasks."""
    return Encoder(path, pattern)


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, single: np.ndarray, pattern: str = public_tokenizers.PATTERN) -> Counter:
    """The worker's counter, kept between tasks."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, single, pattern)
    return _counters[path, pattern]
