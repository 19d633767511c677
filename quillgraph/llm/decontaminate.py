"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into passages of PASSAGE characters (shorter items are one passage), each STRIDE characters, and again into passages
of QUOTE characters, each STEP characters and with fewer edits, so that a part of an item is found as well: any QUOTE + STEP - 1 characters
in a row of an item hold a whole passage. A passage of m characters with k edits at most shares m - q + 1 - k * q of its q-grams with its
copy, on diagonals (place in the text less place in the passage) that lie within k of each other. So:

1. q-grams of the text that stand in any passage are marked; only stretches with enough marks for some passage are looked at;
2. their marks are counted by passage and by overlapping bands of diagonals, each copy's diagonals being in one band at least;
3. bands with enough marks are verified by alignment inside the band: edit distance of the whole passage to any part of the text there.

Texts are compared as lower-case letters and digits with single spaces; places are in that form. Items with fewer than q characters are
passed over. Nulls: null texts match nothing, null ids are kept, null items are passed over; repeated rows are each reported; an empty table
on either side gives no match. A benchmark of BLOCK characters or less goes to the workers as one index. A larger one goes in blocks, one
after another; texts are read once against the bits of all blocks' q-grams, and only those that may hold a copy of some block against each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import Cut, pieces, ragged

Q = 8
PASSAGE, STRIDE = 100, 50
#: The same for short quotes of a longer item.
QUOTE, STEP = 70, 8
#: Edits for each character of a passage.
EDITS = 0.08
#: The same for a short quote: it says less, so fewer edits are let pass.
QUOTE_EDITS = 0.03
BLOCK = 4_000_000
BITS = 22
#: 2 ** 30 bits (128 MB) are sent to each worker at most; of a benchmark beyond 134 million characters more texts pass, and none is lost.
SCREEN_BITS = 30
OTHER = regex.compile(r"[^\p{L}\p{N}]+")
B1, B2, B4 = (pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in (1, 2, 4))


def normal(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 characters from each place on."""
    if len(codes) < Q:
        return np.zeros(0, dtype=np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    h = c[:-1] * np.uint64(B1) + c[1:]
    h = h[:-2] * np.uint64(B2) + h[2:]
    h = h[:-4] * np.uint64(B4) + h[4:]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def starts_of(size: int, length: int, stride: int) -> list[int]:
    return [0] if size <= length else [*range(0, size - length, stride), size - length]


@dataclass
class Index:
    """Passages of one block of items, and the places of the items' q-grams by hash.

    The items' characters stand one item after another in `codes`; kind[j]:kind[j + 1] are the passages of the j-th length, by their start there.
    """

    items: np.ndarray
    start: np.ndarray
    size: np.ndarray
    need: np.ndarray
    budget: np.ndarray
    kind: list[int]
    codes: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    place: np.ndarray
    base: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]], edits: float = EDITS) -> Index:
        forms = [(item, codes_of(normal(text))) for item, text in items]
        forms = [(item, codes) for item, codes in forms if len(codes) >= Q]
        bases = np.cumsum([0, *(len(codes) for _, codes in forms)])
        own, start, size, kind = [], [], [], [0]
        for length, stride in ((PASSAGE, STRIDE), (QUOTE, STEP)):
            for (item, codes), b in zip(forms, bases.tolist()):
                if length == PASSAGE or len(codes) > length:  # a shorter item is one passage already
                    for s in starts_of(len(codes), length, stride):
                        own.append(item)
                        start.append(b + s)
                        size.append(min(length, len(codes)))
            kind.append(len(own))
        size = np.array(size, dtype=np.int64)
        rate = np.where(np.arange(len(size)) < kind[1], edits, min(edits, QUOTE_EDITS))
        budget = np.minimum((rate * size).astype(np.int64), np.maximum(size - Q, 0) // Q)
        each = [grams(codes) for _, codes in forms]
        h = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
        counts = np.array([len(e) for e in each], dtype=np.int64)
        place, base = ragged(bases[:-1], counts), np.repeat(bases[:-1], counts)
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        table = np.zeros(1 << BITS, dtype=bool)
        table[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        codes = np.concatenate([c for _, c in forms]) if forms else np.zeros(0, dtype=np.uint32)
        return cls(np.array(own, dtype=np.int64), np.array(start, dtype=np.int64), size, size - Q + 1 - budget * Q, budget, kind, codes, hashes, np.append(first, len(h)), place[order], base[order], table)

    def holding(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages that hold the q-gram of each entry, and for each of them the entry's number."""
        passage, which = [], []
        place, base = self.place[entry], self.base[entry]
        for (low, high), length in zip(zip(self.kind, self.kind[1:]), (PASSAGE, QUOTE)):
            own = self.start[low:high]
            begin = np.searchsorted(own, np.maximum(place - length + Q, base))
            n = np.searchsorted(own, place, side="right") - begin
            passage.append(ragged(begin + low, n))
            which.append(np.repeat(np.arange(len(entry)), n))
        return np.concatenate(passage), np.concatenate(which)

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """passage, start, end, edits of verified copies in one run of characters."""
        if not len(self.items) or len(codes) < Q:
            return []
        h = grams(codes)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at):
            return []
        row = np.searchsorted(self.hashes, h[at])
        ok = row < len(self.hashes)
        ok[ok] = self.hashes[row[ok]] == h[at[ok]]
        at, row = at[ok], row[ok]
        # marks in the stretch that a copy takes, for the least that any passage needs
        stretch = PASSAGE + int(self.budget.max())
        after = np.searchsorted(at, at + stretch) - np.arange(len(at))
        begin = np.flatnonzero(after >= self.need.min())
        if not len(begin):
            return []
        cover = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + after[begin], -1)
        dense = np.cumsum(cover[:-1]) > 0
        at, row = at[dense], row[dense]
        n = self.first[row + 1] - self.first[row]
        entry = ragged(self.first[row], n)
        passage, which = self.holding(entry)
        diagonal = np.repeat(at, n)[which] - self.place[entry][which] + self.start[passage]
        width = int(self.budget.max()) + 1  # bands of twice this width, by this step: any k + 1 diagonals are inside one
        low = np.floor_divide(diagonal, width)
        offset = int(low.min()) - 1
        span = int(low.max()) - offset + 2
        found, count = np.unique(np.concatenate([passage * span + (low - offset), passage * span + (low - 1 - offset)]), return_counts=True)
        p, band = found // span, found % span + offset
        keep = count >= self.need[p]
        return self._verified(codes, p[keep], band[keep] * width, 2 * width)

    def _verified(self, codes: np.ndarray, passages: np.ndarray, diagonals: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
        out = []
        far = np.int64(1 << 20)
        for s in range(0, len(passages), 4096):
            p, d = passages[s : s + 4096], diagonals[s : s + 4096]
            size = self.size[p]
            most = int(size.max())
            pattern = self.codes[np.minimum(self.start[p][:, None] + np.arange(most)[None, :], len(self.codes) - 1)]
            places = d[:, None] + np.arange(most + width)[None, :]
            inside = (places >= 0) & (places < len(codes))
            text = np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
            step = np.arange(width)
            dist, start = np.zeros((len(p), width), dtype=np.int64), np.tile(step, (len(p), 1))
            end = np.zeros(len(p), dtype=np.int64)
            begin, best = np.zeros(len(p), dtype=np.int64), np.full(len(p), far)
            for i in range(most):  # dist[:, j]: the passage's first i characters to text up to diagonal j
                both = (dist + (pattern[:, i : i + 1] != text[:, i : i + width])) * far + start
                left_out = np.full_like(both, far * far)
                left_out[:, :-1] = (dist[:, 1:] + 1) * far + start[:, 1:]
                now = np.minimum(both, left_out) - step * far
                now = np.minimum.accumulate(now, axis=1) + step * far
                dist, start = now // far, now % far
                done = np.flatnonzero(size == i + 1)
                j = dist[done].argmin(axis=1)
                best[done], begin[done], end[done] = dist[done, j], start[done, j], i + 1 + j
            good = np.flatnonzero(best <= self.budget[p])
            out += [(int(p[k]), int(d[k] + begin[k]), int(d[k] + end[k]), int(best[k])) for k in good.tolist()]
        return out


def _found(index: Index, ids: list, texts: list[str]) -> list[tuple]:
    """id, item, start, end, edits, passages: a row for each text and item, over all its passages that match."""
    spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    forms = [codes_of(normal(t)) for t in texts]
    gap = np.full(PASSAGE * 2, 0, dtype=np.uint32)
    starts = np.cumsum([0, *(len(f) + len(gap) for f in forms)])
    whole = np.concatenate([x for f in forms for x in (f, gap)]) if forms else np.zeros(0, dtype=np.uint32)
    for p, a, b, e in index.matches(whole):
        k = int(np.searchsorted(starts, max(a, 0), side="right")) - 1
        spans.setdefault((k, int(index.items[p])), []).append((p, a - int(starts[k]), b - int(starts[k]), e))
    out = []
    for (k, item), own in sorted(spans.items()):
        passages = {p for p, *_ in own}
        out.append((ids[k], item, max(0, min(a for _, a, _, _ in own)), min(len(forms[k]), max(b for _, _, b, _ in own)), min(e for *_, e in own), len(passages)))
    return out


@dataclass
class Screen:
    """The q-grams of all blocks in one table of bits: a text that no stretch has enough marks of holds no copy of any block."""

    table: np.ndarray
    bits: int
    need: int
    stretch: int

    @classmethod
    def empty(cls, characters: int) -> Screen:
        bits = min(SCREEN_BITS, max(BITS, (8 * characters).bit_length()))
        return cls(np.zeros(1 << bits - 3, dtype=np.uint8), bits, 1 << 30, PASSAGE)

    def add(self, index: Index) -> None:
        at = (index.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        np.bitwise_or.at(self.table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if len(index.items):
            self.need, self.stretch = min(self.need, int(index.need.min())), max(self.stretch, PASSAGE + int(index.budget.max()))

    def passes(self, text: str | None) -> bool:
        h = (grams(codes_of(normal(text))) >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(self.table[h >> 3] >> (h & 7) & 1)
        return len(at) >= self.need and bool((np.searchsorted(at, at + self.stretch) - np.arange(len(at)) >= self.need).any())


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> tuple[int, int, Callable[[int], list[tuple[int, str]]]]:
    """The number of blocks of `most` characters or so, the characters of all, and a function that fetches a block: only one is on the driver at a time."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = int(items.agg(F.sum(F.length("t"))).first()[0] or 0)
    n = -(-total // most)
    return n, total, lambda k: sorted(tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect())


def _rows_with(docs: DataFrame, text_col: str, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of docs that keep() wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 20):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _screened(docs: DataFrame, text_col: str, n: int, total: int, fetch: Callable[[int], list[tuple[int, str]]], edits: float) -> tuple[DataFrame, DataFrame]:
    """The few rows of docs that may hold a copy of several blocks' items, written to be read for each block, and the other rows."""
    screen = Screen.empty(total)
    for k in range(n):
        screen.add(Index.build(fetch(k), edits))
    held = docs.sparkSession.sparkContext.broadcast(screen)
    passes = lambda part: [held.value.passes(t) for t in part.column(text_col).to_pylist()]
    return Cut(_rows_with(docs, text_col, passes), "able").df, _rows_with(docs, text_col, lambda part: [not x for x in passes(part)])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """id, item, start, end, edits, passages: a row for each text and item of which a passage was found in it."""
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = T.StructType([own.schema["i"], T.StructField("item", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("start", "end", "edits", "passages")]])

    def found_in(df: DataFrame, index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "t", 1 << 20):
                    found = _found(index.value, part.column("i").to_pylist(), part.column("t").to_pylist())
                    cols = list(zip(*found, strict=True)) or [[]] * 6
                    kinds = [part.schema.field("i").type, pa.int64(), *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["i", "item", "start", "end", "edits", "passages"])

        return df.mapInArrow(run, schema)

    context = docs.sparkSession.sparkContext
    n, total, fetch = blocks(benchmark, item_col, item_text, block)
    if n == 0:
        out = docs.sparkSession.createDataFrame([], schema)
    elif n == 1:
        out = found_in(own, context.broadcast(Index.build(fetch(0), edits)))
    else:
        able, _ = _screened(own, "t", n, total, fetch, edits)
        parts = []
        for k in range(n):
            index = context.broadcast(Index.build(fetch(k), edits))
            parts.append(Cut(found_in(able, index), "found").df)
            index.destroy()
        out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("i").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits", "passages")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no passage of the benchmark was found, whatever their ids. Columns as in docs; nothing is shuffled."""

    def without(df: DataFrame, index: Broadcast) -> DataFrame:
        def keep(part: pa.RecordBatch) -> list[bool]:
            leaks = {k for k, *_ in _found(index.value, range(part.num_rows), part.column(text_col).to_pylist())}
            return [k not in leaks for k in range(part.num_rows)]

        return _rows_with(df, text_col, keep)

    context = docs.sparkSession.sparkContext
    n, total, fetch = blocks(benchmark, item_col, item_text, block)
    if n == 0:
        return docs
    if n == 1:
        return without(docs, context.broadcast(Index.build(fetch(0), edits)))
    able, rest = _screened(docs, text_col, n, total, fetch, edits)
    for k in range(n):
        index = context.broadcast(Index.build(fetch(k), edits))
        able = Cut(without(able, index), "able").df
        index.destroy()
    return rest.unionByName(able)
