"""Packing documents into sequences: best fit, then local search by exchanges.

Documents longer than a sequence are cut into whole sequences, with the odd piece in
front; only the odd pieces and the shorter documents are left to pack. They are dealt
by hash into groups of bounded size; each group is packed by itself: best fit for
falling sizes, then moves between bins that are not full, each of which raises the sum
of squared fills, until none is left. What stays in bins that are not full is dealt
again into fewer groups.

Null texts count as empty and still hold the end id. Rows with equal ids are packed as
rows of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import whole_text
from .tokenizers_memo import encoder

# Pieces in a group, about; a group is packed by one task.
GROUP = 3_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and the end id, cut only where they exceed ``size``."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_many
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, rows = batch.slice(at, 512), []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range(n % size or min(n, size), n, size), n]
                    rows += [
                        (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                        for piece, (a, b) in enumerate(zip(edges, edges[1:]))
                    ]
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return chosen.mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], size: int) -> list[list[int]]:
    """Bins of places in ``sizes``: largest first, each to the fullest bin that takes it."""
    open_bins: list[list[list[int]]] = [[] for _ in range(size + 1)]
    free = 0  # a bit for each room that some bin has
    bins = []
    for place in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need = sizes[place]
        fits = free >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            room, chosen = size, []
            bins.append(chosen)
        chosen.append(place)
        left = room - need
        if left:
            open_bins[left].append(chosen)
            free |= 1 << left
    return bins


class _Search:
    """Local search over the bins that are not full.

    ``by_size`` holds the places of the pieces of each size in those bins, as sets, and
    ``present`` the sizes that occur, in order.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], size: int):
        self.sizes, self.size = sizes, size
        self.bins = [set(content) for content in bins]
        self.fill = [sum(sizes[i] for i in content) for content in bins]
        self.home = {i: b for b, content in enumerate(self.bins) for i in content}
        self.by_size: list[set[int]] = [set() for _ in range(size + 1)]
        self.present = 0
        for i in self.home:
            self._add(i)

    def _add(self, i: int) -> None:
        self.by_size[self.sizes[i]].add(i)
        self.present |= 1 << self.sizes[i]

    def _drop(self, i: int) -> None:
        self.by_size[self.sizes[i]].discard(i)
        if not self.by_size[self.sizes[i]]:
            self.present &= ~(1 << self.sizes[i])

    def _largest(self, most: int, least: int, other: int) -> int | None:
        """A piece outside bin ``other`` of at most ``most`` and at least ``least`` tokens, as long as possible,
        from a bin that has less in it than ``other``."""
        below = self.present & ((1 << (most + 1)) - 1)
        while below:
            found = below.bit_length() - 1
            if found < least:
                return None
            for i in self.by_size[found]:
                if self.home[i] != other:
                    return i
            below &= ~(1 << found)
        return None

    def _move(self, i: int, to: int) -> None:
        start, n = self.home[i], self.sizes[i]
        self.bins[start].discard(i)
        self.bins[to].add(i)
        self.fill[start] -= n
        self.fill[to] += n
        self.home[i] = to

    def _gain(self, to: int, other: int, moved: int) -> bool:
        """Whether ``moved`` tokens from ``other`` to ``to`` raise the sum of squared fills."""
        return moved > 0 and self.fill[to] + moved <= self.size and self.fill[to] + moved > self.fill[other]

    def _settle(self, b: int) -> None:
        """Full bins leave the search."""
        if self.fill[b] == self.size:
            for i in self.bins[b]:
                self._drop(i)

    def improve(self, to: int) -> bool:
        """One exchange that fills bin ``to`` further; False if there is none."""
        room = self.size - self.fill[to]
        if not room or not self.bins[to]:
            return False
        # Move one piece.
        i = self._largest(room, 1, to)
        best: tuple[int, int, tuple] = (0, 0, ())
        if i is not None and self._gain(to, self.home[i], self.sizes[i]):
            best = (self.sizes[i], self.home[i], ((i, to),))
        for n in sorted({self.sizes[a] for a in self.bins[to]}):
            a = next(x for x in self.bins[to] if self.sizes[x] == n)
            # One for one.
            i = self._largest(min(self.size, n + room), n + 1 + best[0], to)
            if i is not None and self._gain(to, self.home[i], self.sizes[i] - n):
                best = (self.sizes[i] - n, self.home[i], ((i, to), (a, self.home[i])))
            # Two of one bin for one.
            pair = self._pair(n + room, n + best[0], to)
            if pair and self._gain(to, pair[2], pair[3] - n):
                best = (pair[3] - n, pair[2], ((pair[0], to), (pair[1], to), (a, pair[2])))
            if best[0] == room:
                break
        for i, place in best[2]:
            self._move(i, place)
        if best[2]:
            self._settle(to)
            self._settle(best[1])
        return bool(best[2])

    def _pair(self, most: int, least: int, other: int) -> tuple[int, int, int, int] | None:
        """Two pieces of one of the emptiest bins that together fit best."""
        found = None
        for b in self.emptiest:
            if b == other or len(self.bins[b]) < 2:
                continue
            held = sorted((self.sizes[i], i) for i in self.bins[b])
            for at, (n, i) in enumerate(held):
                j = bisect_right(held, (most - n, 1 << 62)) - 1
                if j > at and n + held[j][0] > max(least, found[3] if found else 0):
                    found = (i, held[j][1], b, n + held[j][0])
        return found

    def run(self) -> list[set[int]]:
        again = True
        while again:
            again = False
            order = sorted((b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.size), key=lambda b: -self.fill[b])
            self.emptiest = order[-8:]
            for b in order:
                while self.improve(b):
                    again = True
        return [content for content in self.bins if content]


def pack_sizes(sizes: list[int], size: int) -> list[list[int]]:
    """Bins of places in ``sizes``, none over ``size``."""
    bins = best_fit(sizes, size)
    full, rest = [], []
    for content in bins:
        (full if sum(sizes[i] for i in content) == size else rest).append(content)
    improved = _Search(sizes, rest, size).run()
    return [*full, *(sorted(content) for content in improved)]


def pack(parts: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces.

    The pieces of bins that a group could not fill are dealt anew, into fewer groups, as
    long as that leaves less to deal.
    """
    def packed(todo: DataFrame, level: int, groups: int) -> DataFrame:
        def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            unfilled = np.zeros(len(rows), bool)
            lengths = rows["length"].tolist()
            for number, content in enumerate(pack_sizes(lengths, size)):
                at = 0
                for i in content:
                    sequence[i], offset[i] = number, at
                    at += lengths[i]
                unfilled[content] = at < size
            sequence += (level << 58) + (key[0] << 24)
            return rows.assign(sequence_id=sequence, offset=offset, unfilled=unfilled).drop(columns="_group")

        hashed = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(groups))
        schema = f"{PIECES}, sequence_id bigint, offset bigint, unfilled boolean"
        return materialize(
            todo.withColumn("_group", hashed.cast("bigint")).groupBy("_group").applyInPandas(place, schema), "packed"
        )

    # Whole sequences need no search; their numbers are negative.
    done = [parts.where(F.col("length") == size).select(
        *parts.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )]
    todo, level = parts.where(F.col("length") < size), 0
    left = todo.count()
    while left:
        groups = max(1, -(-left // GROUP))
        result = packed(todo, level, groups)
        again = result.where("unfilled").count() if groups > 1 else 0
        last = groups == 1 or again > left // 2
        done.append((result if last else result.where("not unfilled")).drop("unfilled"))
        if last:
            break
        todo, level, left = result.where("unfilled").select(*parts.columns), level + 1, again
    together = done[0]
    for rows in done[1:]:
        together = together.unionByName(rows)
    return together


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, **columns: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` ids."""
    return pack(materialize(pieces(docs, tokenizer, end_id, size, **columns), "pieces"), size)
