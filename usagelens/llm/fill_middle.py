"""Fill-in-the-middle transformation, with cuts located by a Fenwick tree.

A text's UTF-8 bytes are taken in fixed blocks. A Fenwick tree holds for every block how
many units end in it and how many code points start in it. A unit is a run of other
characters with the white space before it, or the white space at the end of the text; so
its last byte is told by itself and the byte after it, and blocks are counted without
one another. The cut after ``k`` units is found by a binary-lifting descent to the block
in which the ``k``-th unit ends, and then among the ends of that block alone. The tree
takes two numbers a block and counting takes windows of blocks, so a very long text
needs its bytes and little besides.

Cuts and the form are drawn from the sha256 of seed and id, so any task repeats them.
The output is put together, and taken apart again, by Spark's own string functions.

Null texts count as empty and are plain; a null id draws as the empty text. Rows with
equal ids draw alike, each on its own text. Other columns stay as they are, apart from
those named like a result, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
BLOCK = 1024  # bytes
WINDOW = 1024  # blocks that are counted at once
SEED, RATE, SPM = 42, 50, 80  # percent of texts that are cut, and of those with the suffix first
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]
# White space as the units count it (fixed values).
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def _ends(window: np.ndarray, after: int | None) -> np.ndarray:
    """Which bytes end a unit; ``after`` is the byte behind the window, None at the end of the text."""
    space = SPACE[window]
    follows = np.empty(len(window), bool)
    follows[:-1] = space[1:]
    follows[-1] = True if after is None else SPACE[after]
    ends = follows & ~space
    if after is None:
        ends[-1] = True
    return ends


class UnitTree:
    """Counts of units and code points over the blocks of one text."""

    def __init__(self, data: bytes, block: int = BLOCK, window: int = WINDOW):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        blocks = -(-len(self.data) // block)
        # Column 0 counts units, column 1 code points; row 0 stays empty.
        self.tree = np.zeros((blocks + 1, 2), np.int64)
        for first in range(0, blocks, window):
            some = self._bytes(first, min(first + window, blocks))
            starts = np.arange(0, len(some), block)
            counts = self.tree[first + 1:first + 1 + len(starts)]
            counts[:, 0] = np.add.reduceat(_ends(some, self._after(first, window)), starts, dtype=np.int64)
            counts[:, 1] = np.add.reduceat((some & 0xC0) != 0x80, starts, dtype=np.int64)
        step = 1
        while step <= blocks:
            parents = np.arange(2 * step, blocks + 1, 2 * step)
            self.tree[parents] += self.tree[parents - step]
            step *= 2

    def _bytes(self, first: int, last: int) -> np.ndarray:
        return self.data[first * self.block:last * self.block]

    def _after(self, first: int, blocks: int) -> int | None:
        at = (first + blocks) * self.block
        return int(self.data[at]) if at < len(self.data) else None

    def units(self) -> int:
        """Units of the whole text: the sum over all blocks."""
        at, total = len(self.tree) - 1, 0
        while at:
            total += int(self.tree[at, 0])
            at &= at - 1
        return total

    def cut(self, units: int) -> int:
        """Code points up to the end of the ``units``-th unit."""
        if units <= 0:
            return 0
        blocks = len(self.tree) - 1
        at, left, chars = 0, units, 0
        for step in (1 << i for i in reversed(range(blocks.bit_length()))):
            if at + step <= blocks and self.tree[at + step, 0] < left:
                at += step
                left -= int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
        inside = self._bytes(at, at + 1)
        end = np.flatnonzero(_ends(inside, self._after(at, 1)))[left - 1]
        # The last byte of a unit is also that of a code point, so all that start up to it are whole.
        return chars + int(np.count_nonzero((inside[:end + 1] & 0xC0) != 0x80))


def _cuts(text: Column, first: Column, second: Column) -> Column:
    """n, and the code points before each of the two drawn cuts."""

    @F.pandas_udf("n bigint, low bigint, high bigint")
    def cuts(texts: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
        rows = []
        for data, a, b in zip(texts, firsts, seconds):
            tree = UnitTree(data)
            n = tree.units()
            low, high = sorted((a % (n + 1), b % (n + 1)))
            rows.append((n, tree.cut(low), tree.cut(high)))
        return pd.DataFrame(rows, columns=["n", "low", "high"], dtype="int64")

    return cuts(text.cast("binary"), first, second)


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels that can be found again: none starts where another one, or itself, goes on."""
    before, suffix, middle = sentinels
    if len({before, suffix, middle}) < 3:
        raise ValueError("sentinels differ from one another")
    for a in sentinels:
        for b in sentinels:
            if a != b and a in b or any(a.endswith(b[:i]) for i in range(1, len(b) + (a != b))) or not a:
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")
    return before, suffix, middle


def transform(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows with n, form, prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are cut, ``spm`` percent of those with the suffix first;
    empty texts and texts that spell a sentinel stay plain.
    """
    p, s, m = _checked(sentinels)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    kept = [c for c in docs.columns if c not in RESULTS]
    text = F.col("_text")
    plain = (F.length(text) == 0) | text.contains(p) | text.contains(s) | text.contains(m) | (drawn[2] % 100 >= rate)
    cut = (
        docs.select(F.struct(*kept).alias("_row"), whole_text(text_col).alias("_text"), digits.alias("_h"))
        .select("_row", "_text", "_h", _cuts(text, drawn[0], drawn[1]).alias("_cut"))
        .select(
            "_row", "_text", F.col("_cut.n").alias("n"), F.col("_cut.low").cast("int").alias("_low"), F.col("_cut.high").cast("int").alias("_high"),
            F.when(plain, "plain").when(drawn[3] % 100 < spm, "spm").otherwise("psm").alias("form"),
        )
    )
    prefix = F.substring(text, F.lit(1), F.col("_low"))
    middle = F.substring(text, F.col("_low") + 1, F.col("_high") - F.col("_low"))
    suffix = F.substring(text, F.col("_high") + 1, F.length(text) - F.col("_high"))
    whole = F.col("form") == "plain"
    return cut.select(
        "_row.*", "n", "form", F.when(~whole, F.col("_low").cast("bigint")).alias("prefix_chars"),
        F.when(~whole, (F.col("_high") - F.col("_low")).cast("bigint")).alias("middle_chars"),
        F.when(whole, text)
        .when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).alias("output"),
    )


def restored(output: str = "output", form: str = "form", sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text again, from an output and its form alone."""
    p, s, m = _checked(sentinels)
    whole = F.col(output)

    def between(start: str, end: str) -> Column:
        """What follows the leading ``start``, up to ``end``; the text spells neither."""
        return F.substring(whole, F.lit(len(start) + 1), F.instr(whole, end) - len(start) - 1)

    def after(mark: str) -> Column:
        return F.substring(whole, F.instr(whole, mark) + len(mark), F.length(whole))

    inner = lambda a, b: F.substring(whole, F.instr(whole, a) + len(a), F.instr(whole, b) - F.instr(whole, a) - len(a))
    psm = F.concat(between(p, s), after(m), inner(s, m))
    spm = F.concat(inner(p, m), after(m), between(s, p))
    return F.when(F.col(form) == "plain", whole).when(F.col(form) == "psm", psm).otherwise(spm)


def digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Checksums of the outputs and of the texts that come back from them."""
    return cut.select(
        F.col(id_col).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )
