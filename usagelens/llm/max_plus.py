"""SentencePiece encoding of very long documents by a max-plus scan, and decoding.

Byte-pair encoding is a best path: a row of pieces is the encoding of its text exactly
if every two neighbours are the encoding of theirs. So the states of a scan are the last
piece and where it ends; a step to a piece that fits weighs 0, any other minus infinity.
A long document is cut into chunks. A chunk, seen with some characters on both sides,
gives the matrix from the states at its start to those at its end: which of them are
joined by a path of weight 0 (kept sparse; most chunks meet a word start, where all
paths are one). Matrices are combined pairwise, as a tree; going down the tree fixes the
state at every cut, and every chunk is traced back alone.

Inside a chunk, a space after another character always starts a piece, so the words
between such places have encodings of their own; the library makes them, once for each
worker that meets them. Paths are followed through what the cuts leave open: the words
they cut, and chunks without such a place.

A document of up to ``CHUNK`` characters is one chunk with known ends. Models are BPE
models without normalisation other than the space in front. Cuts avoid runs of spaces,
so a run longer than a chunk stays in one. Null texts count as empty and have no ids.
Null and repeated ids are kept as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

from ..session import materialize
from .common import whole_text

CHUNK = 1 << 16
SPACE = "▁"
MEMORY = 400_000
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
_MODELS: dict[str, "Model"] = {}


def model(path: str) -> "Model":
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


class Model:
    def __init__(self, path: str):
        loaded = self.library = SentencePieceProcessor(model_file=path)
        self.pieces = [loaded.id_to_piece(i) for i in range(len(loaded))]
        usable = [i for i in range(len(loaded)) if not (loaded.is_byte(i) or loaded.is_control(i) or loaded.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in usable}
        self.scores = {self.pieces[i]: loaded.get_score(i) for i in usable}
        self.bytes = [loaded.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.of_byte = {i: b for b, i in enumerate(self.bytes)}
        self.longest = max(map(len, self.ids))
        self.fits: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}
        self.runs: dict[int, bytes] = {}

    # ---------------------------------------------------------------- pieces

    def merged(self, text: str) -> list[str]:
        """The encoding by merges: the best pair first, the left one of equals."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        ahead = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols):
                pair = symbols[i] + symbols[j]
                if pair in self.scores:
                    heapq.heappush(heap, (-self.scores[pair], i, j, pair))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if symbols[i] is None or j >= len(symbols) or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = after[j]
            if after[j] < len(symbols):
                ahead[after[j]] = i
            offer(i)
            if ahead[i] >= 0:
                offer(ahead[i])
        return [s for s in symbols if s is not None]

    def fit(self, left: str, right: str) -> bool:
        """Whether two pieces are the encoding of their text."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > MEMORY:
                self.fits.clear()
            known = left + right not in self.scores and self.merged(left + right) == [left, right]
            self.fits[left, right] = known
        return known

    def coded(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for piece in pieces:
            found = self.ids.get(piece)
            ids += [found] if found is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    # ----------------------------------------------------------------- paths

    def forward(self, text: str, starts: dict[int, dict[str, int]], end: int, over: int) -> dict[int, dict[str, tuple[int, list]]]:
        """All pieces on valid paths: by end, with the set of starts they follow from (as bits) and their predecessors.

        ``starts`` has the pieces that end where paths begin. Pieces that begin before
        ``end`` are followed, also where they reach up to ``over``.
        """
        table: dict[int, dict[str, tuple[int, list]]] = {
            at: {piece: (bits, []) for piece, bits in found.items()} for at, found in starts.items()
        }
        for at in range(min(starts), end):
            here = table.get(at)
            if not here:
                continue
            reach = min(over, at + self.longest)
            options = [text[at:to] for to in range(at + 1, reach + 1) if text[at:to] in self.ids] or [text[at]]
            if len(options[0]) > 1:
                options.insert(0, text[at])
            for piece in options:
                alone = len(piece) == 1 and piece not in self.ids
                for last, (bits, _) in here.items():
                    if not last or alone or self.fit(last, piece):
                        slot = table.setdefault(at + len(piece), {})
                        old = slot.get(piece)
                        slot[piece] = (bits | old[0], [*old[1], (at, last)]) if old else (bits, [(at, last)])
        return table

    @staticmethod
    def trace(table: dict, at: int, piece: str, bit: int) -> list[str]:
        """The pieces of the path of one start that ends with a piece; the start's own piece is left out."""
        found: list[str] = []
        while True:
            before = table[at][piece][1]
            if not before:
                return found[::-1]
            found.append(piece)
            at, piece = next((a, p) for a, p in before if table[a][p][0] & bit)

    def led(self, run: int, pieces: list[str]) -> bytes:
        """Ids of a word that follows a run of spaces, the last of them in ``pieces`` already."""
        if run > 1 and pieces[0] == SPACE:
            return self.spaces(run) + self.coded(pieces[1:])
        return (self.spaces(run - 1) if run > 1 else b"") + self.coded(pieces)

    def spaces(self, run: int) -> bytes:
        if run not in self.runs:
            self.runs[run] = self.coded(self.merged(SPACE * run))
        return self.runs[run]

    def whole(self, text: str) -> bytes:
        """Ids of text that starts with a space and ends where a piece has to end.

        The library encodes words that are new here; it puts the first space in front itself.
        """
        units = _UNIT.findall(text)
        known = self.units
        new = {unit for unit in set(units) if unit not in known}
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = set(units)
        known.update((unit, self.spaces(len(unit))) for unit in new if unit[-1] == SPACE)
        listed = [unit for unit in new if unit[-1] != SPACE]
        for unit, ids in zip(listed, self.library.encode([u[1:].replace(SPACE, " ") for u in listed], num_threads=1) if listed else ()):
            known[unit] = np.array(ids, "<u4").tobytes()
        return b"".join([known[u] for u in units])

    # ---------------------------------------------------------------- chunks

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces over a cut, as characters before and after it."""
        found = [
            (cut - a, b - cut) for a in range(max(0, cut - self.longest), cut) for b in range(cut, min(len(text), a + self.longest) + 1)
            if text[a:b] in self.ids
        ]
        return found if text[cut - 1] in self.ids else [*found, (1, 0)]

    def chunk(self, text: str, begin: int, end: int, want: tuple | None = None):
        """The matrix of a chunk ``text[begin:end]``, or the ids of the path between two states.

        State ``None`` is the start or end of a document. ``want`` is a pair of states.
        """
        first, last = begin == 0, end == len(text)
        sync = lambda a, b: next((i for i in range(max(a, 1), b + 1) if i < len(text) and text[i] == SPACE and text[i - 1] != SPACE), None)
        head = 0 if first else sync(begin, end)
        entries: list = [None] if first else self.states(text, begin)
        if head is None:
            return self._spaceless(text, begin, end, entries, want)
        # The part up to the first word start, for every entry.
        starts: dict[int, dict[str, int]] = {}
        if not first:
            for i, (a, b) in enumerate(entries):
                if begin + b <= head:
                    starts.setdefault(begin + b, {}).setdefault(text[begin - a:begin + b], 0)
                    starts[begin + b][text[begin - a:begin + b]] |= 1 << i
            table = self.forward(text, starts, head, head) if starts else {}
            arrived = {i for bits, _ in table.get(head, {}).values() for i in range(len(entries)) if bits >> i & 1}
        else:
            table, arrived = {}, {0}
        # The part after the last word start, for every exit.
        tail = head
        if last:
            tail = end
        else:
            for i in range(end, head, -1):
                if text[i] == SPACE and text[i - 1] != SPACE:
                    tail = i
                    break
        if tail == end:
            closing, exits = None, [None if last else (a, 0) for a in self._ends(text, head, end, last)]
        else:
            run = len(text[tail:end]) - len(text[tail:end].lstrip(SPACE))
            closing = self.forward(text, {tail + run - 1: {"": 1}}, end, len(text))
            exits = [(len(p) - (at - end), at - end) for at in range(end, len(text) + 1) for p in closing.get(at, {}) if at - len(p) < end]
        if want is None:
            return {"rows": [[entries[i], exits] for i in sorted(arrived)]}
        ids = b""
        if not first:
            i = entries.index(want[0])
            piece = next(p for p, (bits, _) in table[head].items() if bits >> i & 1)
            ids = self.coded(self.trace(table, head, piece, 1 << i))
        ids += self.whole(text[head:tail])
        if closing is not None:
            a, b = want[1]
            pieces = self.trace(closing, end + b, text[end - a:end + b], 1)
            ids += self.led(run, pieces)
        return ids

    def _ends(self, text: str, head: int, end: int, last: bool) -> list[int]:
        """Length of the piece that ends at a word start; at a document's end it does not matter."""
        if last:
            return [0]
        if end == head:
            return [a for a, b in self.states(text, end) if b == 0]
        unit = _UNIT.findall(text[head:end])[-1]
        word = SPACE + unit.lstrip(SPACE)
        table = self.forward(word, {0: {"": 1}}, len(word), len(word))
        return [len(p) for p in table[len(word)]]

    def _spaceless(self, text: str, begin: int, end: int, entries: list, want: tuple | None):
        starts: dict[int, dict[str, int]] = {}
        for i, (a, b) in enumerate(entries):
            starts.setdefault(begin + b, {})[text[begin - a:begin + b]] = 1 << i
        table = self.forward(text, starts, end, len(text))
        if end == len(text):
            exits = {None: table.get(end, {})}
        else:
            exits = {
                (len(p) - (at - end), at - end): {p: table[at][p]}
                for at in range(end, len(text) + 1) for p in table.get(at, {}) if at - len(p) < end
            }
        if want is None:
            return {"rows": [
                [entry, [e for e, found in exits.items() if any(bits >> i & 1 for bits, _ in found.values())]]
                for i, entry in enumerate(entries)
            ]}
        bit = 1 << entries.index(want[0])
        at = end + (want[1][1] if want[1] else 0)
        piece = next(p for p, (bits, _) in exits[want[1]].items() if bits & bit)
        return self.coded(self.trace(table, at, piece, bit))

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        parts, held = [], bytearray()
        for i in numbers:
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append(self.pieces[i])
        parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ")[1:]


def _key(state) -> tuple | None:
    return tuple(state) if state is not None else None


def compose(a: dict, b: dict) -> dict:
    """The product of two matrices; rows without an exit go."""
    made = {entry: sorted({e for mid in exits for e in b.get(mid, ())}, key=str) for entry, exits in a.items()}
    return {entry: exits for entry, exits in made.items() if exits}


def settle(matrices: list[dict], entry, exit_) -> list[tuple]:
    """The states at both ends of every chunk of a document, from products in a tree."""
    if len(matrices) == 1:
        return [(entry, exit_)]
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([compose(below[i], below[i + 1]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    ends = [(entry, exit_)]
    for below in levels[-2::-1]:
        parts: list[tuple] = []
        for i, (start, stop) in enumerate(ends):
            if 2 * i + 1 < len(below):
                mid = next(m for m in below[2 * i][start] if stop in below[2 * i + 1].get(m, ()))
                parts += [(start, mid), (mid, stop)]
            else:
                parts.append((start, stop))
        ends = parts
    return ends


def _escaped(text: str) -> str:
    return text.replace(" ", SPACE)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every document."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))

    @F.pandas_udf("binary")
    def single(texts: pd.Series) -> pd.Series:
        held = model(path)
        return pd.Series([held.whole(SPACE + _escaped(t)) if t else b"" for t in texts], dtype="object")

    short = rows.where(F.char_length("text") <= chunk).select("doc_id", single("text").alias("ids"))
    # Chunks end with a character that is no space, or with the text.
    cut = F.filter(
        F.regexp_extract_all("text", F.lit(f"(?s).{{0,{chunk - 1}}}[ {SPACE}]*(?:[^ {SPACE}]|\\z)"), F.lit(0)), lambda c: F.length(c) > 0
    )
    side = 32  # more than the longest piece on both sides
    long = materialize(
        rows.where(F.char_length("text") > chunk)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", cut.alias("parts"))
        .select("row", "doc_id", "parts", F.posexplode("parts").alias("k", "chunk"))
        .select(
            "row", "doc_id", "k", "chunk", F.size("parts").alias("n"),
            F.coalesce(F.right(F.get("parts", F.col("k") - 1), F.lit(side)), F.lit("")).alias("left"),
            F.coalesce(F.left(F.get("parts", F.col("k") + 1), F.lit(side)), F.lit("")).alias("right"),
        ), "chunks",
    )

    def place(k: int, left: str, part: str, right: str) -> tuple[str, int, int]:
        left = SPACE if k == 0 else _escaped(left)
        whole = left + _escaped(part) + _escaped(right)
        return whole, 0 if k == 0 else len(left), len(left) + len(part)

    @F.pandas_udf("string")
    def matrix(k: pd.Series, left: pd.Series, part: pd.Series, right: pd.Series) -> pd.Series:
        held = model(path)
        return pd.Series([json.dumps(held.chunk(*place(*row))) for row in zip(k, left, part, right)], dtype="object")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        matrices = [
            {_key(entry): [_key(e) for e in exits] for entry, exits in json.loads(text)["rows"]} for text in group["matrix"]
        ]
        return group[["row", "k"]].assign(ends=[json.dumps(pair) for pair in settle(matrices, None, None)])

    matrices = long.select("row", "k", matrix("k", "left", "chunk", "right").alias("matrix"))
    settled = materialize(matrices.groupBy("row").applyInPandas(ends, "row bigint, k int, ends string"), "ends")

    @F.pandas_udf("binary")
    def traced(k: pd.Series, left: pd.Series, part: pd.Series, right: pd.Series, pair: pd.Series) -> pd.Series:
        held = model(path)
        return pd.Series([
            held.chunk(*place(*row[:4]), want=tuple(_key(s) for s in json.loads(row[4]))) for row in zip(k, left, part, right, pair)
        ], dtype="object")

    pieces = long.join(settled, ["row", "k"]).select("row", "doc_id", "k", traced("k", "left", "chunk", "right", "ends").alias("ids"))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "ids": [b"".join(group["ids"])]})

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary"
    return short.unionByName(pieces.groupBy("row").applyInPandas(joined, schema))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and the sha256 of the text that the ids decode to."""
    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = model(path)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [len(ids) // 4 for ids in batch["ids"]],
                "ids_crc32": [zlib.crc32(ids) for ids in batch["ids"]],
                "decoded_sha256": [hashlib.sha256(held.decode(ids).encode("utf-8", "surrogatepass")).hexdigest() for ids in batch["ids"]],
            })

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.mapInPandas(described, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string")
