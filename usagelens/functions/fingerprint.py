"""Content fingerprints: whitespace-free MurmurHash2, and an entry-set digest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Fixed values of 32-bit MurmurHash2, its seed here, and the bytes left out.
MULTIPLIER = np.uint32(0x5BD1E995)
SHIFT = np.uint32(24)
SEED = 1
WHITESPACE = b"\t\n\r "


def murmur2_batch(blobs: list[bytes]) -> np.ndarray:
    """Hash many byte strings at once.

    The hash is a chain over four-byte words, so it cannot be cut along one
    string. It runs instead across the strings of a batch, longest first: step
    ``i`` mixes word ``i`` of every string that still has one.
    """
    bare = [b.translate(None, WHITESPACE) for b in blobs]
    size = np.array([len(b) for b in bare], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    sizes = size[order]
    words = sizes // 4
    ends = np.cumsum(words)
    starts = ends - words
    flat = np.frombuffer(b"".join(bare[i][: (size[i] // 4) * 4] for i in order), dtype="<u4")
    with np.errstate(over="ignore"):
        mixed = flat * MULTIPLIER
        mixed = (mixed ^ (mixed >> SHIFT)) * MULTIPLIER
        h = sizes.astype(np.uint32) ^ np.uint32(SEED)
        alive = len(bare)
        for step in range(int(words.max(initial=0))):
            while words[alive - 1] <= step:
                alive -= 1
            h[:alive] = (h[:alive] * MULTIPLIER) ^ mixed[starts[:alive] + step]
        tails = np.array(
            [int.from_bytes(bare[i][(size[i] // 4) * 4:], "little") for i in order], dtype=np.uint32
        )
        h = np.where(sizes % 4 > 0, (h ^ tails) * MULTIPLIER, h)
        h = (h ^ (h >> np.uint32(13))) * MULTIPLIER
        h = h ^ (h >> np.uint32(15))
    out = np.zeros(len(bare), dtype=np.int64)
    out[order] = np.where(sizes == 0, 0, h)
    return out


@F.pandas_udf(T.LongType())
def content_fingerprint(content: pd.Series) -> pd.Series:
    """MurmurHash2 of a binary column with whitespace bytes removed; empty is 0."""
    present = content.notna()
    out = pd.Series(pd.array([pd.NA] * len(content), dtype="Int64"), index=content.index)
    if present.any():
        out[present] = murmur2_batch([bytes(b) for b in content[present]])
    return out


def entry_set_digest(position: Column, path: Column, content_hash: Column) -> list[Column]:
    """Aggregates that identify an archive's ordered entries without collecting them.

    Each entry (its position included, so order counts) becomes a SHA-256, and the
    four 64-bit words are xor-ed over the entries. Xor is partial on the map
    side, so an archive of any size, or any number of them, costs one row per task.
    """
    entry = F.sha2(F.concat_ws("\x1f", position.cast("string"), path, content_hash), 256)
    word = lambda i: F.conv(F.substring(entry, 1 + 16 * i, 16), 16, -10).cast("bigint")
    return [F.bit_xor(word(i)).alias(f"digest_{i}") for i in range(4)] + [
        F.count(F.lit(1)).alias("entries")
    ]
