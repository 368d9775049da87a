"""Words and shingles of whole Arrow batches, as numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased. Words and shingles are
handled as 64-bit hashes; that two of them are confused by chance is not considered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weftwork.functions.batches import CHUNK_BYTES, KEPT, _powers, buffers, chunks, mix, relieve, words

__all__ = ["CHUNK_BYTES", "KEPT", "_powers", "buffers", "chunks", "mix", "relieve", "set_id", "shingle_sets", "words"]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles. With fewer words the
    whole sequence is one shingle; a text without words has the empty set."""
    h, _, _, at = words(texts)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        if len(h) >= width:
            rows = np.full(len(h) - width + 1, np.uint64(width))
            for j in range(width):
                rows = rows * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - width + 1 + j]
            rows = mix(rows)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(rows[a : b - width + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                x = np.uint64(b - a)
                for v in h[a:b]:
                    x = x * np.uint64(0xD6E8FEB86659FD93) + v
                out.append(mix(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes, whatever their order."""
    with np.errstate(over="ignore"):
        x = mix(s * np.uint64(0xA0761D6478BD642F) + np.uint64(11)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])
