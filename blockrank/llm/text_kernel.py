"""Vectorised text work on Arrow batches: word spans, word hashes, shingles.

Words are maximal runs of bytes outside `[\\x20\\x09-\\x0D]`. A word's hash is a polynomial of its bytes
modulo 2**64, finished by a mixer, so that equal words have equal hashes in any batch, task or run; two
different words share a hash with a chance of about 2**-64. Everything works on whole texts; texts are
taken in chunks of rows so that memory depends on the chunk (or the longest text), not on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], dtype=np.uint64)
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
    return _tables["p"], _tables["i"]


def text_chunks(batch: pa.RecordBatch, column: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over a batch; a null text counts as empty."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + chunk_bytes, side="right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    np.logical_and(inside[:-1], ~cut[1:n], out=before[1:])
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    np.logical_and(inside[1:], ~cut[1:n], out=after[:-1])
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def line_offsets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the `\\n`-split lines of all texts and for each text the index of its first line.

    A line runs up to and with its line feed, which is white space and so in no word; a text of n line
    feeds has n + 1 lines, the empty ones included."""
    feeds = np.flatnonzero(data == 10) + 1
    counts = np.searchsorted(feeds, offs[1:], side="right") - np.searchsorted(feeds, offs[:-1], side="right") + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(first[-1] + 1, dtype=np.int64)
    heads = np.zeros(first[-1] + 1, dtype=bool)
    heads[first[:-1]] = True
    heads[-1] = True
    out[heads] = np.append(offs[:-1], offs[-1])
    out[~heads] = feeds
    return out, first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for spans in order that do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + _BLOCK)))
        size = int(ends[j - 1] - base)
        power, inverse = _powers(max(size + 1, _BLOCK + 4096))
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        seg = data[base : base + size].astype(np.uint64)
        seg += np.uint64(1)
        seg *= power[:size]
        np.cumsum(seg, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    out += (ends - starts).astype(np.uint64)
    return mix(out)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each member, and its place in the group."""
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return group, np.arange(total) - np.repeat(begin, counts)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and for each text the index of its first (one more at the end).

    A text of fewer than k words, but at least one, has one shingle, of all its words."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    out = np.zeros(begin[-1], dtype=np.uint64)
    for j in range(k):
        out += padded[at + j] * _STEPS[j % 8] ^ np.uint64(j // 8)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        own = np.zeros(len(few), dtype=np.uint64)
        for j in range(k - 1):
            own += np.where(n[few] > j, padded[first[few] + j] * _STEPS[j % 8] ^ np.uint64(j // 8), np.uint64(0))
        out[begin[few]] = own
    return mix(out), begin


def order_within(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The order by (group, key); groups are numbered from 0."""
    bits = np.uint64(max(1, int(groups.max()).bit_length() if len(groups) else 1))
    joined = (groups.astype(np.uint64) << (np.uint64(64) - bits)) | (keys.astype(np.uint64) >> bits)
    order = np.argsort(joined)
    joined, own = joined[order], keys[order]
    if not ((joined[1:] == joined[:-1]) & (own[1:] != own[:-1])).any():
        return order
    # different keys that differ in their last bits only
    order = np.argsort(keys)
    for low in range(0, max(1, int(groups[-1]).bit_length() if len(groups) else 1), 16):
        part = ((groups[order] >> low) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(part, kind="stable")]
    return order


def occurrence(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each member how often its key came before in its group."""
    if not len(keys):
        return np.zeros(0, np.int64)
    tagged = keys ^ (groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged, kind="stable")
    same = tagged[order]
    new = np.concatenate([[True], same[1:] != same[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order)) - start
    return out
