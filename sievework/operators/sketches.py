"""Candidates of a set-similarity join: pairs of sets that share a token of their prefixes and may be near by their sizes, by
the token's places, and by parity sketches. No near pair is lost; the exact check is the caller's.

A parity sketch has a bit for each of b cells of token hashes: whether an odd number of the set's tokens fall in it. The sketches
of two sets differ in at most as many bits as the sets differ in tokens, so a pair whose sketches differ in more is none. b is
between a half and one of the set's size: a sketch takes about a 90th of the room of the hashes themselves.

A task gets the lists of many tokens at once, so a set and its sketch travel once for each group of lists, not once a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of token hashes, whose counts order the tokens: rare ones first.
BUCKETS = 1 << 20
#: Sets a group of lists, about; and pairs that are looked at together.
GROUP_SETS, CHUNK = 20_000, 1 << 20
CROSS, SIDE, PLACE = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)
RECORD = "g long, h long, side int, n int, sketch binary, keys binary"


def _flat(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a batch of sets as one array, and the size of each."""
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
    return tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), sizes.astype(np.int64)


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many tokens of the sets are in each bucket: BUCKETS numbers, whatever the table's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for b in batches:
            seen += np.bincount((_flat(b.column("toks"))[0] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    found = sets.select("toks").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(b: pa.RecordBatch, df: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """Of a batch's prefix tokens: their set, key (token and part), place from 1, and bucket's count; the sets' sizes; all tokens."""
    flat, sizes = _flat(b.column("toks"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    rarity = df[(flat & np.uint64(BUCKETS - 1)).astype(np.int64)]
    order = np.lexsort((flat, rarity, row))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    keep = at <= np.repeat(sizes - (sizes * t + 99) // 100 + 1, sizes)
    mine = order[keep]
    part = b.column("part").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    key = (flat[mine] ^ part[row[mine]]) * np.uint64(0x9E3779B97F4A7C15)
    return row[keep], key ^ (key >> np.uint64(29)), at[keep], rarity[mine], sizes, flat, row


def _packed(flat: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The parity sketches of a batch of sets."""
    bits = np.maximum(64, 1 << np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    cell = (ends - bits)[row] + ((flat >> np.uint64(20)).astype(np.int64) & (bits - 1)[row])
    odd = (np.bincount(cell, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)
    return _binary(np.packbits(odd, bitorder="little"), ends // 8)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _records(sets: DataFrame, df, t: int, groups: int, hot: dict[int, int]) -> DataFrame:
    """A row for each set and group of lists that it is in. A list of many sets, of hot (its key: number of blocks), is a group
    for each pair of its blocks."""
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_blocks = np.array([hot[k] for k in sorted(hot)], np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key, at, _, sizes, flat, of = _prefixes(b, df.value, t)
            if not len(row):
                continue
            h = b.column("h").to_numpy(zero_copy_only=False)
            g, mark = (key >> np.uint64(33)).astype(np.int64) % groups, at.astype(np.uint32)
            if len(hot_keys):
                where = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                is_hot = hot_keys[where] == key
                x = np.flatnonzero(is_hot)
                k = hot_blocks[where[x]]
                mine = (h[row[x]].view(np.uint64) >> np.uint64(7)).astype(np.int64) % k
                spread = np.repeat(np.arange(len(x)), k)
                other = np.arange(len(spread)) - np.repeat(np.cumsum(k) - k, k)
                mine, x = mine[spread], x[spread]
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                # groups of blocks have numbers below 0, those of many lists from 0 on
                pair = (key[x] ^ (low * 1_000_003 + high).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                flags = np.where(low != high, CROSS, np.uint32(0)) | np.where((low != high) & (mine == high), SIDE, np.uint32(0))
                rest = ~is_hot
                g = np.concatenate([g[rest], pair | np.int64(-(1 << 63))])
                mark = np.concatenate([mark[rest], mark[x] | flags.astype(np.uint32)])
                row, key = np.concatenate([row[rest], row[x]]), np.concatenate([key[rest], key[x]])
            order = np.lexsort((g, row))
            row, g = row[order], g[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])]))
            ends = np.concatenate([first[1:], [len(row)]])
            keys = np.stack([key[order].astype(np.uint32), mark[order]], axis=1)
            owner = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[first]), b.column("h").take(owner), b.column("side").take(owner), pa.array(sizes[row[first]].astype(np.int32)), _packed(flat, of, sizes).take(owner), _binary(keys, ends * 8)],
                schema=pa.schema([("g", pa.int64()), ("h", pa.int64()), ("side", pa.int32()), ("n", pa.int32()), ("sketch", pa.binary()), ("keys", pa.binary())]),
            )

    return sets.select("h", "part", "side", "toks").mapInArrow(make, RECORD)


def _ragged(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in one array, and how many each row has."""
    parts, counts = [], []
    for c in column.chunks:
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        counts.append(np.diff(offsets))
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.concatenate(parts).tobytes(), dtype), np.concatenate(counts) // size


def _differ(a: np.ndarray, b: np.ndarray, words: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of rows a and b differ; the longer one, of twice the length, is folded."""
    out = np.zeros(len(a), np.int64)
    width = np.minimum(words[a], words[b])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for x in np.array_split(at, 1 + len(at) * int(w) // (4 * CHUNK)):
            sides = []
            for r in (a[x], b[x]):
                cells = values[starts[r][:, None] + np.arange(w)]
                longer = np.flatnonzero(words[r] > w)
                for fold in range(1, int(words[r].max(initial=w)) // int(w)):
                    more = longer[words[r[longer]] > fold * w]
                    cells[more] ^= values[starts[r[more]][:, None] + fold * w + np.arange(w)]
                sides.append(cells)
            out[x] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    return out


def _pairs(group: pa.Table, t: int, sided: bool) -> pa.Table:
    """a, b (hashes of ids) of the sets of a group that may be near."""
    h, n = group.column("h").to_numpy(), group.column("n").to_numpy().astype(np.int64)
    side = group.column("side").to_numpy()
    values, words = _ragged(group.column("sketch"), np.uint64)
    entries, counts = _ragged(group.column("keys"), np.uint32)
    starts, entries = np.cumsum(words) - words, entries.reshape(-1, 2)
    row = np.repeat(np.arange(len(h)), counts // 2)
    # the entries of a list stand together, in the order of their sets' sizes: what may be near an entry is a range after it
    order = np.lexsort((n[row], entries[:, 0]))
    key, row, mark = entries[order, 0].astype(np.uint64), row[order], entries[order, 1]
    at = (mark & PLACE).astype(np.int64)
    size = np.uint64(1 << 31)
    until = np.searchsorted(key * size + n[row].astype(np.uint64), key * size + np.minimum(n[row] * 100 // t, (1 << 31) - 1).astype(np.uint64), side="right")
    many = until - np.arange(len(row)) - 1
    ends = np.cumsum(many)
    found = [np.zeros((0, 2), np.int64)]
    begin = 0
    while begin < len(row):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, side="right")))
        x = np.repeat(np.arange(begin, end), many[begin:end])
        y = x + 1 + np.arange(len(x)) - np.repeat(ends[begin:end] - many[begin:end] - (ends[begin - 1] if begin else 0), many[begin:end])
        begin = end
        total = n[row[x]] + n[row[y]]
        need = (t * total + 99 + t) // (100 + t)
        ok = (1 + np.minimum(n[row[x]] - at[x], n[row[y]] - at[y]) >= need) & ((mark[x] & CROSS == 0) | (mark[x] & SIDE != mark[y] & SIDE))
        ok &= (side[row[x]] != side[row[y]]) if sided else (h[row[x]] != h[row[y]])
        a, b, spare = row[x[ok]], row[y[ok]], (total - 2 * need)[ok]
        near = _differ(a, b, words, values, starts) <= spare
        a, b = a[near], b[near]
        low = (side[a] < side[b]) if sided else (h[a] < h[b])
        found.append(np.unique(np.stack([np.where(low, h[a], h[b]), np.where(low, h[b], h[a])], axis=1), axis=0))
    both = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": both[:, 0], "b": both[:, 1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def candidates(sets: DataFrame, counted: DataFrame, t: int, most: int, sided: bool = False) -> DataFrame:
    """ha, hb: pairs of hashes of ids. sets: h (hash of the id), part (hash of that within which sets are compared), side (0, or
    1 for the other side; if sided, only sets of different sides are compared, and ha is of side 0), toks. counted: tokens
    whose counts give their order. Lists of more than `most` sets are split into blocks of about so many."""
    counts = bucket_counts(counted)
    df = sets.sparkSession.sparkContext.broadcast(counts)

    def long_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, key, _, rarity, *_ = _prefixes(b, df.value, t)
            yield pa.RecordBatch.from_arrays([pa.array(key[rarity > most].view(np.int64))], names=["key"])

    keyed = counted.select("h", "part", "side", "toks")
    found = keyed.mapInArrow(long_lists, "key long").groupBy("key").count().where(F.col("count") > most).collect() if (counts > most).any() else []
    hot = {r["key"] % (1 << 64): -(-r["count"] // most) for r in found}
    groups = 8 + counted.count() // GROUP_SETS
    records = _records(sets, df, t, groups, hot)
    pairs = records.groupBy("g").applyInArrow(lambda g: _pairs(g, t, sided), "a long, b long")
    return pairs.distinct().toDF("ha", "hb")
