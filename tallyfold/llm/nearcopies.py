"""Near-duplicate texts: pairs whose sets of consecutive words have at least a given Jaccard similarity.

A text is the set of its hashed word windows, a vector of bits.  The generalised pigeonhole principle: of two texts with
n and m windows, n <= m, that are similar to s, at most e = n (1 - s) / (1 + s) of the smaller one's windows are missing
in the other.  Cut its windows into partitions of correlated bits (windows that stand side by side, which an edit changes
together) and give partition i a threshold t_i >= -1: if the t_i + 1 add up to e + `MEET`, then in some partitions no more
than t_i windows are missing, and asking for any t_i + 1 windows of each partition meets the other text in `MEET` windows
(in all common ones, if they are fewer).  A partition is therefore probed under its t_i + 1 rarest windows.  The
thresholds with the least estimated number of candidates are a dynamic programme over the partitions; as each further
window of a partition costs at least as much as the one before, its solution is known in closed form: the e + `MEET`
windows with the least estimated counts, wherever they stand (`allocated`).  Counts are estimated by a sketch over all
texts; a window counted once is certain to stand in one text and costs nothing.

Texts that meet in a window are held against each other at once by size and by place: what follows the windows they
share first must leave room for the common ones.  Pairs that meet often enough are filtered by 256 parity bits of the
sets, whose Hamming distance never exceeds the size of the symmetric difference, and verified on the full sets.  No step
loses a pair, so the operator has no inexact setting.

A window that very many texts are asked under is split: its texts fall into groups, and each pair of groups meets in a
cell of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyfold.llm.classes import expanded
from tallyfold.storage import discard, written

KEYS = 32  # windows of a text that count sketches and buckets are planned for
MOST_SLOTS = 1 << 27  # a count sketch has as many counters as keys need, and never more: 64 MiB
PIECE = 1 << 16  # slots in a piece of a count sketch, so that a slot in it takes two bytes
BUCKET = 500_000  # windows that a task holds at once when texts meet, about
HOT = 20_000  # texts of one window that meet in one cell, about
FLUSH = 1 << 21  # counters that a counting task holds before it sends them on
#: What the four bits of a counter stand for; up to 4 a count is exact, above it is rounded down.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 9, 16, 32, 128, 512, 2048, 16384, 131072, 1 << 20, 1 << 24], dtype=np.int64)
#: Windows in which similar texts must meet: each more is one more window sent of each text, and fewer pairs to verify.
MEET = 3
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, M1, dtype=np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * M2
        x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (longest runs of letters and digits, lower-cased) of a batch, and each text's number of words."""
    # the only letter whose lower case holds a character that is none: kept inside its word
    line = "\x00".join(t.replace("İ", "i") if "İ" in t else t for t in texts).lower() + "\x00"
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _letters()[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    breaks = np.flatnonzero(codes == 0)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = ends - starts
    longest = int(sizes.max())
    at = np.arange(len(codes), dtype=np.int64)
    offset = at[inside] - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        weighed = _mix(codes[inside].astype(np.uint64) + np.uint64(1)) * _powers(1 << max(6, longest.bit_length()))[offset]
        hashes = _mix(np.add.reduceat(weighed, np.concatenate(([0], np.cumsum(sizes)[:-1]))))
    owner = np.searchsorted(breaks, starts)
    return hashes, np.bincount(owner, minlength=len(texts))


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words within texts, and each window's text; with repeats."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = hashes[:n].copy()
        for k in range(1, width):
            total = total * M1 + hashes[k : k + n]
    whole = owner[:n] == owner[width - 1 :]
    return _mix(total[whole]), owner[:n][whole]


def sets_of(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit members per text, sorted, with the texts' offsets."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    members = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    sizes = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=texts)
    return members, np.concatenate(([0], np.cumsum(sizes)))


def _chunks(batches: Iterator[pd.DataFrame], least_words: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows whose texts have enough words, with all their words' hashes and their numbers of words."""
    for batch in batches:
        batch = batch[batch["text"].notna() & batch["id"].notna()]
        for low in range(0, len(batch), 2000):
            part = batch.iloc[low : low + 2000]
            hashes, counts = word_hashes(part["text"].tolist())
            keep = counts >= least_words
            if keep.any():
                yield part[keep], hashes[np.repeat(keep, counts)], counts[keep]


FEATURES = "id bigint, at bigint, h1 bigint, h2 bigint, size int, p1 bigint, p2 bigint, p3 bigint, p4 bigint"
MEMBERS = "id bigint, h1 bigint, h2 bigint, members binary"


def _set_hashes(members: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        spread = _mix(members.astype(np.uint64) * M1 + np.uint64(7))
        return spread, np.add.reduceat(spread, off[:-1]).view(np.int64), np.add.reduceat(_mix(spread + M3), off[:-1]).view(np.int64)


def featured(width: int, least_words: int):
    """Arrow batches of (id, at, text) -> FEATURES, for texts of at least `least_words` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, hashes, counts in _chunks(batches, max(least_words, width)):
            n = len(part)
            members, off = sets_of(*windows(hashes, counts, width), n)
            spread, h1, h2 = _set_hashes(members, off)
            sizes = np.diff(off)
            place = np.repeat(np.arange(n), sizes) * 256 + (spread >> np.uint64(24) & np.uint64(255)).astype(np.int64)
            parity = np.packbits((np.bincount(place, minlength=n * 256).reshape(n, 256) & 1).astype(np.uint8), axis=1).view(np.int64)
            yield pd.DataFrame({"id": part["id"].to_numpy(), "at": part["at"].to_numpy(), "h1": h1, "h2": h2, "size": sizes.astype(np.int32)} | {f"p{i + 1}": parity[:, i] for i in range(4)})

    return run


def membered(width: int, least_words: int):
    """Arrow batches of (id, text) -> MEMBERS, the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, hashes, counts in _chunks(batches, max(least_words, width)):
            members, off = sets_of(*windows(hashes, counts, width), len(part))
            _, h1, h2 = _set_hashes(members, off)
            raw = members.tobytes()
            yield pd.DataFrame({"id": part["id"].to_numpy(), "h1": h1, "h2": h2, "members": [raw[4 * a : 4 * b] for a, b in zip(off[:-1], off[1:], strict=True)]})

    return run



def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys & np.uint64(slots - 1)).astype(np.int64)


class Counts:
    """A sketch of counts: four bits for each slot of a key's hash.  None is too small up to 4, so 0 and 1 are certain."""

    def __init__(self, pieces: Iterator[tuple[int, np.ndarray]], slots: int) -> None:
        self.slots, self.packed = slots, np.zeros(slots // 2, dtype=np.uint8)
        for at, counts in pieces:
            level = (np.searchsorted(LEVELS, counts, side="right") - 1).astype(np.uint8)
            self.packed[at // 2 : (at + len(counts)) // 2] = level[0::2] | level[1::2] << 4

    def level(self, keys: np.ndarray) -> np.ndarray:
        slot = _slot(keys, self.slots)
        return self.packed[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8) & 15


SPARSE = "piece int, slots binary, counts binary"


def _pieces(at: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
    """Counters of sorted slots, in pieces."""
    piece = at // PIECE
    cut = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True]))) if len(at) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield pd.DataFrame({"piece": [int(piece[a])], "slots": [(at[a:b] - piece[a] * PIECE).astype(np.uint16).tobytes()], "counts": [counts[a:b].astype(np.uint32).tobytes()]})


def _sparse(batches: Iterator[pd.DataFrame], keys_of, slots: int) -> Iterator[pd.DataFrame]:
    """The counters of a partition's keys that aren't 0, in pieces; what is held is bounded by `FLUSH` and a batch."""
    at, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        new, n = np.unique(_slot(keys_of(batch), slots), return_counts=True)
        at, back = np.unique(np.concatenate((at, new)), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate((counts, n)), minlength=len(at)).astype(np.int64)
        if len(at) > FLUSH:
            yield from _pieces(at, counts)
            at, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield from _pieces(at, counts)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PIECE, dtype=np.int64)
    for at, counts in zip(pdf["slots"], pdf["counts"], strict=True):
        total[np.frombuffer(at, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint32)
    used = np.flatnonzero(total)
    return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "slots": [used.astype(np.uint16).tobytes()], "counts": [np.minimum(total[used], (1 << 32) - 1).astype(np.uint32).tobytes()]})


def slots_for(keys: int) -> int:
    """Twice the keys as a power of two, within the bounds."""
    return min(MOST_SLOTS, max(1 << 16, 1 << (2 * keys).bit_length()))


def counters(df: DataFrame, keys_of, slots: int) -> Iterator[tuple[int, np.ndarray]]:
    """Counts by slot over the keys of all rows, piece by piece: the piece's first slot and its counts."""
    parts = df.mapInPandas(lambda batches: _sparse(batches, keys_of, slots), SPARSE)
    # a task sums a piece of at most 64 input partitions, so its group is bounded too
    salts = max(1, df.rdd.getNumPartitions() // 64)
    if salts > 1:
        parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("piece", "salt").applyInPandas(_summed, SPARSE)
    for r in parts.groupBy("piece").applyInPandas(_summed, SPARSE).toLocalIterator():
        out = np.zeros(PIECE, dtype=np.int64)
        out[np.frombuffer(r.slots, dtype=np.uint16)] = np.frombuffer(r.counts, dtype=np.uint32)
        yield r.piece * len(out), out


def _members(width: int, least_words: int):
    """The windows of a batch's texts, each once a text."""

    def run(batch: pd.DataFrame) -> np.ndarray:
        sets = [sets_of(*windows(hashes, counts, width), len(part))[0] for part, hashes, counts in _chunks(iter([batch]), max(least_words, width))]
        return np.concatenate(sets) if sets else np.zeros(0, np.uint32)

    return run


def asked(sizes: np.ndarray, share: float) -> np.ndarray:
    """How many first windows hold `MEET` common ones (or all), if at least `share` of the windows are common."""
    return np.minimum(sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + MEET, sizes)


def allocated(level: np.ndarray, members: np.ndarray, owner: np.ndarray, off: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest thresholds with `units` units for each text: (its windows by estimated count, which are asked for).

    Windows come as keys of owner, level and member.  A partition's threshold is the number of its windows asked for,
    less one.
    """
    key = np.sort(owner.astype(np.uint64) << np.uint64(36) | level.astype(np.uint64) << np.uint64(32) | members)
    return key, np.arange(len(key)) - off[owner] < units[owner]


PREFIXES = "id bigint, h1 bigint, h2 bigint, size int, first int, windows binary"


def prefixed(width: int, least_words: int, similarity: float, seen):
    """Arrow batches of (id, text) -> PREFIXES: the windows to be sent, the rare ones first, and the place of the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, hashes, counts in _chunks(batches, max(least_words, width)):
            n = len(part)
            members, off = sets_of(*windows(hashes, counts, width), n)
            _, h1, h2 = _set_hashes(members, off)
            sizes = np.diff(off)
            owner = np.repeat(np.arange(n), sizes)
            key, wanted = allocated(seen.value.level(members), members, owner, off, asked(sizes, similarity))
            alone = (key >> np.uint64(32) & np.uint64(15)) <= 1  # counts are never too small there
            keep = ~alone & wanted
            raw = (key[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
            cut = 4 * np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=n))))
            out = pd.DataFrame({"id": part["id"].to_numpy(), "h1": h1, "h2": h2, "size": sizes.astype(np.int32), "first": np.bincount(owner[alone], minlength=n).astype(np.int32), "windows": [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]})
            yield out[np.diff(cut) > 0]

    return run


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: they compress better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(planes: list[bytes], dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(p, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel() for p in planes])


DEALT = "bucket int, windows binary, cells binary, ids binary, sizes binary, places binary"


def _cells(ids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the cells (low << 8 | high group) it meets others in, as (row, cell): one for each group of its window."""
    row = np.repeat(np.arange(len(ids)), groups)
    other = np.arange(len(row)) - np.repeat(np.cumsum(groups) - groups, groups)
    own = (_mix(ids.view(np.uint64))[row] % groups[row].astype(np.uint64)).astype(np.int64)
    return row, np.minimum(own, other) << 8 | np.maximum(own, other)


def dealt(buckets: int, seen):
    """Arrow batches of PREFIXES -> DEALT: windows with their texts, by ranges of hashes; hot windows by cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys = np.frombuffer(b"".join(batch["windows"]), dtype=np.uint32)
            n = batch["windows"].map(len).to_numpy() // 4
            owner = np.repeat(np.arange(len(batch)), n)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n) + batch["first"].to_numpy()[owner]
            ids, sizes = batch["id"].to_numpy()[owner], batch["size"].to_numpy()[owner].astype(np.int32)
            groups = np.clip(LEVELS[seen.value.level(keys)] // HOT + 1, 1, 256)
            cell = np.zeros(len(keys), np.int64)
            if groups.max(initial=1) > 1:
                row, cell = _cells(ids, groups)
                keys, ids, sizes, place = keys[row], ids[row], sizes[row], place[row]
            spread = (_mix(keys.astype(np.uint64) + (cell.astype(np.uint64) << np.uint64(32))) >> np.uint64(32)) * np.uint64(buckets)
            bucket = (spread >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)):
                at = order[cut[k] : cut[k + 1]]
                cells = cell[at].astype(np.uint16).tobytes() if cell[at].any() else b""
                yield pd.DataFrame({"bucket": [k], "windows": [keys[at].tobytes()], "cells": [cells], "ids": [_planes(ids[at])], "sizes": [_planes(sizes[at])], "places": [_planes(place[at].astype(np.int32))]})

    return run


def _met(rows: list, similarity: float, seen, block: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """The meetings of one bucket's texts: a < b and how many they must have, once for each."""
    windows = [np.frombuffer(r.windows, dtype=np.uint32) for r in rows]
    cell = np.concatenate([np.frombuffer(r.cells, dtype=np.uint16) if r.cells else np.zeros(len(w), np.uint16) for r, w in zip(rows, windows, strict=True)]).astype(np.int64)
    windows = np.concatenate(windows)
    keys = windows.astype(np.int64)
    if cell.any():  # windows are told apart by their cells too
        keys = np.unique(keys << 16 | cell, return_inverse=True)[1].astype(np.int64)
    keys <<= 24
    ids, sizes, places = (_numbers([getattr(r, c) for r in rows], t) for c, t in (("ids", np.int64), ("sizes", np.int32), ("places", np.int32)))
    top = (1 << 24) - 1
    key = keys | np.minimum(sizes, top)
    order = np.argsort(key, kind="stable")
    key, keys, ids, sizes, places, windows, cell = key[order], keys[order], ids[order], sizes[order].astype(np.int64), places[order], windows[order], cell[order]
    mixed = cell >> 8 != cell & 255
    groups = (LEVELS[seen.value.level(windows)] // HOT + 1).clip(1, 256).astype(np.uint64) if mixed.any() else None
    group = _mix(ids.view(np.uint64)) % groups if mixed.any() else None
    # the smaller text of a pair stands before the larger, which is at most 1 / similarity times as large
    end = np.searchsorted(key, keys | np.minimum(np.floor(sizes / similarity + 1e-9).astype(np.int64), top), side="right")
    left = np.flatnonzero(places < asked(sizes, 2 * similarity / (1 + similarity)))
    left = left[end[left] > left + 1]
    n = end[left] - left - 1
    total = np.cumsum(n)
    low = 0
    while low < len(left):
        high = max(low + 1, int(np.searchsorted(total, total[low] - n[low] + block, side="right")))
        m = n[low:high]
        i = np.repeat(left[low:high], m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        room = np.minimum(sizes[i] - places[i], sizes[j] - places[j])
        common = np.ceil(similarity / (1 + similarity) * (sizes[i] + sizes[j]) - 1e-9)
        could = room > common - MEET
        if group is not None:  # in a cell of two groups only texts of different groups meet
            could &= ~mixed[i] | (group[i] != group[j])
        a, b = ids[i[could]], ids[j[could]]
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "need": np.minimum(common[could], MEET).astype(np.int32)})
        yield pairs.groupby(["a", "b", "need"]).size().rename("n").reset_index()
        low = high


MEETINGS = "a bigint, b bigint, need int, n bigint"


def met(similarity: float, seen):
    """Arrow batches of DEALT, sorted by bucket -> `MEETINGS` in the windows that both texts are sent under."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if rows and rows[0].bucket != r.bucket:
                    yield from _met(rows, similarity, seen)
                    rows = []
                rows.append(r)
        if rows:
            yield from _met(rows, similarity, seen)

    return run


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        s, t = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
        same = len(np.intersect1d(s, t, assume_unique=True))
        out[i] = same / (len(s) + len(t) - same)
    return pd.Series(out)


def near_copies(df: DataFrame, key: str, text: str, latest: str, similarity: float = 0.6, width: int = 3, least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(pairs: a < b, similarity; classes: id, class).

    A class holds the texts with equal sets of windows and is named by its least id; pairs are between classes.  Texts
    with fewer than `least_words` words, and null ones, are in no class.  Of an id delivered several times the latest
    row counts, of rows of one time the one with the greatest text hash.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.unix_micros(F.col(latest).cast("timestamp")), F.lit(-(1 << 62))).alias("at"), F.col(text).alias("text"))
    features = written(rows.mapInPandas(featured(width, least_words), FEATURES), "near-features")
    newest = features.groupBy("id").agg(F.max(F.struct("at", "h1", "h2")).alias("r")).select("id", "r.h1", "r.h2")
    leads = newest.groupBy("h1", "h2").agg(F.min("id").alias("class"))
    classes = written(newest.join(leads, ["h1", "h2"]).select("id", "class", "h1", "h2"), "near-classes")
    lead = classes.where(F.col("id") == F.col("class")).select("id", "h1", "h2")
    parities = features.join(lead, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "size", "p1", "p2", "p3", "p4")
    parities = written(parities, "near-parities")
    discard(features)

    spark, texts = df.sparkSession, parities.count()
    plain = rows.select("id", "text")
    slots = slots_for(texts * KEYS)
    seen = spark.sparkContext.broadcast(Counts(counters(plain, _members(width, least_words), slots), slots))  # of bounded size
    prefixes = plain.mapInPandas(prefixed(width, least_words, similarity, seen), PREFIXES)
    prefixes = prefixes.join(lead, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "size", "first", "windows")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts * KEYS // BUCKET)
    by_window = prefixes.mapInPandas(dealt(buckets, seen), DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    meetings = by_window.mapInPandas(met(similarity, seen), MEETINGS).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    first = written(meetings.where("n >= need").select("a", "b"), "near-first")
    seen.unpersist()
    side = lambda at: parities.select(F.col("id").alias(at), F.col("size").alias(f"n{at}"), *[F.col(f"p{i}").alias(f"{at}{i}") for i in (1, 2, 3, 4)])
    odd = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in (2, 3, 4)), F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))))
    could = (F.least("na", "nb") >= similarity * F.greatest("na", "nb")) & (odd <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")))
    candidates = written(first.join(side("a"), "a").join(side("b"), "b").where(could).select("a", "b"), "near-candidates")
    discard(first)

    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ids.count() <= 1_000_000:  # 8 MB of ids; beyond, the join shuffles
        ids = F.broadcast(ids)
    sets = rows.select("id", "text").join(ids, "id", "left_semi").mapInPandas(membered(width, least_words), MEMBERS)
    sets = written(sets.join(lead, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "members"), "near-members")
    both = candidates.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    same = F.pandas_udf(_similarity, DoubleType())
    pairs = both.select("a", "b", same("ma", "mb").alias("similarity")).where(F.col("similarity") >= similarity)
    return pairs, classes.select("id", "class")


def found(blocks: DataFrame) -> DataFrame:
    """block_id_a < block_id_b: blocks of at least 20 words whose sets of three consecutive words are similar to 0.6.

    The result names every pair, so copies are expanded; `classes_and_links` has one row per block instead.
    """
    pairs, classes = near_copies(blocks, "block_id", "text", "ingested_at")
    sizes = classes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    several = classes.join(sizes.select("class"), "class", "left_semi")
    between = expanded(expanded(written(pairs.select("a", "b"), "near-pairs"), "a", classes, sizes, "x"), "b", classes, sizes, "y").select("x", "y")
    within = expanded(several.select(F.col("class").alias("a"), F.col("id").alias("x")), "a", several, sizes, "y").where(F.col("x") < F.col("y")).select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("block_id_a"), F.greatest("x", "y").alias("block_id_b"))


def classes_and_links(blocks: DataFrame) -> DataFrame:
    """block_id, class_id, links: one row per block of at least 20 words: the least block with its set of windows, and to how many other classes that class is similar."""
    pairs, classes = near_copies(blocks, "block_id", "text", "ingested_at")
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return classes.join(links, "class", "left").select(F.col("id").alias("block_id"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def class_pairs(blocks: DataFrame) -> DataFrame:
    """class_a < class_b, similarity: similar classes, by their least blocks."""
    pairs, _ = near_copies(blocks, "block_id", "text", "ingested_at")
    return pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("similarity", 6).alias("similarity"))
