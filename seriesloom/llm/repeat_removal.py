"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A byte goes if a window of ``THRESHOLD`` bytes that covers it starts anywhere
else too. Suffixes need only be ordered through that many bytes: passes over
most significant digits (of ``DIGIT`` bytes, told apart by 64-bit hashes) split
the suffixes into groups, single ones drop out after each pass, and groups that
are left after the last pass are the repeated windows. They are then compared
byte by byte, so no hash decides what is removed.

Only suffixes that can repeat are sorted. Every window holds an anchor, the
gram of ``GRAM`` bytes with the smallest hash in it, and equal windows hold
equal anchors at equal places. So:

1. Rows are written once, in blocks, and never shuffled. Of equal texts (by
   SHA-256) one row goes on. A text of full length with a copy is removed
   whole; it stays as a witness for the others.
2. Each block sends its distinct anchors (about one for 50 bytes), packed, to
   hash partitions, which answer each block with those of its anchors that occur
   twice or more anywhere, and say which of them are hot (in ``HOT`` blocks or
   more). An anchor in N texts costs an entry for each block, not for each text.
3. The windows of each anchor that is left are a stretch of bytes. For hot
   anchors, the hashes of their windows are first answered in the same way, so
   that windows which hang on a common passage but occur once drop out where
   they are. Stretches that are equal within a block are settled there and go on
   once; the others go to the partition of their anchor, where the radix passes
   run.

Partitions are sized by what they hold, so their number grows with the input.

Defined results: a row for each input row; a null text is empty; matches never
cross documents; equal rows are copies of each other; any text length works (long
texts are cut into overlapping pieces, each window lies in one); an empty table
gives an empty result; ``doc_id`` may be null or repeat and is only passed on;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import blocked, ranges, run_starts, staged, text_bytes, text_or_empty
from seriesloom.llm.exchange import SENT, SIDE, answered, answers, found_in, joined, keys_of, listed, sent, table_of, taking_part, texts_of

THRESHOLD, GRAM, DIGIT = 200, 100, 50
PIECE = 1 << 20
#: Text bytes of a block, anchors of an anchor partition, bytes of stretches sorted together.
BLOCK, PART_ANCHORS, PART_BYTES = 10 << 20, 2_000_000, 6 << 20
#: Blocks from which an anchor is hot: its windows are counted by hash before any bytes of theirs move.
HOT = 64
_POS = np.uint64((1 << 21) - 1)
_BASE = 0xD1342543DE82EF95
_LETTERS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the hash's base and of its inverse, made once in each task."""

    def __init__(self, n: int = PIECE + THRESHOLD):
        self.up = self._run(_BASE, n)
        self.down = self._run(pow(_BASE, -1, 1 << 64), n)

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, np.uint64(base), np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from each place; equal bytes, equal hash."""
        if isinstance(at, slice):
            n = len(sums) - size
            h = (sums[size:] - sums[:n]) * self.down[:n]
        else:
            h = (sums[at + size] - sums[at]) * self.down[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window of each anchor of a piece of at most PIECE + 199 bytes."""
    windows = len(data) - THRESHOLD + 1
    if windows < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = powers.hashes(powers.sums(data), slice(None), GRAM)
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    w = THRESHOLD - GRAM + 1
    grid = np.full(-(-len(key) // w) * w, np.uint64(2**64 - 1))
    grid[: len(key)] = key
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & _POS).astype(np.int64)
    first = run_starts(at)
    return h[at[first]], first, np.append(first[1:], windows) - 1


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(data) - THRESHOLD + 1), PIECE):
        yield at, data[at : at + PIECE + THRESHOLD - 1]


def _ask_anchors(parts: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        powers = Powers()
        found = [keys_of(anchors(p, powers)[0], parts) for _, t in taking_part(rows, side) for _, p in pieces(t)]
        return sent(rows["b"][0].as_py() if rows.num_rows else 0, found)

    return run


def _hot(side: pa.Table, hot: int) -> np.ndarray:
    keys, _, blocks = answers(side, 0)
    return keys[blocks >= hot]


def _hot_windows(p: np.ndarray, powers: Powers, parts: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a piece that hang on hot anchors: their starts, their stretches and their keys."""
    h, first, last = anchors(p, powers)
    _, hit = found_in(keys_of(h, parts), hot)
    size = (last - first + 1)[hit]
    at = ranges(first[hit], size)
    return at, np.repeat(np.flatnonzero(hit), size), keys_of(powers.hashes(powers.sums(p), at, THRESHOLD), parts) if len(at) else np.zeros(0, np.uint64)


def _ask_windows(parts: int, hot: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        powers, found, heavy = Powers(), [], _hot(side, hot)
        if len(heavy):
            found = [_hot_windows(p, powers, parts, heavy)[2] for _, t in taking_part(rows, side) for _, p in pieces(t)]
        return sent(rows["b"][0].as_py() if rows.num_rows else 0, found)

    return run


_STRETCHES = "part int, b long, ids binary, at binary, sizes binary, bytes binary"


def _stretches(parts: int, to: int, heavy: int):
    """Stretches of a block for the radix passes, and what the block has settled (rows without bytes)."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        want = answers(side, 0)[0]
        out: dict[int, list] = defaultdict(lambda: [[], [], [], []])
        settled: list[tuple[int, int, int]] = []
        if len(want):
            powers, seen = Powers(), {}
            hot, windows = _hot(side, heavy), answers(side, 1)[0]
            for i, t in taking_part(rows, side):
                for at, p in pieces(t):
                    h, first, last = anchors(p, powers)
                    keys = keys_of(h, parts)
                    hit = found_in(keys, want)[1] & ~found_in(keys, hot)[1]
                    found = [(h[hit], first[hit], last[hit])]
                    if len(hot):  # of a hot anchor's windows, the runs of those that occur again
                        w, owner, key = _hot_windows(p, powers, parts, hot)
                        again = found_in(key, windows)[1]
                        w, owner = w[again], owner[again]
                        new = run_starts(w - np.arange(len(w)) + owner * np.int64(1 << 40))
                        found.append((h[owner[new]], w[new], w[np.append(new[1:], len(w)) - 1] if len(w) else w))
                    for hh, a_, z_ in found:
                        for part, a, z in zip(((hh >> np.uint64(32)) % np.uint64(to)).tolist(), a_.tolist(), z_.tolist(), strict=True):
                            s = t[at + a : at + z + THRESHOLD]
                            if (known := seen.get(s)) is None:
                                seen[s] = [i, at + a, at + z]
                                for col, x in zip(out[part], (i, at + a, len(s), s), strict=True):
                                    col.append(x)
                            else:
                                settled += [(i, at + a, at + z), *([tuple(known)] if known[0] is not None else [])]
                                known[0] = None
        b = rows["b"][0].as_py() if rows.num_rows else 0
        made = [(p, b, np.asarray(i, np.int64).tobytes(), np.asarray(a, np.int32).tobytes(), np.asarray(n, np.int32).tobytes(), b"".join(s)) for p, (i, a, n, s) in out.items()]
        if settled:
            x = np.asarray(settled, np.int64)
            made.append((b % to, b, x[:, 0].tobytes(), x[:, 1].astype(np.int32).tobytes(), x[:, 2].astype(np.int32).tobytes(), None))
        return table_of(made, (pa.int32(), pa.int64(), *[pa.binary()] * 4), ("part", "b", "ids", "at", "sizes", "bytes"))

    return run


def radix_groups(data: np.ndarray, starts: np.ndarray, powers: Powers) -> np.ndarray:
    """Which of the suffixes at ``starts`` equal another one in THRESHOLD bytes."""
    sums = powers.sums(data)
    left = np.arange(len(starts))
    group = np.zeros(len(starts), np.uint64)
    for depth in range(0, THRESHOLD, DIGIT):
        key = powers.hashes(sums, starts[left] + depth, DIGIT) ^ (group * np.uint64(0xBF58476D1CE4E5B9))
        order = np.argsort(key, kind="stable")
        first = run_starts(key[order])
        size = np.diff(first, append=len(order))
        many = np.repeat(size > 1, size)
        left, group = left[order[many]], np.repeat(np.arange(len(size)), size)[many].astype(np.uint64)
    out = np.zeros(len(starts), bool)
    out[left[_confirmed(data, starts[left], group)]] = True
    return out


def _confirmed(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the windows at ``at`` equal another one, by their bytes; ``group``: sorted numbers of supposed groups."""
    first = run_starts(group)
    lead = np.repeat(at[first], np.diff(first, append=len(group)))
    order = np.argsort(at, kind="stable")
    s, lead = at[order], lead[order]
    # a window and its leader that follow a compared pair differ from it in one byte at most
    whole = np.concatenate([[True], (s[1:] != s[:-1] + 1) | (lead[1:] != lead[:-1] + 1)]) if len(s) else np.zeros(0, bool)
    same = bool((data[s + THRESHOLD - 1] == data[lead + THRESHOLD - 1]).all())
    span = np.arange(THRESHOLD)
    x, y = s[whole], lead[whole]
    for a in range(0, len(x), 16384):
        same = same and bool((data[x[a : a + 16384, None] + span] == data[y[a : a + 16384, None] + span]).all())
    if same:
        return np.ones(len(at), bool)
    texts = [data[a : a + THRESHOLD].tobytes() for a in at.tolist()]  # two digits clashed
    seen = Counter(texts)
    return np.array([seen[t] > 1 for t in texts])


def _repeated(table: pa.Table) -> pa.Table:
    """b, ids, first, last: the runs of repeated windows among a partition's stretches."""
    blocks = table["b"].to_numpy()
    pure = np.array([x.is_valid for x in table["bytes"]])
    per = np.array([len(x.as_py()) // 8 for x in table["ids"]], np.int64)
    ids, at, sizes = joined(table["ids"], np.int64), joined(table["at"], np.int32).astype(np.int64), joined(table["sizes"], np.int32).astype(np.int64)
    block, sort = np.repeat(blocks, per), np.repeat(pure, per)
    known = [(block[~sort], ids[~sort], at[~sort], sizes[~sort])]
    block, ids, at, sizes = block[sort], ids[sort], at[sort], sizes[sort]
    if len(ids):
        data = joined(table["bytes"].filter(pa.array(pure)), np.uint8)
        n = sizes - THRESHOLD + 1
        owner, place = np.repeat(np.arange(len(n)), n), ranges(np.cumsum(sizes) - sizes, n)
        hit = np.flatnonzero(radix_groups(data, place, Powers(len(data))))
        new = run_starts(place[hit] - np.arange(len(hit)) + owner[hit] * np.int64(1 << 40))
        first, last = hit[new], hit[np.append(new[1:], len(hit)) - 1] if len(hit) else hit
        own = owner[first]
        inside = at[own] - (np.cumsum(sizes) - sizes)[own]
        known.append((block[own], ids[own], place[first] + inside, place[last] + inside))
    b, i, a, z = (np.concatenate(c) for c in zip(*known, strict=True))
    order = np.argsort(b, kind="stable")
    b, i, a, z = b[order], i[order], a[order].astype(np.int32), z[order].astype(np.int32)
    cuts = [*run_starts(b).tolist(), len(b)]
    spans = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return table_of([(int(b[x.start]), i[x].tobytes(), a[x].tobytes(), z[x].tobytes()) for x in spans], (pa.int64(), *[pa.binary()] * 3), ("b", "ids", "first", "last"))


def removed_spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximal removed byte runs [start, end) from the first and last windows of runs."""
    order = np.argsort(first, kind="stable")
    first = first[order]
    end = np.maximum.accumulate(last[order] + THRESHOLD)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return np.stack([first[new], np.append(end[new[1:] - 1], end[-1])], axis=1)


def _cut(rows: pa.Table, side: pa.Table) -> pa.Table:
    """What is removed from the texts of a block, and the digest of the rest."""
    ids, first, last = joined(side["ids"], np.int64), joined(side["first"], np.int32).astype(np.int64), joined(side["last"], np.int32).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, first, last = ids[order], first[order], last[order]
    cuts = run_starts(ids)
    runs = {int(ids[a]): (first[a:z], last[a:z]) for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)][: len(cuts)], strict=True)}
    made = []
    for i, t in texts_of(rows, ids[cuts]):
        cut = removed_spans(*runs[i])
        edges = [0, *cut.ravel().tolist(), len(t)]
        digest = hashlib.sha256(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))).hexdigest()
        made.append((rows["b"][0].as_py(), i, int((cut[:, 1] - cut[:, 0]).sum()), digest, [{"start": a, "end": z} for a, z in cut.tolist()]))
    return table_of(made, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("b", "i", "removed", "cut_sha256", "cut"))


def repeated_passages(docs: DataFrame, block_bytes: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges) of each row."""
    size = text_bytes(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    table = blocked(plain.withColumn("sha", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long")), "repeats", size, "text", block_bytes)
    classes = staged(table.groupBy("sha").agg(F.count(F.lit(1)).alias("m"), F.max("n_bytes").alias("n"), F.min(F.struct("b", "i")).alias("one")), "repeats-classes")
    stands = classes.filter(F.col("n") >= THRESHOLD).select("one.b", "one.i")

    side = staged(stands.groupBy("b").applyInArrow(listed, SIDE), "repeats-stands")
    parts = max(1, math.ceil(size / 50 / PART_ANCHORS))
    texts = table.select("b", "i", "text").groupBy("b")
    asked = texts.cogroup(side.groupBy("b")).applyInArrow(_ask_anchors(parts), SENT)
    frequent = staged(asked.groupBy("part").applyInArrow(answered(0), SIDE), "repeats-anchors")
    side = side.unionByName(frequent)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, blocks = joined(x["numbers"], np.uint32), joined(x["blocks"], np.uint32)
            # an anchor found n times in all is shared out to the blocks that have it
            yield pa.RecordBatch.from_arrays([pa.array([float((n / np.maximum(blocks, 1)).sum())]), pa.array([int((blocks >= hot).sum())])], ["n", "hot"])

    found = frequent.select("numbers", "blocks").mapInArrow(summary, "n double, hot long").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot")).first()
    if found["hot"]:
        windows = texts.cogroup(side.groupBy("b")).applyInArrow(_ask_windows(parts, hot), SENT)
        side = side.unionByName(staged(windows.groupBy("part").applyInArrow(answered(1), SIDE), "repeats-windows"))
    to = max(1, math.ceil((found["n"] or 0) * (GRAM + THRESHOLD) / PART_BYTES))
    stretches = texts.cogroup(side.groupBy("b")).applyInArrow(_stretches(parts, to, hot), _STRETCHES)
    runs = stretches.groupBy("part").applyInArrow(_repeated, "b long, ids binary, first binary, last binary")
    cut = texts.cogroup(runs.groupBy("b")).applyInArrow(_cut, "b long, i long, removed long, cut_sha256 string, cut array<struct<start: long, end: long>>")
    cut = cut.select(F.struct("b", "i").alias("one"), "removed", "cut_sha256", "cut")
    judged = table.select("doc_id", "n_bytes", "sha").join(classes.join(staged(cut, "repeats-cut"), "one", "left").drop("n"), "sha")
    whole = (F.col("m") > 1) & (F.col("n_bytes") >= THRESHOLD)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    spans = F.when(whole, all_of_it).otherwise(F.coalesce("cut", none))
    return judged.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "sha")).alias("kept_sha256"), spans.alias("spans"),
    )
