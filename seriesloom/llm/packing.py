"""Best-fit packing with variable capacities.

Rows are dealt in turn into blocks of a bounded number of tokens; only ids and
lengths move. Rows that stand next to each other go to different blocks, so the
copies of a document that a mix emits never share a bin. In a block, pieces go in decreasing length into the open bin
with the least room that still holds them. Where none does, a bin is opened at
the permitted length with the least cost per token it can be expected to hold:
a length's cost over what the piece and the still unplaced pieces that would
fit can fill of it. All permitted lengths compete for every bin, so they are
optimised jointly. At the end each bin is downsized to the smallest permitted
length that holds its contents.

Defined results: a document has its words plus one end token, so an empty or
null text is one token; documents longer than the largest length are cut into
full pieces and a rest, none is dropped; equal rows are packed each, told apart
by ``row``; of pieces with equal lengths the one of the smaller row goes first;
an empty table gives an empty result; further columns are ignored. ``doc_id`` may
be null or repeat.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import staged, word_count

SIZES = (256, 512, 1024, 2048, 4096)
BLOCK_TOKENS = 2_000_000
BLOCK_ROWS = 100_000
SCHEMA = "doc_id long, row long, piece int, n_tokens int, bin_id long, bin_start int, bin_size int, bin_used int"


def token_cost(size: int) -> float:
    """Work of one sequence: linear layers plus attention, in tokens."""
    return size * (1.0 + size / 16384.0)


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = token_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each piece, and each bin's final size.

    ``lengths`` are in decreasing order, each between 1 and the largest size.
    """
    sizes, n = sorted(sizes), len(lengths)
    costs = [cost(s) for s in sizes]
    descending = [-x for x in lengths]
    left = np.concatenate([np.cumsum(np.asarray(lengths, np.int64)[::-1])[::-1], [0]]).tolist()
    open_bins: dict[int, list[int]] = {}
    mask = 0  # bit r: some open bin has room r
    bin_of, start, used, room = [0] * n, [0] * n, [], []
    for i, x in enumerate(lengths):
        higher = mask >> x
        if higher:
            r = x + (higher & -higher).bit_length() - 1
            stack = open_bins[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
        else:
            best = None
            for s, c in zip(sizes, costs, strict=True):
                if s >= x:
                    fits = left[max(i + 1, bisect_left(descending, -(s - x)))] if s > x else 0
                    rate = c / min(s, x + fits)
                    if best is None or rate < best[0]:
                        best = (rate, s)
            b, r = len(used), best[1]
            used.append(0)
            room.append(r)
        bin_of[i], start[i] = b, used[b]
        used[b] += x
        room[b] = r - x
        if room[b]:
            open_bins.setdefault(room[b], []).append(b)
            mask |= 1 << room[b]
    return bin_of, start, [sizes[bisect_left(sizes, u)] for u in used]


def pack_documents(docs: DataFrame, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = token_cost, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each piece: where it lies in which bin, and that bin's size."""
    rows = staged(docs.select("doc_id", (word_count() + 1).alias("n"), F.monotonically_increasing_id().alias("row")), "pack-lengths")
    total = rows.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(2, math.ceil((total["n"] or 0) / block_tokens), math.ceil(total["rows"] / block_rows))
    most = max(sizes)

    def pack(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].combine_chunks()
        n = table["n"].to_numpy()
        block = table["block"][0].as_py()
        pieces = -(-n // most)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(most, n[doc] - piece * most)
        row = table["row"].to_numpy()
        order = np.lexsort((piece, row[doc], -length))
        bin_of, start, final = best_fit(length[order].tolist(), sizes, cost)
        bins = np.asarray(bin_of, np.int64)
        fill = np.bincount(bins, weights=length[order], minlength=len(final)).astype(np.int64)
        i32 = lambda x: pa.array(np.asarray(x), pa.int32())
        return pa.table({
            "doc_id": ids.take(pa.array(doc[order])), "row": pa.array(row[doc[order]]), "piece": i32(piece[order]), "n_tokens": i32(length[order]), "bin_id": pa.array(bins + (block << 32), pa.int64()),
            "bin_start": i32(start), "bin_size": i32(np.asarray(final)[bins]), "bin_used": i32(fill[bins]),
        })

    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "row", F.pmod("row", F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(pack, SCHEMA)
