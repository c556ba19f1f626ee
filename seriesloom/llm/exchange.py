"""Questions of blocks to hash partitions: how often does each of my keys occur anywhere?

A block sends its distinct 64-bit hashes with their number, packed by
partition, so a key that all texts share costs an entry for each block, not for
each text. A partition adds the numbers up and answers each block for its own
keys. Inside a partition a key is the lower 32 bits of its hash: a clash can
only raise a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seriesloom.llm.common import run_starts, stable_order

SENT = "part int, b long, hashes binary, counts binary"
#: Answers (part >= 0) and, as part -1, the rows of a block that take part.
SIDE = "b long, part int, kind int, data binary, numbers binary, blocks binary"
_SIDE_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_SIDE_NAMES = ("b", "part", "kind", "data", "numbers", "blocks")


def table_of(rows: list[tuple], kinds, names) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})


def joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def keys_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition and lower 32 bits of each hash in one number."""
    return (((h >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def sent(block: int, keys: list[np.ndarray]) -> pa.Table:
    """The distinct keys of a block and how often each occurs there, packed by partition."""
    s = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))
    first = run_starts(s)
    n, s = np.diff(first, append=len(s)).astype(np.uint32), s[first]
    cuts = [*run_starts(s >> np.uint64(32)).tolist(), len(s)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    low = s.astype(np.uint32)
    return table_of([(int(s[a] >> np.uint64(32)), block, low[a:z].tobytes(), n[a:z].tobytes()) for a, z in spans], (pa.int32(), pa.int64(), pa.binary(), pa.binary()), ("part", "b", "hashes", "counts"))


def answered(kind: int):
    """To each block, those of its keys that occur twice or more anywhere, their number, and how many blocks have them."""

    def run(table: pa.Table) -> pa.Table:
        low, n = joined(table["hashes"], np.uint32), joined(table["counts"], np.uint32)
        order = stable_order(low)
        first = run_starts(low[order])
        blocks = np.diff(first, append=len(low))
        total, held = np.zeros(len(low), np.uint32), np.zeros(len(low), np.uint32)
        if len(low):
            total[order] = np.repeat(np.minimum(np.add.reduceat(n[order].astype(np.int64), first), 2**32 - 1), blocks)
            held[order] = np.repeat(blocks, blocks)
        often = total > 1
        size = [len(x.as_py()) // 4 for x in table["hashes"]]
        ends = np.cumsum(size).tolist()
        part, rows = int(table["part"][0].as_py()), []
        for b, e, s in zip(table["b"].to_pylist(), ends, size, strict=True):
            x = np.arange(e - s, e)[often[e - s : e]]
            if len(x):
                rows.append((b, part, kind, low[x].tobytes(), total[x].tobytes(), held[x].tobytes()))
        return table_of(rows, _SIDE_KINDS, _SIDE_NAMES)

    return run


def listed(rows: pa.Table) -> pa.Table:
    """The rows (b, i) of a block that take part, in one row."""
    return table_of([(rows["b"][0].as_py(), -1, 0, rows["i"].to_numpy().tobytes(), b"", b"")], _SIDE_KINDS, _SIDE_NAMES)


def taking_part(rows: pa.Table, side: pa.Table) -> Iterator[tuple[int, bytes]]:
    """i and text of the rows of a block that take part."""
    if rows.num_rows and side.num_rows:
        yield from texts_of(rows, joined(side["data"].filter(pa.array(side["part"].to_numpy() == -1)), np.int64))


def texts_of(rows: pa.Table, wanted: np.ndarray) -> Iterator[tuple[int, bytes]]:
    at = np.flatnonzero(np.isin(rows["i"].to_numpy(), wanted))
    for i, t in zip(rows["i"].take(at), rows["text"].take(at), strict=True):
        yield i.as_py(), t.as_py().encode()


def answers(side: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that a block was answered, in order, with their numbers and blocks."""
    mine = side.filter(pa.array((side["part"].to_numpy() >= 0) & (side["kind"].to_numpy() == kind))) if side.num_rows else side
    keys = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(p << 32) for p, x in zip(mine["part"].to_pylist(), mine["data"].to_pylist(), strict=True)]
    keys = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(keys, kind="stable")
    return keys[order], joined(mine["numbers"], np.uint32)[order], joined(mine["blocks"], np.uint32)[order]


def found_in(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in the sorted ``known``, and whether they do."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys
