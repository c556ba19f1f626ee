"""Language-model scores by prediction by partial matching.

A trie of byte contexts up to ``ORDER`` bytes is counted over all training
texts. A byte's probability is read at the longest context that has been seen;
a byte not seen there costs an escape (method D: half a count is taken
from each different byte of the context for it), and the next shorter context leaves out what the
longer one has, so that no probability is spent twice. Below the empty context
the bytes not seen at all are equally likely. A text is its words, lower-cased
(A-Z), each followed by one byte: a space between words, a line feed at the
end; its contexts begin with line feeds.

Rows are written once, in blocks of bounded size, and never shuffled. The nodes
of contexts of up to ``LOW`` bytes are one small table (at most 2**24 counts,
whatever the corpus): it is summed map-side and sent to all. For longer contexts
and for tokens nothing is broadcast: each block sends its distinct tokens and
contexts, packed, to hash partitions, which add up the training counts of all
blocks and send back to each block the counts of what it asked for: its own
tokens, and whole nodes of its own contexts. Then each block scores its texts.
Tokens are told apart by 63 bits of their hash.

Defined results: a null or empty text is its end token; equal rows are scored
(and counted) each; texts of any length are scored whole; without training
texts every byte has probability 1/256 and all tokens are unknown; an empty
table gives an empty result; further columns, whatever their names, are ignored;
a null doc_id counts as training.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import blocked, crc_mod, distinct, ranges, run_starts, stable_order, staged, text_bytes

ORDER, LOW = 5, 2
BLOCK = 8 << 20
TOKENS, TOTALS = -1, -2
PACKED = "part int, b long, kind int, keys binary, counts binary"
_U8, _U24, _ONE = np.uint64(8), np.uint64(24), np.uint64(1)


def normal(text: bytes) -> bytes:
    """What is scored of a text: lower-cased words, spaces between them, a line feed."""
    return b" ".join(text.lower().split()) + b"\n"


def _keys(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of each byte of each body as a number, and the bytes of each body."""
    pad = b"\n" * order
    data = np.frombuffer(b"".join(x for b in bodies for x in (pad, b)), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    key = data[order:].astype(np.uint64)
    for j in range(1, order + 1):
        key |= data[order - j : len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    first = np.cumsum(sizes + order) - sizes - order  # places count from the end of the first pad
    inside = np.ones(len(key), bool)
    for j in range(order):
        inside[first[1:] - order + j] = False
    return key[inside], sizes


def _low_bits(k: int) -> np.uint64:
    return np.uint64((1 << (8 * (k + 1))) - 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")  # merges the sorted parts that the keys come in
    s = keys[order]
    first = run_starts(s)
    return s[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _shorter(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same counts for contexts cut to k bytes."""
    keys = keys & _low_bits(k)
    if 8 * (k + 1) > 40 or counts.max(initial=0) >= 1 << 24:
        return _summed(keys, counts)
    s = np.sort((keys << _U24) | counts.astype(np.uint64))  # far faster than an index sort
    keys, counts = s >> _U24, (s & np.uint64(0xFFFFFF)).astype(np.int64)
    first = run_starts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Ids(dict):
    """Number each word in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct token, and the number of each token with the tokens of each text."""
    ids, parts = Ids(), []
    end = ids[b""]
    for b in bodies:
        words = b.split()
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([end]))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids)) >> _ONE
    sizes = np.array([len(p) + 1 for p in parts[::2]], np.int64)
    return hashes, np.concatenate(parts), sizes


def _rows(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return [x.as_py() for x in table["text"]], table["held"].to_numpy(zero_copy_only=False)


def _low_counts(docs: DataFrame, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of all contexts of ``low`` bytes: added up in each task, then by key."""

    def run(batches):
        found: list = []
        for batch in batches:
            bodies, held = _rows(pa.Table.from_batches([batch]))
            if bodies := [b for b, h in zip(bodies, held, strict=True) if not h]:
                s = np.sort(_keys(bodies, low)[0].astype(np.uint32))
                first = run_starts(s)
                found.append((s[first].astype(np.uint64), np.diff(first, append=len(s))))
            if sum(len(k) for k, _ in found) > 4_000_000:
                found = [_summed(*map(np.concatenate, zip(*found, strict=True)))]
        if found:
            k, n = _summed(*map(np.concatenate, zip(*found, strict=True)))
            for a in range(0, len(k), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 65536].view(np.int64)), pa.array(n[a : a + 65536])], ["key", "n"])

    def pack(table: pa.Table) -> pa.Table:
        k, n = _summed(table["key"].to_numpy().view(np.uint64), table["n"].to_numpy())
        return pa.table({"keys": pa.array([_enc(k)], pa.binary()), "counts": pa.array([_enc(n)], pa.binary())})

    sums = docs.select("text", "held").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # at most 256 rows of at most 2**16 packed counts each
    got = sums.groupBy(F.shiftright("key", 8 * low).alias("top")).applyInArrow(pack, "keys binary, counts binary").collect()
    pairs = [(_dec(bytes(r["keys"])).view(np.uint64), _dec(bytes(r["counts"]))) for r in got]
    return _summed(*map(np.concatenate, zip(*pairs, strict=True))) if pairs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _part(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """By token, or by context, so that a node is in one partition."""
    x = keys if kind == TOKENS else (keys >> _U8) + np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)) % np.uint64(parts)


def _enc(keys: np.ndarray) -> bytes:
    """Sorted numbers (or counts) as compressed differences."""
    return zstandard.compress(np.diff(keys.astype(np.int64), prepend=0).tobytes(), 1)


def _dec(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


def _pack(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("part", "b", "kind", "keys", "counts"), cols, kinds, strict=True)})


def _asked(parts: int, order: int, low: int):
    """What a block holds: its tokens and longer contexts with their training counts (or 0)."""

    def run(table: pa.Table) -> pa.Table:
        block = table["b"][0].as_py()
        bodies, held = _rows(table)
        hashes, word, sizes = _words(bodies)
        n = np.bincount(word, weights=np.repeat(~held, sizes), minlength=len(hashes)).astype(np.int64)
        found = {TOKENS: _summed(hashes, n)}
        key, sizes = _keys(bodies, order)
        key = np.sort((key << _ONE) | np.repeat(held, sizes))
        train = (~key & _ONE).astype(np.int64)
        key >>= _ONE
        first = run_starts(key)
        u, c = key[first], np.add.reduceat(train, first)
        del key, train
        for k in range(order, low, -1):
            found[k] = u, c = (u, c) if k == order else _shorter(u, c, k)
        rows = []
        for kind, (u, c) in found.items():
            p = _part(u, kind, parts)
            by = stable_order(p)
            cuts = [*run_starts(p[by]).tolist(), len(by)]
            rows += [(int(p[by[a]]), block, kind, _enc(u[by[a:z]]), _enc(c[by[a:z]])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return _pack(rows)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The corpus counts of a partition, to each block what it asked for; its totals of tokens go to one block."""
    kinds, blocks = table["kind"].to_numpy(), table["b"].to_numpy()
    part, rows = table["part"][0].as_py(), []
    for kind in distinct(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        asked = [_dec(table["keys"][int(i)].as_py()).view(np.uint64) for i in at]
        u, c = _summed(np.concatenate(asked), np.concatenate([_dec(table["counts"][int(i)].as_py()) for i in at]))
        u, c = u[c > 0], c[c > 0]
        if kind == TOKENS:
            rows.append((part, int(blocks.min()), TOTALS, _enc(np.array([len(u), c.sum()], np.int64)), b""))
            node, first = u, np.arange(len(u))
        else:
            first = run_starts(u >> _U8)
            node = (u >> _U8)[first]
        size = np.diff(first, append=len(u))
        for i, k in zip(at, asked, strict=True):
            wanted = k if kind == TOKENS else (k >> _U8)[run_starts(k >> _U8)]
            place, hit = _find(node, wanted)
            place = place[hit]
            if len(place):
                entries = ranges(first[place], size[place])
                rows.append((part, int(blocks[i]), kind, _enc(u[entries]), _enc(c[entries])))
    return _pack(rows)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Trie:
    """Nodes of all orders as sorted arrays of (context, byte) and counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for keys, counts in levels:
            first = run_starts(keys >> _U8)
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            self.levels.append((keys, counts, (keys >> _U8)[first], first, np.diff(first, append=len(keys)), total))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each (context of the highest order, byte)."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        less, less_d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # what longer contexts have
        for k in range(len(self.levels) - 1, -1, -1):
            entries, counts, context, first, d, total = self.levels[k]
            if not len(entries) or not len(left):
                continue
            key = keys[left] & _low_bits(k)
            node, known = _find(context, key >> _U8)
            t, e = 2 * (total[node] - less), d[node] - less_d
            live = known & (t > 0)
            at, hit = _find(entries, key)
            done = live & hit
            out[left[done]] += np.log10((2 * counts[at[done]] - 1) / t[done])
            miss = live & ~hit
            out[left[miss]] += np.log10(e[miss] / t[miss])
            stay = ~done
            left, node, known = left[stay], node[stay], known[stay]
            less, less_d = np.zeros(len(left), np.int64), np.where(known, d[node], 0)
            if k and known.any():  # what the next shorter context has of this one's bytes
                nodes = distinct(node[known])
                low, low_counts = self.levels[k - 1][:2]
                short = low_counts[np.searchsorted(low, entries[ranges(first[nodes], d[nodes])] & _low_bits(k - 1))]
                sums = np.add.reduceat(short, np.cumsum(d[nodes]) - d[nodes])
                less[known] = sums[np.searchsorted(nodes, node[known])]
        out[left] -= np.log10(max(1, 256 - len(self.levels[0][0])))
        return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, part_score double, score double, all_known long, all_tokens long"


def _scored(order: int, low: tuple[np.ndarray, np.ndarray], low_order: int):
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        found: dict[int, list] = {k: [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] for k in (TOKENS, *range(low_order + 1, order + 1))}
        totals = np.zeros(2, np.int64)
        for kind, k, c in zip(side["kind"].to_pylist(), side["keys"], side["counts"], strict=True):
            if kind == TOTALS:
                totals += _dec(k.as_py())
            else:
                found[kind].append((_dec(k.as_py()).view(np.uint64), _dec(c.as_py())))
        levels = {k: _summed(*map(np.concatenate, zip(*x, strict=True))) for k, x in found.items()}
        tokens, counts = levels[TOKENS]
        lows = [low]
        for k in range(low_order - 1, -1, -1):
            lows.append(_shorter(*lows[-1], k))
        trie = Trie([*lows[::-1], *(levels[k] for k in range(low_order + 1, order + 1))])
        bodies, held = _rows(table)
        hashes, word, sizes = _words(bodies)
        at, hit = _find(tokens, hashes)
        c = np.where(hit, counts[at], 0) if len(counts) else np.zeros(len(hashes))
        first = np.cumsum(sizes) - sizes
        known, base = np.add.reduceat(hit[word].astype(np.int64), first), np.add.reduceat(np.log10(c + 0.1)[word], first)
        score = np.zeros(len(bodies))
        # keys of a run of texts are sorted together with the number of their text, 16 bits
        for run_of in range(0, len(bodies), 1 << 16):
            key, size = _keys(bodies[run_of : run_of + (1 << 16)], order)
            key = np.sort((key << np.uint64(16)) | np.repeat(np.arange(len(size), dtype=np.uint64), size))
            doc, key = (key & np.uint64(0xFFFF)).astype(np.int64), key >> np.uint64(16)
            new = run_starts(key)
            each = np.repeat(trie.log10(key[new]), np.diff(new, append=len(key)))
            score[run_of : run_of + len(size)] = np.bincount(doc, weights=each, minlength=len(size))
        cols = [table["doc_id"], table["held"], sizes, known, base, score, [None] * len(sizes), [None] * len(sizes)]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in _SCORED.split(", ")]
        made = pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})
        last = pa.table({n: pa.array([v], k) for n, v, k in zip(names, [None] * 6 + totals.tolist(), kinds, strict=True)})
        return pa.concat_tables([made, last])

    return run


def ppm_scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK, low: int = LOW) -> DataFrame:
    """held_out, token counts, base_score and score (log10) of each row."""
    size = text_bytes(docs)
    held = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    table = blocked(plain, "ppm", size, "text", block_bytes, normal)
    sums = _low_counts(table, low)
    asked = table.groupBy("b").applyInArrow(_asked(max(1, math.ceil(size / block_bytes)), order, low), PACKED)
    answers = asked.groupBy("part").applyInArrow(_answered, PACKED)
    scored = staged(table.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(_scored(order, sums, low), _SCORED), "ppm-scores")
    totals = scored.filter("all_tokens is not null").agg(F.sum("all_known").alias("v"), F.sum("all_tokens").alias("n")).first()
    n_tokens, n_distinct = totals["n"] or 0, totals["v"] or 0
    below = math.log10(n_tokens + 0.1 * (n_distinct + 1))
    return scored.filter("all_tokens is null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("part_score") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score"
    )
