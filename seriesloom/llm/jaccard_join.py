"""Exact n-gram Jaccard join and its connected components.

1. Rows are written once, in blocks, and never shuffled. Documents with equal
   shingle sets form one class; everything below runs on one row of each class,
   so exact copies cost nothing further.
2. Document frequencies. Each block sends its distinct shingles, packed, to hash
   partitions and is told how many classes have them. A set that links with
   another has at least the threshold's share of its shingles there, so all
   other classes are done (no link is lost: hash clashes only keep more classes).
3. Size-banded tiles: the shingles of a class are put in one order, rarest
   first. Sets that link share a shingle among the first n - ceil(t * n) + 1 of
   theirs, the prefix; what no other class has is left out of it. Prefixes send a
   set's size and hashed bitmap to tiles of (hash partition, size band); only
   sets in one or neighbouring bands can link. In a tile, sets that meet on a
   prefix shingle and are not yet in one component are compared by bit counts,
   which bound the overlap from above; the pairs that pass are intersected
   exactly as sorted arrays. Tiles are read three times, and the links found are
   merged after each: first the sets that share a shingle are compared with one
   pivot only, which joins dense groups at a cost in proportion to their size;
   then a forest of each tile's pairs is listed, strongest bounds first; then
   every pair that still lies between two components. So pairs inside a group of
   copies are not listed, and no link between components is missed.

Before each reading, prefix shingles whose sets are all in one component are
dropped, and so are sets without any other. Tiles with many sets are cut into
pairs of chunks that go to tasks of their own (or, once that costs more, into hash
partitions of their shingles). Shingles are 64-bit hashes; classes are told apart
by a 128-bit digest of the set and named by a row of theirs.

Defined results: null, empty and blank texts have no set and link with nothing;
texts of any length are read whole; equal rows, and texts with equal sets, are in
one class; rows that share a doc_id and have different texts stay rows of their
own; ties do not occur, a pair links or not; rows without an id link like others
and their component is named by the smallest id in it (null if it has none); an
empty table gives an empty result; further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import blocked, distinct, fresh, run_starts, sortable, staged, text_bytes
from seriesloom.llm.components import components
from seriesloom.llm.exchange import SENT, SIDE, answered, answers, found_in, keys_of, listed, sent, taking_part
from seriesloom.llm.shingles import WordHasher, bitmap, fold, shingle_sets, signature_words

#: Links: DEN * intersection >= NUM * union.
NUM, DEN = 3, 4
WORDS = 5
#: Text bytes of a block, and shingles that one hash partition holds.
BLOCK, PART_SHINGLES = 10 << 20, 3_000_000
#: Sets of a chunk: where they meet one pivot, and where a larger tile is cut into pairs of chunks.
PIVOT_SETS, TILE_SETS = 1000, 50_000
#: Sets of a size band for each hash partition, and most partitions, where a tile is one chunk.
PART_SETS, FEW_PARTS = 5000, 4
#: Most tiles whose sizes are broadcast.
MOST_SIZES = 10_000
#: Rows and columns of bitmaps compared at once.
TILE = 256
CHUNK_BYTES = 2 << 20


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def _chunks(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, data, size = [], [], 0
    for i, t in texts:
        ids.append(i)
        data.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield ids, data
            ids, data, size = [], [], 0
    if ids:
        yield ids, data


def set_classes(table: DataFrame, k: int = WORDS) -> DataFrame:
    """b, i, doc_id, digest, n (set size), set (128-bit digest of the set; null if empty) of a blocked table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            n, own = [], []
            for _, texts in _chunks((0, t.as_py().encode()) for t in batch["text"]):
                for s in shingle_sets(texts, hasher, k):
                    n.append(len(s))
                    own.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("b", "i", "doc_id", "digest")], pa.array(n, pa.int64()), pa.array(own, pa.binary())], ["b", "i", "doc_id", "digest", "n", "set"])

    return table.mapInArrow(run, "b long, i long, doc_id long, digest string, n long, `set` binary")


def _class_id(b, i):
    """One number for a row of a blocked table: its task and its place there."""
    return ((b >> 32) << 40) | i


def _stands(classes: DataFrame) -> DataFrame:
    """set, b, i, cid: the row that stands for each class; cid is made from the row, so classes never share one."""
    one = classes.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min(F.struct("b", "i")).alias("one")).select("set", "one.b", "one.i")
    return one.withColumn("cid", F.expr("shiftleft(shiftright(b, 32), 40) | i"))


def _ask(parts: int, k: int):
    """The distinct shingles of a block's classes."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        hasher = WordHasher()
        found = [keys_of(s, parts) for _, texts in _chunks(taking_part(rows, side)) for s in shingle_sets(texts, hasher, k)]
        return sent(rows["b"][0].as_py() if rows.num_rows else 0, found)

    return run


def _linkable(parts: int, k: int, num: int, den: int):
    """Sets that share enough shingles with any others: cid, n, elements (sorted uint64 as bytes), bits (their bitmap) and prefix."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        hasher, out = WordHasher(), ([], [], [], [], [])
        known, numbers, _ = answers(side, 0)
        b = rows["b"][0].as_py() if rows.num_rows else 0
        for ids, texts in _chunks(taking_part(rows, side)):
            for i, s in zip(ids, shingle_sets(texts, hasher, k), strict=True):
                n = len(s)
                at, hit = found_in(keys_of(s, parts), known)
                if den * int(hit.sum()) < num * n:
                    continue
                classes = np.where(hit, numbers[at], 0).astype(np.int64)
                first = np.argsort(classes, kind="stable")[: n + (-num * n // den) + 1]  # n - ceil(num * n / den) + 1, rarest first, then by hash
                prefix = s[first[hit[first]]].view(np.int64)
                if len(prefix):
                    for col, x in zip(out, (_class_id(b, i), n, s.tobytes(), bitmap(s, signature_words(n)).tobytes(), prefix), strict=True):
                        col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("cid", "n", "elements", "bits", "prefix"), out, kinds, strict=True)})

    return run


def verified(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The (a, b) rows whose sets link, by exact intersection of sorted arrays."""
    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good[i] = den * both >= num * (len(p) + len(q) - both)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _band(n: int, num: int, den: int) -> int:
    return int(math.log(n) / math.log(den / num) + 1e-9)


def _open(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """cid, n, label, bits, prefix: the sets, with those of their prefix shingles that lead to another component."""
    rows = sets.join(labels, sets["cid"] == labels["node"], "left").select("cid", "n", F.coalesce("label", "cid").alias("label"), "bits", "prefix")
    each = rows.select("cid", "label", F.explode("prefix").alias("h"))
    mixed = each.groupBy("h").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one <> other").select("h")
    left = each.join(mixed, "h").groupBy("cid").agg(F.collect_list("h").alias("prefix"))
    return rows.drop("prefix").join(left, "cid")


def _tiles(rows: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """part, band, home, cid, n, label, bits, prefix: a row for each tile a set goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for c, n, label, bits, f in zip(*[batch[x].to_pylist() for x in ("cid", "n", "label", "bits")], batch["prefix"], strict=True):
                prefix = f.values.to_numpy().view(np.uint64)
                part = (prefix * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
                band = _band(n, num, den)
                for p in distinct(part):
                    own = prefix[part == p].tobytes()
                    for b, home in ((band, True), (band + 1, False)):
                        for col, x in zip(out, (int(p), b, home, c, n, label, bits, own), strict=True):
                            col.append(x)
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["part", "band", "home", "cid", "n", "label", "bits", "prefix"])

    return rows.select("cid", "n", "label", "bits", "prefix").mapInArrow(run, "part int, band int, home boolean, cid long, n long, label long, bits binary, prefix binary")


def _dealt(tiles: DataFrame, parts: int, pivots: bool) -> DataFrame:
    """Tiles with work left, cut into chunks x and y of at most TILE_SETS sets or so: (part, band, x, y) is a task's group.

    ``second`` marks the rows of chunk y where x and y differ. The sets of a
    tile's largest component are in chunks of their own, which meet those of the
    others only. With ``pivots`` chunks of PIVOT_SETS are taken alone.
    """
    per = tiles.groupBy("part", "band", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("part", "band").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top")).filter(F.col("m") > F.col("top.c"))
    small = F.broadcast if 70 * parts <= MOST_SIZES else (lambda df: df)  # a row for each partition and size band
    cuts = lambda m, of=TILE_SETS: F.ceil(m / of).cast("int")
    chunk = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    if pivots:
        sizes = sizes.select("part", "band", cuts(F.col("m"), PIVOT_SETS).alias("cuts"))
        rows = tiles.join(small(sizes), ["part", "band"]).withColumn("x", chunk(F.col("cuts"))).withColumn("y", F.col("x")).withColumn("second", F.lit(False)).drop("cuts")
        return rows.repartition("part", "band", "x", "y")
    sizes = sizes.select("part", "band", F.col("top.label").alias("major"), cuts(F.col("top.c")).alias("first"), cuts(F.col("m") - F.col("top.c")).alias("rest"))
    major = F.col("label") == F.col("major")
    rows = tiles.join(small(sizes), ["part", "band"]).withColumn("own", F.when(major, chunk(F.col("first"))).otherwise(F.col("first") + chunk(F.col("rest"))))
    rows = rows.withColumn("met", F.explode(F.sequence(F.when(major, F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)))
    rows = rows.withColumn("x", F.least("own", "met")).withColumn("y", F.greatest("own", "met")).withColumn("second", F.col("own") > F.col("met"))
    return rows.drop("own", "met", "major", "first", "rest").repartition("part", "band", "x", "y")


def tile_pairs(n: np.ndarray, label: np.ndarray, home: np.ndarray, maps: list[np.ndarray], num: int = NUM, den: int = DEN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group that bit counts cannot rule out."""
    at = np.arange(len(n))
    return ((p, q) for p, q, _ in bounded_pairs(at, at, n, label, home, maps, num, den))


def bounded_pairs(left: np.ndarray, right: np.ndarray, n: np.ndarray, label: np.ndarray, home: np.ndarray, maps: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of ``left`` and ``right`` that may link, and the share of both sizes that their overlap bound is.

    Not yet in one component (``label`` may change between two steps), at least
    one at home, and with an overlap bound of at least num / (num + den) of both
    sizes, which links need. Where left and right are one, each pair comes once.
    """
    one = left is right
    left = left[np.argsort(n[left], kind="stable")]
    right = left if one else right[np.argsort(n[right], kind="stable")]
    words = np.array([len(m) for m in maps])
    for i in range(0, len(left), TILE):
        for j in range(i if one else 0, len(right), TILE):
            p, q = left[i : i + TILE], right[j : j + TILE]
            if n[p].max() * den < num * n[q].min():
                break
            if n[q].max() * den < num * n[p].min():
                continue
            ok = (label[p][:, None] != label[q][None, :]) & (home[p][:, None] | home[q][None, :])
            ok &= (n[p][:, None] * den >= num * n[q][None, :]) & (n[q][None, :] * den >= num * n[p][:, None])
            if one and i == j:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            if not ok.any():
                continue
            w = int(min(words[p].min(), words[q].min()))
            x = np.concatenate([fold(maps[a][None, :], w) for a in p])
            y = np.concatenate([fold(maps[a][None, :], w) for a in q])
            u, v = np.nonzero(ok)
            for at in range(0, len(u), 65536):
                s, t = u[at : at + 65536], v[at : at + 65536]
                only_x = np.bitwise_count(x[s] & ~y[t]).sum(axis=1, dtype=np.int64)
                only_y = np.bitwise_count(y[t] & ~x[s]).sum(axis=1, dtype=np.int64)
                bound = np.minimum(n[p[s]] - only_x, n[q[t]] - only_y)
                both = n[p[s]] + n[q[t]]
                good = bound * (num + den) >= num * both
                yield p[s[good]], q[t[good]], bound[good] / both[good]


class Forest:
    """Keeps, of the pairs offered, those that join two trees; sets of one label start as one tree."""

    def __init__(self, label: np.ndarray):
        self.tree = np.unique(label, return_inverse=True)[1].reshape(-1)
        order = np.argsort(self.tree, kind="stable")
        self.members = np.split(order, np.flatnonzero(np.diff(self.tree[order])) + 1)

    def joining(self, p: np.ndarray, q: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strongest pairs first."""
        at = np.flatnonzero(self.tree[p] != self.tree[q])
        kept = []
        for i in at[np.argsort(-strength[at], kind="stable")].tolist():
            x, y = int(self.tree[p[i]]), int(self.tree[q[i]])
            if x != y:
                if len(self.members[x]) < len(self.members[y]):
                    x, y = y, x
                self.tree[self.members[y]] = x
                self.members[x] = np.concatenate([self.members[x], self.members[y]])
                kept.append(i)
        return p[kept], q[kept]


def _candidates(num: int, den: int, step: str):
    """Pairs of a tile to verify; step: pivot (sets with one pivot of each shingle), forest (pairs that join trees of them) or all."""

    def run(table: pa.Table) -> pa.Table:
        cid, n, label = (table[c].to_numpy() for c in ("cid", "n", "label"))
        home, second = (table[c].to_numpy(zero_copy_only=False) for c in ("home", "second"))
        maps = [np.frombuffer(x.as_py(), np.uint64) for x in table["bits"]]
        prefixes = [np.frombuffer(x.as_py(), np.uint64) for x in table["prefix"]]
        h = np.concatenate(prefixes)
        owner = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        cuts = [*run_starts(h).tolist(), len(h)]
        found: set[tuple[int, int]] = set()
        tried: set[bytes] = set()
        trees = None if step == "all" else Forest(label)
        now = label if trees is None else trees.tree
        crossing = table["x"][0] != table["y"][0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2 or (now[owner[a:b]] == now[owner[a]]).all():
                continue
            group = np.sort(owner[a:b])
            if (key := hashlib.blake2b(group.tobytes(), digest_size=16).digest()) in tried:
                continue
            tried.add(key)
            left, right = (group[~second[group]], group[second[group]]) if crossing else (group, group)
            if step == "pivot":
                left, right = group[[cid[group].argmin()]], group
            for p, q, strength in bounded_pairs(left, right, n, now, home, maps, num, den):
                if trees is not None:
                    p, q = trees.joining(p, q, strength)
                one, two = cid[p], cid[q]
                found.update(zip(np.minimum(one, two).tolist(), np.maximum(one, two).tolist(), strict=True))
        pairs = sorted(found)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return run


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """node, label after further links: only the graph between labels is solved."""
    named = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    ends = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    top = components(ends).select(F.col("node").alias("k"), F.col("label").alias("top"))
    new = top.select(F.col("k").alias("node")).join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return labels.unionByName(new).withColumnRenamed("label", "k").join(top, "k", "left").select("node", F.coalesce("top", "k").alias("label"))


def linkable_sets(table: DataFrame, classes: DataFrame, stands: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """cid, n, elements, bits, prefix of the classes that may link, one row each."""
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / PART_SHINGLES))
    side = staged(stands.select("b", "i").groupBy("b").applyInArrow(listed, SIDE), "jaccard-stands")
    texts = table.select("b", "i", "text").groupBy("b")
    asked = texts.cogroup(side.groupBy("b")).applyInArrow(_ask(parts, k), SENT)
    frequent = asked.groupBy("part").applyInArrow(answered(0), SIDE)
    return staged(texts.cogroup(side.unionByName(frequent).groupBy("b")).applyInArrow(_linkable(parts, k, num, den), "cid long, n long, elements binary, bits binary, prefix array<long>"), "jaccard-sets")


def tile_parts(rows: DataFrame, num: int, den: int) -> int:
    """Hash partitions of each size band of open sets.

    Small bands are spread over a few. Where a band has to be cut into chunks, a
    set is sent once for each chunk in one partition, or its bitmap once for each
    shingle of its prefix in many; whichever is less decides.
    """
    bands = rows.groupBy(F.floor(F.log(F.col("n")) / math.log(den / num)).alias("band")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("prefix")).alias("h"), F.sum(F.octet_length("bits")).alias("b"))
    found = bands.agg(F.max("m").alias("most"), F.sum("m").alias("m"), F.sum("h").alias("h"), F.sum("b").alias("b")).first()
    most, chunks = found["most"] or 0, 2 * (found["most"] or 0) / TILE_SETS
    if chunks <= 1:
        return max(1, min(FEW_PARTS, math.ceil(most / PART_SETS)))
    shingles, bits = found["h"] / found["m"], found["b"] / found["m"]
    return 1 if chunks * (bits + 8 * shingles) <= shingles * (bits + 8) else math.ceil(chunks * shingles)


def links(sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """node, label: the components of the links between sets, found in three readings of their tiles."""
    labels = _apart(sets)
    for step in ("pivot", "forest", "all"):
        more = staged(_linked(sets, labels, step, num, den), "jaccard-links")
        if more.limit(1).count():
            labels = staged(_merged(labels, more), "jaccard-labels")
    return labels


def _apart(sets: DataFrame) -> DataFrame:
    """Labels of no links at all."""
    return sets.select(F.col("cid").alias("node"), F.col("cid").alias("label")).filter("false")


def _linked(sets: DataFrame, labels: DataFrame, step: str, num: int, den: int) -> DataFrame:
    """a, b: the links that one reading of the tiles finds."""
    rows = staged(_open(sets, labels), "jaccard-open")
    parts = tile_parts(rows, num, den)
    tiles = staged(_tiles(rows, parts, num, den), "jaccard-tiles")
    pairs = _dealt(tiles, parts, step == "pivot").groupBy("part", "band", "x", "y").applyInArrow(_candidates(num, den, step), "a long, b long").distinct()
    return verified(pairs, sets, num, den)


def _classed(docs: DataFrame, k: int, num: int, den: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest (of the text), n and cid (null without a set) of each row; and the sets that may link."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _digest().alias("digest"))
    table = blocked(plain, "jaccard", text_bytes(docs), "text", block_bytes)
    classes = staged(set_classes(table, k), "jaccard-classes")
    stands = staged(_stands(classes), "jaccard-stands-by-set")
    rows = classes.join(stands.select("set", "cid"), "set", "left").select("doc_id", "digest", "n", "cid")
    return rows, linkable_sets(table, classes, stands, k, num, den)


def _grouped(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, digest (of the text), n and group (null without a set) of each row."""
    rows, sets = _classed(docs, k, num, den, block_bytes)
    labels = links(sets, num, den)
    return rows.join(labels, rows["cid"] == labels["node"], "left").select("doc_id", "digest", "n", F.coalesce("label", "cid").alias("group"))


def near_links(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links, without regard to components: (class_a, class_b) of every two linked classes, and (doc_id, class_id) of each row.

    Documents with equal sets are one class and link with one another. In a
    dense group the links alone grow with its square, so this is for those who
    want them; components need far fewer.
    """
    rows, sets = _classed(docs, k, num, den, block_bytes)
    found = staged(_linked(sets, _apart(sets), "all", num, den), "jaccard-links")
    return found.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")), rows.select("doc_id", F.col("cid").alias("class_id"))


def near_components(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    named = _grouped(docs, k, num, den, block_bytes).select("doc_id", "n", "group")
    smallest = named.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns with one row of each component: the smallest id, then the smallest digest of the text.

    Texts without a set link with nothing, so each (id, text) of them stays once.
    """
    key, own, n = fresh(docs, "kept_key", "own_key", "copy")
    name = lambda digest: F.concat(digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = staged(_grouped(docs, **options).select("doc_id", "digest", "group", name(F.col("digest")).alias(key)), "jaccard-rows")
    each = F.coalesce(F.col("group").cast("string"), F.concat(F.lit("-"), F.col(key)))
    kept = rows.groupBy(each.alias("each")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"), F.col(key))).alias("one")).select(F.col("one")[key].alias(key))
    found = docs.withColumn(own, name(_digest())).join(kept, F.col(own) == F.col(key), "left_semi")
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).limit(1).count():  # some rows share id and text
        found = found.withColumn(n, F.row_number().over(Window.partitionBy(own).orderBy(*sortable(docs.drop("text"))))).filter(F.col(n) == 1)
    return found.select(docs.columns)


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(g)
"""
