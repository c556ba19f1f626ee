"""Corpus operators against brute force, and their edge cases, on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import chat_format, components, exact_dedup, exchange, gru_model, jaccard_join, license_scan, mixing, packing, ppm_score, quality_rules, repeat_removal, toxicity
from seriesloom.llm.queries import oracle_sql, queries
from tests.compare import connection, difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string"


def make(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 90))) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(70))
    joined = [f"{a} {passage} {b}" for a, b in zip(base[20:26], base[26:32], strict=True)]
    return [*base, *near, *base[5:10], *joined, None, "", " \t\n", "one two", "ONE TWO", "é ü x <|im_end|> ß", "a " * 5000, "x" * 70_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op7_weighted_mix", "op8_chat_format", "op9_exact_dedup"])
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert difference(spark, sf, queries()[name], oracle_sql()[name], connection(sf)) == ""


def test_exact_dedup(spark, docs, texts, empty):
    rows = docs.unionByName(docs.filter("doc_id in (0, 7)"))  # equal rows too
    got = exact_dedup.exact_dedup(rows).collect()
    assert len(got) == len(texts) + 2
    best = {}
    for i, t in enumerate(texts):
        best[t or ""] = i
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["keep_id"] == best[t] and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(best) == exact_dedup.drop_exact_copies(rows).count()
    # all digests in the ordinary shuffle, and all on the broadcast side, agree
    assert sorted(map(tuple, exact_dedup.exact_dedup(rows, support=0.9).collect())) == sorted(map(tuple, got)) == sorted(map(tuple, exact_dedup.exact_dedup(rows, support=0.001).collect()))
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.exact_dedup(docs.selectExpr("cast(null as long) doc_id", "'a' text")).filter("kept").count() == 1


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components(spark, docs, texts, empty, monkeypatch, small):
    if small:  # many blocks, hash partitions and chunks of tiles
        for name, value in (("PART_SHINGLES", 500), ("TILE_SETS", 3), ("PIVOT_SETS", 3), ("MOST_SIZES", 0)):
            monkeypatch.setattr(jaccard_join, name, value)
        monkeypatch.setattr(jaccard_join, "tile_parts", lambda sets, num, den: 9)
    got = sorted(tuple(r) for r in jaccard_join.near_components(docs, block_bytes=5000 if small else 1 << 20).collect())
    assert got == brute_components(texts)
    assert jaccard_join.near_components(empty).count() == 0


def test_all_links(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 5)
    pairs, members = jaccard_join.near_links(docs)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert all((of[a] == of[b]) == (sets[a] == sets[b]) for a in of for b in range(a) if sets[a] and sets[b]) and {of[i] for i, x in enumerate(sets) if not x} == {None}
    want = {frozenset((of[a], of[b])) for a in of for b in range(a) if sets[a] and sets[b] and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [frozenset(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 5


@pytest.mark.parametrize("steps", [("all",), ("pivot", "all"), ("forest", "all")])
def test_each_reading_of_the_tiles_finds_the_rest(spark, monkeypatch, steps):
    rng = random.Random(6)
    base = [f"w{rng.randrange(40)}" for _ in range(60)]
    rows = []
    for i in range(60):  # a chain of near copies: only neighbours link
        base = [*base[3:], *(f"w{rng.randrange(40)}" for _ in range(3))]
        rows.append(" ".join(base))
    rows += [" ".join(f"z{j}" if j == i else f"c{j}" for j in range(60)) for i in range(50)]  # a dense group
    rng.shuffle(rows)
    real = jaccard_join._candidates
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 7)
    monkeypatch.setattr(jaccard_join, "PIVOT_SETS", 5)
    monkeypatch.setattr(jaccard_join, "_candidates", lambda num, den, step: real(num, den, step) if step in steps else lambda t: real(num, den, "all")(t).slice(0, 0))
    assert sorted(tuple(r) for r in jaccard_join.near_components(make(spark, rows)).collect()) == brute_components(rows)


def test_jaccard_rows_without_an_id_link(spark):
    w = [f"w{i}" for i in range(120)]
    rows = spark.createDataFrame([(i, " ".join(w[a : a + 100])) for i, a in ((1, 0), (None, 10), (2, 20), (None, 10))], "doc_id long, text string")
    got = jaccard_join.near_components(rows).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "None", "None"] and {r["component_id"] for r in got} == {1}
    assert [r["doc_id"] for r in jaccard_join.one_of_each(rows).collect()] == [1]


def test_jaccard_one_row_of_each_component(spark):
    w = [f"w{i}" for i in range(120)]
    text = lambda a: " ".join(w[a : a + 100])
    rows = [(5, text(0), "x"), (5, text(0), "x"), (5, text(0), "y"), (5, "other words of the same id here", "z"), (3, text(10), "q"), (7, "", "e"), (7, "", "e"), (8, None, "e"), (None, " ", "e")]
    got = sorted(str(tuple(r)) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept_key string")).collect())
    assert got == sorted(map(str, [rows[3], rows[4], rows[5], rows[7], rows[8]]))


def test_clashes_do_not_lower_the_count():
    # in class 1 two shingles have the lower bits 7, which another class of another block has once; 9 is alone
    key = lambda *x: np.array(x, np.uint64)
    asked = pa.concat_tables([exchange.sent(1, [key(7, 7, 8), key(9)]), exchange.sent(2, [key(7)])])
    got = exchange.answers(exchange.answered(0)(asked).filter(pc.field("b") == 1), 0)
    assert [x.tolist() for x in got] == [[7], [3], [2]]


@pytest.mark.parametrize(("links_", "pointers"), [(0, 0), (0, 10**6), (10, 0), (10**6, 0)])
def test_components(spark, monkeypatch, links_, pointers):
    monkeypatch.setattr(components, "MOST_LINKS", links_)
    monkeypatch.setattr(components, "MOST_POINTERS", pointers)
    rng = random.Random(11)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(300, 316)] + [(rng.randrange(500, 540), rng.randrange(500, 540)) for _ in range(20)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes(monkeypatch, texts):
    from seriesloom.llm.shingles import WordHasher

    data = [(t or "").encode() for t in [*texts, "Ab\x0bab\x1caB\x85x", "a" * 300 + " b"]]
    words = [t.lower().split() for t in data]
    for piece in (1 << 20, 50):
        monkeypatch.setattr(WordHasher, "PIECE", piece)
        hashes, sizes = WordHasher().words(data)
        assert sizes.tolist() == [len(w) for w in words]
        flat = [x for w in words for x in w]
        seen = dict(zip(flat, hashes.tolist(), strict=True))
        assert [seen[x] for x in flat] == hashes.tolist() and len(set(seen.values())) == len(seen)
    assert [len(x) for x in WordHasher().words([])] == [0, 0]


def test_tile_bound_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (20, 25, 40, 300)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], s[:1] + np.uint64(1)])) for s in sets]
    from seriesloom.llm.shingles import bitmap, signature_words

    n = np.array([len(s) for s in sets])
    maps = [bitmap(s, signature_words(len(s))) for s in sets]
    found = {tuple(sorted((int(a), int(b)))) for p, q in jaccard_join.tile_pairs(n, np.arange(len(sets)), np.ones(len(sets), bool), maps) for a, b in zip(p, q, strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 4 * both < 3 * (n[a] + n[b] - both) or (b, a) in found


def test_tile_forest():
    rng = np.random.default_rng(8)
    label = np.array([0, 0, 1, 2, 3, 3, 4, 5])
    trees = jaccard_join.Forest(label)
    kept = []
    for _ in range(3):
        p, q = rng.integers(0, 7, 40), rng.integers(0, 7, 40)  # the last set meets no other
        a, b = trees.joining(p, q, rng.random(40))
        kept += zip(label[a].tolist(), label[b].tolist(), strict=True)
    assert len(kept) == 4 and all(x != y for x, y in kept)
    assert len(set(trees.tree[:7].tolist())) == 1 and trees.tree[7] != trees.tree[0]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 5000, "hot": 3}])
def test_repeats(spark, docs, texts, empty, options):
    rows = [*enumerate(texts), *[(3, texts[3])] * 3, (None, texts[45]), (None, texts[45])]  # equal rows, with and without an id
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    want = []
    for (doc, _), t in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((doc, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    got = repeat_removal.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 b", "2 i", "'x' sha").repartition(3), **options).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    assert all(r["n_removed"] == sum(x["end"] - x["start"] for x in r["spans"]) for r in got)
    assert repeat_removal.repeated_passages(empty).count() == 0


def test_clashes_are_told_apart_by_bytes(monkeypatch):
    data = np.frombuffer(b"a" * 199 + b"b" + b"a" * 199 + b"c" + b"q" * 30 + b"a" * 199 + b"b", np.uint8)
    starts = np.array([0, 200, 430])
    monkeypatch.setattr(repeat_removal.Powers, "hashes", lambda self, sums, at, size: np.zeros(len(at), np.uint64))
    assert repeat_removal.radix_groups(data, starts, repeat_removal.Powers(len(data))).tolist() == [True, False, True]


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(2)
    t = rng.integers(97, 123, 5000, dtype=np.uint8).tobytes()
    whole = sum(int(b - a + 1) for _, p in repeat_removal.pieces(t) for _, a, b in [repeat_removal.anchors(p, repeat_removal.Powers())] for a, b in zip(a, b, strict=True))
    monkeypatch.setattr(repeat_removal, "PIECE", 700)
    cut = sum(int(b - a + 1) for _, p in repeat_removal.pieces(t) for _, a, b in [repeat_removal.anchors(p, repeat_removal.Powers())] for a, b in zip(a, b, strict=True))
    assert whole == cut == 4801


@pytest.mark.parametrize("options", [{"block_bytes": 20_000}, {"block_bytes": 1 << 20, "low": 1}])
def test_ppm(docs, texts, empty, options):
    words = [(t or "").encode().lower().split() for t in texts]
    train = [w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(x for w in train for x in [*w, "end"])
    n, v = sum(count.values()), len(count)
    k = ppm_score.ORDER
    node = collections.defaultdict(collections.Counter)
    stream = lambda w: b"\n" * k + b" ".join(w) + b"\n"
    for w in train:
        t = stream(w)
        for i in range(k, len(t)):
            for j in range(k + 1):
                node[t[i - j : i]][t[i]] += 1

    def log10(context, byte):
        out, seen = 0.0, set()
        for j in range(k, -1, -1):
            c = {x: y for x, y in node.get(context[k - j :], {}).items() if x not in seen}
            if not c:
                continue
            t, d = sum(c.values()), len(c)
            if byte in c:
                return out + math.log10((2 * c[byte] - 1) / (2 * t))
            out += math.log10(d / (2 * t))
            seen |= set(c)
        return out - math.log10(256 - len(seen))

    got = {r["doc_id"]: r for r in ppm_score.ppm_scores(docs, **options).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(words):
        all_ = [*w, "end"]
        r, t = got[i], stream(w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(all_), sum(x in count for x in all_), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in all_))
        if len(t) < 2000:
            assert r["score"] == pytest.approx(sum(log10(t[j - k : j], t[j]) for j in range(k, len(t))))
    assert ppm_score.ppm_scores(empty).count() == 0


def test_ppm_counts_equal_rows_each(spark):
    rows = [(1, "ab ab"), (1, "ab ab"), (None, "ab ab"), (None, "cd"), (2, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, b string, held string").repartition(3)
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    got = ppm_score.ppm_scores(docs, block_bytes=20_000).collect()
    assert len(got) == 5 and {r["train_tokens"] for r in got} == {sum(len(t.split()) + 1 for t in train)}
    assert len({(r["score"], r["base_score"]) for r in got if r["n_tokens"] == 3}) == 1 and max(r["n_tokens"] for r in got) == 40_001


def test_chat_round_trip(spark):
    nasty = "<|im_end|><\\|im_start|> <\\\\| < | \\ <"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, 0, "system", "s"), (3, 0, "assistant", ""), (3, 1, "assistant", "b\nc"), (None, 5, "us\ner", "x"), (3, 1, "assistant", "b\nc")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat_format.chat_examples(convs)
    got = {r["conv_id"]: r for r in chat_format.chat_digests(ex).collect()}
    for cid in (1, 2, 3, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == cid))
        assert got[cid]["n_turns"] == len(mine)
        assert got[cid]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[cid]["loss_sha256"] == hashlib.sha256("".join(x for _, r, x in mine if r == "assistant").encode()).hexdigest()
    for r in ex.filter("loss_start is not null and conv_id = 1").collect():
        assert "<|" not in r["formatted"][r["loss_start"] : r["loss_end"]]
    assert chat_format.chat_digests(chat_format.chat_examples(convs.filter("false"))).count() == 0


def test_chat_of_long_texts_and_odd_columns(spark):
    long = "<|x " * 200_000
    rows = [(1, 0, "user", long, "f"), (1, 1, "assistant", long, "f"), (1, 1, "assistant", long, "f")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    ex = chat_format.chat_examples(convs)
    got = chat_format.chat_digests(ex).first()
    assert ex.count() == 2 and (got["n_turns"], got["loss_chars"]) == (3, 2 * len(long)) and got["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest()
    probe = chat_format.with_probe(convs).filter("conv_id = -1").orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in probe] == [(0, "user", chat_format.PROBE), (1, "assistant", chat_format.PROBE)]


def test_mix(docs, texts, empty):
    got = mixing.mix_sources(docs, slices=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(3), slices=20).collect()))
    
    per = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode().split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        p = per[r["source"]]
        p[0] += r["size"]
        p[1] += r["taken"]
        p[2] = r["target"]
        p[3] = max(p[3], r["size"])
    total = sum(p[0] for p in per.values())
    assert sum(p[2] for p in per.values()) == pytest.approx(1.5 * total)
    for p in per.values():
        assert p[2] <= 2 * p[0] + 1e-9 and abs(p[1] - p[2]) <= max(q[3] for q in per.values())
    assert mixing.mix_sources(empty).count() == 0


def naive_fit(lengths, sizes):
    used, size, bins = [], [], []
    for i, x in enumerate(lengths):
        room = [(size[b] - used[b], b) for b in range(len(used)) if size[b] - used[b] >= x]
        if room:
            b = min(room)[1]
        else:
            rest = lengths[i + 1 :]
            rate, s = min((packing.token_cost(s) / min(s, x + sum(y for y in rest if y <= s - x)), s) for s in sizes if s >= x)
            used.append(0)
            size.append(s)
            b = len(used) - 1
        bins.append(b)
        used[b] += x
    return bins, [min(s for s in sizes if s >= u) for u in used]


def test_best_fit():
    rng = random.Random(5)
    for sizes in ((8, 16, 32), (10,), (4, 100)):
        lengths = sorted((rng.randint(1, sizes[-1]) for _ in range(200)), reverse=True)
        bins, start, final = packing.best_fit(lengths, sizes)
        fill = collections.Counter()
        for b, s, x in zip(bins, start, lengths, strict=True):
            assert s == fill[b]
            fill[b] += x
        assert all(fill[b] <= final[b] for b in fill)
        _, want = naive_fit(lengths, sizes)
        assert sorted(final) == sorted(want)  # ties between bins of equal room may go either way


def test_packing_keeps_every_token(docs, texts, empty):
    rows = packing.pack_documents(docs).collect()
    per = collections.Counter()
    for r in rows:
        per[r["doc_id"]] += r["n_tokens"]
        assert r["bin_start"] + r["n_tokens"] <= r["bin_used"] <= r["bin_size"]
    assert per == {i: len((t or "").encode().split()) + 1 for i, t in enumerate(texts)}
    assert packing.pack_documents(empty).count() == 0


LICENSE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, i, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, count(label) AS n_base, min(i - 1) FILTER (label IS NOT NULL) AS first_word, max(i - 1) FILTER (label IS NOT NULL) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN p ON p.doc_id = w.doc_id GROUP BY w.doc_id
"""


def test_base_phrases_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    base = lambda s, d: queries()["op5_license_scan"](s, d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert difference(spark, sf, base, LICENSE_SQL, connection(sf)) == ""


def test_license_scan_of_long_and_repeated_rows(spark):
    mit = "permission is hereby granted, free of charge, to any person obtaining a copy"
    long = "word " * 300_000 + mit.replace("charge", "chrage") + " word" * 1000 + " all rights reserved"
    rows = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, long, "y")], "doc_id long, text string, spans string")
    got = license_scan.scan_licenses(rows).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in map(lambda r: tuple(map(str, r)), got)}) == 1
    assert (got[0]["n_words"], got[0]["first_word"], got[0]["labels"]) == (300_000 + 13 + 1000 + 3, 301_013, "mit,reserved") and got[0]["spans"][0]["first_word"] == 300_000


def test_license_scan(spark, empty):
    mit = "permission is hereby granted, free of charge, to any person obtaining a copy"
    texts = ["All rights reserved. x all RIGHTS reserved", "licensed under CC BY-NC 4.0", mit, "x " + mit.replace("granted", "grantd").replace("person", "persons") + " y", "nothing", None, "", "Licenced under the Apache licence, version 2.0", mit.replace("e", "")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(make(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(9)] == ["reserved", "cc,cc-by", "mit", "mit", "", "", "", "apache", ""]
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (7, 2, 0, 4, "reserved")
    assert got[3]["spans"][0]["edits"] == 2 and got[3]["spans"][0]["first_word"] == 1 and got[4]["first_word"] is None
    assert license_scan.scan_licenses(empty).count() == 0


def test_seeds_miss_nothing():
    import regex

    scanner, rng = license_scan.Scanner(), random.Random(9)
    for label, notice, k in license_scan.NOTICES:
        for edits in range(k + 2):
            x = list(notice)
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice("abcxyz")
            _, joined = scanner.words(("before " + "".join(x) + " after").encode())
            whole = any(regex.search(b"(?:%s){e<=%d}" % (regex.escape(n.encode()), m), joined) for lab, n, m in license_scan.NOTICES if lab == label)
            assert any(s.label == label for s in scanner.fuzzy(joined)) == whole


def test_quality_statistics(docs, texts, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        five = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + d for j in range(len(w) - 4) if five[tuple(w[j : j + 5])] > 1 for d in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^ \t-\r]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0


def quality_kept(spark, texts, **options):
    return {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(make(spark, texts).selectExpr("doc_id", "text", "'en' lang", "'s' source"), **options).collect()}


def test_quality_fences_have_no_top(spark):
    def marked(n):  # n symbols in each word of 1,000
        return " ".join("#" * n + "x" * (998 - n) + f"{j:02}" for j in range(12))

    def long_words(n):
        return " ".join(f"{j:02}" + "x" * (n - 2) for j in range(12))

    # median 2, quantile 15/16 of 32: 5, so the fence is 8
    got = quality_kept(spark, [marked(n) for n in [0] * 10 + [2] * 10 + [5] * 10 + [8, 990]])
    assert [i for i, k in got.items() if not k] == [31]
    # median 10, quantile 25: fence 40; nothing lies below
    got = quality_kept(spark, [long_words(n) for n in [10] * 20 + [25] * 10 + [40, 100_000]])
    assert [i for i, k in got.items() if not k] == [31]
    # alike however large: all stay, and what lies beyond them on either side goes
    got = quality_kept(spark, [long_words(n) for n in [30_023] * 30 + [29_000, 90_000]])
    assert sorted(i for i, k in got.items() if not k) == [30, 31]


def test_quality_fences_lean_on_larger_groups(spark):
    rows = [(i, "x " * (i % 7) + " ".join(f"{i % 5}y{j}" for j in range(20)), "en" if i < 50 else None, "a" if i < 45 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = quality_rules.text_stats(docs).selectExpr("*", "n_words < 10 base_failed")
    plain = lambda d: {(r["lang"], r["source"]): r["word_length_high"] for r in d.collect()}
    own, whole = plain(quality_rules.fences(judged, prior=0)), plain(quality_rules.fences(judged, prior=10**9))
    assert set(own) == {("en", "a"), ("en", None), (None, None)} and len(set(whole.values())) == 1
    for k, x in plain(quality_rules.fences(judged)).items():
        assert min(own[k], whole[k], *own.values()) - 1 <= x <= max(*own.values(), whole[k])


def test_quality_fences_differ_between_groups(spark):
    limits = quality_rules.quality_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("lang", "source").agg(*[F.first(f"{r}_high").alias(r) for r in quality_rules.RATIOS]).collect()
    for r in quality_rules.RATIOS:
        assert len({x[r] for x in limits}) >= 0.9 * len(limits) == 72


def test_quality_sketches_are_close_beyond_their_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judged = quality_rules.text_stats(docs).selectExpr("*", "n_words < 10 base_failed", "n_words * 10000L div greatest(n_lines, 1) v").filter("n_words >= 10")
    got = judged.groupBy().agg(F.kll_sketch_agg_bigint("v", F.lit(quality_rules.SKETCH)).alias("s"), F.collect_list("v").alias("all")).select(F.kll_sketch_get_quantile_bigint("s", F.lit(15 / 16)).alias("q"), "all").first()
    rank = sum(v <= got["q"] for v in got["all"]) / len(got["all"])
    assert abs(rank - 15 / 16) < 0.005 and len(got["all"]) > quality_rules.SKETCH


def test_network_gradients():
    words = [b"good", b"bad", b"ugly", b"fine"]
    model = gru_model.Model({b"good": 1, b"bad": 2}, {b"good": 1}, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    at, mask = np.array([[0, 1, 2], [3, 0, 0]]), np.array([[1, 1, 1], [1, 0, 0]], bool)
    y = np.array([1.0, 0.0])

    def loss():
        p, _ = model.windows(*model.project(model.encode(words)[0]), at, mask)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = model.gradients(words, at, mask, y)
    for name in ("wf", "ub", "wa", "v", "wo", "cuf", "cwb", "word", "char"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, h = model.p[name][i], 1e-2
        model.p[name][i] = old + h
        up = loss()
        model.p[name][i] = old - h
        down = loss()
        model.p[name][i] = old
        assert (up - down) / (2 * h) == pytest.approx(float(g[name][i]), rel=0.05, abs=1e-4)


def plain_gru(p, u, steps):
    """States of one sequence of projections, in the order of ``steps``."""
    n = u.shape[0]
    h, out = np.zeros(n), np.zeros((len(p), n))
    for i in steps:
        a = h @ u
        z, r = (1 / (1 + np.exp(-(p[i][k * n : (k + 1) * n] + a[k * n : (k + 1) * n]))) for k in (0, 1))
        h = (1 - z) * np.tanh(p[i][2 * n :] + r * a[2 * n :]) + z * h
        out[i] = h
    return out


def plain_score(model, text):
    """The largest window score, token by token in double precision."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    found, best = gru_model.tokens(text), 0.0
    for a in gru_model.window_starts(len(found)):
        x = []
        for w in found[a : a + gru_model.WINDOW]:
            byte = p["char"][list(w)]
            ends = [plain_gru(byte @ p[f"cw{d}"] + p[f"cb{d}"], p[f"cu{d}"], range(len(w)) if d == "f" else range(len(w) - 1, -1, -1))[-1 if d == "f" else 0] for d in "fb"]
            x.append(np.concatenate([p["word"][model.vocabulary.get(w, 0)], p["head"][model.heads.get(w[:4], 0)], *ends]))
        x = np.array(x)
        h = np.concatenate([plain_gru(x @ p["wf"] + p["bf"], p["uf"], range(len(x))), plain_gru(x @ p["wb"] + p["bb"], p["ub"], range(len(x) - 1, -1, -1))], axis=1)
        e = np.tanh(h @ p["wa"] + p["ba"]) @ p["v"]
        alpha = np.exp(e - e.max())
        best = max(best, 1 / (1 + np.exp(-((alpha / alpha.sum()) @ h @ p["wo"] + p["bo"][0]))))
    return best


def test_scores_match_a_plain_pass_and_do_not_depend_on_batches():
    rng = random.Random(2)
    some = [" ".join(rng.choice(["idiot", "Good", "x1", "über", "supercalifragilistic", "day"]) for _ in range(n)).encode() for n in (1, 3, 47, 48, 49, 80, 81, 500)]
    bags = [(int(b"idiot" in t), [gru_model.tokens(t)[:48]]) for t in some] + [(0, [[b"good", b"day"]])] * 4
    model = gru_model.train(bags, steps=20)
    want = [plain_score(model, t) for t in some]
    got = toxicity.Scorer(model).scores(some)
    assert got == pytest.approx(want, abs=1e-4)
    more = some * 90
    order = list(range(len(more)))
    rng.shuffle(order)
    mixed = toxicity.Scorer(model).scores([more[i] for i in order])
    assert all(mixed[j] == got[i % len(some)] for j, i in enumerate(order))
    assert [float(toxicity.Scorer(model).scores([t])[0]) for t in some] == got.tolist()


def test_all_windows_of_the_sample_are_read(spark):
    docs = spark.createDataFrame([(i, f"t{i} " * 1000) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    known = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    bags = toxicity.sample_of(docs, labels)
    assert sorted(w[0][0].decode() for _, w in bags) == sorted(f"t{i}" for i in known) and {len(w) for _, w in bags} == {len(gru_model.window_starts(1000))}
    assert len(toxicity.sample_of(docs, labels, 3)) == 6 and sum(map(len, (w for _, w in toxicity.sample_of(docs, labels, 30, 9000)))) <= 2 * len(gru_model.window_starts(1000))


def test_repeated_rows_are_scored_and_linked_each(spark, docs, texts):
    twice = docs.unionByName(docs.filter("doc_id in (0, 7)")).unionByName(docs.filter("doc_id = 7"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for got, column in ((toxicity.toxicity(twice, labels), "score"), (jaccard_join.near_components(twice), "component_id")):
        per = collections.defaultdict(list)
        for r in got.collect():
            per[r["doc_id"]].append(r[column])
        assert {i: len(x) for i, x in per.items() if len(x) > 1} == {0: 2, 7: 3} and len(per) == len(texts) and all(len(set(x)) == 1 for x in per.values())


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(360):
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randint(5, 120))]
        if toxic := i % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron"]))
        rows.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    rows += [None, "", " "]
    docs, lab = make(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, lab).collect()}
    held = [i for i in range(360) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(363))
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) > 0.9
    assert [got[i]["score"] for i in (360, 361, 362)] == [0.0] * 3
    assert {r["score"] for r in toxicity.toxicity(docs, lab.filter("false")).collect()} == {0.0}
    assert toxicity.toxicity(empty, lab).count() == 0
