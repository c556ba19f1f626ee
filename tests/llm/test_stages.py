"""The five pipeline stages on awkward rows, and the pipeline against a brute-force version."""

import collections
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest

import corpus_pipeline
from seriesloom.llm import common, mixing, packing, toxicity
from tests.llm.test_operators import brute_components

#: Names that the operators use inside.
CLASHING = ("kept_id", "kept_key", "own_key", "own_digest", "copy", "mix_id", "mix_key", "mix_nth", "mix_copies", "sha", "digest", "id", "b", "i", "block", "row", "n", "label", "score")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def make(spark, rows):
    """Rows of (doc_id, text, lang, source), each with the clashing columns."""
    return spark.createDataFrame([(i, t, lang, s, None, *[f"{c}{i}" for c in CLASHING]) for i, t, lang, s in rows], SCHEMA)


def plain(df):
    return sorted(str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) for _ in range(120)]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(base)]
    out += [(200 + i, base[i], "en", "s0") for i in range(10)]  # copies of other ids
    out += [(5, base[5], "en", "s1"), (5, base[5], "en", "s1"), (5, base[5], "de", None), (5, base[6] + " more", "en", "s1")]  # one id: equal rows, another column, another text
    out += [(300 + i, base[i] + " tail", "en", "s2") for i in range(20, 30)]  # near copies
    out += [(None, base[40], "en", "s3"), (None, base[40], "en", "s3"), (None, None, None, None), (400, None, "en", "s1"), (401, "", "en", "s1"), (402, " \n", "en", "s1")]
    out += [(500, " ".join(rng.choice(words) for _ in range(60_000)), "en", "s1")]  # very long
    out += [(600 + i, base[i][:40] + " you idiot " + base[i], "en", "s0") for i in range(60, 75)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, _, _ in rows if i is not None and i < 500] + [(i, 0, 1) for i in range(660, 675)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_clashing_columns(spark, docs, sf_dir, stage):
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, docs.limit(0), sf_dir).count() == 0, name
    got = run(spark, docs, sf_dir)
    if stage < 4:
        assert got.schema == docs.schema, name
        # every row is one of the input's, with its own columns
        assert all(r["kept_key"] == f"kept_key{r['doc_id']}" and r["b"] == f"b{r['doc_id']}" for r in got.collect()), name


def test_toxic_rows_go(spark, docs, rows, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model)
    want = sorted(str(r) for r in rows if scorer.scores([(r[1] or "").encode()])[0] < toxicity.LIMIT)
    assert plain(corpus_pipeline.remove_toxic(spark, docs, sf_dir)) == want
    assert sum("idiot" in x for x in want) < 3 and len(want) > 0.9 * (len(rows) - 15)


def brute_exact(rows):
    best = {}
    for r in rows:
        key = r[1] or ""
        # the largest id; of equal ids and texts the first by the other columns, nulls first
        order = (r[0] is not None, r[0] or 0, [-ord(c) for c in (r[2] or "")] or [1], [-ord(c) for c in (r[3] or "")] or [1])
        if key not in best or order > best[key][0]:
            best[key] = (order, r)
    return [r for _, r in best.values()]


def brute_near(rows):
    labels = brute_components([t for _, t, _, _ in rows])
    groups = collections.defaultdict(list)
    for r, (_, _, root) in zip(rows, labels, strict=True):
        groups[root].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def test_exact_and_near_copies_go(spark, rows, sf_dir):
    first = [r for r in rows if r[0] != 5 or r[2] == "en"]  # equal rows differ in nothing
    exact = corpus_pipeline.remove_copies(spark, make(spark, first), sf_dir)
    want = brute_exact(first)
    assert plain(exact) == sorted(map(str, want))
    assert plain(corpus_pipeline.remove_near_copies(spark, exact, sf_dir)) == sorted(map(str, brute_near(want)))
    # of rows that share id and text the same one stays on any partitioning
    every = make(spark, rows)
    assert sorted(map(str, corpus_pipeline.remove_copies(spark, every.repartition(7), sf_dir).collect())) == sorted(map(str, corpus_pipeline.remove_copies(spark, every.coalesce(1), sf_dir).collect()))


def test_mix_emits_rows_as_often_as_taken(spark, docs, rows, sf_dir):
    size = lambda t: len((t or "").encode().split())
    taken = mixing.mix_sources(docs).collect()
    want = collections.Counter()
    for r in taken:
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    got = collections.Counter((r["doc_id"], r["source"], size(r["text"])) for r in corpus_pipeline.mix(spark, docs, sf_dir).collect())
    assert got == +want and sum(n * k[2] for k, n in got.items()) == sum(r["taken"] for r in taken)
    assert len(taken) == len(rows) and all(r["copies"] == 0 for r in taken if not r["size"])
    again = mixing.mixed_documents(docs.repartition(3))
    assert plain(again) == plain(corpus_pipeline.mix(spark, docs, sf_dir))


def test_copies_never_share_a_bin(spark, docs, rows):
    twice = docs.withColumn("lang", docs["lang"]).selectExpr("*", "explode(array(1, 2)) as again").drop("again")
    got = packing.pack_documents(twice).collect()
    assert len({(r["row"], r["piece"]) for r in got}) == len(got)
    assert sum(r["n_tokens"] for r in got) == 2 * sum(len((t or "").encode().split()) + 1 for _, t, _, _ in rows)
    for other in (packing.pack_documents(twice, block_tokens=5000).collect(), got):
        bins = collections.defaultdict(list)
        for r in other:
            if r["doc_id"] is not None and r["doc_id"] > 5:
                bins[r["bin_id"]].append((r["doc_id"], r["piece"]))
        assert all(len(set(x)) == len(x) for x in bins.values())


def test_pipeline_against_brute_force(spark, rows, sf_dir):
    labels, base = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit(base, labels))
    kept = [r for r in rows if scorer.scores([(r[1] or "").encode()])[0] < toxicity.LIMIT]
    near = brute_near(brute_exact(kept))
    size = lambda t: len((t or "").encode().split())
    per = collections.Counter()
    for _, t, _, s in near:
        per[s] += size(t)
    # targets: weights 3, 1, 2 in the order of sources, none above twice its source
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (3, 1, 2)[j % 3] for j, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(per.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * per[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in full}
        left -= sum(2.0 * per[s] for s in full)
        open_ -= full
    out = corpus_pipeline.run(spark, sf_dir).collect()
    copies = collections.Counter()
    for r in out:
        copies[r["doc_id"]] += r["n_tokens"]
    tokens, largest = collections.Counter(), max(size(t) for _, t, _, _ in near)
    for i, t, _, s in near:
        if copies.get(i) and i is not None:
            assert copies[i] in (size(t) + 1, 2 * (size(t) + 1))
        if i is not None:
            tokens[s] += copies.get(i, 0) - (copies.get(i, 0) // (size(t) + 1) if size(t) else 0)
    assert set(copies) <= {r[0] for r in near}
    for s in per:
        assert abs(tokens[s] + sum(size(t) for i, t, _, q in near if i is None and q == s and copies.get(None)) - target[s]) <= 2 * largest
    for r in out:
        assert r["bin_start"] + r["n_tokens"] <= r["bin_used"] <= r["bin_size"] in packing.SIZES


@pytest.mark.parametrize(("folder", "master", "want"), [(None, "local[8]", "/tmp/checkpoints"), ("hdfs://x/c/", "spark://h:1", "hdfs://x/c"), ("/own", "local", "/own"), (None, "spark://h:1", None), (None, "local-cluster[2,1,1024]", None)])
def test_staged_tables_need_a_shared_folder(folder, master, want):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    if want:
        assert common.shared_dir(session) == f"{want}/seriesloom-app"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session)


def test_staged_tables_can_be_dropped(spark):
    df = spark.range(3)
    one, two = common.staged(df, "x"), common.blocked(df.selectExpr("id", "'a' t"), "y", 3, "t", 10)
    assert one.count() == two.count() == 3
    before = len(os.listdir(common.shared_dir(spark)))
    common.drop_staged(spark)
    assert before >= 2 and not os.path.exists(common.shared_dir(spark)) and not [t for t in spark.catalog.listTables() if t.name.startswith("seriesloom_")]


def test_blocks_spread_over_buckets(spark):
    values = [0, 1, -1, 2**40 + 7, -(2**62), 5 << 32, *range(100)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x long").selectExpr("hash(x)").collect()]
    assert common.spark_hash(np.array(values)).tolist() == want
    loads = collections.Counter()
    for part in range(40):
        last = (part << 32) - 1
        for nth in range(3):
            b = common.block_number(part, nth, last + 1, 128)
            assert last < b < (part + 1) << 32
            last = b
            loads[int(common.spark_hash(np.array([b]))[0]) % 128] += 1
    assert max(loads.values()) <= 2 and sum(loads.values()) == 120


def test_blocks_hold_all_rows(spark):
    texts = ["", None, *("x" * (i % 50) for i in range(500)), "y" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2)
    got = common.blocked(df, "z", 20_000, "t", 1000).collect()
    assert sorted(r["t"] for r in got) == sorted(t or "" for t in texts) and len({(r["b"], r["i"]) for r in got}) == len(texts)
    size = collections.Counter()
    for r in got:
        size[r["b"]] += len(r["t"]) + common.ROW_BYTES
    assert max(size.values()) <= 5000 + common.ROW_BYTES + 1000 and len(size) > 20
