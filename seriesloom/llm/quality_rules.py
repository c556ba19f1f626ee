"""Quality rules with thresholds adapted to each language and source.

Text statistics are taken in one pass over the documents. The values of each
ratio are then gathered in a mergeable quantile sketch (KLL, ``SKETCH`` items a
level) for each (lang, source): partial sketches are merged map-side, so a hot
source costs no more than any other, and no value is capped. The sketches of a
language, and of the whole corpus, are merged from those of its sources. Up to
``SKETCH`` values a sketch is exact; beyond, the rank of a quantile it gives is
off by about 0.13 % of the values at most (99 % confidence).

Fences come from the quantiles alone, there are no fixed cutoffs: the upper one
lies as far beyond the quantile ``tail`` of a ratio as that lies above the
median (times ``reach``), a lower one likewise below. A group's fence is averaged with its
language's, which counts as ``PRIOR`` documents, and that in the same way with
the corpus's; so small groups lean on larger ones, without a switch.

The verdict is a join: a document stays if no ratio lies outside the fences of
its group. Documents that fail the base rules take no part in the sketches.

Defined results: a null or empty text has no words and fails; texts of any length
are read whole; null lang and source form groups of their own; equal rows are
judged alike, and a ratio that equals a fence stays (so groups of ties stay); an
empty table gives an empty result; further columns, whatever their names, are
ignored. Where a sketch is not exact its choice of items is random, so reruns may
judge documents at a fence differently; within a run the fences are written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import WORD_SPACE, distinct, staged

SYMBOLS = b"#*$%&|<>"
#: ratio: (numerator, denominator, tail quantile, lower fence too)
RATIOS = {
    "word_length": ("word_chars", "n_words", 15 / 16, True),
    "symbols": ("n_symbols", "n_words", 15 / 16, False),
    "dup_lines": ("n_dup_lines", "n_lines", 31 / 32, False),
    "repeats": ("n_repeat_words", "n_words", 31 / 32, False),
}
#: Ratios are whole numbers of this part of one.
UNIT = 10_000
REACH = 1
#: Documents that the fence of the larger group counts as.
PRIOR = 32
SKETCH = 4096
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
CHUNK_BYTES = 1 << 20


class Ids(dict):
    """Number each key in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, words in 5-word windows that it holds twice or more."""
    n = len(ids) - 4
    if n < 2:
        return np.zeros(n_docs, np.int64)
    inside = doc[4:] == doc[:n]
    k = np.uint64(0x9E3779B97F4A7C15)
    key = doc[:n].astype(np.uint64)
    for j in range(5):
        key = (key ^ ids[j : j + n].astype(np.uint64)) * k
        key ^= key >> np.uint64(29)
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (doc[a] == doc[b])
    for j in range(5):  # equal keys are confirmed on the words
        same[same] = ids[a[same] + j] == ids[b[same] + j]
    hit = np.zeros(len(ids) + 1, np.int64)
    found = distinct(np.concatenate([a[same], b[same]]))
    hit[found] += 1
    hit[found + 5] -= 1
    covered = np.cumsum(hit[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def chunk_stats(texts: list[bytes]) -> np.ndarray:
    """One row of STATS for each text."""
    out = np.zeros((len(texts), 6), np.int64)
    ids, parts = Ids(), []
    for i, t in enumerate(texts):
        words = t.split()
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 0] = len(words)
        out[i, 2] = len(t) - len(t.translate(None, SYMBOLS))
        out[i, 3], out[i, 4] = len(lines), len(lines) - len(set(lines))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    out[:, 5] = repeated_words(flat, np.repeat(np.arange(len(texts)), out[:, 0]), len(texts))
    return out


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATS, read in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATS.split(",")]
        for batch in batches:
            raw = pc.fill_null(batch["text"], "")
            points = pc.utf8_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, texts, size = [], [], 0
            spaces = np.zeros(len(raw), np.int64)
            for i, t in enumerate(raw.cast(pa.binary() if raw.type == pa.string() else pa.large_binary())):
                b = t.as_py()
                spaces[i] = len(b) - len(b.translate(None, WORD_SPACE))
                texts.append(b)
                size += len(b)
                if size >= CHUNK_BYTES:
                    rows.append(chunk_stats(texts))
                    texts, size = [], 0
            rows.append(chunk_stats(texts))
            stats = np.concatenate(rows)
            stats[:, 1] = points - spaces
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *[pa.array(stats[:, j]) for j in range(6)]], ["doc_id", "lang", "source", *names])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(run, f"doc_id long, lang string, source string, {STATS}")


def _ratio(name: str) -> Column:
    top, bottom, *_ = RATIOS[name]
    return F.expr(f"`{top}` * {UNIT}L div greatest(`{bottom}`, 1)")


def _fence(sketch: Column, tail: float, side: int, reach: int) -> Column:
    """The upper (side 1) or lower (side -1) fence that a sketch gives."""
    read = lambda q: F.kll_sketch_get_quantile_bigint(sketch, F.lit(q))
    end = read(tail if side > 0 else 1 - tail)
    return F.greatest(end + (end - read(0.5)) * reach, F.lit(0).cast("long"))


def fences(judged: DataFrame, reach: int = REACH, prior: int = PRIOR, size: int = SKETCH) -> DataFrame:
    """lang, source and the fences of each ratio ({ratio}_high, {ratio}_low)."""
    groups = judged.groupBy("lang", "source").agg(
        F.count(F.when(~F.col("base_failed"), 1)).alias("n"),
        *[F.kll_sketch_agg_bigint(F.when(~F.col("base_failed"), _ratio(r)), F.lit(size)).alias(r) for r in RATIOS],
    )
    groups = staged(groups, "quality-sketches")
    wanted = [(r, tail, side) for r, (_, _, tail, lower) in RATIOS.items() for side in ((1, -1) if lower else (1,))]
    name = lambda r, side: f"{r}_{'high' if side > 0 else 'low'}"
    found = None
    for keys in ([], ["lang"], ["lang", "source"]):
        merged = groups if len(keys) == 2 else groups.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_bigint(r).alias(r) for r in RATIOS])
        own = merged.filter("n > 0").select(*keys, "n", *[_fence(F.col(r), tail, side, reach).alias(name(r, side)) for r, tail, side in wanted])
        if found is None:
            found = own.drop("n")
            continue
        above = found.select(*[F.col(c).alias(f"above_{c}") for c in found.columns])
        joined = own.join(above, own["lang"].eqNullSafe(F.col("above_lang"))) if len(keys) == 2 else own.crossJoin(F.broadcast(above))  # one row
        blend = lambda c: F.expr(f"(n * {c} + {prior}L * above_{c}) div (n + {prior}L)").alias(c)  # noqa: E731, B023
        found = joined.select(*keys, *[blend(name(r, side)) for r, _, side in wanted])
    return found


def quality_rules(docs: DataFrame, reach: int = REACH, prior: int = PRIOR, size: int = SKETCH) -> DataFrame:
    """STATS, base_failed and kept of each document, with its group's fences."""
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    judged = staged(text_stats(docs).withColumn("base_failed", failed), "quality-stats")
    limits = staged(fences(judged, reach, prior, size), "quality-fences").withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    rows = judged.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    fits = F.lit(True)
    for r, (*_, lower) in RATIOS.items():
        fits = fits & (_ratio(r) <= F.col(f"{r}_high"))
        if lower:
            fits = fits & (_ratio(r) >= F.col(f"{r}_low"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))


def _fence_sql() -> str:
    """The same verdict with exact quantiles, so a reference for tables of up to SKETCH documents."""
    wanted = [(r, side, f"{r}_{'high' if side > 0 else 'low'}") for r, (*_, lower) in RATIOS.items() for side in ((1, -1) if lower else (1,))]
    ratio = {r: f"({t} * {UNIT} // greatest({b}, 1))" for r, (t, b, _, _) in RATIOS.items()}

    def level(keys: str) -> str:
        picks = []
        for r, side, name in wanted:
            at = lambda q: f"list({ratio[r]} ORDER BY {ratio[r]})[greatest(1, ceil(count(*) * {q!r}::DOUBLE))::BIGINT]"  # noqa: E731, B023
            end = at(RATIOS[r][2] if side > 0 else 1 - RATIOS[r][2])
            picks.append(f"greatest({end} + ({end} - {at(0.5)}) * {REACH}, 0) AS {name}")
        return f"SELECT {keys and keys + ', '}count(*) AS n, {', '.join(picks)} FROM j WHERE NOT base_failed" + (f" GROUP BY {keys}" if keys else "")

    blend = lambda own, above: ", ".join(f"({own}.n * {own}.{c} + {PRIOR} * {above}.{c}) // ({own}.n + {PRIOR}) AS {c}" for *_, c in wanted)
    test = " AND ".join(f"{ratio[r]} {'<=' if side > 0 else '>='} fences.{c}" for r, side, c in wanted)
    return f"""
, q0 AS ({level("")}), q1 AS ({level("lang")}), q2 AS ({level("lang, source")}),
m AS (SELECT q1.lang, {blend("q1", "q0")} FROM q1 CROSS JOIN q0),
fences AS (SELECT q2.lang, q2.source, {blend("q2", "m")} FROM q2 JOIN m ON q2.lang IS NOT DISTINCT FROM m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({test}, true) AS kept
FROM j LEFT JOIN fences ON j.lang IS NOT DISTINCT FROM fences.lang AND j.source IS NOT DISTINCT FROM fences.source
"""


QUALITY_SQL = (
    r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS five, lead(x, 4) OVER o AS z FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g WHERE z IS NOT NULL) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
j AS (SELECT d.doc_id, d.lang, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
        CAST(len(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        len(w) < 10 OR coalesce(r.n, 0) * 100 > len(w) * 20 AS base_failed
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id)"""
    + _fence_sql()
)
