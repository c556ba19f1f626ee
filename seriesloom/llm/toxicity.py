"""Toxicity scores from a bidirectional gated recurrent network.

The network (see ``gru_model``) is fitted on the driver from all windows of a
bounded sample of labelled documents: at most ``SAMPLE`` of each label and
``SAMPLE_BYTES`` of their texts, whole documents in a fixed pseudo-random order.
It has a fixed size. Every whole document is then scored where it is read: all
its overlapping windows, the largest probability counts. There is no shuffle.

Scores do not depend on what else a task reads: products are taken over batches
of one fixed shape, and scores are rounded to ``DIGITS`` places.

Defined results: an empty, blank or null text has score 0; equal rows get equal
scores; texts of any length are scored whole; without labels of both kinds all
scores are 0; rows of ``labels`` with nulls are left out and a doc_id with
several labels counts as toxic if one is; a doc_id on several rows teaches by
each; a score that equals the limit counts as toxic; an empty table gives an
empty result; lang, source and other columns, whatever their names, are never
read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import crc_mod
from seriesloom.llm.gru_model import STATE, WINDOW, Model, tokens, train, window_starts
from seriesloom.llm.shingles import chunks

#: Most labelled documents of each label, and bytes of all their texts, to learn from.
SAMPLE, SAMPLE_BYTES = 1200, 48 << 20
LIMIT = 0.7
#: Windows or tokens in one product, and places of a score.
FIXED, DIGITS = 512, 6
#: Distinct tokens whose projections a task keeps.
MOST_TOKENS = 150_000


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[int, list[list[bytes]]]]:
    """(label, all windows) of the documents to learn from: ids with a crc32 remainder other than 1 (modulo 3)."""
    known = labels.filter(crc_mod("doc_id", 3) != 1).filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("y"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = known.filter("y = 1").orderBy(*order).limit(sample).unionByName(known.filter("y = 0").orderBy(*order).limit(sample))
    # at most 2 * SAMPLE ids are broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    bags, size = [], 0
    for r in rows.select("y", "text", *[o.alias(f"o{i}") for i, o in enumerate(order)]).orderBy("o0", "o1", F.md5("text")).toLocalIterator():
        text = (r["text"] or "").encode()
        size += len(text)
        if size > sample_bytes:
            break
        w = tokens(text)
        bags.append((r["y"], [w[a : a + WINDOW] for a in window_starts(len(w))]))
    return bags


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model | None:
    """The network learnt from ``sample_of``; options are those of ``train``."""
    return train(sample_of(docs, labels, sample), **options)


class Scorer:
    """Scores texts with one model, keeping the projections of tokens it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.size = 0
        self.pf, self.pb = (np.zeros((4096, 3 * STATE), np.float32) for _ in "fb")

    def _rows(self, words: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.index) > MOST_TOKENS:
            self._clear()
        new = list({w for d in words for w in d} - self.index.keys())
        new.sort()
        self.index.update(zip(new, range(self.size, self.size + len(new)), strict=True))
        while len(self.pf) < self.size + len(new):
            self.pf, self.pb = (np.concatenate([p, np.zeros_like(p)]) for p in (self.pf, self.pb))
        for a in range(0, len(new), FIXED):
            part = new[a : a + FIXED]
            f, b = self.model.project(self.model.encode(part + [b""] * (FIXED - len(part)))[0])
            at = slice(self.size + a, self.size + a + len(part))
            self.pf[at], self.pb[at] = f[: len(part)], b[: len(part)]
        self.size += len(new)
        get = self.index.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in words]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows = self._rows([tokens(t) for t in texts])
        out = np.zeros(len(texts))
        whole, whole_doc = [], []
        short = [i for i, r in enumerate(rows) if 0 < len(r) < WINDOW]
        for i, r in enumerate(rows):
            if len(r) >= WINDOW:
                starts = np.asarray(window_starts(len(r)))
                whole.append(r[starts[:, None] + np.arange(WINDOW)])
                whole_doc.append(np.full(len(starts), i))
        if whole:
            at, doc = np.concatenate(whole), np.concatenate(whole_doc)
            for a in range(0, len(at), FIXED):
                np.maximum.at(out, doc[a : a + FIXED], self._windows(at[a : a + FIXED], None))
        for a in range(0, len(short), FIXED):
            part = short[a : a + FIXED]
            mask = np.arange(WINDOW)[None, :] < np.array([len(rows[i]) for i in part])[:, None]
            at = np.zeros(mask.shape, np.int64)
            at[mask] = np.concatenate([rows[i] for i in part])
            out[part] = self._windows(at, mask)
        return np.round(out, DIGITS)

    def _windows(self, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Scores of at most FIXED windows, filled up to that number."""
        n = len(at)
        at = np.concatenate([at, np.zeros((FIXED - n, WINDOW), np.int64)])
        if mask is not None:
            mask = np.concatenate([mask, np.ones((FIXED - n, WINDOW), bool)])
        return self.model.windows(self.pf, self.pb, at, mask)[0][:n]


def with_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row."""
    sent = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent)
        scorer = Scorer(model) if model is not None else None
        for ids, texts in chunks(batches, 1 << 20):
            score = scorer.scores(texts) if scorer else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    scored = with_scores(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The input's rows and columns without documents scored ``limit`` or more."""
    sent = pickle.dumps(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent)
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            keep, texts, size = [], [], 0
            for i, t in enumerate(batch["text"]):
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1])
                if size >= 1 << 20 or i == len(batch) - 1:
                    keep += (scorer.scores(texts) < limit).tolist() if scorer else [True] * len(texts)
                    texts, size = [], 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
