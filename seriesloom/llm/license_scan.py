"""License scans: fuzzy search for short notices.

A notice with up to k edits, cut into k + 1 pieces, holds at least one piece
unchanged. One Aho-Corasick automaton over all pieces of all notices finds
those exact seeds in a single pass; the regex library then checks a window of
bounded length around each seed for the whole notice with at most k edits and
gives its span. Exact base phrases are found in the same pass.

The text is lower-cased (A-Z) and reduced to its words, runs of letters, digits
and characters from U+0080 on, joined by single spaces.

Defined results: a null text is empty; equal rows are scanned each; texts of
any length are scanned whole; spans of one notice don't overlap, and a
match is drawn closer where that needs fewer edits; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exact phrases and their labels.
PHRASES = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
#: label, notice, most edits (insertions, deletions and substitutions of characters)
NOTICES = (
    ("apache", "licensed under the apache license version 2 0", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    ("cc", "this work is licensed under a creative commons attribution", 5),
    ("cc", "licensed under cc by nc 4 0", 2),
    ("gpl", "under the terms of the gnu general public license", 4),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    ("mit", "released under the mit license", 2),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("reserved", "copyright all rights reserved", 2),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, edits: int>>"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    edits: int


class Scanner:
    """Compiled once in each task."""

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        import ahocorasick
        import regex

        self.phrases = [(b" " + p + b" ", label) for p, label in phrases.items()]
        self.notices, seeds = [], {}
        for n, (label, notice, k) in enumerate(notices):
            raw = notice.encode()
            self.notices.append((label, len(raw), k, regex.compile(b"(?:%s){e<=%d}" % (regex.escape(raw), k), regex.ENHANCEMATCH)))
            at = 0
            for i in range(k + 1):
                end = at + (len(raw) - at) // (k + 1 - i)
                seeds.setdefault(raw[at:end].decode(), []).append((n, end))
                at = end
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, places)
        self.seeds.make_automaton()

    @staticmethod
    def words(text: bytes) -> tuple[int, bytes]:
        found = text.translate(_LETTERS).split()
        return len(found), b" " + b" ".join(found) + b" "

    def base(self, joined: bytes) -> list[tuple[int, str]]:
        """Start word and label of each place of a base phrase."""
        found = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                found.append((joined.count(b" ", 0, at), label))
                at = joined.find(phrase, at + 1)
        return found

    def fuzzy(self, joined: bytes) -> list[Span]:
        """Notices with at most their number of edits, left to right, not overlapping."""
        found: list[Span] = []
        done: dict[int, int] = {}  # where the last verified span of a notice ends
        tried: dict[int, tuple[int, int]] = {}
        for last, places in self.seeds.iter(joined.decode("latin-1")):
            for n, end in places:
                label, size, k, pattern = self.notices[n]
                begin = max(last + 1 - end - k, done.get(n, 0))
                window = (begin, begin + size + 2 * k)
                if begin > last or tried.get(n) == window:
                    continue
                tried[n] = window
                if m := pattern.search(joined, *window):
                    done[n] = m.end()
                    # the word that holds or follows the first character, words from 0
                    first = joined.count(b" ", 0, m.start() + 1) - 1
                    found.append(Span(label, first, first + m.group().strip().count(b" "), sum(m.fuzzy_counts)))
        return found

    def scan(self, text: bytes) -> tuple:
        n, joined = self.words(text)
        places, spans = self.base(joined), self.fuzzy(joined)
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(s.label for s in spans)})
        sizes = {label: size for label, size, *_ in self.notices}
        score = 1.0 if places else max((1.0 - s.edits / sizes[s.label] for s in spans), default=0.0)
        starts = [at for at, _ in places]
        return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, [s._asdict() for s in spans]


def scan_licenses(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """Counts, labels, score and the spans of fuzzy notices of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [scanner.scan((t.as_py() or "").encode()) for t in batch["text"]]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
