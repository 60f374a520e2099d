"""Licence scan: ordered signature rules behind a keyword prefilter.

An automaton finds the rules' keywords in the words of a text, and only rules
with a keyword there run. Overlapping detections are resolved by priority,
then length, then rule order: one whose words lie within those of a detection
that was kept before is suppressed. The three base phrases are found on their
own and their labels always stay.

Edge cases: a null or empty text has no words, no labels and score 0; first
and last place are null without a base phrase; repeated rows are scanned one
by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.batches import bounded_batches
from tallymill.llm.license_rules import PRIORITY_SCORE, rules
from tallymill.llm.words import normalized
from tallymill.session import materialize

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def resolve(found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """Of (priority, start, end, rule, label) those that no kept one contains.

    Kept intervals are looked up among those that start at or before a
    detection, by the furthest end so far, so dense texts stay cheap.
    """
    import bisect

    starts: list[int] = []
    reach: list[int] = []  # the furthest end of kept intervals up to that start
    kept = []
    for d in sorted(found, key=lambda d: (d[0], d[1] - d[2], d[3], d[1])):
        at = bisect.bisect_right(starts, d[1])
        if at and reach[at - 1] >= d[2]:
            continue
        kept.append(d)
        starts.insert(at, d[1])
        reach.insert(at, max(d[2], reach[at - 1] if at else d[2]))
        for i in range(at + 1, len(reach)):
            if reach[i] >= d[2]:
                break
            reach[i] = d[2]
    return sorted(kept, key=lambda d: (d[1], d[2], d[3]))


class Scanner:
    def __init__(self):
        import ahocorasick

        self.gates = ahocorasick.Automaton()
        by_keyword: dict[str, list] = {}
        for r in rules():
            by_keyword.setdefault(f" {r.keyword} ", []).append(r)
        for k, v in by_keyword.items():
            self.gates.add_word(k, v)
        self.gates.make_automaton()

    def scan(self, text: str | None) -> tuple:
        words = normalized(text).decode("utf-8", "replace")
        padded = f" {words} "
        n_words = words.count(" ") + 1 if words else 0
        places, labels = [], set()
        for phrase, label in BASE.items():
            at, passed, count = padded.find(f" {phrase} "), 0, 0
            while at >= 0:
                count += padded.count(" ", passed, at)
                passed = at
                places.append(count)
                labels.add(label)
                at = padded.find(f" {phrase} ", at + 1)
        gated = {r.order: r for _, some in self.gates.iter(padded) for r in some}
        found = [(r.priority, m.start(), m.end(), r.order, r.label) for r in (gated[k] for k in sorted(gated)) for m in r.pattern.finditer(words)]
        kept = resolve(found)
        miss = 1.0
        for label in {d[4] for d in kept}:
            miss *= 1 - PRIORITY_SCORE[min(d[0] for d in kept if d[4] == label)]
        if labels and not kept:
            miss = 1 - PRIORITY_SCORE[4]
        shown = ",".join(sorted(labels | {d[4] for d in kept}))
        detections = ";".join(f"{d[4]}@{d[1]}-{d[2]}" for d in kept)
        first, last = (min(places), max(places)) if places else (None, None)
        return n_words, len(places), first, last, ",".join(sorted(labels)), shown, 1 - miss, detections


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, base places and labels, all labels, score, and the kept detections as label@start-end (characters of the normalized text)."""

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = [x.split()[0] for x in RESULT.split(", ")]
        for texts in batches:
            out = pd.DataFrame([scanner.scan(t) for t in texts], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    with bounded_batches(docs.sparkSession):
        return materialize(docs.select(F.col(key).alias("doc_id"), scan(F.col(text)).alias("__s")).select("doc_id", "__s.*"), "scanned")
