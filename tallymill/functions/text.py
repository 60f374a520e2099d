"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The replacements that normalise a citation, and the terms looked for in it.
CITATION_SHORT = (("section", "sec"), ("clause", "cl"), ("regulation", "reg"), ("guideline", "guide"))
CITATION_TERMS = (("pocamla", ("pocamla",)), ("dpa", ("dpa", "data protection")), ("cbk", ("cbk",)), ("frc", ("frc",)))


def strip_all(c: Column) -> Column:
    """Without any kind of white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokenize(c: Column) -> Column:
    """Lower-cased words at white space, letters and digits only, empty ones dropped.

    All else goes from the whole text at once, which is one expression a text
    instead of one a word; only at its ends an empty word can be left.
    """
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}\s]+", "")
    return F.array_remove(F.split(kept, r"(?U)\s+"), "")


def chunk_hash(content: Column, source: Column, page: Column, version: Column) -> Column:
    return F.sha2(F.concat_ws("|", content, source, F.coalesce(page.cast("string"), F.lit("None")), version), 256)


def normalize_citation(c: Column) -> Column:
    c = strip_all(F.lower(c))
    for long, short in CITATION_SHORT:
        c = F.replace(c, F.lit(long), F.lit(short))
    return c


def key_terms(c: Column) -> Column:
    """Known regulators and acts, then sec<n> for every section number, as they stand."""
    c = F.lower(c)
    known = []
    for term, forms in CITATION_TERMS:
        hit = F.lit(False)
        for f in forms:
            hit = hit | F.contains(c, F.lit(f))
        known.append(F.when(hit, F.lit(term)))
    sections = F.transform(F.regexp_extract_all(c, F.lit(r"section\s*(\d+)"), 1), lambda s: F.concat(F.lit("sec"), s))
    return F.concat(F.array_compact(F.array(*known)), sections)


def jaccard(target: Column, other: Column) -> Column:
    """Of two arrays as sets; 0 where the target is empty."""
    union = F.size(F.array_union(target, other))
    return F.when(F.size(target) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(target, other)) / union)


def citation_similarity(target: Column, text: Column) -> Column:
    return jaccard(F.array_distinct(key_terms(target)), F.array_distinct(key_terms(text)))


def recursive_chunks(text: str, size: int = 1000, overlap: int = 200, separators=("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves; neighbours share up to ``overlap``."""
    mark = next(s for s in separators if not s or s in text)
    finer = separators[separators.index(mark) + 1 :]
    parts = text.split(mark) if mark else list(text)
    parts = [p if not i or not mark else mark + p for i, p in enumerate(parts)]
    out: list[str] = []
    run: list[str] = []

    def close():
        if joined := "".join(run).strip():
            out.append(joined)

    held = 0
    for part in (p for p in parts if p):
        if len(part) > size and finer:
            if run:
                close()
                run, held = [], 0
            out += recursive_chunks(part, size, overlap, finer)
            continue
        if held + len(part) > size and run:
            close()
            while run and (held > overlap or held + len(part) > size):
                held -= len(run.pop(0))
        run.append(part)
        held += len(part)
    close()
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, chunk_no, content; Python since the splitter carries state along a text."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([recursive_chunks(t, size, overlap) if t else [] for t in texts])

    return docs.select(F.col(key), F.posexplode(cut(F.coalesce(F.col(text), F.lit(""))))).toDF(key, "chunk_no", "content")
