"""Token counts, huge documents by overlapping chunks.

A text up to ``chunk_bytes`` is encoded as it is. A longer one is encoded in
overlapping chunks with offsets, and neighbours are spliced at a boundary that
both have and that is proven stable: no piece of the vocabulary contains the
two characters on its sides next to each other, so no merge can cross it and
the two sides are encoded independently of each other. If an overlap holds no
such boundary it is widened, at last to the whole text.

Edge cases: null counts as empty (0 tokens); repeated rows are counted one by
one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.batches import bounded_batches
from tallymill.session import materialize

MODEL = "piece_bpe_32k.model"
CHUNK_BYTES, OVERLAP_BYTES, LIMIT = 1 << 15, 256, 4096
_SLICE = 256


def model_path(model: str) -> str:
    """A path as it is; a bare name is looked up beside the public tokenizers."""
    if os.path.dirname(model):
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class SplicingCounter:
    """Counts tokens of one tokenizer; ``widened`` says how often an overlap was too narrow."""

    def __init__(self, model: str = MODEL, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        self.chunk, self.overlap, self.widened = chunk_bytes, overlap_bytes, 0
        special = [i for i in range(self.sp.get_piece_size()) if self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)]
        pieces = (self.sp.id_to_piece(i) for i in sorted(set(range(self.sp.get_piece_size())) - set(special)))
        self.joined = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}

    def counts(self, texts: list[str]) -> list[int]:
        out, short = [0] * len(texts), []
        for i, t in enumerate(texts):
            if len(t) * 4 <= self.chunk or len(t.encode("utf-8", "replace")) <= self.chunk:
                short.append(i)
            else:
                out[i] = self.long_count(t)
        for at in range(0, len(short), _SLICE):
            some = short[at : at + _SLICE]
            for i, ids in zip(some, self.sp.encode([texts[i] for i in some], num_threads=1), strict=True):
                out[i] = len(ids)
        return out

    def _spans(self, data: bytes, start: int, end: int) -> tuple[list[int], list[int]]:
        pieces = self.sp.encode(data[start:end].decode("utf-8"), return_type="proto").pieces
        return [start + p.begin for p in pieces], [start + p.end for p in pieces]

    def _stable(self, data: bytes, at: int) -> bool:
        """Whether no merge can cross this place between two characters."""
        lo = at - 1
        while lo > 0 and data[lo] & 0xC0 == 0x80:
            lo -= 1
        around = data[lo : at + 4].decode("utf-8", "ignore").replace(" ", "▁")
        return len(around) > 1 and (around[0], around[1]) not in self.joined

    def long_count(self, text: str) -> int:
        data = text.encode("utf-8", "replace")
        n, total, counted, start = len(data), 0, 0, 0

        def char(at: int) -> int:  # the start of the character that a byte is in
            while 0 < at < n and data[at] & 0xC0 == 0x80:
                at -= 1
            return at

        end = char(min(n, self.chunk))
        begins, ends = self._spans(data, start, end)
        while end < n:
            overlap, cut = self.overlap, None
            while cut is None:
                follow = char(max(end - overlap, counted))
                if follow <= counted:  # nothing left to widen into: lengthen the chunk itself
                    end = char(min(n, end + self.chunk + overlap))
                    begins, ends = self._spans(data, start, end)
                    if end == n:
                        break
                    continue
                far = char(min(n, follow + self.chunk + overlap))
                b2, e2 = self._spans(data, follow, far)
                common = sorted({e for e in ends if follow < e < end} & {b for b in b2 if b > follow}, key=lambda x: abs(2 * x - follow - end))
                cut = next((x for x in common if self._stable(data, x)), None)
                if cut is None:
                    self.widened += 1
                    overlap *= 2
            if cut is None:
                break
            total += sum(counted <= b < cut for b in begins)
            counted, start, end, begins, ends = cut, follow, far, b2, e2
        return total + sum(counted <= b for b in begins)


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = SplicingCounter(model, chunk_bytes, overlap_bytes)
        for texts in batches:
            yield pd.Series(counter.counts([t or "" for t in texts]), dtype="int64")

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), tokens(body).alias("n_tokens"))
    with bounded_batches(docs.sparkSession):
        return materialize(rows.withColumn("over_limit", F.col("n_tokens") > F.lit(limit)), "counted")
