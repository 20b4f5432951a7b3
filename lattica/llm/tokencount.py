"""Exact token counts of whole texts, however long, by overlapping chunks that are spliced where both agree.

A huge text is encoded in chunks that overlap. The piece offsets of two neighbours are compared in the overlap, and the
texts are spliced at the first offset where both have a border and where the border is proven stable: a blank after
another character. No piece of the vocabulary has a blank after another character (checked on loading), so no merge ever
reaches over such a border, whatever stands on either side. Where an overlap has no such offset, or its offsets can't be
told, it is widened to twice its length, up to the end of the text, and then the chunk is not cut at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lattica.llm.common import map_batches, small_batches, text_column

CHUNK, OVERLAP = 16_384, 256  # characters
BLANK = "▁"


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.stable = all(BLANK not in p.lstrip(BLANK) for p in pieces)
        #: Characters of the text that a piece covers. Of the bytes of a character, the first counts.
        self.covers = np.array([(int(p[3:5], 16) & 0xC0 != 0x80) if self.model.is_byte(i) else len(p) for i, p in enumerate(pieces)], np.int64)
        self.unknown = self.model.unk_id()

    def _borders(self, text: str, at: int) -> tuple[np.ndarray, bool]:
        """Offsets in the whole text of the ends of the pieces of a chunk that starts at offset at.

        The model writes a blank before a text; the first piece covers it too. False: offsets can't be told.
        """
        ids = np.array(self.model.encode(text, num_threads=1) if text else [], np.int64)
        ends = at + np.cumsum(self.covers[ids]) - 1
        return ends, not len(ids) or bool(ends[-1] == at + len(text) and not (ids == self.unknown).any())

    def count(self, text: str) -> int:
        if len(text) <= self.chunk + self.overlap or not self.stable:
            return len(self.model.encode(text, num_threads=1))
        total, at = 0, 0  # at: a proven border, or the start
        #: The blank at a border is the one that the model writes before a text.
        skip = 0
        while at < len(text):
            overlap, cut = self.overlap, None
            while cut is None:
                stop = at + self.chunk + overlap
                if stop >= len(text):
                    return total + len(self.model.encode(text[at + skip :], num_threads=1))
                left, sure = self._borders(text[at + skip : stop], at + skip)
                right, sure_too = self._borders(text[at + self.chunk : stop], at + self.chunk)
                for both in np.intersect1d(left, right).tolist() if sure and sure_too else ():
                    if at + self.chunk < both < stop and text[both] == " " and text[both - 1] not in (" ", BLANK):
                        cut = both
                        break
                overlap *= 2
            total += int(np.searchsorted(left, cut, "right"))
            at, skip = cut, 1
        return total


_loaded: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    A null text counts as empty, with no tokens; repeated rows and null ids come out as they went in. Nothing is
    shuffled, and a worker encodes one chunk at a time, which grows only where a text has no border to cut at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(id_col, text_column(text_col).alias("__text"))
    key = (path, chunk, overlap)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _loaded:
            _loaded[key] = Counter(*key)
        counter, texts = _loaded[key], batch.column("__text").to_pylist()
        n = [counter.count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(rows, run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean")
