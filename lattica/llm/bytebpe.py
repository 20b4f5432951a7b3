"""Byte-level BPE encoding and decoding in linear time.

An Aho-Corasick automaton over the vocabulary (bytes as Latin-1 characters) finds the tokens that start at each byte. The
encoder takes the longest, keeps it only if it may follow the token before it, else tries the next shorter one, and steps
back where none fits. Two tokens may stand side by side if no merge reaches over their border; that is worked out from
the two tokens' last merges alone and memoised. Positions from which no encoding goes on are marked, so each is tried
once and the whole is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lattica.llm.common import map_batches, small_batches, text_column

#: Distinct pieces whose ids a worker remembers, the most bytes of one, and pairs of tokens; beyond it a memory starts anew.
MEMORY, LONGEST, PAIRS = 400_000, 64, 1_000_000


class BytePairs(dict):
    """Maps a piece (str) to its ids, as little-endian unsigned 32-bit integers; itself the memory of those seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.parts = {rank: self._last_merge(token, rank) for token, rank in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            if len(token) == 1 or self.parts[rank]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte, and for a token that merges never make."""
        parts, ranks = [token[i : i + 1] for i in range(len(token))], self.ranks
        while len(parts) > 2:
            least, i = min([(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))])
            if least >= rank:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def may_follow(self, left: int, right: int) -> bool:
        """No merge over the border of the two comes before the merges that make them.

        Going back in time, the younger of the two tokens falls apart first; the part at the border takes its place. A
        merge over the border would have happened if its rank is below that of the token that fell apart last; of two
        equal merges the left one comes first.
        """
        a, b, before, answer = left, right, len(self.ranks) + 1, True
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < before:
                answer = False
                break
            split_a, split_b = self.parts[a], self.parts[b]
            if split_a is None and split_b is None:
                break
            if split_b is None or (split_a is not None and a > b):
                before, a = a, split_a[1]
            else:
                before, b = b + 1, split_b[0]
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[left, right] = answer
        return answer

    def encode(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        size, fits, starts = self.size, self.fits, [[] for _ in data]
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            starts[end + 1 - size[rank]].append(rank)  # shorter ones are found first
        ids: list[int] = []
        dead = bytearray(len(data) + 1)  # no encoding goes on from there
        at, left = 0, starts[0][:] if data else []  # left: tokens from here on that aren't tried yet
        while at < len(data):
            last = ids[-1] if ids else -1
            while left:
                t = left.pop()
                if not dead[at + size[t]] and (last < 0 or (f if (f := fits.get((last, t))) is not None else self.may_follow(last, t))):
                    ids.append(t)
                    at += size[t]
                    if at < len(data):
                        left = starts[at][:]
                    break
            else:
                if not ids:
                    raise ValueError("a byte is not in the vocabulary")
                dead[at] = 1
                t = ids.pop()
                at -= size[t]
                left = starts[at][: starts[at].index(t)]
        return ids

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        out = np.array(self.encode(data), "<u4").tobytes()
        if len(data) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = out
        return out

    def packed(self, text: str) -> bytes:
        """The ids of the whole text."""
        return b"".join([self[p] for p in self.pieces(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join([self.token[i] for i in np.frombuffer(packed, "<u4").tolist()])


_loaded: dict[tuple[str, str], BytePairs] = {}


def load(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path, pattern] = BytePairs(ranks, pattern)
    return _loaded[path, pattern]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids, *keep) for each row of docs.

    ids are the token ids as little-endian unsigned 32-bit integers in one binary value. A null text counts as empty and
    has no ids; each row is its own, so repeated rows and null ids come out as they went in. Nothing is shuffled; a
    worker holds the vocabulary (a fixed size), a bounded memory of pieces, and one batch.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(id_col, text_column(text_col).alias("__text"), *keep)
    kinds = dict(rows.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        packed = [bpe.packed(t) for t in batch.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(id_col),
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in packed]),
                pa.array(packed, pa.binary()),
                *(batch.column(c) for c in keep),
            ],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", *keep],
        )

    return map_batches(rows, run, schema)
