"""Language identification by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary, byte pieces included, so any text can be written with them. Each
language has its own piece probabilities, learned by expectation-maximisation; a word's probability is the sum over all
its segmentations, by a forward pass, and a text's that of its words. The vocabulary, not the data, bounds the model.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, slices, small_batches, staged, text_column

#: Documents of each language, in expectation, that a model is fitted on; and rounds of expectation-maximisation.
SAMPLE, ROUNDS = 800, 2
SMOOTHING = 0.02
UNKNOWN = "und"
#: Words, and letters of them, that a worker remembers; beyond it the memory starts anew.
MEMORY, LETTERS = 250_000, 16_000_000
#: Letters of a word up to which probabilities can't vanish in double precision but for rare scripts.
SHORT = 40
_LETTERS = re.compile(r"[^\W\d_]+")
_EVERY = 8


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Vocabulary:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length: dict[int, int] = {}
        for i in range(self.size):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                self.automaton.add_word(model.id_to_piece(i), i)
                self.length[i] = len(model.id_to_piece(i))
        self.automaton.make_automaton()
        self.lengths = np.array([self.length.get(i, 0) for i in range(self.size)])

    def arcs(self, word: str) -> tuple[int, list[list[tuple[int, tuple[int, ...]]]]]:
        """Length, and for each end the (start, pieces) that lead there; a character without a piece of its own goes by its bytes."""
        text = "▁" + word
        to: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(len(text) + 1)]
        for end, piece in self.automaton.iter(text):
            to[end + 1].append((end + 1 - self.length[piece], (piece,)))
        for i, c in enumerate(text):
            if not any(start == i for start, _ in to[i + 1]):
                to[i + 1].append((i, tuple(self.byte[b] for b in c.encode("utf-8", "replace"))))
        return len(text), to


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


@dataclass
class Model:
    path: str
    langs: list[str]  # sorted
    p: np.ndarray  # (pieces, languages): probabilities


def word_log_probabilities(voc: Vocabulary, p: np.ndarray, word: str, rows: dict[tuple[int, ...], list[float]] | None = None) -> list[float]:
    """Of each language, the logarithm of the sum over all segmentations of the word."""
    rows = {} if rows is None else rows
    n, to = voc.arcs(word)
    k = range(p.shape[1])
    sums: list[list[float]] = [[1.0] * len(k)]
    scale = [0.0] * len(k)
    for end in range(1, n + 1):
        total = [0.0] * len(k)
        for start, pieces in to[end]:
            if (q := rows.get(pieces)) is None:
                q = rows[pieces] = np.prod(p[list(pieces)], axis=0).tolist()
            total = [t + s * x for t, s, x in zip(total, sums[start], q)]
        sums.append(total)
        if end % _EVERY == 0:  # against underflow; no arc is longer than the rows that are rescaled
            near = range(max(0, end + 1 - 2 * _EVERY), end + 1)
            for j in k:
                if total[j] > 0:
                    scale[j] += math.log(total[j])
                    for i in near:
                        if sums[i] is not sums[-1]:
                            sums[i][j] /= total[j]
                    total[j] = 1.0
    return [math.log(x) + s if x > 0 else -1e9 for x, s in zip(sums[n], scale)]


def expected_pieces(voc: Vocabulary, p: list[float], word: str) -> dict[int, float]:
    """How often each piece stands in a segmentation of the word, in expectation under one language's probabilities.

    Sums forward and back are divided by running factors, one a position, so that long words can't make them vanish: f[i]
    is the true sum over the product of the factors up to i, and back[i] the true one over that of the factors after i.
    """
    n, to = voc.arcs(word)
    q = {pieces: math.prod(p[i] for i in pieces) for arcs in to for _, pieces in arcs}
    f, factor = [1.0] + [0.0] * n, [1.0] * (n + 1)
    for end in range(1, n + 1):
        total = 0.0
        for s, x in to[end]:
            y = f[s] * q[x]
            for i in range(s + 1, end):
                y /= factor[i]
            total += y
        factor[end] = total or 1.0
        f[end] = total / factor[end]
    out: dict[int, float] = {}
    if f[n] <= 0:
        return out
    back = [0.0] * n + [1.0]
    for end in range(n, 0, -1):
        for s, x in to[end]:
            y = back[end] * q[x]
            for i in range(s + 1, end + 1):
                y /= factor[i]
            back[s] += y
            share = f[s] * y
            for i in x:
                out[i] = out.get(i, 0.0) + share
    return out


def train(docs: DataFrame, path: str, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model of every non-null value of lang_col.

    Of each language about `sample` documents are used, those with the smallest hashes of their ids, of the share that
    the counts over all documents give; that bounds the work by the number of languages. Without any labelled text the
    model has no languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), text_column(text_col).alias("__text")).where(F.col("__lang").isNotNull())
    count = {r[0]: r[1] for r in rows.groupBy("__lang").count().collect()}
    langs = sorted(count)
    if not langs:
        return Model(path, [], np.zeros((vocabulary(path).size, 0)))
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / count[k])))]), F.col("__lang"))
    place = F.pmod(F.xxhash64(F.col("__id")), F.lit(1 << 30)) / (1 << 30)

    def count_words(batches):
        for batch in slices(batches):
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([w for _, w in seen]), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counted = rows.where(place < share).select("__lang", "__text").mapInArrow(count_words, "lang string, word string, n long")
    counted = staged(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition("word"))
    size = vocabulary(path).size
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):

        def expect(batches, p=p):
            voc = vocabulary(path)
            lists = {k: p[:, j].tolist() for j, k in enumerate(langs)}
            total: dict[tuple[str, int], float] = {}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    for piece, x in expected_pieces(voc, lists[lang], word).items():
                        total[lang, piece] = total.get((lang, piece), 0.0) + n * x
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total]), pa.array([i for _, i in total], pa.int32()), pa.array(list(total.values()), pa.float64())], names=["lang", "piece", "x"])

        # Rounded, so that the order of the sums does not matter.
        table = counted.mapInArrow(expect, "lang string, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).collect()
        p = np.full((size, len(langs)), SMOOTHING)
        for r in table:
            p[r.piece, langs.index(r.lang)] += round(r.x, 4)
        p /= p.sum(0)
    return Model(path, langs, p)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, *keep) for each row of docs; score is the posterior of the predicted language, prior even.

    A text that is null or has no letter gets `und` and score 0, and so does every text if the model has no languages.
    Ties go to the language that sorts first. Only the text is looked at. Nothing is shuffled; a worker holds the model
    and a bounded memory of words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"), *keep)
    kinds = dict(rows.dtypes)
    own = Scorer(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best = own.best_of(batch.column("__text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array([x for x, _ in best], pa.string()), pa.array([x for _, x in best], pa.float64()), *(batch.column(c) for c in keep)],
            names=[id_col, "lang_pred", "score", *keep],
        )

    return map_batches(rows, run, f"`{id_col}` {kinds[id_col]}, lang_pred string, score double" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def many_log_probabilities(voc: Vocabulary, p: np.ndarray, words: list[str]) -> np.ndarray:
    """word_log_probabilities of many words: one pass of the automaton, then the forward sums of all words side by side."""
    text = "\0".join("▁" + w for w in words) + "\0"
    found = np.fromiter(itertools.chain.from_iterable(voc.automaton.iter(text)), np.int64).reshape(-1, 2)
    end, piece = found[:, 0] + 1, found[:, 1]
    length = voc.lengths[piece]
    lengths = np.array([len(w) + 2 for w in words])
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(text), bool)
    inside[first + lengths - 1] = False
    inside[end[length == 1] - 1] = False  # such a character has a piece of its own
    bare = np.flatnonzero(inside)
    if len(bare):
        kinds = sorted({text[i] for i in bare.tolist()})
        rows = np.stack([np.prod(p[[voc.byte[b] for b in c.encode("utf-8", "replace")]], axis=0) for c in kinds])
        at = {c: len(p) + i for i, c in enumerate(kinds)}
        p = np.concatenate([p, rows])
        end = np.concatenate([end, bare + 1])
        piece = np.concatenate([piece, [at[text[i]] for i in bare.tolist()]])
        length = np.concatenate([length, np.ones(len(bare), np.int64)])
    step = end - first[np.searchsorted(first, end - 1, "right") - 1]
    order = np.lexsort((end, step))
    end, piece, start, step = end[order], piece[order], (end - length)[order], step[order]
    sums = np.zeros((len(text) + 1, p.shape[1]))
    sums[first] = 1.0
    cuts = np.flatnonzero(np.diff(step, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(step)], strict=True):
        e = end[a:b]
        heads = np.flatnonzero(np.diff(e, prepend=-1))
        sums[e[heads]] = np.add.reduceat(sums[start[a:b]] * p[piece[a:b]], heads)
    with np.errstate(divide="ignore"):
        return np.log(sums[first + lengths - 1])


class Scorer:
    """A model and the memory of the words seen; only the model travels."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.letters = model, {}, 0

    def __getstate__(self) -> Model:
        return self.model

    def __setstate__(self, model: Model) -> None:
        self.__init__(model)

    def _learn(self, words: set[str]) -> None:
        if not self.known:
            self.voc, self.table = vocabulary(self.model.path), np.zeros((1 << 14, len(self.model.langs)))
        self.letters += sum(map(len, words))
        at = len(self.known)
        while at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        short = [w for w in words if len(w) <= SHORT]
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            rows = many_log_probabilities(self.voc, self.model.p, part)
            for j in np.flatnonzero(~np.isfinite(rows).all(1)).tolist():
                rows[j] = word_log_probabilities(self.voc, self.model.p, part[j])
            self.table[at + i : at + i + len(part)] = rows
        self.known.update(zip(short, range(at, at + len(short))))
        for w in words:
            if len(w) > SHORT:
                self.table[len(self.known)] = word_log_probabilities(self.voc, self.model.p, w)
                self.known[w] = len(self.known)

    def best_of(self, texts: list[str | None]) -> list[tuple[str, float]]:
        lists = [words_of(t) if t else [] for t in texts]
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.known) > MEMORY or self.letters > LETTERS:
            self.known, self.letters = {}, 0
        if new := set().union(*lists).difference(self.known):
            self._learn(new)
        out, known = [], self.known
        for words in lists:
            if not any(c.isalpha() for w in words for c in w):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.table[[known[w] for w in words]].sum(0)
            top = int(total.argmax())
            out.append((self.model.langs[top], float(1 / np.exp(np.minimum(0, total - total[top])).sum())))
        return out
