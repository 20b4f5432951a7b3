"""Mixing to target weights with soft memberships.

A classifier fitted on a labelled table gives each document a posterior over domains. Rates x, one for each document and
none negative, are fitted so that the expected tokens of each domain, A x with A[d, i] = posterior of d times tokens of i,
meet the targets: projected-gradient least squares over documents, from x = 1. A step is one distributed sum of A x over
all documents, a small vector g back to them, and max(0, x - posterior . g) in each. With documents weighted by their
tokens, the gradient is g = W (A x - b), W being the weight of the misfits. That is the inverse of G, the sum of tokens
times posterior times its transpose over the documents whose rate isn't zero, so a step meets the targets at once where no
rate falls to zero. Where such a step makes the misfit grow it is taken back, and plain steps of a size that can't
overshoot follow. Tokens are those of a public byte-level vocabulary, as its library counts them.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, slices, small_batches, staged, text_column
from lattica.plans.cut import discard

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hashes of their ids.
LABELLED = 20_000
#: Places of hashed tokens and pairs of tokens, a power of two; steps of the fit, and the misfit at which it ends.
BUCKETS, STEPS, TOLERANCE = 1 << 16, 60, 1e-3
# Domains of the labelled table.
DOMAINS = ("good", "poor", "toxic")


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain's number of a labelled row; null if a label is missing."""
    return F.when(toxic == 1, F.lit(2)).when(quality == 1, F.lit(0)).when((quality == 0) & (toxic == 0), F.lit(1)).cast("int")


_loaded: dict[tuple[str, str], tiktoken.Encoding] = {}


def tokens_of(texts: pa.Array, vocabulary: tuple[str, str]) -> list[np.ndarray]:
    """The token ids of each text, by the ranks in a file and a pattern; strings of special tokens are ordinary text."""
    if vocabulary not in _loaded:
        with open(vocabulary[0], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The library looks for special tokens first; without any it stops at every place of a text. This one is never allowed.
        _loaded[vocabulary] = tiktoken.Encoding("mixing", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={"\0none\0": max(ranks.values()) + 1})
    encode = _loaded[vocabulary].encode_to_numpy
    return [np.asarray(encode(t, disallowed_special=()), np.int64) for t in texts.to_pylist()]


def _distinct(ids: np.ndarray) -> int:
    """How many different ids there are; small ones are sorted by their digits."""
    if not len(ids):
        return 0
    x = np.sort(ids.astype(np.uint16) if int(ids.max()) < 1 << 16 else ids, kind="stable")
    return 1 + int(np.count_nonzero(x[1:] != x[:-1]))


def style(texts: pa.Array, ids: list[np.ndarray]) -> np.ndarray:
    """Of each text: shares of non-letters, digits, upper case and repeated tokens, and the logarithm of its length."""
    out = []
    for t, x in zip(texts.to_pylist(), ids, strict=True):
        b = np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) if t else np.zeros(256)
        n = max(1, int(b.sum()))
        letters = b[65:91].sum() + b[97:123].sum() + b[128:].sum() + b[32] + b[10]
        out.append((1 - letters / n, b[48:58].sum() / n, b[65:91].sum() / n, 1 - _distinct(x) / max(1, len(x)), np.log1p(len(x)) / 10))
    return np.array(out, float).reshape(-1, 5)


def _places(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens and pairs of neighbours, text by text, and how many each text has."""
    parts, count = [], np.zeros(len(ids), np.int64)
    for i, x in enumerate(ids):
        if len(x):
            pairs = x[:-1] * 0x9E3779B1 + x[1:] * 0x85EBCA6B + 1
            parts += [x * 0xC2B2AE35 >> 7 & BUCKETS - 1, (pairs ^ pairs >> 15) >> 3 & BUCKETS - 1]
            count[i] = 2 * len(x) - 1
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), count


@dataclass
class Classifier:
    """Softmax regression on evidence of tokens (mean and greatest log-likelihoods by domain) and style."""

    vocabulary: tuple[str, str]
    words: np.ndarray  # (buckets, domains): log-likelihoods less their mean over domains
    weights: np.ndarray  # (features, domains)
    centre: np.ndarray
    spread: np.ndarray

    def raw(self, texts: pa.Array, ids: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Features, and the number of tokens; ids are the texts' tokens, if they are known."""
        ids = tokens_of(texts, self.vocabulary) if ids is None else ids
        at, count = _places(ids)
        odds = self.words.take(at, axis=0)
        some = count > 0
        first = np.cumsum(count) - count
        mean, peak = np.zeros((2, len(ids), odds.shape[1]))
        if some.any():
            mean[some] = np.add.reduceat(odds, first[some]) / count[some, None]
            peak[some] = np.maximum.reduceat(odds, first[some])
        return np.concatenate([mean, peak, style(texts, ids)], 1), np.array([len(x) for x in ids], np.int64)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, n = self.raw(texts)
        z = np.c_[(x - self.centre) / self.spread, np.ones(len(x))] @ self.weights
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), n


def fit_classifier(docs: DataFrame, labels: DataFrame, vocabulary: tuple[str, str], domains: int = len(DOMAINS), labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fitted on at most `labelled` rows of labels (id, domain), null ones left out; without any, posteriors are even.

    Of an id with several labels the smallest domain counts. The labelled documents' tokens are worked out once and written
    with them. Token counts are summed by task and bucket, a table of fixed size; the features of the labelled documents, as
    many rows as the bound says, go to the driver.
    """
    known = labels.select(F.col("id").cast("long").alias("__id"), F.col("domain").alias("__d")).where("__id IS NOT NULL AND __d IS NOT NULL")
    chosen = known.groupBy("__id").agg(F.min("__d").alias("__d")).orderBy(F.xxhash64("__id"), "__id").limit(labelled)
    found = staged(docs.select(F.col(id_col).cast("long").alias("__id"), text_column(text_col).alias("__text")).join(F.broadcast(staged(chosen)), "__id").select("__d", "__text"))

    def tokenise(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = pa.array([x.astype("<u4").tobytes() for x in tokens_of(batch.column("__text"), vocabulary)], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, "__ids"])

    def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("__ids").to_pylist()]

    rows = staged(map_batches(found, tokenise, "__d int, __text string, __ids binary"))
    discard(found)
    empty = Classifier(vocabulary, np.zeros((BUCKETS, domains)), np.zeros((2 * domains + 6, domains)), np.zeros(2 * domains + 5), np.ones(2 * domains + 5))

    def count(batches):
        total = np.zeros(domains * BUCKETS, np.int64)
        for batch in slices(batches):
            at, n = _places(unpacked(batch))
            total += np.bincount(np.repeat(batch.column("__d").to_numpy(), n) * BUCKETS + at, minlength=len(total))
        d, b = np.nonzero(total.reshape(domains, BUCKETS))
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(b, pa.int32()), pa.array(total[d * BUCKETS + b])], names=["d", "b", "n"])

    counted = rows.select("__d", "__ids").mapInArrow(count, "d int, b int, n long").groupBy("d", "b").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return empty
    total = np.full((BUCKETS, domains), 0.1)
    for r in counted:
        total[r.b, r.d] += r.n
    words = np.log(total / total.sum(0))
    empty.words = words - words.mean(1, keepdims=True)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, _ = empty.raw(batch.column("__text"), unpacked(batch))
        return pa.RecordBatch.from_arrays([batch.column("__d"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["d", "x"])

    table = sorted((r.d, tuple(r.x)) for r in map_batches(rows, features, "d int, x array<double>").collect())
    discard(rows)
    y, x = np.array([d for d, _ in table]), np.array([f for _, f in table])
    empty.centre, empty.spread = x.mean(0), x.std(0) + 1e-6
    x = np.c_[(x - empty.centre) / empty.spread, np.ones(len(x))]
    hot = np.eye(domains)[y]
    w = np.zeros((x.shape[1], domains))
    gram = np.linalg.inv(x.T @ x / len(x) / 2 + 1e-2 * np.eye(x.shape[1]))
    for _ in range(150):  # steps under a fixed bound of the curvature: they never overshoot
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        w -= gram @ (x.T @ (p / p.sum(1, keepdims=True) - hot) / len(x) + 1e-3 * w)
    empty.weights = w
    return empty


def _rates(p: np.ndarray, steps: Sequence[Sequence[float]]) -> np.ndarray:
    """The rates of documents with the posteriors p, after the steps."""
    x = np.ones(len(p))
    for g in steps:
        x = np.maximum(0.0, x - p @ np.array(g))
    return x


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def fit_rates(rows: DataFrame, targets: Sequence[float], budget: float | None = None, whole: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[list[float]], list[float]]:
    """The steps of the fit, of each the vector g for x = max(0, x - posterior . g) from x = 1; and the misfits left.

    rows has (posterior array<double>, n_tokens long). The targets' shares are of `budget` tokens; without one, of as many
    tokens as give the first domain `whole` times its own, or as there are if that is null too. A misfit is a domain's
    expected tokens over its target, less 1 (the share of all tokens, where the target is 0). The fit ends when all are
    within the tolerance, or when steps bring them no nearer: targets can be out of reach.
    """
    d = len(targets)
    names = [*[f"s{i}" for i in range(d)], *[f"g{i}" for i in range(d * d)]]

    def sums(batches, history):
        part = np.zeros(d + d * d)
        for batch in batches:
            q, n = _matrix(batch.column("posterior"), d), batch.column("n_tokens").to_numpy()
            x = _rates(q, history)
            part[:d] += (n * x) @ q
            part[d:] += ((q * (n * (x > 0))[:, None]).T @ q).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in part], names=names)

    def after(history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """A x, and G of the documents whose rate isn't zero, over all tokens."""
        parts = rows.select("posterior", "n_tokens").mapInArrow(lambda batches: sums(batches, history), ", ".join(f"{c} double" for c in names))
        row = parts.agg(*[F.sum(c).alias(c) for c in names]).first()
        values = np.array([row[c] or 0.0 for c in names]) / total
        return values[:d], values[d:].reshape(d, d)

    total = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return [], [0.0] * d
    now, gram = after([])
    goal = np.array(targets, float) / sum(targets)
    if budget is not None:
        goal *= budget / total
    elif whole is not None and goal[0] > 0:
        goal *= whole * now[0] / goal[0]
    over = np.where(goal > 0, goal, 1.0)
    cost = lambda x: float((((x - goal) / over) ** 2).sum())
    safe = np.diag(over**-2) / max(1e-12, np.linalg.eigvalsh(gram / np.outer(over, over)).max())
    out: list[list[float]] = []
    bold = True
    for k in range(steps):
        if np.abs((now - goal) / over).max() < tolerance:
            break
        # Rounded, so that the order of distributed sums makes no difference.
        along = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) if bold else safe
        tried = [*out, [float(f"{x:.10g}") for x in along @ (now - goal)]]
        new, held = after(tried)
        if cost(new) >= cost(now) * (1 - 1e-9):
            if not bold:
                break
            bold = False
            continue
        out, now, gram, bold = tried, new, held, bold or k % 4 == 0
    return out, [float(f"{x:.6g}") for x in (now - goal) / over]


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: Sequence[float], vocabulary: tuple[str, str], budget: float | None = None, whole: float | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, n_tokens, posterior, rate, copies, misfit, *keep) for each row of docs.

    labels has (id, domain); vocabulary is a file of ranks and a pattern, by which tokens are counted. rate is the
    expected number of copies, such that the expected tokens by domain meet the targets as fit_rates says; misfit (the
    same in all rows) tells how far each domain stays from its target, which can be out of reach. copies is the rate
    rounded up or down by a hash of the id and n_tokens, so that it is kept in expectation. Null texts count as empty and
    have no tokens and the posterior of an empty text. Repeated rows get the same rate and copies. Without labels the
    posterior is even. An empty table gives no rows.

    Nothing is shuffled but sums of fixed size: token counts by bucket, and expected tokens by domain.
    """
    small_batches(docs.sparkSession)
    d = len(targets)
    model = fit_classifier(docs, labels, vocabulary, d, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("__id"), text_column(text_col).alias("__text"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(keep)])
    own = [f"__x{i}" for i in range(len(keep))]
    kinds = dict(rows.dtypes)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, n = model.posteriors(batch.column("__text"))
        return pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), d).cast(pa.list_(pa.float64())), *(batch.column(c) for c in own)], names=["__id", "n_tokens", "posterior", *own])

    scored = staged(map_batches(rows, predict, f"__id {kinds['__id']}, n_tokens long, posterior array<double>" + "".join(f", {c} {kinds[c]}" for c in own)))
    steps, misfit = fit_rates(scored, targets, budget, whole)

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _rates(_matrix(batch.column("posterior"), d), steps)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*batch.schema.names, "rate"])

    place = F.pmod(F.xxhash64(F.col("__id"), F.col("n_tokens")), F.lit(1 << 30)) / (1 << 30)
    out = map_batches(scored, rate, ", ".join(f"{c} {k}" for c, k in scored.dtypes) + ", rate double", 4096)
    return out.select(F.col("__id").alias(id_col), "n_tokens", "posterior", "rate", F.floor(F.col("rate") + place).cast("int").alias("copies"), F.array(*map(F.lit, misfit)).alias("misfit"), *[F.col(f"__x{i}").alias(c) for i, c in enumerate(keep)])
