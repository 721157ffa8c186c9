"""Toxicity by weak supervision.

Many weak voters look at a document: lexicons, and patterns of its characters. A
generative label model takes the true class as hidden and estimates how often each voter speaks
up in either class (its accuracy), and how strongly voters repeat one another beyond what the
class explains (their correlations), by which their say is cut. The posterior of a document
comes from its votes alone, so two documents with the same votes have the same one, whatever
their labels; it is what a linear classifier is trained on, and the classifier then scores every
document. Labels draw up the lexicons, give the share of class 1 and the estimate's start, which
stays with it as a prior of the voters' rates (PRIOR_WEIGHT): without one, the hidden class wanders
off to whatever parts the votes best, such as long texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

# At most so many labelled rows train the model, those with the smallest hash of their id.
TRAINING_ROWS = 20_000
HASH_BITS = 20
PREFIXES = (4, 5)
LEXICONS = 40
SINGLE = 28
LEXICON_ENTRIES = 1500
# Twice the log-likelihood ratio at which a feature is not taken for chance.
EVIDENCE = 20.0
# A feature belongs in a lexicon if label 1 holds at least this share of its documents.
PURITY = 0.85
# The prior of the voters' rates counts as so many rows for each row voted on.
PRIOR_WEIGHT = 4.0
_LETTERS = re.compile(r"[^\W\d_]+")
# Patterns of the characters: runs of marks, shouting, masked and stretched words.
_PATTERNS = (
    re.compile(r"[!?]{2,}"),
    re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{2,}\b){2}"),
    re.compile(r"\b\w+[*#@$]+\w+\b"),
    re.compile(r"(\w)\1{3,}"),
    re.compile(r"\b(?:you|your|you're|ur)\b", re.I),
)
N_PATTERNS = len(_PATTERNS)


def features(text: str) -> np.ndarray:
    """Distinct features of a whole text: hashed words and word beginnings, in lower case, and
    the patterns it shows. The first N_PATTERNS numbers are those of the patterns."""
    words = set(_LETTERS.findall(text.lower()))
    starts = {w[:n] for n in PREFIXES for w in words if len(w) > n}
    hashed = [zlib.crc32(w.encode()) for w in words]
    hashed += [zlib.crc32(w.encode(), 1) for w in starts]
    found = np.unique(np.array(hashed, np.uint32) >> (32 - HASH_BITS)).astype(np.int32) + N_PATTERNS
    shown = [i for i, p in enumerate(_PATTERNS) if p.search(text)]
    return np.concatenate((np.array(shown, np.int32), found))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Votes:
    """Voters drawn up from counts over labelled documents: which feature belongs to which lexicon."""

    def __init__(self, df1: np.ndarray, df0: np.ndarray, n1: float, n0: float):
        """`df1`, `df0`: documents of label 1 and 0 by feature, of n1 and n0. Features that `evident` leaves out may be 0."""
        size = len(df1)
        # How surprising a feature's share of label 1 is, for those where it is nearly always 1.
        n, rate = df1 + df0, n1 / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = df1 / n
            gain = df1 * np.log(p / rate) + np.where(df0 > 0, df0 * np.log((1 - p) / (1 - rate)), 0.0)
        gain = np.where((n > 0) & (p > PURITY), 2 * gain, 0.0)
        gain[:N_PATTERNS] = 0.0
        bad = np.argsort(-gain, kind="stable")[:LEXICON_ENTRIES]
        bad = bad[gain[bad] > EVIDENCE]
        # The strongest entries are voters of their own; the others share lexicons of about equal
        # strength.
        self.voter = np.full(size, -1, np.int16)
        rest = np.arange(max(0, len(bad) - SINGLE)) * (LEXICONS - SINGLE) // max(1, len(bad) - SINGLE)
        self.voter[bad] = np.concatenate((np.arange(min(SINGLE, len(bad))), SINGLE + rest))
        self.voter[:N_PATTERNS] = LEXICONS + np.arange(N_PATTERNS)
        self.n = LEXICONS + N_PATTERNS + 1
        self.chosen = np.concatenate((np.arange(N_PATTERNS), bad))

    def of(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Documents by voters: who speaks up. The last voter does if no bad lexicon does."""
        fired = np.zeros((n, self.n), bool)
        by = self.voter[ids]
        fired[rows[by >= 0], by[by >= 0]] = True
        fired[:, -1] = ~fired[:, :LEXICONS].any(axis=1)
        return fired


def label_model(fired: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of class 1 for each row of votes, by expectation maximisation.

    `start` (0 or 1 per row) gives the share of class 1 and the rates the voters begin with. These rates
    stay as a prior worth PRIOR_WEIGHT rows a row; no row's own start enters its posterior otherwise.
    """
    f, q = fired.astype(float), start.astype(float)
    share = np.clip(q.mean(), 1e-3, 1 - 1e-3)
    worth1, worth0 = PRIOR_WEIGHT * len(f) * share, PRIOR_WEIGHT * len(f) * (1 - share)
    first1 = (f.T @ q + 0.5) / (q.sum() + 1)
    first0 = (f.T @ (1 - q) + 0.5) / ((1 - q).sum() + 1)
    for _ in range(rounds):
        rate1 = (f.T @ q + 0.5 + worth1 * first1) / (q.sum() + 1 + worth1)
        rate0 = (f.T @ (1 - q) + 0.5 + worth0 * first0) / ((1 - q).sum() + 1 + worth0)
        # Correlations within the classes, as far as the hidden class does not explain them. A voter's
        # say is divided by what it shares with the others, in squares, itself included.
        rest = f - q[:, None] * rate1 - (1 - q)[:, None] * rate0
        cov = rest.T @ rest / len(f)
        sd = np.sqrt(np.diag(cov)) + 1e-9
        corr = cov / sd / sd[:, None]
        np.fill_diagonal(corr, 1.0)
        corr[np.abs(corr) < 0.1] = 0.0
        say = 1 / (corr**2).sum(axis=0)
        yes, no = np.log(rate1 / rate0) * say, np.log((1 - rate1) / (1 - rate0)) * say
        odds = np.log(share / (1 - share)) + f @ yes + (1 - f) @ no
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q


def linear_classifier(rows, columns, n, width, target, rounds=400, l2=2e-4):
    """Weights and bias of a logistic regression on binary features with soft targets (Adam)."""
    w, b = np.zeros(width), np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        odds = b + np.bincount(rows, w[columns], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target) / n
        grad = np.append(np.bincount(columns, error[rows], minlength=width) + l2 * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def evident(counts: DataFrame, n1: float, n0: float) -> DataFrame:
    """The rows of `counts` (feature, df1, df0) that may enter a lexicon, and a few at the limit, which `Votes` judges."""
    p, rate = F.col("df1") / (F.col("df1") + F.col("df0")), n1 / (n1 + n0)
    rest = F.when(F.col("df0") > 0, F.col("df0") * F.ln((1 - p) / (1 - rate))).otherwise(0.0)
    gain = F.col("df1") * F.ln(p / rate) + rest
    return counts.filter((F.col("df1") > 0) & (p > PURITY) & (2 * gain > EVIDENCE - 0.001))


def train(table: DataFrame) -> tuple[np.ndarray, float]:
    """Weights over all features and a bias, from (doc_id, toxic, features) of documents, one row per doc_id.

    Features are counted by Spark. What reaches the driver are the counts of features that may be lexicon entries, and of
    each document the entries that it has.
    """
    size = N_PATTERNS + (1 << HASH_BITS)
    # Copies say nothing new: one document for each set of features.
    once = cut(
        table.groupBy("features").agg(F.min_by("toxic", "doc_id").alias("toxic"), F.max("doc_id").alias("last")),
        "training-sets",
    )
    n, n1 = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n0 = n - n1
    rate = (n1 + 0.5) / (n + 1)
    weights, bias = np.zeros(size, np.float32), float(np.log(rate / (1 - rate)))
    if not n1 or not n0:
        return weights, bias
    counts = once.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    counts = counts.agg(F.sum("toxic").alias("df1"), F.sum(1 - F.col("toxic")).alias("df0"))
    found = evident(counts, float(n1), float(n0)).toArrow()
    at, (df1, df0) = found.column("feature").to_numpy(), np.zeros((2, size))
    df1[at], df0[at] = found.column("df1").to_numpy(), found.column("df0").to_numpy()
    votes = Votes(df1, df0, float(n1), float(n0))
    y, rows, ids = _chosen(once, votes.chosen)
    posterior = label_model(votes.of(rows, ids, len(y)), y)
    place = np.full(size, -1)
    place[votes.chosen] = np.arange(len(votes.chosen))
    w, bias = linear_classifier(rows, place[ids], len(y), len(votes.chosen), posterior)
    weights[votes.chosen] = w
    return weights, float(bias)


def _chosen(once: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the documents, and the features among `chosen` with the places of their documents."""
    chosen = np.sort(chosen).astype(np.int32)

    def task(batches):
        for batch in batches:
            lists = batch.column(2)
            features = lists.flatten().to_numpy()
            keep = np.isin(features, chosen)
            # Where each document's end among those that are kept.
            ends = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(features[keep], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["last", "toxic", "features"])

    few = once.select("last", "toxic", "features").mapInArrow(task, "last long, toxic int, features array<int>").toArrow()
    few = few.sort_by([("last", "descending")]).combine_chunks()
    column = few.column("features").combine_chunks()
    ends = column.offsets.to_numpy()
    rows = np.repeat(np.arange(few.num_rows), np.diff(ends))
    return few.column("toxic").to_numpy().astype(float), rows, column.values.to_numpy()[ends[0] : ends[-1]]


def training_table(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, toxic, features of at most `most` labelled documents that are not held out. Of rows with one doc_id, that
    with the smallest hash of its text is taken."""
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def task(batches):
        for batch in batches:
            found = [features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "features"]
            )

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return joined.groupBy("doc_id", "toxic").agg(first).mapInArrow(task, "doc_id long, toxic int, features array<int>")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> list[tuple[int, np.ndarray]]:
    """The rows of `training_table` on the driver, by doc_id."""
    found = training_table(docs, labels, most).orderBy("doc_id").collect()
    return [(r.toxic, np.array(r.features, np.int32)) for r in found]


def _scorer(docs: DataFrame, labels: DataFrame, most: int):
    """A function that a task calls for a function from texts to scores."""
    weights, bias = train(training_table(docs, labels, most))
    used = np.flatnonzero(weights)
    values = weights[used]

    def load():
        w = np.zeros(N_PATTERNS + (1 << HASH_BITS), np.float64)
        w[used] = values
        odds = lambda t: np.clip(bias + w[features(t or "")].sum(), -30, 30)
        return lambda texts: [float(1 / (1 + np.exp(-odds(t)))) for t in texts]

    return load


def score(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`.

    `score` is between 0 and 1, higher where label 1 is likelier, and `predicted` is 1 from 0.5
    on. The whole text is looked at; null counts as empty, and empty texts are scored by the
    bias alone. Labels that are neither 0 nor 1, null ids and held-out rows are not learned
    from; if a document has two labels, 1 counts. Without labels of both classes all scores are
    the smoothed share of label 1. Repeated rows are scored each. The model has a fixed size.
    """
    scorer = _scorer(docs, labels, most)

    def task(batches):
        score_all = scorer()
        for batch in batches:
            scores = score_all(batch.column(2).to_pylist())
            out = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), out, pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        task, "doc_id long, held_out boolean, score double, predicted int"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """The rows of `docs`, with all their columns, that `score` does not predict as toxic."""
    scorer = _scorer(docs, labels, most)
    at = docs.columns.index("text")

    def task(batches):
        score_all = scorer()
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in score_all(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
