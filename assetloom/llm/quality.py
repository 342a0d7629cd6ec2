"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each whole text gives a vector of counts and ratios, transformed towards normal shape (logarithms
of counts, logits of shares). Each class has a mean and a covariance, shrunk towards its own
diagonal and towards the covariance of both classes; the inverses of the covariances' Cholesky factors
are kept, so a score is the difference of two Mahalanobis distances, by matrix products, plus a
constant. The log odds are then drawn in (tanh), and weighed by the number of words, as the statistics
of few words say little.

The fit takes at most ``sample`` labelled documents, those of the least hash of their id, so what
is broadcast and what reaches the driver is bounded by that.

Defined results: a null or empty text has the statistics of a text without words and gets a score
like any other; scores are between 0 and 1. An id with labels of both classes is left out of the fit;
of documents with one id the one of the least statistics counts. With fewer than two documents of
either class nothing can be told apart, and every text scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import crc_mod, release, table

SAMPLE, THRESHOLD = 20_000, 0.3
#: Shrinkage towards the joint covariance, then towards the own diagonal.
TO_JOINT, TO_DIAGONAL = 0.1, 0.1
#: Bound of a text's log odds, and the number of words that give half of it.
EVIDENCE, FEW_WORDS = 12.0, 10.0
STATS = ["log_chars", "log_words", "word_length", "upper", "digit", "symbol", "pipe", "stop", "space", "distinct_words", "repeated_neighbours", "distinct_lines", "top_word", "letters_in_words", "sentence_ends", "plain_word_ends"]
_KINDS = np.zeros((256, 8), np.int64)
_KINDS[ord("A") : ord("Z") + 1, 0] = 1
_KINDS[ord("0") : ord("9") + 1, 1] = 1
_KINDS[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+!"], 2] = 1
_KINDS[ord("|"), 3] = 1
_KINDS[[ord(c) for c in ".,;:?"], 4] = 1
_KINDS[[9, 10, 11, 12, 13, 32], 5] = 1
_KINDS[ord("a") : ord("z") + 1, 6] = 1
_KINDS[128:, 6] = 1
_KINDS[[10], 7] = 1


def _logit(share: float, n: float) -> float:
    """The logit of a share of n things, drawn in by half a thing at either end."""
    p = (share * n + 0.5) / (n + 1.0)
    return float(np.log(p / (1 - p)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATS``."""
    data = text.encode()
    n = max(len(data), 1)
    upper, digit, symbol, pipe, stop, space, lower, _ = (int(x) for x in np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS)
    words = data.split()
    m = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x]
    plain = sum(map(_ends_plain, words))
    ends = sum(w.endswith((b".", b"?", b"!")) for w in words)
    return [
        float(np.log1p(len(data))),
        float(np.log1p(m)),
        float(np.log((n - space + 1) / (m + 1))),
        _logit(upper / max(upper + lower, 1), upper + lower),
        _logit(digit / n, n),
        _logit(symbol / n, n),
        _logit(pipe / n, n),
        _logit(stop / n, n),
        _logit(space / n, n),
        float(np.log((len(counts) + 1) / (m + 1) ** 0.8)),
        _logit(again / max(m - 1, 1), max(m - 1, 1)),
        _logit(len(set(lines)) / max(len(lines), 1), max(len(lines), 1)),
        _logit(max(counts.values(), default=0) / max(m, 1), max(m, 1)),
        _logit((upper + lower) / n, n),
        _logit(ends / max(m, 1), max(m, 1)),
        _logit(plain / max(m, 1), max(m, 1)),
    ]


_PLAIN_ENDS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:?") | frozenset(range(128, 256))


def _ends_plain(word: bytes) -> bool:
    return word[-1] in _PLAIN_ENDS


@dataclass
class QualityModel:
    """Scaling, and for each class (0, 1) its mean, its covariance's Cholesky factor and its constant;
    and the log odds of class 1 before a text is seen."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray
    prior: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.spread, -8, 8)
        log_density = [c - 0.5 * np.square((z - mean) @ inverse.T).sum(axis=1) for mean, inverse, c in zip(self.means, self.inverse_factors, self.constants, strict=True)]
        # the words are the evidence: few of them move the odds less, and none without bound
        words = np.expm1(stats[:, STATS.index("log_words")])
        evidence = EVIDENCE * np.tanh((log_density[1] - log_density[0]) / EVIDENCE) * words / (words + FEW_WORDS)
        return 1 / (1 + np.exp(-evidence - self.prior))


def fit_discriminant(stats: np.ndarray, labels: np.ndarray, to_joint: float = TO_JOINT, to_diagonal: float = TO_DIAGONAL) -> QualityModel:
    if min((labels == 0).sum(), (labels == 1).sum()) < 2:
        n = len(STATS)
        return QualityModel(np.zeros(n), np.ones(n), np.zeros((2, n)), np.zeros((2, n, n)), np.zeros(2), 0.0)
    centre, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    z = np.clip((stats - centre) / spread, -8, 8)
    own = [z[labels == c] for c in (0, 1)]
    joint = sum(len(x) * np.cov(x.T, bias=True) for x in own) / len(z)
    factors, constants = [], []
    for x in own:
        cov = (1 - to_joint) * np.cov(x.T, bias=True) + to_joint * joint
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(-np.log(np.diag(lower)).sum())
    return QualityModel(centre, spread, np.array([x.mean(axis=0) for x in own]), np.array(factors), np.array(constants), float(np.log(len(own[1]) / len(own[0]))))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Learn from the rows of ``labels`` where ``learn`` (over its id column) holds."""
    known = labels.filter(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("_y")).filter("y = _y").select("i", "y", F.xxhash64("i").alias("h"))
    # of hashes spread over 64 bits, this share holds twice as many as are wanted
    few = known.filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= 2.0 * sample / max(known.count(), 1))
    chosen = few.orderBy("h", "i").limit(sample).select("i", "y")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [statistics(t.as_py() or "") for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("i").cast(pa.int64()), b.column("y"), pa.array(own, type=pa.list_(pa.float64()))], names=["i", "y", "s"])

    found = sorted(rows.mapInArrow(run, "i long, y int, s array<double>").groupBy("i").agg(F.first("y").alias("y"), F.min("s").alias("s")).collect())
    return fit_discriminant(np.array([r.s for r in found]).reshape(len(found), len(STATS)), np.array([r.y for r in found]))


def quality_score(text: Column, model: QualityModel) -> Column:
    """The probability that a text is of class 1."""

    def run(texts: pa.Array) -> pa.Array:
        release(__name__)
        stats = np.array([statistics(t.as_py() or "") for t in texts]).reshape(len(texts), len(STATS))
        return pa.array(model.scores(stats), type=pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=T.DoubleType())(text)


def op10_quality_classifier(spark, sf_dir):
    """The quality of every document, learned from labels whose id's crc32 modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
