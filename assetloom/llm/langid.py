"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams (of one to
three characters) that both have, over the geometric mean of their own numbers. N-grams are hashed
into a fixed number of cells, and all cells of the whole text count once. Nyström's method projects
the kernel on landmark texts, and ridge regression, one language against the rest, is fitted there:
scores are K(x, landmarks) @ K(landmarks)^-1/2 @ weights. A batch of texts is scored by two matrix
products: presence times landmarks, then the kernel block times the folded weights.

The model is fitted on at most ``per_language`` documents of each language, those of the least
hash of their id, so what reaches the driver is bounded by that and the number of languages. Ids of
hashes above a share of all, which follows from the language's count, are left out before the ids are
ranked, so the ranking sees a few times ``per_language`` rows of a language at any size.

Defined results: a text that is null or has no letter is ``und`` with score 0; a tie goes to the
language that sorts first; of labelled rows with one id and language one counts; without any labelled
row no language is known, and all texts are ``und`` with score 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import crc_mod, release, table

#: Cells of hashed n-grams, longest n-gram, and the sample sizes of a fit.
CELLS, LONGEST, PER_LANGUAGE, LANDMARKS, RIDGE = 1 << 14, 3, 400, 24, 1e-3
#: Ids that are ranked for each that is chosen.
SPARE = 4
#: Texts scored at once.
BLOCK = 64
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def cells(text: str) -> np.ndarray:
    """The cells of a text's n-grams, each once, ascending."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(CELLS, bool)
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(chars) < n:
            break
        h = (h[: len(chars) - n + 1] ^ (chars[n - 1 :] + np.uint32(n))) * FACTORS[n - 1]
        h ^= h >> np.uint32(15)
        seen[(h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - CELLS.bit_length() + 1)] = True
    return np.flatnonzero(seen)


def presence(texts: list[str]) -> np.ndarray:
    """A row for each text, of length 1: its cells, each by the same weight."""
    out = np.zeros((len(texts), CELLS), np.float32)
    for row, text in zip(out, texts, strict=True):
        own = cells(text)
        if len(own):
            row[own] = len(own) ** -0.5
    return out


@dataclass
class LanguageModel:
    """Languages in order; landmarks (cells x landmarks); weights (landmarks x languages); the claim (``beyond_chance``)
    below which a text is of no language, where it was fitted."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    scale: float
    least_claim: float = -math.inf

    def scores(self, texts: list[str]) -> np.ndarray:
        return (presence(texts) @ self.landmarks) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores from 0 to 1."""
        names, marks = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if self.languages else []
        for at in range(0, len(known), BLOCK):
            rows = known[at : at + BLOCK]
            s = self.scores([texts[i] for i in rows]) * self.scale
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, row in zip(rows, p.argmax(axis=1), p, strict=True):
                names[i], marks[i] = self.languages[best], float(row[best])
        return names, marks


def fit_kernel(presences: np.ndarray, langs: list[str], per_class_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fit on rows of ``presence``; the first rows of each language are its landmarks."""
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((CELLS, 0), np.float32), np.zeros((0, 0), np.float32), 1.0)
    of = np.array([languages.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(of == c)[:per_class_landmarks] for c in range(len(languages))])
    landmarks = presences[marks].T
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    keep = values > 1e-8 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = (presences @ landmarks).astype(np.float64) @ root
    targets = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # each class weighs the same, however many documents it has
    w = 1.0 / np.bincount(of)[of]
    weights = np.linalg.solve((features * w[:, None]).T @ features + ridge * np.eye(features.shape[1]), (features * w[:, None]).T @ targets)
    return LanguageModel(languages, np.ascontiguousarray(landmarks), (root @ weights).astype(np.float32), 4.0)


def _learned(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[np.ndarray, list[str]]:
    """Presences and languages of at most ``per_language`` texts of each language, those of the least hashes of
    their ids, of the rows where ``learn`` holds and language and text are known."""
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("t"))
    counts = known.groupBy("l").agg(F.count("*").alias("n"))
    # of hashes spread over 64 bits, this share holds some SPARE times as many as are wanted
    place = F.col("h").cast("double") / 2.0**64 + 0.5
    few = known.select("i", "l", "h").join(F.broadcast(counts), "l").filter(place <= SPARE * per_language / F.col("n")).select("l", "h", "i").distinct()
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).filter(F.col("k") <= per_language)
    rows = known.select("i", "l", "t").join(F.broadcast(chosen.select("i", "l", "h")), ["i", "l"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.packbits(np.bincount(cells(t.as_py()), minlength=CELLS).astype(bool)).tobytes() for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("h"), pa.array(own, type=pa.binary())], names=["l", "h", "c"])

    cells_of = rows.select("l", "h", "t").mapInArrow(run, "l string, h long, c binary").groupBy("l", "h").agg(F.min("c").alias("c"))
    found = sorted(cells_of.collect(), key=lambda r: (r.l, r.h))
    bits = np.array([np.unpackbits(np.frombuffer(r.c, np.uint8)) for r in found], np.float32).reshape(len(found), CELLS)
    return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1)), [r.l for r in found]


def fit_languages(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and language and text are known."""
    return fit_kernel(*_learned(docs, learn, id_col, text_col, lang_col, per_language))


#: Cells below which a text is too short to be told from others, and to be claimed by one language.
FEW_CELLS, CLAIM_CELLS = 8, 24
#: Share of held-out texts that limits leave out of account.
ODD = 1 / 200


def beyond_chance(presences: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """How far the ridge scores of texts lie from those of as many cells drawn by chance, in units of what chance varies
    by: the distance over all languages together (some 20 and more for texts of learned languages or alike, up to some
    5 for other scripts), and the score of the language that claims a text most (about 0 or less for a language that
    was not learned)."""
    by_cell = (model.landmarks @ model.weights).astype(np.float64)
    n = (presences > 0).sum(axis=1)
    off = (presences @ model.landmarks) @ model.weights - np.sqrt(n)[:, None] * by_cell.mean(axis=0)
    spread = np.atleast_2d(np.cov(by_cell.T, bias=True))
    # of two languages each has the other's scores with the sign changed, so the matrix may have no inverse
    distance = np.sqrt(np.maximum(((off @ np.linalg.pinv(spread, rcond=1e-6, hermitian=True)) * off).sum(axis=1), 0))
    return distance, (off / np.maximum(np.sqrt(np.diag(spread)), 1e-12)).max(axis=1)


def nearness(presences: np.ndarray, model: LanguageModel) -> np.ndarray:
    """The distance of ``beyond_chance``; less than any limit for texts that no language of the model claims; infinite
    for texts of fewer than FEW_CELLS cells. Those of fewer than CLAIM_CELLS need no claim."""
    n = (presences > 0).sum(axis=1)
    distance, claim = beyond_chance(presences, model)
    return np.where(n < FEW_CELLS, math.inf, np.where((n >= CLAIM_CELLS) & (claim < model.least_claim), -math.inf, distance))


def _limit(reached: list[float], off: float) -> float:
    """What all but a share of ODD reach, less a part ``off`` of its size."""
    if not reached:
        return -math.inf
    least = float(np.quantile(reached, ODD))
    return least - abs(least) * off


def fit_with_limit(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[LanguageModel, float]:
    """A model with its least claim, and a limit of ``nearness`` below which a text is of none of its languages: half of
    the claim and a quarter of the distance that all but 1 in 200 of the texts that are learned from reach, each half of
    them being scored by a model of the other (texts of languages that the other half lacks say nothing)."""
    presences, langs = _learned(docs, learn, id_col, text_col, lang_col, per_language)
    place = np.array([langs[:i].count(x) for i, x in enumerate(langs)]) % 2
    distances: list[float] = []
    claims: list[float] = []
    for half in (0, 1):
        part = fit_kernel(presences[place == half], [x for x, k in zip(langs, place, strict=True) if k == half])
        rest = presences[[i for i, x in enumerate(langs) if place[i] != half and x in part.languages]]
        if len(rest):
            n = (rest > 0).sum(axis=1)
            distance, claim = beyond_chance(rest, part)
            distances += distance[n >= FEW_CELLS].tolist()
            claims += claim[n >= CLAIM_CELLS].tolist()
    return replace(fit_kernel(presences, langs), least_claim=_limit(claims, 0.5)), _limit(distances, 0.75)


def language_nearness(text: Column, model: LanguageModel) -> Column:
    """The nearness of a text to the languages of a model; null if it is null or has no letter, or nothing was learned."""

    def run(texts: pa.Array) -> pa.Array:
        release(__name__)
        out: list[float | None] = []
        for at in range(0, len(texts), BLOCK):
            part = texts.slice(at, BLOCK).to_pylist()
            known = [t for t in part if t is not None and any(map(str.isalpha, t))] if model.languages else []
            scores = iter(nearness(presence(known), model).tolist() if known else ())
            out += [next(scores) if model.languages and t is not None and any(map(str.isalpha, t)) else None for t in part]
        return pa.array(out, type=pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="double")(text)


PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_language(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score)."""

    def run(texts: pa.Array) -> pa.Array:
        release(__name__)
        names: list[str] = []
        scores: list[float] = []
        for at in range(0, len(texts), BLOCK):  # so that few texts stand in memory twice
            n, s = model.predict(texts.slice(at, BLOCK).to_pylist())
            names += n
            scores += s
        return pa.StructArray.from_arrays([pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["lang", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=PREDICTED)(text)


def op7_language_id(spark, sf_dir):
    """The language of every document, learned from those whose id's crc32 modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_languages(docs, ~held_out)
    out = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), predict_language(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
