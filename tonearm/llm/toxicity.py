"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .labels import held_out, sample

FOLDS, HELD_FOLD = 5, 0
#: Bound of the labelled sample that is learned from, and of the lexicon.
SAMPLE_ROWS, LEXICON_TERMS = 12_000, 600
#: A term enters the lexicon if at least this part of the sample texts that hold it is toxic, with this log-likelihood ratio.
MIN_SHARE, MIN_EVIDENCE = 0.6, 8.0
PREFIXES = (4, 5, 6, 7)
#: Second-person words in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
NEAR = 3
#: Characters that stand for letters in disguised words.
LEET = str.maketrans("0134578@$!*#", "oleasbtasi  ")
_DISGUISE = re.compile(r"(?<=[a-z])[0134578@$!*#]+(?=[a-z])")
#: Bytes of a text in lower case that end a word: anything in ASCII but letters.
_SPACED = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))
FEATURES = (
    "hit_rate", "hits", "weight_rate", "max_weight", "distinct_hits", "prefix_rate", "second_person_rate", "near_rate",
    "capital_rate", "punctuation_rate", "exclamation_rate", "obfuscation_rate", "obfuscated_hits", "words", "digit_rate",
)
#: Byte classes: 1 capital, 2 punctuation, 3 exclamation mark, 4 digit.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[33:48], _CLASSES[58:65], _CLASSES[91:97], _CLASSES[123:127] = 2, 2, 2, 2
_CLASSES[65:91], _CLASSES[48:58], _CLASSES[33] = 1, 4, 3
_MEMORY = 300_000


def words_of(low: str) -> list[bytes]:
    """Words of a text in lower case as UTF-8: runs of letters, where anything beyond ASCII is a letter."""
    return low.encode("utf-8", "replace").translate(_SPACED).split()


def terms_of(word: str) -> list[str]:
    """The word and its longer beginnings, which stand for inflected and compound forms."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def disguises(low: str) -> list[str]:
    """Words with marks or digits between their letters, each once per place."""
    found, until = [], 0
    for m in _DISGUISE.finditer(low):
        if m.start() < until:
            continue
        start, until = m.start(), m.end()
        while start > 0 and low[start - 1].isalpha():
            start -= 1
        while until < len(low) and (low[until].isalpha() or low[until] in "0134578@$!*#" and low[until + 1 : until + 2].isalpha()):
            until += 1
        found.append(low[start:until])
    return found


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memory = lexicon, {}

    def weight(self, word: str) -> float:
        """The word's lexicon weight, negative if only a beginning of it is listed, 0 if nothing is."""
        exact = self.lexicon.get(word)
        if exact:
            return exact
        return -max((self.lexicon.get(t, 0.0) for t in terms_of(word)[1:]), default=0.0)

    def __call__(self, text: str) -> np.ndarray:
        low = text.lower()
        words = words_of(low)
        n = max(1, len(words))
        memory = self.memory
        if len(memory) > _MEMORY:
            memory.clear()
        distinct = set(words)
        for w in distinct.difference(memory):
            memory[w] = self.weight(w.decode("utf-8", "replace"))
        known = {w for w in distinct if memory[w]}
        weights = np.array([memory[w] for w in words]) if known else np.zeros(len(words))
        size = np.abs(weights)
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON] if distinct & SECOND_PERSON else []
        near = 0
        if persons and known:
            at = np.flatnonzero(size)
            where = np.searchsorted(persons, at)
            spots = np.array([-(10**9), *persons, 10**9])
            near = int(((at - spots[where] <= NEAR) | (spots[where + 1] - at <= NEAR)).sum())
        disguised = disguises(low)
        undone = sum(1 for w in disguised if self.weight(w.translate(LEET).replace(" ", "")))
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        kinds = np.bincount(_CLASSES[raw], minlength=5)
        chars = max(1, len(raw))
        return np.array([
            (size > 0).sum() / n, np.log1p((size > 0).sum()), size.sum() / n, size.max(initial=0.0), len(known), (weights < 0).sum() / n,
            len(persons) / n, near / n, kinds[1] / chars, (kinds[2] + kinds[3]) / chars, kinds[3] / chars,
            len(disguised) / n, np.log1p(undone), np.log1p(len(words)), kinds[4] / chars,
        ])


def features(text: Column | str, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Featurizer(lexicon)
        for batch in texts:
            yield pd.Series([make(t) for t in batch])

    return of(F.coalesce(text, F.lit("")))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, toxic = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = {t for w in set(words_of(text.lower())) if len(w) > 2 for t in terms_of(w.decode("utf-8", "replace"))}
            n.update(seen)
            if y:
                toxic.update(seen)
        names = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([n[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())],
            ["term", "n", "toxic"],
        )


def learn_lexicon(rows: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms of toxic texts with their smoothed log odds, at most ``terms``; ``rows`` is the bounded sample."""
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not bad or bad == n:
        return {}
    base = bad / n
    counted = rows.select("text", "y").mapInArrow(_count_terms, "term string, n bigint, toxic bigint").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")
    )
    share = F.col("toxic") / F.col("n")
    rest = F.col("n") - F.col("toxic")
    evidence = F.col("toxic") * F.log(share / base) + F.when(rest > 0, rest * F.log((1 - share) / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / (rest + 0.5)) - F.lit(float(np.log(base / (1 - base))))
    best = counted.filter("toxic > 2").filter(share >= MIN_SHARE).withColumn("evidence", evidence).filter(F.col("evidence") >= MIN_EVIDENCE)
    picked = best.orderBy(F.col("evidence").desc(), "term").limit(terms).select("term", odds.alias("w")).collect()
    return {r["term"]: float(r["w"]) for r in picked}


@dataclass
class Model:
    lexicon: dict
    trees: object
    calibration: object
    constant: float

    def score(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """``rows`` with the column ``out``; helper columns are dropped again."""
        if self.trees is None:
            return rows.withColumn(out, F.lit(self.constant))
        made = rows.withColumn("_x", array_to_vector(features(F.col(text), self.lexicon)))
        made = self.trees.transform(made).withColumn("_p", vector_to_array("_probability")[1]).drop("_x", "_raw", "_probability", "_label")
        made = self.calibration.transform(made).drop("_p")
        return made.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score")))).drop("_score")


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and trees from three quarters of the sample, the calibration from the last.

    Without labels of both kinds the score is constant: the share of toxic
    labels, 0 if there is none.
    """
    known = materialize(sample(documents, labels, "toxic", FOLDS, HELD_FOLD, rows), "toxicity-sample")
    lexicon = learn_lexicon(known.filter("part > 0"))
    parts = max(1, min(32, known.rdd.getNumPartitions()))
    table = known.select("y", "part", array_to_vector(features("text", lexicon)).alias("_x"), F.col("y").cast("double").alias("_y"))
    table = materialize(table.select("y", "part", vector_to_array("_x").alias("_x"), "_y").repartition(parts), "toxicity-features")
    table = table.withColumn("_x", array_to_vector("_x"))
    kinds = {(r["part"] > 0, r["y"]): r["count"] for r in table.groupBy("part", "y").count().collect()}
    if not all((side, y) in kinds for side in (True, False) for y in (0, 1)):
        share = known.agg(F.avg("y")).first()[0]
        return Model({}, None, None, float(share or 0.0))
    boosting = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_label", maxIter=16, maxDepth=3, stepSize=0.3, seed=17)
    trees = boosting.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(table.filter("part > 0"))
    scored = trees.transform(table.filter("part = 0")).select("_y", vector_to_array("_probability")[1].alias("_p"))
    calibration = IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol="_score").fit(scored)
    return Model(lexicon, trees, calibration, 0.0)


def scan(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5).

    Only the text enters a score.  Null and empty texts are scored like any
    text without words.  Repeated rows and null ids are kept (nothing is joined
    by id when scoring; a null id isn't held out), further columns are ignored,
    an empty table gives an empty result.
    """
    model = fit(documents, labels, rows)
    scored = model.score(documents.select("doc_id", "text"), "text", "score")
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents scored below 0.5, with all their columns."""
    model = fit(documents, labels, rows)
    packed = documents.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return model.score(packed, "_text", "_toxic").filter("_toxic < 0.5").select("_row.*")
