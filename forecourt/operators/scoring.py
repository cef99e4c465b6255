"""Five-class text scoring with exchangeable scorers.

A scorer turns a text column into ``array<double>`` of five class
probabilities.  Everything after that (star, label, override) is shared.  No
pretrained weights ship with this package; ``BatchScorer`` is the place to load
some.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions import sentiment as st
from forecourt.functions.keywords import found_keywords
from forecourt.functions.text import let, model_text, word_tokens

CLASSES = 5


@dataclass(frozen=True)
class LexiconScorer:
    """Signal words decide: the more positive ones, the higher the star."""

    positive: list[str] = field(default_factory=lambda: list(lx.POSITIVE_SIGNALS))
    negative: list[str] = field(default_factory=lambda: list(lx.NEGATIVE_SIGNALS))

    def probabilities(self, text: Column) -> Column:
        def centre(found: Column) -> Column:
            pos = F.size(F.filter(found, lambda i: i < len(self.positive)))
            neg = F.size(found) - pos
            return let(
                F.struct(pos.alias("p"), neg.alias("n")),
                lambda s: F.lit(3.0) + (s["p"] - s["n"]) * 2.0 / (s["p"] + s["n"] + 1),
            )

        def logits(c: Column) -> Column:
            return F.array(*[-(F.lit(float(k)) - c) * (F.lit(float(k)) - c)
                             for k in range(1, CLASSES + 1)])

        found = found_keywords(F.lower(text), [*self.positive, *self.negative])
        return st.softmax(let(let(found, centre), logits))

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.probabilities(F.col(text)))


@dataclass(frozen=True)
class ModelScorer:
    """A fitted Spark ML pipeline with a ``probability`` column."""

    model: PipelineModel
    reg: float = 0.01

    @staticmethod
    def rows(df: DataFrame, text: str, star: str) -> DataFrame:
        """What a fit reads: the tokens and the class of every row with a star."""
        return df.where(F.col(star).between(1, CLASSES)).select(
            word_tokens(F.col(text), []).alias("_tokens"),
            (F.col(star) - 1).cast("double").alias("_label"),
        )

    @classmethod
    def train(
        cls, df: DataFrame, text: str, star: str, features: int = 1 << 16, max_iter: int = 20,
        reg: float = 0.01, tol: float = 1e-6,
    ) -> "ModelScorer":
        """Multinomial logistic regression on hashed words and star ratings 1-5.

        ``features`` is the size of the model, stated by the caller: words that meet in one
        place share a weight.  ``gradient`` tells how far a fit is from the optimum.
        """
        hashing = HashingTF(numFeatures=features, inputCol="_tokens", outputCol="_features")
        lr = LogisticRegression(
            featuresCol="_features", labelCol="_label", probabilityCol="_probability",
            family="multinomial", maxIter=max_iter, regParam=reg, tol=tol,
        )
        return cls(Pipeline(stages=[hashing, lr]).fit(cls.rows(df, text, star)), reg)

    def gradient(self, df: DataFrame, text: str, star: str) -> DataFrame:
        """(feature, star, gradient) of the regularised loss at the fitted weights, a certificate of the fit.

        The loss is convex, so weights whose gradients are all near zero are near the only optimum.
        Feature -1 is the intercept; features that no row has have neither weight nor gradient.  One
        grouped aggregation over (feature, sums): its size is the model's.
        """
        fitted = self.model.stages[-1]
        classes = range(fitted.numClasses)
        told = self.model.transform(self.rows(df, text, star)).select(
            vector_to_array("_features").alias("x"),
            F.zip_with(vector_to_array("_probability"), F.sequence(F.lit(0), F.lit(fitted.numClasses - 1)),
                       lambda p, k: p - F.when(k == F.col("_label"), 1.0).otherwise(0.0)).alias("off"))
        present = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("feature"), v.alias("v"))), lambda s: s["v"] > 0)
        every = F.concat(F.array(F.struct(F.lit(-1).alias("feature"), F.lit(1.0).alias("v"))), present)
        long = told.select("off", F.explode(every).alias("s")).select("off", "s.*")
        n = told.agg(F.count("*")).scalar()
        sums = long.groupBy("feature").agg(
            F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"),
            *(F.sum(F.col("v") * F.col("off")[k]).alias(f"g{k}") for k in classes))
        weights = fitted.coefficientMatrix.toArray()
        known = pd.DataFrame({"feature": range(-1, weights.shape[1]), **{
            f"w{k}": [0.0, *weights[k].tolist()] for k in classes}})
        known = df.sparkSession.createDataFrame(known).withColumn("feature", F.col("feature").cast("int"))
        # The penalty is on weights of features scaled to unit deviation.
        variance = (F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1)
        both = sums.join(known, "feature").withColumn("gradients", F.array(*(F.struct(
            F.lit(k + 1).alias("star"), (F.col(f"g{k}") / n + self.reg * variance * F.col(f"w{k}")).alias("gradient"))
            for k in classes)))
        return both.select("feature", F.explode("gradients").alias("s")).select("feature", "s.*")

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        tokens = df.withColumn("_tokens", word_tokens(F.col(text), []))
        scored = self.model.transform(tokens)
        p = F.concat(vector_to_array("_probability"), F.array_repeat(F.lit(0.0), CLASSES))
        return scored.withColumn(out, F.slice(p, 1, CLASSES)).drop(
            "_tokens", "_features", "rawPrediction", "_probability", "prediction"
        )


@dataclass(frozen=True)
class BatchScorer:
    """User weights: ``load()`` runs once per task and returns a batch function.

    The function takes a list of cleaned texts and returns an ``(n, 5)`` array.
    """

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    batch_size: int = 64

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, size = self.load, self.batch_size

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            predict = load()
            for texts in batches:
                values = texts.tolist()
                rows: list[np.ndarray] = []
                for i in range(0, len(values), size):
                    rows.extend(np.asarray(predict(values[i:i + size]), dtype=float))
                yield pd.Series(rows, dtype=object)

        return df.withColumn(out, run(F.col(text)))


def predict(
    df: DataFrame,
    text: str = "text",
    scorer=None,
    overrides: list[str] | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Add sentiment, confidence, bert_star and the three probabilities.

    The scorer reads the cleaned text, the override the untouched one.
    ``max_chars`` is for scorers with a limited input window.
    """
    scorer = LexiconScorer() if scorer is None else scorer
    cleaned = df.withColumn("_model_text", model_text(F.col(text), max_chars))
    scored = scorer.score(cleaned, "_model_text", "_p")
    result = let(
        st.result(F.col("_p")), lambda r: st.apply_override(F.col(text), r, overrides)
    )
    return (
        scored.withColumn("_r", result)
        .withColumns({
            "sentiment": F.col("_r.sentiment"),
            "confidence": F.col("_r.confidence"),
            "bert_star": F.col("_r.star"),
            "prob_positive": F.col("_r.prob_positive"),
            "prob_neutral": F.col("_r.prob_neutral"),
            "prob_negative": F.col("_r.prob_negative"),
        })
        .drop("_model_text", "_p", "_r")
    )
