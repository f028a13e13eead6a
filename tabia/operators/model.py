"""Base score by a linear model, with its exact per-feature contributions.

For a linear model with independent features the Shapley value of feature i is
``coef_i * (x_i - mean_i)``; the contributions and the mean prediction add up to
the prediction.
"""

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from tabia.operators.features import FEATURE_VECTOR
from tabia.schemas import KEY


def _value(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class LinearScorer:
    """A linear model: fitted here, or a scorecard supplied by the user."""

    coefficients: dict[str, float]
    means: dict[str, float]
    intercept: float = 0.0

    def prediction(self) -> Column:
        total = F.lit(float(self.intercept))
        for name, value in self.coefficients.items():
            total = total + _value(name) * F.lit(float(value))
        return total

    def contributions(self) -> Column:
        """ARRAY<STRUCT<feature, impact>>, largest absolute impact first.

        Equal impacts are ordered by feature name.
        """
        entries = [
            F.struct(
                (-F.abs(self._impact(name))).alias("order"),
                F.lit(name).alias("feature"),
                self._impact(name).alias("impact"),
            )
            for name in self.coefficients
        ]
        return F.transform(
            F.sort_array(F.array(*entries)),
            lambda e: F.struct(e["feature"].alias("feature"), e["impact"].alias("impact")),
        )

    def _impact(self, name: str) -> Column:
        shift = _value(name) - F.lit(float(self.means[name]))
        return shift * F.lit(float(self.coefficients[name]))


def feature_means(vectors: DataFrame, names=FEATURE_VECTOR) -> dict[str, float]:
    """Means of the features: one row, whatever the number of customers."""
    row = vectors.agg(*[F.avg(c).alias(c) for c in names]).first()
    return {c: float(row[c] or 0.0) for c in names}


def fit(vectors: DataFrame, label: str, names=FEATURE_VECTOR, reg: float = 0.0) -> LinearScorer:
    """One pass of the normal equations over the labelled vectors.

    The fitted state is one coefficient and one mean per feature.
    """
    names = list(names)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(
        vectors.where(F.col(label).isNotNull())
    )
    model = LinearRegression(
        featuresCol="features", labelCol=label, solver="normal", regParam=reg
    ).fit(assembled)
    return LinearScorer(
        dict(zip(names, map(float, model.coefficients))),
        feature_means(vectors, names),
        float(model.intercept),
    )


def explain(vectors: DataFrame, scorer: LinearScorer, keys=KEY) -> DataFrame:
    """Contributions in long form with their rank."""
    return vectors.select(
        *keys, F.posexplode(scorer.contributions()).alias("pos", "entry")
    ).select(*keys, (F.col("pos") + 1).alias("rank"), "entry.feature", "entry.impact")
