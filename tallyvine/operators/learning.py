"""Labelled vectors: counts, reproducible split, accuracy, principal components."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.operators.moments import scatter_matrix
from tallyvine.operators.positions import split_at


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the number of rows and of different labels, no label counting as one."""
    missing = F.coalesce(F.max(F.col(label).isNull().cast("bigint")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), (F.countDistinct(label) + missing).alias("classes"))


def train_test_split(
    df: DataFrame, key: str, test_hundredths: int = 20, seed: int = 1234
) -> tuple[DataFrame, DataFrame]:
    """Rows in random but reproducible order of a hash of their key, split into train and test.

    The test part has ``test_hundredths`` percent of the rows, rounded up, whatever the partitioning.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    test_rows = ceil(df.count() * test_hundredths / 100)
    test, train = split_at(df.withColumn("_drawn", drawn), test_rows, ["_drawn", key])
    return train.drop("_drawn"), test.drop("_drawn")


def accuracy_by_k(lists: DataFrame, label: str = "label") -> DataFrame:
    """Rows (k, accuracy), of predictions per number of neighbours as ``knn_classify_up_to`` gives them."""
    each = lists.select(label, F.posexplode("predicted").alias("place", "predicted"))
    right = F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy")
    return each.groupBy((F.col("place") + 1).alias("k")).agg(right).orderBy("k")


def accuracy(df: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """One row: the fraction of rows whose prediction equals the label."""
    return df.agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def principal_components(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """``key`` and the first ``k`` centred principal components, ``pc1`` onwards.

    One scan for the scatter matrix, whose size depends on the vector length only, and one for the
    scores. A component's sign is free; it is set so that its largest loading is positive. A null
    or unequally long vector ends the job; without rows there is nothing to fit and no row.
    """
    found = scatter_matrix(df, vector)
    names = [f"pc{i + 1}" for i in range(k)]
    if found is None:
        return df.select(key, *[F.lit(None).cast("double").alias(name) for name in names])
    _, mean, scatter = found
    if k > len(mean):
        raise ValueError(f"{k} components of vectors of length {len(mean)}")
    loadings = np.linalg.eigh(scatter)[1][:, ::-1][:, :k]
    loadings *= np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])
    centred = F.zip_with(F.col(vector), _array(mean), lambda x, m: x.cast("double") - m)

    def score(weights: np.ndarray) -> Column:
        products = F.zip_with(centred, _array(weights), lambda x, w: x * w)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    return df.select(key, *[score(loadings[:, i]).alias(name) for i, name in enumerate(names)])


def _array(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(value)) for value in values])
