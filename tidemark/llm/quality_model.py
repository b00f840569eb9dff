"""Operator 3, quality classifier: an additive model with pairwise interactions over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive import AdditiveModel, fit
from .common import crc_mod, labelled_texts, table
from .text_stats import ratios, with_stats

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def features(docs: DataFrame, *keep: str) -> DataFrame:
    return with_stats(docs).select(*keep, *(F.coalesce(v, F.lit(0.0)).alias(k if k not in keep else f"{k}_") for k, v in ratios().items()))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> AdditiveModel:
    """The model fitted on at most `bound` labelled documents outside the held-out fold, one row a key."""
    names = list(ratios())
    rows = features(labelled_texts(docs, labels, "quality", FOLDS, HELD_OUT, bound), "label").collect()
    x = np.array([[r[k] for k in names] for r in rows], float).reshape(-1, len(names))
    return fit(names, x, np.array([r["label"] for r in rows], float))


def classify(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: the statistics by Spark, the bins and table sums by numpy a batch.

    Only the text enters a score. A null or empty text is scored by its zero statistics; repeated rows
    each get their score; an empty table gives no row; further columns are ignored.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in model.names], 1) if batch.num_rows else np.empty((0, len(model.names)))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return features(rows, "doc_id", "held_out").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
