"""Encoders that yield tokens: weights shipped to each executor once, mapped into memory by each Python worker once, and batches predicted in place.

Tokens go through `functions.vectors.class_and_mean`, which keeps the class token and the mean of the patches.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tilewright.functions.vectors import REGISTERS, class_and_mean, in_tokens
from tilewright.sources.graymaps import located

Model = Callable[[np.ndarray], np.ndarray]


def write_weights(weights: np.ndarray, uri: str) -> str:
    """A weight matrix as a file that workers can map into memory; returns its URI."""
    system, path = located(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        np.save(out, weights)
    return uri


def patch_model(weights: np.ndarray) -> Model:
    """A stand-in for a trained model: each patch of a row times the weights is a token; the class token is their maximum, and register tokens repeat the first patch.

    Rows (batch, values) give tokens (batch, 1 + REGISTERS + patches, width), in the order of a vision transformer.
    """

    def tokens(rows: np.ndarray) -> np.ndarray:
        patches = rows.reshape(len(rows), -1, weights.shape[0]) @ weights
        return np.concatenate([patches.max(1, keepdims=True), np.repeat(patches[:, :1], REGISTERS, axis=1), patches], axis=1)

    return tokens


def token_encoder(spark: SparkSession, weights_uri: str, values: int, make_model: Callable[[np.ndarray], Model] = patch_model, batch: int = 256) -> Callable[[Column], Column]:
    """An expression from `values` numbers of a tile to its tokens, one after the other in one array.

    The file is sent to each executor once. A worker makes the model when it first meets the expression and keeps it for all its tasks.
    """
    spark.sparkContext.addFile(weights_uri)
    name = posixpath.basename(weights_uri)

    def make() -> Model:
        model = make_model(np.load(SparkFiles.get(name), mmap_mode="r"))
        return lambda rows: np.ascontiguousarray(model(rows.astype(np.float32))).reshape(len(rows), -1).astype(np.float32)

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[values]])


def token_embeddings(samples: DataFrame, encoder: Callable[[Column], Column], width: int, column: str = "pixels") -> DataFrame:
    """slide_name, x, y and embedding: the class token of `width` numbers and the mean of the patch tokens; the reduction runs in Spark."""
    tokens = samples.select("slide_name", "x", "y", encoder(F.col(column)).alias("tokens"))
    return tokens.select("slide_name", "x", "y", class_and_mean(in_tokens(F.col("tokens"), width)).cast("array<float>").alias("embedding"))
