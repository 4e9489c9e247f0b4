"""Text embeddings: a plug-in model in Arrow batches, and feature hashing without a model."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from .phrases import chunks

Model = Callable[[list[str]], list[list[float]]]
# Bytes of text that a model gets at a time.
MODEL_BYTES = 1 << 20


def embed(docs: DataFrame, load_model: Callable[[], Model], key: str) -> DataFrame:
    """(key, embedding): ``load_model`` runs once per task and the model gets ``MODEL_BYTES`` of text at a time, or one longer text.

    A blank text has an empty vector. Bytes that are no UTF-8 reach the model as replacement characters.
    """
    schema = T.StructType([docs.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for part in chunks(batches, max_bytes=MODEL_BYTES):
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            full = [i for i, text in enumerate(texts) if text.strip()]
            vectors: list = [[]] * len(texts)
            if full:
                for i, vector in zip(full, model([texts[i] for i in full]), strict=True):
                    vectors[i] = vector
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "embedding"])

    return docs.select(key, F.make_valid_utf8("text").alias("text")).mapInArrow(run, schema)


def hashed_embeddings(docs: DataFrame, dims: int = 384) -> DataFrame:
    """(id, embedding): signed feature hashing of the words, scaled to length one; no words, no vector.

    A text's vector depends on that text alone: one pass in Arrow batches, no shuffle.
    """
    schema = T.StructType([docs.schema["id"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def place(word: str) -> tuple[int, int]:
        h = hashlib.md5(word.encode()).hexdigest()
        return int(h[:7], 16) % dims, 1 if int(h[7], 16) % 2 == 0 else -1

    def vector(words) -> list[float]:
        if len(words) == 0:
            return []
        sums = np.zeros(dims)
        for word, n in Counter(words).items():
            at, sign = place(word)
            sums[at] += sign * n
        length = np.linalg.norm(sums)
        # Words that cancel each other leave a zero vector.
        return (sums / length if length else sums).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": batch["words"].map(vector)})

    return docs.select("id", tokens(F.col("text")).alias("words")).mapInPandas(run, schema)
