"""Clean vectors and classes of equal vectors, shared by the embedding operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from headwind.llm.tables import keep


def packed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, dim, vec``: the components as bytes, null where a vector takes no part.

    No part take vectors that are null, empty or zero, or hold a null or a component that is not finite.
    """
    kind = "<f4" if isinstance(rows.schema[vec_col].dataType.elementType, FloatType) else "<f8"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vecs = [], []
            for row in batch.column(1):
                own = None
                if row.is_valid and len(row.values) and not row.values.null_count:
                    x = row.values.to_numpy().astype(kind)
                    if np.isfinite(x).all() and x.any():
                        own = x + np.array(0, kind)  # one zero, without a sign
                dims.append(0 if own is None else len(own))
                vecs.append(None if own is None else own.tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "dim": pa.array(dims, pa.int32()), "vec": pa.array(vecs, pa.binary())})

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(run, "vec_id long, dim int, vec binary")


def component_kind(rows: DataFrame, vec_col: str) -> str:
    return "<f4" if isinstance(rows.schema[vec_col].dataType.elementType, FloatType) else "<f8"


def classes_of(vectors: DataFrame) -> DataFrame:
    """One row per different vector: ``node`` (a number of its own), ``least`` id, ``n`` rows, ``dim``, ``vec``.

    Copies are folded on the map side first. The table is written, so the numbers never change.
    """
    found = vectors.where("vec is not null").groupBy("dim", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    return keep(found.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Packed vectors of one dimension as rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), kind)
