"""SHA-256 over the ordered pieces of a group, streamed: a task holds one piece of a group at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = hashlib.sha256(b"").hexdigest()


def _stream(separator: bytes, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, hasher = False, None, None
        for batch in batches:
            keys, values = [], []
            pieces = batch.column("piece")
            for i, k in enumerate(batch.column("k").to_pylist()):
                if started and k == key:
                    hasher.update(separator)
                else:
                    if started:
                        keys.append(key)
                        values.append(hasher.hexdigest())
                    started, key, hasher = True, k, hashlib.sha256()
                hasher.update(pieces[i].as_buffer())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.string())], names=["k", "sha256"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([hasher.hexdigest()])], names=["k", "sha256"])

    return run


def ordered_sha256(pieces: DataFrame, key: str, order: str, piece: str, separator: str) -> DataFrame:
    """(k, sha256): the digest of the non-null string pieces of each key in the given order, joined by ``separator``.

    A digest is sequential by nature, so the pieces of one key pass through one task, one at a time.
    """
    moved = pieces.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(piece).alias("piece"))
    ranked = moved.repartition("k").sortWithinPartitions("k", "o").select("k", "piece")
    kind, spark_kind = {"bigint": (pa.int64(), "long"), "binary": (pa.binary(), "binary")}[dict(moved.dtypes)["k"]]
    return ranked.mapInArrow(_stream(separator.encode(), kind), f"k {spark_kind}, sha256 string")
