"""Blocks of documents, and messages between blocks and buckets.

Documents are dealt into blocks (by a hash of the row) that one Python call holds. A block sends
buckets one packed message each; a bucket answers every message with one answer whose entries stand in the
order of the message's. The blocks' shuffle is reused by all rounds, no state is kept, and a lost
executor costs the recomputation of its partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, text_bytes, tidy

#: Bytes of text in a block, and partitions beyond which a task works through several blocks one after another.
BLOCK_BYTES, MOST_PARTITIONS = 4 << 20, 20_000
#: Added to the documents; a name that their own columns won't have.
BLOCK = "__block"
MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("round", pa.int32()), ("payload", pa.binary())])


def planes(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Low bytes of number columns, plane by plane: sorted columns then compress."""
    n = len(columns[0][0])
    parts = [np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :w].T for c, w in columns]
    return np.ascontiguousarray(np.concatenate(parts)).tobytes() if n else b""


def unplanes(data: bytes, widths: list[int]) -> list[np.ndarray]:
    flat = np.frombuffer(data, np.uint8).reshape(sum(widths), -1)
    out, at = [], 0
    for w in widths:
        full = np.zeros((flat.shape[1], 8), np.uint8)
        full[:, :w] = flat[at : at + w].T
        out.append(full.reshape(-1).view("<u8").astype(np.uint64))
        at += w
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted column, the first from zero."""
    return np.diff(x, prepend=np.uint64(0))


def low(x: np.ndarray, width: int) -> np.ndarray:
    return x & np.uint64((1 << 8 * width) - 1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: buckets are ranges of hashes, so sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def name_in_bucket(hashes: np.ndarray, where: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits that tell the hashes of one bucket apart, in their order."""
    base = -(-(where << 32) // buckets)  # the least upper half of a hash in the bucket
    return (hashes - (base.astype(np.uint64) << np.uint64(32))) >> np.uint64(max(0, 32 - (buckets.bit_length() - 1)))


def cut(where: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of a sorted column: (value, stretch)."""
    edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(where[a]), slice(a, b)


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    tidy()
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def texts_of(rows: pa.Table) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]


def answers_of(answers: pa.Table, number: int) -> dict[int, bytes]:
    """A block's answers of a round, by bucket."""
    return {b: p for b, r, p in zip(*(answers.column(c).to_pylist() for c in ("bucket", "round", "payload")), strict=True) if r == number}


class Deal:
    """Documents dealt into n blocks, and the rounds of messages over them. The frame has the columns that the calls use."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        self.n = max(1, math.ceil(text_bytes(docs) / block_bytes))
        self.partitions = min(self.n, MOST_PARTITIONS)
        dealt = bounded(docs).withColumn(BLOCK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n)).cast("int"))
        self.blocks = dealt.repartition(self.partitions, BLOCK).groupBy(BLOCK)

    def send(self, call: Callable[[pa.Table], pa.Table], schema: pa.Schema = MESSAGE) -> DataFrame:
        return self.blocks.applyInArrow(call, ddl(schema))

    def answer(self, messages: DataFrame, call: Callable[[pa.Table], pa.Table], schema: pa.Schema = ANSWER) -> DataFrame:
        return messages.repartition(self.partitions, "bucket").groupBy("bucket").applyInArrow(call, ddl(schema))

    def told(self, answers: DataFrame, call: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """call(a block's rows, the answers to it) of every block."""
        return self.blocks.cogroup(answers.withColumnRenamed("block", BLOCK).repartition(self.partitions, BLOCK).groupBy(BLOCK)).applyInArrow(call, schema)
