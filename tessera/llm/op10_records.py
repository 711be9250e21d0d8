"""Token ids in length-delimited binary records with masked checksums.

A file holds, for each document, one frame:

    uint64 length | uint32 masked crc32c of the length | payload | uint32 masked crc32c of the payload

The payload is the document's ids as little-endian uint16 (uint32 for vocabularies
above 65,536). A separate offset index (Parquet: doc_id, part, path, offset, n_tokens)
serves shuffled reads. Files follow doc_id: part k holds smaller ids than part k + 1, and
frames within a part ascend; null ids come first, equal ids are ordered by text.

Written by range-partitioned tasks: a task writes its file under a name of its own
and renames it at the end, so a task that runs twice leaves one whole file.
Null text counts as empty: only the end id. An empty table gives an empty index.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ALPHABET, SPACE, load
from .common import bounded, SLICE_CHARS, block_count, shared_dir, slices

HEAD = struct.Struct("<QI")
#: Input bytes per output file.
PART_BYTES = 16 << 20
#: White-space runs from this length on don't go through the library's pattern, whose stack ends near a million.
LONG_RUN = 100_000
long_runs = regex.compile(f"[{SPACE}]{{{LONG_RUN},}}").finditer
INDEX = "doc_id long, part int, path string, offset long, n_bytes long, n_tokens long, before long"


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, dict[str, int], regex.Pattern, int]:
    """The file's byte-level model on the rank engine: ids of such files are ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in ALPHABET.items()}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("records", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    top = max([*ranks.values(), *added.values()])
    return enc, added, regex.compile("(" + "|".join(map(regex.escape, added)) + ")"), top


def encode_plain(path: str, text: str) -> list[int]:
    """Ids of a text without special strings; long white-space runs are cut out as the pattern would cut them."""
    enc = encoder(path)[0]
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in long_runs(text):
        merges = load(path).merges
        a, b = run.span()
        b -= b < len(text)  # the last one belongs to what follows
        out += enc.encode_ordinary(text[at:a])
        out += merges.exact(merges.symbols(text[a:b]))
        at = b
    return out + enc.encode_ordinary(text[at:])


def encode(path: str, text: str, end_id: int) -> np.ndarray:
    _, added, split, top = encoder(path)
    kind = np.uint16 if max(top, end_id) < 1 << 16 else np.uint32
    out = []
    for s in split.split(text) if "<|" in text else [text]:
        out.append([added[s]] if s in added else encode_plain(path, s))
    return np.array([t for x in out for t in x] + [end_id], kind)


def frames(payloads: list[bytes]) -> list[bytes]:
    from .crc import crc32c, masked

    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [n + struct.pack("<I", h) + p + struct.pack("<I", t) for n, h, p, t in zip(lengths, heads.tolist(), payloads, tails.tolist(), strict=True)]


def unframe(data: list[bytes]) -> list[bytes]:
    """Payloads of whole frames; raises on any damaged length or checksum."""
    from .crc import crc32c, masked

    payloads = [d[12:-4] for d in data]
    heads, tails = masked(crc32c([d[:8] for d in data])), masked(crc32c(payloads))
    for d, h, t, p in zip(data, heads.tolist(), tails.tolist(), payloads, strict=True):
        if HEAD.unpack_from(d) != (len(p), h) or struct.unpack("<I", d[-4:])[0] != t:
            raise ValueError("damaged record")
    return payloads


def write_part(batches: Iterator[pa.RecordBatch], uri: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    store, root = fs.FileSystem.from_uri(uri)
    name, own = f"{root}/part-{part:06d}.rec", f"{root}/.writing-{part:06d}-{uuid.uuid4().hex}"
    offset = before = 0
    out = None
    for batch in batches:
        for piece in slices(batch, "text"):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own)
            ids = [encode(path, t or "", end_id) for t in piece.column("text").to_pylist()]
            whole = frames([i.tobytes() for i in ids])
            out.write(b"".join(whole))
            sizes = np.fromiter(map(len, whole), np.int64, len(whole))
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").cast(pa.int64()), pa.array([part] * n, pa.int32()), pa.array([name] * n, pa.string()),
                    pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(counts), pa.array(before + np.cumsum(counts) - counts),
                ],
                ["doc_id", "part", "path", "offset", "n_bytes", "n_tokens", "before"],
            )
            offset, before = offset + int(sizes.sum()), before + int(counts.sum())
    if out is not None:
        out.close()
        store.move(own, name)


def write_records(docs: DataFrame, tokenizer_path: str, uri: str, end_id: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write files and offset index below uri; returns the index."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = block_count(docs, part_bytes)
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    index = ordered.mapInArrow(lambda it: write_part(it, f"{uri}/records", tokenizer_path, end_id), INDEX)
    index.write.mode("overwrite").parquet(f"{uri}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{uri}/index")


def read_batches(batches: Iterator[pa.RecordBatch], uri: str, wide: bool, with_ids: bool) -> Iterator[pa.RecordBatch]:
    store, _ = fs.FileSystem.from_uri(uri)
    opened: dict[str, pa.NativeFile] = {}
    for batch in batches:
        paths, offsets, sizes = (batch.column(c).to_pylist() for c in ("path", "offset", "n_bytes"))
        start = 0
        while start < len(paths):
            stop, held = start, 0
            while stop < len(paths) and (stop == start or held + sizes[stop] <= SLICE_CHARS):
                held += sizes[stop]
                stop += 1
            data = []
            for p, o, n in zip(paths[start:stop], offsets[start:stop], sizes[start:stop], strict=True):
                if p not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {p: store.open_input_file(p)}
                opened[p].seek(o)
                data.append(opened[p].read(n))
            ids = [np.frombuffer(p, np.uint32 if wide else np.uint16).astype("<u4") for p in unframe(data)]
            piece = batch.slice(start, stop - start)
            columns = [piece.column("doc_id"), piece.column("start"), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([i.tolist() for i in ids], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
            start = stop


def read_records(spark: SparkSession, uri: str, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Rows of the files by the offset index: doc_id, start, n_tokens, ids_crc32 and, if asked, ids."""
    index = spark.read.schema(INDEX).parquet(f"{uri}/index")
    # One row for each file; a running sum over those few rows gives each file's first position.
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select(F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    rows = index.join(bases, F.col("part") == F.col("__part")).select("doc_id", "path", "offset", "n_bytes", (F.col("base") + F.col("before")).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    wide = encoder(tokenizer_path)[3] >= 1 << 16
    placed = rows.repartition("path").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(lambda it: read_batches(it, uri, wide, with_ids), schema)


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2, uri: str | None = None) -> DataFrame:
    """Write the records, read them back and return one row for each document."""
    spark = docs.sparkSession
    uri = uri or shared_dir(spark)
    write_records(docs, tokenizer_path, uri, end_id)
    return read_records(spark, uri, tokenizer_path)
