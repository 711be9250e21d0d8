"""BPE encoding and decoding by speculation and verification (see bpe.py).

Rows are independent: one scan, no shuffle, recomputed alone after a lost task.
Null text counts as empty; an empty text has no tokens and decodes to ""; repeated
rows give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_CHARS, CACHE_WORDS, Tokenizer, load
from .common import bounded, slices, tidy

#: For each tokenizer of the worker: word -> ids as text, word -> decoded text.
_words: dict[str, tuple[dict[str, str], dict[str, str]]] = {}


def learn(tok: Tokenizer, ids_of: dict[str, str], text_of: dict[str, str], lists: list[list[str]]) -> list[str]:
    """Encode and decode the words that the worker hasn't met yet; those too long to be remembered are returned."""
    if len(ids_of) > 2 * CACHE_WORDS:
        ids_of.clear()
        text_of.clear()
    new = list(set().union(*lists).difference(ids_of))
    for word, ids in zip(new, tok.merges.encode_words(new), strict=True):
        ids_of[word] = " ".join(map(str, ids))
        text_of[word] = tok.decode_words(ids)
    return [w for w in new if len(w) > CACHE_CHARS]


def numbers(lines: list[str], counts: list[int]) -> pa.Array:
    """The ids of each line as a list column."""
    flat = np.fromstring(" ".join(x for x in lines if x), np.int32, sep=" ")
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat))


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, texts: bool) -> Iterator[pa.RecordBatch]:
    tok = load(path)
    ids_of, text_of = _words.setdefault(path, ({}, {}))
    tidy()
    glue = "" if tok.byte_decoder else " "
    for batch in batches:
        for part in slices(batch, "text", 2_000_000):
            pieces = [tok.segments(t or "") for t in part.column("text").to_pylist()]
            words = [[tok.pretokens(s) if i is None else (s, i) for s, i in doc] for doc in pieces]
            long = learn(tok, ids_of, text_of, [w for doc in words for w in doc if isinstance(w, list)])
            counts, ids, decoded = [], [], []
            for doc in words:
                found, texts_found = [], []
                for w in doc:
                    found += map(ids_of.__getitem__, w) if isinstance(w, list) else [str(w[1])]
                    texts_found += map(text_of.__getitem__, w) if isinstance(w, list) else [w[0]]
                line = " ".join(filter(None, found))
                counts.append(line.count(" ") + 1 if line else 0)
                ids.append(line)
                decoded.append(glue.join(filter(None, texts_found)))
            for w in long:
                del ids_of[w], text_of[w]
            columns = [part.column("doc_id"), pa.array(counts, pa.int64())]
            columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in v], pa.string()) for v in (ids, decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                columns += [numbers(ids, counts), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, with_texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text; with_texts adds both themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_texts else ""
    rows = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: encode_batches(it, tokenizer_path, with_texts), schema)
