"""Token counts: pieces counted once per distinct pre-token, joined to the
pre-token frequencies of each document and summed. Pieces are counted from the greedy proposals; lists of
ids are made for words whose proposal fails only, and dropped at once.

The join is local to a worker: its dictionary of pre-tokens meets the documents where they are, so nothing is
shuffled, and a pre-token is counted once for each worker that meets it. (A shuffled join that counts it
once in all moves a row for every different word of every document; the README has figures.) The dictionary is bounded
in words and characters and starts afresh when full.

Null text counts as empty with 0 tokens; repeated rows give repeated rows; a very long text is a slice of its own;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_CHARS, CACHE_WORDS, load
from .common import bounded, slices, tidy

_pieces: dict[str, dict[str, int]] = {}


def count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    tidy()
    tok = load(path)
    pieces = _pieces.setdefault(path, {})
    for batch in batches:
        for part in slices(batch, "text"):
            sizes, frequencies, special = [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                freq: Counter[str] = Counter()
                extra = 0
                for s, i in tok.segments(text):
                    if i is None:
                        freq.update(tok.pretokens(s))
                    else:
                        extra += 1
                frequencies.append(freq)
                special.append(extra)
            if len(pieces) > 4 * CACHE_WORDS:
                pieces.clear()
            new = list(set().union(*frequencies).difference(pieces))
            pieces.update(zip(new, tok.merges.count_words(new), strict=True))
            totals = [e + sum(n * pieces[w] for w, n in f.items()) for e, f in zip(special, frequencies, strict=True)]
            for w in new:
                if len(w) > CACHE_CHARS:
                    del pieces[w]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: count_batches(it, tokenizer_path, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
