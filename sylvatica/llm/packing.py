"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of 2048 and then into pieces of the powers of two in what is
left.  A piece is a sequence of its own, kept with all others of its length, so a batch of equal lengths
needs no padding and no sequence crosses documents.  The cut of a document depends on nothing but its own
length: there is no shuffle, no state between documents and no task larger than its input split.

Token ids are those of the byte-level BPE vocabulary in ``tokenizer`` (its special-token strings count as
special tokens), then the end id.  ``tiktoken`` reads the same vocabulary as ranks and gives the same ids
several times faster; a text that it refuses goes to ``tokenizers``.

Defined cases: a null text counts as empty, and an empty text is the end id alone (one piece of length 1);
a very long text is cut like any other; a null or repeated doc_id is carried through and each of its rows
is packed; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.storage import small_batches, text_or_empty

CONTEXT = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k"
PIECES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long"


def piece_lengths(tokens: int, context: int = CONTEXT) -> list[int]:
    """Whole contexts first, then the powers of two of the rest, largest first."""
    whole, rest = divmod(tokens, context)
    return [context] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def encoder(tokenizer: str = TOKENIZER) -> Callable[[str], list[int]]:
    """text -> ids, as ``tokenizers`` gives them with add_special_tokens=False."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{tokenizer}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    slow: list = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as refused:  # tiktoken's regex engine panics on some very long runs
            if isinstance(refused, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{tokenizer}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def pack(docs: DataFrame, text: str = "text", context: int = CONTEXT, end_id: int = END_ID, tokenizer: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """A row per piece: where it lies in its document, its ids, their CRC-32, its bucket (its length) and
    its place (sequence_id, offset).  ``keep_ids=False`` leaves the ids themselves out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            held = 0
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array(encode(value.as_py()) + [end_id], "<u4")
                start, identifier = 0, doc.as_py()
                for length in piece_lengths(len(ids), context):
                    piece = ids[start : start + length]
                    for out, item in zip(rows, (identifier, start, length, piece.astype(np.int32) if keep_ids else None, zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        out.append(item)
                    start += length
                held += len(ids)
                if held > 1 << 20:  # a batch of long texts goes out in parts
                    yield _rows(rows)
                    rows, held = ([], [], [], [], [], []), 0
            if rows[0]:
                yield _rows(rows)

    pieces = small_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty(text).alias("text")).mapInArrow(cut, PIECES)
    pieces = pieces if keep_ids else pieces.drop("ids")
    return pieces.withColumns({"bucket": F.col("length"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def _rows(rows: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
