"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

tiktoken applies the pre-tokenisation pattern to a whole text at once.  Very long
texts are first cut where the pattern always ends a match: before a single space
that stands between two characters that are not white space.  No alternative of the
pattern holds a space anywhere but at its start, except the white-space runs, and a
run cannot reach over such a place; so the matches on both sides are those of the
whole text and memory stays bounded by the piece length.

Defined results.  Null text counts as empty; an empty text has no ids and decodes
to no bytes.  Rows are independent: repeated rows give repeated results.  Only the
two named columns are read, so other columns cannot clash with the outputs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts over this many characters are cut at safe boundaries into pieces of about so many.
PIECE_CHARS = 65_536
#: Bytes of results in one Arrow batch, about.
BATCH_BYTES = 4_000_000

SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """The tiktoken encoding of a local rank file; one per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in order, cut only at safe boundaries; a stretch without one stays whole."""
    start = 0
    while len(text) - start > piece_chars:
        found = SAFE.search(text, start + piece_chars)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def ids_of(text: str, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS, special: tuple[tuple[str, int], ...] = ()) -> bytes:
    """Ids as little-endian unsigned 32-bit integers.

    ``special``: tokens, free of blanks, whose occurrences get the given id; the texts
    between them are encoded each by itself.
    """
    encode, allowed = encoding(rank_file, pattern, special).encode_to_numpy, {token for token, _ in special}
    return b"".join(encode(piece, allowed_special=allowed, disallowed_special=()).astype("<u4", copy=False).tobytes() for piece in safe_pieces(text, piece_chars))


def bytes_of(ids: bytes, rank_file: str, pattern: str) -> bytes:
    """Raw bytes of the ids; never passed through a lossy text decoder."""
    import numpy as np

    return encoding(rank_file, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def encode_bpe(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True
) -> DataFrame:
    """One row per document: id, ids (binary, little-endian unsigned 32-bit), n_tokens,
    and with ``decode`` the decoded bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids binary, n_tokens bigint" + (", decoded binary" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, size, coded, back = 0, 0, [], []
            for i, text in enumerate(texts):
                ids = ids_of(text.as_py() or "", rank_file, pattern)
                coded.append(ids)
                size += len(ids)
                if decode:
                    back.append(bytes_of(ids, rank_file, pattern))
                    size += len(back[-1])
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    yield result(keys.slice(start, len(coded)), coded, back)
                    start, size, coded, back = i + 1, 0, [], []

    def result(keys: pa.Array, coded: list[bytes], back: list[bytes]) -> pa.RecordBatch:
        columns = [keys, pa.array(coded, pa.binary()), pa.array([len(x) // 4 for x in coded], pa.int64())]
        names = [id_col, "ids", "n_tokens"]
        if decode:
            columns, names = [*columns, pa.array(back, pa.binary())], [*names, "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
