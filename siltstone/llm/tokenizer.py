"""Encoding texts with a public byte-level BPE tokenizer.

Forced-boundary splitting: a pair of neighbouring bytes that stands inside no token of the
vocabulary can't be bridged by any merge, so the text may be cut there and the fragments encoded
independently. Cuts that could change how the pattern splits the text before the merges are not
used: behind white space, before an apostrophe and inside a character. Fragments have a bounded
length where the text has forced boundaries at all; their ids are concatenated.

Scale: one Arrow pass, no shuffle. Cuts of a whole batch are found with one vectorised look at the
byte pairs, ids stay in Arrow buffers. Each Python worker reads the vocabulary once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from siltstone.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges. A fixed value of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which on a fragment ends at the next forced boundary.
FRAGMENT = 1024
#: Last bytes of white space characters beyond ASCII; cuts behind them are not used.
_WIDE_BLANK_ENDS = [0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]


@lru_cache(4)
def load(path: str):
    """(encoding, forced): the encoder and, by first * 256 + second byte, whether a cut is certain."""
    import numpy as np
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    forced = np.ones((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            forced[b[:-1], b[1:]] = False
    forced[list(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f") + _WIDE_BLANK_ENDS] = False
    forced[:, ord("'")] = False
    forced[:, 0x80:0xC0] = False
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), forced.ravel()


def fragments(data, start: int, end: int, cuts, length: int = FRAGMENT) -> list[tuple[int, int]]:
    """[(start, end)] of the fragments of data[start:end]; cuts are the forced boundaries, ascending."""
    import numpy as np

    out = []
    while end - start > length:
        at = np.searchsorted(cuts, start + length)
        if at == len(cuts) or cuts[at] >= end:
            break
        out.append((start, int(cuts[at])))
        start = int(cuts[at])
    out.append((start, end))
    return out


def encode_array(texts, path: str = VOCABULARY, length: int = FRAGMENT):
    """(ids, counts): numpy arrays of the ids of all texts of a pyarrow string array, end to end, and
    of how many each text has. Null and empty texts have none."""
    import numpy as np
    import pyarrow as pa

    encoding, forced = load(path)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    raw = memoryview(data)
    counts, parts = np.zeros(len(texts), np.int64), []
    first, last = int(offsets[0]), int(offsets[-1])
    pairs = data[first : max(last - 1, first)].astype(np.uint16) * 256 + data[first + 1 : last] if last - first > 1 else np.zeros(0, np.uint16)
    cuts = np.flatnonzero(forced[pairs]) + first + 1
    for i in np.flatnonzero(valid & (np.diff(offsets) > 0)):
        for a, b in fragments(data, int(offsets[i]), int(offsets[i + 1]), cuts, length):
            ids = np.asarray(encoding.encode_to_numpy(bytes(raw[a:b]).decode("utf-8", "replace"), disallowed_special=()), np.int32)
            counts[i] += len(ids)
            parts.append(ids)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts


def encode(documents: DataFrame, path: str = VOCABULARY, length: int = FRAGMENT) -> DataFrame:
    """(doc_id, ids): every document's token ids, without special tokens.

    Null and empty texts have an empty list. Repeated rows come out repeated, other columns are
    ignored, an empty table gives no rows. Strings of special tokens are ordinary text.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds the memory of long texts
                part = batch.slice(at, 512)
                ids, counts = encode_array(part.column("text"), path, length)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return spread(documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")).mapInArrow(run, "doc_id bigint, ids array<int>")
