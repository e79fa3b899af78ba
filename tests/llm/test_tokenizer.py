import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")


def ids_of(texts, length=tokenizer.FRAGMENT):
    ids, counts = tokenizer.encode_array(pa.array(texts, pa.string()), length=length)
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def plain(text):
    return tokenizer.load(tokenizer.VOCABULARY)[0].encode_ordinary(text) if text else []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("ab'st \n\t　\xa0\x85 1,.!-é日ß")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_fragments_change_nothing(texts):
    assert ids_of(texts, length=1) == [plain(t) for t in texts]


def test_contractions_and_blanks():
    texts = ["!'s", "x'll", "a \n\n b", "don't", "　're", "...\n\n\n", "日'本 \n", "  lead", "trail  ", "12'd3"]
    assert ids_of(texts, length=1) == [plain(t) for t in texts]


def test_long_texts_are_cut_and_whole():
    rng = random.Random(1)
    long = "".join(rng.choice(["word ", "12:30,", "\n", "Größe", "日本", "--> "]) for _ in range(60_000))
    assert ids_of([long]) == [plain(long)]
    _, forced = tokenizer.load(tokenizer.VOCABULARY)
    data = np.frombuffer(long.encode(), np.uint8)
    cuts = np.flatnonzero(forced[data[:-1].astype(np.uint16) * 256 + data[1:]]) + 1
    parts = tokenizer.fragments(data, 0, len(data), cuts)
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert max(b - a for a, b in parts) < 2 * tokenizer.FRAGMENT
    assert ids_of(["x" * 300_000]) == [plain("x" * 300_000)]  # nowhere to cut


def test_slices_and_nulls():
    texts = pa.array(["zz", None, "", "abc", "def"], pa.string())
    ids, counts = tokenizer.encode_array(texts.slice(1, 3))
    assert counts.tolist() == [0, 0, len(plain("abc"))] and ids.tolist() == plain("abc")
    assert tokenizer.encode_array(pa.array([], pa.string()))[0].tolist() == []


def test_frames(spark):
    rows = [(1, "Hello world", "en"), (2, None, "en"), (3, "", "en"), (4, " \n ", "en"), (1, "Hello world", "en"), (None, "x", None), (5, "<|endoftext|>", "en")]
    got = tokenizer.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, plain(t)) for i, t, _ in rows)
    assert tokenizer.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
