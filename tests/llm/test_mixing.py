import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import mixing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")
DOCS = "doc_id bigint, source string, text string, block string, n string"
TARGETS = "source string, target_share double, max_repeats int"


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutations(size, key):
    got = mixing.permute(np.arange(size), np.full(size, size), np.full(size, key))
    assert sorted(got.tolist()) == list(range(size))


def test_permutations_differ_and_mix():
    n = 5000
    a, b = (mixing.permute(np.arange(n), np.full(n, n), np.full(n, k)) for k in (1, 2))
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.05


@pytest.mark.parametrize("seed", [0, 1, 7])
def test_shards_draw_as_from_a_multinomial(spark, seed):
    plan = [{"source": "a", "slots": 30_000, "blocks": 12_000}, {"source": "b", "slots": 10_000, "blocks": 10_000}, {"source": "c", "slots": 5, "blocks": 5}]
    rows = mixing.slot_table(plan, spark, seed).collect()
    assert Counter(r.source for r in rows) == {"a": 30_000, "b": 10_000, "c": 5}
    shards = Counter(r.shard for r in rows)
    assert sorted(shards) == list(range(10)) and all(n == mixing.SHARD_SLOTS for k, n in shards.items() if k < 9)
    assert len({(r.shard, r.position) for r in rows}) == len(rows)
    of_b = Counter(r.shard for r in rows if r.source == "b")
    assert all(abs(of_b[k] - 1024) < 5 * (4096 * 0.25 * 0.75) ** 0.5 for k in range(9)) and len(set(of_b.values())) > 3
    uses = Counter((r.repeat, r.block) for r in rows if r.source == "a")
    assert max(uses.values()) == 1 and Counter(k for k, _ in uses) == {0: 12_000, 1: 12_000, 2: 6_000}


def test_quotas():
    rows = [{"source": s, "target_share": w, "max_repeats": r, "blocks": b, "tokens": b * 10} for s, w, r, b in (("a", 0.5, 1, 100), ("b", 0.3, 2, 20), ("c", 0.2, 9, 0))]
    assert [(q["source"], q["slots"]) for q in mixing.quotas(rows)] == [("a", 67), ("b", 40)]
    assert mixing.quotas([]) == []
    assert [(q["source"], q["slots"]) for q in mixing.quotas(rows, 1200)] == [("a", 75), ("b", 40)]  # b falls short of 45
    assert [(q["source"], q["slots"]) for q in mixing.quotas(rows, 160)] == [("a", 10), ("b", 6)]


def test_a_short_block_repeated_costs_no_share():
    rows = [{"source": s, "target_share": w, "max_repeats": r, "blocks": b, "tokens": n} for s, w, r, b, n in (("a", 0.9, 1, 1000, 1_000_000), ("b", 0.1, 6, 11, 10_500))]
    got = {q["source"]: q["slots"] for q in mixing.quotas(rows)}
    assert got == {"a": 567, "b": 66}  # 63,000 tokens of b are a tenth of the 630,000


def corpus(spark):
    rows = [(i, "big", f"text number {i} " * (i % 40), "x", "x") for i in range(400)]
    rows += [(1000 + i, "small", "tiny words here " * 10, "x", "x") for i in range(40)]
    rows += [(2000, "other", "not listed " * 50, "x", "x"), (2001, None, "no source", "x", "x"), (2002, "small", None, "x", "x"), (2003, "small", "", "x", "x"), (2004, "big", "w " * 5000, "x", "x")]
    return spark.createDataFrame(rows, DOCS)


def test_mixture(spark):
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 5), ("never", 0.0, 5), ("zero", 0.2, 0), (None, 0.5, 1)], TARGETS)
    docs = corpus(spark)
    got = mixing.mixture(docs, targets, block=64, seed=3).collect()
    assert {r.source for r in got} == {"big", "small"} and all(len(r.ids) == r.n <= 64 for r in got)
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n
    total = sum(tokens.values())
    assert tokens["big"] / total == pytest.approx(2 / 3, abs=0.02)
    uses = Counter((r.source, r.block) for r in got)
    assert max(v for (s, _), v in uses.items() if s == "big") == 1 and max(uses.values()) <= 3
    blocks = {(r.source, r.block): r.ids for r in got}
    assert all(blocks[r.source, r.block] == r.ids for r in got)
    report = {r.source: r for r in mixing.share_report(docs, targets, block=64, seed=3).collect()}
    assert set(report) == {"big", "small", "absent"} and report["absent"].reached_share == 0 and report["small"].tokens == tokens["small"]
    assert report["big"].reached_share + report["small"].reached_share == pytest.approx(1)
    assert report["small"].most_repeats <= 3


@pytest.mark.parametrize("tasks", [1, 4, 32, 128])
def test_blocks_are_full_and_hold_all_tokens(spark, tasks):
    docs, targets = corpus(spark).repartition(tasks, "doc_id"), spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], TARGETS)
    rows = sorted(mixing.blocks_of(docs, targets, block=64).collect(), key=lambda r: (r.source, r.block))
    for source in ("big", "small"):
        own = [r for r in rows if r.source == source]
        assert [r.block for r in own] == list(range(len(own))) and sum(r.n < 64 for r in own) <= 1 and max(r.n for r in own) <= 64
    enc = tokenizer.load(tokenizer.VOCABULARY)[0]
    want = {r.doc_id: enc.encode_ordinary(r.text) for r in docs.where("source in ('big', 'small') and text <> ''").collect()}
    got: dict[int, list[int]] = {}
    for r in rows:
        ids, at = mixing._unpacked(r.packed).tolist(), 0
        assert sum(r.doc_tokens) == r.n == len(ids) and min(r.doc_tokens) > 0
        for d, k in zip(r.doc_ids, r.doc_tokens, strict=True):
            got.setdefault(d, []).extend(ids[at : at + k])
            at += k
    assert got == {d: ids for d, ids in want.items() if ids}


def test_a_large_batch_is_unpacked_in_parts():
    runs = [np.arange(i % 5 + 1, dtype=np.int32) + i for i in range(2500)]
    batch = pa.RecordBatch.from_pydict({"block": list(range(2500)), "packed": [mixing._packed(r) for r in runs]})
    got = list(mixing._unpack(iter([batch.slice(0, 0), batch, batch.slice(7, 3)])))
    assert max(b.num_rows for b in got) <= 1000
    rows = [r for b in got for r in b.to_pylist()]
    want = [*range(2500), 7, 8, 9]
    assert [r["block"] for r in rows] == want and [r["ids"] for r in rows] == [runs[i].tolist() for i in want]


def test_a_size_lets_capped_sources_fall_short(spark):
    docs, targets = corpus(spark), spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], TARGETS)
    rows = {r.source: r for r in mixing.share_report(docs, targets, block=64, size=2 * 64 * 60).collect()}
    assert rows["big"].tokens >= 64 * 59 and rows["small"].tokens == rows["small"].available_tokens < 64 * 60
    assert rows["small"].reached_share < 0.5 < rows["big"].reached_share and rows["small"].short_blocks <= 1


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("absent", 1.0, 1)], TARGETS)
    assert mixing.mixture(corpus(spark), targets).count() == 0
    none = spark.createDataFrame([], DOCS)
    assert mixing.mixture(none, targets).count() == 0
    assert [r.reached_share for r in mixing.share_report(none, targets).collect()] == [0.0]
    assert mixing.mixture(corpus(spark), spark.createDataFrame([], TARGETS)).count() == 0
