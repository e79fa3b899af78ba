"""Mixing sources to target shares of the tokens, with capped repeats.

Tokens are packed into blocks of fixed length per source; one block of a source at most is shorter. Output shards
draw their counts of each source: all slots of the mixture are shuffled by a pseudorandom permutation, which
makes each shard's counts a multinomial draw given the sources' quotas, so the quotas are met to the slot.
Every slot is mapped through a pseudorandom permutation of its source's block numbers and joined with the block
by number. Each pass over a source is another permutation, so no block, and no document, is used more
often than its source allows.

Scale: each task packs what it reads and leaves one rest shorter than a block per source; the rests alone are
moved to be packed together. Slots are made where they are used, the driver holds only totals per listed
source. The join is on unique (source, block) keys, so a source with a third of all tokens is no hot key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.tokenizer import VOCABULARY, encode_array
from siltstone.session import checked_broadcast, materialise, spread

BLOCK = 1024
SHARD_SLOTS = 4096
#: Rows that a Python pass holds unfolded at a time, however many an Arrow batch has.
ROWS = 512
#: The number of the part that holds the blocks packed from the tasks' rests; it is the last of its source.
RESTS = 2**31 - 1
_BLOCKS = "source string, part int, seq int, n int, doc_ids array<bigint>, doc_tokens array<int>, packed binary"
_NAMES = ["source", "part", "seq", "n", "doc_ids", "doc_tokens", "packed"]


def _batch(rows: list):
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _slices(batches: Iterator) -> Iterator:
    """The batches in parts of at most `ROWS` rows; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def listed(targets: DataFrame) -> DataFrame:
    """Sources that can be drawn: positive share and cap; a null cap is 1; the first row per source."""
    rows = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    rows = rows.where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats > 0")
    return rows.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("r")).select("source", "r.*")


def pack(documents: DataFrame, sources: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(source, part, seq, n, doc_ids, doc_tokens, packed): what each task makes of the listed sources' tokens, blocks of `block`
    ids and one shorter rest per source at most.

    `packed` is the deflated run of little-endian 32-bit ids, `doc_tokens` says how many are of each document. Null and empty texts hold no tokens. Documents span
    blocks where they must.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: dict[str, list] = {}  # by source: [ids so far by document, blocks written]

        def close(source: str, state: list, ids, docs: list[int], lengths: list[int], rows: list) -> None:
            rows.append((source, part, state[1], len(ids), docs, lengths, _packed(ids)))
            state[1] += 1

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids, counts = encode_array(some.column("text"), path)
                ends = np.cumsum(counts)
                docs, owner = some.column("doc_id").to_pylist(), np.array(some.column("source").to_pylist(), dtype=object)
                rows: list = []
                for source in dict.fromkeys(owner):
                    own = np.flatnonzero((owner == source) & (counts > 0))
                    state = waiting.setdefault(source, [[], 0])
                    pieces = state[0] + [(docs[i], ids[ends[i] - counts[i] : ends[i]]) for i in own]
                    if not pieces:
                        continue
                    run_ids = np.concatenate([p for _, p in pieces])
                    edges = np.cumsum([len(p) for _, p in pieces])
                    full = len(run_ids) // block
                    for b in range(full):
                        first, last = np.searchsorted(edges, b * block, "right"), np.searchsorted(edges, (b + 1) * block, "left")
                        lengths = np.diff(np.clip(np.r_[b * block, edges[first : last + 1]], b * block, (b + 1) * block))
                        close(source, state, run_ids[b * block : (b + 1) * block], [d for d, _ in pieces[first : last + 1]], lengths.tolist(), rows)
                    left = []
                    for (d, p), end in zip(pieces, edges, strict=True):
                        if end > full * block:
                            left.append((d, p[max(0, full * block - (end - len(p))) :].copy()))
                    state[0] = left
                yield _batch(rows)
        rows = []
        for source, state in waiting.items():
            if state[0]:
                close(source, state, np.concatenate([p for _, p in state[0]]), [d for d, _ in state[0]], [len(p) for _, p in state[0]], rows)
        yield _batch(rows)

    wanted = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    wanted = wanted.where("text is not null and text <> ''").join(checked_broadcast(sources.select("source")), "source", "left_semi")
    return spread(wanted).mapInArrow(run, _BLOCKS)


def _packed(ids) -> bytes:
    import numpy as np

    return zlib.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes):
    import numpy as np

    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int32)


def join_rests(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """The full blocks of `pieces` as they are, and the tasks' rests laid end to end per source and cut into blocks; one
    block of a source at most stays shorter. A block takes `block` rests at most, as none is empty."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in _slices(batches):
            rows = []
            for source, number, members in zip(*(batch.column(c).to_pylist() for c in ("source", "seq", "members")), strict=True):
                ids, docs, lengths = [], [], []
                for m in members:
                    low, high = max(0, number * block - m["start"]), (number + 1) * block - m["start"]
                    ids.append(_unpacked(m["packed"])[low:high])
                    inside = np.diff(np.clip(np.r_[0, np.cumsum(m["doc_tokens"])], low, high))
                    docs += [d for d, k in zip(m["doc_ids"], inside, strict=True) if k]
                    lengths += [int(k) for k in inside if k]
                run_ids = np.concatenate(ids)
                rows.append((source, RESTS, number, len(run_ids), docs, lengths, _packed(run_ids)))
            yield _batch(rows)

    rests = pieces.where(F.col("n") < block)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rests.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rests.join(starts.hint("merge"), ["source", "part"])
    numbers = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}"))
    placed = placed.select("source", F.explode(numbers.cast("array<int>")).alias("seq"), F.struct("start", "doc_ids", "doc_tokens", "packed").alias("m"))
    joined = placed.groupBy("source", "seq").agg(F.sort_array(F.collect_list("m")).alias("members")).mapInArrow(run, _BLOCKS)
    return pieces.where(F.col("n") >= block).unionByName(joined)


def blocks_of(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(source, block, n, doc_ids, doc_tokens, packed): the listed sources' tokens in blocks, numbered within the source without
    gaps from 0. Written once, as what a block holds must not change when a task runs again."""
    pieces = materialise(pack(documents, listed(targets), path, block), "blocks")
    whole = join_rests(pieces, block)
    counts = whole.groupBy("source", "part").agg(F.count("*").alias("k"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select("source", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset")), "offsets")
    return whole.join(checked_broadcast(offsets), ["source", "part"]).withColumn("block", F.col("offset") + F.col("seq")).drop("offset", "part", "seq")


def quotas(totals: list[dict], size: int | None = None) -> list[dict]:
    """The slots of each source that occurs: [{source, share, slots, blocks}].

    `totals`: [{source, target_share, max_repeats, blocks, tokens}]. Shares of sources that don't occur go to the others in
    proportion. Without a size the mixture is the largest in which every source holds its share under its cap, that
    is as large as the scarcest source allows. With a size in tokens every source gets its share of that, and
    one whose cap does not allow it falls short. Slots are counted by the source's tokens a block, as one block is shorter.
    """
    here = [t for t in totals if t["tokens"]]
    if not here:
        return []
    sum_of = sum(t["target_share"] for t in here)
    most = min(t["max_repeats"] * t["tokens"] * sum_of / t["target_share"] for t in here)
    out = []
    for t in here:
        share = t["target_share"] / sum_of
        slots = int(share * (most if size is None else size) * t["blocks"] / t["tokens"] + 0.5)
        out.append({"source": t["source"], "share": share, "slots": max(1, min(slots, t["max_repeats"] * t["blocks"])), "blocks": t["blocks"]})
    return out


def permute(index, size, key):
    """numpy arrays: the place of `index` in a pseudorandom permutation of range(size), one
    permutation per key. A Feistel network over an even number of bits, walked until inside."""
    import numpy as np

    size, key, out = size.astype(np.uint64), key.astype(np.uint64), index.astype(np.uint64).copy()
    bits = np.zeros(len(size), np.uint64)
    for b in range(1, 64):
        bits[size > np.uint64(1) << np.uint64(b - 1)] = b
    half = np.maximum((bits + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right, m, k = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], key[todo]
            for r in range(4):
                x = (right + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ k
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & m)
            out[todo] = (left << half[todo]) | right
            todo &= out >= size
    return out.astype(np.int64)


def slot_table(plan: list[dict], spark: SparkSession, seed: int = 0) -> DataFrame:
    """(shard, position, source, repeat, block): what each slot of the mixture holds, by the quotas' plan. `position`
    orders the slots of a shard, `repeat` counts the passes over the source from 0."""
    names, ends = [q["source"] for q in plan], [0]
    for q in plan:
        ends.append(ends[-1] + q["slots"])
    sizes, slots = [q["blocks"] for q in plan], ends[-1]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for ids in batches:
            at = ids["id"].to_numpy()
            drawn = permute(at, np.full(len(at), slots), np.full(len(at), seed * 2_000_003 + 1))
            owner = np.searchsorted(ends, drawn, "right") - 1
            i, size = drawn - np.asarray(ends)[owner], np.asarray(sizes)[owner] if len(at) else drawn
            repeat = i // np.maximum(size, 1)
            key = (seed * 1_000_003 + owner) * 65_537 + repeat + 2
            yield pd.DataFrame({"shard": at // SHARD_SLOTS, "position": (at % SHARD_SLOTS).astype(np.int32), "source": np.asarray(names, object)[owner], "repeat": repeat.astype(np.int32), "block": permute(i % np.maximum(size, 1), size, key)})

    return spark.range(slots).mapInPandas(draw, "shard bigint, position int, source string, repeat int, block bigint")


def _plan(blocks: DataFrame, targets: DataFrame, size: int | None) -> list[dict]:
    totals = blocks.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n").alias("tokens"))
    known = [r.asDict() for r in listed(targets).join(totals, "source").orderBy("source").collect()]
    return quotas(known, size)


def _unpack(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in _slices(batches):
        runs = [_unpacked(x) for x in batch.column("packed").to_pylist()]
        offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32))
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(runs), pa.int32()))
        rest = [n for n in batch.schema.names if n != "packed"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), ids], [*rest, "ids"])


def mixture(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, block: int = BLOCK, seed: int = 0, size: int | None = None) -> DataFrame:
    """(shard, position, source, repeat, block, n, doc_ids, doc_tokens, ids): the mixture, a block of token ids a row.

    Each source has its target share of the slots, and of the tokens up to one block a pass. Without a `size` in tokens
    the mixture is as large as the scarcest source allows; with one, sources fall short where their cap does
    not allow their share of it. Listed sources without tokens have none, and their shares go to the others
    in proportion; sources that aren't listed, null ones and null or empty texts stay out. Empty tables
    give no rows.
    """
    blocks = blocks_of(documents, targets, path, block)
    slots = slot_table(_plan(blocks, targets, size), documents.sparkSession, seed)
    # slots grow with the tokens, though Spark's estimate of an exploded plan doesn't show it
    joined = blocks.join(slots.hint("merge"), ["source", "block"]).select("shard", "position", "source", "repeat", "block", "n", "doc_ids", "doc_tokens", "packed")
    return joined.mapInArrow(_unpack, "shard bigint, position int, source string, repeat int, block bigint, n int, doc_ids array<bigint>, doc_tokens array<int>, ids array<int>")


def share_report(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, block: int = BLOCK, seed: int = 0, size: int | None = None) -> DataFrame:
    """(source, target_share, reached_share, tokens, available_tokens, max_repeats, most_repeats, short_blocks) of
    every listed source; most_repeats is how often its most used block occurs, short_blocks how many of its blocks
    are not full."""
    blocks = materialise(blocks_of(documents, targets, path, block).select("source", "block", "n"), "sizes")
    slots = blocks.join(slot_table(_plan(blocks, targets, size), documents.sparkSession, seed).hint("merge"), ["source", "block"])
    per_block = slots.groupBy("source", "block").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    used = per_block.groupBy("source").agg(F.sum("n").alias("tokens"), F.max("k").alias("most_repeats"))
    there = blocks.groupBy("source").agg(F.sum("n").alias("available_tokens"), F.count_if(F.col("n") < block).alias("short_blocks"))
    rows = listed(targets).join(used, "source", "left").join(there, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    rows = rows.select("source", "target_share", "max_repeats", *map(zero, ("tokens", "available_tokens", "most_repeats", "short_blocks")))
    return rows.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))
