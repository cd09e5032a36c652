"""Exact top-k inner-product search over a bit-sliced index."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import checkpoint

#: Rows of an index block, and queries in a row that is streamed past it.
BLOCK_ROWS, BATCH_QUERIES = 65_536, 64


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit slices [dimension, bit, word], least value of each dimension): bit r of a slice is row r's bit of value - least."""
    least = values.min(0)
    rest = (values - least).astype(np.uint64)
    width = max(1, int(rest.max(initial=0)).bit_length())
    pad = -len(values) % 64
    rest = np.pad(rest, ((0, pad), (0, 0)))
    out = np.empty((rest.shape[1], width, len(rest) // 64), np.uint64)
    rest = np.ascontiguousarray(rest.T)
    for b in range(width):
        bit = ((rest >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[:, b] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64)
    return out, least


def add_slices(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum over dimensions of |q| * t, t being a dimension's value, or its complement where q is below 0.

    For each bit of |q| the dimension's slices are added, shifted by that bit; slices of one weight are summed three at
    a time into one of that weight and a carry of the next.
    """
    width, todo = index.shape[1], {}
    for d in np.flatnonzero(query):
        own = ~index[d] if query[d] < 0 else index[d]
        q = abs(int(query[d]))
        while q:
            low = (q & -q).bit_length() - 1
            q &= q - 1
            for b in range(width):
                todo.setdefault(low + b, []).append(own[b])
    out, p = [], 0
    while todo:
        stack = todo.pop(p, [])
        while len(stack) > 1:
            a, b = stack.pop(), stack.pop()
            half = a ^ b
            if stack:
                c = stack.pop()
                carry = (a & b) | (half & c)
                half ^= c
            else:
                carry = a & b
            stack.append(half)
            todo.setdefault(p + 1, []).append(carry)
        out.append(stack[0] if stack else np.zeros(index.shape[2], np.uint64))
        p += 1
    return out


def top_rows(sums: list[np.ndarray], live: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums among `live`, from the most significant slice downward, and every row that ties with the last."""
    sure, rest = np.zeros_like(live), live.copy()
    for s in reversed(sums):
        more = rest & s
        n = int(np.bitwise_count(sure | more).sum())
        if n > k:
            rest = more
        else:
            sure |= more
            rest = rest & ~s
            if n == k:
                rest = np.zeros_like(rest)
                break
    return np.flatnonzero(np.unpackbits((sure | rest).view(np.uint8), bitorder="little"))


def usable(df: DataFrame, scale: float) -> DataFrame:
    """(vec_id, x): vectors as integers floor(scale * x), one a vec_id."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    return df.where(F.coalesce(good, F.lit(False))).select("vec_id", x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(ids, lists) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, values [row, dimension]) of Arrow columns; shorter vectors are filled up with 0."""
    ids, lists = np.asarray(ids), lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    off = np.asarray(lists.offsets).astype(np.int64)
    vals, size = np.asarray(lists.values), np.diff(off)
    out = np.zeros((len(ids), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(ids)), size), np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = vals[off[0] : off[-1]]
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def packed(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def unpacked(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data))


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, slices, vectors), written through a checkpoint: each block's rows sliced once, all as bytes."""

    def build(table: pa.Table) -> pa.Table:
        ids, values = matrix(table.column("vec_id"), table.column("x"))
        cut, _ = slices(values) if values.shape[1] else (np.zeros((0, 1, -(-len(ids) // 64)), np.uint64), None)
        return pa.table({"block": table.column("block")[:1], "ids": [packed(ids)], "slices": [packed(cut)], "vectors": [packed(values.astype(np.int32) if np.abs(values).max(initial=0) < 1 << 31 else values)]})

    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    return checkpoint(rows.select(part, "vec_id", "x").groupBy("block").applyInArrow(build, "block int, ids binary, slices binary, vectors binary"))


def search(embeddings: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, block_rows: int = BLOCK_ROWS, batch: int = BATCH_QUERIES, tasks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own, by integer inner product, ties to smaller ids.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and null ids, take
    no part; empty ones score 0. Of rows that repeat a vec_id the least vector counts. Vectors that are shorter than
    others are filled up with 0. Scores must fit in 63 bits. Each block of rows is sliced once and its index written;
    a task reads a block's index once and queries stream past it, and gives the k best of the block for each, of which the
    k best are kept. Only where there are fewer blocks than `tasks` (default: twice the cluster's cores) is a
    block's index copied to several tasks, which share the queries.
    """
    rows, asked = usable(embeddings, scale), usable(queries, scale)
    n, m = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-m // batch))
    shares = min(groups, max(1, (tasks or 2 * embeddings.sparkSession.sparkContext.defaultParallelism) // blocks))
    index = build_index(rows, blocks).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    asks = asked.groupBy(group.alias("group")).agg(F.collect_list(F.struct("vec_id", "x")).alias("q")).withColumn("share", F.pmod("group", F.lit(shares)))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    empty = F.lit(None).cast(asks.schema["q"].dataType).alias("q")
    left = index.select("block", "share", F.lit(-1).alias("group"), "ids", "slices", "vectors", empty)
    right = asks.select("block", "share", "group", *none("ids", "slices", "vectors"), "q")
    stream = left.unionByName(right).repartition(blocks * shares, "block", "share").sortWithinPartitions("block", "share", "group")

    def run(batches):
        ids = values = cut = everyone = None
        for part in batches:
            got = []
            for r in range(part.num_rows):
                if part.column("group")[r].as_py() < 0:
                    ids, values, cut = (unpacked(part.column(c)[r].as_py()) for c in ("ids", "vectors", "slices"))
                    everyone = np.packbits(np.arange(cut.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
                elif ids is not None:
                    q = part.column("q").slice(r, 1).flatten()
                    got += best(ids, values, cut, everyone, *matrix(q.field("vec_id"), q.field("x")))
            if got:
                a, b, c = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_pydict({"query_id": a.astype(np.int64), "vec_id": b.astype(np.int64), "score": c.astype(np.int64)})

    def best(ids, values, cut, everyone, qids, qs):
        dims = min(values.shape[1], qs.shape[1])
        for qid, q in zip(qids, qs[:, :dims]):
            live = everyone.copy()
            own = np.searchsorted(ids, qid)
            if own < len(ids) and ids[own] == qid:
                live[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
            found = top_rows(add_slices(cut[:dims], q), live, k)
            exact = values[found][:, :dims].astype(np.int64) @ q  # the boundary's ties are resolved on exact scores
            order = np.lexsort((ids[found], -exact))[:k]
            yield np.full(len(order), qid), ids[found][order], exact[order]

    found = stream.mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
