"""SimHash near-duplicates: pivot distance tables find fingerprints of few differing bits, links make components."""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import KEY_ROWS, boxed, checkpoint, spread_join, words

SHINGLE = 3
MAX_BITS = 2
#: Ranges of a distance coordinate are so wide; REFERENCES of them at most make a bucket, CHECKED more discard pairs.
RANGE, REFERENCES, CHECKED = 8, 20, 16
#: Buckets of more fingerprints than this are linked through one-bit neighbours instead of pairs.
PAIRS_UP_TO = 24
#: Of a near copy: words in a shingle, least similarity of the sets of shingles, and most differing bits of 128 to compare them at all.
NEAR_SHINGLE, NEAR_LEAST, NEAR_BITS = 5, 0.8, 32
#: What tells texts apart in that search: their fingerprint and the digest of their set.
NEAR_NODE = ["fp", "fp1", "s"]
#: Buckets of near copies of more fingerprints than this are linked through their centre and by blocks.
NEAR_PAIRS_UP_TO = 64
#: Fingerprints in a bucket of outer ranges on average, at most, and references that a fingerprint lies in an outer range of, of each group.
NEAR_BUCKET, HITS = 32, 2
#: Fingerprints in a block of a large bucket; a task compares two blocks.
BLOCK = 2048


def _bit_counts(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[document, bit] -> how many of its hashes have the bit; bytes of 8 counters are added in runs of at most 255."""
    table = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
    out = np.zeros((len(lengths), 64), np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    parts = (lengths[full] + 254) // 255
    own = np.repeat(full, parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = starts[own] + 255 * nth
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(table[raw[:, byte]], at)
        np.add.at(out, (own, slice(8 * byte, 8 * byte + 8)), sums.view(np.uint8).reshape(-1, 8).astype(np.int64))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers one to one."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_hashes(shingle: int) -> Column:
    """xxHash64 (seed 42) of each run of `shingle` of the words in column w; of fewer words the whole sequence, of none no hash."""
    joined = ", ".join(f"w[i + {k}]" for k in range(shingle))
    runs = f"transform(sequence(0, size(w) - {shingle}), i -> xxhash64(concat_ws(' ', {joined})))"
    return F.expr(f"if(size(w) >= {shingle}, {runs}, if(size(w) = 0, array(), array(xxhash64(array_join(w, ' ')))))")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, longs: int = 1) -> DataFrame:
    """(doc_id, row, fp, ..) of each row: bit i of fp is set if over half of the text's shingles have it in their xxHash64 (seed 42).

    Shingles are runs of `shingle` words, repeats included; of fewer words the whole sequence. No word, or null: zero.
    row is a hash of the text. With `longs` = 2 a second number fp1 comes from a mix of the same hashes, and s is a digest of their set.
    """
    w = documents.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
    kind = dict(documents.dtypes)["doc_id"]
    names = ["fp", *[f"fp{k}" for k in range(1, longs)]]

    def run(batches):
        for batch in batches:
            col = batch.column("hashes")
            off = np.asarray(col.offsets).astype(np.int64)
            vals = np.ascontiguousarray(np.asarray(col.values)[off[0] : off[-1]])
            n = np.diff(off)
            counts = {name: np.zeros((len(col), 64), np.int64) for name in names}
            i = 0
            while i < len(col):  # about half a million hashes at a time
                j = min(len(col), max(i + 1, int(np.searchsorted(off, off[i] + (1 << 19), "right")) - 1))
                hashes = vals[off[i] - off[0] : off[j] - off[0]]
                for name in names:
                    counts[name][i:j] = _bit_counts(hashes, off[i:j] - off[i], n[i:j])
                    hashes = _mix(hashes)
                i = j
            out = {"doc_id": batch.column("doc_id"), "row": batch.column("row")}
            if longs > 1:
                sets = [_mix(np.unique(vals[a - off[0] : b - off[0]])) for a, b in zip(off[:-1], off[1:])]
                out["s"] = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
            for name in names:
                out[name] = np.packbits(counts[name] * 2 > n[:, None], axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_pydict(out)

    fields = ", ".join(f"{name} long" for name in (["s"] if longs > 1 else []) + names)
    return w.select("doc_id", "row", _shingle_hashes(shingle).alias("hashes")).mapInArrow(run, f"doc_id {kind}, row long, {fields}")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def references(n: int) -> list[int]:
    """n reference fingerprints of 64 bits, fixed pseudo-random numbers."""
    return [int(x) for x in _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def pivot_buckets(fps: DataFrame, in_key: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp): fingerprints in buckets of their distances to references.

    Two fingerprints of m or fewer differing bits have Hamming distances to a reference that differ by m or less. Each of
    the first `in_key` distances is cut into ranges, and a fingerprint goes to all ranges within m / 2 of its own
    distance: one, or two near an edge. So such a pair shares a range in each coordinate and a bucket, the combination of ranges.
    """
    margin = -(-max_bits // 2)
    refs = np.array(references(in_key), np.uint64)

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            own, key = np.arange(len(fp)), np.zeros(len(fp), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(in_key):
                    d = np.bitwise_count(fp ^ refs[k]).astype(np.int64)[own] + RANGE
                    low, high = (d - margin) // RANGE, (d + margin) // RANGE
                    both = np.flatnonzero(low != high)
                    step = lambda at, cell: _mix(key[at] * np.uint64(31) + (cell + 64 * k).astype(np.uint64) + np.uint64(1))  # noqa: B023, E731
                    key = np.concatenate([step(slice(None), low), step(both, high[both])])
                    own = np.concatenate([own, own[both]])
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "fp": fp.view(np.int64)[own]})

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def pivot_filter(max_bits: int, longs: int = 1):
    """A test of pairs of rows, whose first `longs` numbers are a fingerprint: discards those whose distances to any of CHECKED
    more references differ by over max_bits, which pairs of up to max_bits differing bits never do, and verifies the rest by
    their differing bits."""
    refs = np.array(references(longs * (REFERENCES + CHECKED)), np.uint64).reshape(-1, longs)[REFERENCES:]

    def close(values):
        fps = [v.view(np.uint64) for v in values[:longs]]
        distances = [distance(fps, r).astype(np.int16) for r in refs]

        def test(a, b):
            keep = np.arange(len(a))
            for d in distances:
                keep = keep[np.abs(d[a[keep]] - d[b[keep]]) <= max_bits]
            bits = distance([fp[a[keep]] for fp in fps], [fp[b[keep]] for fp in fps])
            return keep[bits <= max_bits], bits[bits <= max_bits].astype(np.int64)

        return test

    return close


def distance(a, b) -> np.ndarray:
    """Differing bits of fingerprints of one or more numbers of 64 bits."""
    out = np.bitwise_count(a[0] ^ b[0])
    for x, y in zip(a[1:], b[1:]):
        out = out + np.bitwise_count(x ^ y)  # two numbers differ in 128 bits at most
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of n rows that make a spanning forest of least weight: in rounds, each tree takes its lightest edge to another."""
    order = np.lexsort((b, a, weight))
    a, b, kept = a[order], b[order], [np.zeros(0, np.int64)]
    label, live = np.arange(n), np.arange(len(a))
    while True:
        x, y = label[a[live]], label[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            return order[np.concatenate(kept)]
        best = np.full(n, len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        x, y, parent, before = label[a[chosen]], label[b[chosen]], np.arange(n), None
        while before is None or (parent != before).any():
            before = parent.copy()
            np.minimum.at(parent, x, parent[y])
            np.minimum.at(parent, y, parent[x])
            parent = parent[parent]
        label = parent[label]


def meet(keyed: DataFrame, pairs_up_to: int, close, key_rows: int = KEY_ROWS, shares: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pairs, dense) of rows (key, numbers..): of the pairs of rows of one key that the test `close` makes of their numbers keeps, pairs has those, as columns
    a_.. and b_.., that make a spanning forest of least differing bits, for keys of up to `pairs_up_to` rows; dense has the rows of
    all larger keys.

    Rows are sorted by key and streamed, a key's rows held only until there are more than `pairs_up_to`. Keys of very many rows,
    as counted in a 64th of all rows by a hash, need no place of their own: their rows are dense wherever they lie.
    """
    names = [c for c in keyed.columns if c != "key"]
    some = keyed.where(F.pmod(F.xxhash64(*names), F.lit(shares)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    some = checkpoint(some)
    limit = max(key_rows // shares, (some.agg(F.sum("n")).first()[0] or 0) // 4096, pairs_up_to // 4, 2)
    hot = keyed.sparkSession.createDataFrame([(r.key,) for r in some.where(F.col("n") > limit).select("key").collect()], "key long")  # 4096 keys at most
    rest = keyed.join(F.broadcast(hot), "key", "left_anti").repartition("key").sortWithinPartitions("key")

    def run(batches):
        key, values, large = np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in names], None
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                key = np.concatenate([key, np.asarray(batch.column("key"))])
                values = [np.concatenate([v, np.asarray(batch.column(c))]) for v, c in zip(values, names)]
            end = len(key)
            if batch is not None and end:
                start = int(np.searchsorted(key, key[-1]))
                if end - start <= pairs_up_to and key[-1] != large:
                    end = start  # the last key may go on
            now, part = key[:end], [v[:end] for v in values]
            starts = np.flatnonzero(np.diff(now, prepend=now[:1] - 1)) if end else np.zeros(0, np.int64)
            sizes = np.diff(starts, append=end)
            many = np.repeat((sizes > pairs_up_to) | (now[starts] == large if large is not None else False), sizes) if end else np.zeros(0, bool)
            found = [(np.zeros(0, np.int64),) * 3]
            few = np.flatnonzero(~many)
            test = close([v[few] for v in part])
            for step in range(1, pairs_up_to):
                a = np.flatnonzero(now[few[:-step]] == now[few[step:]])
                if not len(a):
                    break
                keep, bits = test(a, a + step)
                found.append((few[a[keep]], few[a[keep] + step], bits))
            a, b, bits = (np.concatenate(x) for x in zip(*found))
            tree = forest(end, a, b, bits)
            a, b = a[tree], b[tree]
            rows = np.flatnonzero(many)
            if len(a) + len(rows):
                cols = {"key": pa.array(np.concatenate([now[a], now[rows]])), "pair": pa.array(np.arange(len(a) + len(rows)) < len(a))}
                for v, c in zip(part, names):
                    cols[f"a_{c}"] = np.concatenate([v[a], v[rows]])
                    cols[f"b_{c}"] = np.concatenate([v[b], v[rows]])
                yield pa.RecordBatch.from_pydict(cols)
            if end:
                large = now[-1] if many[-1] else None
            key, values = key[end:], [v[end:] for v in values]

    fields = "key long, pair boolean, " + ", ".join(f"a_{c} long, b_{c} long" for c in names)
    out = checkpoint(rest.mapInArrow(run, fields))
    dense = out.where("not pair").select("key", *[F.col(f"a_{c}").alias(c) for c in names]).unionByName(keyed.join(F.broadcast(hot), "key"))
    return out.where("pair").drop("key", "pair"), dense


def links(fps: DataFrame, max_bits: int = MAX_BITS, pairs_up_to: int = PAIRS_UP_TO, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b), a < b: enough pairs of different fingerprints of at most `max_bits` (2 or less) differing bits to make
    the same components as all such pairs. fps has one column fp of distinct values.

    Buckets come from the pivot table, of more coordinates the more fingerprints there are, up to REFERENCES. Within a
    bucket, pairs with a coordinate difference of more than `max_bits` in the other references are discarded, and the rest
    verified by their differing bits. A bucket of more than `pairs_up_to` fingerprints isn't paired: each member points to
    all fingerprints of one bit more or less, and those that meet there are at most two bits apart, are verified
    and linked to the least, at most 65 in a meeting. That way is exact too, and linear where ranges no longer tell
    fingerprints apart.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("links are made for up to two differing bits")
    many = fps.count()
    in_key = min(REFERENCES, max(1, math.ceil(math.log(max(many * 2 / pairs_up_to, 1)) / math.log(1 / 0.53))))
    pairs, dense = meet(pivot_buckets(fps, in_key, max_bits), pairs_up_to, pivot_filter(max_bits), key_rows)
    pairs = pairs.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))
    if max_bits < 2:
        return pairs.unionByName(_one_bit(dense, max_bits)).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    near = dense.select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("z", "a")
    stars = near.join(least, "z").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).distinct()


def _one_bit(dense: DataFrame, max_bits: int) -> DataFrame:
    """The pairs of one differing bit among fingerprints, by looking up each one's 64 neighbours above it."""
    own = dense.select("fp").distinct()
    if not max_bits:
        return own.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    flips = F.array(*[F.lit(_signed(1 << i)) for i in range(64)])
    up = own.select(F.col("fp").alias("a"), F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("b")).where("a < b")
    return up.join(own.select(F.col("fp").alias("b")), "b").select("a", "b")


def components(nodes: DataFrame, edges: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(node, root) for each node: the least node that it can reach.

    Each round, a node takes the least root among its own, its neighbours' and that root's root, until nothing
    changes. Rounds are cut by checkpoints; only the number of changes reaches the driver. Lookups of a root that
    very many nodes share are dealt over tasks.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    inner = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    many = inner.count()
    changed = bool(many)
    while changed:
        up = both.join(inner.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        new = inner.join(up, inner["node"] == up["a"], "left").select("node", F.col("root").alias("old"), F.least("root", "r").alias("mid"))
        jump = inner.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        sizes = inner.groupBy(F.col("root").alias("mid")).agg(F.count("*").alias("n"))
        new = spread_join(new, jump, "mid", sizes, many, ["node"], "left", key_rows)
        new = checkpoint(new.select("node", "old", F.least("mid", "far").alias("root")))
        changed = new.where("old != root").limit(1).count() > 0
        inner = new.select("node", "root")
    return nodes.join(inner, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _named(docs: DataFrame, edges: DataFrame, fp: list[str], key_rows: int) -> DataFrame:
    """docs with component_id, the least doc_id of the component of the row's fingerprint, which is columns `fp`."""
    rows = docs.withColumn("node", F.struct(*fp))
    nodes = checkpoint(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = checkpoint(components(nodes.select("node"), edges, key_rows))
    named = nodes.join(found, "node")
    names = checkpoint(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"), F.sum("n").alias("rows")))
    many = names.agg(F.sum("n").alias("nodes"), F.sum("rows").alias("rows")).first()
    by_fp = spread_join(named.select("node", "root"), names.select("root", "component_id"), "root", names.select("root", "n"), many.nodes or 0, ["node"], "inner", key_rows)
    return spread_join(rows, by_fp.select("node", "component_id"), "node", nodes.select("node", "n"), many.rows or 0, ["doc_id", "row"], "inner", key_rows).drop("node")


def near_duplicates(documents: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable through links of
    fingerprints of two or fewer differing bits).

    Exact copies share a fingerprint and so are one node. Documents without words have fingerprint zero and are
    linked like any other. Rows with a null doc_id keep their row but give no name to a component (null if it has no
    other); rows that repeat a doc_id with different texts connect the components of those texts' fingerprints only by name.
    """
    docs = checkpoint(fingerprints(documents.select("doc_id", "text")))
    edges = links(docs.select("fp").distinct(), key_rows=key_rows)
    edges = checkpoint(edges.select(F.struct(F.col("a").alias("fp")).alias("a"), F.struct(F.col("b").alias("fp")).alias("b")))
    found = _named(docs, edges, ["fp"], key_rows)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def both_within(reach: int, bits: int) -> float:
    """The share of all 128-bit numbers that lie within `reach` of both of two numbers of `bits` differing bits."""
    return sum(math.comb(128 - bits, a) * math.comb(bits, b) for b in range(bits + 1) for a in range(reach - max(b, bits - b) + 1)) / 2**128


def outer_ranges(many: int, recall: float = 0.95, at_bits: int = 24) -> tuple[int, int, int, int]:
    """(groups, reach, references, tables) of pivot_tables() for `many` fingerprints.

    A bucket holds NEAR_BUCKET of `many` fingerprints of random bits at most; two fingerprints of `at_bits` differing bits
    share one with a probability of `recall`. That they share an outer range of one reference has an exact probability:
    their distances to it are a + b and a + at_bits - b, with a of the bits that they share.
    """
    groups = 1 + (many > 1 << 14) + (many > 1 << 27)  # more groups need fewer references, but more tables
    share = lambda reach: sum(math.comb(128, k) for k in range(reach + 1)) / 2**128
    reach = next(x for x in range(58, 0, -1) if many * share(x) ** groups <= NEAR_BUCKET or x == 1)
    refs = round(HITS / (2 * share(reach)))
    met = (1 - (1 - 2 * both_within(reach, at_bits)) ** refs) ** groups
    return groups, reach, refs, math.ceil(math.log(1 - recall) / math.log(1 - met))


def spaced_ranges(many: int, recall: float = 0.95, at_bits: int = 24, pairs: int = 1 << 12) -> tuple[int, int]:
    """(apart, tables) of pivot_tables() for `many` fingerprints, with buckets of spaced references only.

    outer_ranges() takes the distances to references of different groups as independent. To references that happen to
    lie close they aren't, and the share of buckets that for this hold far more grows with the number of references. So the references
    of a bucket differ in `apart` bits or more, the least for which two groups give no more than NEAR_BUCKET of `many` fingerprints of
    random bits, or than twice the average, and more tables make up for the buckets left out: how often a table finds a pair
    of `at_bits` differing bits is measured, on fixed random pairs.
    """
    groups, reach, n, _ = outer_ranges(many, recall, at_bits)
    share = both_within(reach, 0)
    more = max(2, NEAR_BUCKET / max(1, many * share**groups))
    apart = 0 if groups == 1 else next(d for d in range(65) if both_within(reach, d) <= more * share**2)
    order = np.random.default_rng(14)
    x = order.integers(0, 1 << 64, (pairs, 2), np.uint64)
    turned = order.permuted(np.tile(np.arange(128) < at_bits, (pairs, 1)), axis=1)
    y = x ^ np.packbits(turned, axis=1, bitorder="little").view(np.uint64)
    met, refs = 0, table_references(8, groups, n)
    for of in refs:
        a, b = (set(zip(*(v.tolist() for v in table_keys(*fps.T, of, 0, reach, apart)))) for fps in (x, y))
        met += len({own for own, _ in a & b})
    return apart, math.ceil(math.log(1 - recall) / math.log(1 - max(1, met) / (len(refs) * pairs)))


def table_references(tables: int, groups: int, n: int) -> np.ndarray:
    """[table, group, reference] -> 128 bits as two numbers."""
    known = 2 * (REFERENCES + CHECKED)  # those of pivot_filter()
    return np.array(references(known + tables * groups * n * 2)[known:], np.uint64).reshape(tables, groups, n, 2)


def table_keys(f: np.ndarray, g: np.ndarray, refs: np.ndarray, table: int, reach: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, key) for the buckets of one table, of references refs[group], that fingerprints f, g lie in."""
    own, key, chosen = np.arange(len(f)), np.full(len(f), table, np.uint64), []
    for of in refs:
        d = np.stack([distance((f, g), r) for r in of])
        cell, rows = np.nonzero(np.concatenate([d <= reach, d >= 128 - reach]))
        order = np.argsort(rows, kind="stable")
        cell, many_of = cell[order], np.bincount(rows, minlength=len(f))
        times = many_of[own]
        at = np.repeat((np.cumsum(many_of) - many_of)[own] - np.cumsum(times) + times, times) + np.arange(times.sum())
        centre = np.concatenate([of, ~of])[cell[at]]  # 128 - reach and over of a reference is up to reach of its inverse
        chosen = [np.repeat(c, times, axis=0) for c in chosen]
        far = np.ones(len(at), bool)
        for c in chosen:
            far &= distance(c.T, centre.T) >= apart
        chosen = [c[far] for c in [*chosen, centre]]
        with np.errstate(over="ignore"):
            key = _mix(_mix(np.repeat(key, times)[far]) * np.uint64(31) + cell[at][far].astype(np.uint64) + np.uint64(1))
        own = np.repeat(own, times)[far]
    return own, key


def pivot_tables(fps: DataFrame, many: int, apart: int = 0, tables: int | None = None) -> DataFrame:
    """(key, fp, fp1, s): 128-bit fingerprints in buckets of their distances to references.

    The distances of a fingerprint to full-width references are cut into three ranges: up to `reach`, the 128 - reach and
    over, and the middle one, where most lie and which tells nothing. A bucket is an outer range of a reference of each
    group; near copies share outer ranges far more often than others. Each table has references of its own, so the
    tables find a pair independently; their number grows with that of the fingerprints, and buckets stay small, if the centres
    of their ranges, references or their inverses, differ in `apart` bits or more (see spaced_ranges()).
    """
    groups, reach, n, planned = outer_ranges(many)
    refs = table_references(tables or planned, groups, n)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            f, g, s = (np.asarray(batch.column(c)) for c in ("fp", "fp1", "s"))
            for t, of in enumerate(refs):
                own, key = table_keys(f.view(np.uint64), g.view(np.uint64), of, t, reach, apart)
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "fp": f[own], "fp1": g[own], "s": s[own]})

    return fps.select("fp", "fp1", "s").mapInArrow(run, "key long, fp long, fp1 long, s long")


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("fp", "fp1")), F.lit(0))


def bucket_centres(dense: DataFrame, sizes: DataFrame, key_rows: int, block: int = BLOCK) -> DataFrame:
    """(a, b): each fingerprint of a large bucket with the bucket's centre, the member next to the majority of each bit.

    The centre is that of about a block of the members; where it isn't the best one of all, bucket_trees() has more to do.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    some = spread_join(dense, sizes, "key", sizes, total, ["fp", "fp1", "s"], "inner", key_rows)
    some = some.where(F.pmod(F.xxhash64("fp", "fp1", F.lit("centre")), F.ceil(F.col("n") / block)) == 0)

    def centre(table: pa.Table) -> pa.Table:
        nodes = [np.asarray(table.column(c).combine_chunks()) for c in NEAR_NODE]
        fps = [v.view(np.uint64) for v in nodes[:2]]
        bits = np.concatenate([np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for v in fps])
        middle = np.packbits(bits * 2 > table.num_rows, bitorder="little").view(np.uint64)
        at = np.lexsort((*nodes[::-1], distance(fps, middle)))[:1]
        return pa.table({"key": table.column("key")[:1], **{c: v[at] for c, v in zip(NEAR_NODE, nodes)}})

    found = some.select("key", *NEAR_NODE).groupBy("key").applyInArrow(centre, "key long, fp long, fp1 long, s long")
    found = checkpoint(found.select("key", F.struct(*NEAR_NODE).alias("a")))
    rows = dense.select("key", F.struct(*NEAR_NODE).alias("b"))
    return spread_join(rows, found, "key", sizes, total, ["b"], "inner", key_rows).where("a != b").select("a", "b")


def bucket_trees(dense: DataFrame, found: DataFrame, sizes: DataFrame, key_rows: int, block: int = BLOCK, max_bits: int = NEAR_BITS) -> DataFrame:
    """(a, b): of large buckets whose fingerprints `found` doesn't have in one component, the pairs of least differing
    bits that would connect them (a spanning tree). Blocks of a bucket meet two at a time; trees of all
    meetings together hold a tree of the whole, and no task holds more than two blocks."""
    rows = dense.select("key", F.struct(*NEAR_NODE).alias("node")).join(found, "node")
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    blocks = apart.join(sizes, "key").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = spread_join(rows, blocks, "key", sizes, total, ["node"], "inner", key_rows)
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node.fp", "node.fp1", "node.s", "root")

    def tree(table: pa.Table) -> pa.Table:
        f, g = (np.asarray(table.column(c).combine_chunks()).view(np.uint64) for c in ("fp", "fp1"))
        roots = {}
        label = np.array([roots.setdefault((r["fp"], r["fp1"], r["s"]), len(roots)) for r in table.column("root").to_pylist()])
        s = np.asarray(table.column("s").combine_chunks())
        near, via = np.full(len(f), 999, np.int64), np.zeros(len(f), np.int64)
        left, out, at = np.ones(len(f), bool), [], 0
        for _ in range(len(f)):
            left[at] = False
            d = np.bitwise_count(f ^ f[at]).astype(np.int64) + np.bitwise_count(g ^ g[at])
            d[label == label[at]] = -1
            closer = d < near
            near[closer], via[closer] = d[closer], at
            rest = np.where(left, near, 1000)
            at = int(rest.argmin())
            if rest[at] == 1000:
                break
            if 0 <= near[at] <= max_bits:
                out.append((via[at], at))
        x, y = (np.array(k, np.int64) for k in (zip(*out) if out else ((), ())))
        return pa.table({"fp": f[x].view(np.int64), "fp1": g[x].view(np.int64), "s": s[x], "to": f[y].view(np.int64), "to1": g[y].view(np.int64), "to_s": s[y]})

    edges = rows.groupBy("key", "i", "j").applyInArrow(tree, "fp long, fp1 long, s long, to long, to1 long, to_s long")
    return edges.select(F.struct(*NEAR_NODE).alias("a"), F.struct(F.col("to").alias("fp"), F.col("to1").alias("fp1"), F.col("to_s").alias("s")).alias("b"))


def similar(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: float, key_rows: int, sent: int = 400_000) -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts' sets of shingles have a Jaccard similarity of `least` or more.

    nodes has (node, doc_id, row), one text of each fingerprint. Up to `sent` of the fingerprints in pairs are broadcast
    to find their texts where they lie; more are joined.
    """
    pairs = checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = checkpoint(used.join(nodes, "node"))
    few = wanted.limit(sent + 1).count() <= sent
    texts = documents.select("doc_id", F.xxhash64("text").alias("row"), "text")
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "row"])
    sets = texts.select("node", words(F.col("text")).alias("w")).select("node", F.array_distinct(_shingle_hashes(shingle)).alias("s"))
    sets = checkpoint(sets.groupBy("node").agg(F.first("s").alias("s")))  # repeated rows have the same set
    many = pairs.count()
    counts = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    first = spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a", counts("a"), many, ["b"], "inner", key_rows)
    both = spread_join(first, sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b", counts("b"), many, ["a"], "inner", key_rows)
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_copies(documents: DataFrame, shingle: int = NEAR_SHINGLE, least: float = NEAR_LEAST, pairs_up_to: int = NEAR_PAIRS_UP_TO, key_rows: int = KEY_ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of each row with a doc_id: the least doc_id reachable through near copies, texts whose sets of
    `shingle`-word shingles have a similarity of `least` or more.

    Candidates are 128-bit fingerprints that share a bucket of pivot distances; pairs whose distances to any of CHECKED more
    references differ by over NEAR_BITS are discarded, and the rest verified to differ in up to NEAR_BITS bits. Texts of one set of
    shingles are one node, and texts of one fingerprint alone are compared like any others. Of each bucket, the pairs of a spanning forest of least differing bits are compared by
    their whole texts. In a bucket of more than `pairs_up_to` fingerprints, all members are compared with its centre
    first; only where that leaves it in several components, its blocks are searched for the forest that connects
    these. So no bucket emits all its pairs, and none is cut short. Still some links are lost: pairs that share no bucket, that differ in more bits
    (repeated words turn a fingerprint, not a set), or in whose place the forest has an edge that fails. Where all
    count, as in the pipeline, take minhash.one_of_each().
    """
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    fps = checkpoint(fingerprints(docs, shingle, 2))
    nodes = checkpoint(fps.groupBy(F.struct(*NEAR_NODE).alias("node")).agg(F.min(F.struct("doc_id", "row")).alias("m")).select("node", "m.*"))
    many = nodes.count()
    keyed = pivot_tables(nodes.select("node.*"), many, *spaced_ranges(many))
    found, dense = meet(keyed, pairs_up_to, pivot_filter(NEAR_BITS, 2), key_rows)
    pairs = found.select(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for c in NEAR_NODE]).alias(side) for side in ("a", "b")])
    dense = checkpoint(dense)
    sizes = checkpoint(dense.groupBy("key").agg(F.count("*").alias("n")))
    large = sizes.limit(1).count() > 0
    if large:
        pairs = pairs.unionByName(bucket_centres(dense, sizes, key_rows, block).where(_differing("a", "b") <= NEAR_BITS))
    edges = checkpoint(similar(docs, nodes, pairs, shingle, least, key_rows))
    if large:
        found = checkpoint(components(nodes.select("node"), edges, key_rows))
        more = checkpoint(bucket_trees(dense, found, sizes, key_rows, block))
        if more.limit(1).count():
            edges = checkpoint(edges.unionByName(similar(docs, nodes, more, shingle, least, key_rows)))
    return _named(fps, edges, NEAR_NODE, key_rows).select("doc_id", "component_id")


def one_of_each(documents: DataFrame, **how) -> DataFrame:
    """The documents whose doc_id is their component's id in near_copies(), rows and columns as they are; rows with a null doc_id stay.

    Rows that repeat a doc_id stay or go together: they go only if all of them lie in components of other ids.
    """
    later = near_copies(documents.select("doc_id", "text"), **how).groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("later"))
    later = later.where("later").select("doc_id")
    return boxed(documents).join(later, F.col("row.doc_id") == F.col("doc_id"), "left_anti").select("row.*")
