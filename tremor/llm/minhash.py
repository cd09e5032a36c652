"""MinHash near-duplicates: banded candidates, pruned batch by batch of their signatures by a posterior bound, verified on full sets."""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import KEY_ROWS, boxed, checkpoint, spread_join
from tremor.llm.simhash import _mix, components, forest
from tremor.llm.spans import TEXT, Spans, pieces

SHINGLE = 4
#: Words in a shingle of the corpus pipeline.
COPY_SHINGLE = 5
#: Least similarity of the sets, in hundredths.
LEAST = 80
#: Largest probability that a pair of just the least similarity shares no band, and that the posterior bound prunes it at a batch.
MISS = 1e-7
#: Signature values are compared in so many batches.
BATCHES = 5
#: Members of a bucket meet in blocks of about so many.
BLOCK = 512
#: Up to so many candidates are broadcast to find their texts where they lie; the texts of more are joined.
SENT = 400_000


def bands_for(many: int, least: int = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): rows a band, which follow the logarithm of the number of documents so that buckets stay small, and so
    many bands that two sets of similarity `least` share one but for a probability of `miss`."""
    rows = max(5, math.ceil(math.log(max(many, 2), 16)))
    return rows, math.ceil(math.log(miss) / math.log1p(-((least / 100) ** rows)))


def fewest_matches(n: int, least: int = LEAST, miss: float = MISS) -> int:
    """The fewest equal values of n at which a similarity of `least` or more still has a posterior probability of `miss` or more.

    With a uniform prior the posterior after m equal values is Beta(m + 1, n - m + 1), whose mass above t is the
    probability that of n + 1 draws, each a success with probability t, no more than m succeed.
    """
    t, below = least / 100, 0.0
    for m in range(n + 1):
        below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        if below >= miss:
            return m
    return n


def _sets(text: pa.Array, shingle: int):
    """(i, j, sets) for runs of texts: of texts i to j - 1 the sorted 64-bit hashes of their distinct shingles, made from those of the words; of fewer words the whole sequence, of none no hash."""
    for i, j, data, ends in pieces(text):
        s = Spans(data, ends, TEXT, lower=True)
        n = np.bincount(s.doc, minlength=j - i)
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            hashes = s.hash
            for k in range(1, shingle):
                hashes = _mix(hashes[: len(s.hash) - k] * np.uint64(31) + s.hash[k:])
            sets = []
            for at, many in zip(first.tolist(), n.tolist()):
                if many >= shingle:
                    sets.append(np.unique(hashes[at : at + many - shingle + 1]))
                else:
                    whole = np.uint64(many)
                    for h in s.hash[at : at + many]:
                        whole = _mix(np.array([whole * np.uint64(29) + h]))[0]
                    sets.append(np.full(min(many, 1), whole, np.uint64))
        yield i, j, sets


def signatures(documents: DataFrame, shingle: int, size: int) -> DataFrame:
    """(doc_id, row, s0, s1, n_shingles, sig) of each row: row is a hash of the text, (s0, s1) a digest of its set of distinct
    shingles, sig `size` 16-bit MinHash values (none for an empty set)."""
    kind = dict(documents.dtypes)["doc_id"]
    rng = np.random.default_rng(5)
    flips, factors = rng.integers(0, 1 << 63, size, np.uint64), rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)

    def signed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Digests and signatures of sets that aren't empty."""
        n = np.array([len(x) for x in sets], np.int64)
        at, h, sig = np.cumsum(n) - n, np.concatenate(sets), np.zeros((len(sets), size), np.uint16)
        with np.errstate(over="ignore"):
            once = _mix(h)
            digest = np.stack([np.add.reduceat(once, at), np.add.reduceat(_mix(once * np.uint64(31)), at)], axis=1)
            for k in range(size):
                sig[:, k] = _mix(np.minimum.reduceat((h ^ flips[k]) * factors[k], at)) & np.uint64(0xFFFF)
        return digest, sig

    def run(batches):
        for batch in batches:
            for i, j, sets in _sets(batch.column("text"), shingle):
                n = np.array([len(x) for x in sets], np.int64)
                digest, raw = np.zeros((j - i, 2), np.uint64), [None] * (j - i)
                full = np.flatnonzero(n)
                cuts = np.searchsorted(np.cumsum(n[full]), np.arange(0, n.sum(), 1 << 15)[1:])
                for some in np.split(full, np.unique(cuts)):  # about as many hashes at a time as a cache holds
                    if len(some):
                        digest[some], sig = signed([sets[k] for k in some])
                        for k, one in zip(some.tolist(), sig):
                            raw[k] = one.tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "row": batch.column("row").slice(i, j - i), "s0": digest[:, 0].view(np.int64), "s1": digest[:, 1].view(np.int64), "n_shingles": n, "sig": pa.array(raw, pa.binary())})

    texts = documents.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, row long, s0 long, s1 long, n_shingles long, sig binary")


def _node(a: str = "s0", b: str = "s1") -> Column:
    return F.struct(F.col(a).alias("s0"), F.col(b).alias("s1"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of signatures as rows of numbers."""
    column = column.cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[first : first + 2 * size * len(column)].view(np.uint16).reshape(-1, size)


def band_keys(nodes: DataFrame, rows: int, bands: int) -> DataFrame:
    """(key, band, s0, s1): each node once a band, under a hash of the band's values."""

    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column("sig"), rows * bands).astype(np.uint64)
            for b in range(bands):
                with np.errstate(over="ignore"):
                    key = np.full(len(sig), b + 1, np.uint64)
                    for k in range(rows):
                        key = _mix(key * np.uint64(31) + sig[:, b * rows + k])
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "band": np.full(len(key), b, np.int32), "s0": batch.column("s0"), "s1": batch.column("s1")})

    return nodes.select("s0", "s1", "sig").mapInArrow(run, "key long, band int, s0 long, s1 long")


def common_counts(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, bits: int = 1 << 12, pairs: int = 1 << 15) -> np.ndarray:
    """Sizes of the intersections of sets p[i] and q[i], of sorted numbers: by rows of bits over the numbers that two sets or more have, some thousands at a time."""
    used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    p, q, out = at[: len(p)], at[len(p) :], np.zeros(len(p), np.int64)
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    number, many = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)[1:]
    shared = many[number] > 1
    number, owner = (np.cumsum(many > 1) - 1)[number[shared]], owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, bits):
        i, j = np.searchsorted(number, [low, low + bits])
        rows = np.zeros((len(used), bits), bool)
        rows[owner[i:j], number[i:j] - low] = True
        rows = np.packbits(rows, axis=1).view(np.uint64)
        for k in range(0, len(p), pairs):
            out[k : k + pairs] += np.bitwise_count(rows[p[k : k + pairs]] & rows[q[k : k + pairs]]).sum(1, dtype=np.int64)
    return out


def meetings(members: DataFrame, rows: int, bands: int, exact: bool, least: int, miss: float, block: int) -> DataFrame:
    """(a0, a1, b0, b1, more): of the members of a bucket with different roots, pairs that the posterior bound doesn't prune.

    A pair is compared where it first shares a band, batch of signature values by batch, and dropped as soon as it has fewer equal
    ones than fewest_matches(). If not `exact`, each block of a bucket is compared with itself alone, and of the pairs left
    those go out that make a forest of most equal values over the roots, and each member's best; `more` tells on each row
    whether its bucket may hold others. If `exact`, all pairs of blocks meet, members bring their sets `s`, each pair left is
    verified there and then, and a forest of the verified ones goes out. Rows are sorted and streamed, so a task holds
    two blocks, and no bucket hands out its pairs.
    """
    size = rows * bands
    ends = [size * (k + 1) // BATCHES for k in range(BATCHES)]
    needed = [fewest_matches(n, least, miss) for n in ends]
    own = F.pmod(F.xxhash64("s0", "s1", F.lit("block")), F.col("blocks")).cast("int")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("weight") / (block << 9))) if exact else F.ceil(F.col("n") / block)
    dealt = members.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)) if exact else F.col("own")
    dealt = dealt.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    longs = ("key", "i", "j", "own", "s0", "s1", "root", "n_shingles", "band", "blocks")
    dealt = dealt.select("key", "i", "j", "own", "s0", "s1", F.xxhash64("root").alias("root"), "n_shingles", "band", "blocks", "sig", *(["s"] if exact else []))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def verified_ones(x, sets, group, p, q):
        """Which pairs have a similarity of `least` or more."""
        out = np.zeros(len(p), bool)
        order = np.argsort(group[p], kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(group[p][order])) + 1):
            if len(some):
                common = common_counts(sets, p[some], q[some])
                out[some] = 100 * common >= least * (x["n_shingles"][p[some]] + x["n_shingles"][q[some]] - common)
        return out

    def compared(x, sig, sets, group, last):
        """Places of surviving pairs and their equal values."""
        found, waiting = [(np.zeros(0, np.int64),) * 3], []
        a, step = np.arange(len(group)), 1

        def settle():
            p, q, equal = (np.concatenate(f) for f in zip(*waiting))
            waiting.clear()
            if exact:
                keep = verified_ones(x, sets, group, p, q)
                p, q, equal = p[keep], q[keep], equal[keep]
            found.append((p, q, equal))

        while True:
            a = a[a + step < last[a]]
            if not len(a):
                break
            b, step = a + step, step + 1
            n, m = x["n_shingles"][a], x["n_shingles"][b]
            live = (x["root"][a] != x["root"][b]) & (100 * np.minimum(n, m) >= least * np.maximum(n, m)) & ((x["i"][a] == x["j"][a]) | (x["own"][a] != x["own"][b]))
            p, q = a[live], b[live]
            equal, begin = np.zeros(len(p), np.int64), 0
            for end, need in zip(ends, needed):
                equal += (sig[p, begin:end] == sig[q, begin:end]).sum(1)
                keep = equal >= need
                p, q, equal, begin = p[keep], q[keep], equal[keep], end
            if len(p):
                shared = (sig[p] == sig[q]).reshape(len(p), bands, rows).all(2)
                keep = shared.argmax(1) == x["band"][p]
                waiting.append((p[keep], q[keep], equal[keep]))
                if sum(len(w[0]) for w in waiting) > 1 << 18:
                    settle()
        if waiting:
            settle()
        return tuple(np.concatenate(f) for f in zip(*found))

    def chosen(x, group, p, q, equal):
        """Which of the pairs go out."""
        out = np.zeros(len(p), bool)
        both = np.concatenate([x["root"][p].view(np.uint64), x["root"][q].view(np.uint64)])
        place = np.unique(_mix(both ^ _mix(np.concatenate([group[p], group[p]]).astype(np.uint64))), return_inverse=True)[1]
        if len(p):
            out[forest(int(place.max()) + 1, place[: len(p)], place[len(p) :], size - equal)] = True
        if not exact:
            ends_of, pair = np.concatenate([p, q]), np.tile(np.arange(len(p)), 2)
            order = np.lexsort((pair, -equal[pair], ends_of))
            best = np.ones(len(order), bool)
            best[1:] = ends_of[order][1:] != ends_of[order][:-1]
            out[pair[order[best]]] = True
        return out

    def run(batches):
        held, sigs, sets = {c: np.zeros(0, np.int64) for c in longs}, np.zeros((0, size), np.uint16), []
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held = {c: np.concatenate([held[c], np.asarray(batch.column(c)).astype(np.int64)]) for c in longs}
                sigs = np.concatenate([sigs, _matrix(batch.column("sig"), size)])
                if exact:
                    off, values = np.asarray(batch.column("s").offsets), np.asarray(batch.column("s").values)
                    sets += [np.sort(values[i:j]) for i, j in zip(off[:-1], off[1:])]
            many = len(held["key"])
            if not many:
                continue
            new = np.ones(many, bool)
            new[1:] = np.any([held[c][1:] != held[c][:-1] for c in ("key", "i", "j")], axis=0)
            starts = np.flatnonzero(new)
            end = many if batch is None else int(starts[-1])  # the last meeting may go on
            x, sig = {c: v[:end] for c, v in held.items()}, sigs[:end]
            group = np.cumsum(new[:end]) - 1
            last = np.append(starts, many)[group + 1] if end else np.zeros(0, np.int64)
            p, q, equal = compared(x, sig, sets, group, last)
            out = chosen(x, group, p, q, equal)
            if len(p):
                rest = (np.bincount(group[p[~out]], minlength=int(group[-1]) + 1) > 0) & (not exact)
                p, q = p[out], q[out]
                yield pa.RecordBatch.from_pydict({"key": x["key"][p], "a0": x["s0"][p], "a1": x["s1"][p], "b0": x["s0"][q], "b1": x["s1"][q], "more": rest[group[p]]})
            held, sigs, sets = {c: v[end:] for c, v in held.items()}, sigs[end:], sets[end:]

    return dealt.mapInArrow(run, "key long, a0 long, a1 long, b0 long, b1 long, more boolean")


def shingle_sets(documents: DataFrame, wanted: DataFrame, shingle: int, sent: int = SENT) -> DataFrame:
    """(node, s) for each wanted node (node, doc_id, row): its set of shingle hashes, from its text. doc_id may be null."""
    few = wanted.limit(sent + 1).count() <= sent
    w = wanted.select("node", F.col("doc_id").alias("d"), F.col("row").alias("r"))
    texts = documents.select("doc_id", F.xxhash64("text").alias("row"), "text")
    texts = texts.join(F.broadcast(w) if few else w, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))

    def run(batches):
        for batch in batches:
            for i, j, found in _sets(batch.column("text"), shingle):
                ends = np.cumsum([0, *(len(x) for x in found)])
                s = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(found).view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"s0": batch.column("s0").slice(i, j - i), "s1": batch.column("s1").slice(i, j - i), "s": s})

    sets = texts.select("node.s0", "node.s1", F.col("text").cast("binary").alias("text")).mapInArrow(run, "s0 long, s1 long, s array<long>").select(_node().alias("node"), "s")
    return sets.groupBy("node").agg(F.first("s").alias("s"))  # repeated rows have the same set


def verified(pairs: DataFrame, sets: DataFrame, least: int, key_rows: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of `least` hundredths or more."""
    many = pairs.count()
    counts = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    first = spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a", counts("a"), many, ["b"], "inner", key_rows)
    both = spread_join(first, sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b", counts("b"), many, ["a"], "inner", key_rows)
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(100 * common >= least * (F.size("x") + F.size("y") - common)).select("a", "b")


def joined(roots: DataFrame, new: DataFrame, key_rows: int) -> DataFrame | None:
    """(node, root) after new links (a, b) between nodes; None if they connect nothing new. Only roots are linked, so what is already one component costs nothing."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = new.join(of("a"), "a").join(of("b"), "b").where("ra != rb")
    edges = checkpoint(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not edges.limit(1).count():
        return None
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    higher = checkpoint(components(ends, edges, key_rows).select(F.col("node").alias("root"), F.col("root").alias("higher")))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    met = spread_join(roots, higher, "root", sizes, roots.count(), ["node"], "left", key_rows)
    return checkpoint(met.select("node", F.coalesce("higher", "root").alias("root")))


def links(documents: DataFrame, nodes: DataFrame, rows: int, bands: int, shingle: int, least: int = LEAST, miss: float = MISS, key_rows: int = KEY_ROWS, block: int = BLOCK) -> DataFrame:
    """(node, root) of the nodes that share a bucket with others: the least node of the component that all pairs of a similarity of
    `least` or more make.

    Of buckets that hold the same nodes, the one of the first band stays. First each bucket gives a forest of likely pairs, and each
    member's best, which are verified by joining their sets. Then the buckets that may hold more, and whose members aren't one component by
    now, get the sets of their members, and all pairs that the bound leaves are verified inside. So no bucket emits all its pairs, and none is cut short.
    """
    keyed = band_keys(nodes, rows, bands)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("s0", "s1")).alias("x"), F.min("s0").alias("m"), F.first("band").alias("band")).where("n > 1")
    live = checkpoint(sizes.groupBy("n", "x", "m").agg(F.min(F.struct("band", "key")).alias("k")).select("k.key", "n"))
    total = live.agg(F.sum("n")).first()[0] or 0
    met = spread_join(keyed, live, "key", live, total, ["s0", "s1"], "inner", key_rows)
    members = checkpoint(met.join(nodes.select("s0", "s1", "n_shingles", "sig"), ["s0", "s1"]).withColumn("node", _node()))
    wanted = checkpoint(members.select("node").distinct().join(nodes.select(_node().alias("node"), "doc_id", "row"), "node"))
    sets = checkpoint(shingle_sets(documents, wanted, shingle))
    roots = wanted.select("node", F.col("node").alias("root"))
    found = checkpoint(meetings(members.withColumn("root", F.col("node")), rows, bands, False, least, miss, block))
    pairs = lambda found: found.select(F.least(_node("a0", "a1"), _node("b0", "b1")).alias("a"), F.greatest(_node("a0", "a1"), _node("b0", "b1")).alias("b")).distinct()
    roots = joined(roots, verified(checkpoint(pairs(found)), sets, least, key_rows), key_rows) or roots
    open_keys = found.where("more").select("key").unionByName(live.where(F.col("n") > block).select("key")).distinct()
    left = spread_join(members, checkpoint(open_keys), "key", live, total, ["node"], "left_semi", key_rows)
    rooted = checkpoint(left.select("key", "node").join(roots, "node"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    weights = left.groupBy("key").agg(F.sum("n_shingles").alias("weight"))
    apart = checkpoint(apart.join(weights, "key"))
    if not apart.limit(1).count():
        return roots
    rooted = spread_join(rooted, apart, "key", live, total, ["node"], "inner", key_rows)
    again = left.join(rooted, ["key", "node"])
    again = spread_join(again, sets, "node", again.groupBy("node").agg(F.count("*").alias("n")), total, ["key"], "inner", key_rows)
    return joined(roots, checkpoint(pairs(meetings(again, rows, bands, True, least, miss, 8 * block))), key_rows) or roots


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, least: int = LEAST, miss: float = MISS, key_rows: int = KEY_ROWS, block: int = BLOCK, empty_alike: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles (distinct), component_id (least doc_id reachable through sets of a similarity of
    `least` hundredths or more), kept (whether that is its own id).

    Documents of equal sets are one node. Documents without words, or text, have an empty set and are linked with
    nothing, or all with each other if `empty_alike`. Rows with a null doc_id keep their row but give no name to a component (null if it has no other) and aren't kept; rows
    that repeat a doc_id with different texts connect the components of those texts only by name.
    """
    docs = documents.select("doc_id", "text")
    rows, bands = bands_for(docs.count(), least, miss)
    fps = checkpoint(signatures(docs, shingle, rows * bands))
    full = fps.where("n_shingles > 0").select("doc_id", "row", "n_shingles", "sig", _node().alias("node"))
    nodes = full.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min(F.struct("doc_id", "row")).alias("m"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    nodes = checkpoint(nodes.select("node", "node.*", "n_shingles", "sig", "m.*", "first", "n"))
    roots = links(docs, nodes.drop("node", "first", "n"), rows, bands, shingle, least, miss, key_rows, block)
    own = nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = checkpoint(own)
    names = own.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    names = checkpoint(names)
    named = spread_join(own.select("node", "root"), names.select("root", "component_id"), "root", names.select("root", "n"), own.count(), ["node"], "inner", key_rows)
    found = spread_join(full.drop("sig"), named.select("node", "component_id"), "node", own.select("node", "n"), full.count(), ["doc_id", "row"], "inner", key_rows)
    found = found.select("doc_id", "n_shingles", "component_id")
    alone = fps.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if empty_alike:
        alone = alone.drop("component_id").crossJoin(F.broadcast(alone.agg(F.min("doc_id").alias("component_id"))))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(documents: DataFrame, shingle: int = COPY_SHINGLE, **how) -> DataFrame:
    """The documents whose doc_id is their component's id in near_duplicates(), rows and columns as they are; rows with a null doc_id stay.

    Rows that repeat a doc_id stay or go together: they go only if all of them lie in components of other ids. Documents without words are copies of each other.
    """
    found = near_duplicates(documents.where("doc_id is not null"), shingle, empty_alike=True, **how)
    later = found.groupBy("doc_id").agg(F.bool_and(~F.col("kept")).alias("later")).where("later").select("doc_id")
    return boxed(documents).join(later, F.col("row.doc_id") == F.col("doc_id"), "left_anti").select("row.*")
