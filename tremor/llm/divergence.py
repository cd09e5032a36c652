"""Source divergence audit: terms counted again by source in the dense slots of minimal perfect hashes, and how far sources lie apart."""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import checkpoint, lower_ascii
from tremor.llm.spans import LETTERS, Spans, mix, pieces

#: Terms are runs of ASCII letters and non-ASCII characters.
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a term must be in.
LEAST = 10
#: Terms of a shard, about; a shard's hash is built in one task.
SHARD = 1 << 16
#: Bytes of terms that are broadcast at a time. More shards go out in further passes over the texts.
SENT = 1 << 26
#: Bytes of dense slots that a task holds before it hands on what it has counted.
DENSE = 1 << 26
#: Slots and sources of a piece of the comparison of sources.
SLOTS, SOURCES = 1 << 12, 256
#: Positions of a level for each key that is left; levels until keys left are listed.
SPACE, LEVELS = 1.5, 40
UNIT = 1_000_000_000


def plain(documents: DataFrame) -> DataFrame:
    """(lang, source, text), null being the empty text."""
    return documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of the terms in at least `least` documents of a language: each row is a document of its own."""
    terms = F.array_distinct(F.array_remove(F.split(lower_ascii(F.col("text")), NOT_LETTERS), ""))
    return texts.select("lang", F.explode(terms).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("lang", "term")


def _at(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))


def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def perfect_hash(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes, bits, order): a minimal perfect hash of 64-bit numbers.

    At each level, numbers that have a position of the level for themselves set its bit, and the others go to the next. A
    number's slot is the count of bits before its own over all levels, so slots are 0, 1, .. without gaps. order lists the
    numbers by slot. Numbers that no level tells apart, equal ones, come last and have no bit.
    """
    sizes, bits, order, left = [], [], [], np.arange(len(h))
    while len(left) and len(sizes) < LEVELS:
        size = 64 * (1 + int(SPACE * len(left)) // 64)
        at = (_at(h[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        hits = np.bincount(at, minlength=size)
        alone = hits[at] == 1
        bits.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
        order.append(left[alone][np.argsort(at[alone])])
        sizes.append(size)
        left = left[~alone]
    return sizes, np.concatenate([np.zeros(0, np.uint64), *bits]), np.concatenate([np.zeros(0, np.int64), *order, left])


class Slots:
    """The perfect hashes of some shards, which give a term of a language its slot, if it is one of theirs.

    shards: rows (lang, shard, shards, base, n, blob), where `shards` is how many the language has and base its terms in shards before.
    """

    def __init__(self, shards: list[tuple]):
        shards = sorted(shards, key=lambda r: (r[0], r[1]))
        self.langs: dict[str, tuple[int, dict[int, int]]] = {}
        for k, (lang, shard, many, _, _, _) in enumerate(shards):
            self.langs.setdefault(lang, (many, {}))[1][shard] = k
        parts = [pickle.loads(r[5]) for r in shards]
        depth = max([1, *(len(sizes) for sizes, _, _ in parts)])
        self.offset, self.size = np.zeros((len(parts), depth), np.int64), np.zeros((len(parts), depth), np.uint64)
        at = 0
        for k, (sizes, _, _) in enumerate(parts):
            for level, size in enumerate(sizes):
                self.offset[k, level], self.size[k, level] = at, size
                at += size
        self.words = np.concatenate([np.zeros(0, np.uint64), *(bits for _, bits, _ in parts)])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        n = np.array([r[4] for r in shards], np.int64)
        first, placed = np.cumsum(n) - n, np.array([int(np.bitwise_count(bits).sum()) for _, bits, _ in parts], np.int64)
        self.first, self.base = first, np.array([r[3] for r in shards], np.int64)
        self.bits_before = np.cumsum(placed) - placed  # less than first where a shard before has numbers without a bit
        keys = b"".join(keys for _, _, keys in parts)
        data = np.frombuffer(keys, np.uint8)
        self.terms = Spans(data, np.flatnonzero(data == 0x20), LETTERS)  # a term a text, in the order of slots
        self.rest = {}  # terms whose number is that of another one
        for k, r in enumerate(shards):
            for slot in range(placed[k], n[k]):
                self.rest[r[0], self.terms.word(first[k] + slot)] = r[3] + slot
        self.rest_hashes = np.array([self.terms.hash[first[k] + s] for k in range(len(parts)) for s in range(placed[k], n[k])], np.uint64)

    def find(self, s: Spans, langs: list[str]) -> np.ndarray:
        """The slot within its language of each word of s, whose text's language is langs[doc]; -1 for other words."""
        codes = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        of_doc = np.array([codes[lang] for lang in langs], np.int64)
        hashes = np.array([_lang_hash(lang) for lang in codes], np.uint64)
        out, where = np.full(len(s.start), -1, np.int64), np.full(len(s.start), -1, np.int64)
        h = mix(s.hash ^ hashes[of_doc[s.doc]])
        for lang, code in codes.items():
            if lang in self.langs:
                many, places = self.langs[lang]
                place = np.full(many, -1, np.int64)
                place[list(places)] = list(places.values())
                mine = np.flatnonzero(of_doc[s.doc] == code) if len(codes) > 1 else np.arange(len(h))
                where[mine] = place[(h[mine] % np.uint64(many)).astype(np.int64)]
        left = np.flatnonzero(where >= 0)
        for level in range(self.size.shape[1]):
            k = where[left]
            deep = self.size[k, level] > 0
            left, k = left[deep], k[deep]
            if not len(left):
                break
            at = self.offset[k, level] + (_at(h[left], level) % self.size[k, level]).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            got, below = left[hit], word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot = self.rank[at[hit] >> 6] + np.bitwise_count(below) - self.bits_before[k[hit]]
            right = s.same(got, self.terms, self.first[k[hit]] + slot)
            out[got[right]] = self.base[k[hit]][right] + slot[right]
            left = left[~hit]
        if self.rest:
            for i in np.flatnonzero((out < 0) & np.isin(s.hash, self.rest_hashes)):
                out[i] = self.rest.get((langs[s.doc[i]], s.word(i)), -1)
        return out


@lru_cache(maxsize=1)
def _slots(sent) -> Slots:
    return Slots(sent.value)


def shard_hashes(kept: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, shard, shards, n, blob): the terms of each language dealt to shards of about `shard` terms by their hash, each with its perfect hash and its terms in the order of slots."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))

    def deal(batches):
        for batch in batches:
            for i, j, data, ends in pieces(batch.column("term")):
                part = batch.slice(i, j - i)
                langs = np.array([_lang_hash(x) for x in part.column("lang").to_pylist()], np.uint64)
                h = mix(Spans(data, ends, LETTERS).hash ^ langs)  # a term a text
                own = (h % np.asarray(part.column("shards")).astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "term": part.column("term"), "shards": part.column("shards"), "shard": pa.array(own), "h": pa.array(h.view(np.int64))})

    def build(table: pa.Table) -> pa.Table:
        h = np.asarray(table.column("h").combine_chunks()).view(np.uint64)
        terms = table.column("term").to_pylist()
        sizes, bits, order = perfect_hash(h)
        blob = pickle.dumps((sizes, bits, b"".join(terms[k].encode() + b" " for k in order)), 5)
        first = table.slice(0, 1)
        return pa.table({"lang": first.column("lang"), "shard": first.column("shard"), "shards": first.column("shards"), "n": pa.array([len(h)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    dealt = kept.join(sizes, "lang").select("lang", "term", "shards").mapInArrow(deal, "lang string, term string, shards int, shard int, h long")
    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, shards int, n long, blob binary")


def recount(texts: DataFrame, kept: DataFrame, shard: int = SHARD, sent: int = SENT, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """(counts, terms): counts has (lang, source, slot, n), how often each kept term, by its slot in its language, occurs in the
    language's documents of a source, where it does; terms has (lang, term, slot).

    The perfect hashes are broadcast, up to `sent` bytes of shards at a time, and each time one pass over the texts looks every
    word up, verifies it against the stored term and adds one to a slot of its group's dense array. A task that holds more than
    `dense` bytes of arrays hands their counts on and begins anew. Of the shards, the driver gets their sizes (a row a language and `shard` terms) and
    one broadcast at a time.
    """
    spark = texts.sparkSession
    shards = checkpoint(shard_hashes(kept, shard))
    sizes = shards.select("lang", "shard", "n", F.octet_length("blob").alias("bytes")).orderBy("lang", "shard").collect()
    rounds, base, before = [], {}, 0
    for r in sizes:
        base[r.lang, r.shard] = before = before if r.shard else 0
        before += r.n
        if not rounds or sum(x.bytes for x in rounds[-1]) + r.bytes > sent:
            rounds.append([])
        rounds[-1].append(r)
    counts = spark.createDataFrame([], "lang string, source string, slot long, n long")
    terms = spark.createDataFrame([], "lang string, term string, slot long")
    for part in rounds:
        chosen = spark.createDataFrame([(r.lang, r.shard, base[r.lang, r.shard]) for r in part], "lang string, shard int, base long")
        rows = shards.join(F.broadcast(chosen), ["lang", "shard"]).select("lang", "shard", "shards", "base", "n", "blob").collect()  # `sent` bytes at most
        table = spark.sparkContext.broadcast([tuple(r[:5]) + (bytes(r.blob),) for r in rows])

        def count(batches, table=table):
            slots, arrays, held = _slots(table), {}, 0
            many = {}
            for r in table.value:
                many[r[0]] = max(many.get(r[0], 0), r[3] + r[4])

            def out():
                for (lang, source), array in arrays.items():
                    slot = np.flatnonzero(array)
                    yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(slot)), "source": pa.repeat(source, len(slot)), "slot": slot, "n": array[slot]})

            for batch in batches:
                for i, j, data, ends in pieces(batch.column("text")):
                    langs, sources = (batch.column(c).slice(i, j - i).to_pylist() for c in ("lang", "source"))
                    s = Spans(data, ends, LETTERS, lower=True)
                    slot = slots.find(s, langs)
                    codes: dict[tuple, int] = {}
                    of_doc = np.array([codes.setdefault(x, len(codes)) for x in zip(langs, sources)], np.int32)
                    known = np.flatnonzero(slot >= 0)
                    group = of_doc[s.doc[known]]
                    known, group = known[np.argsort(group, kind="stable")], np.sort(group)
                    cuts = np.searchsorted(group, np.arange(len(codes) + 1))
                    for (lang, source), code in codes.items():
                        own = slot[known[cuts[code] : cuts[code + 1]]]
                        if not len(own):
                            continue
                        if (lang, source) not in arrays:
                            arrays[lang, source] = np.zeros(many[lang], np.int64)
                            held += 8 * many[lang]
                        np.add.at(arrays[lang, source], own, 1)
                    if held > dense:
                        yield from out()
                        arrays, held = {}, 0
            yield from out()

        def number(batches, table=table):
            slots = _slots(table)
            for batch in batches:
                for i, j, data, ends in pieces(batch.column("term")):
                    slot = slots.find(Spans(data, ends, LETTERS), batch.column("lang").slice(i, j - i).to_pylist())
                    here = np.flatnonzero(slot >= 0)
                    yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").slice(i, j - i).take(here), "term": batch.column("term").slice(i, j - i).take(here), "slot": slot[here]})

        counts = counts.unionByName(texts.select("lang", "source", "text").mapInArrow(count, "lang string, source string, slot long, n long"))
        terms = terms.unionByName(kept.select("lang", "term").mapInArrow(number, "lang string, term string, slot long"))
    counts = counts.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))
    return checkpoint(counts), checkpoint(terms)


def _rate(n: str, total: str, v: str = "v") -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 v)), exact; null without kept terms."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div nullif(cast({total} + 2 * {v} as decimal(20, 0)), 0)")


def source_distances(counts: DataFrame, groups: DataFrame, slots: int = SLOTS, sources: int = SOURCES) -> DataFrame:
    """(lang, a, b, value) for sources numbered a < b of a language with kept terms: the sum over all its kept terms of
    floor((p - q)^2 / (p + q)).

    counts has (lang, g, slot, p) of terms that occur, groups (lang, g, v, p0) with the p of a term that doesn't. Slots and
    sources are cut into ranges, and a task compares two ranges of sources over one of slots: dense arrays of slots x sources numbers each.
    """
    most = groups.groupBy("lang").agg(F.floor(F.max("g") / sources).alias("last"))
    own = F.floor(F.col("g") / sources)

    def cut(df, shard):
        met = df.withColumn("shard", shard).join(most, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        return met.select("lang", "shard", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "g", "slot", "p", "v")

    base = groups.where("v > 0").select("lang", "g", "v", F.lit(-1).cast("long").alias("slot"), F.col("p0").alias("p"))
    base = cut(base, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / slots))))
    rows = cut(counts.select("lang", "g", "slot", "p", F.lit(0).cast("long").alias("v")), F.floor(F.col("slot") / slots))

    def compare(key, table):
        i, j = key[2].as_py(), key[3].as_py()
        g, slot, p, v = (np.asarray(table.column(c).combine_chunks()) for c in ("g", "slot", "p", "v"))
        shard = key[1].as_py()
        n = min(int(v.max()) - shard * slots, slots)
        is_base = slot < 0
        ids = np.sort(g[is_base])
        matrix = np.empty((len(ids), n), np.int64)
        matrix[np.searchsorted(ids, g[is_base])] = p[is_base][:, None]
        matrix[np.searchsorted(ids, g[~is_base]), slot[~is_base] - shard * slots] = p[~is_base]
        block = ids // sources
        out = []
        for k in range(len(ids)):
            if block[k] == i:
                others = np.flatnonzero((block == j) & (ids > ids[k]))
                for begin in range(0, len(others), 64):
                    some = others[begin : begin + 64]
                    far, both = matrix[some] - matrix[k], matrix[some] + matrix[k]
                    out.append(np.stack([np.full(len(some), ids[k]), ids[some], (far * far // both).sum(1)]))
        a, b, value = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.table({"lang": pa.repeat(key[0], len(a)), "a": a, "b": b, "value": value})

    piece = ["lang", "shard", "i", "j"]  # dealt by all four: what is already dealt by language would pass for it
    parts = base.unionByName(rows).repartition(*piece).groupBy(*piece).applyInArrow(compare, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(documents: DataFrame, least: int = LEAST, top: int = 10, shard: int = SHARD, sent: int = SENT, dense: int = DENSE, slots: int = SLOTS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) that occurs: part `pair` ranks the other sources of the
    language by how far their terms lie from its own, part `term` has the `top` terms that it uses more than its language does.

    A language keeps the terms in at least `least` of its documents. A group, and a language, gives each kept term
    p = 1 + floor(10^9 (n + 2) / (N + 2 V)), and two such numbers lie floor((p - q)^2 / (p + q)) apart; all of it exact. Null
    lang, source and text are the empty text; rows that repeat a doc_id count each. Groups of a language without kept terms have value 0
    to each other; a language of one source has no pairs. Ties go to the item first in UTF-8. Empty documents give no rows.
    """
    texts = plain(documents)
    kept = checkpoint(kept_terms(texts, least))
    counts, terms = recount(texts, kept, shard, sent, dense)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = texts.groupBy("lang", "source").agg(F.count("*").alias("docs")).join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", number.alias("g"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = checkpoint(groups.withColumn("p0", _rate("0", "total")))
    rows = checkpoint(counts.join(groups, ["lang", "source"]).withColumn("p", _rate("n", "total")))
    apart = source_distances(rows.select("lang", "g", "slot", "p"), groups.select("lang", "g", "v", "p0"), slots, sources)
    apart = checkpoint(apart.select("lang", "a", "b", "value").unionByName(apart.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")))
    named = lambda c, name: groups.select("lang", F.col("g").alias(c), F.col("source").alias(name))
    pairs = apart.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    bare = groups.where("v = 0")  # languages without kept terms, where all sources are alike
    alike = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.unionByName(alike.withColumn("value", F.lit(0).cast("long"))).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    all_of = W.partitionBy("lang", "slot")  # a row for each source
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    used = rows.withColumn("m", F.sum("n").over(all_of)).join(whole, "lang").withColumn("q", _rate("m", "all")).where("p > q")
    used = used.join(terms, ["lang", "slot"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(used.withColumn("rank", rank).where(F.col("rank") <= top))
