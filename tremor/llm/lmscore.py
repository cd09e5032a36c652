"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import checkpoint, crc_mod, release, spread_join
from tremor.llm.langid import text_chunks

#: Bits of the filter for each member at least, and the least log2 of its bits; it has no largest size.
BITS_A_MEMBER, LEAST_LOG2 = 8, 22
#: A filter of up to 2**26 bits, 8 MB, is sent to each worker; of a larger one, the segments stay in a table.
SENT_LOG2 = 26
#: The filter is made in 2**CUT segments at least, each of the n-grams whose ids begin with its number; more if they would
#: have over 2**SEGMENT_LOG2 bits. In the table, up to 2**RUN_LOG2 neighbours are probed together.
CUT, SEGMENT_LOG2, RUN_LOG2 = 10, 22, 5
#: Bytes of an id that the filter knows beside its segment. A segment has half a million members at most, so another id of
#: the same bytes is there with a probability of 1.3e-4, far below that of the filter's own false hits.
WIDTH = 4
#: Bytes of texts that look up their n-grams together.
CHUNK = 1 << 22
SEGMENT_COUNTS = "segment int, ids binary, counts binary"
#: A count c is held as the number of steps 1, 2, 3, 4, 6, 8, 12, 16 .. up to c: a member for each level up to its own.
STEPS = np.array([1] + [s << k for k in range(40) for s in (2, 3)], np.int64)
#: Words of exact counts that are sent to the workers; the counts of all others are joined.
HEAD = 1 << 19
#: Weight of a word's share of its predecessor's successors; the rest is that of its share of all tokens. From a pair's
#: count DISCOUNT is taken off first, so a pair that is there but once says little.
WEIGHT, DISCOUNT = 0.5, 0.75

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Ids have 58 bits, so one takes 6 bytes where the first 10 are known.
KEPT = np.uint64((1 << 64) - (1 << 6))
END = np.int64(0x6A09E667F3BCC900)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_ids(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(ids, row): 64-bit ids of all words and each text's end, in order, and the row of each. A-Z is lower-cased.

    A word's id is mixed from its length and the sum of its groups of 8 bytes, each mixed with its place.
    """
    up = (data >= 65) & (data <= 90)
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = np.where(up, data + 32, data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[lengths > 0]] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    first = np.flatnonzero(~blank & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:] | edge[1:-1]
    size = np.flatnonzero(~blank & after) + 1 - first
    eights = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    groups = (size + 7) // 8
    nth = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
    rest = np.minimum(np.repeat(size, groups) - 8 * nth, 8).astype(np.uint64)
    inside = np.uint64((1 << 64) - 1) >> (np.uint64(64) - np.uint64(8) * rest)
    with np.errstate(over="ignore"):
        mixed = _mix((eights[np.repeat(first, groups) + 8 * nth] & inside) + _mix((nth + 1).astype(np.uint64)))
        sums = np.add.reduceat(mixed, np.cumsum(groups) - groups) if len(groups) else mixed
        ids = (_mix(sums + size.astype(np.uint64)) & KEPT).view(np.int64)
    row = np.searchsorted(starts + lengths, first, "right")
    order_row = np.concatenate([row, np.arange(len(lengths))])
    count = np.bincount(row, minlength=len(lengths))
    out, rows = np.empty(len(order_row), np.int64), np.empty(len(order_row), np.int64)
    place = np.arange(len(row)) + row
    ends = np.cumsum(count) + np.arange(len(lengths))
    out[place], rows[place] = ids, row
    out[ends], rows[ends] = END, np.arange(len(lengths))
    return out, rows


def shifted(values: np.ndarray, rows: np.ndarray, first) -> np.ndarray:
    """The value of each token's predecessor; `first` for the first token of a text."""
    prev = np.empty_like(values)
    prev[1:] = values[:-1]
    prev[np.flatnonzero(np.diff(rows, prepend=-1))] = first
    return prev


def pair_ids(prev: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of (previous token, token)."""
    with np.errstate(over="ignore"):
        return (_mix(prev.view(np.uint64) * np.uint64(3) + _mix(ids.view(np.uint64) + np.uint64(1))) & KEPT).view(np.int64)


def _counted(batches, pairs: bool):
    """(ids, counts) of all tokens of the texts, or of all pairs of tokens that follow each other, in pieces."""
    for batch in batches:
        for _, data, starts, lengths in text_chunks(batch.column("text"), 1 << 22):
            ids, rows = token_ids(data, starts, lengths)
            yield np.unique(pair_ids(shifted(ids, rows, END), ids) if pairs else ids, return_counts=True)


def _merged(pieces, size: int = 1 << 20):
    """Pieces of (ids, counts) added up to pieces of about `size` ids or more, in the order of the ids as unsigned numbers."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n > size:
            yield summed(held)
            held, n = [], 0
    if held:
        yield summed(held)


def _unigrams(training: DataFrame) -> DataFrame:
    """(id, n) of all tokens of the texts: one or more rows an id."""

    def run(batches):
        for ids, n in _merged(_counted(batches, pairs=False)):
            yield pa.RecordBatch.from_pydict({"id": ids, "n": n})

    return training.select("text").mapInArrow(run, "id long, n long")


def low_bytes(ids: np.ndarray, known: int = CUT, width: int = 6) -> bytes:
    """Ids without their first `known` bits, the next `width` bytes of each."""
    rest = ((ids.view(np.uint64) << np.uint64(known)) >> np.uint64(64 - 8 * width)).astype("<u8")
    return rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_low_bytes(data: bytes, first, known: int = CUT, width: int = 6) -> np.ndarray:
    """Ids from low_bytes() and their first `known` bits; bits that it left out are 0."""
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    rest = (raw.reshape(-1).view("<u8") << np.uint64(64 - 8 * width)) >> np.uint64(known)
    return (rest | (np.asarray(first).astype(np.uint64) << np.uint64(64 - known))).view(np.int64)


def by_segment(pieces, cut: int):
    """Record batches (segment, ids, counts) of pieces: the ids of each segment as bytes of low_bytes() and their counts."""
    for ids, n in pieces:
        segs = (ids.view(np.uint64) >> np.uint64(64 - cut)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(segs, prepend=-1))
        ends = [*cuts[1:], len(segs)]
        yield pa.RecordBatch.from_pydict({
            "segment": segs[cuts].astype(np.int32),
            "ids": pa.array([low_bytes(ids[a:b], cut, WIDTH) for a, b in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        })


def segment_counts(training: DataFrame, cut: int) -> DataFrame:
    """(segment, ids, counts) of all pairs of tokens of the texts."""
    return training.select("text").mapInArrow(lambda batches: by_segment(_merged(_counted(batches, pairs=True)), cut), SEGMENT_COUNTS)


def segment_rows(counts: DataFrame, cut: int) -> DataFrame:
    """(segment, ids, counts) of rows (id, n)."""

    def run(batches):
        pieces = ((np.asarray(b.column("id")), np.asarray(b.column("n"))) for b in batches if b.num_rows)
        yield from by_segment(_merged(pieces), cut)

    return counts.select("id", "n").mapInArrow(run, SEGMENT_COUNTS)


def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) from several pairs of arrays."""
    ids, back = np.unique(np.concatenate([x for x, _ in held]).view(np.uint64), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate([x for _, x in held]), minlength=len(ids))
    return ids.view(np.int64), n.astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, "right")


def filter_log2(members: int) -> int:
    """log2 of the filter's bits: BITS_A_MEMBER for each member, or up to twice as many."""
    return max(LEAST_LOG2, (BITS_A_MEMBER * members).bit_length())


def _bits(ids: np.ndarray, j, log2: int, cut: int) -> list[np.ndarray]:
    """Two places of each id's level j within the filter of 2**log2 bits, both in the id's segment. Of the id, its first
    cut bits and the next WIDTH bytes count."""
    ids = ids.view(np.uint64) & np.uint64((1 << 64) - (1 << max(0, 64 - cut - 8 * WIDTH)))
    with np.errstate(over="ignore"):
        h = _mix(ids + np.uint64(j) * _ODD)
    inner = np.uint64(log2 - cut)
    base = (ids >> np.uint64(64 - cut)) << inner
    mask = (np.uint64(1) << inner) - np.uint64(1)
    return [base | (h & mask), base | ((h >> np.uint64(32)) & mask)]


def build_segments(counts: DataFrame, log2: int, cut: int = CUT) -> DataFrame:
    """(segment, bits, members), written through a checkpoint: the filter of 2**log2 bits in 2**cut segments, without empty
    ones, from rows (segment, ids, counts). These are shuffled once, by segment, and sorted, and each segment is made
    from its own rows, which are as many ids as it has bits for."""
    width = (1 << log2) >> cut

    def made(segment: int, held: list) -> pa.RecordBatch:
        ids, n = summed(held)
        lev, bits, members = level(n), np.zeros(width, bool), 0
        for j in range(1, int(lev.max(initial=0)) + 1):
            for at in _bits(ids[lev >= j], j, log2, cut):
                bits[at % np.uint64(width)] = True
            members += int((lev >= j).sum())
        return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "members": pa.array([members], pa.int64())})

    def fill(batches):
        last, held = None, []
        for batch in batches:
            for s, x, n in zip(batch.column("segment").to_pylist(), batch.column("ids"), batch.column("counts")):
                if s != last and held:
                    yield made(last, held)
                    held = []
                last = s
                ids = from_low_bytes(x.as_py(), s, cut, WIDTH)
                held.append((ids, np.frombuffer(n.as_py(), "<u4").astype(np.int64)))
                if len(held) > 64:
                    held = [summed(held)]
        if held:
            yield made(last, held)

    rows = counts.repartition("segment") if cut == CUT else counts.repartition(1 << (cut - RUN_LOG2), "segment")
    return checkpoint(rows.sortWithinPartitions("segment").mapInArrow(fill, "segment int, bits binary, members long"))


def folded(segments: DataFrame, log2: int, cut: int = CUT) -> DataFrame:
    """(segment, bits) of the filter of 2**log2 bits, from the segments of the same or a larger one: halves are laid over each other."""
    size = ((1 << log2) >> cut) // 8

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("bits"):
                seg = np.frombuffer(x.as_py(), np.uint8)
                while len(seg) > size:
                    seg = seg[: len(seg) // 2] | seg[len(seg) // 2 :]
                out.append(seg.tobytes())
            yield pa.RecordBatch.from_pydict({"segment": batch.column("segment"), "bits": pa.array(out, pa.binary())})

    return segments.select("segment", "bits").mapInArrow(run, "segment int, bits binary")


def gathered(segments: DataFrame, log2: int, cut: int = CUT) -> np.ndarray:
    """The folded segments of a filter of 2**log2 bits as bytes on the driver."""
    size = ((1 << log2) >> cut) // 8
    out = np.zeros((1 << log2) // 8, np.uint8)
    for r in segments.toLocalIterator():
        out[r.segment * size : (r.segment + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def build_filter(counts: DataFrame, log2: int) -> np.ndarray:
    """The filter of 2**log2 bits as bytes on the driver, from rows (id, n)."""
    return gathered(build_segments(segment_rows(counts, CUT), log2), log2)


def probe(bits: np.ndarray, log2: int, ids: np.ndarray, cut: int = CUT, first: int = 0) -> np.ndarray:
    """The level of each id: how many levels in a row are members. `bits` begins with the filter's bit number `first`."""
    lev = np.zeros(len(ids), np.int64)
    live = np.arange(len(ids))
    for j in range(1, len(STEPS) + 1):
        a, b = (x - np.uint64(first) for x in _bits(ids[live], j, log2, cut))
        hit = (bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
        live = live[hit.astype(bool)]
        if not len(live):
            break
        lev[live] = j
    return lev


def _distinct(ids: np.ndarray, rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The distinct ids of tokens but those in `known`, and of all pairs, as unsigned numbers in order."""
    tokens = np.unique(ids)
    return np.unique(np.concatenate([tokens[~_inside(known, tokens)[1]], pair_ids(shifted(ids, rows, END), ids)]).view(np.uint64))


def _inside(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each id in the sorted keys, whether it is there)."""
    at = np.minimum(np.searchsorted(keys, ids), max(len(keys) - 1, 0))
    return at, keys[at] == ids if len(keys) else np.zeros(len(ids), bool)


def with_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, texts): the rows of docs in the order in which they are read, about CHUNK bytes of texts packed into one compressed
    value. Files are cut the same way whenever they are read in a query, so the chunks are."""

    def pack(batches):
        for batch in batches:
            for i, _, _, lengths in text_chunks(batch.column("text"), CHUNK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(i, len(lengths)))
                yield pa.RecordBatch.from_pydict({"texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return docs.mapInArrow(pack, "texts binary").withColumn("chunk", F.monotonically_increasing_id())


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of docs in one chunk of with_chunks()."""
    return pa.ipc.open_stream(table.column("texts")[0].as_buffer()).read_all()


def chunk_ids(table: pa.Table, known: np.ndarray) -> np.ndarray:
    (_, *texts), = text_chunks(table.column("text").combine_chunks(), 1 << 40)
    return _distinct(*token_ids(*texts), known)


def probes(texts: DataFrame, cut: int, shared) -> DataFrame:
    """(chunk, run, segments, ids): the distinct ids that each chunk's texts look up in each run of segments, in order: the
    place of each one's segment in the run, and low_bytes(). Words of the head, the broadcast's first array, aren't looked up."""

    def asked(table: pa.Table) -> pa.Table:
        ids = chunk_ids(unpacked(table), shared.value[0])
        segs = (ids >> np.uint64(64 - cut)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(segs >> RUN_LOG2, prepend=-1))
        spans = list(zip(cuts, [*cuts[1:], len(ids)]))
        return pa.table({
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(spans), pa.int64()),
            "run": (segs[cuts] >> RUN_LOG2).astype(np.int32),
            "segments": pa.array([(segs[a:b] % (1 << RUN_LOG2)).astype(np.uint8).tobytes() for a, b in spans], pa.binary()),
            "ids": pa.array([low_bytes(ids[a:b], cut, WIDTH) for a, b in spans], pa.binary()),
        })

    return texts.groupBy("chunk").applyInArrow(asked, "chunk long, run int, segments binary, ids binary")


def answers(asked: DataFrame, segments: DataFrame, log2: int, cut: int) -> DataFrame:
    """(chunk, run, levels): probes meet the segments of their run, and a byte for each id gives its level."""
    size = ((1 << log2) >> cut) // 8

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        runs = left.column("run").to_pylist()
        bits, out = np.zeros(size << RUN_LOG2, np.uint8), []
        for s, x in zip(right.column("segment").to_pylist(), right.column("bits")):
            k = s % (1 << RUN_LOG2)
            bits[k * size : (k + 1) * size] = np.frombuffer(x.as_py(), np.uint8)
        for r, k, x in zip(runs, left.column("segments"), left.column("ids")):
            ids = from_low_bytes(x.as_py(), np.frombuffer(k.as_py(), np.uint8).astype(np.int64) + (r << RUN_LOG2), cut, WIDTH)
            out.append(probe(bits, log2, ids, cut, (r * 8 * size) << RUN_LOG2).astype(np.uint8).tobytes())
        return pa.table({"chunk": pa.array(left.column("chunk").to_pylist(), pa.int64()), "run": pa.array(runs, pa.int32()), "levels": pa.array(out, pa.binary())})

    runs = segments.withColumn("run", F.shiftright("segment", RUN_LOG2))
    return asked.groupBy("run").cogroup(runs.groupBy("run")).applyInArrow(look, "chunk long, run int, levels binary")


def model_log10(own, before, c2, mass: float, kinds: int) -> np.ndarray:
    """log10 probability of tokens from levels: of the token, of its predecessor and of the pair.

    A token's share of its predecessor's successors, DISCOUNT off the pair's count, is mixed with its share of all tokens. A pair's count is taken at
    its level's least and its predecessor's at its most, so no predecessor has shares of over one. After a word that
    training lacks, only the share of all tokens counts.
    """
    p1 = (estimate(own) + 0.1) / (mass + 0.1 * (kinds + 1))
    least, most = np.concatenate([[0], STEPS]), np.concatenate([[1], STEPS[1:] - 1, STEPS[-1:] * 2])
    share = np.minimum(np.maximum(least[c2] - DISCOUNT, 0) / most[before], 1.0)
    trust = np.where(before > 0, WEIGHT, 0.0)
    return np.log10((1 - trust) * p1 + trust * share)


def estimate(lev: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of those that it holds."""
    middle = np.concatenate([[0.0], (STEPS[:-1] + STEPS[1:] - 1) / 2, STEPS[-1:]])
    return middle[lev]


def score(documents: DataFrame, head: int = HEAD, sent_log2: int = SENT_LOG2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts whose crc32(doc_id as text) mod 10 isn't 0, all of them. Tokens are known by 64-bit ids. Exact
    counts of the `head` most frequent words, a bounded table, are sent to the workers; tokens of all other words are
    joined with their counts by id, one row a word and text, and a word of very many texts is dealt over tasks. The filter grows with its members; one of up
    to 2**sent_log2 bits is sent too, and of a larger one the segments stay in a table: the distinct n-grams of each chunk of
    texts are shuffled to their segments, and their levels back to the chunk. A null text is an empty one: its end is its only
    token. A null id counts as an empty id text. Every row gives a row, repeated ones too. Without training tokens all
    counts are 0 and each token has probability 1.
    """
    spark = documents.sparkSession
    held = (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out")
    docs = documents.select("doc_id", "text", held)
    training = docs.where("not held_out")
    unigrams = checkpoint(_unigrams(training).groupBy("id").agg(F.sum("n").alias("n")))
    binary = F.bin("n")  # its length and second digit give the level
    lev = F.greatest(2 * (F.length(binary) - 1) + (F.substring(binary, 2, 1) == "1").cast("int"), F.lit(1))
    steps = {r.k: r for r in unigrams.groupBy(lev.alias("k")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}  # a row per level
    total, kinds = sum(r.n for r in steps.values()), sum(r.v for r in steps.values())
    mass = float(sum(estimate(np.array([k]))[0] * r.v for k, r in steps.items()))
    raw = filter_log2(total)  # a count has no more levels than tokens, and most have fewer; folded below
    cut = max(CUT, raw - SEGMENT_LOG2)
    least, room = len(STEPS), head
    while least > 1 and room >= (steps[least - 1].v if least - 1 in steps else 0):
        least -= 1
        room -= steps[least].v if least in steps else 0
    floor = int(STEPS[least - 1])
    top = unigrams.where(F.col("n") >= F.lit(floor)).toArrow()  # at most `head` words
    order = np.argsort(ids := np.asarray(top.column("id").combine_chunks()))
    keys_n = ids[order], np.asarray(top.column("n").combine_chunks())[order]
    del top, ids
    segments = build_segments(segment_counts(training, cut).unionByName(segment_rows(unigrams, cut)), raw, cut)
    release(spark)
    log2 = min(raw, filter_log2(segments.agg(F.sum("members")).first()[0] or 0))
    segments = folded(segments, log2, cut)
    near = log2 <= sent_log2
    shared = spark.sparkContext.broadcast((*keys_n, gathered(segments, log2, cut) if near else None))
    norm = np.log10(max(total + 0.1 * (kinds + 1), 0.1))

    def scored(batch, look, **step):
        keys, freq, _ = shared.value
        n = batch.num_rows
        tokens, known, base, model = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        rare, rare_rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, data, starts, lengths in text_chunks(batch.column("text"), **step):
            ids, rows = token_ids(data, starts, lengths)
            uniq, back = np.unique(ids, return_inverse=True)
            at, inside = _inside(keys, uniq)
            count = np.where(inside, freq[at], 0) if len(keys) else np.zeros(len(uniq), np.int64)
            found, m = inside[back], len(lengths)
            tokens[i : i + m] = np.bincount(rows, minlength=m)
            known[i : i + m] = np.bincount(rows[found], minlength=m)
            base[i : i + m] = np.bincount(rows[found], weights=(np.log10(count + 0.1) - norm)[back][found], minlength=m)
            lev = level(count)  # exact for words of the head, looked up for others
            lev[~inside] = look(uniq[~inside])
            prev = shifted(ids, rows, END)
            before = shifted(lev[back], rows, lev[np.searchsorted(uniq, END)])
            pairs, place = np.unique(pair_ids(prev, ids), return_inverse=True)
            c2 = look(pairs)[place]
            model[i : i + m] = np.bincount(rows, weights=model_log10(lev[back], before, c2, mass, kinds), minlength=m)
            rare.append(ids[~found])
            rare_rows.append(rows[~found] + i)
        rare, rare_rows = np.concatenate(rare), np.concatenate(rare_rows)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rare_rows, minlength=n))]).astype(np.int32)), pa.array(rare))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": tokens, "known": known, "base": base, "score": model, "rare": lists}

    def run(batches):
        flt = shared.value[2]
        for batch in batches:
            yield pa.RecordBatch.from_pydict(scored(batch, lambda ids: probe(flt, log2, ids, cut)))

    def joined_up(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = unpacked(left).combine_chunks().to_batches()[0]
        ids = chunk_ids(pa.Table.from_batches([batch]), shared.value[0])
        order = np.argsort(np.asarray(right.column("run")))
        levels = right.column("levels").to_pylist()
        lev = np.frombuffer(b"".join(levels[k] for k in order), np.uint8).astype(np.int64)
        return pa.table(scored(batch, lambda x: lev[np.searchsorted(ids, x.view(np.uint64))], step=1 << 40))

    kind = dict(documents.dtypes)["doc_id"]
    fields = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>"
    if near:
        rows = docs.mapInArrow(run, fields)
    else:
        texts = with_chunks(docs)
        levels = answers(probes(texts, cut, shared), segments, log2, cut)
        rows = texts.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(joined_up, fields)
    rows = checkpoint(rows).withColumn("row", F.monotonically_increasing_id())
    release(spark)
    tail = unigrams.where(F.col("n") < F.lit(floor)).withColumnRenamed("n", "freq")
    once = checkpoint(rows.select("row", F.explode("rare").alias("id")).groupBy("row", "id").agg(F.count("*").alias("times")))
    sizes = once.groupBy("id").agg(F.count("*").alias("n"))
    joined = spread_join(once, tail, "id", sizes, once.count(), ["row"], "left")
    log = F.log10(F.coalesce("freq", F.lit(0)) + 0.1) - float(norm)
    more = joined.groupBy("row").agg(F.sum(log * F.col("times")).alias("more"), F.sum(F.when(F.col("freq") > 0, F.col("times")).otherwise(0)).alias("seen"))
    known = F.col("known") + F.coalesce("seen", F.lit(0))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    out = rows.join(more, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
