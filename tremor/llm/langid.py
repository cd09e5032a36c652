"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import boxed, checkpoint

ORDER = 3
#: Code lengths are held as whole numbers of 2**-16 bits, so their sums are exact and don't depend on any order.
UNIT = 1 << 16
#: Bytes of text that one numpy step works on.
STEP = 1 << 20


def text_chunks(column: pa.ChunkedArray | pa.Array, step: int = STEP):
    """(first row, bytes, starts, lengths) over a string column, in runs of rows of about `step` bytes; null is empty."""
    for arr in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        arr = arr.cast(pa.large_binary()).fill_null(b"")
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
            j = min(j, len(arr))
            yield i, data[off[i] : off[j]], off[i:j] - off[i], np.diff(off[i : j + 1])
            i = j


def _context_codes(data, starts, lengths):
    """For each folded byte the number made of the ORDER bytes before it (white space before a text) and its own."""
    c = _FOLD[data].astype(np.uint32)
    first = starts[lengths > 0]
    code, prev = c.copy(), c
    for k in range(1, ORDER + 1):
        shifted = np.empty_like(prev)
        shifted[1:] = prev[:-1]
        shifted[first] = 32
        prev = shifted
        code |= prev << np.uint32(8 * k)
    return code


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[9:14] = 32
    return t


_FOLD = _fold()


def sample_training(documents: DataFrame, keep: Column, per_lang: int) -> DataFrame:
    """About `per_lang` whole documents of each language where `keep` holds, chosen by a hash of the id."""
    rows = documents.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return rows
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < rates[F.col("lang")] * (1 << 20))


def fit(documents: DataFrame, keep: Column, per_lang: int = 1500) -> dict:
    """Learn each language's byte contexts of up to ORDER bytes.

    The sample is bounded: about `per_lang` documents of each language (all, where there are fewer). Bytes are folded
    to lower case and white space, and every other byte keeps a value of its own. Returns the languages and the counts of
    (context, byte) that each language's sample has; no rows give a model without languages.
    """
    rows = checkpoint(sample_training(documents, keep, per_lang))

    def contexts(batches):
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for i, data, starts, lengths in text_chunks(batch.column("text")):
                code = _context_codes(data, starts, lengths)
                own = np.repeat(np.arange(len(lengths)), lengths)
                for lang in sorted(set(langs[i : i + len(lengths)])):
                    keys, n = np.unique(code[np.isin(own, np.flatnonzero(langs[i : i + len(lengths)] == lang))], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "code": keys.astype(np.int64), "n": n})

    counts = rows.mapInArrow(contexts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(counts["lang"].unique())
    return {"langs": langs, "width": 256, "counts": [(g["code"].to_numpy().astype(np.uint32), g["n"].to_numpy()) for g in (counts[counts["lang"] == x] for x in langs)]}


def _find(keys: np.ndarray, x: np.ndarray):
    """(place of each x in the sorted keys, whether it is there)."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def tables(model: dict) -> list:
    """For each order, of what any language has seen: the (context, byte) codes in order, their code lengths [code, language],
    the contexts in order and the lengths of their escapes [context, language], in UNIT-ths of a bit under escape method C."""
    out: list = []
    for order in range(ORDER + 1):
        mask = np.uint32((1 << (8 * order + 8)) - 1)
        own = [np.unique(codes & mask, return_inverse=True) for codes, _ in model["counts"]]
        keys = np.unique(np.concatenate([k for k, _ in own]))
        contexts = np.unique(keys >> np.uint32(8))
        context = np.searchsorted(contexts, keys >> np.uint32(8))
        escape = np.zeros((len(contexts), len(own)), np.int32)
        length = lengths_of(out, keys, len(own))
        for k, ((mine, inverse), (_, n)) in enumerate(zip(own, model["counts"])):
            c = np.bincount(inverse, weights=n)
            at = np.searchsorted(keys, mine)
            total, kinds = np.bincount(context[at], weights=c, minlength=len(contexts)), np.bincount(context[at], minlength=len(contexts))
            seen = kinds > 0
            escape[seen, k] = np.round(-np.log2(kinds[seen] / (total + kinds)[seen]) * UNIT)
            length[:, k] += escape[context, k]
            length[at, k] = np.round(-np.log2(c / (total + kinds)[context[at]]) * UNIT)
        out.append((keys, length, contexts, escape))
    return out


def lengths_of(found: list, codes: np.ndarray, langs: int) -> np.ndarray:
    """[code, language] -> code length in UNIT-ths of a bit, from the last order of the tables down to the uniform byte."""
    if not found:
        return np.full((len(codes), langs), 8 * UNIT, np.int32)
    *lower, (keys, length, contexts, escape) = found
    x = codes & np.uint32((1 << (8 * len(found))) - 1)
    at, hit = _find(keys, x)
    out = length[at]
    miss = np.flatnonzero(~hit)
    if len(miss):
        place, known = _find(contexts, x[miss] >> np.uint32(8))
        out[miss] = lengths_of(lower, x[miss], langs) + np.where(known[:, None], escape[place], 0)
    return out


def code_lengths(model: dict) -> np.ndarray:
    """[context and byte, language] -> code length, for all 256 bytes after each context that any language has seen."""
    found = tables(model)
    codes = (found[-1][2].astype(np.uint32)[:, None] << np.uint32(8)) | np.arange(256, dtype=np.uint32)
    return lengths_of(found, codes.ravel(), len(model["langs"]))


_built: dict = {}


def built(name: str, shared) -> list:
    """The tables of a broadcast model, made once in each worker process."""
    if name not in _built:
        _built.clear()  # one model at a time
        _built[name] = tables(shared.value)
    return _built[name]


def _judge(spark, model: dict):
    """A function (texts, ok) -> (language or und, score, bits a byte) for Arrow columns."""
    langs = model["langs"]
    shared = spark.sparkContext.broadcast(model)  # the contexts of the bounded sample
    name = uuid.uuid4().hex

    def run(text, ok):
        best, share, bits = np.zeros(len(text), np.int64), np.zeros(len(text)), np.zeros(len(text))
        if langs:
            found = built(name, shared)
            for i, data, starts, lengths in text_chunks(text, STEP // 4):
                if not len(data):
                    continue
                full = np.flatnonzero(lengths)
                sums = np.add.reduceat(lengths_of(found, _context_codes(data, starts, lengths), len(langs)), starts[full], axis=0, dtype=np.int64)
                rows, low = i + full, sums.min(1)
                best[rows] = sums.argmin(1)
                share[rows] = 1 / np.exp2(-np.minimum((sums - low[:, None]) / UNIT, 1000)).sum(1)
                bits[rows] = low / UNIT / lengths[full]
        names = np.asarray([*langs, "und"], object)[np.where(np.asarray(ok) & bool(langs), best, len(langs))]
        return names, np.where(names == "und", 0.0, share), bits

    return run


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("ok")


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1, the language's share of 2**-length) and bits (a byte's code
    length in that language).

    `und` with score 0 is given to null texts, texts without a letter, and all texts if the model has no language.
    Every row is judged on its own, repeated rows and null ids too. Ties go to the first language by name.
    """
    judge = _judge(documents.sparkSession, model)

    def run(batches):
        for batch in batches:
            names, share, bits = judge(batch.column("text"), batch.column("ok"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": share, "bits": bits})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text", _has_letter()).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double")


def accepted(documents: DataFrame, model: dict, least: float = 0.5, most_bits: float = 8.0) -> DataFrame:
    """The documents with a language; rows and columns stay as they are, whatever their names.

    Dropped are `und` documents (null, or without a letter), those that no language has a share of `least` in, and
    those whose code in the best language takes `most_bits` bits a byte or more: a text that no language codes in fewer
    bits than it has itself is of no learned language.
    """
    judge = _judge(documents.sparkSession, model)

    def run(batches):
        for batch in batches:
            names, share, bits = judge(pc.struct_field(batch.column("row"), "text"), batch.column("ok"))
            keep = pa.array((names != "und") & (share >= least) & (bits < most_bits))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row").filter(keep)})

    rows = boxed(documents, "text").select("row", _has_letter())
    return rows.mapInArrow(run, T.StructType([T.StructField("row", documents.schema)])).select("row.*")
