"""The corpus pipeline and its stages against plain Python, on rows with nulls, repeats and clashing column names."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_lines, jaccard, reach

import corpus_pipeline
from tremor.llm import mixing

NAMES = ["a.b", "mix_copies", "__gone", "__text", "row", "gone", "lines", "node", "key", "n", "`odd`"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)


def rows_of():
    rng = np.random.default_rng(7)
    en, fr = ["the", "house", "and", "river", "near", "old", "town", "is", "this", "what"], ["le", "chat", "noir", "dans", "maison", "très", "petite", "avec", "une", "été"]
    text = lambda pool, n: " ".join(pool[k] + str(rng.integers(40)) for k in rng.integers(0, 10, n))
    out = [(i, text(en, 90), "en", "s1") for i in range(30)] + [(i, text(fr, 90), "fr", "s2") for i in range(30, 50)]
    passage = text(en, 60)
    out += [(60, f"{text(en, 20)}\n{passage}\n{text(en, 20)}", "en", "s1"), (61, f"{text(en, 30)}\n{passage}", "en", None), (62, passage, None, "s1")]
    near = out[3][1].split()
    near[40] = "other"
    out += [(70, " ".join(near), "en", "s2"), (71, out[4][1], "en", "s2"), (72, out[5][1] + " ending words", "en", "s1")]
    out += [(80, None, "en", "s1"), (81, "", "en", "s1"), (82, "123 !!! 456", None, "s2"), (83, "x", "en", "s1"), (None, text(en, 40), "en", "s1"), (84, "the house " * 3000, "en", "s1")]
    out += [(64, "x " * 300 + text(en, 60), "en", "s1"), (65, "x " * 300 + text(en, 60), "en", "s1")]  # one fingerprint, but no copies
    out += [(85, text(en, 50), "en", "s1"), (85, text(fr, 50), "fr", "s1"), (86, text(en, 30), "en", "s2"), (86, None, "en", "s2")]
    return out + [out[2], out[2]]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *[f"{n}{i}" for n in NAMES]) for i, t, lang, s in rows], SCHEMA)


ITEM = " ".join(f"bench{i}" for i in range(30))


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM), (2, None), (None, "nothing")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, benchmark_dir):
    rows = rows_of()
    rows.append((90, "the river " * 10 + ITEM, "en", "s1"))
    rows.append((91, "the river " * 400 + ITEM, "en", "s1"))
    d = table(spark, rows)
    stage = dict(corpus_pipeline.STAGES)

    spoken = stage["language"](spark, d, benchmark_dir)
    assert spoken.columns == d.columns
    assert pairs(spoken) == Counter((i, t) for i, t, _, _ in rows if t and any(c.isalpha() for c in t))

    lines = stage["line_dedup"](spark, d, benchmark_dir)
    left = brute_lines([(i, t) for i, t, _, _ in rows], 50)
    assert lines.columns == d.columns
    assert pairs(lines) == Counter((i, left.get((i, t), t)) for i, t, _, _ in rows)

    near = stage["near_dedup"](spark, d, benchmark_dir)
    once = {(i, t) for i, t, _, _ in rows if i is not None}
    root = reach(range(len(once)), (lambda x: lambda a, b: jaccard(x[a][1], x[b][1]) >= 0.8)(sorted(once, key=repr)))
    least = {}
    for k, (i, t) in enumerate(sorted(once, key=repr)):
        least[root[k]] = min(i, least.get(root[k], i))
    stays = {i for k, (i, t) in enumerate(sorted(once, key=repr)) if least[root[k]] == i}
    assert near.columns == d.columns
    assert pairs(near) == Counter((i, t) for i, t, _, _ in rows if i is None or i in stays)

    clean = stage["decontaminate"](spark, d, benchmark_dir)
    assert clean.columns == d.columns
    assert pairs(clean) == Counter((i, t) for i, t, _, _ in rows if i != 90)

    mix = stage["mixture"](spark, d, benchmark_dir)
    assert set(mix.columns) == {*d.columns, "mix_taken"}
    most = Counter((i, t) for i, t, _, _ in rows)
    found = mix.collect()
    assert all(int(r.mix_copies) in (1, 2, 3) and r.mix_taken == int(r.mix_copies) * len(r.text.split()) for r in found)
    assert all(n <= most[k] for k, n in pairs(mix).items())
    want = mixing.mix(d).groupBy("doc_id", "size", "copies").count().where("copies > 0").collect()
    assert Counter((r.doc_id, len(r.text.split()), int(r.mix_copies)) for r in found) == Counter({(r.doc_id, r["size"], r.copies): r["count"] for r in want})
    for _, make in corpus_pipeline.STAGES:
        empty = make(spark, d.limit(0), benchmark_dir)
        assert empty.collect() == []


@pytest.mark.parametrize("groups, words_of", [(240, 120), (240, 30)])
def test_near_dedup_finds_every_near_copy(spark, benchmark_dir, groups, words_of):
    """Pairs just above and below the least similarity, chains of them, and copies whose repeated words turn the fingerprint, by brute force of all pairs of a group."""
    rng, rows = np.random.default_rng(21), []
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(words_of)]
        own = [base, base + ["x"] * 400] if g % 3 == 0 else [base]
        for j in range(1, 5):
            t = list(own[-1] if j % 2 else base)
            cut = int(rng.integers(1, max(2, words_of // 5)))
            own.append(t[cut:] if j == 1 else t[:-cut] + [f"e{g}x{j}x{k}" for k in range(cut // 2)] if j == 2 else t[:cut] + ["y"] + t[cut:])
        rows += [(10 * g + k, " ".join(own[k]), "en", "s1") for k in rng.permutation(len(own)).tolist()]
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, table(spark, rows), benchmark_dir).collect()}
    texts, want = {i: t for i, t, _, _ in rows}, set()
    for g in range(groups):
        root = reach([i for i in texts if i // 10 == g], lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
        want |= {i for i in root if root[i] == i}
    assert got == want


def test_rows_of_one_document_share_its_copies(spark):
    """Equal rows get what the mix gives them together, rows without a doc_id each their own."""
    same = [(7, "a b c", "en", "s1")] * 40 + [(None, f"n{i} m", "en", "s1") for i in range(6)] + [(None, "n1 m", "en", "s1")] * 5 + [(8, "w " * 500, "en", "s2")]
    d = table(spark, same).repartition(5)
    found, want = mixing.mixed(d).collect(), mixing.mix(d).where("copies > 0").collect()
    assert Counter((r.doc_id, len(r.text.split()), r.mix_copies) for r in found) == Counter((r.doc_id, r["size"], r.copies) for r in want)
    assert len({r.mix_copies for r in found if r.doc_id == 7}) <= 3 and max(r.mix_copies for r in found) <= 3


def test_run_is_its_stages_in_a_row(spark, benchmark_dir, tmp_path):
    folder = str(tmp_path)
    d = table(spark, rows_of() + [(90, "the river " * 10 + ITEM, "en", "s1")])
    d.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{benchmark_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder)
    step = d
    for _, make in corpus_pipeline.STAGES:
        step = make(spark, step, folder)
        step = spark.createDataFrame(step.collect(), step.schema)
    assert pairs(got) == pairs(step)
    ids = {r.doc_id for r in got.collect()}
    assert not ids & {70, 71, 72, 80, 81, 82, 90}


def test_held_out_documents_are_not_learned_from(spark):
    assert zlib.crc32(b"4") % 3 == spark.range(1).select(F.crc32(F.lit("4").cast("binary")) % 3).first()[0]
