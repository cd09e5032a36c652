"""The byte transducer, filter audit, MinHash near-duplicates and source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tremor.llm import audit, divergence, minhash
from tremor.llm.spans import LETTERS, TEXT, Spans, pieces

DOCS = "doc_id long, text string, lang string, source string, n int, part string, mask int, sig string, key string, slot string, good string"
LABELS = "doc_id long, quality int, toxic int, text string, n int"


def docs(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns have names that operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2, "s", "k", "t", "g") for r in rows], DOCS)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


TEXTS = ["", " ", "a", "one two  two\tTwo", "é ü é\xa0é  x 漢字 漢字 𝒳", "$5 & 7|8", "x" * 200 + " " + "x" * 200 + " " + "x" * 199 + "y", "ab\x00cd ab\x00cd", "tail ", " head", "A" * 8 + " " + "A" * 8 + "B " + "A" * 16]


def test_transducer():
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join(rng.choice(["aa", "bb", "Ab", "é", "longerword" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 300))) for _ in range(50)), None]
    for piece in (10, 1 << 20):
        at = 0
        for i, j, data, ends in pieces(pa.array(texts, pa.string())[0:], piece):
            assert i == at
            at = j
            s = Spans(data, ends, TEXT)
            found = defaultdict(list)
            for k, d in enumerate(s.doc):
                found[int(d)].append(s.word(k).decode())
            for k in range(i, j):
                assert found[k - i] == words(texts[k])
            assert s.distinct().tolist() == [len(set(words(t))) for t in texts[i:j]]
        assert at == len(texts)
    sliced = pa.array(texts, pa.string())[4:9]
    assert [data[: e + 1].tobytes().decode() for _, _, data, (e, *_) in pieces(sliced, 1)] == [t + " " for t in texts[4:9]]


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(Spans, "_hashes", lambda self: np.zeros(len(self.start), np.uint64))
    data = np.frombuffer(b"aa ab aa abcdefghi abcdefghj abcdefghi ", np.uint8)
    assert Spans(data, np.array([len(data) - 1]), TEXT).distinct().tolist() == [4]


def audited(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    each = defaultdict(list)
    for d, text, _, source in rows:
        t, w = text or "", words(text)
        fails = {
            k
            for k, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), d is not None and d > least[t]))
            if bad
        }
        each[source or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, found in each.items():
        share = Counter()
        for order in permutations("ABCDE"):
            name = "".join(order)
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in found if f in x[0] and not x[0] & before]
                kept = sum(not x[0] & {*before, f} for x in found)
                out[part, name, step] = [kept, len(gone), sum(f in x[0] and bool(x[0] & before) for x in found), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                share[f] += len(gone)
        for key, row in out.items():
            if key[0] == part:
                row.append(share[key[1][key[2] - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, "", "en", ""), (None, "", "en", "a"), (None, "Same text", "en", "a"), (9, "Same text", "en", "b"), (9, "Same text", "en", "b"), (8, "Same text", "en", "a"), (9, "other text of nine", "en", "b"), (10, "w " * 30000, "en", "a")]
    base = " ".join(f"word{i}" for i in range(60))
    for i in range(20, 80):
        text = rng.choice([base, base.upper(), base + " #", base + " Z" * 40, "short", base[: rng.randint(0, 400)]])
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(9, 1, 0), (9, 0, 1), (None, 1, 1)]
    found = audit.audit(docs(spark, rows), spark.createDataFrame([(*r, "t", 1) for r in labels], LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(found) == len(got) and got == audited(rows, labels)
    empty = spark.createDataFrame([], DOCS)
    assert audit.audit(empty, spark.createDataFrame([], LABELS)).collect() == []
    assert len(audit.audit(docs(spark, rows[:1]), spark.createDataFrame([], LABELS)).collect()) == 600


def shingles(text, k=4):
    w = words(lower(text))
    return frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([" ".join(w)] if w else [])


def linked(rows):
    """{doc_id: component} by comparing all sets."""
    sets = defaultdict(set)
    for d, text, *_ in rows:
        sets[shingles(text)].add(d)
    keys = [s for s in sets if s]
    root = {s: s for s in keys}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[top(a)] = top(b)
    names = defaultdict(set)
    for s in keys:
        names[top(s)] |= {d for d in sets[s] if d is not None}
    return {(d, len(s)): min(names[top(s)], default=None) if s else d for s in sets for d in sets[s]}


def test_minhash_components(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(0, "", "en", "a"), (1, None, "en", "a"), (2, " \n ", "en", "a"), (3, "Two words", "en", "a"), (4, "two  WORDS", "en", "b"), (None, "two words", "en", "b"), (None, "nobody else has this text", "en", "b"), (5, "long " * 30000, "en", "a"), (5, "long " * 30000, "en", "a"), (6, "LONG " * 29000, "en", "a")]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(10, 130):  # a group of near copies about the bound, and a chain that leads away from it
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text), "en", "a"))
    for i in range(130, 180):
        base[rng.randrange(len(base))] = f"new{i}"
        rows.append((i, " ".join(base), "en", "a"))
    for i in range(180, 260):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))), "en", "b"))
    rows.append((300, rows[50][1], "en", "c"))
    want = linked(rows)
    for how in ({}, {"block": 16, "key_rows": 20}):
        got = minhash.near_duplicates(docs(spark, rows), **how).collect()
        assert len(got) == len(rows)
        for r in got:
            assert want[r.doc_id, r.n_shingles] == r.component_id, r
            assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    assert minhash.near_duplicates(docs(spark, rows).limit(0)).collect() == []


def test_posterior_bound():
    assert minhash.bands_for(1000) == (5, 41) and minhash.bands_for(10**10)[0] == 9
    rng = np.random.default_rng(1)
    for n in (40, 200):
        need = minhash.fewest_matches(n)
        below = lambda m: (rng.beta(m + 1, n - m + 1, 2_000_000) >= 0.8).mean()  # noqa: B023, E731
        assert below(need + n // 20) > 0 and 0 < need < 0.8 * n


def diverged(rows, least=10, top=10):
    terms = [[w for w in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) if w] for _, t, *_ in rows]
    keys = [(lang or "", source or "") for _, _, lang, source in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source), ts in zip(keys, terms):
        df[lang].update(set(ts))
        counts[lang, source].update(ts)
    out = {}
    for lang in {k[0] for k in keys}:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in counts if x == lang}
        every = {t: sum(c[t] for c in own.values()) for t in kept}
        rate = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        q = rate(every)
        p = {s: rate(c) for s, c in own.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            best = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", best)):
                out |= {(lang, s, part, item, k): -value for k, (value, _, item) in enumerate(found, 1)}
    return out


def test_divergence(spark):
    rng = random.Random(11)
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, "!!! 123", "xx", "a"), (4, "solo", "xx", "b"), (None, "alpha beta", "en", "a"), (5, "alpha " * 40000, "en", "c"), (6, "é" * 300 + " alpha", "en", "a")]
    for lang, many in (("en", 120), ("de", 60), (None, 15)):
        vocabulary = [f"{lang}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["é" * 3, "Ünï", "x" * 80, "alpha"]
        for i in range(many):
            k = rng.randint(0, 4)
            rows.append((100 + i, ", ".join(rng.choice(vocabulary[: 20 + 20 * k]).title() for _ in range(rng.randint(0, 80))), lang, rng.choice(["a", "b", "s" + str(k), None])))
    want = diverged(rows)
    for how in ({}, {"shard": 8, "sent": 900, "dense": 100, "slots": 16, "sources": 2}):
        found = divergence.divergence(docs(spark, rows), **how).collect()
        got = {(r.lang, r.source, r.part, r["item"], r.rank): r.value for r in found}
        assert len(found) == len(got) and got == want
    assert divergence.divergence(docs(spark, rows).limit(0)).collect() == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 5000, np.uint64)
    sizes, bits, order = divergence.perfect_hash(h)
    assert sorted(order.tolist()) == list(range(5000)) and int(np.bitwise_count(bits).sum()) == 5000
    assert divergence.perfect_hash(h[:0])[0] == []


@pytest.mark.parametrize("equal", [False, True])
def test_slots_verify_terms(monkeypatch, equal):
    if equal:  # all terms have one hash: all are listed
        monkeypatch.setattr(Spans, "_hashes", lambda self: np.zeros(len(self.start), np.uint64))
    terms = [f"t{chr(97 + i)}" for i in range(20)]
    data = np.frombuffer(("".join(t + " " for t in terms)).encode(), np.uint8)
    s = Spans(data, np.flatnonzero(data == 0x20), LETTERS)
    h = divergence.mix(s.hash ^ np.uint64(divergence._lang_hash("en")))
    sizes, bits, order = divergence.perfect_hash(h)
    import pickle

    blob = pickle.dumps((sizes, bits, b"".join(terms[k].encode() + b" " for k in order)))
    slots = divergence.Slots([("en", 0, 1, 0, 20, blob)])
    assert sorted(slots.find(s, ["en"] * 20).tolist()) == list(range(20))
    assert set(slots.find(s, ["de"] * 20).tolist()) == {-1}
    other = np.frombuffer(b"tz zz ta ", np.uint8)
    found = slots.find(Spans(other, np.array([8]), LETTERS), ["en"])
    assert found[:2].tolist() == [-1, -1] and found[2] >= 0
