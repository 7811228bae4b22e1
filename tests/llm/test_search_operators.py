"""Operators 11 to 13 against brute-force versions, and on nulls, ties, copies, empty tables and clashing columns."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from perfengine.llm import op11_neighbours, op12_spelling, op13_lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<float>, node long, query int"


def neighbours(rows, k=10):
    """{query: [(vec_id, score)]} by comparing everything."""
    out = {}
    for q, x in rows:
        if q % 100 == 0:
            d = sorted((math.sqrt(((np.float64(x) - np.float64(y)) ** 2).sum()), i) for i, y in rows if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def answer(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def run_vectors(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2) for i, v in rows], VECTORS)
    return op11_neighbours.nearest(df, F.col("vec_id") % 100 == 0)


def test_neighbours_recall_and_scores(spark):
    """Random directions, the hardest case for a graph, with a tight cluster and a group of exact copies."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 24)).astype(np.float32)
    x[100:400] = x[100] + rng.normal(size=(300, 24)).astype(np.float32) * 1e-3
    x[600:1200] = x[600]
    got, want = answer(run_vectors(spark, list(enumerate(x)))), neighbours(list(enumerate(x)))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.97
    assert got[600] == want[600] and got[1100] == want[1100]  # copies: the smallest ids, at distance 0
    for q in got:
        for i, s in got[q]:
            assert s == math.sqrt(((np.float64(x[q]) - np.float64(x[i])) ** 2).sum())


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1, 0, 0]), (1, [0, 1, 0]), (2, [0, 1, 0]), (3, [2, 0, 0]), (100, [1, 0, 0]), (-100, [0, 0, 5])]
    bad = [(7, None), (8, []), (9, [0, 0, 0]), (10, [None, 1, 1]), (11, [nan, 1, 1]), (12, [inf, 0, 1]), (None, [1, 1, 1]), (200, [1, 1]), (300, None), (1, [0, 1, 0])]
    got = answer(run_vectors(spark, good + bad))
    assert got == neighbours(good)
    assert answer(run_vectors(spark, [(0, [1, 1])])) == {}
    assert answer(run_vectors(spark, [])) == {}
    assert answer(run_vectors(spark, [(7, None)])) == {}


def variants(docs):
    counts = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= 2}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


DOCS = "doc_id long, text string, word string, n long, length int"


def spelled(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in docs], DOCS).repartition(4)
    return sorted(map(tuple, op12_spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_against_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 60).to_pylist()]
    # a chain of forms over two steps, letters in and out of a-z, anagrams, repeated rows, nulls and a very long word
    docs += [(1000 + i, "Chimneys " * 220) for i in range(5)] + [(2000, "chimnéys " * 40), (2001, "chimnées " * 3), (2002, "CHÍMNEYS chimneys× chimneys÷ " * 3)]
    docs += [(3000, "listen silent enlist tinsels listens silents " * 2)] * 2 + [(None, "chimney " * 9), (4, None), (5, ""), (6, "q" * 5000 + " " + "q" * 5001), (7, "q" * 5000 + " " + "q" * 5001)]
    got = spelled(spark, docs)
    assert got == variants(docs)


def test_variants_in_slices(spark, monkeypatch):
    """Blocks cut into many slices give the same pairs."""
    words = {f"abcdef{a}{b}" for a in "ghijklmn" for b in "ghijklmn"} | {f"abcdefg{a}" for a in "opqrst"}
    docs = [(1, " ".join(sorted(words))), (2, " ".join(sorted(words)))]
    monkeypatch.setattr(op12_spelling, "SLICE_BYTES", 40)
    assert spelled(spark, docs) == variants(docs)


def test_variants_of_nothing(spark):
    assert spelled(spark, []) == [] and spelled(spark, [(1, None), (2, "short words only"), (3, "onceonly")]) == []


def ranked(spark, docs, items, **more):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, term string, score double")
    items = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")
    return sorted(map(tuple, op13_lexical.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (r[0] is None, r))


def lexical(docs, items, k=50):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    whole, total = sum(1 for *_, n in held if n), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for doc, c, n in held:
            m = 50 + 50 * n * whole // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r))


TEXTS = [(3, "Die Straße, the STRASSE!"), (1, "the cat_the dog"), (2, "the cat the dog"), (2, "the cat the dog"), (None, "cat"), (9, None), (10, ""), (11, "?! --"),
         (12, "cat " * 30_000), (13, "İstanbul 42 the"), (14, "dog"), (15, "dog")]
ITEMS = [(1, "CAT dog?"), (1, "42"), (2, "Straße straße"), (3, None), (4, "nowhere"), (None, "the"), (5, ""), (6, "the cat dog 42 istanbul")]


@pytest.mark.parametrize("tiny", [False, True])
def test_lexical_against_brute_force(spark, monkeypatch, tiny):
    """tiny: the vocabulary is joined, several groups and tiles, and the vocabulary cut where sums would pass the bound."""
    if tiny:
        monkeypatch.setattr(op13_lexical, "VOCABULARY_BYTES", 10)
        monkeypatch.setattr(op13_lexical, "GROUP_BYTES", 60)
        monkeypatch.setattr(op13_lexical, "TILE_TERMS", 2)
        monkeypatch.setattr(op13_lexical, "EXACT", 500)
        monkeypatch.setattr(op13_lexical, "TILE_CELLS", 4)
    assert ranked(spark, TEXTS, ITEMS) == lexical(TEXTS, ITEMS)
    assert ranked(spark, TEXTS, ITEMS, k=1) == lexical(TEXTS, ITEMS, 1)


def test_lexical_of_nothing(spark):
    assert ranked(spark, [], ITEMS) == [] and ranked(spark, TEXTS, []) == [] and ranked(spark, [(1, None)], ITEMS) == []


def test_lexical_oracle(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    got = op13_lexical.query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(op13_lexical.ORACLE_SQL).fetchall())
