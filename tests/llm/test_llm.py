"""Each operator against a brute-force version, and on nulls, ties, empty tables and clashing columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perfengine.llm import (
    common, op1_mixing, op2_decontaminate, op3_url_filter, op4_html_extract, op5_fingerprint,
    op6_language, op7_toxicity, op8_neardup, op9_records, op10_licenses,
)
from perfengine.llm import shingles as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, sig int, token string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    base = prose(1, 200)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    texts = [(0, base), (1, base.upper()), (2, near), (3, prose(2, 150)), (4, None), (5, ""), (6, "  \n"), (7, "one two"), (8, "one two"),
             (9, prose(3, 30000)), (None, prose(4, 50)), (11, base + " " + prose(5, 10)), (12, "12 % 34"), (3, prose(2, 150))]
    return [(i, t, None if i == 4 else "en", None if i == 3 else "a", len(t or ""), "x", 1, "t") for i, t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(3, 30000).split(" ", 100)[100][:400].rsplit(" ", 1)[0]), (2, "nowhere to be found in any text at all"), (3, None), (4, "")],
                          "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "HTTP://WWW.Example.com/en/x?q", "<p>a &amp; b"), (2, None, None), (3, "http://a.net/es/1", "<article><p>One.<script>x</script></article><footer>f</footer>"), (3, "no scheme", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("op", [op1_mixing, op2_decontaminate, op3_url_filter, op4_html_extract, op5_fingerprint, op6_language, op7_toxicity, op8_neardup, op9_records, op10_licenses])
def test_empty_tables(spark, empty, op):
    assert op.query(spark, empty).count() == 0


def test_word_hashes_follow_words():
    texts = ["a b  A", None, "", "x\ty", "ab", " a", "é z"]
    got, at = S.word_hashes(*S.utf8(pa.array(texts)))
    words = [(t or "").lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert all((got[i] == got[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def groups(texts, n, percent=80):
    def of(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    sets = [of(t) for _, t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    return [len(s) for s in sets], root


def test_near_groups_match_brute_force(spark, folder):
    texts = [(r[0], r[1]) for r in rows()]
    sizes, root = groups(texts, 4)
    first = {}
    for (i, _), r in zip(texts, root):
        if i is not None:
            first[r] = min(first.get(r, i), i)
    want = sorted((str(i), n, str(first.get(r, i))) for (i, _), n, r in zip(texts, sizes, root))
    got = op8_neardup.query(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_with_chain(spark, tmp_path):
    base = prose(9, 120).split()
    rng = random.Random(5)
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        docs.append((i, " ".join(w)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, root = groups(docs, 4)
    first = {}
    for (i, _), r in zip(docs, root):
        first[r] = min(first.get(r, i), i)
    got = {r.doc_id: r.component_id for r in op8_neardup.query(spark, str(tmp_path)).collect()}
    assert got == {i: first[r] for (i, _), r in zip(docs, root)}


def test_least_matches_is_the_posterior():
    n, m = op8_neardup.least_matches(0.8, 1e-6)[0]
    s = np.linspace(0, 1, 200001)
    for k, reached in ((m, True), (m - 1, False)):
        p = s**k * (1 - s) ** (n - k)
        assert (p[s >= 0.8].sum() / p.sum() >= 1e-6) == reached


def test_decontamination(spark, folder):
    got = op2_decontaminate.query(spark, folder).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in got] == [(9, 1, 1.0)]
    left = op2_decontaminate.decontaminate_stage(spark, common.table(spark, folder, "documents"), folder)
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")] and left.count() == len(rows()) - 1


def test_mixing_counts(spark, folder):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"), F.lit(1).alias("rate"))
    got = {r["source"]: r["n"] for r in op1_mixing.mix(docs, {"x": 3.0, "y": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["x"] - 15000) < 500 and abs(got["y"] - 5000) < 300
    big = op1_mixing.mix(docs.limit(200), {"x": 1.0, "y": 0.0}, budget=600.0 * 5000).agg(F.avg("_copies"), F.countDistinct("source")).first()
    assert abs(big[0] / (5000 * 200 / docs.limit(200).where("source = 'x'").count()) - 1) < 0.05 and big[1] == 1
    assert op1_mixing.query(spark, folder).count() >= 0


def test_url_rules_and_words(spark, folder):
    got = {r.page_id: r for r in op3_url_filter.query(spark, folder).collect() if r.page_id != 3}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[2].host, got[2].path, got[2].rule) == ("", "", None)
    pages = spark.createDataFrame([(1, "http://cheappills.org/x", "cheap bread"), (2, "http://daily-news.org/world", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in op3_url_filter.judged(pages).collect()}
    assert got[1].host_words == ["cheap", "pills", "org"] and got[1].verdict == "block" and got[2].verdict == "allow"


def test_url_labels_hold_no_host_of_the_given_pages():
    names = {"cheap-pills", "adult-x", "spam-farm", "ads-track", "casino-win", "free-bets"}
    words = {w for n in names for w in n.split("-")} | {"www", "m", "blog", "example"}
    asked = {"cheap", "pills"}  # by test_url_rules_and_words
    listed = {w for url, _ in op3_url_filter.LABELLED for w in re.split("[^a-z]+", url.split("://")[1])}
    assert not (words - asked) & listed
    assert not any(n in url for n in names for url, _ in op3_url_filter.LABELLED)


def test_html_layouts():
    chain = op4_html_extract.trained()
    for page, gold in op4_html_extract.training_pages(40, seed=77):
        assert op4_html_extract.main_text(page, chain) == "\n".join(gold)
    assert op4_html_extract.main_text(None, chain) == ""
    assert op4_html_extract.main_text("<p <a href='x", chain) in ("", "<p")


def test_html_hides_by_attribute_alone_and_ends_open_heads():
    texts = lambda page: [b.text for b in op4_html_extract.blocks(page)]
    for name in ("overflow-hidden", "md:hidden", "hidden"):
        assert texts(f'<article class="{name}"><p>One.</p></article><p>Two.') == ["One.", "Two."]
    assert texts('<div hidden><p>no</p></div><div aria-hidden="true">no</div><div aria-hidden=false>yes</div>') == ["yes"]
    assert texts('<div title="a hidden door" data-x="x hidden"><p>One.') == ["One."]
    for start in ("<body>", "", "<div>", '<body class="x">'):
        assert texts(f"<html><head><title>t</title><meta charset=utf-8>{start}<p>One.<p>Two.") == ["One.", "Two."]
    assert texts("<head><title>t</title><style>x</style>plain<p>One.") == ["plain", "One."]
    assert texts("<head><template><p>no</p></template><noscript><p>no</p></noscript></head><p>One.") == ["One."]


def test_html_footer_marks_count_anywhere_in_a_block():
    page = op4_html_extract.blocks("<p>" + "word " * 100 + "All rights reserved.</p>")
    assert "foot" in op4_html_extract.features(page)[0]


def test_fingerprints(spark, folder):
    got = op5_fingerprint.query(spark, folder).collect()
    assert len(got) == len(rows()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint and by[5].fingerprint == "" and by[4].n_chars == 0
    import hashlib
    t, nxt = rows()[2][1], rows()[1][1]  # 2 is followed by 1
    edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
    assert by[2].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert by[0].edited_sha256 != by[1].edited_sha256


def test_language(spark, tmp_path):
    words = {"en": "the house and water with thing", "de": "der haus und wasser mit schön"}
    docs = [(i, " ".join(random.Random(i).choice(words[lang].split()) for _ in range(40)), lang) for i in range(200) for lang in [["en", "de"][i % 2]]]
    docs += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_language.query(spark, str(tmp_path)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in docs[:200])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert op6_language.language_stage(spark, common.table(spark, str(tmp_path), "documents"), str(tmp_path)).count() == 200


def test_toxicity(spark, tmp_path):
    docs = [(i, prose(i, 120) + (" vileword " * 3 if i % 5 == 0 else " ") + prose(i + 999, 30)) for i in range(600)]
    spark.createDataFrame(docs + [(9000, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op7_toxicity.query(spark, str(tmp_path)).collect()
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 601


def test_copies_of_a_toxic_text_teach_no_words():
    rng = random.Random(5)
    plain = [(prose(100 + i, 60), 0) for i in range(200)]
    bad = [" ".join(w if rng.random() > 0.1 else rng.choice(["zorkan", "quxlim", "vuxpat"]) for w in prose(400 + i, 60).split()) for i in range(40)]
    copied = " ".join(f"wyx{i}zuv" for i in range(60))
    rows = plain + [(t, 1) for t in bad] + [(copied + " zorkan", 1)] * 40
    rng.shuffle(rows)
    found = op7_toxicity.dictionaries(rows).toxic
    assert b"zorkan" in found and b"quxlim" in found and b"wyx7zuv" not in found
    fresh = [prose(900, 60), prose(901, 60) + " quxlim ab vuxpat cd quxlim", copied[:100]]
    low, high, other = op7_toxicity.train(rows, 0.3).score(fresh)
    assert low < op7_toxicity.THRESHOLD <= high and other < high


def test_toxic_phrases_and_rare_toxic_texts_are_learnt():
    # a fixed phrase (each of its words always behind the same one) and a word in five toxic texts, copies of none
    rng = random.Random(8)
    rows = [(prose(1000 + i, 80), 0) for i in range(300)]
    for i in range(60):
        words = prose(2000 + i, 80).split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), "cd mendaxo trivolu serkanti")
        rows.append((" ".join(words), 1))
    rows += [(" ".join(f"grünzwol {w}" for w in prose(3000 + i, 30).split()), 1) for i in range(5)]
    rng.shuffle(rows)
    scorer = op7_toxicity.train(rows, 0.2)
    low, phrase, rare = scorer.score([prose(5000, 80), prose(5001, 40) + " cd mendaxo trivolu serkanti " + prose(5002, 30), prose(5003, 40) + " grünzwol " + prose(5004, 30)])
    assert low < op7_toxicity.THRESHOLD <= phrase and low < rare, (low, phrase, rare)


def test_toxicity_sample_is_cut_before_the_collect(spark):
    long = " ".join(f"w{i:05d}" for i in range(20000))
    places = [int(w.split()[0][1:]) for w in op7_toxicity.drawn(long, 12)]
    assert len(places) == 12 and places == sorted(places) and np.std(np.diff(places)) > 100  # by hash, not by a stride
    docs = spark.createDataFrame([(1, long)] + [(2, f"copy {i} " + long) for i in range(30)] + [(3, None)], "doc_id long, text string").repartition(4)
    sample = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = op7_toxicity.windows_of(docs, sample)
    assert sorted((r["doc_id"], len(r["ws"])) for r in got) == [(1, 12), (2, 256), (3, 1)]
    own = {r["doc_id"]: bytes(r["own"]) for r in got}
    assert own[2] == min(op7_toxicity.digest(f"copy {i} " + long) for i in range(30))
    scorers = op7_toxicity.folded([(bytes(r["own"]), r["ws"], r["toxic"]) for r in got])
    x = op7_toxicity.measured(docs, sample, got, scorers)
    k = next(i for i, r in enumerate(got) if r["doc_id"] == 1)
    assert x[k] == scorers[k % op7_toxicity.FOLDS].features(long)


def test_records_round_trip(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = op9_records.query(spark, folder).orderBy("start").collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in rows()}
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(ids[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())
        start += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and len(got) == len(rows())


def test_crc32c_known_value():
    raw = np.frombuffer(b"123456789", np.uint8)
    crc = 0xE3069283  # the check value of CRC-32C
    assert op9_records.masked_crc32c(raw, np.array([0, 9]))[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_encoder_splits_like_the_library():
    import public_tokenizers
    e = op9_records.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = ["a", "b", "Z", " ", " ", "\n", "\t", ".", "'s", "!", "1", "é", "中", " ", "<|endoftext|>", "\0", "  ", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for t, x in zip(texts, e(texts)):
        assert x.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_without_error(monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(op9_records, "MEMORY", 60)
    e = op9_records.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    kept = 0
    for k in range(40):
        texts = [" ".join(rng.choice(["the", "of", "and", "é", f"w{rng.randrange(10**6)}"]) for _ in range(20)) for _ in range(5)] + [None, ""]
        before = len(e.pieces)
        got = e(texts)
        kept += 0 < len(e.pieces) < before
        assert [x.tolist() for x in got] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert kept > 3


def test_licenses(spark, folder, tmp_path):
    docs = [(1, "Foo. Licensed under the Apache License, Version 2.0. All RIGHTS reserved"), (2, "cc by CC-BY x gnu general public license"), (3, None), (4, prose(1, 50))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_licenses.query(spark, str(tmp_path)).collect()}
    for i, t in docs:
        n, starts, labels = op10_licenses.plain_base(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(starts), *((starts[0], starts[-1]) if starts else (None, None)), ",".join(labels))
    assert got[1].labels == "apache-2.0,reserved" and got[3].score == 0


def test_pipeline(spark, folder):
    kept = op8_neardup.dedup_stage(spark, common.table(spark, folder, "documents"), folder)
    _, root = groups([(r[0], r[1]) for r in rows()], 5)
    assert kept.count() == len(set(root)) and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
