"""License scans by a positional rare-token index (operator 10).

The index maps each word of the licence templates to its postings (template, position). A word's IDF is
taken from the corpus (documents that hold it, counted over all of them); words of ``MIN_IDF`` or more
are looked up. Every place of such a word in a file votes for the relative position file place minus
template place; a template with votes of half of its rare words (two at least, or its only one) within
``SLACK`` words is a candidate, and is confirmed if its mandatory key phrases stand in the file at that
relative position, give or take ``SLACK``. A file may hold any number of templates, at any places.

Words: A-Z lower-cased, runs of ASCII digits, a-z and non-ASCII characters. Base phrases are found wherever
their words stand consecutively. The score is the largest share of a confirmed template's words that
stand in place; a base phrase gives 0.5 at least.

Nulls: a null or empty text has no words, empty labels and score 0. Repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.llm import shingles as S
from perfengine.llm.common import bounded_batches, table

# The phrases of the contract, and the notices of public licences with their key phrases.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
     "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
     ["apache org licenses license 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights to "
     "use copy modify merge publish distribute sublicense and or sell copies of the software",
     ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]
MIN_IDF, SLACK = 2.0, 3


def hashes_of(phrase: str) -> np.ndarray:
    raw = np.frombuffer(phrase.encode(), np.uint8)
    return S.word_hashes(raw, np.array([0, len(raw)]), S.ALNUM)[0]


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def _document_counts(words: list[str]):
    known = np.concatenate([hashes_of(w) for w in words])
    order = np.argsort(known)

    def run(batches):
        for batch in batches:
            total = np.zeros(len(words), np.int64)
            for _, raw, at in S.chunks(batch.column("text")):
                h, wo = S.word_hashes(raw, at, S.ALNUM)
                place = np.minimum(np.searchsorted(known[order], h), len(words) - 1)
                hit = np.flatnonzero(known[order][place] == h)
                doc = np.searchsorted(wo, hit, "right") - 1
                pairs = np.unique(doc * len(words) + order[place[hit]])
                total += np.bincount(pairs % len(words), minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total)], ["word", "n"])
    return run


def idf(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of every template word over all documents: log((1 + documents) / (1 + documents with the word))."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_document_counts(vocabulary(templates)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = texts.count()
    return {r["word"]: float(np.log((1 + total) / (1 + r["n"]))) for r in counts.collect()}


class Scanner:
    def __init__(self, idfs: dict[str, float], templates=TEMPLATES, base=BASE):
        self.templates = [(label, hashes_of(text), [hashes_of(p) for p in phrases]) for label, text, phrases in templates]
        self.base = [(hashes_of(phrase), label) for phrase, label in base.items()]
        self.rare, self.postings = [], defaultdict(list)
        self.phrase_at = []
        for t, (_, words, phrases) in enumerate(self.templates):
            names = templates[t][1].split()
            rare = [q for q, w in enumerate(names) if idfs.get(w, np.inf) >= MIN_IDF]
            # a template of common words alone is looked up by its least common one
            rare = rare or [max(range(len(names)), key=lambda q: idfs.get(names[q], 0.0))]
            self.rare.append(len(rare))
            for q in rare:
                self.postings[int(words[q])].append((t, q))
            self.phrase_at.append([self._places(words, p) for p in phrases])
        keys = np.array(sorted({*self.postings, *(int(p[0]) for p, _ in self.base)}), np.uint64)
        self.keys = keys

    @staticmethod
    def _places(words: np.ndarray, phrase: np.ndarray) -> list[int]:
        return [i for i in range(len(words) - len(phrase) + 1) if (words[i : i + len(phrase)] == phrase).all()]

    def scan(self, h: np.ndarray, places: np.ndarray) -> tuple[list[int], set[str], set[str], float]:
        """(starts of base phrases, base labels, the method's labels, score) of one text; places: those of key words."""
        starts, base, labels, score = [], set(), set(), 0.0
        votes = defaultdict(list)
        for p in places.tolist():
            w = int(h[p])
            for phrase, label in self.base:
                if w == int(phrase[0]) and p + len(phrase) <= len(h) and (h[p : p + len(phrase)] == phrase).all():
                    starts.append(p)
                    base.add(label)
                    score = max(score, 0.5)
            for t, q in self.postings.get(w, ()):
                votes[t].append((p - q, q))
        for t, found in votes.items():
            label, words, phrases = self.templates[t]
            found.sort()
            need = max(min(2, self.rare[t]), -(-self.rare[t] // 2))
            begin, tried = 0, None
            for end in range(len(found)):
                while found[end][0] - found[begin][0] > SLACK:
                    begin += 1
                if len({q for _, q in found[begin : end + 1]}) < need or found[begin][0] == tried:
                    continue
                tried = found[begin][0]
                if all(any(self._stands(h, p, tried + at) for at in ats) for p, ats in zip(phrases, self.phrase_at[t])):
                    labels.add(label)
                    score = max(score, self._share(h, words, tried))
        return sorted(set(starts)), base, labels, score

    @staticmethod
    def _stands(h: np.ndarray, phrase: np.ndarray, at: int) -> bool:
        return any((h[i : i + len(phrase)] == phrase).all() for i in range(max(0, at - SLACK), at + 2 * SLACK + 1) if i + len(phrase) <= len(h))

    @staticmethod
    def _share(h: np.ndarray, words: np.ndarray, at: int) -> float:
        near = [np.isin(w, h[max(0, at + q - SLACK) : max(0, at + q + 2 * SLACK + 1)]) for q, w in enumerate(words)]
        return float(np.mean(near))

    def rows(self, texts: pa.Array):
        """(n_words, base starts, base labels, all labels, score) of each text."""
        for _, raw, at in S.chunks(texts):
            h, wo = S.word_hashes(raw, at, S.ALNUM)
            place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == h)
            ends = np.searchsorted(hit, wo)
            for d in range(len(wo) - 1):
                n, mine = int(wo[d + 1] - wo[d]), hit[ends[d] : ends[d + 1]]
                if len(mine):
                    starts, base, labels, score = self.scan(h[wo[d] : wo[d + 1]], mine - wo[d])
                    yield n, starts, base, base | labels, score
                else:
                    yield n, [], set(), set(), 0.0


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, starts (of base phrases), base (labels), labels, score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = spark.sparkContext.broadcast(Scanner(idf(docs)))

    def run(batches):
        for batch in batches:
            rows = list(held.value.rows(batch.column("text")))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())),
                 pa.array([sorted(x) for x in cols[2]], pa.list_(pa.string())), pa.array([sorted(x) for x in cols[3]], pa.list_(pa.string())),
                 pa.array(cols[4], pa.float64())], ["doc_id", "n_words", "starts", "base", "labels", "score"])

    return docs.mapInArrow(run, "doc_id long, n_words long, starts array<bigint>, base array<string>, labels array<string>, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.get("starts", F.lit(0)).alias("first_word"), F.get("starts", F.size("starts") - 1).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def plain_base(text: str | None) -> tuple[int, list[int], list[str]]:
    """(words, starts, labels) of one text by regular expressions, for tests."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(i for i, _ in found), sorted({x for _, x in found})
