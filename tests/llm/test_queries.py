"""Queries beside brute force on the smallest tables, and operators on awkward rows, empty tables and whole columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from colscope.llm import bloom, bpe, components, exact_dedup, language, licenses, mixing, quality_classifier, quality_rules, sharding, simhash, token_counts
from colscope.llm.queries import PIECES, QUERIES, VOCABULARY
from tests import oracle

WORD = re.compile("[^\x20\x09-\x0d]+")
RANKS = bpe.read_ranks(public_tokenizers.path(VOCABULARY))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def run(spark, name, folder):
    return by_id(QUERIES[name](spark, folder))


# --- op1 quality rules


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check_base(row, text):
    n, chars, symbols, lines, repeats = base_counts(text)
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, lines, repeats)
    assert row.base_failed == (n < 50 or 100 * repeats > 50 * n)
    assert not (row.base_failed and row.kept)


def test_quality_rules(spark, folder, texts):
    found = run(spark, "op1_quality_rules", folder)
    assert found.keys() == texts.keys()
    for i, row in found.items():
        check_base(row, texts[i])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [found[i].kept for i, q in labels.items() if q and found[i].n_words >= 50]
    assert np.mean(clean) > 0.98
    junk = [found[i].kept for i, q in labels.items() if not q and found[i].n_words >= 50]
    assert np.mean(junk) < 0.1


def test_quality_rules_edges(edge, edge_rows, empty):
    rows = quality_rules.judged(edge).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == \
        Counter((r.doc_id, *base_counts(r.text)) for r in edge_rows)
    assert quality_rules.judged(empty).collect() == []


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(40_000) < 0.7
    on_good, on_bad = [0.97, 0.95, 0.9, 0.92, 0.98], [0.6, 0.9, 0.7, 0.5, 0.8]
    right = np.stack([rng.random(len(y)) < np.where(y, g, b) for g, b in zip(on_good, on_bad)], axis=1)
    votes = np.where(rng.random(right.shape) < 0.2, 0, np.where(right == y[:, None], 1, -1))
    found = quality_rules.estimate(Counter(map(tuple, votes.tolist())))
    assert abs(found.good - 0.7) < 0.05
    assert np.abs(np.array(found.on_good) - on_good).max() < 0.05 and np.abs(np.array(found.on_bad) - on_bad).max() < 0.08
    assert quality_rules.estimate({}).good == quality_rules.GOOD


# --- op2 license scans

PHRASES = [("mit", "under the mit license".split()), ("apache-2", "apache license version 2".split()), ("cc-by-nc", "cc by nc".split())]


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    words = license_words(text)
    return len(words), [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p)] == p]


def check_license(row, text):
    n, places = base_places(text)
    assert (row.n_words, row.n_base) == (n, len(places))
    assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert row.base_labels == ",".join(sorted({x for _, x in places}))
    labels = [x for x in row.labels.split(",") if x]
    assert labels == sorted(set(labels)) and {x for _, x in places} <= set(labels)
    assert 0 <= row.score <= 1 and (row.score > 0) == bool(labels)


def brute_detections(text, rules):
    norm = " " + " ".join(license_words(text)) + " " if license_words(text) else " "
    out = []
    for n, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            out.append((start, start + m[0].count(" "), r.priority, n, r.label))
    return out


def survivors(found):
    """By definition: no other detection of the same or a better priority spans it; of equal spans the earlier rule wins."""
    def hidden(d):
        return any(e is not d and e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1]
                   and ((e[0], e[1]) != (d[0], d[1]) or (e[2], e[3]) < (d[2], d[3])) for e in found)
    return {d[4] for d in found if not hidden(d)}


def test_licenses(spark, folder, texts):
    found = run(spark, "op2_license_scans", folder)
    assert found.keys() == texts.keys()
    for i, row in found.items():
        check_license(row, texts[i])
    assert {"mit", "apache-2", "cc-by-nc"} <= {x for r in found.values() for x in r.labels.split(",")}


def test_license_rules(spark):
    rules = licenses.signatures()
    assert len(rules) > 300
    texts = ["This work is licensed under the GNU Lesser General Public License, version 2.1 or later. All rights reserved.",
             "CC BY-NC-SA 4.0 and CC-BY 3.0; distributed under the three clause BSD license", "mit license", "mit freunden", "SPDX-License-Identifier: MPL-2.0",
             "Creative Commons Attribution ShareAlike 4.0 under the mit license mit license", "cc by nc " * 400, "dedicated to the public domain (CC0 1.0 Universal)",
             "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"]
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        found = brute_detections(texts[r.doc_id], rules)
        assert sorted((d.start, d.end, d.priority, d.label) for d in r.detections) == sorted((a, b, p, x) for a, b, p, _, x in found)
        assert set(r.labels.split(",")) - {""} == (survivors(found) - {licenses.NONE}) | {x for _, x in base_places(texts[r.doc_id])[1]}
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[0] == "lgpl-2.1,proprietary" and labels[3] == "" and labels[4] == "mpl-2"


def shortest(pattern):
    """A short text that a signature matches: no optional part, the first of several."""
    pattern = re.sub(r"\(\?:\[\^ \]\+ \)\{1,\d+\}\?", "x ", re.sub(r"\(\?: \[\^ \]\+\)\{0,\d+\}", "", pattern)).replace("[^ ]+", "x")
    for old, new in ((r"\(\?:[^()]*\)\?", ""), (r"\(\?:([^()|]*)[^()]*\)(?!\?)", r"\1")) * 4:
        pattern = re.sub(old, new, pattern)
    return re.sub(r".\?", "", re.sub(r"\[(.)[^]]*\]", r"\1", pattern))


def test_license_keywords(spark):
    rules = licenses.signatures()
    texts = [f"x {shortest(r.pattern)} x" for r in rules]
    assert all(re.search(f"(?<= )(?:{r.pattern})(?= )", t) for r, t in zip(rules, texts, strict=True))
    found = by_id(licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    lost = [t for n, (r, t) in enumerate(zip(rules, texts, strict=True))
            if (1, t.count(" ") - 1, r.label, r.priority) not in {tuple(d) for d in found[n].detections}]
    assert lost == []
    texts = ["It is not distributed by the GPL license", "never published by us, but by the BSD license"]  # denied without the word under
    found = by_id(licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [licenses.NONE in {d.label for d in found[n].detections} for n in range(2)] == [True, True] and found[0].labels == ""
    texts = ["Released under the MIT.", "distributed under the terms of the MIT, see the file", "It is subject to MIT no attribution", "mit Freunden"]
    found = by_id(licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [found[n].labels for n in range(4)] == ["mit", "mit", "mit-0", ""]
    for n, text in enumerate(texts):
        assert sorted((d.start, d.end, d.priority, d.label) for d in found[n].detections) == sorted((a, b, p, x) for a, b, p, _, x in brute_detections(text, rules))


def test_license_sentences(spark):
    """Notices, addresses and denials; names in prose score low together; only A-Z are lowered."""
    texts = ["We love BSD cars and the Expat community; Apache 2 helicopters; Elastic license plates; I bought an unlicense", "It is not licensed under the GNU General Public License",
             "See https://www.apache.org/licenses/LICENSE-2.0 for details", "Redistributions of source code must retain the above copyright notice",
             "this is not available under the MIT license", "under the MIT License", "(see http://creativecommons.org/licenses/by-nc-sa/4.0/)", "incompatible with the Apache License version 2"]
    found = by_id(licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert found[0].score <= 0.31 and found[1].labels == "" and found[1].score == 0
    assert [found[n].labels for n in (2, 3, 6)] == ["apache-2", "bsd", "cc-by-nc-sa"] and all(found[n].score >= 0.8 for n in (2, 3, 6))
    assert found[4].labels == found[4].base_labels == "mit" and found[4].n_base == 1  # base labels always stay
    assert found[5].score >= 0.95 and found[7].labels == "apache-2"
    kelvin = by_id(licenses.scanned(spark.createDataFrame([(0, "\u212a \u0130 licensed under the zlib \u212aicense")], "doc_id long, text string")))[0]
    assert kelvin.n_words == len(license_words("\u212a \u0130 licensed under the zlib \u212aicense"))


def test_license_edges(edge, edge_rows, empty):
    rows = licenses.scanned(edge).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word) for r in rows) == Counter(
        (r.doc_id, base_places(r.text)[0], len(base_places(r.text)[1]), min(base_places(r.text)[1], default=(None,))[0]) for r in edge_rows)
    assert licenses.scanned(empty).collect() == []


# --- op3 quality classifier


def test_classifier(spark, folder, texts):
    found = run(spark, "op3_quality_classifier", folder)
    assert found.keys() == texts.keys()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert np.mean([found[i].kept == bool(q) for i, q in labels.items()]) > 0.85


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = quality_classifier.fit(docs, labels.filter(part != 0))
    found = by_id(quality_classifier.scored(docs, model))
    test = [(found[r.doc_id], bool(r.quality)) for r in labels.filter(part == 0).collect()]
    assert np.mean([f.kept for f, y in test if y]) > 0.95 and np.mean([f.kept for f, y in test if not y]) <= 0.1

    def loss(score):
        return -np.mean([math.log(max(score(f) if y else 1 - score(f), 1e-12)) for f, y in test])

    def bad(score):
        return sum(score(f) >= 0.5 for f, y in test if not y)

    views, both = [lambda f: f.score_text, lambda f: f.score_meta], lambda f: f.score
    assert all(loss(both) < loss(v) and bad(both) <= bad(v) for v in views)  # the combination beats either view


def test_metadata_view_sees_the_layout():
    plain = quality_classifier.meta_places("Some words of prose.\nAnd a second line of it.", "en", "s")
    for other in ("SOME WORDS OF PROSE.\nAND A SECOND LINE OF IT.", "Some words of prose.\nSome words of prose.", "1234 567 89 0.\n1 2 3 4 5 6 7 8 9 0 1 2",
                  "<b>Some</b> <i>words</i>\n<p>|||</p> line of it."):
        assert set(quality_classifier.meta_places(other, "en", "s").tolist()) != set(plain.tolist())
    words = quality_classifier.meta_places("Same words of prose.\nAnt a second line if it.", "en", "s")
    assert words.tolist() == plain.tolist()  # but no words


def test_combination_learns_which_view_to_trust():
    rng = np.random.default_rng(1)
    y = (rng.random(2_000) < 0.5).astype(float)
    good, noise = np.where(y > 0, 1, -1) + rng.normal(size=2_000), rng.normal(size=2_000)
    a, b, _ = quality_classifier.combined(good, noise, y)
    assert a > 5 * b and b >= 0


def test_a_repeated_id_does_not_fill_the_sample(spark):
    """A labelled id that a third of the rows repeat brings few of them."""
    rows = [(0 if i % 3 == 0 else i, f"text {i} of many words" if i % 2 else "### $$$", "en", "s") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    drawn = []
    quality_classifier.fit(docs, labels, labelled=200, pool=100)
    original = quality_classifier.co_train
    try:
        quality_classifier.co_train = lambda texts, metas, y, fold, pool: (drawn.append((len(y), len(pool[0]))), original(texts, metas, y, fold, pool))[1]
        quality_classifier.fit(docs, labels, labelled=200, pool=100)
    finally:
        quality_classifier.co_train = original
    assert 100 < drawn[0][0] < 300 and drawn[0][1] < 200


def test_classifier_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.classified(edge, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(19)] + [(0, None), (None, 1), (5, 0)], "doc_id long, quality int")
    rows = quality_classifier.classified(edge, some).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.classified(empty, some).collect() == []


def test_classifier_reads_long_words(spark):
    """Texts without blanks that differ only after their first 64 characters, in kinds of characters that other texts share."""
    def text(n, good):
        start = "".join(chr(0x4E00 + (n * 31 + k * 17) % 5000) for k in range(64))
        return start + "".join(chr(0x4E00 + (n * 7 + k) % 5000) if good or k % 2 else "#" for k in range(256))

    n = 400
    rows = [(i, text(i, i % 2), "zh", "src") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n // 2)], "doc_id long, quality int")
    found = by_id(quality_classifier.classified(docs, labels))
    assert np.mean([found[i].kept == bool(i % 2) for i in range(n // 2, n)]) > 0.95
    cache = quality_classifier._Places()
    same, other = ("x" * 64 + end for end in ("=" * 64 + "12", "=" * 64 + "a-"))
    shapes = [set(quality_classifier.text_places(t, cache)) for t in (same, other, "12", "a-")]
    assert shapes[2] & shapes[0] - shapes[1] and shapes[3] & shapes[1] - shapes[0]


# --- op4 exact dedup


def sha(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()


def test_exact_edges(edge, edge_rows, empty):
    best, size = {}, Counter()
    for r in edge_rows:
        key = (-len(r.text or ""), r.doc_id is None, r.doc_id)
        size[sha(r.text)] += 1
        best[sha(r.text)] = min(best.get(sha(r.text), key), key, key=lambda k: (k[0], k[1], k[2] or 0))
    expected = Counter((r.doc_id, best[sha(r.text)][2], size[sha(r.text)],
                        (-len(r.text or ""), r.doc_id is None, r.doc_id) == best[sha(r.text)], sha(r.text)) for r in edge_rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.mark(edge).collect()) == expected
    kept = exact_dedup.deduplicate(edge)
    assert kept.columns == edge.columns
    assert Counter(sha(r.text) for r in kept.collect()) == Counter(dict.fromkeys(best, 1))
    assert exact_dedup.mark(empty).collect() == [] and exact_dedup.deduplicate(empty).collect() == []


def test_exact_with_a_full_filter(monkeypatch, edge):
    """A filter that flags nearly all rows gives the same result."""
    whole = Counter(map(tuple, exact_dedup.mark(edge).collect()))
    monkeypatch.setattr(bloom, "LEAST_BITS", 64)
    monkeypatch.setattr(bloom, "MOST_BITS", 64)
    assert Counter(map(tuple, exact_dedup.mark(edge).collect())) == whole


# --- op5 mixing


def brute_shares(sizes, recipe):
    """Fill the tree by raising a level of water, in fractions, then round down level by level like the operator."""
    def weight(level, name):
        return recipe.weights.get(level, {}).get(name, recipe.other)

    total = sum(sizes.values())
    out = {}

    def share(prefix, budget):
        depth = len(prefix)
        if depth == len(mixing.LEVELS):
            out[prefix] = budget
            return
        caps = Counter()
        for leaf, n in sizes.items():
            if leaf[:depth] == prefix:
                caps[leaf[depth]] += n * recipe.epochs
        filled = {}
        while True:
            open_names = [c for c in caps if c not in filled]
            spare = budget - sum(filled.values())
            w = sum(weight(mixing.LEVELS[depth], c) for c in open_names)
            new = [c for c in open_names if caps[c] * w <= spare * weight(mixing.LEVELS[depth], c)]
            if not new:
                break
            filled.update({c: caps[c] for c in new})
        for c in caps:
            share((*prefix, c), filled[c] if c in filled else spare * weight(mixing.LEVELS[depth], c) // w)

    share((), min(total * recipe.numerator // recipe.denominator, total * recipe.epochs))
    return out


def leaf_of(row, recipe):
    source = mixing.MISSING if row.source is None else row.source
    domain = next((d for d, s in recipe.domains.items() if source in s), recipe.other_domain)
    return domain, mixing.MISSING if row.lang is None else row.lang, source


def brute_epochs(rows, recipe):
    tokens = [len(WORD.findall(r.text or "")) for r in rows]
    leaves = [leaf_of(r, recipe) for r in rows]
    sizes = Counter()
    for leaf, n in zip(leaves, tokens):
        sizes[leaf] += n
    budgets, out = brute_shares(sizes, recipe), Counter()
    for leaf in sizes:
        mine = [i for i in range(len(rows)) if leaves[i] == leaf]
        whole, rest = divmod(budgets[leaf], sizes[leaf]) if sizes[leaf] else (0, 0)
        digest = {i: hashlib.md5(f"{recipe.seed}:{whole + 1}:{'' if rows[i].doc_id is None else rows[i].doc_id}".encode()).hexdigest() for i in mine}
        for i in mine:
            upto = sum(tokens[j] for j in mine if digest[j] <= digest[i])
            out[(rows[i].doc_id, *leaf, tokens[i], whole + (whole < recipe.epochs and upto <= rest))] += 1
    return out


@pytest.mark.parametrize("recipe", [mixing.Recipe(), mixing.Recipe(numerator=9, denominator=5), mixing.Recipe(numerator=3, epochs=1),
                                    mixing.Recipe(weights={"lang": {"en": 0}, "source": {"src0": 9}}), mixing.Recipe(numerator=0)])
def test_mixing(documents, recipe):
    found = Counter(map(tuple, mixing.chosen(documents, recipe).collect()))
    assert found == brute_epochs(documents.collect(), recipe)



def test_mixing_edges(edge, edge_rows, empty):
    recipe = mixing.Recipe(numerator=3)
    assert Counter(map(tuple, mixing.chosen(edge, recipe).collect())) == brute_epochs(edge_rows, recipe)
    mixed = mixing.mixed(edge, recipe)
    assert mixed.columns == edge.columns
    assert mixed.count() == sum(k[-1] * n for k, n in brute_epochs(edge_rows, recipe).items())
    assert mixing.chosen(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_mixing_cuts_digit_by_digit(monkeypatch, documents):
    whole = Counter(map(tuple, mixing.chosen(documents).collect()))
    monkeypatch.setattr(mixing, "FEW_ROWS", 1)
    assert Counter(map(tuple, mixing.chosen(documents).collect())) == whole


# --- op6 token counts


def greedy(word, pieces):
    n, at, text = 0, 0, token_counts.FIRST + word
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces and text[at:e].startswith(token_counts.FIRST) == (at == 0)), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton():
    pieces = ["▁a", "▁ab", "▁abcdx", "b", "c", "cdy", "d", "bc", "▁", "zz"]
    machine = token_counts.automaton(pieces)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        word = "".join(rng.choice(list("abcdxyz"), rng.integers(1, 9)))
        assert machine.count(token_counts.FIRST + word) == greedy(word, set(pieces)), word


def test_token_counts(spark, folder, texts):
    pieces = token_counts.read_pieces(public_tokenizers.path(PIECES))
    known = set(pieces)
    found = run(spark, "op6_token_counts", folder)
    counts = {w: greedy(w, known) for t in texts.values() for w in WORD.findall(t or "")}
    for i, row in found.items():
        own = [counts[w] for w in WORD.findall(texts[i] or "")]
        assert (row.n_words, row.n_tokens, row.n_unknown) == (len(own), sum(map(abs, own)), sum(n < 0 for n in own))


def test_token_counts_edges(edge, edge_rows, empty):
    pieces = token_counts.read_pieces(public_tokenizers.path(PIECES))
    machine, known = token_counts.automaton(pieces), set(pieces)
    short = [r for r in edge_rows if len(r.text or "") < 2000]
    rows = token_counts.counted(edge, machine).collect()
    assert len(rows) == len(edge_rows)
    expected = Counter((r.doc_id, len(WORD.findall(r.text or "")), sum(abs(greedy(w, known)) for w in WORD.findall(r.text or ""))) for r in short)
    assert not expected - Counter((r.doc_id, r.n_words, r.n_tokens) for r in rows)
    assert token_counts.counted(empty, machine).collect() == []
    assert {r.n_tokens for r in token_counts.counted(edge.limit(3), token_counts.automaton([])).collect()} <= {0, 1, 3}


# --- op7 sharding


def brute_shard(key, weights):
    cost = {n: -math.log((int(hashlib.md5(f"{key}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for n, w in enumerate(weights) if w > 0}
    return min(cost, key=lambda n: (cost[n], n))


def test_sharding(spark, folder, texts):
    found = run(spark, "op7_sharding", folder)
    assert found.keys() == texts.keys()
    slots = defaultdict(list)
    for i, r in found.items():
        data = (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == brute_shard(i, [1.0] * 16) and r.grown_shard in (r.shard, 16)
        assert r.grown_shard == brute_shard(i, [1.0] * 17)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_sharding_edges(monkeypatch, edge, empty):
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 1)
    rows = sharding.shards(edge, [1, 0, 2.5]).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == brute_shard("" if r.doc_id is None else r.doc_id, [1, 0, 2.5]) and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == edge.count()
    assert sharding.shards(empty, [1.0]).collect() == []


def test_sharding_follows_weights(spark):
    many = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in sharding.shards(many, [1.0, 2.0, 5.0]).collect())
    assert all(abs(n[k] / 8000 - w / 8) < 0.03 for k, w in enumerate((1, 2, 5)))


# --- op8 byte-level BPE


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe(spark, folder, texts, reference):
    found = run(spark, "op8_byte_bpe", folder)
    assert found.keys() == texts.keys()
    for i, r in found.items():
        ids = reference.encode_ordinary(texts[i] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_bpe_edges(edge, edge_rows, empty, reference):
    for chars in (40, bpe.CHUNK_CHARS):
        rows = bpe.encode(edge, RANKS, public_tokenizers.PATTERN, slices=7, chunk_chars=chars)
        rows = rows.select("*", bpe.decode(edge.sparkSession, F.col("ids"), RANKS).alias("data")).collect()
        assert all(r.data == r.decoded for r in rows)
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.data)) for r in rows) == Counter(
            (r.doc_id, tuple(reference.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in edge_rows)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_of_long_words(reference):
    rng = np.random.default_rng(5)
    for n in (1, 2, 199, 201, 3000):
        for letters in ("ab", "the in", "=", "0123456789", "aé漢😀"):
            word = "".join(rng.choice(list(letters), n))
            assert bpe.encode_word(word.encode(), RANKS) == reference._core_bpe.encode_single_piece(word.encode())
            assert bpe.encode_word(word.encode(), RANKS) == (bpe._encode_long(word.encode(), RANKS) if word.encode() not in RANKS else [RANKS[word.encode()]])


# --- op9 language ID


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    docs = by_id(spark.read.parquet(f"{folder}/documents.parquet"))
    found = run(spark, "op9_language_id", folder)
    assert found.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in found.items())
    test = [i for i, r in found.items() if r.held_out and any(map(str.isalpha, docs[i].text))]
    assert np.mean([found[i].lang_pred == docs[i].lang for i in test]) > 0.97


def test_language_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b"], np.array([-1, -2]), rng.integers(-9_000_000, -1000, (2, language.BUCKETS + 1)).astype(np.int32))
    model.table[:, -1] = 0
    texts = ["", None, "123 ...", "abc def", "été " * 50, "x" * 3000]
    together = language._scored(model, texts)
    for i, t in enumerate(texts):
        names, scores = language._scored(model, [t])
        assert (names[0], scores[0]) == (together[0][i], together[1][i])
    assert together[0][:3] == ["und"] * 3


def test_language_of_cut_texts(monkeypatch):
    model = language.Model(["a", "b"], np.zeros(2, np.int64), np.random.default_rng(2).integers(-9000, 0, (2, language.BUCKETS + 1)).astype(np.int32))
    model.table[:, -1] = 0
    whole = language._scored(model, ["some words of a text, cut anywhere", "b"])
    monkeypatch.setattr(language, "MOST_CHARS", 5)
    cut = language._scored(model, ["some words of a text, cut anywhere", "b"])
    assert whole[0] == cut[0] and np.array_equal(whole[1], cut[1])


def test_language_edges(spark, edge, empty):
    rows = language.identified(edge).collect()
    assert len(rows) == edge.count()
    assert all(r.lang_pred in ("en", "de", "", "und") for r in rows)
    assert language.identified(empty).collect() == [] and language.recognised(empty).collect() == []
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identified(unlabelled).collect()} == {("und", 0.0)}
    assert language.recognised(edge).columns == edge.columns


# --- op10 SimHash


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest doc_id (None last) by fingerprint, linking those that differ in at most four bits."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 4:
                root[find(p)] = find(q)
    return {p: find(p) for p in distinct}


def test_simhash(spark, folder, texts):
    found = run(spark, "op10_simhash_dedup", folder)
    assert found.keys() == texts.keys()
    prints = {i: brute_print(t) for i, t in texts.items()}
    roots = brute_components(prints.values())
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(roots[p], i)
    for i, r in found.items():
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", least[roots[prints[i]]])


def test_simhash_edges(edge, edge_rows, empty):
    prints = [brute_print(r.text) for r in edge_rows]
    roots = brute_components(prints)
    least = {}
    for r, p in zip(edge_rows, prints):
        if r.doc_id is not None:
            least[roots[p]] = min(least.get(roots[p], r.doc_id), r.doc_id)
    found = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.mark(edge).collect())
    assert found == Counter((r.doc_id, p, least.get(roots[p])) for r, p in zip(edge_rows, prints))
    stay = simhash.representatives(edge)
    assert stay.columns == edge.columns
    best = {}  # one row of each component: the smallest doc_id, null last
    for r, p in zip(edge_rows, prints):
        best[roots[p]] = min(best.get(roots[p], (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in stay.collect()) == Counter(best.values())
    assert simhash.mark(empty).collect() == [] and simhash.representatives(empty).collect() == []


@pytest.mark.parametrize("crowd", [2, 5, 2048])
def test_links_connect_all_near_fingerprints(spark, crowd):
    """Random, near and crowded fingerprints, with and without the ways for crowded keys."""
    rng = np.random.default_rng(7)
    values = set(rng.integers(0, 1 << 63, 150).tolist())
    centre = int(rng.integers(0, 1 << 63))
    for start in (centre, centre ^ 0xFF00FF):
        now = start
        for _ in range(60):  # a chain, and balls around its members
            now ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            values |= {now, now ^ (1 << int(rng.integers(0, 64)))}
    values = sorted(values)
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    reached = {r.a % (1 << 64): r.b % (1 << 64) for r in components.roots(simhash.links(table, len(values), crowd=crowd)).collect()}
    roots = brute_components(values)
    mine, theirs = defaultdict(set), defaultdict(set)
    for v in values:
        mine[reached.get(v, v)].add(v)
        theirs[roots[v]].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_masks_cover_every_pair(blocks):
    rng = np.random.default_rng(blocks)
    for m in [(1 << 64) - 1, *simhash.masks((1 << 64) - 1, 4, 6)[:3]]:
        places = [b for b in range(64) if m >> b & 1]
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(places, 4, replace=False))
            assert any(not flips & x for x in simhash.masks(m, 4, blocks))


def test_roots_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999), (5, 5), (700, 700)], "a long, b long")
    assert {r.a: r.b for r in components.roots(links).collect()} == {**{i: 0 for i in range(1, 301)}, 1000: 999}
    assert components.roots(links.limit(0)).collect() == []


# --- the pipeline


def test_pipeline(spark, documents, folder, reference):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        kept.append((name, before, docs))
    columns = [set(d.columns) for _, _, d in kept[:-1]]
    assert all(c == set(documents.columns) for c in columns)
    (_, start, after_lang), (_, _, after_exact), (_, near_in, after_near), (_, mix_in, after_mix), (_, last_in, ids) = kept
    assert {r.doc_id for r in start if WORD.search(r.text or "") and any(map(str.isalpha, r.text))} == {r.doc_id for r in after_lang.collect()}
    best = {}
    for r in sorted(after_lang.collect(), key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(sha(r.text), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in after_exact.collect())
    roots = brute_components([brute_print(r.text) for r in near_in])
    least = {}
    for r in sorted(near_in, key=lambda r: r.doc_id):
        least.setdefault(roots[brute_print(r.text)], r.doc_id)
    assert sorted(least.values()) == sorted(r.doc_id for r in after_near.collect())
    taken = brute_epochs(mix_in, corpus_pipeline.RECIPE)
    assert sorted(k[0] for k in taken if k[-1]) == sorted(r.doc_id for r in after_mix.collect())
    for r in ids.collect():
        text = next(x.text for x in last_in if x.doc_id == r.doc_id)
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_edges(spark, edge, empty, folder):
    for start in (edge, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.count() <= start.count()


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) & set(QUERIES)))
def test_sql(spark, folder, name):
    ok, message = oracle.compare(spark, oracle.connect(folder), name, QUERIES[name], driver.oracle_sql()[name], folder)
    assert ok, message
