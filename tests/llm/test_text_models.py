"""Language, toxicity and license operators."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passplane.llm import language, licenses, toxicity
from passplane.llm.base import documents, is_held_out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_viterbi_is_best_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(1, 6))
        s = rng.normal(0, 5, (n, 3)).astype(np.float32)
        value = lambda path: sum(s[i, k] for i, k in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        assert tuple(language.viterbi(s, np.array([n]), 4.0)) == max(itertools.product(range(3), repeat=n), key=value)
    s, counts = rng.normal(0, 5, (10, 3)).astype(np.float32), np.array([3, 0, 5, 2])
    parts = [language.viterbi(s[a : a + n], np.array([n]), 4.0) for a, n in zip(np.cumsum(counts) - counts, counts, strict=True) if n]
    assert (language.viterbi(s, counts, 4.0) == np.concatenate(parts)).all()


def test_language_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in documents(spark, sf_dir).select("doc_id", "lang").collect()}
    found = [r for r in language.op2_language(spark, sf_dir).collect()]
    assert len(found) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in found)
    own = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert np.mean(own) > 0.98


def test_language_spans_of_mixed_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language.fit(docs)
    some = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("length(text) > 1500 and text not like '%|%'").collect()}
    a, b = sorted(some)[:2]
    spans = language.label(model, [some[a] + " " + some[b]], spans=True)[0][2]
    assert [s[2] for s in spans] == [a, b] and abs(spans[1][0] - 40) <= 6


def test_language_of_odd_rows(spark, odd, nothing):
    model = language.train([("en", "the of and to in that is was for it with as his on be at by"), ("ru", "и в не на я быть он с что а по это она этот к но они мы"), ("de", "der die und in den von zu das mit sich des auf für ist")])
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 10)) and got[5][0] == "en"
    assert language.label(model, ["это мы"])[0][0] == "ru"
    assert language.predict(odd, language.train([])).where("lang_pred <> 'und'").count() == 0
    assert language.predict(nothing, model).count() == 0 and language.fit(nothing).languages == []
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9, 11}


def _labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    plain = [f"wort{k}" for k in range(300)]
    out = []
    for i in range(n):
        text = list(rng.choice(plain, int(rng.integers(20, 80))))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(2):
                text.insert(int(rng.integers(len(text))), f"gemein{rng.choice(list('abcdefgh'))}{rng.integers(1000)}")
        out.append((i, " ".join(text), toxic))
    return out


def test_toxicity_learns_stems_and_leaves_clean_texts(spark):
    rows = _labelled(1500)
    docs = spark.createDataFrame([(i, t, "de") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(rows[0][0], rows[0][2]), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, language.fit(docs))
    score = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    own = [(score[i] >= 0.5, y == 1) for i, _, y in rows if held_out(i)]
    assert np.mean([a == b for a, b in own]) > 0.95
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() < len(rows)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int")
    lang = language.train([])
    none = toxicity.fit(odd, labels.limit(0), lang)
    assert none.net is None and toxicity.score(odd, none).where("score <> 0").count() == 0
    some = toxicity.learn([("bad words here", 1, False, 1.0), ("good words here", 0, False, 1.0)], lang)
    got = toxicity.score(odd, some).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, some).count() == 0 and toxicity.keep_clean(nothing, labels).count() == 0


def test_toxicity_thresholds_see_all_labelled_rows(spark, monkeypatch):
    # a language with many toxic texts of which few are in the sample
    monkeypatch.setattr(toxicity, "POSITIVES", 200)
    monkeypatch.setattr(toxicity, "NEGATIVES", 400)
    rows = [(i, t, y, "de") for i, t, y in _labelled(3000)]
    rows += [(3000 + i, t.replace("wort", "slovo"), y, "cs") for i, t, y in _labelled(300, 1)]
    docs = spark.createDataFrame([(i, t, lang) for i, t, _, lang in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    lang = language.fit(docs)
    model = toxicity.fit(docs, labels, lang)
    assert lang.languages.index("cs") in model.net.thresholds and lang.languages.index("de") in model.net.thresholds
    n = sum(not held_out(i) for i, *_ in rows)
    counted = []
    real = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda net, logit, lang, y, w, counts=None, least=25: (counted.append(len(logit) if counts is None else int(counts.sum())), real(net, logit, lang, y, w, counts, least)))
    toxicity.fit(docs, labels, lang)
    assert counted[-1] > n - 600


def test_pooling_does_not_see_the_shortening():
    rows = [(t, y, False, 1.0) for _, t, y in _labelled(200, 2)]
    model = toxicity.learn(rows, language.train([]))
    data = toxicity.prepare([r[0] for r in rows[:50]], model.lang)
    net = model.net
    slot = net.table._find(data.words.ravel())
    every = np.where(net.table.keys[slot] == 0, 0, net.table.values[slot] + 1).reshape(data.words.shape)
    whole = net.forward(every, data.counts, net.tables())[0]
    assert np.allclose(whole, net.logits(data.words, data.counts))


def test_license_places_against_brute_force(odd, odd_rows, nothing, spark, sf_dir):
    rows = [(r.doc_id, r.text or "") for r in documents(spark, sf_dir).collect()] + odd_rows + [(90, "Cc-BY cc by CC  by all rights reserved. GENERAL public  license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()), key=str)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want.append((i or -1, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want, key=str)
    assert licenses.scan(nothing).count() == 0


def test_license_rules_resolve_overlaps():
    s = licenses.Scanner()
    labels = lambda t: [r.label for _, _, r in s.detections(t)]
    assert len(s.rules) > 200
    assert labels("licensed under the apache license version 2 0") == ["unspecified-license", "apache-2.0"]
    assert labels("gnu general public license version 3 or at your option any later version") == ["gpl-3-or-later"]
    assert labels("cc by sa 4 0") == ["cc-by-sa-4.0"] and labels("this is about mittens and apaches") == []
    # the keyword prefilter loses nothing: every rule's match contains its keyword
    texts = ["spdx license identifier mit", "released under the mit license", "c 2020 someone all rights reserved", "for personal use only", "mpl 2 0 and epl 2 0", "neither the name of x nor y may be used to endorse or promote products", "must not be copied without prior written consent", "tous droits réservés", "zlib license", "gnu lesser general public license version 2 1"]
    for text in texts:
        assert s.detections(text) == s.resolved(text, range(len(s.rules))) != []
    assert all(r.keyword for r in s.rules)


def test_many_languages_and_marks(spark):
    """None of 300 languages is left out, and held-out texts of each are predicted."""
    rnd = random.Random(4)
    words = {k: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(300)}
    rows = [(20 * k + n, " ".join(rnd.choice(words[k]) for _ in range(12)), f"l{k:03d}") for k in range(300) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 300 and model.logs is None
    found = language.predict(docs, model).select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), "lang_pred")
    held = found.where(is_held_out())
    assert held.count() > 1000 and held.where("lang = lang_pred").count() > 0.98 * held.count() and found.select("lang_pred").distinct().count() == 300
    # a combining mark is no letter
    few = language.fit(docs.where("lang < 'l002'"))
    assert len(few.languages) == 2
    assert language.label(few, ["́́", "12 ́", "é"])[:2] == [("und", 0.0, 0)] * 2 and language.label(few, ["é"])[0][0] != "und"


def test_scores_are_the_same_as_lists_and_as_a_matrix():
    rows = [("de", "das ist ein Text, und der ist lang"), ("en", "this is a text and it is long"), ("ru", "это длинный текст")]
    held = {lang: language.sparse(*language.counted([text])) for lang, text in rows}
    w = language.words_of(["this und это ist", "", "x"])
    assert np.allclose(language.model_of(held).scores(w), language.model_of(held, dense=0).scores(w), atol=1e-4)


@pytest.mark.parametrize("hot", [8, 9, 11, None])
def test_one_id_does_not_decide_for_its_language(spark, hot):
    """2,580 rows of one training id, or of none, beside 620 others: both languages are learned, from a bounded number of texts."""
    rows = [(hot, f"das ist der {k}. Text und nicht der letzte", "de") for k in range(2580)] + [(100 + k, f"this is text {k} and not the last one", "en") for k in range(620)]
    rows += [(hot, "immer der gleiche Satz", "nl")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(docs, per_language=50)
    assert model.languages == ["de", "en", "nl"]
    same = language.fit(docs.repartition(2), per_language=50)
    assert all(np.array_equal(getattr(model, c), getattr(same, c)) for c in ("base", "cuts", "which", "more"))
    # 50 texts of at most 43 characters each
    counts = {lang: 0.3 * np.expm1(model.more[model.which == k].astype(float)).sum() for k, lang in enumerate(model.languages)}
    assert all(0 < n <= 50 * 60 for n in counts.values())


def test_language_scores_by_hand(spark):
    """Word scores, candidates and prediction by plain loops over the same trigrams."""
    pairs = [("de", "der hund und die katze sind im haus"), ("en", "the dog and the cat are in the house"), ("ru", "собака и кошка в доме")]
    model = language.train(pairs)

    def buckets(word):
        out, low = [], [32, 32, *map(ord, word), 32]
        for k in range(2, len(low)):
            before, twice = low[k - 1], low[k - 2] if low[k - 1] != 32 else 32
            h = (low[k] * 0x9E3779B1 ^ before * 0x85EBCA6B ^ twice * 0xC2B2AE35) & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16)
        return out

    counts = {lang: {} for lang, _ in pairs}
    for lang, text in pairs:
        for word in text.split():
            for b in buckets(word):
                counts[lang][b] = counts[lang].get(b, 0) + 1

    def score(lang, word):
        total = sum(counts[lang].values())
        cyrillic = "Ѐ" <= word[0] <= "ӿ"
        return sum(np.log((counts[lang].get(b, 0) + 0.3) / (total + 0.3 * language.BUCKETS)) for b in buckets(word)) - 1000 * (cyrillic != (lang == "ru"))

    def best(text):
        words, names = re.findall(r"[^\W\d_]+", text.lower()), ["de", "en", "ru"]
        s = np.array([[score(x, w) for x in names] for w in words])
        paths = itertools.product(range(3), repeat=len(words))
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - language.PENALTY * sum(a != b for a, b in zip(p, p[1:], strict=False))
        path = max(paths, key=value)
        held = [sum(len(w) for w, k in zip(words, path, strict=True) if k == x) for x in range(3)]
        return names[int(np.argmax(held))], max(held) / sum(held)

    for text in ["der hund", "the cat in the house", "Hund, DOG; кошка!", "die katze the house", "в доме 12 und"]:
        lang, share = best(text)
        got = language.label(model, [text])[0]
        assert got[0] == lang and abs(got[1] - share) < 1e-9, text


def test_network_by_plain_loops():
    """Logits of the trained network against windows computed one by one; its gradients by differences."""
    rows = [(t, y, False, 1.0) for _, t, y in _labelled(120, 4)]
    model = toxicity.learn(rows, language.train([]))
    net = model.net
    texts = [r[0] for r in rows[:12]] + ["", "nichts davon"]
    data = toxicity.prepare(texts, model.lang)
    got = net.logits(data.words, data.counts)
    at = 0
    for k, n in enumerate(data.counts.tolist()):
        vectors = []
        for word in data.words[at : at + n]:
            v = np.zeros(toxicity.DIMENSIONS)
            for h in word.tolist():
                slot = int(net.table._find(np.array([h], np.uint64))[0])
                if net.table.keys[slot] != 0:
                    v += net.embedding[net.table.values[slot] + 1]
            vectors.append(v)
        at += n
        zero, feature = np.zeros(toxicity.DIMENSIONS), []
        for f, bias in zip(net.filters, net.bias, strict=True):
            windows = [sum(((vectors[a + j] if 0 <= a + j < n else zero) @ f[j] for j in range(len(f))), np.zeros(toxicity.FILTERS)) for a in range(-max(toxicity.WIDTHS) + 1, n + 1)]
            inner = windows[max(toxicity.WIDTHS) - 1 :]
            feature.append(np.maximum(np.maximum(np.max(inner, axis=0), 0 if not n else -np.inf) + bias, 0))
        want = float(np.concatenate(feature) @ net.out + net.out_bias[0])
        # windows beyond the text see only zeros; where the text leaves them as the maximum both agree
        assert abs(got[k] - want) < 1e-3 or not n, (k, got[k], want)


def test_threshold_is_best_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        label = rng.integers(0, 2, 60)
        logit = np.round(rng.normal(0, 1, 60) + label, 1)
        weight = rng.choice([1.0, 2.0], 60)

        def f_half(cut, logit=logit, label=label, weight=weight):
            passed, true = weight[logit > cut].sum(), (weight * label)[logit > cut].sum()
            return 0.0 if true < 0.5 * passed or not passed else 1.25 * true / (0.25 * (weight * label).sum() + passed)

        cut = toxicity.best_threshold(logit, label, weight)
        best = max(f_half(c) for c in [*(np.unique(logit) - 0.05), logit.max() + 1])
        assert f_half(cut) >= best - 0.006 or not best


def test_long_texts_leave_the_sample_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20_000)
    rows = _labelled(400, 7)
    rows[3] = (rows[3][0], rows[3][1] + " wort1" * 50_000, rows[3][2])
    docs = spark.createDataFrame([(i, t, "de") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    real = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda found, lang: (seen.append(sum(len(r[0]) for r in found)), real(found, lang))[1])
    model = toxicity.fit(docs, labels, language.fit(docs))
    assert seen[0] <= 40_000 and model.net is not None and toxicity.score(docs, model).count() == 400


def test_license_labels_and_score_against_plain_rules(spark, sf_dir, odd, odd_rows):
    """Labels and scores from every rule tried everywhere and overlaps resolved pair by pair."""
    notices = [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under GPL v2 or later. All rights reserved. (c) 2019 Someone", "Creative Commons Attribution-ShareAlike 4.0; some rights reserved",
        "This work is licensed under a Creative Commons license. CC BY-NC 4.0. No part of this book may be reproduced. May not be copied without prior written consent.", "for personal use only, not for commercial use; royalty free", "caf\u00a0e all rights\u00a0reserved mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy to deal in the software without restriction",
    ]
    rows = [(r.doc_id, r.text or "") for r in documents(spark, sf_dir).collect()] + odd_rows + [(5000 + k, t) for k, t in enumerate(notices)]
    rules = licenses.rules()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        line = " ".join(words)
        found = []
        for k, r in enumerate(rules):
            for m in re.finditer(r.pattern, line, re.ASCII):
                if (m.start() == 0 or line[m.start() - 1] == " ") and (m.end() == len(line) or line[m.end()] == " "):
                    found.append((-r.priority, m.start() - m.end(), k, m.start(), m.end()))
        stay = []
        for x in sorted(found):
            if all(x[4] <= y[3] or y[4] <= x[3] for y in stay):
                stay.append(x)
        base = {label for p, label in licenses.BASE.items() if f" {p} " in f" {line} "}
        score = 1.0
        for x in stay:
            score *= 1 - licenses.WEIGHT[-x[0]]
        want.append((str(i), ",".join(sorted(base | {rules[x[2]].label for x in stay})), round(max(0.9 * bool(base), 1 - score), 9)))
    got = sorted((str(r.doc_id), r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    differ = [(a, b) for a, b in zip(got, sorted(want), strict=True) if a != b]
    assert not differ, differ[:3]
    assert len({x for _, labels, _ in got for x in labels.split(",")}) > 12


def test_long_notices_are_swept_in_time():
    import time

    s = licenses.Scanner()
    line = "all rights reserved mit license c 2020 someone " * 40_000
    began = time.time()
    assert len(s.detections(line)) > 80_000
    assert time.time() - began < 20


def test_license_spans(spark):
    row = licenses.scan(spark.createDataFrame([(1, "x y MIT License; all  rights reserved")], "doc_id long, text string"), spans=True).first()
    assert [(x["first"], x["last"], x["label"]) for x in row.spans] == [(2, 3, "mit"), (4, 6, "reserved")]
