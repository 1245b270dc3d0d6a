"""Operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import bisect
import collections
import gzip
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import decontamination, language_model, licenses, lines, mixing, ngram_join, quality_model, quality_rules, registry, token_counts, warc
from loomgraph.llm.common import materialise, scratch_root, without
from oracle import DATA

DOCS = "doc_id bigint, text string, source string, lang string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None),
    (2, "", "", "en"),
    (3, "  \n\t\r\n ", "a", "xx"),
    (None, "no id here, but words enough for all of the rules to look at it", "a", "en"),
    (4, "same text of some words\nand a second line", "a", "en"),
    (4, "same text of some words\nand a second line", "a", "en"),
    (5, "same text of some words\nand a second line", "b", "de"),
    (6, LONG, "a", "en"),
    (7, "x", "a", "en"),
    (8, "ünïcödé 漢字 😀 İK \x00 \x7f words", "a", "fr"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


# 1


def test_mix_odd_rows(odd, none):
    dims = mixing.document_dims(odd)
    clash = odd.withColumn("mix_rate", F.lit("old")).withColumn("share", F.lit(1)).withColumn("n", F.lit(1))
    out = mixing.mix(clash, dims, mixing.n_words(odd["text"]), {"source": {"a": 0.5, "*": 0.5}, "lang": {"en": 1.0}, "topic": {"prose": 1.0}}).collect()
    assert len(out) == len(ODD) and "share" in out[0].asDict()
    assert all(r["mix_rate"] == 0 for r in out if r["lang"] != "en")
    assert mixing.mix(none, mixing.document_dims(none), mixing.n_words(none["text"])).isEmpty()


def test_raked_marginals_meet_targets(spark):
    rng = random.Random(3)
    rows = [(i, "x " * rng.randrange(1, 90), rng.choice("aab"), rng.choice(["en", "de"])) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 1.0}}
    out = mixing.mix(docs, mixing.document_dims(docs), mixing.n_words(docs["text"]), targets, budget=0.5).collect()
    total = sum(r["mix_tokens"] for r in out)
    for d, wanted in (("source", targets["source"]), ("lang", targets["lang"])):
        for v, share in wanted.items():
            assert sum(r["mix_tokens"] * r["mix_rate"] for r in out if r[d] == v) / total == pytest.approx(0.5 * share, abs=1e-3)
    with pytest.raises(ValueError):
        mixing.mix(docs, mixing.document_dims(docs), mixing.n_words(docs["text"]), {"source": {str(i): 1 for i in range(200_000)}})


def test_mix_without_known_values(spark):
    docs = spark.createDataFrame([(i, "some words here", s, "xx") for i, s in enumerate(["new", None, "other"])], DOCS)
    mixed = lambda targets: mixing.mix(docs, mixing.document_dims(docs), mixing.n_words(docs["text"]), targets).collect()
    none = mixed({"source": {"a": 1.0}, "lang": {"en": 1.0}, "topic": {"prose": 1.0}})
    assert [r["mix_rate"] for r in none] == [0, 0, 0] and [r["mix_copies"] for r in none] == [0, 0, 0]
    rest = mixing.mix(docs, mixing.document_dims(docs), mixing.n_words(docs["text"])).collect()
    assert [r["mix_rate"] for r in rest] == pytest.approx([0.5] * 3) and {r["mix_error"] for r in rest} == {0.0}


# 2


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "Some words"), (2, None), (None, "second line"), (3, ""), (3, "漢字 😀"), (4, "absent words here")], "item_id bigint, text string")
    out = decontamination.scan(odd, bench).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append((r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]))
    assert len(out) == len(ODD) and by[4] == [(9, 4, 1, True)] * 2 and by[1] == [(0, 0, 0, False)] and by[6][0][0] == 30_000
    assert by[8] == [(5, 2, 1, True)] and by[3] == [(0, 0, 0, False)] and by[7] == [(1, 0, 0, False)]
    assert decontamination.scan(none, bench).isEmpty()
    assert all(not r["contaminated"] for r in decontamination.scan(odd, bench.limit(0)).collect())


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    items = [(i, text(rng.choice([1, 3, 9, 10, 14]))) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    want = {}
    for i, t in docs:
        w, hit, ids = t.split(), set(), set()
        for j, s in items:
            for win in decontamination.windows_of(s.split(), 4):
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        ids.add(j)
        want[i] = (len(hit), len(ids))
    for chunk in (32_000_000, 60):
        monkeypatch.setattr(decontamination, "CHUNK_BYTES", chunk)
        index = materialise(decontamination.build_index(d), "index")
        found = decontamination.digest(decontamination.search(index, b, window=4))
        assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in found.collect()} == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two y three"), (2, "three two one"), (3, "one " + "x " * 9 + "two three"), (4, "one two"), (5, "three one")], "doc_id bigint, text string")
    item = spark.createDataFrame([(7, "one two three")], "item_id bigint, text string")
    found = decontamination.search(materialise(decontamination.build_index(docs), "index"), item, slack=2.0)
    assert {r["doc_id"] for r in found.where(F.size("near") > 0).collect()} == {1, 2}


def test_proximity_in_query_and_pipeline(spark, tmp_path):
    item = [f"b{i}" for i in range(12)]
    inserted = " ".join([*item[:4], "x", *item[4:8], "y", *item[8:]])
    swapped = " ".join([*item[:5], item[6], item[5], *item[7:]])
    docs = spark.createDataFrame([(1, inserted), (2, f"before {swapped} after"), (3, " ".join(item)), (4, "x ".join(item)), (5, " ".join(item[:11])[3:]), (6, None)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item)), (8, "not there")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in registry.queries()["op2_decontaminate"](spark, str(tmp_path)).collect()}
    assert {i: r["n_near"] for i, r in out.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    assert {i for i, r in out.items() if r["contaminated"]} == {3, 5} and len({r["near_sha256"] for r in out.values()}) == 2
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == {4, 6}


# 3


def test_license_odd_rows(spark, odd, none):
    assert licenses.scan(none.select("doc_id", "text")).isEmpty()
    more = [(20, "MIT License mit license", "a", "en"), (21, "the MIT  license.\nGNU General, Public License", "a", "en"), (22, "CC-BY cc by", "a", "en"), (23, "licensed under the lesser gnu general public license", "a", "en")]
    docs = odd.union(spark.createDataFrame(more, DOCS)).withColumn("score", F.lit("old")).withColumn("labels", F.lit(1))
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (out[20]["n_base"], out[20]["first_word"], out[20]["last_word"], out[20]["base_labels"]) == (2, 0, 2, "mit")
    assert (out[21]["n_base"], out[21]["first_word"], out[21]["last_word"]) == (2, 1, 3)
    assert out[22]["n_base"] == 2 and "lgpl" in out[23]["labels"] and out[23]["base_labels"] == "gpl"
    assert out[1]["n_words"] == 0 and out[1]["first_word"] is None and out[1]["labels"] == "" and out[8]["n_words"] == 5


def test_license_notices_in_any_line_breaks(spark):
    grant = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this\n  software and go on"
    long = " ".join(["filler"] * 200)
    docs = [(1, grant), (2, f"{long} {grant} {long}"), (3, grant.replace("granted", "given").replace("charge", "cost")), (4, long), (5, " ".join(grant.split()[:8] + [long] + grant.split()[8:])), (6, "Licensed under CC BY 4.0")]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [out[i]["labels"] for i in (1, 2, 3, 4, 5, 6)] == ["mit", "mit", "", "", "", "cc-by"]
    assert [out[i]["score"] for i in (1, 2, 3)] == [1.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), templates=[("x", "w " * 65)])


# 4


def test_lines_odd_rows(spark, odd, none):
    assert lines.drop_boilerplate(none).isEmpty()
    out = lines.drop_boilerplate(odd.withColumn("n_lines", F.lit("x")), min_pages=2, ratio=0.1).collect()
    assert len(out) == len(ODD) and {r["text"] for r in out if r["doc_id"] == 1} == {None}
    assert [r["n_dropped"] for r in out if r["doc_id"] == 4] == [2, 2] and [r["text"] for r in out if r["doc_id"] == 4] == ["", ""]
    assert [r["n_dropped"] for r in out if r["doc_id"] == 5] == [0]


def test_lines_both_joins_agree(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "\n".join(rng.choice("abcdefgh ") for _ in range(6)), rng.choice("st"), "en") for i in range(200)], DOCS)
    first = sorted(lines.drop_boilerplate(docs, ratio=0.5).collect())
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted(lines.drop_boilerplate(docs, ratio=0.5).collect()) == first


# 5


def test_quality_held_out(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.score(docs, quality_model.train(docs, labels)).join(labels, "doc_id").collect()
    held = [(r["quality"], r["score"] >= 0.3) for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 1), (7, 0), (7, 1)], "doc_id bigint, quality int")
    model = quality_model.train(odd, labels)
    out = quality_model.score(odd.withColumn("y", F.lit(1)).withColumn("score", F.lit("old")), model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_model.score(none, quality_model.train(none, labels.limit(0))).isEmpty()
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1


def plain_quality_score(model, x):
    """By single look-ups, feature by feature and pair by pair."""
    fine = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, x, strict=True)]
    coarse = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.coarse, x, strict=True)]
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, fine, strict=True)) + sum(t[coarse[p]][coarse[q]] for (p, q), t in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + math.exp(-total))


def test_quality_scores_against_plain_lookups(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    # The same tables come from plain lists of the labelled texts.
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sorted((r["quality"], quality_model.features_of((texts[r["doc_id"]] or "").encode())) for r in labels.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5)
    x, y = np.array([f for _, f in rows], float), np.array([q for q, _ in rows], float)
    order = np.lexsort((*x.T, y))
    again = quality_model.fit(x[order], y[order])
    for r in registry.queries()["op5_quality_model"](spark, DATA).collect():
        want = plain_quality_score(again, quality_model.features_of((texts[r["doc_id"]] or "").encode()))
        assert r["score"] == pytest.approx(want, rel=1e-6) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert quality_model.score(docs, model).count() == len(texts)


def test_quality_features_look_at_whole_words():
    names = quality_model.FEATURES
    x = quality_model.features_of(b"abcdefgh1zzzz abcdefgh2zzzz " + b"x" * 300 + b" " + b"y" * 300)
    assert x[names.index("once_run")] == 1 and x[names.index("distinct")] == 1 and x[names.index("top_word")] == 0.25


def test_quality_repeated_ids_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i} of words", "a", "en") for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 3, "doc_id bigint, quality int")
    seen = []
    original = quality_model.fit
    try:
        quality_model.fit = lambda x, y: seen.append(len(y)) or original(x, y)
        quality_model.train(docs, labels, sample=5)
    finally:
        quality_model.fit = original
    assert seen and seen[0] <= 5


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    assert (0, 1) in {tuple(sorted(p)) for p in model.pairs} and ((model.score(x) > 0.5) == y).mean() > 0.9


# 6


def plain_rules(rows, least_texts, fence):
    """All measures and decisions of (doc_id, text, lang) rows by plain counting."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for _, text, lang in rows:
        text = text or ""
        w = text.encode().split()
        full = [x for x in text.split("\n") if x.encode().split()]
        found = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = len({j for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
        tokens = [t for x in w for t in model.encode(x.decode())]
        n, chars = len(tokens), sum(len(x.decode()) for x in w)
        entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(tokens).values())
        kinds = collections.Counter()
        for c in text:
            if c.isascii():
                kinds["Latin"] += c.isalpha()
            else:
                kinds[quality_rules._NAMES[quality_rules._SCRIPT_TABLE[c.encode()[0]]]] += 1
        kinds = {k: v for k, v in kinds.items() if k and v}
        script = min(kinds, key=lambda k: (-kinds[k], k)) if kinds else ""
        values = {"chars_per_token": chars / n if n else 0.0, "byte_share": sum(map(model.is_byte, tokens)) / n if n else 0.0, "entropy_share": entropy / math.log2(n) if n > 1 else 1.0}
        base = (len(w), chars, sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), repeated)
        out.append({"base": base, "n": n, "entropy": entropy, "values": values, "script": script, "lang": lang, "failed": len(w) < 10 or 100 * repeated > 20 * len(w)})
    groups = collections.defaultdict(list)
    length = lambda r: max(1, r["n"]).bit_length() - 1
    for r in out:
        if not r["failed"]:
            for kind in ("lang", "script"):
                groups[kind, r[kind], length(r)].append(r)
    for r in out:
        own = next((g for k in ("lang", "script") if r[k] is not None and len(g := groups[k, r[k], length(r)]) >= least_texts), None)
        r["left"] = []
        for m, (side, width, step) in quality_rules.RULES.items() if own and r["n"] else ():
            v = sorted(round(x["values"][m] / step) for x in own)
            q1, q3 = (v[math.ceil(k * len(v) / 4) - 1] for k in (1, 3))
            far = max((q3 - q1) * step, width) * fence
            if side != "high" and r["values"][m] < q1 * step - far - 1e-6 or side != "low" and r["values"][m] > q3 * step + far + 1e-6:
                r["left"].append(m)
    return out


@pytest.mark.parametrize("least_texts", [1, 5])
def test_rules_against_plain_version(spark, odd, none, least_texts):
    docs = odd.select("doc_id", "text", "lang").union(spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id") + 100, "text", "lang"))
    rows = [tuple(r) for r in docs.collect()]
    want = plain_rules(rows, least_texts, 2.0)
    out = quality_rules.apply_rules(docs.withColumn("kept", F.lit(3)), least_texts=least_texts).collect()
    measured = lambda base, n, script, lang, values, entropy, failed, left: (*base, n, script, lang or "", *[round(x, 9) for x in (*values, entropy)], failed, left, not failed and not left)
    got = sorted(
        measured((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["n_tokens"], r["script"], r["lang"], [r[m] for m in quality_rules.RULES], r["token_entropy"], r["base_failed"], r["band_failed"])
        for r in out
    )
    assert got == sorted(measured(w["base"], w["n"], w["script"], w["lang"], w["values"].values(), w["entropy"], w["failed"], ",".join(w["left"])) for w in want)
    assert all(r["kept"] == (not r["base_failed"] and r["band_failed"] == "") for r in out) and any(r["band_failed"] for r in out)
    assert quality_rules.apply_rules(none).isEmpty()


def test_scripts():
    found = {t: quality_rules._script(t.encode()) for t in ("abc é", "привет", "Ελληνικά", "漢字かな", "한국어", "مرحبا", "123 !", "नमस्ते", "שלום")}
    assert list(found.values()) == ["Latin", "Cyrillic", "Greek", "Han", "Hangul", "Arabic", "", "Indic", "Hebrew"]


# 7


def plain_components(docs, n, pct):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        o = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * o >= pct * (len(sets[a]) + len(sets[b]) - o):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "pct", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_components_against_brute_force(spark, n, pct, seed):
    rng, texts = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 20, 90, 300]))]
        for _ in range(rng.choice([3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w[rng.choice([0, 0, 3]) :]))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(30)]) for _ in range(30)]
    texts += ["", None, "a", "a", "a b", "A  b", "a b c a b c", "b c a b c a a b c"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True))
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), n, pct).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == plain_components(docs, n, pct)


@pytest.mark.parametrize("pct", [80, 90])
@pytest.mark.parametrize("documents", [1, 10**6, 10**13])
def test_linked_sets_share_a_signature(pct, documents):
    rng, bands = np.random.default_rng(pct), ngram_join.Bands(pct, documents)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(np.exp(rng.uniform(0, 7))) + 1, dtype=np.uint64) * np.uint64(2))
        k = int(rng.integers(0, bands.differ(len(a), len(a)) + 1))
        gone = rng.choice(len(a), min(k // 2, len(a) - 1), replace=False)
        b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(0, 2**63, k - len(gone), dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert ngram_join.least_differ(ngram_join.sketch(a)[8:], ngram_join.sketch(b)[8:]) <= differ
        if ngram_join._linked(len(a), len(b), differ, pct):
            assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_components_with_dealt_ngrams(spark, monkeypatch):
    """The same links where every n-gram that several hold is dealt out by salt."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(30)]) for _ in range(30)]
    docs = list(enumerate(texts))
    monkeypatch.setattr(ngram_join, "PER_TASK", 3)
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == plain_components(docs, 3, 80)


def test_components_odd_rows(odd, none):
    out = ngram_join.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    by = collections.defaultdict(set)
    for r in out:
        by[r["doc_id"]].add(r["component_id"])
    assert by[4] == {4} and by[5] == {4} and by[1] == {1} and by[2] == {2} and by[None] == {None}
    assert ngram_join.near_duplicates(none).isEmpty()


# 8


def test_language_model_base(spark, odd):
    out = language_model.score(odd).collect()
    assert len(out) == len(ODD)
    trained = [t for i, t, *_ in ODD if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    counts = collections.Counter(w for t in trained for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    for r in out:
        t = next(t for i, t, *_ in ODD if i == r["doc_id"])
        tokens = [*words(t), b""]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert r["train_tokens"] == n and r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def one_block(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = language_model.encode(docs.coalesce(1), 10).collect()
    assert len(rows) == 1
    return docs, language_model.Block(rows[0].asDict())


def some_texts(seed, n=60):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.random() ** 3 * 50)}" for _ in range(rng.choice([0, 1, 2, 15, 16, 17, 70])))) for i in range(n)] + [(n, None), (n + 1, "new words only")]


def plain_scores(texts, mixer, n_bits):
    """Each text's log10 probability, token by token and bit by bit, by dictionaries of all training text."""
    m, hash_of = language_model, {}
    split = {i: [*words(t), b""] for i, t in texts}
    for seq in split.values():
        hash_of.update({w: xxhash.xxh3_64_intdigest(w) for w in seq})
    code = lambda w: f"{hash_of[w] >> (64 - m.CODE):0{m.CODE}b}"
    context = lambda seq, t, kind: tuple(seq[t - 1 - k] if t > k else None for k in range(kind + 1))
    taken, count, in_class, different = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    learned = [seq for i, seq in split.items() if not language_model.held_out(i, 10)]
    for w in itertools.chain(*learned):
        count[w] += 1
    frequent = set(sorted(count, key=lambda w: (-count[w], hash_of[w]))[: m.FREQUENT])
    # A word before is a context of its own if it is frequent, and else by its class.
    cell = lambda seq, t: None if not t else seq[t - 1] if seq[t - 1] in frequent else code(seq[t - 1])[: m.CELL_BITS]
    for seq in learned:
        for t, w in enumerate(seq):
            taken.update(((0, cell(seq, t), code(w)[:j]) for j in range(m.CELL_BITS + 1)))
            taken.update((1, context(seq, t, 1), code(w)[:j]) for j in (*range(n_bits + 1), m.CODE))
    for w, c in count.items():
        in_class.update({code(w)[:j]: c for j in range(n_bits + 1)})
        different[code(w)[:n_bits]] += 1
    other_way = lambda path: path[:-1] + "10"[int(path[-1])]
    out = {}
    for i, seq in split.items():
        less, total = int(not language_model.held_out(i, 10)), 0.0
        weights, refined = np.array(mixer.weights, float), np.array(mixer.refined, float)
        for t0 in range(0, len(seq), m.CHUNK):
            moves, marks = np.zeros_like(weights), collections.defaultdict(list)
            for t in range(t0, min(len(seq), t0 + m.CHUNK)):
                w, path = seq[t], code(seq[t])
                offered, offers = None, 0
                for k in (0, 1):
                    places = [s for s in range(t) if context(seq, s, k) == context(seq, t, k)]
                    if places:
                        offered, offers = code(seq[places[-1]])[:n_bits], k + 1
                pair = lambda n: max(0, taken[1, context(seq, t, 1), path[:n]] - less)  # noqa: B023, E731
                gate = ((pair(0) > 0) + (pair(0) > 3) + (pair(0) > 40)) * m.OFFERS + offers
                for j in range(n_bits):
                    here = path[: j + 1]
                    x = [math.log((in_class[here] + 0.4) / (in_class[other_way(here)] + 0.4))]
                    for kind, key in ((0, cell(seq, t)), (1, context(seq, t, 1))):
                        if kind == 0 and j >= m.CELL_BITS:
                            x.append(0)
                            continue
                        odds = math.log((max(0, taken[kind, key, here] - less) + 0.4) / (taken[kind, key, other_way(here)] + 0.4))
                        x.append(max(-127, min(127, round(m.STEPS * odds))) / m.STEPS)
                    x.append(0 if offered is None or offered[:j] != path[:j] else 1 if offered[j] == path[j] else -1)
                    dot = max(-7.99, min(7.99, sum(a * b for a, b in zip(x, weights[:, gate, j], strict=True))))
                    q = 1 / (1 + math.exp(-dot))
                    place = round(2 * abs(dot))
                    r = refined[place] if dot >= 0 else 1 - refined[place]
                    total += math.log10((q + r) / 2)
                    moves[:, gate, j] += m.LEARN * (1 - q) * np.array(x)
                    marks[place].append(dot >= 0)
                p = (count[w] + 0.1) / (in_class[path[:n_bits]] + 0.1 * (different[path[:n_bits]] + 1))
                total += math.log10((pair(m.CODE) + m.SMOOTH * p) / (pair(n_bits) + m.SMOOTH))
            weights += moves
            for place, right in marks.items():
                refined[place] += (1 - (1 - m.REFINE) ** len(right)) * (sum(right) / len(right) - refined[place])
        out[i] = total
    return out


def cells_and_frequent(block, most):
    """As the driver has them, from one block."""
    counts = np.bincount(block.tokens[~block.held], minlength=len(block.words))
    order = sorted(range(len(counts)), key=lambda i: (-counts[i], int(block.words[i].view(np.int64))))[:most]
    frequent = np.sort(block.words[[i for i in order if counts[i]]])
    context, own = language_model.cells_of(block, frequent)
    size = (language_model.FREQUENT + (1 << language_model.CELL_BITS) + 1) << language_model.CELL_BITS
    return language_model.cell_odds(np.bincount((context << language_model.CELL_BITS)[~block.held] + own[~block.held], minlength=size)), frequent


@pytest.mark.parametrize("grow_from", [1 << 26, 100])
def test_language_model_against_plain_version(spark, monkeypatch, grow_from):
    # What the executors use of the module stands as it is there; these are the driver's.
    monkeypatch.setattr(language_model, "GROW_FROM", grow_from)
    monkeypatch.setattr(language_model, "RANGE_KEYS", 300)
    texts = some_texts(3)
    docs, block = one_block(spark, texts)
    n_bits = language_model.sizes(int((~block.held).sum()))
    assert n_bits == (10 if grow_from > 100 else 13)
    by_class = np.bincount((block.words >> np.uint64(64 - n_bits)).astype(np.int64)[block.tokens[~block.held]], minlength=1 << n_bits)
    first = language_model.Mixer(n_bits, by_class)
    weights, seen = first.learn(block, language_model.own_predictions(block, n_bits, *cells_and_frequent(block, language_model.FREQUENT)))
    mixer = language_model.Mixer(n_bits, by_class, weights, (seen[0] + 20 * first.refined) / (seen[1] + 20))
    want = plain_scores(texts, mixer, n_bits)
    for r in language_model.score(docs.coalesce(1)).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=2e-4)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / max(1, len((dict(texts)[r["doc_id"]] or "").encode())))


def test_language_model_sums_over_many_blocks(spark, monkeypatch):
    """Blocks and ranges of any size answer with the same counts; only the first weights depend on the blocks they are learned on."""
    texts = some_texts(4)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    _, block = one_block(spark, texts)
    made = language_model.encode(docs.repartition(5), 10).collect()
    monkeypatch.setattr(language_model, "RANGE_KEYS", 20)
    n_bits, part_bits, context_bits = 10, 3, 36
    rows = spark.createDataFrame(made, language_model.BLOCK)
    asked = rows.mapInArrow(language_model._ask_pairs(part_bits, context_bits), language_model.ASKED)
    answers = asked.coalesce(1).sortWithinPartitions("part", "kind").mapInArrow(language_model._summed(1, language_model._pair_answer(n_bits)), language_model.ANSWER).collect()
    cells, frequent = cells_and_frequent(block, 7)
    whole = language_model.own_predictions(block, n_bits, cells, frequent)

    def told(found, t):
        k = found.row[t]
        return tuple(found.odds[k]), found.in_class[k], found.as_word[k], found.level[k], tuple(found.by_cell(np.array([t]))[0])

    starts = dict(zip([i for i, _ in texts], block.starts, strict=True))
    for row in made:
        part = language_model.Block(row.asDict())
        payloads = [a["payload"] for a in sorted(answers, key=lambda a: a["part"]) if a["block"] == row["block"]]
        found = language_model.Predictions(part, payloads, cells, frequent, n_bits, part_bits, context_bits)
        for i, n, at in zip(row["doc_ids"], part.lengths, part.starts, strict=True):
            assert [told(found, at + k) for k in range(n)] == [told(whole, starts[i] + k) for k in range(n)]


def test_cells_are_summed_over_tasks(spark):
    texts = some_texts(6)
    _, block = one_block(spark, texts)
    cells, frequent = cells_and_frequent(block, 7)
    rows = spark.createDataFrame(language_model.encode(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4), 10).collect(), language_model.BLOCK).repartition(3)
    counted = rows.mapInArrow(language_model._count_cells(frequent), "part int, cells binary").coalesce(1).sortWithinPartitions("part")
    parts = sorted(counted.mapInArrow(language_model._sum_cells, "part int, odds binary").collect())
    got = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int8).reshape(2, -1, 2 << language_model.CELL_BITS) for _, x in parts], axis=1)
    assert (got == cells).all()


def test_class_bits_are_a_distribution():
    """What the mixer gives the classes that may follow a text adds up to one."""
    rng, n_bits = np.random.default_rng(2), 10
    texts = [[5, 9, 5, 9, 5, k] for k in range(1 << n_bits)]
    words = (np.arange(1 << n_bits, dtype=np.uint64) << np.uint64(64 - n_bits)).tobytes()
    row = {"words": words, "tokens": language_model.pack(np.array(texts, np.int32).ravel()), "n_tokens": language_model.pack(np.full(len(texts), 6, np.int32)), "held": [False] * len(texts)}
    block = language_model.Block(row)
    # Any odds will do, as long as both ways of a bit have them with unlike signs.
    every, tree = np.arange(1 << n_bits), np.rint(rng.normal(size=(2, 1 << n_bits)) * 20)

    def drawn(k):
        node = lambda j: (every >> (n_bits - j)) + (1 << j)
        return np.stack([np.where(every >> (n_bits - 1 - j) & 1, 1, -1) * tree[k][node(j) % len(tree[k])] for j in range(n_bits)], axis=1).astype(np.int8)

    class Found:
        row, level = block.tokens, np.full(1 << n_bits, 2, np.int8)
        by_cell = staticmethod(lambda at, odds=drawn(0): odds[block.tokens[at]])
        by_pair = staticmethod(lambda at, odds=drawn(1): odds[block.tokens[at]])

    found = Found()
    mixer = language_model.Mixer(n_bits, rng.integers(0, 50, 1 << n_bits), rng.normal(size=(language_model.K, language_model.GATES, n_bits)).astype(np.float32), rng.random(language_model.BINS))
    mixer.refined[0] = 0.5
    assert (2 ** mixer.bits(block, found)[5::6]).sum() == pytest.approx(1, abs=1e-4)


def test_learning_helps(spark):
    _, block = one_block(spark, some_texts(5, 300))
    by_class = np.bincount((block.words >> np.uint64(54)).astype(np.int64)[block.tokens[~block.held]], minlength=1 << 10)
    first, found = language_model.Mixer(10, by_class), language_model.own_predictions(block, 10, *cells_and_frequent(block, 4096))
    weights, seen = first.learn(block, found)
    second = language_model.Mixer(10, by_class, weights.astype(np.float32), (seen[0] + 20 * first.refined) / (seen[1] + 20))
    assert second.bits(block, found)[block.held].sum() > first.bits(block, found)[block.held].sum()


def test_copies_are_scored_apart(spark):
    rng = random.Random(7)
    texts = [(i, " ".join(f"w{int(rng.random() ** 2 * 3000)}" for _ in range(80))) for i in range(200)]
    twice = [(1000 + i, texts[i][1]) for i in range(0, 40, 2)]
    out = {r["doc_id"]: r["bits_per_byte"] for r in language_model.score(spark.createDataFrame(texts + twice, "doc_id bigint, text string")).collect()}
    copies = {i for i, _ in twice} | {i - 1000 for i, _ in twice}
    learned = {i for i in out if not language_model.held_out(i, 10) and (i not in copies or not language_model.held_out((i + 1000) if i < 1000 else i - 1000, 10))}
    assert max(out[i] for i in learned & copies) < min(out[i] for i in out if i not in copies)


def test_language_model_learns_from_every_block(spark, monkeypatch):
    """The first weights and the map are those of all blocks, each by its training tokens."""
    m, texts, learned = language_model, some_texts(17, 40), []
    made = m.Mixer.__init__

    def watched(self, *given):
        learned.extend(given[2:])
        made(self, *given)

    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(12, "doc_id")
    blocks = [m.Block(r.asDict()) for r in m.encode(docs, 10).collect()]
    assert len(blocks) > 8
    with monkeypatch.context() as patched:
        patched.setattr(m.Mixer, "__init__", watched)
        assert m.score(docs).count() == len(texts)
    _, whole = one_block(spark, texts)
    by_class = np.bincount((whole.words >> np.uint64(54)).astype(np.int64)[whole.tokens[~whole.held]], minlength=1 << 10)
    first, (cells, frequent) = m.Mixer(10, by_class), cells_and_frequent(whole, m.FREQUENT)
    each = [(int((~b.held).sum()), *first.learn(b, m.own_predictions(b, 10, cells, frequent))) for b in blocks]
    weights, seen = sum(n * w for n, w, _ in each) / sum(n for n, _, _ in each), sum(s for _, _, s in each)
    assert np.allclose(learned[0], weights, atol=1e-5) and np.allclose(learned[1], (seen[0] + 20 * first.refined) / (seen[1] + 20))


def test_language_model_without_training(spark, none):
    assert language_model.score(none).isEmpty()
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = language_model.score(spark.createDataFrame([(held, "a b", "s", "en")], DOCS)).first()
    assert out["held_out"] and out["n_known"] == 0 and out["train_tokens"] == 0


# 9


def test_edited_trees_equal_full_counts():
    encoder, rng = token_counts.Encoder(), random.Random(6)
    parts = ["a", "'s", "'re", "'r", "  ", " ", "\n", "\n\n", "é", "1", "22", "!!", " the", "tion", "'ll", "\t", "漢", "😀"]
    text_of = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(300):
        text = text_of(rng.choice([0, 1, 40, 700]))
        tree = encoder.tree(text)
        for _ in range(4):
            text, n = tree.edit(text, rng.randrange(len(text) + 3), rng.choice([0, 1, 2, 60]), text_of(rng.choice([0, 1, 3, 90])), encoder)
            assert tree.n_tokens == len(encoder.bpe.encode_ordinary(text))
            assert tree.flat()[0].tolist() == [len(x) for x in encoder.split.findall(text)]


def test_stored_trees(spark, odd, none):
    edits = F.array(F.struct(F.lit(3).cast("bigint").alias("pos"), F.lit(2).cast("bigint").alias("n_delete"), F.lit(" new").alias("insert")))
    stored = token_counts.build_trees(odd)
    out = token_counts.update_trees(stored.withColumn("edits", F.when(F.col("doc_id") != 7, edits))).collect()
    encoder = token_counts.Encoder()
    assert len(out) == len(ODD) and all(r["n_tokens"] == len(encoder.bpe.encode_ordinary(r["text"] or "")) for r in out)
    once = token_counts.count_edited(odd.withColumn("edits", edits)).collect()
    assert {(r["doc_id"], r["n_tokens_after"]) for r in once if r["doc_id"] not in (7, None)} == {(r["doc_id"], r["n_tokens"]) for r in out if r["doc_id"] not in (7, None)}
    assert next(r["n_encoded"] for r in once if r["doc_id"] == 6) < 20
    assert token_counts.count_edited(none.withColumn("edits", edits)).isEmpty()


def test_counts_of_long_edits_against_full_counts(spark):
    """Edits over many leaves, through stored trees."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "don't", "  x", "\n\n", "é1", "漢"]) for _ in range(3000)) for _ in range(4)]
    plans = [[(rng.randrange(8000), rng.choice([0, 1500, 6000]), rng.choice(["", " it's " * 700, "x"])) for _ in range(3)] for _ in texts]
    docs = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(texts, plans, strict=True))], f"doc_id bigint, text string, edits {token_counts.EDIT}")
    encoder = token_counts.Encoder()
    for r in token_counts.count_edited(docs).collect():
        text = before = texts[r["doc_id"]]
        for pos, n, insert in plans[r["doc_id"]]:
            text = text[:pos] + insert + text[min(pos, len(text)) + n :]
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(encoder.bpe.encode_ordinary(before)), len(encoder.bpe.encode_ordinary(text)))
        assert r["n_pretokens"] == len(encoder.split.findall(before))


def test_query_of_edits_against_full_counts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    edits = {r["doc_id"]: (r["text"] or "", r["e"]) for r in rows.withColumn("e", token_counts.sample_edits(F.col("doc_id"), F.col("text"))).collect()}
    encoder = token_counts.Encoder()
    out = registry.queries()["op9_token_counts"](spark, DATA).collect()
    assert len(out) == len(edits)
    for r in out:
        text, todo = edits[r["doc_id"]]
        after = text
        for e in todo:
            after = after[: e["pos"]] + e["insert"] + after[e["pos"] + e["n_delete"] :]
        assert (r["n_pretokens"], r["n_tokens"], r["n_tokens_after"]) == (len(encoder.split.findall(text)), len(encoder.bpe.encode_ordinary(text)), len(encoder.bpe.encode_ordinary(after)))


# 10

PAGES = "page_id bigint, url string, html string, run string"


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 300 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://B.example/x?b=2&a=1#f", long, "r"), (2, "https://www.b.example:443/x?a=1&b=2", long, "r"), (3, None, None, None), (4, "a\r\nb", "", "r"), (5, "http://[bad", "x" * 99, "r"), (6, "http://c/", "x" * 99, "r"), (None, "http://d/", long, "r")]
    path = warc.write_archive(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w")
    out = {r["page_id"]: r for r in warc.merge_runs(warc.read_archive(spark, path)).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in out.items() if k in (1, 2, None)} == {1: ("response", None), 2: ("revisit", 1), None: ("revisit", 1)}
    assert out[1]["payload_bytes"] == out[2]["payload_bytes"] == len(long.encode()) and out[1]["url_key"] == out[2]["url_key"]
    assert all(out[k]["record_type"] == "response" for k in (3, 4, 5, 6))
    bodies = [x for f in tmp_path.glob("w/part-*") for _, _, x in warc.records(f.read_bytes())]
    assert sum(x.endswith(long.encode()) for x in bodies) == 1 and len(bodies) == len(rows)
    # A reader may start at any offset of the index.
    files = {f.name: f.read_bytes() for f in tmp_path.glob("w/part-*")}
    for r in out.values():
        _, fields, _ = next(warc.records(files[r["run"]][r["offset"] :]))
        assert fields["warc-record-id"] == f"<{warc.ID}{'' if r['page_id'] is None else r['page_id']}>"
    assert all(gzip.decompress(x).count(b"WARC/1.1\r\nWARC-Type") for x in files.values())
    assert warc.merge_runs(warc.read_archive(spark, warc.write_archive(spark.createDataFrame([], PAGES)))).isEmpty()


def test_cut_archive_is_an_error(tmp_path):
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    for content in (whole, whole[:-3], gzip.compress(b"nothing of the kind")):
        with pytest.raises(ValueError):
            list(warc.records(content))


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    body = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    pages = [(i, f"http://h/{i}", body(2_000_000 if i == 3 else 30_000), "") for i in range(40)]
    path = warc.write_archive(spark.createDataFrame(pages, PAGES).coalesce(1), f"file://{tmp_path}/w")
    found = sorted(f.stat().st_size for f in tmp_path.glob("w/part-*"))
    assert len(found) > 4 and all(x < 300_000 for x in found[:-1])
    assert {r["page_id"]: r["payload_bytes"] for r in warc.read_archive(spark, path).collect()} == {i: len(h) for i, _, h, _ in pages}


def test_many_equal_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://h/", "x" * 200 if i % 3 else f"{i}" * 99, "") for i in range(60)], PAGES)
    for most in (1_000_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_KEYS", most)
        out = {r["page_id"]: r["refers_to"] for r in warc.read_archive(spark, warc.write_archive(pages)).collect()}
        assert out == {i: 1 if i % 3 and i != 1 else None for i in range(60)}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(((f"r{i}", rng.choice("abc"), rng.choice("xyz"), rng.randrange(9), "", 0, "", "", None, n) for n in range(rng.randrange(7))), key=warc._rank) for i in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(itertools.chain(*runs), key=warc._rank)


def test_histories_are_in_order(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    pages = spark.createDataFrame([(i, f"http://h{rng.choice('aaab')}/p", f"body {i}", "") for i in range(300)], PAGES)
    merged = warc.merge_runs(warc.read_archive(spark, warc.write_archive(pages))).collect()
    assert [warc._rank(r) for r in merged] == sorted(warc._rank(r) for r in merged) and len(merged) == 300


def test_without(spark, monkeypatch):
    rows, keys = spark.createDataFrame([(1,), (2,), (None,)], "k bigint"), spark.createDataFrame([(2,), (None,)], "k bigint")
    assert sorted(without(rows, keys, "k").collect(), key=str) == [(1,), (None,)]
    monkeypatch.setattr("loomgraph.llm.common.BROADCAST_KEYS", 0)
    assert sorted(without(rows, keys, "k").collect(), key=str) == [(1,), (None,)]


def test_scratch_is_shared_on_a_cluster():
    class Context:
        applicationId, master = "a", "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        scratch_root(Session())
