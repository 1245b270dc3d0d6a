import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import decontamination, mixing, quality_model, registry
from oracle import DATA, check
from test_llm_operators import plain_components, plain_quality_score

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name])


def plain_lines(rows, ratio=0.02, min_pages=5):
    pages, held = collections.Counter(), collections.Counter()
    key = lambda x: x.strip(" \t\r")
    for r in rows:
        pages[r["source"] or ""] += 1
        held.update({(r["source"] or "", key(x)) for x in (r["text"] or "").split("\n") if key(x)})
    cut = {k for k, n in held.items() if n >= min_pages and n > ratio * pages[k[0]]}
    out = {}
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if (r["source"] or "", key(x)) not in cut]
        out[r["doc_id"]] = "\n".join(kept) if len(kept) < len(lines) else r["text"]
    return out


def plain_contaminated(text, items, slack=decontamination.SLACK):
    w = decontamination.words_of((text or "").encode())
    at = collections.defaultdict(list)
    for i, x in enumerate(w):
        at[x].append(i)
    for item in items:
        for win in decontamination.windows_of(item, 10) if item else []:
            if any(w[i : i + len(win)] == win for i in at.get(win[0], ())):
                return True
        if item and all(x in at for x in item):
            want, span = set(item), max(len(item), int(slack * len(item)))
            if any(want <= set(w[i : i + span]) for x in want for i in at[x]):
                return True
    return False


def plain_mixture(rows, budget=0.5, iterations=12):
    """doc_id to rate and copies, raked cell by cell."""
    def cell(r):
        t = r["text"] or ""
        topic = "legal" if "licens" in t.lower() else "tabular" if " | " in t else "prose"
        return tuple(v if v in mixing.TARGETS[d] and v != "*" else "*" for d, v in (("source", r["source"]), ("lang", r["lang"]), ("topic", topic)))

    have = collections.Counter()
    for r in rows:
        have[cell(r)] += len((r["text"] or "").encode().split())
    share = {c: float(n) for c, n in have.items()}
    for _ in range(iterations):
        for k, (d, targets) in enumerate(mixing.TARGETS.items()):
            there = {c[k] for c in have}
            total = sum(targets.get(v, 0) for v in there)
            now = collections.Counter()
            for c, s in share.items():
                now[c[k]] += s
            for c in share:
                share[c] = share[c] * targets.get(c[k], 0) / total / now[c[k]] if total and now[c[k]] else 0.0
    total, tokens = sum(share.values()), sum(have.values())
    out = {}
    for r in rows:
        c = cell(r)
        rate = share[c] / total * budget * tokens / have[c] if total and have[c] else 0.0
        u = int(hashlib.md5(f"{r['doc_id']}|mix".encode()).hexdigest()[:8], 16) / 2**32
        out[r["doc_id"]] = (rate, math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), [decontamination.words_of((r["text"] or "").encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    model = quality_model.train(docs, labels)
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}

    def after(name):
        nonlocal docs
        docs, before = corpus_pipeline.materialise(STAGES[name](spark, docs, DATA), name), docs.columns
        assert docs.columns == before
        found = [r.asDict() for r in docs.collect()]
        assert len({r["doc_id"] for r in found}) == len(found)
        return {r["doc_id"]: r for r in found}

    rows = {i: r for i, r in rows.items() if plain_quality_score(model, quality_model.features_of((r["text"] or "").encode())) >= 0.3}
    assert after("quality") == rows
    cut = plain_lines(list(rows.values()))
    rows = {i: r | {"text": cut[i], "n_chars": len(cut[i]) if cut[i] != r["text"] else r["n_chars"]} for i, r in rows.items()}
    assert after("line_dedup") == rows
    of = plain_components([(i, r["text"]) for i, r in rows.items()], 5, 80)
    rows = {i: r for i, r in rows.items() if of[i][1] == i}
    assert after("near_duplicates") == rows
    clean = {i: r for i, r in rows.items() if not plain_contaminated(r["text"], items)}
    assert after("decontaminate") == clean and len(clean) < len(rows)
    want = plain_mixture(list(clean.values()))
    out = {r["doc_id"]: r for r in STAGES["mix_sources"](spark, docs, DATA).collect()}
    assert out.keys() == {i for i, (_, n) in want.items() if n}
    for i, r in out.items():
        assert r["mix_rate"] == pytest.approx(want[i][0], rel=1e-6) and r["mix_copies"] == want[i][1]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == out.keys()


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, "  \n\t ", "xx", "a", 5),
    (None, "no id here but words enough for everything that looks at it", "en", "a", 1),
    (None, "no id here but words enough for everything that looks at it", "en", "a", 1),
    (None, "without an id either and unlike the others in every one of its words", "en", "a", 1),
    (4, "the same text of some words\nand a second line with some more", "en", "a", 1),
    (4, "the same text of some words\nand a second line with some more", "en", "a", 2),
    (4, "quite another text under the id that two other rows have too", "en", "a", 1),
    (5, "the same text of some words\nand a second line with some more", "de", "b", 1),
    (-6, LONG, "en", "a", 1),
    (7, "x", "en", "a", 1),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quite another text"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_on_odd_rows(spark, folder, monkeypatch):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"n_lines": F.lit("own"), "component_id": F.lit("own"), "id": F.lit(1), "key": F.lit(2)})
    every = sorted(map(str, ODD))

    def after(name):
        out = STAGES[name](spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns and {r["n_lines"] for r in out.collect()} <= {"own"}
        return sorted(str(tuple(r)[:5]) for r in out.collect())

    monkeypatch.setattr(quality_model, "THRESHOLD", 0.0)
    assert after("quality") == every
    assert after("line_dedup") == every
    # Of equal rows, and of documents near to each other, one stays; the others under its id do too.
    assert after("near_duplicates") == sorted(str(r) for i, r in enumerate(ODD) if i not in (4, 7, 9))
    assert after("decontaminate") == sorted(str(r) for r in ODD if r[1] is None or "quite another" not in r[1])
    assert set(after("mix_sources")) <= set(every)


def test_stages_on_empty_tables(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).isEmpty(), name
