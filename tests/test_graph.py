"""Golden cases of tokens, scores, clusters, feedback and evaluation."""

import base64
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.tokens import jaccard, normalize, split_tokens
from loomgraph.operators import anchors as A
from loomgraph.operators import feedback as B
from loomgraph.operators import stats as X
from loomgraph.operators import substrings
from loomgraph.operators.numbering import numbered
from loomgraph.operators.scratch import shared_folder
from loomgraph.operators import scratch, similarity
from loomgraph.operators.similarity import score_pairs, token_idf
from loomgraph.plans import evaluate as E
from loomgraph.plans import registry
from loomgraph.plans.query import expand, query
from loomgraph.streaming import implicit
from oracle import DATA


def node(id, type, raw_name, service, fields=(), method=None, path=None, target=None):
    return (id, type, raw_name, service, None, method, path, target, list(fields))


def graph(spark, *rows):
    return normalize(spark.createDataFrame(list(rows), schema.SCANNED))


SMALL = [
    node("web::fe::createOrder", "frontend_mutation", "createOrder", "web", ["items", "userId"]),
    node("gateway::gql::createOrder", "graphql_mutation", "createOrder", "gateway", ["input", "items", "userId"]),
    node("orders::http::POST", "http_endpoint", "createOrder", "orders-svc", ["items", "userId"], "POST", "/orders"),
    node("orders::kafka", "kafka_topic", "order-created", "orders-svc", ["orderId", "userId"], "produce"),
    node("billing::kafka", "kafka_topic", "order-created", "billing-svc", ["orderId", "userId"], "consume"),
    node("users::http::GET", "http_endpoint", "getUserProfile", "users-svc", ["userId", "email"], "GET", "/users/{id}"),
    node("gateway::gql::userProfile", "graphql_query", "userProfile", "gateway", ["userId"]),
    node("billing::refund", "http_endpoint", "refundPayment", "billing-svc", ["paymentId"], "POST", "/payments/refund"),
]


@pytest.mark.parametrize(
    ("name", "tokens"),
    [
        ("createOrderItem", ["create", "order", "item"]),
        ("GetUserProfile", ["get", "user", "profile"]),
        ("order-item-created", ["order", "item", "created"]),
        ("HTTPServerX", ["http", "server"]),
        ("/owners/{ownerId}", ["owners", "{owner", "id}"]),
        ("a_b", []),
        ("", []),
    ],
)
def test_tokens(spark, name, tokens):
    assert spark.range(1).select(split_tokens(F.lit(name))).first()[0] == tokens


def test_jaccard(spark):
    both = F.array(F.lit("a"), F.lit("b"))
    none = F.array().cast("array<string>")
    assert spark.range(1).select(jaccard(both, both), jaccard(none, both)).first()[:] == (1.0, 0.0)


def test_complementary_pair_without_weights(spark):
    pair = graph(spark, node("a", "graphql_mutation", "createOrder", "x"), node("b", "kafka_topic", "order-created", "y"))
    assert score_pairs(pair).first()["total_score"] == pytest.approx(0.2979)


def test_unlike_nodes_have_no_edge(spark):
    assert score_pairs(graph(spark, node("a", "graphql_query", "getUser", "x"), node("b", "kafka_topic", "payment-processed", "y"))).isEmpty()


def test_other_services_score_higher(spark):
    pairs = [
        graph(spark, node("a", "http_endpoint", "createOrder", "x", method="POST"), node("b", "graphql_mutation", "createOrder", "y")),
        graph(spark, node("a", "http_endpoint", "createOrder", "x"), node("b", "graphql_type", "createOrderResponse", "x")),
    ]
    assert [score_pairs(p).first()["total_score"] for p in pairs] == [pytest.approx(0.9969), pytest.approx(0.2933)]


@pytest.mark.parametrize("holders", [1000, 1, 2])
def test_prefix_filter_loses_no_edge(spark, monkeypatch, holders):
    monkeypatch.setattr("loomgraph.operators.similarity.HOLDERS_A_TASK", holders)
    nodes = graph(spark, *SMALL)
    idf = token_idf(nodes)
    every = score_pairs(nodes, idf, min_score=0.0).where("total_score >= 0.12").collect()
    assert sorted(every) == sorted(score_pairs(nodes, idf).collect())


def test_direction(spark):
    edges = score_pairs(graph(spark, *SMALL), bff={"gateway"}).collect()
    ways = {(e["source_id"], e["target_id"]): (e["from_service"], e["to_service"]) for e in edges}
    assert ways["billing::kafka", "orders::kafka"] == ("orders-svc", "billing-svc")
    assert ways["gateway::gql::createOrder", "web::fe::createOrder"] == ("web", "gateway")
    call = graph(spark, node("a", "backend_client_call", "getOrder", "x", target="y"), node("b", "http_endpoint", "getOrder", "z"))
    assert score_pairs(call).select("from_service", "to_service").first()[:] == ("x", "y")


def test_service_words_in_hints_count_less(spark):
    nodes = graph(
        spark, node("1", "http_endpoint", "assistantGeneral", "ai-tools", ["chatbot"]), node("2", "http_endpoint", "aiToolsUserSetting", "ai-tools"), node("3", "kafka_topic", "x", "other-service")
    )
    hints = A.effective_hints(spark.createDataFrame([(1, "ai-tools chatbot assistant general")], "hint_id bigint, hint string"), nodes)
    assert [r["id"] for r in A.find_anchors(nodes, hints).collect()] == ["1"]


def test_query_and_expand(spark):
    nodes = graph(spark, *SMALL)
    edges = score_pairs(nodes, token_idf(nodes), {"gateway"})
    hints = spark.createDataFrame([(1, "createOrder"), (2, "nothing alike"), (3, "")], "hint_id bigint, hint string")
    out = query(nodes, edges, hints).orderBy("rank").collect()
    assert {r["query"] for r in out} == {"createOrder"}
    assert {n["id"] for n in out[0]["nodes"]} >= {"web::fe::createOrder", "gateway::gql::createOrder", "orders::http::POST"}
    assert any((e["from_service"], e["to_service"]) == ("web", "gateway") for e in out[0]["directed_edges"])
    found = expand(nodes, edges, spark.createDataFrame([("createorder",), ("absent",)], "name string"))
    assert found.where("source_id = 'web::fe::createOrder' AND neighbor_id = 'gateway::gql::createOrder'").first()["direction"] == "outbound"


def test_empty_graph(spark):
    nodes = graph(spark)
    edges = score_pairs(nodes, token_idf(nodes))
    hints = spark.createDataFrame([(1, "order")], "hint_id bigint, hint string")
    assert edges.isEmpty() and query(nodes, edges, hints).isEmpty() and A.find_anchors(nodes, A.effective_hints(hints, nodes)).isEmpty()


DAY = dt.datetime(2024, 6, 1)


def feedback(spark, *rows):
    return spark.createDataFrame([(DAY - dt.timedelta(days=age), "h", 1, ids, ok, "manual") for age, ids, ok in rows], schema.FEEDBACK)


def test_feedback_counts_and_age(spark):
    rows = feedback(spark, (1, ["A"], True), (2, ["A", "B", ""], False), (200, ["C"], True))
    now = {r["node_id"]: (r["accepted"], r["rejected"]) for r in B.feedback_counts(B.recent(rows, DAY)).collect()}
    assert now == {"A": (1, 1), "B": (0, 1)}
    assert "C" in {r["node_id"] for r in B.feedback_counts(B.recent(rows, DAY, 300)).collect()}
    assert [r["node_id"] for r in B.accepted_nodes(B.feedback_counts(B.recent(rows, DAY))).collect()] == ["A"]


@pytest.mark.parametrize(("votes", "wanted"), [([(1, ["A"], True)] * 4, [(1.1, 1), (0.55, 2)]), ([(1, ["A"], False)], [(0.5, 2), (0.55, 1)])])
def test_rerank(spark, votes, wanted):
    start = 0.5 if len(votes) == 4 else 0.6
    clusters = spark.createDataFrame([(1, 1, start, ["A"]), (1, 2, 0.55, ["Z"])], "hint_id bigint, rank int, confidence double, node_ids array<string>")
    hints = spark.createDataFrame([(1, "h")], "hint_id bigint, hint string")
    out = B.rerank(clusters, hints, B.feedback_counts(feedback(spark, *votes))).orderBy("prior_rank").collect()
    assert [(r["confidence"], r["rank"]) for r in out] == wanted


def activity(spark, *opened):
    kind = "session string, query_id bigint, hint string, ts timestamp, clusters array<struct<rank:int,node_names:array<string>,node_ids:array<string>>>"
    asked = spark.createDataFrame([("s", 1, "h", DAY, [(1, ["createorder"], ["A"]), (2, ["x"], ["B"])])], kind)
    rows = [("s", n, DAY + dt.timedelta(seconds=t)) for n, t in opened]
    return asked, spark.createDataFrame(rows, "session string, name string, ts timestamp")


@pytest.mark.parametrize(("opened", "n"), [([("createOrder", 600)], 1), ([("createOrder", 601)], 0), ([("other", 5)], 0), ([("Order", 5), ("createorder", 9)], 1)])
def test_implicit_feedback(spark, opened, n):
    found = B.implicit_feedback(*activity(spark, *opened)).collect()
    assert len(found) == n and all(r["source"] == "implicit_expand" and r["node_ids"] == ["A"] for r in found)


def test_rating_takes_the_latest_query_with_the_rank(spark):
    asked, _ = activity(spark)
    ratings = spark.createDataFrame([(1, "s", DAY + dt.timedelta(seconds=9), "h", 2), (2, "s", DAY, "h", 3)], "rating_id bigint, session string, ts timestamp, hint string, cluster_rank int")
    assert {r["rating_id"]: r["node_ids"] for r in B.rating_nodes(ratings, asked).collect()} == {1: ["B"], 2: []}


def test_metrics(spark):
    shown = "hint_id bigint, rank int, nodes array<struct<id:string>>"
    results = spark.createDataFrame([(1, 1, [("x",)]), (1, 2, [("a",)]), (2, 1, [("b",), ("c",)]), (3, 1, [("q",)])], shown)
    asked = "judgment_id bigint, hint_id bigint, hint string, expected_node_ids array<string>, match string, k int"
    judgments = spark.createDataFrame([(1, 1, "h", ["a"], "any", None), (2, 2, "h", ["b", "c"], "all", None), (3, 3, "h", ["z"], "any", 1)], asked)
    judged = E.judge(results, judgments)
    assert {r["judgment_id"]: r["rank"] for r in judged.collect()} == {1: 2, 2: 1, 3: None}
    scores = E.metrics(judged).first()
    assert (scores["hits"], scores["mrr"]) == (2, 0.5) and scores["hit_rate"] == pytest.approx(2 / 3)


def test_payload_tokens_against_the_encoder(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "createOrder", '{"id":"a::b","score":0.5}', "naïve 漢字  \n\n x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = E.token_counts(rows, "t", file, public_tokenizers.PATTERN).collect()
    assert [r["output_tokens"] for r in sorted(found)] == [len(encoding.encode_ordinary(t or "")) for t in texts]
    answers = registry.QUERIES["payload_tokens"](spark, DATA).collect()
    assert answers and all(0 < r["output_tokens"] < r["n_chars"] for r in answers)


def test_stale(spark):
    state = spark.createDataFrame([("a", "h", DAY), ("b", "h", DAY - dt.timedelta(days=7))], schema.REPO_STATE)
    assert X.stale(state, DAY).first()["age_days"] == 7 and X.stale(state, DAY).first()["warning"]
    assert X.stale(state, DAY - dt.timedelta(hours=1)).first()["warning"] is None


def test_issue_activity(spark):
    rows = [("bot[bot]", "User", False, DAY), ("Owner", "User", False, DAY), ("u", "User", False, DAY), ("u", "User", True, DAY), ("u", "User", False, DAY - dt.timedelta(days=9))]
    issues = spark.createDataFrame(rows, "login string, user_type string, is_pull_request boolean, created_at timestamp")
    assert X.issue_activity(issues, "owner", F.lit(DAY)).first()[:] == (3, 1, 1, 1)


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.createDataFrame([(f"k{i * 37 % 101:03}", i) for i in range(101)], "k string, v int").repartition(7)
    out = sorted((r["k"], r["n"]) for r in numbered(rows, "k", "n").collect())
    assert out == [(f"k{i:03}", i + 1) for i in range(101)]
    assert numbered(rows.limit(0), "k", "n").isEmpty()


@pytest.mark.parametrize("chars", [4_000_000, 5])
def test_contained_against_brute_force(spark, monkeypatch, chars):
    rng = random.Random(1)
    monkeypatch.setattr(substrings, "CHUNK_CHARS", chars)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i, word(rng.randrange(12)), None if i % 7 == 0 else word(3)) for i in range(80)]
    patterns = [(j, word(rng.choice([0, 1, 2, 2, 3]))) for j in range(12)] + [(90, None), (91, "ab"), (92, "ab")]
    rows, asked = spark.createDataFrame(texts, "i int, t string, u string"), spark.createDataFrame(patterns, "j int, p string")
    found = substrings.contained(rows, [F.col("t"), F.col("u")], asked, F.col("p"))
    want = sorted((i, j) for i, t, u in texts for j, p in patterns if p is not None and (p in t or u is not None and p in u))
    assert sorted((r["i"], r["j"]) for r in found.collect()) == want and found.columns == ["i", "t", "u", "j", "p"]
    assert substrings.contained(rows, [F.col("t")], asked.limit(0), F.col("p")).isEmpty()


def random_activity(seed, sessions=3, n=250):
    """Rows of (session, kind, ts, query_id, hint, name, clusters), many within each other's time to live."""
    rng, out = random.Random(seed), []
    for i in range(n):
        at, s = DAY + dt.timedelta(seconds=rng.randrange(40 * n)), f"s{rng.randrange(sessions)}"
        a, b = rng.choice("abcdefgh") * 2, rng.choice("abcdefgh") * 3
        if rng.random() < 0.6:
            out.append((s, "query", at, i, f"h{a}", None, [(1, [f"x{a}y"], [a]), (2, [b, "zz"], [b])]))
        else:
            out.append((s, "expand", at, i, None, rng.choice([a, b, f"x{a}y", "ZZ"]), None))
    return out


def plain_feedback(rows, ttl=600, most=20):
    found = []
    for s in {r[0] for r in rows}:
        waiting = []
        for _, kind, ts, query_id, hint, name, clusters in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1] != "query", r[3] if r[1] == "query" else 0, r[5] or "")):
            if kind == "query":
                waiting = [*waiting, (ts, query_id, hint, clusters)][-most:]
                continue
            for entry in list(waiting):
                hit = next((c for c in entry[3] if any(name.lower() in n or n in name.lower() for n in c[1])), None)
                if hit and ts - entry[0] <= dt.timedelta(seconds=ttl):
                    found.append((s, ts, entry[1], entry[2], hit[0], tuple(hit[2])))
                    waiting.remove(entry)
    return sorted(found)


def feedback_rows(frame):
    return sorted((r["session"], r["ts"], r["query_id"], r["hint"], r["cluster_rank"], tuple(r["node_ids"])) for r in frame.collect())


def split_activity(spark, rows):
    every = spark.createDataFrame(rows, implicit.ACTIVITY)
    return every.where("kind = 'query'"), every.where("kind = 'expand'")


@pytest.mark.parametrize(("seed", "n"), [(1, 250), (2, 900)])
def test_implicit_feedback_against_plain_steps(spark, seed, n):
    rows = random_activity(seed, n=n)
    want = plain_feedback(rows)
    assert len(want) > 20 and feedback_rows(B.implicit_feedback(*split_activity(spark, rows))) == want


def test_a_session_waits_for_its_last_queries_only(spark):
    asked = [("s", "query", DAY + dt.timedelta(seconds=i), i, f"h{i}", None, [(1, [f"name{i:02}"], [f"id{i}"])]) for i in range(25)]
    opened = [("s", "expand", DAY + dt.timedelta(seconds=30 + i), 100 + i, None, f"name{i:02}", None) for i in (0, 4, 5, 24)]
    found = feedback_rows(B.implicit_feedback(*split_activity(spark, asked + opened)))
    assert [r[2] for r in found] == [5, 24] and found == plain_feedback(asked + opened)


def test_ratings_against_plain_search(spark):
    rng, rows = random.Random(5), random_activity(6, n=400)
    rated = [(i, f"s{rng.randrange(3)}", DAY + dt.timedelta(seconds=rng.randrange(16_000)), f"h{rng.choice('abcdefgh') * 2}", rng.choice([1, 2, 3])) for i in range(300)]
    out = B.rating_nodes(spark.createDataFrame(rated, "rating_id bigint, session string, ts timestamp, hint string, cluster_rank int"), split_activity(spark, rows)[0])
    for r in out.collect():
        met = [q for q in rows if q[1] == "query" and (q[0], q[4]) == (r["session"], r["hint"]) and dt.timedelta(0) <= r["ts"] - q[2] <= dt.timedelta(seconds=600)]
        ids = [(q[2], q[3], c[2]) for q in met for c in q[6] if c[0] == r["cluster_rank"]]
        assert r["node_ids"] == (max(ids)[2] if ids else [])


def streamed(spark, tmp_path, batches, late_s=0):
    """What the stream gives where each batch of rows is a micro-batch of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, implicit.ACTIVITY).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
        os.utime(f"{tmp_path}/in/{i:03}", (i, i))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, implicit.STATE_STORE)
    try:
        source = spark.readStream.schema(implicit.ACTIVITY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = implicit.implicit_feedback_stream(source, late_s)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set(key, before)


def test_stream_equals_the_batch_whatever_the_micro_batches(spark, tmp_path):
    rows = sorted(random_activity(3, n=200), key=lambda r: r[2])
    end = [("", "expand", rows[-1][2] + dt.timedelta(days=1), None, None, "-", None)]
    cuts = [rows[i : i + 50] for i in range(0, 200, 50)]
    cuts = [list(reversed(c)) for c in cuts] + [end]
    want = plain_feedback(rows)
    assert len(want) > 10 and feedback_rows(streamed(spark, tmp_path, cuts)) == want


def test_late_rows_of_the_stream(spark, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    shown = [(1, ["name"], ["id"])]
    batches = [
        [("s", "query", at(0), 1, "h", None, shown), ("t", "query", at(0), 2, "h", None, shown)],
        [("s", "expand", at(100), None, None, "name", None)],
        # Late, but within the allowance; then beyond it.
        [("t", "expand", at(60), None, None, "name", None)],
        [("u", "query", at(2000), 3, "h", None, shown)],
        [("u", "expand", at(900), None, None, "name", None), ("u", "expand", at(2001), None, None, "name", None)],
        [("", "expand", at(9000), None, None, "-", None)],
    ]
    assert [r[:3] for r in feedback_rows(streamed(spark, tmp_path, batches, 60))] == [("s", at(100), 1), ("t", at(60), 2), ("u", at(2001), 3)]


def test_expiring_join(spark, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(500)), ("t", 3, at(0))], "session string, query_id bigint, asked timestamp").write.parquet(f"{tmp_path}/q")
    spark.createDataFrame([("s", "n", at(590)), ("s", "m", at(1101)), ("t", "n", at(601))], "session string, name string, opened timestamp").write.parquet(f"{tmp_path}/e")
    q, e = (spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}") for x in "qe")
    implicit.expiring_join(q, e).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["query_id"], r["name"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "n"), (2, "n")]


def test_changed_tables_make_a_new_graph(spark, tmp_path):
    part = spark.createDataFrame([(1, "red bolt", "Brand#1", "SMALL")], "p_partkey bigint, p_name string, p_brand string, p_type string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    one = registry.inputs(spark, str(tmp_path))
    assert one.nodes.count() == 1 and registry.inputs(spark, str(tmp_path)) is one
    part.union(spark.createDataFrame([(2, "old gear", "Brand#1", "SMALL")], part.schema)).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert registry.inputs(spark, str(tmp_path)).nodes.count() == 2


def test_intermediates_are_shared_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            applicationId, master = "a", "local-cluster[3,2,1024]"

    with pytest.raises(ValueError):
        shared_folder(Session(), "x")


def test_a_common_field_makes_no_candidates(spark):
    """Nodes of unlike names that share one field among others of their own: their number, not that of their pairs, is what the join takes."""
    nodes = graph(spark, *[node(f"n{i:03}", "graphql_type", f"only{chr(97 + i // 26)}{chr(97 + i % 26)}", "x", [f"f{i}a", f"f{i}b", f"f{i}c", f"g{i % 2}"]) for i in range(300)])
    idf = token_idf(nodes)
    assert similarity.met(similarity._weighted(nodes, idf), similarity.bounds(0.12)).isEmpty()
    assert similarity.field_pairs(nodes, idf).count() == 2 * (150 * 149 // 2) and similarity.name_pairs(nodes, idf).isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_lose_no_edge_of_uneven_nodes(spark, seed):
    rng = random.Random(seed)
    word = lambda: "w" + "abcdefghijklmnopqrstuvwxyz"[min(25, int(rng.expovariate(0.15)))]
    kinds = ["graphql_mutation", "http_endpoint", "kafka_topic", "frontend_mutation"]
    nodes = graph(spark, *[node(f"n{i:03}", rng.choice(kinds), "-".join(word() for _ in range(rng.randrange(1, 9))), f"s{i % 3}", [word() for _ in range(rng.randrange(12))], method=rng.choice(["POST", None])) for i in range(120)])
    idf = token_idf(nodes)
    every = score_pairs(nodes, idf, min_score=0.0)
    for least in (0.12, 0.4):
        want = sorted(every.where(f"total_score >= {least}").collect())
        assert want and sorted(score_pairs(nodes, idf, min_score=least).collect()) == want


def test_pairs_are_not_moved(spark):
    nodes = graph(spark, *SMALL)
    plan = score_pairs(nodes, token_idf(nodes))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]


def all_matches(rows, ttl=600):
    """Each query's first match among all expands, whatever waits beside it."""
    found = []
    opened = sorted((r for r in rows if r[1] == "expand"), key=lambda r: (r[2], r[3], r[5]))
    for s, _, ts, query_id, hint, _, clusters in (r for r in rows if r[1] == "query"):
        for e in (e for e in opened if e[0] == s and ts <= e[2] <= ts + dt.timedelta(seconds=ttl)):
            hit = next((c for c in clusters if any(e[5].lower() in n or n in e[5].lower() for n in c[1])), None)
            if hit:
                found.append((s, e[2], query_id, hint, hit[0], tuple(hit[2])))
                break
    return sorted(found)


def crowded_activity(seed, n=400):
    """More than 20 queries wait at once, and several rows share a moment."""
    return [(r[0], r[1], DAY + dt.timedelta(seconds=(r[2] - DAY).total_seconds() // 400 * 20), *r[3:]) for r in random_activity(seed, n=n) if r[1] == "query" or r[3] % 5 == 0]


def test_feedback_of_a_busy_session_loses_no_query(spark):
    rows = crowded_activity(4)
    want = all_matches(rows)
    assert len(want) > len(plain_feedback(rows)) and feedback_rows(B.implicit_feedback(*split_activity(spark, rows), most=None)) == want


def test_stream_of_a_busy_session_loses_no_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(implicit, "implicit_feedback_stream", implicit.unlimited_feedback_stream)
    rows = sorted(crowded_activity(5, n=200), key=lambda r: r[2])
    end = [("", "expand", rows[-1][2] + dt.timedelta(days=1), None, None, "-", None)]
    batches = [list(reversed(rows[i : i + 50])) for i in range(0, len(rows), 50)]
    assert feedback_rows(streamed(spark, tmp_path, [*batches, end])) == all_matches(rows)


def test_pairs_within_are_each_once(spark):
    from loomgraph.operators.clusters import pairs_within

    row = spark.createDataFrame([(["d", "a", "c", "b"], ["c", "a"])], "members array<string>, first array<string>")
    found = [tuple(p) for p in row.select(pairs_within("members", "first")).first()[0]]
    assert sorted(found) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("c", "d")]


def test_edges_of_nodes_keep_their_rows(spark):
    from loomgraph.plans.query import edges_of

    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.1), ("b", "c", 0.9), ("c", "d", 0.5)], "source_id string, target_id string, total_score double")
    found = edges_of(edges, spark.createDataFrame([("a",), ("b",), ("b",)], "id string"), 0.25)
    assert sorted(r[:2] for r in found.collect()) == [("a", "b"), ("b", "c")]
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert not joined.startswith("Aggregate")


def test_both_sides_of_a_key_are_one_shuffle(spark):
    """Pairs of names take ids and names alone, and nodes are dealt once for both sides."""
    nodes = graph(spark, *SMALL)
    idf, before = token_idf(nodes), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = similarity.met(similarity._weighted(nodes, idf, fields=False), {similarity.NAMES: 0.0}, similarity.OF_NAMES)
        assert pairs.schema["a"].dataType.names == [*similarity.OF_NAMES, "keys"]
        assert pairs.collect() and "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_degrees_store_no_edges(spark):
    registry.forget()
    found = registry.QUERIES["adjacency_degree"](spark, DATA).collect()
    graphs = registry.inputs(spark, DATA)
    assert "edges" not in graphs.stored
    assert sorted(found) == sorted(similarity.adjacency(graphs.edges).groupBy("id").count().collect())
    assert sorted(found) == sorted(registry.QUERIES["adjacency_degree"](spark, DATA).collect())


def test_the_weight_shared_is_made_once(spark):
    """Not for the union and the filter again; and it is that of the sets, empty and unlike ones too."""
    nodes = graph(spark, *SMALL)
    rows = similarity._weighted(nodes, token_idf(nodes))
    pairs = rows.select(F.struct("*").alias("a")).crossJoin(rows.select(F.struct("*").alias("b"))).select("a", "b", similarity.name_score().alias("s"))
    assert pairs._jdf.queryExecution().analyzed().toString().count("array_intersect(") == 1
    for r in pairs.collect():
        a, b, w = r["a"], r["b"], r["a"]["w"] | r["b"]["w"]
        union = sum(w[t] for t in {*a["n"], *b["n"]})
        assert r["s"] == pytest.approx(sum(w[t] for t in {*a["n"]} & {*b["n"]}) / union if union > 1e-12 else 0.0)


@pytest.fixture
def many(spark, monkeypatch):
    """A stored graph whose tables all count as large; Spark would send any of them, by the size of their files, to all executors."""
    monkeypatch.setattr(scratch, "FEW", 0)
    return registry.inputs(spark, DATA)


def sent(rows):
    """Joins that send a table through the driver, before anything is run."""
    return rows._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_clusters_deal_what_grows(many):
    from loomgraph.operators import anchors, clusters

    assert sent(similarity._weighted(many.nodes, None)) <= 1  # where ranges of numbers start, a row a range
    assert not sent(similarity.field_pairs(many.nodes, many.idf))
    found = anchors.hint_scores(many.nodes, many.asked)
    assert sent(found) <= 1 and found.count()  # tokens of hints may be sent to those of nodes
    groups = scratch.cut(clusters.drop_repeats(clusters.merge_hoods(many.hoods)), "groups")
    made = clusters.score_clusters(groups, many.nodes, many.edges, many.anchors, many.asked)
    assert not sent(clusters.neighborhoods(many.anchors, many.edges)) and not sent(made)
    assert made.count() == groups.count() > 0


def test_strong_nodes_deal_what_grows(many):
    from loomgraph.plans.query import strong_nodes

    found = strong_nodes(many.clusters, many.nodes, many.asked)
    assert not sent(found) and found.count() == many.clusters.count() > 0


def test_trimmed_nodes_deal_what_grows(many):
    from loomgraph.plans.query import distinct_sets, trim

    assert not sent(trim(distinct_sets(many.strong), many.nodes))


def test_directed_summary_deals_what_grows(many):
    from loomgraph.plans.query import directed_summary

    found = directed_summary(many.shown, many.edges, many.nodes)
    assert not sent(found) and found.count() > 0


def test_answers_deal_what_grows(many):
    found = query(many.nodes, many.edges, many.hints)
    assert not sent(found) and found.count() > 0


def test_rerank_deals_what_grows(many):
    found = B.rerank(many.clusters, many.hints, scratch.cut(B.feedback_counts(many.feedback), "counts"))
    assert not sent(found) and found.count() == many.clusters.count() > 0
