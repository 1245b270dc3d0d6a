"""Scanners on inline sources, detection, configurations, the store and the engine."""

import datetime as dt
import json

import pytest

from loomgraph import schema
from loomgraph.operators.store import GraphStore
from loomgraph.plans.cli import main
from loomgraph.plans.engine import Engine, rendered
from loomgraph.sources import config, declarative, detect, parsed
from loomgraph.sources.files import fingerprints, source_files


def files(spark, *rows):
    return spark.createDataFrame([("svc", p, t) for p, t in rows], schema.SOURCE_FILE)


def test_spring_resource(spark):
    text = '@RequestMapping("/owners")\nclass A {\n@PostMapping\n@ResponseStatus(HttpStatus.CREATED)\npublic Owner createOwner(X x) {}\n@GetMapping(value = "/{ownerId}")\npublic Optional<Owner> findOwner(int id) {}\n@GetMapping\npublic List<Owner> findAll() {}\n}'
    found = {r["raw_name"]: (r["method"], r["path"]) for r in parsed.scan_http(files(spark, ("a/OwnerResource.java", text), ("a/Owner.java", text))).collect()}
    assert found == {"createOwner": ("POST", "/owners"), "findOwner": ("GET", "/owners/{ownerId}"), "findAll": ("GET", "/owners")}


FASTAPI = """
import fastapi as fa
from fastapi import FastAPI, APIRouter as R
app = FastAPI()
r = R(prefix='/x')
@app.get('/items/{item_id:int}')
async def get_item(item_id): ...
@r.options(
    path='o')
def opt(): ...
@app.post(f'/x{1}')
def dynamic(): ...
@other.get('/no')
def no(): ...
"""


def test_fastapi(spark):
    found = parsed.scan_fastapi(files(spark, ("a/m.py", FASTAPI), ("venv/m.py", FASTAPI), ("a/bad.py", "def (")))
    assert sorted(r["id"] for r in found.collect()) == ["svc::http::GET::/items/{item_id:int}::get_item", "svc::http::OPTIONS::/o::opt"]
    assert found.where("raw_name = 'get_item'").first()["fields"] == ["item_id"]


def test_local_router_is_no_fastapi(spark):
    assert parsed.scan_fastapi(files(spark, ("m.py", "class APIRouter: ...\nr = APIRouter()\n@r.get('/x')\ndef f(): ..."))).isEmpty()


def test_frontend_rest_noise(spark):
    text = "class A { go() { this.axiosRequest.get('/foo') } }"
    found = parsed.scan_frontend_rest(files(spark, ("a.tsx", text), ("a.test.ts", text), ("a.d.ts", text), ("a.stories.tsx", text), ("dist/a.ts", text), ("c.ts", "x = { endpoint: '/plain' }")))
    assert [(r["path"], r["raw_name"], r["target_service"]) for r in found.collect()] == [("/foo", "go", "unknown")]


def test_graphql_comments_and_reach(spark):
    text = "# type No { a: B }\ntype Query {\n  orderStatus(id: ID): String\n  plain: Int\n  next(x: Int): Int\n}"
    found = {r["raw_name"]: r["fields"] for r in parsed.scan_graphql(files(spark, ("a.gql", text))).collect()}
    assert found == {"orderStatus": ["id"], "plain": ["x"], "next": ["x"]}


def test_ts_outbound(spark):
    text = "class AiDs extends Ds { x = 1; baseURL = settings.aiAdapter.host; async ask(q) { return this.streamPost('/ask', q) } }\nrouter.get('/in', handler)"
    found = {r["id"]: r["target_service"] for r in parsed.scan_ts_outbound(files(spark, ("s/a.ts", text)), {"aiAdapter": "ai-adapter"}).collect()}
    assert found == {"svc::ts_outbound::AiDs::ai-adapter": "ai-adapter", "svc::ts_outbound::AiDs.ask::ai-adapter": "ai-adapter", "svc::http::GET::/in::handler": None}


def test_null_and_empty_texts(spark):
    blank = files(spark, ("aController.java", None), ("b.py", None), ("c.gql", ""), ("d.ts", None), ("xClient.java", None), ("application.yaml", None), ("model/e.js", None))
    for scanner in config.SCANNERS.values():
        assert scanner(blank).isEmpty()


@pytest.mark.parametrize(
    ("listing", "scanners"),
    [
        ([("pyproject.toml", "fastapi"), ("pom.xml", "")], ["fastapi"]),
        ([("package.json", '{"dependencies": {"@cubejs-backend/x": "1"}}')], ["cube"]),
        ([("package.json", '{"dependencies": {"apollo-server-express": "1"}}')], ["graphql", "ts_http_outbound"]),
        ([("package.json", "{}"), ("src/schema/a.graphql", "")], ["graphql", "ts_http_outbound"]),
        ([("package.json", "not json")], ["frontend_graphql", "frontend_rest"]),
        ([("build.gradle", "")], ["http", "kafka", "backend_clients"]),
        ([("README.md", "")], []),
    ],
)
def test_detection(spark, listing, scanners):
    assert detect.detect_scanners(files(spark, *listing)).first()["scanners"] == scanners


class OwnScanner:
    def __init__(self, suffix):
        self.suffix = suffix

    def scan(self, service, path, text):
        if path.endswith(self.suffix):
            yield {"id": f"{service}::own", "type": "custom", "raw_name": "custom" + self.suffix, "service": service, "source_file": path, "fields": []}


@pytest.fixture
def repos(tmp_path):
    for name, path, text in (
        ("web", "src/a.ts", "class OrderApi extends Api { async createOrder() { return this.axiosRequest.post('/orders') } }"),
        ("orders", "x/OrderController.java", '@RequestMapping("/orders")\nclass A {\n@PostMapping\npublic void createOrder(X x) {}\n}'),
    ):
        at = tmp_path / name / path
        at.parent.mkdir(parents=True)
        at.write_text(text)
    raw = {"repos": [{"path": "web", "scanners": ["frontend_rest"]}, {"path": "orders", "scanners": ["http", {"type": "test_sources:OwnScanner", "suffix": ".java", "_why": "x"}]}]}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    return tmp_path


def test_engine(spark, repos, capsys):
    engine, now = Engine(spark, f"file://{repos}/graph"), dt.datetime(2024, 1, 1)
    assert engine.store.diagnose()
    cfg = config.load_config(str(repos / "c.json"))
    assert sorted(engine.scan(cfg, now)) == ["orders", "web"] and engine.scan(cfg, now) == []
    assert engine.store.diagnose() == [] and engine.store.read("edges").count() >= 1
    hints = spark.createDataFrame([(1, "createOrder")], "hint_id bigint, hint string")
    assert engine.query(hints).first()["services"] == ["orders", "web"]
    (repos / "orders/x/OrderController.java").write_text("class A {}")
    assert engine.scan(cfg, now) == ["orders"]
    assert engine.scan(cfg | {"repos": cfg["repos"][:1]}, now) == []
    assert {r["value"] for r in engine.stats().where("kind = 'service'").collect()} == {"web"}
    engine.rate(spark.createDataFrame([(now, "h", 1, ["a"], True, None)], schema.FEEDBACK))
    engine.rate(spark.createDataFrame([(now, "h", 1, ["a"], False, "x")], schema.FEEDBACK))
    assert sorted(r["source"] for r in engine.store.read("feedback").collect()) == ["manual", "x"]
    engine.store.write_manifest("c.json")
    assert main(["validate", str(repos / "c.json")]) == 0


def test_upsert_keeps_the_last(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    rows = [("a", "t", "one", "s", 1), ("a", "t", "two", "s", 2)]
    store.upsert_nodes(spark.createDataFrame(rows, "id string, type string, raw_name string, service string, seq bigint"))
    assert [r["raw_name"] for r in store.read("nodes").collect()] == ["two"]


def test_config_errors(tmp_path):
    errors, warnings = config.validate_config({"repos": [{"path": "no", "scanners": ["nope", {"x": 1}, 3]}, {"path": "."}, {"path": ".", "scanners": []}, 4]}, str(tmp_path))
    assert len(errors) == 6 and len(warnings) == 1
    assert config.validate_config({})[0]


def test_judgments(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('# note\n\n{"hint": " a ", "expected_node_ids": "x", "k": 2}\n')
    assert config.load_judgments(spark, str(path)).first()[1:] == ("a", ["x"], "any", 2)
    for bad in ("", "{", '{"hint": ""}', '{"hint": "a", "expected_node_ids": ["x"], "match": "some"}', '{"hint": "a", "expected_node_ids": ["x"], "k": 0}'):
        path.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load_judgments(spark, str(path))


def test_source_files(spark, repos):
    found = source_files(spark, {"web": str(repos / "web")}).collect()
    assert [r["service"] for r in found] == ["web"] and found[0]["path"].endswith("src/a.ts")
    orders = source_files(spark, {"orders": str(repos / "orders")}).collect()
    assert len(orders) == 1 and orders[0]["text"].count("\n") == 4


def web_and_bff(tmp_path):
    for path, text in (
        ("web/package.json", "{}"),
        ("web/src/a.ts", "class OrderApi extends Api { async createOrder() { return this.axiosRequest.post('/orders') } }"),
        ("bff/package.json", '{"dependencies": {"apollo-server": "3"}}'),
        ("bff/schema/a.graphql", "type Mutation {\n  createOrder(id: ID): String\n}"),
        ("jvm/pom.xml", "<project/>"),
        ("jvm/graphql/a.graphql", "type Query {\n  order(id: ID): String\n}"),
        ("loose/lib/OrderController.java", '@RequestMapping("/orders")\nclass A {\n@PostMapping\npublic void createOrder(X x) {}\n}'),
    ):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_scan_without_scanner_lists(spark, tmp_path):
    web_and_bff(tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"repos": [{"path": n} for n in ("web", "bff", "jvm")] + [{"path": "loose", "scanners": []}, {"path": "gone"}]}))
    engine, now = Engine(spark, f"file://{tmp_path}/graph"), dt.datetime(2024, 1, 1)
    assert sorted(engine.scan(config.load_config(str(tmp_path / "c.json")), now)) == ["bff", "jvm", "loose", "web"]
    assert engine.report.scanners["web"] == ["frontend_graphql", "frontend_rest"] and engine.report.scanners["bff"] == ["graphql", "ts_http_outbound"]
    assert engine.report.scanners["jvm"][0] == "graphql" and engine.report.scanners["loose"] == ["http"]
    assert engine.report.missing == ["gone"] and any("gone" in w for w in engine.report.warnings)
    assert {r["service"] for r in engine.store.read("nodes").collect()} == {"web", "bff", "jvm", "loose"}
    assert engine.rescan(now) == [] and sorted(engine.report.reused) == ["bff", "jvm", "loose", "web"]
    # A folder that has gone is passed over, and dropped on demand.
    (tmp_path / "web").rename(tmp_path / "elsewhere")
    assert engine.rescan(now) == [] and engine.stats().where("value = 'web'").count() == 1
    assert "web" not in engine.rescan(now, force=True) and "web" in engine.report.dropped
    assert engine.stats().where("value = 'web'").isEmpty()


def test_unknown_scanner_is_a_warning(spark, repos):
    cfg = config.load_config(str(repos / "c.json"))
    cfg["repos"][0]["scanners"] = ["nope", "frontend_rest"]
    engine = Engine(spark, f"file://{repos}/graph2")
    engine.scan(cfg, dt.datetime(2024, 1, 1))
    assert any("nope" in w for w in engine.report.warnings) and engine.stats().where("value = 'web'").count() == 1


def test_frontends_go_to_every_graphql_service():
    repos_ = [{"name": "jvm", "scanners": ["graphql", "http"]}, {"name": "node", "scanners": [{"type": "graphql"}]}, {"name": "web", "scanners": ["frontend_rest"]}]
    assert config.bff_services({"repos": repos_}) == config.bff_services({"repos": repos_, "bff_services": []}) == {"jvm", "node"}
    assert config.bff_services({"repos": repos_, "bff_services": ["x"]}) == {"x"} and config.bff_services({"repos": repos_[2:]}) is None


def test_answers_ratings_and_expands(spark, repos):
    engine, now = Engine(spark, f"file://{repos}/graph3"), dt.datetime(2024, 1, 1)
    with pytest.raises(config.ConfigError):
        engine.rescan(now)
    engine.scan(config.load_config(str(repos / "c.json")), now)
    answer = engine.ask("createOrder", now)
    assert answer["stale_warning"] is None and answer["chains"][0]["rank"] == 1 and "createOrder" in rendered(answer)
    assert engine.ask("nothing alike", now)["chains"] == [] and rendered(engine.ask("nothing alike", now)) == "nothing found"
    assert engine.judge("createOrder", True, now)["node_ids_count"] == len(answer["chains"][0]["nodes"])
    assert engine.judge("createOrder", True, now + dt.timedelta(seconds=601))["node_ids_count"] == 0
    assert engine.judge("createOrder", False, now, 9)["total_feedback"] == 3
    assert engine.open("absent", now)["neighbors"] == []
    assert engine.open("createorder", now)["neighbors"] and engine.open("createorder", now)["neighbors"]
    logged = [r["source"] for r in engine.store.read("feedback").collect()]
    assert logged.count("implicit_expand") == 1 and logged.count("manual") == 3
    late = engine.ask("createOrder", now + dt.timedelta(days=8))
    assert "8 days" in late["stale_warning"] and "8 days" in rendered(late) and engine.store.diagnose(now + dt.timedelta(days=8)) == [late["stale_warning"]]
    assert set(engine.help()) == {"ask", "open", "judge", "rescan", "stats"}
    # Feedback counts whether or not a time is given.
    hints = spark.createDataFrame([(1, "createOrder")], "hint_id bigint, hint string")
    plain = engine.query(hints, feedback=False).first()["confidence"]
    assert engine.query(hints, as_of=now).first()["confidence"] > plain and engine.query(hints).first()["confidence"] == plain


def test_command_line(spark, repos, capsys):
    store = f"file://{repos}/graph4"
    (repos / "j.jsonl").write_text('{"hint": "createOrder", "expected_node_ids": ["web::rest::POST::/orders::createOrder"]}\n')
    assert main(["--store", store, "scan", str(repos / "c.json")]) == 0
    assert "read: web" in capsys.readouterr().out
    assert main(["--store", store, "query", "createOrder"]) == 0 and "confidence" in capsys.readouterr().out
    assert main(["--store", store, "query", "createOrder", "--json"]) == 0 and json.loads(capsys.readouterr().out)["chains"]
    assert main(["--store", store, "expand", "createOrder"]) == 0 and "neighbor_id" in capsys.readouterr().out
    assert main(["--store", store, "stats"]) == 0 and '"kind":"service"' in capsys.readouterr().out
    assert main(["--store", store, "eval", str(repos / "j.jsonl"), "--min-mrr", "0.1"]) == 0
    assert main(["--store", store, "eval", str(repos / "none.jsonl")]) == 2


def test_store_keeps_nodes_without_a_service(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    store.overwrite("nodes", spark.createDataFrame([("a", "t", "n", None), ("b", "t", "n", "s"), ("c", "t", "n", "u")], "id string, type string, raw_name string, service string"))
    store.replace_services(spark.createDataFrame([], schema.NODE), ["s"])
    assert sorted(r["id"] for r in store.read("nodes").collect()) == ["a", "c"]
    store.insert_clusters(spark.createDataFrame([("h", 0.5, ["a"])], schema.CLUSTER))
    store.insert_clusters(spark.createDataFrame([("h", 0.4, ["c"])], schema.CLUSTER))
    assert store.read("clusters").count() == 2
    store.clear_clusters()
    store.clear_edges()
    assert store.read("clusters").isEmpty() and store.read("edges").isEmpty()


def test_files_below_two_roots(spark, tmp_path):
    for path in ("a/x.txt", "a/in ner/y+z.txt", "b/z.txt"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(path)
    found = source_files(spark, {"all": str(tmp_path / "a"), "inner": str(tmp_path / "a/in ner"), "b": f"file://{tmp_path}/b"})
    assert sorted((r["service"], r["relative"]) for r in found.collect()) == [("all", "in ner/y+z.txt"), ("all", "x.txt"), ("b", "z.txt"), ("inner", "y+z.txt")]
    tokens = {r["name"]: r["git_hash"] for r in fingerprints(found).collect()}
    assert tokens == {r["name"]: r["git_hash"] for r in fingerprints(found.repartition(3)).collect()}
    (tmp_path / "b/z.txt").write_text("other")
    again = {r["name"]: r["git_hash"] for r in fingerprints(source_files(spark, {"all": str(tmp_path / "a"), "b": str(tmp_path / "b")})).collect()}
    assert again["all"] == tokens["all"] and again["b"] != tokens["b"] and source_files(spark, {}).isEmpty()


LISTENERS = """
@KafkaListener(groupId = "g1", topics = {"${kafka.topic.orderCreated}", "plain-topic"})
void a() {}
@KafkaListener(topics = "${app.unknown}") void b() {}
void c() { kafkaProducer.send(kafkaTopicProperties.getStockMoved(), x); kafkaTemplate.send("direct", y); other.send("no"); }
"""


def test_kafka_uses(spark):
    yaml = "kafka:\n  topic:\n    orderCreated: orders-v1 # note\n"
    found = declarative.scan_kafka(files(spark, ("src/main/A.java", LISTENERS), ("application.yaml", yaml), ("src/test/B.java", LISTENERS)))
    roles = {(r["raw_name"], r["method"]) for r in found.collect()}
    assert roles == {("orders-v1", "config"), ("g1", "consume"), ("plain-topic", "consume"), ("unknown", "consume"), ("stock-moved", "produce"), ("direct", "produce")}


def test_frontend_operations(spark):
    blocks = ["query GetOrders($id: ID) {\n    orders(id: $id) {\n      id\n    }\n}", "mutation ($x: X) {\n    saveOrder(x: $x) { id }\n}", "{ me { id } }", "subscription (\n) { }", ""]
    text = "".join(f"const q{i} = gql`{b}`;\n" for i, b in enumerate(blocks))
    found = [(r["type"], r["raw_name"], r["fields"]) for r in parsed.scan_frontend_graphql(files(spark, ("a.tsx", text), ("node_modules/a.ts", text))).collect()]
    assert found == [
        ("frontend_query", "GetOrders", ["orders", "id"]), ("frontend_mutation", "saveOrder", ["saveOrder"]), ("frontend_query", "me", []),
        ("frontend_subscription", "anonymous", []), ("frontend_query", "unknown", []),
    ]


def test_cubes_by_brackets(spark):
    text = 'cube(`Orders`, {\n  sql: `select {x}`,\n  measures: {\n    count: {\n      type: `count`\n    },\n    total: { sql: `a`, filters: [{ sql: `b` }] }\n  },\n  dimensions: { id: { type: `number` } }\n});\ncube("Bad", x)'
    found = parsed.scan_cubes(files(spark, ("model/a.js", text), ("other/a.js", text))).collect()
    assert [(r["raw_name"], r["fields"]) for r in found] == [("Orders", ["count", "total", "id"])]


def test_backend_clients(spark):
    text = """class OrderClient {
  public Order getOrder(String id) { return restClient.get().uri(b -> b.pathSegment("orders", id, "it's").build()).retrieve(); }
  public void put(Order o) { restClient.put().uri("/orders/{id}", 1); }
  public Map<String, X> spaced(String id) { return restClient.get().uri("/no"); }
  public String toString() { restClient.get(); }
}"""
    found = {r["raw_name"]: (r["method"], r["path"], r["target_service"]) for r in parsed.scan_backend_clients(files(spark, ("src/main/order/OrderClient.java", text))).collect()}
    assert found == {"getOrder": ("GET", "/orders/{id}/it's", "order"), "put": ("PUT", "/orders/{id}", "order")}


def test_outbound_calls(spark):
    text = """const load = async (x: X) => { await fetch('/api/eu/x'); axios.get(url); axios({ url }); myAxios.post<T>('/no'); };
class A extends B {
  setUp() { this.setBaseURL(settings.orders.host); }
  async send(x): Promise<void> { this.get<T>('/a/${x}'); this.other('/no'); return new OrderClient(); }
}
"""
    found = parsed.scan_ts_outbound(files(spark, ("s/a.ts", text), ("s/a.test.ts", text)), {"orders": "orders-svc"}, {"/api/eu": "eu"}, {"order": "orders-svc"})
    assert {(r["raw_name"], r["target_service"], r["method"], r["path"]) for r in found.collect()} == {
        ("A", "orders-svc", None, None), ("A.get", None, "GET", None), ("A.axios", None, None, None), ("A.fetch", "eu", "GET", "/api/eu/x"),
        ("A.send", "orders-svc", "GET", "/a/${x}"), ("A.OrderClient", "orders-svc", None, None),
    }


@pytest.mark.parametrize(
    ("url", "shown", "fields"),
    [
        ("/a/${x.y}/b/:id?q=${z}", "/a/{param}/b/{param}", ["x.y", "id", "z", "a", "b"]),
        ("/v1/{id}/{k:int}", "/v1/{id}/{k{param}}", ["id", "k:int", "v1"]),
        ("/plain", "/plain", ["plain"]),
        ("/odd/{/${", "/odd/{/${", ["odd", "${"]),
    ],
)
def test_rest_paths(url, shown, fields):
    node = parsed._rest_node("s", "t", "p", "GET", url, "n")
    assert (node["path"], node["fields"]) == (shown, fields)


def test_topic_lines(spark):
    yaml = "kafka:\n  topic:\n    a: one\n    b:\n    c-d: no\n    e:none\nother:\n    f: no\n"
    assert [(r["key"], r["topic"]) for r in declarative.topic_lines(files(spark, ("application.yaml", yaml))).collect()] == [("a", "one")]
