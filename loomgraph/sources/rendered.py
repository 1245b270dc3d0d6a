"""Source files rendered from regions, nations and brands: known input for the scanners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(template: str, **values: Column) -> Column:
    """A template with <name> places."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


def files(rows: DataFrame, service: str, path: str, text: str, **values: Column) -> DataFrame:
    return rows.select(fill(service, **values).alias("service"), fill(path, **values).alias("path"), fill(text, **values).alias("text"))


def brand_files(part: DataFrame) -> DataFrame:
    """A Spring controller per brand with a handler per part type."""
    kinds = part.select("p_brand", "p_type").distinct()
    handler = fill('    @GetMapping("/<k>/{id}")\n    @ResponseStatus(HttpStatus.OK)\n    public String get<C>(@PathVariable String id) {\n    }\n', k=F.lower("p_type"), C=F.initcap("p_type"))
    body = kinds.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(handler)), "\n").alias("body"))
    b = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    text = '@RestController\n@RequestMapping("/<b>")\npublic class Brand {\n<body>\n    @PostMapping\n    public void add(String x) {\n    }\n}\n'
    return files(body, "svc-<b>", "src/main/java/<b>Controller.java", text, b=b, body=F.col("body"))


def _nation() -> dict[str, Column]:
    name = F.lower(F.replace("n_name", F.lit("_"), F.lit("")))
    return {"n": name, "N": F.initcap(name)}


def _region() -> dict[str, Column]:
    name = F.lower(F.replace("r_name", F.lit(" "), F.lit("")))
    return {"r": name, "R": F.initcap(name)}


def schema_files(nation: DataFrame) -> DataFrame:
    text = (
        "# <n>\ntype Query {\n  get<N>(id: ID!, page: Int): <N>\n}\nextend type Mutation {\n  update<N>(input: <N>Input): <N>\n}\n"
        "type <N> implements Node {\n  key: ID\n  name: String\n}\n"
    )
    return files(nation, "gateway", "schema/<n>.graphql", text, **_nation())


def route_files(nation: DataFrame) -> DataFrame:
    text = (
        "from fastapi import APIRouter as R\nimport fastapi\nrouter = R()\napp: fastapi.FastAPI = fastapi.FastAPI()\nPATH = '/x'\n\n"
        "@router.get('<n>/{item_id}')\nasync def read_<n>(item_id): ...\n\n@app.post(path='/<n>')\ndef add_<n>(): ...\n\n@router.get(PATH)\ndef dynamic(): ...\n"
    )
    return files(nation, "api", "app/<n>.py", text, **_nation())


def operation_files(nation: DataFrame) -> DataFrame:
    text = (
        "const A = gql`\n  query Get<N>($id: ID!) {\n    <n>(id: $id) {\n      key\n    }\n  }\n`;\nconst B = gql`mutation ($x: X) { save<N>(x: $x) { id } }`;\n"
        "const C = gql`{ list<N> { id } }`;\n"
    )
    return files(nation, "web", "src/<n>.tsx", text, **_nation())


def kafka_files(region: DataFrame) -> DataFrame:
    yaml = "server:\n  port: 80\nkafka:\n  topic:\n    orderCreated: <r>-orders\n    refund: '<r>-refunds'\n  group: g\nother: x\n"
    code = (
        'class L {\n  @KafkaListener(topics = "${kafka.topic.orderCreated}")\n  void a() {}\n  @KafkaListener(groupId = "g-<r>", topics = {"<r>-plain"})\n  void b() {}\n'
        '  void c() { kafkaProducer.send(kafkaTopicProperties.getRefund(), x); kafkaProducer.send(kafkaTopicProperties.getStockMoved(), x); kafkaTemplate.send("<r>-direct", x); }\n}\n'
    )
    both = files(region, "<r>", "src/main/resources/application-dev.yaml", yaml, **_region())
    return both.unionByName(files(region, "<r>", "src/main/java/L.java", code, **_region())).unionByName(files(region, "<r>", "src/test/java/T.java", code, **_region()))


def rest_files(region: DataFrame) -> DataFrame:
    text = (
        "export class <R>Api extends BaseApi {\n  async load<R>(id: string): Promise<X> {\n    return this.axiosRequest.get<T>(`/<r>/${id}/items?x=1`);\n  }\n"
        "  async send<R>() {\n    await fetch('https://h.example/v1/<r>');\n    return handleDefaultSSEFetch({ endpoint: '/v2/<r>/stream' });\n  }\n}\n"
    )
    both = files(region, "web", "src/<r>.ts", text, **_region())
    return both.unionByName(files(region, "web", "src/<r>.test.ts", text, **_region())).unionByName(files(region, "web", "dist/<r>.ts", text, **_region()))


def client_files(region: DataFrame) -> DataFrame:
    text = (
        'public class <R>Client {\n  public Order get<R>(String orderId) {\n    return restClient.get().uri(u -> u.pathSegment("orders", orderId).build()).retrieve();\n  }\n'
        '  public void put<R>(X x) {\n    if (x != null) { restClient.put().uri("/<r>/save"); }\n  }\n  public String toString() { return restClient.get(); }\n}\n'
    )
    nested = files(region, "shop", "src/main/java/client/<r>/<R>Client.java", text, **_region())
    return nested.unionByName(files(region, "shop", "src/main/java/client/<R>Client.java", text, **_region()))


def outbound_files(region: DataFrame) -> DataFrame:
    text = (
        "export class <R>Source extends RestDs {\n  constructor() { this.baseURL = settings.<r>.host; }\n  async ask<R>(q) {\n    return this.streamPost('/ask/{id}', q);\n  }\n}\n"
        "export class Other extends Base {\n  run() { axios.get('/api/<r>/x'); fetch(url); axios({}); new <R>Client().go(); }\n}\nrouter.post('/in/<r>', handle<R>);\n"
    )
    return files(region, "bff", "src/<r>.ts", text, **_region())


def cube_files(region: DataFrame) -> DataFrame:
    text = (
        "cube(`<R>`, {\n  sql: `x`,\n  measures: {\n    count: {\n      type: `count`\n    },\n    total<R>: {\n      type: `sum`\n    }\n  },\n"
        "  dimensions: {\n    key: {\n      type: `number`\n    }\n  }\n});\n"
    )
    return files(region, "cubes", "model/<r>.js", text, **_region())


def repo_files(region: DataFrame) -> DataFrame:
    """One repository per region, each of another kind."""
    kinds = [
        ("package.json", '{"dependencies": {"@cubejs-backend/server": "1"}}'),
        ("package.json", '{"devDependencies": {"@apollo/server": "4"}}'),
        ("package.json", '{"dependencies": {"react": "18"}}'),
        ("pom.xml", "<project/>"),
        ("requirements.txt", "FastAPI==0.1"),
    ]
    out = None
    for k, (path, text) in enumerate(kinds):
        part = files(region.where(F.col("r_regionkey") == k), "<r>", path, text.replace("<project/>", "(project)"), **_region())
        out = part if out is None else out.unionByName(part)
    extra = files(region.where(F.col("r_regionkey") == 3), "<r>", "src/schema/a.graphql", "type Query { a: String }", **_region())
    readme = files(region, "<r>", "README.md", "<R>", **_region())
    return out.unionByName(extra).unionByName(readme)
