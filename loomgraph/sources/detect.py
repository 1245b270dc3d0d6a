"""Which scanners suit a service, from the listing of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.files import file_name, has_part

# Where schemas, manifests and build files stand.
_SCHEMA_FOLDERS = ["", "src", "src/schema", "schema", "graphql", "src/graphql"]
_PYTHON_MANIFESTS = ["pyproject.toml", "requirements.txt", "requirements.in", "setup.cfg", "setup.py"]
_BUILDS = ["pom.xml", "build.gradle", "build.gradle.kts"]
_NOISE = ["/node_modules/", "/dist/", "/build/", "/coverage/", "/__tests__/", "/.next/"]


def _names(*scanners: str) -> Column:
    return F.array(*map(F.lit, scanners)) if scanners else F.array().cast("array<string>")


def _dependencies(text: Column) -> Column:
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    maps = [F.from_json(F.get_json_object(text, f"$.{k}"), "map<string,string>") for k in kinds]
    return F.concat(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps])


def detect_scanners(files: DataFrame) -> DataFrame:
    """(service, scanners): FastAPI, cube, GraphQL server, frontend or JVM, in this order; none where nothing speaks for any.

    Paths are relative to the service's root here; only files at or near it count.
    """
    path = F.col("path")
    deps = F.when(path == "package.json", _dependencies(F.col("text")))
    apollo = F.exists(deps, lambda d: (d == "apollo-server") | d.startswith("apollo-server-") | (d == "@apollo/server"))
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    flags = {
        "fastapi": path.isin(_PYTHON_MANIFESTS) & F.col("text").rlike(r"(?i)\bfastapi\b"),
        "package": path == "package.json",
        "cube": F.exists(deps, lambda d: d.startswith("@cubejs-backend")),
        "apollo": apollo,
        "sdl": folder.isin(_SCHEMA_FOLDERS) & path.rlike(r"\.(graphql|gql)$"),
        "jvm": path.isin(_BUILDS),
    }
    seen = files.groupBy("service").agg(*[F.bool_or(F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()])
    chosen = (
        F.when(F.col("fastapi"), _names("fastapi"))
        .when(F.col("package") & F.col("cube"), _names("cube"))
        .when(F.col("package") & (F.col("apollo") | F.col("sdl")), _names("graphql", "ts_http_outbound"))
        .when(F.col("package"), _names("frontend_graphql", "frontend_rest"))
        .when(F.col("jvm") & F.col("sdl"), _names("graphql", "http", "kafka", "backend_clients"))
        .when(F.col("jvm"), _names("http", "kafka", "backend_clients"))
        .otherwise(_names())
    )
    return seen.select("service", chosen.alias("scanners"))


# Fixed values: (scanner, name pattern, what the text must hold) by which files speak for a scanner.
_PROBES = [
    ("graphql", r"\.(graphql|gql)$", None),
    ("http", r"Controller.*\.(java|kt)$|Router.*\.kt$", None),
    ("kafka", r"\.(java|kt|yml|yaml|properties)$", ["KafkaListener", "KafkaTemplate", "kafka."]),
    ("backend_clients", r"\.(java|kt)$", ["RestClient", "RestTemplate", "WebClient"]),
    ("frontend_graphql", r"\.tsx?$", ["gql`", "graphql`"]),
    ("frontend_rest", r"\.tsx?$", ["axiosRequest.", "fetch(", "endpoint:", "endpoint ="]),
    ("ts_http_outbound", r"\.ts$", ["settings.", "router.get(", "router.post(", "streamPost(", "this.post("]),
    ("cube", r"\.(js|ts)$", ["cube(`", "cube('", 'cube("']),
]


def infer_scanners(files: DataFrame) -> DataFrame:
    """(service, scanners) by what the files of a service hold, for configurations that name none."""
    real = files.where(~has_part(F.concat(F.lit("/"), F.col("path")), _NOISE))
    flags = []
    for name, pattern, needles in _PROBES:
        fits = file_name(F.col("path")).rlike(pattern)
        if needles:
            fits = fits & has_part(F.coalesce("text", F.lit("")), needles)
        flags.append(F.bool_or(fits).alias(name))
    jvm = F.bool_or(file_name(F.col("path")).rlike(r"\.(java|kt)$")).alias("__jvm")
    seen = real.groupBy("service").agg(*flags, jvm)
    needs_jvm = ("http", "kafka", "backend_clients")
    named = [F.when(F.col(n) & (F.col("__jvm") if n in needs_jvm else F.lit(True)), n) for n, _, _ in _PROBES]
    return seen.select("service", F.array_compact(F.array(*named)).alias("scanners"))
