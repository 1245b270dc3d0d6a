"""The engine as one object: scan, query, expand, rate, evaluate and count over a stored graph."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.tokens import normalize
from loomgraph.operators import feedback as B
from loomgraph.operators import stats as C
from loomgraph.operators.dedup import last_wins
from loomgraph.operators.scratch import cut
from loomgraph.operators.similarity import score_pairs, token_idf
from loomgraph.operators.store import GraphStore, changed_services
from loomgraph.plans import evaluate as E
from loomgraph.plans import query as Q
from loomgraph.sources.config import ConfigError, bff_services, fill_scanners, resolve_scanner
from loomgraph.sources.files import existing, fingerprints, source_files

#: Queries that a later expand or rating may refer to, and for how long.
MOST_PENDING, PENDING_S = 20, 600


def scan_sources(files: DataFrame, scanners: Iterable[str | Mapping[str, Any]], warnings: list[str] | None = None) -> DataFrame:
    """Scanned nodes of all scanners over the same files, in their order; with ``warnings`` one that can't be made is told there and passed over."""
    out = files.sparkSession.createDataFrame([], schema.SCANNED).withColumn("seq", F.lit(0))
    for i, s in enumerate(scanners):
        try:
            scan = resolve_scanner(s)
        except ConfigError as e:
            if warnings is None:
                raise
            warnings.append(str(e))
            continue
        out = out.unionByName(scan(files).withColumn("seq", F.lit(i)), allowMissingColumns=True)
    return out


def scan_services(files: DataFrame, scanners: Mapping[str, list], warnings: list[str] | None = None) -> DataFrame:
    """Scanned nodes of all services, each by its own scanners; services with like scanners are scanned together."""
    alike: dict[str, tuple[list, list[str]]] = {}
    for name, some in scanners.items():
        alike.setdefault(repr(some), (some, []))[1].append(name)
    out = scan_sources(files, [])
    for some, names in alike.values():
        out = out.unionByName(scan_sources(files.where(F.col("service").isin(names)), some, warnings), allowMissingColumns=True)
    return out


@dataclass
class ScanReport:
    """What a scan did: services read anew, left as they were, dropped, and not found; and what should be looked at."""

    read: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    scanners: dict[str, list] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, GraphStore(spark, root)
        self.report = ScanReport()
        self.config: Mapping[str, Any] | None = None
        #: (hint, time, [(rank, names, ids)]) of the last queries asked one by one.
        self.pending: deque[tuple[str, dt.datetime, list]] = deque(maxlen=MOST_PENDING)

    def scan(self, config: Mapping[str, Any], as_of, force: bool = False) -> list[str]:
        """Brings the graph up to a configuration with absolute paths; returns the services read anew, and keeps a report.

        Repos without scanners get those that suit their files.  Services that are no longer configured go; those whose files haven't
        changed stay as they are; those whose folder isn't there are passed over, or dropped with ``force``; a scanner that can't be made is
        a warning.  All services are read in one plan and replaced at once; if nothing changed, weights and edges stay too.
        """
        report = self.report = ScanReport()
        self.config = config
        repos = {r["name"]: r for r in config["repos"]}
        report.dropped = self.store.prune(self.spark.createDataFrame([(n,) for n in repos], "service string"))
        report.missing = [n for n, r in repos.items() if not existing(self.spark, r["path"])]
        report.warnings += [f"{n}: no folder at {repos[n]['path']}" for n in report.missing]
        if force and report.missing:
            report.dropped += self.store.prune(self.spark.createDataFrame([(n,) for n in repos if n not in report.missing], "service string"))
        there = {n: r for n, r in repos.items() if n not in report.missing}
        files = source_files(self.spark, {n: r["path"] for n, r in there.items()}).persist()
        try:
            filled = fill_scanners(config | {"repos": list(there.values())}, files)
            report.scanners = {r["name"]: r["scanners"] for r in filled["repos"]}
            state = changed_services(fingerprints(files), self.store.read("repo_state"), self.store.read("nodes")).collect()
            todo = [r for r in state if force or r["rescan"]]
            report.read = [r["name"] for r in todo]
            report.reused = [r["name"] for r in state if r["name"] not in report.read]
            if todo:
                self._read(files, report)
                rows = self.spark.createDataFrame([(r["name"], r["git_hash"]) for r in todo], "name string, git_hash string")
                self.store.upsert_state(rows.withColumn("scanned_at", F.lit(as_of)))
        finally:
            files.unpersist()
        if todo or report.dropped:
            self.rebuild(bff_services(filled))
        return report.read

    def _read(self, files: DataFrame, report: ScanReport) -> None:
        """Scans the services of the report and replaces their nodes."""
        scanners = {n: report.scanners[n] for n in report.read}
        report.warnings += [f"{n}: no scanner suits its files; name some in the configuration" for n, s in scanners.items() if not s]
        found = scan_services(files, scanners, report.warnings)
        nodes = cut(normalize(last_wins(found, ["id"], "seq")), "scanned")
        self.store.replace_services(nodes, report.read)
        full = {r["service"] for r in nodes.select("service").distinct().collect()}
        report.warnings += [f"{n}: no nodes" for n in report.read if n not in full and report.scanners[n]]

    def rescan(self, as_of, config: Mapping[str, Any] | None = None, force: bool = False) -> list[str]:
        """The last configuration, or the one given, scanned again."""
        if config is None and self.config is None:
            raise ConfigError("nothing was scanned yet: give a configuration")
        return self.scan(config or self.config, as_of, force)

    def rebuild(self, bff: Collection[str] | None = None) -> None:
        """Token weights and edges anew from the stored nodes."""
        nodes = self.store.read("nodes")
        self.store.overwrite("token_idf", token_idf(nodes))
        self.store.overwrite("edges", score_pairs(nodes, self.store.read("token_idf"), bff))

    def query(self, hints: DataFrame, top_n: int = 5, as_of=None, feedback: bool = True) -> DataFrame:
        """Answers to (hint_id, hint), reranked by recent feedback unless that is off; ``as_of`` stands for the clock, now by default."""
        rows = B.recent(self.store.read("feedback"), as_of or dt.datetime.now(dt.UTC)) if feedback else None
        return Q.query(self.store.read("nodes"), self.store.read("edges"), hints, top_n, rows)

    def expand(self, names: DataFrame) -> DataFrame:
        return Q.expand(self.store.read("nodes"), self.store.read("edges"), names)

    def rate(self, rows: DataFrame) -> None:
        """Logs feedback (ts, hint, cluster_rank, node_ids, accepted, source)."""
        self.store.append_feedback(rows)

    # One question at a time, as tools ask

    def stale_warning(self, as_of: dt.datetime) -> str | None:
        return self.stale(as_of).first()["warning"]

    def ask(self, hint: str, as_of: dt.datetime, top_n: int = 3) -> dict[str, Any]:
        """{chains, stale_warning}; what is shown is kept for a while, so that a rating or an expand can refer to it."""
        hints = self.spark.createDataFrame([(0, hint)], "hint_id bigint, hint string")
        chains = [r.asDict(recursive=True) for r in self.query(hints, top_n, as_of).orderBy("rank").collect()]  # top_n rows
        for c in chains:
            del c["hint_id"]
        if chains:
            shown = [(c["rank"], [x.lower() for n in c["nodes"] for x in (n["name"], n["id"])], [n["id"] for n in c["nodes"]]) for c in chains]
            self.pending.append((hint, as_of, shown))
        return {"chains": chains, "stale_warning": self.stale_warning(as_of)}

    def open(self, name: str, as_of: dt.datetime) -> dict[str, Any]:
        """{neighbors, stale_warning, next_step}; a query that showed the node lately is taken to have been right, once."""
        found = self.expand(self.spark.createDataFrame([(name,)], "name string")).orderBy("source_id", "rank").collect()  # thirty rows at most
        warning = self.stale_warning(as_of)
        if not found:
            return {"neighbors": [], "stale_warning": warning, "next_step": "Nothing of that name. Ask with a broader term first."}
        low, rows = name.lower(), []
        for entry in list(self.pending):
            hint, asked, shown = entry
            hit = next((s for s in shown if any(low in n or n in low for n in s[1])), None)
            if hit and as_of - asked <= dt.timedelta(seconds=PENDING_S):
                rows.append((as_of, hint, hit[0], hit[2], True, "implicit_expand"))
                self.pending.remove(entry)
        if rows:
            self.rate(self.spark.createDataFrame(rows, schema.FEEDBACK))
        step = "Scan again, then ask again." if warning else "Read the neighbours' source files; rate the answer if it misled."
        return {"neighbors": [r.asDict(recursive=True) for r in found], "stale_warning": warning, "next_step": step}

    def judge(self, hint: str, accepted: bool, as_of: dt.datetime, cluster_rank: int = 1, node_ids: Collection[str] = ()) -> dict[str, Any]:
        """Logs a rating; without ids those of the hint's latest answer with such a rank are taken, if it was given lately."""
        ids = list(node_ids)
        if not ids and cluster_rank > 0:
            ids = self._shown(hint, cluster_rank, as_of)
        self.rate(self.spark.createDataFrame([(as_of, hint, cluster_rank, ids, accepted, "manual")], schema.FEEDBACK))
        return {"logged": True, "hint": hint, "accepted": accepted, "node_ids_count": len(ids), "total_feedback": self.store.read("feedback").count()}

    def _shown(self, hint: str, cluster_rank: int, as_of: dt.datetime) -> list[str]:
        for asked_hint, asked, shown in reversed(self.pending):
            if asked_hint == hint and as_of - asked <= dt.timedelta(seconds=PENDING_S):
                for rank, _, ids in shown:
                    if rank == cluster_rank:
                        return ids
        return []

    @staticmethod
    def help() -> dict[str, str]:
        return {
            "ask": "ranked chains of nodes for a hint in business terms",
            "open": "the neighbours of a node by its name, or part of it",
            "judge": "whether an answer was right; ranks later answers",
            "rescan": "reads changed repositories again",
            "stats": "nodes by type and service",
        }

    def evaluate(self, judgments: DataFrame, top_k: int = 5) -> DataFrame:
        return E.evaluate(self.store.read("nodes"), self.store.read("edges"), judgments, top_k)

    def stats(self) -> DataFrame:
        return C.stats(self.store.read("nodes"))

    def stale(self, as_of) -> DataFrame:
        return C.stale(self.store.read("repo_state"), as_of)


def rendered(answer: Mapping[str, Any]) -> str:
    """An answer of ``ask`` as text."""
    lines = [answer["stale_warning"]] if answer["stale_warning"] else []
    for c in answer["chains"]:
        lines.append(f"{c['rank']}. confidence {c['confidence']:.2f}: {', '.join(c['services'])}")
        lines += [f"   {n['label']}  {n['name']}  ({n['service']})" for n in c["nodes"]]
        lines += [f"   {e['from_service']} -> {e['to_service']}: {e['from_node']} -> {e['to_node']} ({e['score']})" for e in c["directed_edges"]]
    return "\n".join(lines) if lines else "nothing found"
