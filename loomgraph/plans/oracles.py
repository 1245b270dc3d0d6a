"""The registered queries in DuckDB SQL, written from the tables without the operators' shortcuts."""

from __future__ import annotations

from loomgraph.functions import scores as S
from loomgraph.sources.catalog import BFF_SERVICES, KINDS, PARTS_A_GROUP, TYPES, VERBS


def toks(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_transform(list_filter(regexp_split_to_array(regexp_replace({spaced}, '[-_./]', ' ', 'g'), '\\s+'), lambda t: len(t) > 1), lambda t: lower(t))"


def uniq(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def join(x: str) -> str:
    return f"array_to_string({x}, ',')"


def has(kind: str) -> str:
    return f"type IN ({kind})"


_CALLS = "'http_endpoint', 'frontend_rest', 'backend_client_call'"
PARTS = f"""
pt AS (SELECT p_brand, p_type, s AS p_group, split_part(p_name, ' ', 1) || s || ' ' || split_part(p_name, ' ', 2) || s AS p_name, lower(p_type) || s AS p_kind
  FROM (SELECT *, translate((p_partkey // {PARTS_A_GROUP})::varchar, '0123456789', 'abcdefghij') AS s FROM part))"""
NODES = f"""{PARTS},
p0 AS (SELECT p_name, p_type, p_kind, min(p_brand) AS brand, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, list_position({KINDS}, p_type) AS t FROM pt GROUP BY 1, 2, 3),
p1 AS (SELECT *, {TYPES}[(ascii(w1) + 2 * ascii(w2) + 3 * t) % {len(TYPES)} + 1] AS type, 'svc-' || (ascii(w2) + t) % 5 AS service FROM p0),
p2 AS (SELECT *, CASE WHEN type IN ({_CALLS}) THEN {VERBS}[(len(p_name) + t) % 5 + 1] WHEN type = 'kafka_topic' THEN CASE WHEN t % 2 = 0 THEN 'produce' ELSE 'consume' END END AS method,
  CASE WHEN type IN ({_CALLS}) THEN '/' || p_kind || '/{{' || w2 || 'Id}}' END AS path,
  CASE WHEN type = 'backend_client_call' THEN 'svc-' || ascii(w1) % 5 END AS target_service, w1 || {cap("w2")} || {cap("p_kind")} AS raw_name FROM p1),
p3 AS (SELECT *, service || '::' || type || '::' || coalesce(method, '-') || '::' || raw_name AS id, [w2 || 'Id', p_kind || 'Code', brand] AS fields FROM p2),
nodes AS (SELECT id, type, raw_name, service, method, path, target_service, {uniq(toks("raw_name"))} AS tokens,
  {uniq(f"flatten(list_transform(list_concat(fields, list_filter([path, target_service], lambda x: x IS NOT NULL)), lambda f: {toks('f')}))")} AS field_tokens FROM p3)"""
IDF = """
idf AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM nodes) / count(*)::double) AS idf
  FROM (SELECT id, unnest(list_distinct(list_concat(tokens, field_tokens))) AS token FROM nodes) GROUP BY 1)"""


def mass(x: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda t: w[t])), 0)"


def wj(a: str, b: str) -> str:
    union = mass(f"list_distinct(list_concat({a}, {b}))")
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 AND {union} > 1e-12 THEN {mass(f'list_intersect({a}, {b})')} / {union} ELSE 0 END"


_KNOWN = ", ".join(f"'{'|'.join(sorted(p))}'" for p in S.COMPLEMENTARY)
_BONUS = " ".join(f"WHEN '{m}|{t}' THEN {v}" for (m, t), v in S.METHOD_BONUS.items())
_FE, _BFF = "'frontend_query', 'frontend_mutation', 'frontend_subscription'", "'graphql_query', 'graphql_mutation', 'graphql_subscription', 'graphql_type'"
_SERVERS = ", ".join(f"'{s}'" for s in BFF_SERVICES)


def way(name: str, pick: str) -> str:
    """One end of the direction CASE."""
    a, b = ("x", "y") if pick == "from" else ("y", "x")
    x_calls = "xtype = 'backend_client_call' AND xtarget IS NOT NULL AND xtarget <> xservice"
    y_calls = "ytype = 'backend_client_call' AND ytarget IS NOT NULL AND ytarget <> yservice"
    kafka = "xtype = 'kafka_topic' AND ytype = 'kafka_topic'"
    return f"""CASE WHEN {x_calls} THEN {'xservice' if pick == 'from' else 'xtarget'} WHEN {y_calls} THEN {'yservice' if pick == 'from' else 'ytarget'}
  WHEN {kafka} AND xmethod = 'produce' AND ymethod IN ('consume', 'config') THEN {a}service WHEN {kafka} AND ymethod = 'produce' AND xmethod IN ('consume', 'config') THEN {b}service
  WHEN xtype IN ({_FE}) AND ytype IN ({_BFF}) AND yservice IN ({_SERVERS}) THEN {a}service WHEN ytype IN ({_FE}) AND xtype IN ({_BFF}) AND xservice IN ({_SERVERS}) THEN {b}service END AS {name}"""


PAIRS = f"""
wm AS (SELECT map_from_entries(list((token, idf))) AS w FROM idf),
q0 AS (SELECT a.id AS a, b.id AS b, a.type AS xtype, b.type AS ytype, a.service AS xservice, b.service AS yservice, a.method AS xmethod, b.method AS ymethod,
  a.target_service AS xtarget, b.target_service AS ytarget, a.tokens AS ta, b.tokens AS tb, a.field_tokens AS fa, b.field_tokens AS fb, w
  FROM nodes a JOIN nodes b ON a.id < b.id, wm WHERE list_has_any(list_concat(a.tokens, a.field_tokens), list_concat(b.tokens, b.field_tokens))),
q1 AS (SELECT *, {wj("ta", "tb")} AS name, greatest({wj("fa", "fb")}, {S.CROSS_WEIGHT} * ({wj("ta", "fb")}), {S.CROSS_WEIGHT} * ({wj("tb", "fa")})) AS field,
  CASE WHEN least(xtype, ytype) || '|' || greatest(xtype, ytype) IN ({_KNOWN}) THEN {S.ROLE} ELSE 1.0 END
    + coalesce(CASE xmethod || '|' || ytype {_BONUS} END, 0) + coalesce(CASE ymethod || '|' || xtype {_BONUS} END, 0) AS role,
  CASE WHEN xservice = yservice THEN {S.WITHIN} ELSE {S.ACROSS} END AS svc FROM q0),
q2 AS (SELECT *, round(least((name::double * {S.NAME_WEIGHT} + field::double * {S.FIELD_WEIGHT}) * role::double * svc::double, 1.0), 4) AS total FROM q1)"""
EDGES = f"""
edges AS MATERIALIZED (SELECT a AS source_id, b AS target_id, total AS total_score, round(name::double, 4) AS name_score, round(field::double, 4) AS field_score,
  round(role::double - 1, 4) AS role_score, svc::double AS service_score, {way("from_service", "from")}, {way("to_service", "to")} FROM q2 WHERE total >= 0.12)"""
ADJ = """
adj AS (SELECT source_id AS id, target_id AS other, total_score AS s FROM edges UNION ALL SELECT target_id, source_id, total_score FROM edges)"""
GRAPH = f"{NODES}, {IDF}, {PAIRS}, {EDGES}, {ADJ}"
HINTS = f"""
h0 AS (SELECT p_name AS hint FROM pt UNION SELECT split_part(p_name, ' ', 1) FROM pt UNION SELECT 'svc ' || min(split_part(p_name, ' ', 2)) FROM pt),
hints0 AS (SELECT row_number() OVER (ORDER BY hint) AS hint_id, hint FROM h0)"""
FAINT = """
h0 AS (SELECT DISTINCT p_name || ' alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu' AS hint FROM pt),
hints0 AS (SELECT row_number() OVER (ORDER BY hint) AS hint_id, hint FROM h0)"""
EFFECTIVE = f"""
st AS (SELECT list(DISTINCT t) AS st FROM (SELECT unnest({toks("service")}) AS t FROM nodes)),
h1 AS (SELECT hint_id, hint, list_sort(list_distinct({toks("hint")})) AS every, st FROM hints0, st),
h2 AS (SELECT *, list_filter(every, lambda t: NOT list_contains(st, t)) AS business FROM h1),
hints AS (SELECT hint_id, hint, CASE WHEN len(business) > 0 THEN business ELSE every END AS ht FROM h2)"""


def relevance(h: str, t: str, f: str) -> str:
    def part(x: str) -> str:
        return f"len(list_intersect({h}, {x})) / greatest(len(list_distinct(list_concat({h}, {x}))), 1)::double"

    return f"CASE WHEN len({h}) > 0 THEN {part(t)} * 0.75 + {part(f)} * 0.25 ELSE 0 END"


SCORES = f"""
hs AS (SELECT hint_id, id, {relevance("ht", "tokens", "field_tokens")} AS score, len(list_intersect(ht, list_distinct(list_concat(tokens, field_tokens)))) AS matches, len(ht) AS n_hint
  FROM hints, nodes WHERE len(tokens) > 0 AND list_has_any(ht, list_concat(tokens, field_tokens)))"""
ANCHORS = """
an0 AS (SELECT *, max(CASE WHEN n_hint > 1 AND matches >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY hint_id) AS strong FROM hs),
an1 AS (SELECT *, max(score) OVER (PARTITION BY hint_id) >= 0.15 AS good FROM an0 WHERE strong = 0 OR matches >= 2),
an2 AS (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, id) AS rank FROM an1 WHERE score > 0),
anchors AS MATERIALIZED (SELECT hint_id, id, score, rank FROM an2 WHERE CASE WHEN good THEN score >= 0.15 AND rank <= 30 ELSE rank <= 10 END)"""
NO_HINT = """
dg AS (SELECT n.id, count(other) AS d FROM nodes n LEFT JOIN adj ON adj.id = n.id GROUP BY 1),
anchors AS MATERIALIZED (SELECT 0 AS hint_id, id, NULL::double AS score, row_number() OVER (ORDER BY d DESC, id) AS rank FROM dg ORDER BY d DESC, id LIMIT 20)"""
HOODS = """
nb AS (SELECT a.hint_id, a.id, other, row_number() OVER (PARTITION BY a.hint_id, a.id ORDER BY s DESC, other) AS n FROM anchors a JOIN adj ON adj.id = a.id WHERE s >= 0.25),
hoods AS MATERIALIZED (SELECT a.hint_id, a.rank, a.id, list_sort(list_distinct(list_append(coalesce(list(other) FILTER (other IS NOT NULL), []), a.id))) AS hood
  FROM anchors a LEFT JOIN (SELECT * FROM nb WHERE n <= 11) x ON x.hint_id = a.hint_id AND x.id = a.id GROUP BY 1, 2, 3)"""


def share(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)::double"


MERGED = f"""
mp AS (SELECT b.hint_id, b.rank, coalesce(list(x.rank) FILTER (x.rank IS NOT NULL AND {share("x.hood", "b.hood")} >= 0.25), []) AS il
  FROM hoods b LEFT JOIN hoods x ON x.hint_id = b.hint_id AND x.rank < b.rank GROUP BY 1, 2),
mr AS (SELECT hint_id, rank, [rank] AS seeds, rank AS seed FROM mp WHERE rank = 1
  UNION ALL SELECT hint_id, rank, CASE WHEN m IS NULL THEN list_append(seeds, rank) ELSE seeds END, coalesce(m, rank)
  FROM (SELECT p.hint_id, p.rank, r.seeds, list_min(list_filter(p.il, lambda i: list_contains(r.seeds, i))) AS m FROM mr r JOIN mp p ON p.hint_id = r.hint_id AND p.rank = r.rank + 1)),
groups AS MATERIALIZED (SELECT hint_id, seed, list_sort(list(DISTINCT x)) AS members FROM (SELECT mr.hint_id, seed, unnest(hood) AS x FROM mr JOIN hoods USING (hint_id, rank)) GROUP BY 1, 2)"""
KEPT = f"""
gn AS (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY seed) AS g FROM groups),
gp AS (SELECT b.hint_id, b.g, coalesce(list(x.g) FILTER (x.g IS NOT NULL AND {share("x.members", "b.members")} >= 0.7), []) AS dup
  FROM gn b LEFT JOIN gn x ON x.hint_id = b.hint_id AND x.g < b.g GROUP BY 1, 2),
gr AS (SELECT hint_id, g, [g] AS kept FROM gp WHERE g = 1
  UNION ALL SELECT p.hint_id, p.g, CASE WHEN list_has_any(p.dup, r.kept) THEN r.kept ELSE list_append(r.kept, p.g) END FROM gr r JOIN gp p ON p.hint_id = r.hint_id AND p.g = r.g + 1),
kept AS MATERIALIZED (SELECT gn.hint_id, gn.seed, gn.members FROM gn JOIN gr USING (hint_id, g) WHERE list_contains(gr.kept, gn.g) AND len(gn.members) >= 2)"""


def scored(hinted: bool) -> str:
    extra = f", list_distinct(flatten(list(list_concat(tokens, field_tokens)))) AS ct, max({relevance('ht', 'tokens', 'field_tokens')}) AS rel, count(*) FILTER (list_has_any(ht, tokens)) AS direct, any_value(ht) AS ht"
    lift = """least(round(c * (0.65 + 0.35 * (len(list_intersect(ht, ct)) / greatest(len(ht), 1)::double)) + least(rel * 0.25, 0.25) + least(direct / n::double * 0.1, 0.1), 3), 1.0)"""
    return f"""
mb AS (SELECT hint_id, seed, unnest(members) AS id FROM kept),
te AS (SELECT DISTINCT hint_id, source_id, target_id, total_score FROM edges JOIN anchors ON id IN (source_id, target_id) WHERE total_score >= 0.25),
me AS (SELECT x.hint_id, x.seed, avg(total_score) AS mean FROM te JOIN mb x ON x.hint_id = te.hint_id AND x.id = source_id JOIN mb y ON y.hint_id = te.hint_id AND y.seed = x.seed AND y.id = target_id GROUP BY 1, 2),
kn AS (SELECT mb.hint_id, mb.seed, count(DISTINCT type) AS nt, count(DISTINCT service) AS ns, count(*) AS n, list(mb.id ORDER BY coalesce(rank, 1073741824), mb.id) AS node_ids{extra if hinted else ""}
  FROM mb JOIN nodes ON nodes.id = mb.id LEFT JOIN anchors ON anchors.hint_id = mb.hint_id AND anchors.id = mb.id {"JOIN hints ON hints.hint_id = mb.hint_id" if hinted else ""} GROUP BY 1, 2),
cf AS (SELECT kn.*, least(round(coalesce(mean, 0) * 0.6 + (least(nt / 4::double, 1.0) * 0.2 + least((ns - 1) / 2::double, 1.0) * 0.2), 3), 1.0) AS c FROM kn LEFT JOIN me USING (hint_id, seed)),
cl AS (SELECT hint_id, node_ids, {lift if hinted else "c"} AS confidence FROM cf),
cr AS (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY confidence DESC, node_ids) AS rank FROM cl),
clusters AS MATERIALIZED (SELECT * FROM cr WHERE rank <= 5)"""


FULL = f"{GRAPH}, {HINTS}, {EFFECTIVE}, {SCORES}, {ANCHORS}, {HOODS}, {MERGED}, {KEPT}, {scored(True)}"
STRONG = """
sx AS (SELECT hint_id, rank, confidence, pos, id FROM (SELECT hint_id, rank, confidence, unnest(node_ids) AS id, unnest(range(len(node_ids))) AS pos FROM clusters)),
sy AS (SELECT sx.*, len(ht) > 1 AND len(list_intersect(ht, list_concat(tokens, field_tokens))) >= 2 AS strong FROM sx JOIN nodes USING (id) JOIN hints USING (hint_id)),
sz AS (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY hint_id, rank) AS n FROM sy),
strong AS MATERIALIZED (SELECT hint_id, rank, confidence, list(id ORDER BY pos) AS node_ids FROM sz WHERE strong OR n < 2 GROUP BY 1, 2, 3)"""
DISTINCT = """
ds AS (SELECT *, row_number() OVER (PARTITION BY hint_id, list_sort(node_ids) ORDER BY rank) AS k FROM strong),
sets AS MATERIALIZED (SELECT * FROM ds WHERE k = 1)"""
_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LABELS.items())
LABEL = f"CASE WHEN type = 'http_endpoint' THEN 'HTTP ' || coalesce(method, '?') || ' ' || coalesce(path, '') ELSE coalesce(CASE type {_LABEL} END, type) END"
SHOWN = f"""
t0 AS (SELECT hint_id, rank, confidence, unnest(node_ids) AS id, unnest(range(len(node_ids))) AS place FROM sets),
t1 AS (SELECT t0.*, type, service, raw_name, {LABEL} AS label, row_number() OVER (PARTITION BY hint_id, rank, service, type ORDER BY place) AS b FROM t0 JOIN nodes USING (id)),
t2 AS (SELECT *, row_number() OVER (PARTITION BY hint_id, rank ORDER BY place) AS pos FROM t1 WHERE b <= 2),
shown AS MATERIALIZED (SELECT * FROM t2 WHERE pos <= 12)"""
SUMMARY = """
d0 AS (SELECT x.hint_id, x.rank, from_service, to_service, source_id, target_id, total_score, round(total_score, 3) AS score FROM edges
  JOIN shown x ON x.id = source_id JOIN shown y ON y.id = target_id AND y.hint_id = x.hint_id AND y.rank = x.rank WHERE from_service IS NOT NULL AND to_service IS NOT NULL),
d1 AS (SELECT *, row_number() OVER (PARTITION BY hint_id, rank, from_service, to_service ORDER BY score DESC, total_score DESC, source_id, target_id) AS k FROM d0),
summary AS (SELECT d1.hint_id, d1.rank, from_service, to_service, a.raw_name AS from_node, b.raw_name AS to_node, score FROM d1 JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE k = 1)"""
ANSWER = f"{FULL}, {STRONG}, {DISTINCT}, {SHOWN}, {SUMMARY}"
EVENTS = f"""
sz0 AS (SELECT (SELECT count(*) FROM nodes) AS size, (SELECT count(*) FROM hints0) AS asked),
ids AS (SELECT row_number() OVER (ORDER BY id) - 1 AS n, id, raw_name FROM nodes),
fb AS (SELECT ts, hint, [x.id, y.id] AS node_ids, event_type <> 'error' AS accepted FROM events, sz0 JOIN hints0 ON hint_id = event_id % asked + 1
  JOIN ids x ON x.n = user_id % size JOIN ids y ON y.n = (user_id * 7 + event_id) % size WHERE event_type <> 'view')"""
RECENT = "fr AS (SELECT * FROM fb WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY)"
COUNTS = """
fc AS (SELECT hint, node_id, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM (SELECT hint, accepted, unnest(node_ids) AS node_id FROM fr) GROUP BY 1, 2)"""
ACTIVITY = """
ids AS (SELECT row_number() OVER (ORDER BY id) - 1 AS n, id, raw_name FROM nodes),
hr AS (SELECT *, floor(epoch(ts) / 3600)::bigint * 7 AS h, (SELECT count(*) FROM nodes) AS size FROM events),
ac AS (SELECT (user_id % 4)::varchar AS session, event_id AS query_id, ts, event_type, x.raw_name AS name1, x.id AS id1, y.raw_name AS name2, y.id AS id2
  FROM hr JOIN ids x ON x.n = h % size JOIN ids y ON y.n = (h + user_id % 3 + 1) % size)"""


def _opens(i: int) -> str:
    both = " OR ".join(f"contains(lower(q.{c}{i}), lower(e.name2)) OR contains(lower(e.name2), lower(q.{c}{i}))" for c in ("name", "id"))
    return f"({both})"


IMPLICIT = f"""
im AS (SELECT q.session, q.query_id, q.name1 AS hint, e.ts, CASE WHEN {_opens(1)} THEN 1 ELSE 2 END AS hit, CASE WHEN {_opens(1)} THEN q.id1 ELSE q.id2 END AS node,
  row_number() OVER (PARTITION BY q.session, q.query_id ORDER BY e.ts, e.query_id, e.name2) AS k
  FROM ac q JOIN ac e ON e.session = q.session AND q.event_type = 'view' AND e.event_type = 'click' AND e.ts >= q.ts AND e.ts <= q.ts + INTERVAL 600 SECOND WHERE {_opens(1)} OR {_opens(2)})"""
