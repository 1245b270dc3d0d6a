"""Scores of pairs, hints and clusters, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of node types that complement each other.
COMPLEMENTARY = [
    ("graphql_mutation", "http_endpoint"),
    ("graphql_mutation", "kafka_topic"),
    ("graphql_query", "http_endpoint"),
    ("frontend_mutation", "graphql_mutation"),
    ("frontend_query", "graphql_query"),
    ("frontend_mutation", "http_endpoint"),
    ("http_endpoint", "kafka_topic"),
    ("frontend_query", "http_endpoint"),
    ("frontend_mutation", "kafka_topic"),
    ("graphql_query", "cube_query"),
    ("cube_query", "http_endpoint"),
]
# What a method adds beside a node type.
METHOD_BONUS = {
    ("POST", "graphql_mutation"): 0.15,
    ("POST", "frontend_mutation"): 0.15,
    ("GET", "graphql_query"): 0.15,
    ("GET", "frontend_query"): 0.15,
    ("DELETE", "graphql_mutation"): 0.10,
    ("PUT", "graphql_mutation"): 0.10,
    ("PATCH", "graphql_mutation"): 0.10,
}
# Weights of names and fields, of a name beside fields, of roles and services.
NAME_WEIGHT, FIELD_WEIGHT, CROSS_WEIGHT = 0.55, 0.45, 0.7
ROLE, ACROSS, WITHIN = 1.30, 1.25, 0.80
#: No pair's roles and services multiply its base by more.
MOST_FACTOR = (ROLE + 2 * max(METHOD_BONUS.values())) * ACROSS
# Display names of node types.
LABELS = {
    "graphql_query": "GraphQL Query",
    "graphql_mutation": "GraphQL Mutation",
    "graphql_subscription": "GraphQL Subscription",
    "graphql_type": "GraphQL Type",
    "kafka_topic": "Kafka Topic",
    "frontend_query": "Frontend Query",
    "frontend_mutation": "Frontend Mutation",
    "frontend_subscription": "Frontend Subscription",
    "cube_query": "Cube Query",
    "backend_client_call": "Backend Client Call",
}


def base_score(name: Column, field: Column) -> Column:
    return name * NAME_WEIGHT + field * FIELD_WEIGHT


def role_factor(type_a: Column, method_a: Column, type_b: Column, method_b: Column) -> Column:
    """1.3 for complementary types, else 1, and the bonuses of either method beside the other type."""
    pair = F.concat_ws("|", F.least(type_a, type_b), F.greatest(type_a, type_b))
    known = ["|".join(sorted(p)) for p in COMPLEMENTARY]
    bonus = F.create_map(*[F.lit(x) for (m, t), v in METHOD_BONUS.items() for x in (f"{m}|{t}", v)])
    # concat is null where there is no method, and so is the lookup
    extra = [F.coalesce(F.element_at(bonus, F.concat(m, F.lit("|"), t)), F.lit(0.0)) for m, t in ((method_a, type_b), (method_b, type_a))]
    return F.when(pair.isin(known), ROLE).otherwise(1.0) + extra[0] + extra[1]


def service_factor(service_a: Column, service_b: Column) -> Column:
    return F.when(service_a.eqNullSafe(service_b), WITHIN).otherwise(ACROSS)


def total_score(base: Column, role: Column, service: Column) -> Column:
    return F.round(F.least(base * role * service, F.lit(1.0)), 4)


def hint_score(hint: Column, tokens: Column, field_tokens: Column) -> Column:
    """Relevance of a node to hint tokens: plain Jaccard of names and fields."""

    def part(t: Column) -> Column:
        return F.size(F.array_intersect(hint, t)) / F.greatest(F.size(F.array_union(hint, t)), F.lit(1))

    return F.when(F.size(hint) > 0, part(tokens) * 0.75 + part(field_tokens) * 0.25).otherwise(0.0)


def hint_matches(hint: Column, tokens: Column, field_tokens: Column) -> Column:
    return F.size(F.array_intersect(hint, F.array_union(tokens, field_tokens)))


def cluster_confidence(mean_edge: Column, n_types: Column, n_services: Column) -> Column:
    spread = F.least(n_types / 4, F.lit(1.0)) * 0.2 + F.least((n_services - 1) / 2, F.lit(1.0)) * 0.2
    return F.least(F.round(mean_edge * 0.6 + spread, 3), F.lit(1.0))


def hint_confidence(confidence: Column, coverage: Column, relevance: Column, direct: Column) -> Column:
    """A cluster's confidence for a hint; ``direct`` is the share of its nodes that the hint names."""
    lifted = confidence * (0.65 + 0.35 * coverage) + F.least(relevance * 0.25, F.lit(0.25)) + F.least(direct * 0.1, F.lit(0.1))
    return F.least(F.round(lifted, 3), F.lit(1.0))


def node_label(kind: Column, method: Column, path: Column) -> Column:
    """HTTP endpoints show method and path; types without a display name show themselves."""
    http = F.concat(F.lit("HTTP "), F.coalesce(method, F.lit("?")), F.lit(" "), F.coalesce(path, F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.when(kind == "http_endpoint", http).otherwise(F.coalesce(F.element_at(names, kind), kind))


def shown_score(total: Column) -> Column:
    """A total with three places, rounded from its binary value."""
    return F.floor(total * 1000 + 0.5) / 1000


def direction_label(from_service: Column, to_service: Column, service: Column) -> Column:
    """An edge's direction as seen from a service; null where it has none."""
    known = from_service.isNotNull() & to_service.isNotNull() & (from_service != "") & (to_service != "")
    return F.when(known, F.when(from_service == service, "outbound").when(to_service == service, "inbound").otherwise("related"))
