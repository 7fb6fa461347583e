"""Provenance: manifests from JSON, AI keywords and source types, signature states, manipulation severity, chains, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source types that stand for AI, patterns that name AI products, severities of actions, words of signature states.
AI_SOURCES = ["trainedalgorithmicmedia", "algorithmicmedia", "compositesynthetic", "digitalcreation"]
AI_WORDS = [
    r"gemini", r"midjourney", r"dall[-\s]?e?", r"stable[\s-]?diffusion", r"openai", r"adobe[\s-]?firefly", r"flux", r"ideogram", r"leonardo", r"kling", r"runway", r"pika", r"sora", r"recraft", r"jimeng", r"imagen",
    r"partylamb",
]
SEVERITY = {"c2pa.edited": 1, "c2pa.opened": 0, "c2pa.cropped": 1, "c2pa.resized": 0, "c2pa.filtered": 1, "c2pa.colorgraded": 0, "c2pa.retouched": 2, "c2pa.composited": 2, "c2pa.adjusted": 1, "c2pa.created": 0}
BAD_STATES = [("invalid", ["invalid", "fail", "error"]), ("untrusted", ["untrusted", "unknown", "unverified"]), ("expired", ["expired"])]
ACTIONS = ["c2pa.actions", "c2pa.actions.v2"]
WORKS = ["stds.schema-org.CreativeWork", "c2pa.claim"]
#: Messages of readers that mean a file has no manifest.
ABSENT = ["not found", "no jumbf", "not supported", "notsupported"]
MANIFEST = (
    "active_manifest string, manifests map<string, struct<signature_info: struct<issuer: string, time: string, validation_status: string, certificates: array<string>>, "
    "assertions: array<struct<label: string, data: struct<generator: string, actions: array<struct<action: string, digitalSourceType: string, softwareAgent: string, description: string>>>>>>>"
)


def keyword_pattern(words: list[str] = AI_WORDS) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def mentions_ai(text: Column, words: list[str] = AI_WORDS) -> Column:
    return F.lower(text).rlike(keyword_pattern(words))


def absent(error: Column) -> Column:
    """A reader's error that stands for a file without a manifest: the tool abstains instead of failing."""
    return F.coalesce(F.lower(error).rlike("|".join(ABSENT)), F.lit(False))


def signature_state(status: Column, issuer: Column, chain: Column) -> Column:
    """The first that holds: what the status says, no issuer, an issuer without chain of certificates, valid."""
    s, state = F.lower(F.coalesce(status, F.lit(""))), F.when(issuer.isNull(), "unsigned").when(~chain & (issuer != ""), "valid_no_chain").otherwise("valid")
    for name, words in reversed(BAD_STATES):
        state = F.when(s.rlike("|".join(words)), name).otherwise(state)
    return state


def is_valid(state: Column) -> Column:
    return state.isin("valid", "valid_no_chain")


def severity(actions: Column) -> Column:
    """Sum over an array of action names; names in any case, unknown ones count nothing."""
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.aggregate(actions, F.lit(0), lambda s, a: s + F.coalesce(F.try_element_at(table, F.lower(a)), F.lit(0)))


def provenance_score(valid: Column, ai: Column, sev: Column) -> Column:
    """struct(real_prob, confidence)."""
    rules = [(valid & ai, 0.0, 0.95), (valid & (sev >= 3), 0.4, 0.7), (valid & (sev >= 1), 0.7, 0.8), (valid, 1.0, 0.95), (ai, 0.2, 0.6)]
    p, c = F.lit(0.5), F.lit(0.3)
    for when, a, b in reversed(rules):
        p, c = F.when(when, a).otherwise(p), F.when(when, b).otherwise(c)
    return F.struct(p.alias("real_prob"), c.alias("confidence"))


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _ai_tool(assertion: Column) -> Column:
    """The tool an assertion declares as AI, or null: a source type of the list settles it, else a keyword in agent and
    description; of works, a keyword in the generator."""
    named = lambda agent, other: F.when(agent != "", agent).otherwise(other)

    def of_action(a: Column) -> Column:
        agent = _text(a["softwareAgent"])
        return F.when(F.lower(_text(a["digitalSourceType"])).rlike("|".join(AI_SOURCES)), named(agent, F.lit("AI Generator"))).when(mentions_ai(F.concat_ws(" ", agent, _text(a["description"]))), named(agent, F.lit("AI Tool")))

    actions = F.get(F.filter(F.transform(F.coalesce(assertion["data"]["actions"], F.array()), of_action), lambda x: x.isNotNull()), F.lit(0))
    generator = assertion["data"]["generator"]
    return F.when(assertion["label"].isin(ACTIONS), actions).when(assertion["label"].isin(WORKS), F.when(mentions_ai(_text(generator)), generator))


def chain(manifest: Column) -> Column:
    """Entries of a manifest, oldest first: array<struct<id, issuer, time, status, chain, ai_tool, actions, agents, active>>."""

    def entry(e: Column) -> Column:
        m = e["value"]
        assertions = F.coalesce(m["assertions"], F.array())
        actions = F.flatten(F.transform(F.filter(assertions, lambda a: a["label"].isin(ACTIONS)), lambda a: F.coalesce(a["data"]["actions"], F.array())))
        ai = F.get(F.filter(F.transform(assertions, _ai_tool), lambda x: x.isNotNull()), F.lit(0))
        s = m["signature_info"]
        return F.struct(
            e["key"].alias("id"), s["issuer"].alias("issuer"), _text(s["time"]).alias("time"), s["validation_status"].alias("status"), (F.size(F.coalesce(s["certificates"], F.array())) > 0).alias("chain"), ai.alias("ai_tool"),
            F.transform(actions, lambda a: _text(a["action"])).alias("actions"), F.transform(actions, lambda a: _text(a["softwareAgent"])).alias("agents"), (e["key"] == manifest["active_manifest"]).alias("active"),
        )

    return F.transform(F.map_entries(manifest["manifests"]), entry)


def described(actions: Column, agents: Column) -> Column:
    """Known actions as "name (agent)", other creations as "created by agent"."""
    known = F.array(*map(F.lit, SEVERITY))
    lines = F.zip_with(actions, agents, lambda a, g: F.when(F.array_contains(known, F.lower(a)), F.concat(F.lower(a), F.lit(" ("), g, F.lit(")"))).when(F.lower(a).contains("created"), F.concat(F.lit("created by "), g)))
    return F.filter(lines, lambda x: x.isNotNull())


def assess(manifests: DataFrame, key: str = "case_id", column: str = "manifest") -> DataFrame:
    """(key, state, verified, is_ai, ai_tool, severity, actions (the first three, as told to a reader), n_actions, creation_tool,
    final_tool, real_prob, confidence) from a column of manifest JSON. Without a manifest (null, or JSON that isn't one) the
    tool abstains: state "none", 0.5 with confidence 0."""
    rows = manifests.select(key, F.from_json(column, MANIFEST).alias("m"))
    rows = rows.select(key, "m", F.coalesce(chain(F.col("m")), F.array().cast("array<struct<id:string,issuer:string,time:string,status:string,chain:boolean,ai_tool:string,actions:array<string>,agents:array<string>,active:boolean>>")).alias("c"))
    first = lambda xs: F.get(xs, F.lit(0))
    issuer = lambda e: F.coalesce(e["issuer"], F.lit("Unknown"))
    active = F.filter("c", lambda e: F.coalesce(e["active"], F.lit(False)))
    own = F.get(active, F.size(active) - 1)
    created = F.filter("c", lambda e: F.exists(e["actions"], lambda a: a.contains("created")))
    actions, agents = (F.flatten(F.col(f"c.{n}")) for n in ("actions", "agents"))
    rows = rows.select(
        key, (F.size("c") > 0).alias("has"), signature_state(own["status"], own["issuer"], F.coalesce(own["chain"], F.lit(False))).alias("state"), first(F.filter(F.transform("c", lambda e: e["ai_tool"]), lambda x: x.isNotNull())).alias("ai_tool"),
        severity(actions).alias("severity"), described(actions, agents).alias("told"), issuer(F.coalesce(first(created), first(F.col("c")))).alias("creation_tool"), issuer(F.coalesce(own, F.get("c", F.size("c") - 1))).alias("final_tool"),
    )
    has, valid = F.col("has"), is_valid(F.col("state"))
    s = provenance_score(valid, F.col("ai_tool").isNotNull(), F.col("severity"))
    return rows.select(
        key, F.when(has, F.col("state")).otherwise("none").alias("state"), (has & valid).alias("verified"), F.col("ai_tool").isNotNull().alias("is_ai"), F.coalesce("ai_tool", F.lit("")).alias("ai_tool"), "severity",
        F.array_join(F.slice("told", 1, 3), ", ").alias("actions"), F.size("told").alias("n_actions"), "creation_tool", "final_tool", F.when(has, s["real_prob"]).otherwise(0.5).alias("real_prob"), F.when(has, s["confidence"]).otherwise(0.0).alias("confidence"),
    )
