"""Risk scores of packages: one aggregation per package, then a chain of expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V
from auspex.operators.findings import deduplicated, patterns


def pattern_scores(findings: DataFrame) -> DataFrame:
    """``patterns`` with score: base of the severity, damped count, confidence."""
    base = X.lookup(F.col("max_severity"), V.BASE_SCORES, 0.5)
    return patterns(findings).withColumn("score", base * (1 + F.log10("n")) * F.least("avg_confidence", F.lit(1.0)))


def category_cap(n_categories: Column, has_tier_one: Column) -> Column:
    return F.when(~has_tier_one, 3.5).when(n_categories == 1, 5.0).when(n_categories == 2, 7.0).when(n_categories == 3, 8.5).otherwise(10.0)


def llm_multiplier(c: Column) -> Column:
    return F.when(c.isNull(), 1.0).when(c < 0.2, 0.2 + 0.5 * c).when(c < 0.5, 0.3 + 0.6 * (c - 0.2)).otherwise(0.5 + 0.8 * (c - 0.5))


def reputation_multiplier(downloads: Column, age: Column, verified: Column) -> Column:
    return F.when((downloads > 1_000_000) & (age > 1095) & verified, 0.3).when((downloads > 100_000) & (age > 365) & verified, 0.5).when((downloads > 10_000) & (age > 180), 0.7).when((downloads > 1_000) & (age > 90), 0.85).otherwise(1.0)


def reputation_tier(downloads: Column, age: Column, verified: Column) -> Column:
    return F.when((downloads > 100_000) & (age > 365) & verified, "tier1_verified").when((downloads > 10_000) & (age > 180), "tier2_popular").when((downloads > 1_000) & (age > 90), "tier3_established").otherwise("tier4_unknown")


def floors(findings: DataFrame) -> DataFrame:
    """The least score that known signs give a package; the first that holds counts."""
    critical = F.col("severity") == "critical"
    known = F.bool_or(critical & (F.col("category") == "blockchain_c2") & F.col("description").contains("Known C2"))
    polling = F.bool_or(critical & (F.col("category") == "blockchain_c2") & F.col("description").contains("polling"))
    local = X.contains_any(F.col("description"), ("i18n", "locale", "translation", "gettext"))
    stego = F.bool_or(critical & F.col("category").isin("stegano_payload", "invisible_character") & F.col("description").contains("decoder") & ~local)
    return findings.groupBy("package_name").agg(F.when(known, 9.0).when(polling, 9.0).when(stego, 8.5).otherwise(0.0).alias("floor"))


def independent_scores(findings: DataFrame, context: DataFrame | None = None, threshold: float = 5.0) -> DataFrame:
    """score in [0, 10] per package; ``context`` may have downloads, age, verified and llm_confidence of it."""
    unique = deduplicated(findings)
    sums = pattern_scores(unique).groupBy("package_name").agg(F.sum("score").alias("raw"), F.countDistinct("category").alias("n_categories"), F.bool_or(F.col("category").isin(*V.TIER_ONE)).alias("tier_one"), F.sum("n").alias("n_findings"))
    scored = sums.join(floors(unique), "package_name")
    factor = F.lit(1.0)
    if context is not None:
        scored = scored.join(context, "package_name", "left")
        factor = llm_multiplier(F.col("llm_confidence")) * reputation_multiplier(F.coalesce("downloads_weekly", F.lit(0)), F.coalesce("age_days", F.lit(0)), F.coalesce("verified", F.lit(False)))
    capped = F.least("raw", category_cap(F.col("n_categories"), F.col("tier_one"))) * factor
    score = F.round(F.least(F.greatest(capped, F.col("floor")), F.lit(10.0)), 6)
    return scored.select("package_name", "n_findings", "n_categories", score.alias("score")).withColumn("is_malicious", F.col("score") >= threshold)


@dataclass(frozen=True)
class Tier:
    number: int
    detectors: tuple[str, ...]
    threshold: float
    multiplier: float = 1.0


TIERS = (Tier(1, V.TIER_ONE, 0.0), Tier(2, ("homoglyph", "bidirectional_override", "stegano_payload", "decoder_function"), 1.0, 1.2), Tier(3, ("header_c2", "blockchain_c2", "locale_geofencing", "time_delay_sandbox_evasion", "encrypted_payload"), 5.0, 1.5))


@dataclass(frozen=True)
class Rule:
    condition: str
    action: str


RULES = (Rule("header_c2.detected == 1 AND final_score > 5", "final_score *= 1.2"), Rule("homoglyph.count >= 3 OR unicode_tag.count >= 2", "final_score += 1.5"), Rule("blockchain_c2.detected == 1", "final_score *= 1.1"))
_TERM = re.compile(r"^(\S+) (==|!=|<=|>=|<|>) (-?[\d.]+)$")


def compile_condition(condition: str, score: Column, counts: Column) -> Column:
    """A condition as a column.  Terms are all joined by AND or all by OR; what doesn't parse is false."""
    parts = condition.split(" AND ") if " AND " in condition else condition.split(" OR ")
    terms = []
    for part in parts:
        m = _TERM.match(part.strip())
        if not m:
            terms.append(F.lit(False))
            continue
        name, op, number = m[1], m[2], float(m[3])
        value = score
        if name != "final_score":
            detector, _, field = name.partition(".")
            n = F.coalesce(counts[detector], F.lit(0)).cast("double")
            value = F.when(n > 0, 1.0).otherwise(0.0) if field == "detected" else n if field in ("score", "count") else F.lit(None).cast("double")
        near = F.abs(value - number) < 0.001
        terms.append(F.coalesce({"==": near, "!=": ~near, "<": value < number, ">": value > number, "<=": value <= number, ">=": value >= number}[op], F.lit(False)))
    out = terms[0]
    for t in terms[1:]:
        out = out & t if " AND " in condition else out | t
    return out


def apply_rules(score: Column, counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules in order, each on the score that the one before left."""
    for rule in rules:
        _, op, number = rule.action.split(" ")
        changed = {"=": F.lit(float(number)), "+=": score + float(number), "*=": score * float(number)}[op]
        score = F.when(compile_condition(rule.condition, score, counts), changed).otherwise(score)
    return score


def tiered_scores(findings: DataFrame, tiers: tuple[Tier, ...] = TIERS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Tiers in order, each only if the sum so far reaches its threshold; then the rules and floors.  Not capped."""
    unique = deduplicated(findings)
    weighted = pattern_scores(unique).withColumn("weighted", F.col("score") * X.lookup(F.col("category"), V.WEIGHTS, V.OTHER_WEIGHT))
    per_tier = [F.coalesce(F.sum(F.when(F.col("category").isin(*t.detectors), F.col("weighted"))), F.lit(0.0)).alias(f"tier{t.number}") for t in tiers]
    counted = weighted.groupBy("package_name").agg(*per_tier)
    counts = unique.groupBy("package_name", "category").count().groupBy("package_name").agg(F.map_from_entries(F.collect_list(F.struct("category", "count"))).alias("counts"))
    running = F.lit(0.0)
    for t in tiers:
        running = F.when(running >= t.threshold, running + F.col(f"tier{t.number}") * t.multiplier).otherwise(running)
    scored = counted.withColumn("running", running).join(counts, "package_name").join(floors(unique), "package_name")
    # map keys that aren't there give null
    final = F.greatest(apply_rules(F.col("running"), F.col("counts"), rules), F.col("floor"), F.lit(0.0))
    return scored.select("package_name", F.round("running", 6).alias("tier_score"), F.round(final, 6).alias("score"))


def package_risk(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Severity points times the multipliers of ``context`` (ecosystem, package_type, age_days, known_publisher), with level."""
    points = findings.groupBy("package_name").agg(F.sum(X.lookup(F.col("severity"), V.RISK_POINTS, 1)).alias("points"))
    age = F.col("age_days")
    factor = X.lookup(F.col("ecosystem"), {"npm": 1.0, "pypi": 1.2, "github": 1.5}, 1.0) * X.lookup(F.col("package_type"), {"library": 1.0, "cli": 1.3, "extension": 1.5}, 1.0) * F.when(age.isNull(), 1.2).when(age < 7, 1.5).when(age < 30, 1.2).otherwise(1.0) * F.when(F.col("known_publisher"), 0.8).otherwise(1.0)
    risk = F.round(F.col("points") * factor, 6)
    level = F.when(F.col("risk") >= 100, "critical").when(F.col("risk") >= 50, "high").when(F.col("risk") >= 25, "medium").when(F.col("risk") >= 10, "low").otherwise("info")
    return points.join(context, "package_name").select("package_name", "points", risk.alias("risk")).withColumn("level", level)


def with_llm_verdict(scores: DataFrame, verdicts: DataFrame, gate: float = 6.0) -> DataFrame:
    """A sure verdict (0.75 and more) replaces is_malicious, an unsure one (0.25 and less) clears it, for scores from the gate on."""
    joined = scores.join(verdicts, "package_name", "left")
    c = F.col("llm_confidence")
    final = F.when((F.col("score") < gate) | c.isNull(), F.col("is_malicious")).when(c >= 0.75, F.col("llm_malicious")).when(c <= 0.25, F.lit(False)).otherwise(F.col("is_malicious"))
    return joined.select("package_name", "score", final.alias("is_malicious"))


def llm_stage(score: Column, triage: Column, analysis: Column) -> Column:
    """The stage where the review of a package ends."""
    return F.when(triage < 0.25, "triage").when(analysis >= 0.75, "analysis").when(score.between(4, 7), "deep_dive").otherwise("analysis")
