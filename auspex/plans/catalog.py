"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V
from auspex.operators import cluster, correlate, detect, findings, graph, mutate, report, scoring, state
from auspex.operators import waves as waves_
from auspex.operators.rules import literals
from auspex.plans import duck
from auspex.plans.duck import q
from auspex.plans.registered import ORACLES, QUERIES, query, table  # noqa: F401
from auspex.sources import corpus, manifests
from auspex.sources.shared import materialize
from auspex.streaming import progress

FLAGSHIP = "package_score_independent"


RANK = f"list_position([{', '.join(map(q, V.SEVERITIES))}], severity)"
UNIQUE = f"""{duck.FINDINGS},
uniq AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY package_name, file_path, line, col, category ORDER BY {RANK} DESC, description, code_point, confidence DESC NULLS LAST) AS rn FROM found) WHERE rn = 1)"""
PATTERNS = f"""{UNIQUE},
pattern AS (SELECT package_name, category, description, count(*) AS n, [{", ".join(map(q, V.SEVERITIES))}][max({RANK})] AS max_severity, avg(coalesce(confidence, 0.5)) AS avg_confidence FROM uniq GROUP BY ALL)"""


def _lookup(expr: str, items: dict, other) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in items.items()) + f" ELSE {other} END"


SCORED = f"""{PATTERNS},
ps AS (SELECT *, {_lookup("max_severity", V.BASE_SCORES, 0.5)} * (1 + log10(n)) * least(avg_confidence, 1) AS score FROM pattern),
fl AS (SELECT package_name, CASE WHEN bool_or(severity = 'critical' AND category = 'blockchain_c2' AND (contains(description, 'Known C2') OR contains(description, 'polling'))) THEN 9.0
  WHEN bool_or(severity = 'critical' AND category IN ('stegano_payload', 'invisible_character') AND contains(description, 'decoder') AND NOT (contains(description, 'i18n') OR contains(description, 'locale') OR contains(description, 'translation') OR contains(description, 'gettext'))) THEN 8.5 ELSE 0 END AS floor FROM uniq GROUP BY 1)"""
INDEPENDENT = f"""{SCORED},
sums AS (SELECT package_name, sum(score) AS raw, count(DISTINCT category) AS n_categories, bool_or(category IN ('invisible_character', 'stego_pattern')) AS tier_one, sum(n)::BIGINT AS n_findings FROM ps GROUP BY 1),
ind AS (SELECT package_name, n_findings, n_categories, least(raw, CASE WHEN NOT tier_one THEN 3.5 WHEN n_categories = 1 THEN 5 WHEN n_categories = 2 THEN 7 WHEN n_categories = 3 THEN 8.5 ELSE 10 END) AS capped, floor FROM sums JOIN fl USING (package_name))"""
CONTEXT_SQL = "ctx AS (SELECT 'pkg' || k AS package_name, k * 17389 AS downloads_weekly, k * 23 AS age_days, k % 2 = 0 AS verified, CASE WHEN k % 3 > 0 THEN k / 97.0 END AS llm_confidence, k % 4 = 1 AS llm_malicious, ['npm', 'pypi', 'github'][k % 3 + 1] AS ecosystem, ['library', 'cli', 'extension'][k % 3 + 1] AS package_type, k % 5 = 0 AS known_publisher FROM (SELECT unnest(range(97)) AS k))"


def context(spark: SparkSession) -> DataFrame:
    """A made-up reputation of each package."""
    k = F.col("id").cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), k % 3 + 1)
    return spark.range(corpus.PACKAGES).select(
        F.concat(F.lit("pkg"), k.cast("string")).alias("package_name"), (k * 17389).alias("downloads_weekly"), (k * 23).alias("age_days"), (k % 2 == 0).alias("verified"),
        F.when(k % 3 > 0, k / 97.0).alias("llm_confidence"), (k % 4 == 1).alias("llm_malicious"), pick("npm", "pypi", "github").alias("ecosystem"), pick("library", "cli", "extension").alias("package_type"), (k % 5 == 0).alias("known_publisher"),
    )


# detectors


@query("all_findings", f"{duck.FINDINGS} SELECT * FROM found")
def all_findings(spark, sf_dir):
    return detect.corpus_findings(spark, sf_dir)


for _name, _maker, _sql in (
    ("char_findings", detect.char_findings, duck.CHAR),
    ("line_findings", detect.line_findings, duck.LINE),
    ("window_findings", detect.window_findings, duck.WINDOW),
):
    query(_name, f"WITH {duck.PREPARED}, {duck.MARKS}, {duck.SIGN} {_sql}")(lambda spark, sf_dir, f=_maker: f(detect.signed(corpus.files(spark, sf_dir))))


@query("file_findings", f"WITH {duck.PREPARED}, {duck.WIDE} {duck.FILE}")
def file_findings(spark, sf_dir):
    signs = materialize(detect.signed(corpus.files(spark, sf_dir)), "signs")
    return detect.file_findings(signs).unionByName(detect.whole_file_findings(signs))


@query("bidi_by_severity", f"WITH {duck.PREPARED}, {duck.MARKS}, f AS ({duck.CHAR}) SELECT severity, count(*) AS n FROM f JOIN ready USING (package_name, file_path) WHERE category = 'bidirectional_override' AND file_class = 'production' GROUP BY 1")
def bidi_by_severity(spark, sf_dir):
    signs = detect.signed(corpus.files(spark, sf_dir)).where("file_class = 'production'")
    return detect.char_findings(signs).where("category = 'bidirectional_override'").groupBy("severity").agg(F.count("*").alias("n"))


# files


@query("file_class_counts", f"WITH {duck.PREPARED} SELECT file_class, is_i18n, count(*) AS n_files, sum(bytes)::BIGINT AS n_bytes FROM ready GROUP BY ALL")
def file_class_counts(spark, sf_dir):
    return detect.prepared(corpus.files(spark, sf_dir)).groupBy("file_class", "is_i18n").agg(F.count("*").alias("n_files"), F.sum("bytes").cast("long").alias("n_bytes"))


@query(
    "line_metrics",
    """SELECT doc_id, len(lines)::BIGINT AS n_lines, strlen(text)::BIGINT AS n_bytes, round(length(regexp_replace(text, '[^ \\t\\n\\r]', '', 'g')) / length(text), 6) AS white_share,
  strlen(text) / len(lines) > 500 OR len(lines) = 1 AND strlen(text) > 1000 AS is_minified FROM (SELECT *, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents WHERE text <> ''))""",
)
def line_metrics(spark, sf_dir):
    """Real text: lines, bytes, share of white space, and whether it looks minified."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").withColumn("n_lines", F.size(X.lines_of(F.col("text"))).cast("long"))
    white = F.length(F.regexp_replace("text", r"[^ \t\n\r]", ""))
    return docs.select("doc_id", "n_lines", F.octet_length("text").cast("long").alias("n_bytes"), F.round(white / F.length("text"), 6).alias("white_share"), X.is_minified(F.col("text"), F.col("n_lines")).alias("is_minified"))


@query("script_hosts", """SELECT host, count(*) AS n_pages, sum(n)::BIGINT AS n_scripts FROM (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, len(regexp_extract_all(html, '<script')) AS n FROM pages) GROUP BY 1""")
def script_hosts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return pages.select(host.alias("host"), F.regexp_count("html", F.lit("<script")).alias("n")).groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_scripts"))


@query("turn_entropy", "SELECT conv_id, turn, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM (SELECT conv_id, turn, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY conv_id, turn) AS total FROM (SELECT conv_id, turn, substr(h, k, 2) AS b FROM (SELECT conv_id, turn, hex(encode(text)) AS h, unnest(range(1, 2 * strlen(text), 2)) AS k FROM conversations)) GROUP BY conv_id, turn, b) GROUP BY conv_id, turn")
def turn_entropy(spark, sf_dir):
    """Entropy of each turn's bytes: counts per byte value, then one sum."""
    turns = table(spark, sf_dir, "conversations").where("octet_length(text) > 0")
    pairs = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit("(..)"), F.lit(1))
    counts = turns.select("conv_id", "turn", F.explode(pairs).alias("b")).groupBy("conv_id", "turn", "b").agg(F.count("*").alias("n"))
    sums = counts.groupBy("conv_id", "turn").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select("conv_id", "turn", F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("entropy"))


# manifests


@query("rdd_dependencies", f"WITH {manifests.SQL} SELECT package_name, file_path, dep, url, CASE WHEN {duck.contains('url', manifests.KNOWN_DOMAINS)} THEN 'critical' ELSE 'high' END AS severity FROM (SELECT package_name, file_path, j.key AS dep, j.value->>'$' AS url FROM manifest, json_each(manifest.doc, '$.dependencies') AS j UNION ALL SELECT package_name, file_path, j.key AS dep, j.value->>'$' AS url FROM (SELECT * FROM manifest WHERE json_exists(doc, '$.devDependencies')), json_each(doc, '$.devDependencies') AS j) WHERE regexp_matches(url, '^https?://')")
def rdd_dependencies(spark, sf_dir):
    return manifests.url_dependencies(manifests.manifests(spark, sf_dir))


_KNOWN = [f"CASE WHEN doc->>'{path}' IN ('JPD', 'jpd', 'Jpd') THEN doc->>'{path}' END" for path in ("$.author.name", "$.author", "$.maintainers[0].name")]


@query("jpd_author", f"WITH {manifests.SQL} SELECT package_name, file_path, coalesce({', '.join(_KNOWN)}) AS author FROM manifest WHERE coalesce({', '.join(_KNOWN)}) IS NOT NULL")
def jpd_author(spark, sf_dir):
    return manifests.known_authors(manifests.manifests(spark, sf_dir))


# findings


@query("findings_dedup", f"{UNIQUE} SELECT * FROM uniq")
def findings_dedup(spark, sf_dir):
    return detect.corpus_unique(spark, sf_dir)


@query("dedup_stats", f"{duck.FINDINGS} SELECT sum(n)::BIGINT AS n_before, count(*) AS n_after, sum(n - 1)::BIGINT AS n_removed FROM (SELECT count(*) AS n FROM found GROUP BY package_name, file_path, line, col, category)")
def dedup_stats(spark, sf_dir):
    return findings.dedup_stats(detect.corpus_findings(spark, sf_dir))


@query("patterns", f"{PATTERNS} SELECT package_name, category, description, n, max_severity, round(avg_confidence, 6) AS avg_confidence FROM pattern")
def patterns(spark, sf_dir):
    return findings.patterns(detect.corpus_unique(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("session_stats", f"{UNIQUE} SELECT count(DISTINCT package_name || ' ' || file_path) AS n_files, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity IN ('low', 'info')) AS n_low FROM uniq")
def session_stats(spark, sf_dir):
    return findings.session_stats(detect.corpus_unique(spark, sf_dir))


@query("summary_by_category", f"{UNIQUE} SELECT category, severity, count(*) AS n, count(DISTINCT package_name || ' ' || file_path) AS n_files FROM uniq GROUP BY ROLLUP (category, severity)")
def summary_by_category(spark, sf_dir):
    unique = detect.corpus_unique(spark, sf_dir)
    return unique.rollup("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("package_name", "file_path").alias("n_files"))


@query("ioc_hits", f"WITH {duck.PREPARED} SELECT package_name, file_path, line, ioc FROM line, (SELECT unnest([{', '.join(map(q, V.C2_WALLETS + V.C2_ADDRESSES))}]) AS ioc) WHERE contains(text, ioc)")
def ioc_hits(spark, sf_dir):
    """Known indicators per line: a combined pattern first, then the single ones."""
    lines = corpus.lines(corpus.files(spark, sf_dir)).where(F.col("text").rlike(literals(V.C2_WALLETS + V.C2_ADDRESSES)))
    hits = F.filter(F.array(*(F.when(F.col("text").contains(i), F.lit(i)) for i in V.C2_WALLETS + V.C2_ADDRESSES)), lambda x: x.isNotNull())
    return lines.select("package_name", "file_path", "line", F.explode(hits).alias("ioc"))


# scores


@query("package_score_independent", f"{INDEPENDENT} SELECT package_name, n_findings, n_categories, round(least(greatest(capped, floor), 10), 6) AS score, round(least(greatest(capped, floor), 10), 6) >= 5 AS is_malicious FROM ind")
def package_score_independent(spark, sf_dir):
    return scoring.independent_scores(detect.corpus_findings(spark, sf_dir))


_MULT = """(CASE WHEN llm_confidence IS NULL THEN 1 WHEN llm_confidence < 0.2 THEN 0.2 + 0.5 * llm_confidence WHEN llm_confidence < 0.5 THEN 0.3 + 0.6 * (llm_confidence - 0.2) ELSE 0.5 + 0.8 * (llm_confidence - 0.5) END)
 * (CASE WHEN downloads_weekly > 1000000 AND age_days > 1095 AND verified THEN 0.3 WHEN downloads_weekly > 100000 AND age_days > 365 AND verified THEN 0.5 WHEN downloads_weekly > 10000 AND age_days > 180 THEN 0.7 WHEN downloads_weekly > 1000 AND age_days > 90 THEN 0.85 ELSE 1 END)"""


@query("package_score_in_context", f"{INDEPENDENT}, {CONTEXT_SQL} SELECT package_name, n_findings, n_categories, round(least(greatest(capped * {_MULT}, floor), 10), 6) AS score, round(least(greatest(capped * {_MULT}, floor), 10), 6) >= 5 AS is_malicious FROM ind JOIN ctx USING (package_name)")
def package_score_in_context(spark, sf_dir):
    """With reputation and review multipliers."""
    return scoring.independent_scores(detect.corpus_findings(spark, sf_dir), context(spark))


_TIERS = "\n".join(f", coalesce(sum(CASE WHEN category IN ({', '.join(map(q, t.detectors))}) THEN score * {_lookup('category', V.WEIGHTS, V.OTHER_WEIGHT)} END), 0) AS t{t.number}" for t in scoring.TIERS)


@query(
    "package_score_tiered",
    f"""{SCORED},
tier AS (SELECT package_name {_TIERS} FROM ps GROUP BY 1),
cnt AS (SELECT package_name, count(*) FILTER (category = 'header_c2') AS h, count(*) FILTER (category = 'homoglyph') AS g, count(*) FILTER (category = 'unicode_tag') AS u, count(*) FILTER (category = 'blockchain_c2') AS b FROM uniq GROUP BY 1),
r1 AS (SELECT *, t1 + CASE WHEN t1 >= 1 THEN t2 * 1.2 ELSE 0 END AS r FROM tier), r2 AS (SELECT *, r + CASE WHEN r >= 5 THEN t3 * 1.5 ELSE 0 END AS tier_score FROM r1),
x1 AS (SELECT *, CASE WHEN h > 0 AND tier_score > 5 THEN tier_score * 1.2 ELSE tier_score END AS s1 FROM r2 JOIN cnt USING (package_name)),
x2 AS (SELECT *, CASE WHEN g >= 3 OR u >= 2 THEN s1 + 1.5 ELSE s1 END AS s2 FROM x1), x3 AS (SELECT *, CASE WHEN b > 0 THEN s2 * 1.1 ELSE s2 END AS s3 FROM x2)
SELECT package_name, round(tier_score, 6) AS tier_score, round(greatest(s3, floor, 0), 6) AS score FROM x3 JOIN fl USING (package_name)""",
)
def package_score_tiered(spark, sf_dir):
    """Tiers and the conditional rules."""
    return scoring.tiered_scores(detect.corpus_findings(spark, sf_dir))


_RISK = "points::DOUBLE * (CASE ecosystem WHEN 'npm' THEN 1.0 WHEN 'pypi' THEN 1.2 ELSE 1.5 END) * (CASE package_type WHEN 'library' THEN 1.0 WHEN 'cli' THEN 1.3 ELSE 1.5 END) * (CASE WHEN age_days < 7 THEN 1.5 WHEN age_days < 30 THEN 1.2 ELSE 1 END) * (CASE WHEN known_publisher THEN 0.8 ELSE 1 END)"


@query("package_risk", f"{UNIQUE}, {CONTEXT_SQL}, p AS (SELECT package_name, sum({_lookup('severity', V.RISK_POINTS, 1)})::BIGINT AS points FROM uniq GROUP BY 1), r AS (SELECT package_name, points, round({_RISK}, 6) AS risk FROM p JOIN ctx USING (package_name)) SELECT *, CASE WHEN risk >= 100 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' WHEN risk >= 10 THEN 'low' ELSE 'info' END AS level FROM r")
def package_risk(spark, sf_dir):
    return scoring.package_risk(detect.corpus_unique(spark, sf_dir), context(spark))


@query("verdict_llm_override", f"{INDEPENDENT}, {CONTEXT_SQL}, s AS (SELECT package_name, round(least(greatest(capped, floor), 10), 6) AS score FROM ind) SELECT package_name, score, CASE WHEN score < 6 OR llm_confidence IS NULL THEN score >= 5 WHEN llm_confidence >= 0.75 THEN llm_malicious WHEN llm_confidence <= 0.25 THEN false ELSE score >= 5 END AS is_malicious FROM s JOIN ctx USING (package_name)")
def verdict_llm_override(spark, sf_dir):
    scores = scoring.independent_scores(detect.corpus_findings(spark, sf_dir)).select("package_name", "score", "is_malicious")
    return scoring.with_llm_verdict(scores, context(spark).select("package_name", "llm_confidence", "llm_malicious"))


_TIER = "SELECT abs(c_acctbal) * 100 AS d, c_custkey % 1500 AS a, c_mktsegment <> 'BUILDING' AS v FROM customer"


@query("reputation_tiers", f"SELECT CASE WHEN d > 100000 AND a > 365 AND v THEN 'tier1_verified' WHEN d > 10000 AND a > 180 THEN 'tier2_popular' WHEN d > 1000 AND a > 90 THEN 'tier3_established' ELSE 'tier4_unknown' END AS tier, count(*) AS n FROM ({_TIER}) GROUP BY 1")
def reputation_tiers(spark, sf_dir):
    """Customers' balances, numbers and segments stand for downloads, ages and verified publishers."""
    of = table(spark, sf_dir, "customer").select((F.abs("c_acctbal") * 100).alias("d"), (F.col("c_custkey") % 1500).alias("a"), (F.col("c_mktsegment") != "BUILDING").alias("v"))
    return of.groupBy(scoring.reputation_tier(F.col("d"), F.col("a"), F.col("v")).alias("tier")).agg(F.count("*").alias("n"))


# correlation

CHAINS = f"""{UNIQUE},
flag AS (SELECT package_name, file_path, bool_or(category IN ('stegano_payload', 'invisible_character', 'stego_pattern')) AS stego, bool_or(category IN ('decoder_function', 'stego_pattern')) AS decoder, bool_or(regexp_matches(description, {q(correlate.EXECUTES)})) AS ex,
  bool_or(category = 'encrypted_payload') AS enc, bool_or(category = 'header_c2') AS header, bool_or(category = 'blockchain_c2') AS chain, bool_or(category IN ('locale_geofencing', 'time_delay_sandbox_evasion')) AS geo, count(*) AS n_steps, [{", ".join(map(q, V.SEVERITIES))}][max({RANK})] AS severity FROM uniq GROUP BY 1, 2),
kinds AS (SELECT *, CASE WHEN stego AND decoder AND ex THEN 'stego' WHEN enc AND ex THEN 'encrypted_exec' WHEN header THEN 'header_c2' WHEN chain THEN 'blockchain_c2' WHEN geo THEN 'geofenced_exec' END AS kind FROM flag),
chains AS (SELECT package_name, file_path, kind, (CASE WHEN kind IN ('stego', 'header_c2') THEN 0.95 WHEN kind = 'encrypted_exec' THEN 0.75 WHEN kind = 'blockchain_c2' THEN 0.9 WHEN ex THEN 0.85 ELSE 0.7 END)::DOUBLE AS confidence, n_steps, severity FROM kinds WHERE kind IS NOT NULL)"""


def _chains(spark, sf_dir):
    return correlate.attack_chains(detect.corpus_unique(spark, sf_dir))


query("attack_chains", f"{CHAINS} SELECT * FROM chains")(_chains)


@query("threat_score", f"{CHAINS} SELECT package_name, count(*) AS n_chains, round(least(sum(confidence * 2 * {_lookup('severity', V.CHAIN_SEVERITY, 1)} * {_lookup('kind', V.CHAIN_MULTIPLIERS, 1)} + least(n_steps * 0.2, 1)), 10), 6) AS threat_score FROM chains GROUP BY 1")
def threat_score(spark, sf_dir):
    return correlate.threat_scores(_chains(spark, sf_dir))


@query("supply_chain", f"{UNIQUE} SELECT count(DISTINCT package_name) AS n_packages, count(DISTINCT package_name) >= 2 AS compromised FROM uniq WHERE {RANK} >= 3")
def supply_chain(spark, sf_dir):
    return correlate.supply_chain(detect.corpus_unique(spark, sf_dir))


@query("campaign_signals", f"{UNIQUE}, c AS (SELECT package_name, count(*) FILTER (real) AS signals, count(DISTINCT category) FILTER (real) AS categories, count(*) FILTER (real AND category IN ({', '.join(map(q, V.HIGH_VALUE))})) AS high_value FROM (SELECT *, category NOT IN ('unknown', 'invisible_character', 'homoglyph') AS real FROM uniq) GROUP BY 1) SELECT *, CASE WHEN signals < 3 OR categories < 2 THEN 'low' WHEN signals >= 5 AND categories >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM c")
def campaign_signals(spark, sf_dir):
    return correlate.campaign_signals(detect.corpus_unique(spark, sf_dir))


@query("campaign_class", f"{UNIQUE} SELECT package_name, CASE WHEN bool_or(category IN ('stegano_payload', 'decoder_function', 'invisible_character')) AND bool_or(category = 'blockchain_c2') THEN 'stego_with_chain' WHEN bool_or(category = 'forcememo_python') THEN 'python_loader' WHEN bool_or(category = 'time_delay_sandbox_evasion') AND replace(package_name, 'pkg', '')::INT % 3 = 0 THEN 'sandbox_delay' WHEN bool_or(category IN ('stegano_payload', 'decoder_function', 'invisible_character')) THEN 'stego' ELSE 'unknown' END AS campaign FROM uniq GROUP BY 1")
def campaign_class(spark, sf_dir):
    """Every third package has a domain of an assistant's tools besides those of the pages."""
    tools = corpus.files(spark, sf_dir).select("package_name").distinct().where(F.regexp_extract("package_name", r"(\d+)", 1).cast("int") % 3 == 0).withColumn("domain", F.lit("mcp.tools.example"))
    return correlate.campaign_class(detect.corpus_unique(spark, sf_dir), cluster.domains(table(spark, sf_dir, "pages")).unionByName(tools))


# clusters and graphs

DOMAINS = "dom AS (SELECT 'pkg' || (page_id % 97) AS package_name, regexp_extract(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS domain FROM pages)"


@query("infra_reuse", f"WITH {DOMAINS} SELECT count(*) AS n_domains, count(*) FILTER (n > 1) AS n_reused, round(avg(n), 6) AS avg_packages FROM (SELECT count(DISTINCT package_name) AS n FROM dom WHERE domain <> '' GROUP BY domain)")
def infra_reuse(spark, sf_dir):
    return cluster.reuse_stats(cluster.domains(table(spark, sf_dir, "pages")))


@query("infra_clusters", f"WITH RECURSIVE {DOMAINS}, e AS (SELECT DISTINCT a.package_name AS a, b.package_name AS b FROM dom a JOIN dom b USING (domain) WHERE domain <> ''), r AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a) SELECT n AS package_name, min(m) AS cluster FROM r GROUP BY 1")
def infra_clusters(spark, sf_dir):
    return cluster.infrastructure_clusters(cluster.domains(table(spark, sf_dir, "pages")))


def importing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one package, each of which imports the one of half its number."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    half = F.floor(F.col("doc_id") / 2).cast("string")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("import { a } from './m"), half, F.lit("'\n"))).otherwise(F.concat(F.lit("const b = require('./m"), half, F.lit("')\n")))
    return docs.select(F.lit("app").alias("package_name"), F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".ts").otherwise(".js")).alias("file_path"), content.alias("content"))


_FILE = "'src/m' || {0} || CASE WHEN {0} % 3 = 0 THEN '.ts' ELSE '.js' END"


@query("import_edges", f"SELECT 'app' AS package_name, {_FILE.format('doc_id')} AS from_file, './m' || (doc_id // 2) AS module, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 3 END AS form, {_FILE.format('(doc_id // 2)')} AS to_file FROM documents WHERE doc_id // 2 IN (SELECT doc_id FROM documents)")
def import_edges(spark, sf_dir):
    files = importing_files(spark, sf_dir)
    return graph.resolved(graph.import_edges(files), files)


@query("dependency_distance", f"WITH RECURSIVE r AS (SELECT max(doc_id) AS n, 0 AS distance FROM documents UNION SELECT n // 2, distance + 1 FROM r WHERE n > 0) SELECT {_FILE.format('n')} AS node, min(distance) AS distance FROM r GROUP BY 1")
def dependency_distance(spark, sf_dir):
    """How far each file is from the one of the greatest number, over imports."""
    files = importing_files(spark, sf_dir)
    edges = graph.resolved(graph.import_edges(files), files).select(F.col("from_file").alias("a"), F.col("to_file").alias("b"))
    start = files.orderBy(F.regexp_extract("file_path", r"m(\d+)", 1).cast("long").desc()).limit(1).select(F.col("file_path").alias("node"))
    return graph.distances(edges, start).select("node", "distance")


# selection and state


@query("version_sampling", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def version_sampling(spark, sf_dir):
    """The last three versions of each package, by orders of customers."""
    from pyspark.sql import Window as Win

    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey")]
    kept = state.latest(table(spark, sf_dir, "orders"), ["o_custkey"], newest, 3)
    return kept.select("o_custkey", "o_orderkey", F.row_number().over(Win.partitionBy("o_custkey").orderBy(*newest)).cast("long").alias("rn"))


@query("pending_packages", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def pending_packages(spark, sf_dir):
    """Orders of every ninth number stand for finished scans."""
    done = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return state.pending(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("cache_lookup", "SELECT o_orderkey AS key, sha256(o_orderpriority) AS content_hash, CASE WHEN o_orderkey % 4 = 0 THEN 'miss' WHEN o_orderkey % 4 = 1 THEN 'stale' WHEN o_orderkey % 4 = 2 THEN 'miss' ELSE 'hit' END AS state, CASE WHEN o_orderkey % 4 = 3 THEN 'clean' END AS result FROM orders")
def cache_lookup(spark, sf_dir):
    """Orders as items: of four, one isn't cached, one is out of date, one has changed, one is a hit."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.sha2("o_orderpriority", 256).alias("content_hash"))
    now = F.lit("2024-01-10").cast("timestamp")
    cache = items.where("key % 4 > 0").select("key", F.when(F.col("key") % 4 == 2, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("key") % 4 == 1, F.lit("2024-01-09")).otherwise(F.lit("2024-01-17")).cast("timestamp").alias("expires_at"), F.lit("clean").alias("result"))
    return state.cache_lookup(items, cache, now)


@query("upserted_packages", "SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def upserted_packages(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").withColumn("version", F.lit(1))
    changes = base.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("version", F.lit(2))
    return state.upserted(base, changes, ["c_custkey"], "version")


@query("name_variants", "SELECT name, v AS variant FROM (SELECT name, unnest(list_distinct([name || '-js', name || 'js', name || '.js', name || '-official', name || '-lib', '@' || name || '/core'])) AS v FROM (SELECT DISTINCT lower(replace(n_name, ' ', '-')) AS name FROM nation)) WHERE v <> name")
def name_variants(spark, sf_dir):
    return state.name_variants(table(spark, sf_dir, "nation").select(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("name")).distinct())


@query("top_malicious", f"{INDEPENDENT} SELECT package_name, round(least(greatest(capped, floor), 10), 6) AS score FROM ind ORDER BY 2 DESC, 1 LIMIT 20")
def top_malicious(spark, sf_dir):
    """A top-k report."""
    return scoring.independent_scores(detect.corpus_findings(spark, sf_dir)).select("package_name", "score").orderBy(F.col("score").desc(), "package_name").limit(20)


@query("wave_levels", "SELECT 'w' || n_nationkey AS wave, floor(log2(n_nationkey + 1))::INT AS level FROM nation")
def wave_levels(spark, sf_dir):
    """Waves that each depend on the one of half their number."""
    waves = table(spark, sf_dir, "nation").select("n_nationkey")
    name = lambda c: F.concat(F.lit("w"), c.cast("string"))
    deps = waves.where("n_nationkey > 0").select(name(F.col("n_nationkey")).alias("wave"), name(F.floor((F.col("n_nationkey") - 1) / 2)).alias("needs"))
    return waves_.level_of(waves.select(name(F.col("n_nationkey")).alias("wave")), deps)


_TREE = 16


def planned_waves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """For each document a wave of a tree, two on a cycle behind it, one between these and one that needs itself, two behind the cycle; every tenth has one that needs an unknown wave."""
    d = F.col("doc_id")
    name = lambda kind, by=d: F.concat(F.lit(kind), by.cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    pairs = [("c", "d"), ("d", "c"), ("c", "w"), ("b", "c"), ("x", "b"), ("x", "x"), ("e", "d"), ("f", "e")]
    links = [F.struct(name(a).alias("wave"), name(b).alias("needs")) for a, b in pairs]
    links += [F.when(d > 0, F.struct(name("w").alias("wave"), name("w", F.floor(d / _TREE)).alias("needs"))), F.when(d % 10 == 0, F.struct(name("g").alias("wave"), name("lost").alias("needs")))]
    deps = docs.select(F.inline(F.filter(F.array(*links), lambda x: x.isNotNull())))
    waves = docs.select(F.explode(F.array(*map(name, "wcdbxef"))).alias("wave")).unionByName(docs.where(d % 10 == 0).select(name("g").alias("wave")))
    return waves, deps


@query(
    "wave_plan",
    f"""SELECT 'w' || doc_id AS wave, 'placed' AS state, CASE WHEN doc_id = 0 THEN 0 ELSE length(to_base(doc_id, {_TREE})) END::INTEGER AS level, NULL::VARCHAR AS tangle FROM documents
UNION ALL SELECT unnest(['c', 'd', 'b', 'x']) || doc_id, 'cycle', NULL, 'b' || doc_id FROM documents UNION ALL SELECT unnest(['e', 'f']) || doc_id, 'blocked', NULL, NULL FROM documents
UNION ALL SELECT 'g' || doc_id, 'blocked', NULL, NULL FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'lost' || doc_id, 'unknown', NULL, 'lost' || doc_id FROM documents WHERE doc_id % 10 = 0""",
)
def wave_plan(spark, sf_dir):
    return waves_.wave_plan(*planned_waves(spark, sf_dir))


# events and reports


@query("campaign_progress", "SELECT user_id % 10 AS wave, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (event_type = 'purchase') AS n_flagged, round(sum(value), 4) AS total_value, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1")
def campaign_progress(spark, sf_dir):
    return progress.counters(table(spark, sf_dir, "events"))


@query("event_activity", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def event_activity(spark, sf_dir):
    return progress.activity(table(spark, sf_dir, "events"))


@query("event_sessions", "SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return progress.sessions(table(spark, sf_dir, "events"))


@query("detection_metrics", f"""WITH {duck.FILES}, p AS (SELECT doc_id, toxic, contains(content, 'eval(') OR contains(content, 'process.') AS flagged FROM corpus JOIN labels USING (doc_id))
SELECT round(count(*) FILTER (flagged AND toxic = 1) / count(*) FILTER (toxic = 1), 6) AS evidence_rate, round(count(*) FILTER (flagged AND toxic = 0) / count(*) FILTER (toxic = 0), 6) AS fp_rate,
round(0.6 * count(*) FILTER (flagged AND toxic = 1) / count(*) FILTER (toxic = 1) + 0.4 * (1 - count(*) FILTER (flagged AND toxic = 0) / count(*) FILTER (toxic = 0)), 6) AS combined FROM p""")
def detection_metrics(spark, sf_dir):
    """Planted snippets against labels: only the formula is real."""
    files = corpus.files(spark, sf_dir).select("doc_id", X.contains_any(F.col("content"), ("eval(", "process.")).alias("flagged"))
    return report.detection_metrics(files.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("positive")), "doc_id"))


@query("wave_summary", f"{UNIQUE} SELECT category, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info FROM uniq GROUP BY 1")
def wave_summary(spark, sf_dir):
    return report.severity_pivot(detect.corpus_unique(spark, sf_dir))


@query("sarif_results", f"{UNIQUE} SELECT file_path, line, category AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END AS level, count(*) AS n FROM uniq GROUP BY ALL")
def sarif_results(spark, sf_dir):
    return report.sarif_levels(detect.corpus_unique(spark, sf_dir))


@query("flagged_packages", f"{UNIQUE}, p AS (SELECT DISTINCT package_name FROM corpus) SELECT package_name, count(category) AS n_findings, max(severity) AS max_text, [{', '.join(map(q, V.SEVERITIES))}][max({RANK})] AS max_severity FROM p LEFT JOIN uniq USING (package_name) GROUP BY 1")
def flagged_packages(spark, sf_dir):
    """Left join of packages and findings; the maximum severity by text, as the reference's SQL takes it, and by rank."""
    unique = detect.corpus_unique(spark, sf_dir)
    return report.flagged_packages(corpus.files(spark, sf_dir).select("package_name").distinct(), unique)


# mutations


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.mutated(corpus.files(spark, sf_dir).where("content <> ''"))


@query("evasion_rate", f"WITH {duck.FILES}, {mutate.SQL} SELECT strategy, count(*) AS n, count(*) FILTER (evaded) AS n_evaded, round(count(*) FILTER (evaded) / count(*), 6) AS evasion_rate FROM evasion GROUP BY 1")
def evasion_rate(spark, sf_dir):
    return mutate.evasion_rate(_mutated(spark, sf_dir))


from auspex.plans import archived, binary_rules, campaign_stream, crossfile, hidden, packages, reviews, shared_infra, threats, versions  # noqa: E402, F401  they register their queries
