"""Queries on gates, variants of texts, borne-out findings and summaries of scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from auspex.operators import detect, enrich, findings, gates, mutate, report, scoring, summaries, variants
from auspex.plans import catalog
from auspex.plans.catalog import duck
from auspex.plans.registered import QUERIES, query, table
from auspex.sources import corpus

# The SQL states the same parts as regular expressions of its own.
_DOCUMENT = r"regexp_matches(low, '\.(mdx?|txt|rst)$')"
_BUILT = r"(regexp_matches(low, '/(dist|build|bin|out|gyp|lib)/|\.(min|bundle|umd)\.|\.[mc]js$|-(dist|prod)\.js$') OR bytes > 500000)"
_BUNDLED = r"(regexp_matches(low, '/(dist|build|bin)/|\.(min|bundle|umd)\.|\.[mc]js$') OR regexp_matches(content, '/\* (webpack|rollup|parcel)|/\*! For license information|__webpack_require__|__ROLLUP__'))"
_MINIFIED = r"""(regexp_matches(file_path, '/(dist|build|lib|bin|out|bundle|compiled|generated|\.next|\.nuxt|\.output|umd|esm|cjs)/|\.(min|bundle|umd|esm|cjs|webpack|rollup|babel|swc)\.') OR regexp_matches(low, 'webpack|rollup|babel|swc|esbuild|vite|parcel|browserify|gulp|grunt')
  OR bytes > 0 AND (bytes // len(lines) > 200 OR bytes > 10000 AND len(lines) < bytes // 500 OR regexp_matches(content, 'webpackJsonp|__webpack_require__|webpackChunk|rollupChunk|__rollup__|babelHelpers|esbuild|parcelRequire|browserify')))"""


@query("file_gates", f"WITH {duck.PREPARED} SELECT package_name, file_path, {_BUNDLED} AS is_bundled, {_MINIFIED} AS is_minified, {_DOCUMENT} AS is_documentation, file_class = 'test' AS is_test, bytes > 500000 AS is_large, bytes > 1000000 AS is_very_large, {_BUILT} AS likely_built FROM ready WHERE content <> ''")
def file_gates(spark, sf_dir):
    return gates.with_gates(corpus.files(spark, sf_dir).where("content <> ''"))


@query(
    "gated_findings",
    f"""{duck.FINDINGS}, gate AS (SELECT package_name, file_path, NOT {_DOCUMENT} AND file_class <> 'test' AS is_source, {_BUILT} AS built FROM ready)
SELECT found.* FROM found JOIN gate USING (package_name, file_path) WHERE CASE category WHEN 'invisible_character' THEN is_source AND (NOT built OR severity = 'critical') WHEN 'homoglyph' THEN is_source
  WHEN 'stego_pattern' THEN is_source AND NOT built WHEN 'stegano_payload' THEN is_source AND NOT built WHEN 'pipe_delimiter_stego' THEN is_source AND NOT built ELSE true END""",
)
def gated_findings(spark, sf_dir):
    return gates.gated(detect.corpus_findings(spark, sf_dir), gates.with_gates(corpus.files(spark, sf_dir)))


@query("serious_findings", f"{catalog.UNIQUE} SELECT category, count(*) AS n FROM uniq WHERE severity IN ('high', 'critical') GROUP BY 1")
def serious_findings(spark, sf_dir):
    return gates.at_least(detect.corpus_unique(spark, sf_dir), "high").groupBy("category").agg(F.count("*").alias("n"))


# variants

_CHARS = "list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1)"
_LINES = "list_transform(range(1, len(lines) + 1), lambda i: lines[i] || chr(10)"
_NOISE = "['// TODO: fix this later', '/* deprecated */', 'var _unused = null;', 'const __DEV__ = false;', 'function _helper() { return 0; }']"
_VARIANTS = rf"""t AS (SELECT item_id, text, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines FROM (SELECT *, string_split(text, chr(10)) AS parts FROM benchmark WHERE text <> '')),
v AS (SELECT item_id, 'invisible' AS variant, array_to_string({_CHARS} || CASE WHEN i % 10 = 1 THEN chr([8203, 8204, 8205, 65024, 917760][(i // 10) % 5 + 1]) ELSE '' END), '') AS content FROM t
UNION ALL SELECT item_id, 'look_alikes', translate(text, 'aeopcxABEHIKMNOPTXYZ', 'аеорсхΑΒΕΗΙΚΜΝΟΡΤΧΥΖ') FROM t
UNION ALL SELECT item_id, 'bidi', chr(8234) || text || chr(8236) FROM t
UNION ALL SELECT item_id, 'selectors', array_to_string(list_transform(range(1, strlen(text) + 1), lambda k: chr(65024 + ('0x' || substr(hex(encode(text)), 2 * k - 1, 2))::INT)), '') FROM t
UNION ALL SELECT item_id, 'noise', array_to_string({_LINES} || CASE WHEN i % 5 = 1 THEN {_NOISE}[(i // 5) % 5 + 1] || chr(10) ELSE '' END), '') FROM t
UNION ALL SELECT item_id, 'names', replace(replace(replace(replace(replace(text, 'config', '_0x1a2b'), 'data', '_0x2c3d'), 'value', '_0x3e4f'), 'result', '_0x5g6h'), 'temp', '_0x7i8j') FROM t
UNION ALL SELECT item_id, 'decoder_names', regexp_replace(text, '\bdecoder\b', 'd3c0d3r', 'g') FROM t
UNION ALL SELECT item_id, 'encodings', replace(replace(replace(replace(replace(text, 'from(''base64'')', 'from(''hex'')'), 'from("base64")', 'from("hex")'), 'atob(', 'hexDecode('), 'btoa(', 'hexEncode('), 'Buffer.from', 'Buffer.hexFrom') FROM t
UNION ALL SELECT item_id, 'turned', text FROM t)"""


@query("text_variants", f"WITH {_VARIANTS} SELECT item_id, variant, length(content)::BIGINT AS n_chars, md5(content) AS digest FROM v")
def text_variants(spark, sf_dir):
    """Every variant of each benchmark text, changed at every place."""
    made = variants.variants(table(spark, sf_dir, "benchmark"), "item_id", "text", rate=1.0)
    return made.select("item_id", "variant", F.length("content").cast("long").alias("n_chars"), F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query(
    "evasion_levels",
    f"""WITH {duck.FILES}, {mutate.SQL}, r AS (SELECT strategy, count(*) AS n, count(*) FILTER (evaded) AS n_evaded, round(count(*) FILTER (evaded) / count(*), 6) AS evasion_rate FROM evasion GROUP BY 1)
SELECT *, CASE WHEN n_evaded = n THEN 'critical' WHEN evasion_rate >= 0.75 THEN 'high' WHEN evasion_rate >= 0.5 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN evasion_rate >= 0.5 THEN 'critical' WHEN evasion_rate >= 0.3 THEN 'high' WHEN evasion_rate >= 0.1 THEN 'medium' ELSE 'low' END AS risk_level FROM r""",
)
def evasion_levels(spark, sf_dir):
    return variants.evasion_levels(QUERIES["evasion_rate"](spark, sf_dir))


# findings that other layers bear out

_EXFIL = "keys of a credential record"


@query(
    "enriched_findings",
    f"""{catalog.UNIQUE}, c AS (SELECT u.*, doc_id, description = '{_EXFIL}' AS exfil FROM uniq AS u JOIN corpus USING (package_name, file_path)),
e AS (SELECT *, concat_ws(', ', CASE WHEN doc_id % 7 = 0 OR exfil THEN 'filesystem artifact found' END, CASE WHEN exfil THEN 'Chrome extension correlation' END, CASE WHEN doc_id % 5 = 0 THEN 'binary payload correlation' END, CASE WHEN doc_id % 15 = 0 THEN 'JS+binary multi-layer detection' END) AS correlations FROM c)
SELECT package_name, file_path, line, col, category, description, correlations, round(CASE WHEN correlations = '' THEN confidence WHEN confidence IS NULL THEN 0.75 WHEN confidence < 0.9 THEN least(confidence + 0.1, 0.95) ELSE confidence END, 6) AS confidence FROM e""",
)
def enriched_findings(spark, sf_dir):
    """Layers by the documents' numbers, as the tables have no host."""
    files, k = corpus.files(spark, sf_dir), F.col("doc_id")
    kinds = F.array_compact(F.array(F.when(k % 7 == 0, "filesystem"), F.when(k % 5 == 0, "binary"), F.when(k % 3 == 0, "js"), F.when(k % 11 == 0, "chrome")))
    context = files.select("file_path", F.explode(kinds).alias("kind")).select("file_path", "kind", F.lit("high").alias("severity"), F.lit("extension with permissions").alias("context"))
    found = enrich.enriched(detect.corpus_unique(spark, sf_dir), context, F.col("description") == _EXFIL)
    return found.select("package_name", "file_path", "line", "col", "category", "description", "correlations", F.round("confidence", 6).alias("confidence"))


# summaries


@query("report_counts", f"{catalog.UNIQUE} SELECT 'severity' AS kind, severity AS name, count(*) AS n FROM uniq GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM uniq GROUP BY 2")
def report_counts(spark, sf_dir):
    return summaries.counts_by(detect.corpus_unique(spark, sf_dir), "severity", "category")


_WAVES = "SELECT CASE WHEN grouping(wave) = 1 THEN 'total' ELSE wave END AS wave, count(*) AS n_scanned, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (malicious) AS n_malicious, round(100.0 * count(*) FILTER (flagged) / count(*), 6) AS flag_rate, round(100.0 * count(*) FILTER (malicious) / count(*), 6) AS malicious_rate FROM (SELECT 'wave' || (o_custkey % 10) AS wave, o_orderstatus = 'F' AS flagged, o_totalprice > 200000 AS malicious FROM orders) GROUP BY ROLLUP (wave)"


@query("wave_rates", _WAVES)
def wave_rates(spark, sf_dir):
    """Orders as scans of waves."""
    wave = F.concat(F.lit("wave"), (F.col("o_custkey") % 10).cast("string"))
    return summaries.wave_rates(table(spark, sf_dir, "orders").select(wave.alias("wave"), (F.col("o_orderstatus") == "F").alias("flagged"), (F.col("o_totalprice") > 200000).alias("malicious")))


@query("wave_markdown", f"SELECT wave, '| ' || wave || ' | ' || n_scanned || ' | ' || n_flagged || ' | ' || n_malicious || ' | ' || printf('%.1f', flag_rate) || '% | ' || printf('%.1f', malicious_rate) || '% |' AS markdown FROM ({_WAVES})")
def wave_markdown(spark, sf_dir):
    return summaries.markdown_rows(wave_rates(spark, sf_dir))


@query("risk_actions", "SELECT c_custkey, CASE WHEN s >= 100 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' WHEN s >= 10 THEN 'LOW' ELSE 'MINIMAL' END AS level, CASE WHEN s >= 100 THEN 'IMMEDIATE_INVESTIGATION' WHEN s >= 50 THEN 'PRIORITY_REVIEW' WHEN s >= 25 THEN 'REVIEW' WHEN s >= 10 THEN 'MONITOR' ELSE 'IGNORE' END AS action, s >= 10 AS flagged FROM (SELECT c_custkey, c_custkey % 130 AS s FROM customer)")
def risk_actions(spark, sf_dir):
    score = F.col("c_custkey") % 130
    return table(spark, sf_dir, "customer").select("c_custkey", summaries.risk_level(score).alias("level"), summaries.risk_action(score).alias("action"), summaries.should_flag(score).alias("flagged"))


@query("yara_rules", """SELECT rule, 'rule ' || rule || chr(10) || '{' || chr(10) || '    strings:' || chr(10) || string_agg('        $s' || n_nationkey || ' = "' || n_name || '"', chr(10) ORDER BY 's' || n_nationkey) || chr(10) || '    condition:' || chr(10) || '        any of them' || chr(10) || '}' AS source FROM (SELECT replace(r_name, ' ', '_') AS rule, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY rule""")
def yara_rules(spark, sf_dir):
    """Nations as the strings of their region's rule."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("rule"))
    named = table(spark, sf_dir, "nation").join(regions, "n_regionkey")
    return summaries.yara_rules(named.select("rule", F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("identifier"), F.col("n_name").alias("value")))


@query("code_point_dedup", f"{duck.FINDINGS} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY package_name, file_path, line, col, code_point ORDER BY category, severity, description, confidence DESC NULLS LAST) AS rn FROM found) WHERE rn = 1")
def code_point_dedup(spark, sf_dir):
    return findings.first_per_code_point(detect.corpus_findings(spark, sf_dir))


@query("severity_counts", f"{catalog.UNIQUE} SELECT category, severity, count(*) AS n, count(DISTINCT package_name || ' ' || file_path) AS n_files FROM uniq GROUP BY ALL")
def severity_counts(spark, sf_dir):
    return findings.severity_counts(detect.corpus_unique(spark, sf_dir), ["category", "severity"])


@query("sarif_rules", f"{catalog.UNIQUE} SELECT category AS rule_id, CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 'error' WHEN bool_or(severity = 'medium') THEN 'warning' WHEN bool_or(severity = 'low') THEN 'note' ELSE 'none' END AS default_level, min(description) AS short_description, count(*) AS n FROM uniq GROUP BY 1")
def sarif_rules(spark, sf_dir):
    return report.sarif_rules(detect.corpus_unique(spark, sf_dir))


@query("review_stages", "SELECT stage, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 < 2.5 THEN 'triage' WHEN c_custkey % 7 >= 5.25 THEN 'analysis' WHEN c_custkey % 11 BETWEEN 4 AND 7 THEN 'deep_dive' ELSE 'analysis' END AS stage FROM customer) GROUP BY 1")
def review_stages(spark, sf_dir):
    """Where the reviews end; customers' numbers stand for scores and verdicts."""
    key = F.col("c_custkey")
    stage = scoring.llm_stage(key % 11, (key % 10) / 10, (key % 7) / 7)
    return table(spark, sf_dir, "customer").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query("scan_rates", "SELECT wave, done, remaining, round(done / minutes, 6) AS per_minute, round(remaining * 60 / (done / minutes), 2) AS eta_seconds FROM (SELECT user_id % 10 AS wave, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type <> 'purchase') AS remaining, (epoch(max(ts)) - epoch(min(ts))) / 60 AS minutes FROM events GROUP BY 1)")
def scan_rates(spark, sf_dir):
    """Rate and remaining time of each wave; purchases stand for finished packages."""
    seconds = F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))
    waves = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("wave")).agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") != "purchase").alias("remaining"), (seconds / 60_000_000).alias("minutes"))
    rate = report.scan_rate(F.col("done"), F.col("remaining"), F.col("minutes"))
    return waves.select("wave", "done", "remaining", F.round(rate["per_minute"], 6).alias("per_minute"), F.round(rate["eta_seconds"], 2).alias("eta_seconds"))
