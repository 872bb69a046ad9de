"""Rules on facts that other tools extract: strings of binaries, browser extensions, memos of wallets, files of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V

#: Imports of process injection, the telling ones first.
STRONG_IMPORTS = ("QueueUserAPC", "VirtualAllocEx", "WriteProcessMemory", "DebugActiveProcessStop")
OTHER_IMPORTS = ("CreateProcessW", "FindResourceW", "LoadResource", "LockResource", "CreateNamedPipeA", "NtAllocateVirtualMemory", "NtProtectVirtualMemory", "NtQuerySystemInformation")
#: Class ids of browsers' elevation services.
ELEVATION = {"{708860E0-F641-4611-8895-7D867DD3675B}": "Chrome", "{576B31AF-6369-4B6B-8560-E4B203A97A8B}": "Edge", "{1FCBE96C-1697-43AF-9140-2897C7C69767}": "Brave"}
#: Signs of a loader from memory, the first of which is a known misspelling.
LOADER_SIGNS = ("LoadLibararyFail", "NtAllocVmErr", "memexec 0.2.0", "generate.dll", "generate.pdb", "generate::run", "memexec::", "memexec ")
#: Extensions and permissions.
KNOWN_EXTENSIONS = (("Google Docs Offline", "1.95.1"),)
RISKY_PERMISSIONS, RISKY_LEAST = ("nativeMessaging", "clipboardRead", "cookies", "declarativeNetRequest"), 3
MEMO_WALLETS = ("28PKnu7RzizxBzFPoLp69HLXp9bJL3JFtT2s5QzHsEA2", "BjVeAjPrSKFiingBn4vZvghsGj9KCE8AJVtbc9S8o8SC", "DSRUBTziADDHSik7WQvSMjvwCHFsbsThrbbjWMoJPUiW", "6YGcuyFRJKZtcaYCCFba9fScNUvPkGXodXE1mJiSzqDJ")
PREFERENCES_BYTES = (1024, 100_000)


def _found(strings: DataFrame, signs: tuple[str, ...]) -> DataFrame:
    """file_path, value, sign: the signs in each string of a file."""
    hits = F.array_compact(F.array(*(F.when(F.col("value").contains(s), F.lit(s)) for s in signs)))
    return strings.select("file_path", "value", F.explode(hits).alias("sign"))


def injection(strings: DataFrame) -> DataFrame:
    """file_path, n_strong, n_found, severity by imports and strings (file_path, value).

    Strong ones count as often as they occur, all by distinct value and sign.
    """
    hits = _found(strings, STRONG_IMPORTS + OTHER_IMPORTS)
    each = hits.groupBy("file_path").agg(F.count_if(F.col("sign").isin(*STRONG_IMPORTS)).alias("n_strong"), F.countDistinct("value", "sign").alias("n_found"))
    severity = F.when(F.col("n_strong") >= 3, "high").when((F.col("n_strong") >= 1) | (F.col("n_found") >= 3), "medium")
    return each.withColumn("severity", severity).where("severity IS NOT NULL")


def memory_loaders(strings: DataFrame) -> DataFrame:
    """file_path, n_signs, severity, confidence."""
    hits = _found(strings.withColumn("value", F.when(F.col("value") == "memexec", "memexec ").otherwise(F.col("value"))), LOADER_SIGNS)
    each = hits.groupBy("file_path").agg(F.countDistinct("sign").alias("n_signs"), F.bool_or(F.col("sign") == LOADER_SIGNS[0]).alias("typo"))
    return each.select("file_path", "n_signs", F.when(F.col("typo") | (F.col("n_signs") >= 2), "high").otherwise("medium").alias("severity"), F.when(F.col("typo"), 0.98).otherwise(0.7).alias("confidence"))


def elevation_services(strings: DataFrame) -> DataFrame:
    """file_path, browser: known class ids in strings of a file."""
    return _found(strings, tuple(ELEVATION)).select("file_path", X.lookup(F.col("sign"), ELEVATION, "").alias("browser")).distinct()


def extension_signals(preferences: DataFrame) -> DataFrame:
    """file_path, extension, signals, severity of each extension in ``doc`` (a variant) that has a signal."""
    listed = F.map_entries(F.try_variant_get("doc", "$.extensions.settings", "map<string,variant>"))
    each = preferences.select("file_path", F.explode(listed).alias("e")).select("file_path", F.col("e.key").alias("extension"), F.col("e.value").alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    foreign = ~F.coalesce(get("$.from_webstore", "boolean"), F.lit(True))
    aside = F.coalesce(get("$.location", "bigint") == 4, F.lit(False))
    flagged = F.coalesce(get("$.creation_flags", "bigint") == 38, F.lit(False))
    known = X.any_of((F.coalesce(get("$.name", "string"), F.lit("")) == n) & (F.coalesce(get("$.version", "string"), F.lit("")) == v) for n, v in KNOWN_EXTENSIONS)
    permissions = F.coalesce(get("$.permissions", "array<string>"), F.array().cast("array<string>"))
    risky = F.size(F.filter(permissions, lambda p: X.contains_any(p, RISKY_PERMISSIONS))) >= RISKY_LEAST
    unverified = foreign & get("$.content_verification", "variant").isNull()
    tests = {"from_webstore:false": foreign, "location:4": aside, "creation_flags:38": flagged, "known_extension": known, "risky_permissions": risky, "no_content_verification": unverified}
    severity = F.when(known | (foreign & aside & flagged), "critical").when(foreign & (aside | flagged) | risky, "medium").otherwise("info")
    signals = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return each.select("file_path", "extension", F.array_join(signals, ",").alias("signals"), severity.alias("severity")).where("signals <> ''")


def odd_preferences(files: DataFrame) -> DataFrame:
    """Files (file_path, bytes) of a protected preferences' name whose size is unusual."""
    least, most = PREFERENCES_BYTES
    return files.where(F.col("file_path").endswith("Secure Preferences") & ((F.col("bytes") < least) | (F.col("bytes") > most)))


def memo_severity(memo: Column, wallet: Column) -> Column:
    """Of a memo: info if it isn't JSON, null if it has no address; ``memo`` is a text."""
    doc = F.try_parse_json(memo)
    server, link = F.try_variant_get(doc, "$.c2server", "string").isNotNull(), F.try_variant_get(doc, "$.link", "string").isNotNull()
    return F.when(doc.isNull(), "info").when(wallet.isin(*MEMO_WALLETS) & (server | link), "high").when(server, "medium").when(link, "info")
