"""Rules on features of binaries, as tables of nested arrays, and on listings of hosts.

``features`` holds file_path, sections (array of name and entropy), strings and imports
(arrays of texts), pdb_path, and cargo_paths (array).  All is one projection over
these columns: no row a string, no shuffle.

Defined cases: null arrays and texts are empty, null elements are passed over; rows
that come twice give two rows; a file without a sign gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X

#: A section above so many bits a byte is encrypted or packed.
PACKED_ENTROPY = 7.5
#: Constants of the generator, words of its imports, words of a key by place and of rounds.
SHIFT_CONSTANTS = ("6c62272e", "2c1b3c6d", "297a2d39")
SHIFT_IMPORTS = ("shift", "rotate", "bit")
PLACE_WORDS = ("idx", "index", "position"), ("xor", "shift")
ROUND_WORDS = ("round", "cascade"), ("decode", "decrypt")
#: Build paths, users and names that are known, and the crate of loaders.
BUILD_PATHS = ("N:\\work\\chrome_current", "DumpBrowserSecrets", "ext_sideloader", "vscode_env_history")
BUILD_USERS = ("Administrator", "davidioasd")
BUILD_NAMES = ("jucku", "myextension", "DllExtractChromiumSecrets", "generate.pdb")
BUILD_CRATE, CRATE_NAME = "neon-", "neon framework"
#: Folders and files that are left on a host.
HOST_FOLDERS = ("SsWolTaQA", "_node_x86", "_node_x64", ".config/system/.data/.nodejs", "work/chrome_current", "DumpBrowserSecrets")
HOST_FILES = ("w.node", "c_x64.node", "f_ex86.node", "data", "index_ia32.node", "index_x64.node", "m", "BqJuCBQutS.exe", "led-win32", "i.js", "init.json")
#: Ranks of severities, in which info is the greatest.
RANKS = {"low": 0, "medium": 1, "high": 2, "critical": 3, "info": 4}


def _texts(name: str) -> Column:
    return F.coalesce(F.array_compact(F.col(name)), F.array().cast("array<string>"))


def _both(words: tuple[tuple[str, ...], tuple[str, ...]]) -> Column:
    """Whether one string has a word of either list."""
    return F.exists(F.transform(_texts("strings"), F.lower), lambda s: X.contains_any(s, words[0]) & X.contains_any(s, words[1]))


def shift_obfuscation(features: DataFrame) -> DataFrame:
    """file_path, signals (joined by commas), n_sections and max_entropy of packed sections, severity, confidence: signs of strings hidden by a shifting generator."""
    packed = F.filter(F.coalesce(F.col("sections"), F.array().cast("array<struct<name:string,entropy:double>>")), lambda s: F.coalesce((s["entropy"] > PACKED_ENTROPY) & ~F.isnan(s["entropy"]), F.lit(False)))
    tests = {
        "high_entropy": F.size(packed) > 0,
        "xorshift_constants": F.exists(_texts("strings"), lambda s: X.contains_any(F.lower(s), SHIFT_CONSTANTS)),
        "shift_operations": F.exists(_texts("imports"), lambda s: X.contains_any(F.lower(s), SHIFT_IMPORTS)),
        "position_dependent_key": _both(PLACE_WORDS),
        "multi_round_decode": _both(ROUND_WORDS),
    }
    signals = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    found = features.select("file_path", signals.alias("s"), F.size(packed).cast("long").alias("n_sections"), F.array_max(F.transform(packed, lambda p: p["entropy"])).alias("max_entropy")).where(F.size("s") > 0)
    n = F.size("s")
    return found.select("file_path", F.array_join("s", ",").alias("signals"), "n_sections", "max_entropy", F.when(n >= 2, "high").otherwise("medium").alias("severity"), F.when(n >= 3, 0.95).when(n == 2, 0.85).otherwise(0.6).alias("confidence"))


def _signs(text: Column, kind: str, words: tuple[str, ...], rule: str, to: str) -> list[Column]:
    """For each word that ``text`` has a sign: kind, word, and what it does to the severity (``set`` it, or ``raise`` it if that is of a lower rank)."""
    sign = lambda w: F.struct(F.lit(kind).alias("kind"), F.lit(w).alias("word"), F.lit(rule).alias("rule"), F.lit(to).alias("to"))
    return [F.when(text.contains(w), sign(w)) for w in words]


def build_metadata(features: DataFrame) -> DataFrame:
    """file_path, indicators (joined by commas, in order of their kinds), severity, confidence: traces of the machine that built a binary.

    Signs come in order (debug path, crates, strings) and each acts on the severity so far,
    which begins at info.  Info has the greatest rank, so raising changes nothing there, and
    a crate takes a high one back to info.
    """
    pdb = F.coalesce(F.col("pdb_path"), F.lit(""))
    debug = _signs(pdb, "pdb_path", BUILD_PATHS, "set", "high") + _signs(pdb, "pdb_path", BUILD_NAMES, "raise", "medium") + _signs(pdb, "username", BUILD_USERS, "set", "high")
    crate = F.struct(F.lit("cargo").alias("kind"), F.lit(CRATE_NAME).alias("word"), F.lit("raise").alias("rule"), F.lit("info").alias("to"))
    crates = F.transform(F.filter(_texts("cargo_paths"), lambda p: p.contains(BUILD_CRATE)), lambda _: crate)
    of_string = lambda s: F.array_compact(F.array(*_signs(s, "string", BUILD_PATHS, "set", "high"), *_signs(s, "username", BUILD_USERS, "raise", "medium"), *_signs(s, "string", BUILD_NAMES, "raise", "medium")))
    found = features.select("file_path", F.concat(F.array_compact(F.array(*debug)), crates, F.flatten(F.transform(_texts("strings"), of_string))).alias("s")).where(F.size("s") > 0)
    rank = lambda name: X.lookup(name, RANKS, -1)
    severity = F.aggregate("s", F.lit("info"), lambda now, e: F.when((e["rule"] == "set") | (rank(now) < rank(e["to"])), e["to"]).otherwise(now))
    words = F.transform(F.array_sort(F.array_distinct(F.transform("s", lambda e: F.struct(e["kind"], e["word"])))), lambda e: e["word"])
    told = found.select("file_path", F.array_join(words, ",").alias("indicators"), severity.alias("severity"))
    return told.withColumn("confidence", F.when(F.col("severity") == "high", 0.9).when(F.col("severity") == "medium", 0.7).otherwise(0.5))


def host_artifacts(listing: DataFrame) -> DataFrame:
    """path, artifact, sign, severity of known folders and files in ``listing`` (path, is_dir).

    A folder whose name holds a known one is high if a known file lies right in it, else medium; a
    known file (or folder of that name) is high.  Only paths of known files are shuffled, by their
    folder.  Rows that come twice are one; a null ``is_dir`` is a file.
    """
    path = F.rtrim(F.col("path"), F.lit("/"))
    rows = listing.where("path IS NOT NULL").select(path.alias("path"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.substring_index(path, "/", -1).alias("name"))
    payloads = rows.where(F.col("name").isin(*HOST_FILES)).distinct()
    signs = F.array_compact(F.array(*(F.when(F.col("name").contains(f), F.lit(f)) for f in HOST_FOLDERS)))
    folders = rows.where(F.col("is_dir") & (F.size(signs) > 0)).distinct().select("path", F.explode(signs).alias("sign"))
    holding = payloads.select(F.expr("substring(path, 1, length(path) - length(name) - 1)").alias("path")).distinct().withColumn("holds", F.lit(True))
    of_folders = folders.join(holding, "path", "left").select("path", F.lit("folder").alias("artifact"), "sign", F.when(F.col("holds"), "high").otherwise("medium").alias("severity"))
    return of_folders.unionByName(payloads.select("path", F.lit("file").alias("artifact"), F.col("name").alias("sign"), F.lit("high").alias("severity")).distinct())
