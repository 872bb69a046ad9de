"""Queries on features of binaries and on listings of hosts.

The tables hold neither, so both are made up by the keys of parts and customers; the
SQL tells what must come out from these keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.operators import binaries
from auspex.plans.duck import q
from auspex.plans.registered import query, table

STRINGS = ("mul 0x6C62272E", "Index ^ XOR", "idx only", "cascade Decrypt", "round", "x", "by Administrator", "C:\\DumpBrowserSecrets\\a", "jucku", "hello", "generate.pdb", "position SHIFT", "297a2d39")
IMPORTS = ("RotateLeft", "kernel32", "Orbit", "open", "read", "BITBLT", "close")
PATHS = ("x.pdb", "N:\\work\\chrome_current\\a.pdb", "C:\\Users\\Administrator\\x.pdb", "/home/u/generate.pdb", "", "/Users/davidioasd/myextension.pdb")
FOLDERS = ("SsWolTaQA9", "app_node_x64", "src", "DumpBrowserSecrets", "lib", "xSsWolTaQA_node_x86")
FILES = ("w.node", "a.js", "data", "m", "data.txt", "init.json", "b")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary a part: two sections, two strings, an import; some without paths, crates or sections."""
    k = F.col("k")
    over = lambda n: F.floor(k / n)
    section = lambda name, n: F.struct(F.lit(name).alias("name"), (n % 40 / 5.0).alias("entropy"))
    return table(spark, sf_dir, "part").where("p_partkey IS NOT NULL").select(F.col("p_partkey").alias("k")).select(
        F.concat(F.lit("lib"), k.cast("string"), F.lit(".node")).alias("file_path"),
        F.when(k % 9 > 0, F.array(section(".text", k * 3), section(".data", over(5)))).alias("sections"),
        F.array(_pick(STRINGS, k), _pick(STRINGS, over(13))).alias("strings"),
        F.when(k % 8 > 0, F.array(_pick(IMPORTS, over(2)), F.lit(None).cast("string"))).alias("imports"),
        F.when(k % 7 > 1, _pick(PATHS, over(3))).alias("pdb_path"),
        F.when(k % 4 == 0, F.array(F.lit("/root/.cargo/neon-1.1.1/a"))).when(k % 4 == 1, F.array(F.lit("/root/.cargo/serde"))).alias("cargo_paths"),
    )


_list = lambda values: f"[{', '.join(map(q, values))}]"
_FEATURES = f"""f AS (SELECT k, 'lib' || k || '.node' AS file_path, CASE WHEN k % 9 > 0 THEN k * 3 % 40 / 5.0 END AS e1, CASE WHEN k % 9 > 0 THEN k // 5 % 40 / 5.0 END AS e2, {_list(STRINGS)} AS ss, ss[k % 13 + 1] AS s1, ss[k // 13 % 13 + 1] AS s2,
CASE WHEN k % 8 > 0 THEN {_list(IMPORTS)}[k // 2 % 7 + 1] ELSE '' END AS imp, CASE WHEN k % 7 > 1 THEN {_list(PATHS)}[k // 3 % 6 + 1] ELSE '' END AS pdb, k % 4 = 0 AS crate FROM (SELECT p_partkey AS k FROM part))"""
_STRONG, _USERS, _WEAK = (r"N:\work\chrome_current", "DumpBrowserSecrets", "ext_sideloader", "vscode_env_history"), ("Administrator", "davidioasd"), ("jucku", "myextension", "DllExtractChromiumSecrets", "generate.pdb")


@query(
    "shift_obfuscation",
    f"""WITH {_FEATURES}, t AS (SELECT file_path, (coalesce(e1 > 7.5, false))::INT + (coalesce(e2 > 7.5, false))::INT AS n_sections, CASE WHEN e1 > 7.5 AND e2 > 7.5 THEN greatest(e1, e2) WHEN e1 > 7.5 THEN e1 WHEN e2 > 7.5 THEN e2 END AS max_entropy,
s1 || s2 LIKE '%0x6C62272E%' OR s1 || s2 LIKE '%297a2d39%' AS b, imp IN ('RotateLeft', 'Orbit', 'BITBLT') AS c, s1 IN ('Index ^ XOR', 'position SHIFT') OR s2 IN ('Index ^ XOR', 'position SHIFT') AS d, s1 = 'cascade Decrypt' OR s2 = 'cascade Decrypt' AS e FROM f),
n AS (SELECT *, (n_sections > 0)::INT + b::INT + c::INT + d::INT + e::INT AS n FROM t)
SELECT file_path, concat_ws(',', CASE WHEN n_sections > 0 THEN 'high_entropy' END, CASE WHEN b THEN 'xorshift_constants' END, CASE WHEN c THEN 'shift_operations' END, CASE WHEN d THEN 'position_dependent_key' END, CASE WHEN e THEN 'multi_round_decode' END) AS signals, n_sections::BIGINT AS n_sections, max_entropy::DOUBLE AS max_entropy,
CASE WHEN n > 1 THEN 'high' ELSE 'medium' END AS severity, (CASE WHEN n > 2 THEN 0.95 WHEN n = 2 THEN 0.85 ELSE 0.6 END)::DOUBLE AS confidence FROM n WHERE n > 0""",
)
def shift_obfuscation(spark, sf_dir):
    return binaries.shift_obfuscation(features(spark, sf_dir))


@query(
    "build_metadata",
    f"""WITH {_FEATURES}, w AS (SELECT 'path' AS g, unnest({_list(_STRONG)}) AS word UNION ALL SELECT 'user', unnest({_list(_USERS)}) UNION ALL SELECT 'name', unnest({_list(_WEAK)})),
h AS (SELECT DISTINCT file_path, CASE WHEN g = 'user' THEN 'username' ELSE place END AS kind, word, g <> 'name' AND place = 'pdb_path' AS debug, g = 'path' AND place = 'string' AS strong
FROM (SELECT file_path, 'pdb_path' AS place, pdb AS t FROM f UNION ALL SELECT file_path, 'string', s1 FROM f UNION ALL SELECT file_path, 'string', s2 FROM f) JOIN w ON contains(t, word)
UNION ALL SELECT file_path, 'cargo', 'neon framework', false, false FROM f WHERE crate),
g AS (SELECT file_path, CASE WHEN bool_or(strong) OR bool_or(debug) AND NOT bool_or(kind = 'cargo') THEN 'high' ELSE 'info' END AS severity FROM h GROUP BY 1),
i AS (SELECT file_path, string_agg(word, ',' ORDER BY kind, word) AS indicators FROM (SELECT DISTINCT file_path, kind, word FROM h) GROUP BY 1)
SELECT file_path, indicators, severity, (CASE severity WHEN 'high' THEN 0.9 ELSE 0.5 END)::DOUBLE AS confidence FROM g JOIN i USING (file_path)""",
)
def build_metadata(spark, sf_dir):
    return binaries.build_metadata(features(spark, sf_dir))


@query(
    "host_artifacts",
    f"""WITH l AS (SELECT '/h' || (k // 30) || '/' || {_list(FOLDERS)}[k % 6 + 1] AS folder, {_list(FILES)}[k % 7 + 1] AS file FROM (SELECT c_custkey AS k FROM customer)),
p AS (SELECT folder, bool_or(file IN ('w.node', 'data', 'm', 'init.json')) AS holds FROM l GROUP BY 1)
SELECT folder AS path, 'folder' AS artifact, sign, CASE WHEN holds THEN 'high' ELSE 'medium' END AS severity FROM p JOIN (SELECT unnest(['SsWolTaQA', '_node_x86', '_node_x64', 'DumpBrowserSecrets']) AS sign) ON contains(folder, sign)
UNION ALL SELECT DISTINCT folder || '/' || file, 'file', file, 'high' FROM l WHERE file IN ('w.node', 'data', 'm', 'init.json')""",
)
def host_artifacts(spark, sf_dir):
    """A folder and a file in it for each customer, thirty a host."""
    k = F.col("c_custkey")
    folder = F.concat(F.lit("/h"), F.floor(k / 30).cast("string"), F.lit("/"), _pick(FOLDERS, k))
    entries = F.array(F.struct(folder.alias("path"), F.lit(True).alias("is_dir")), F.struct(F.concat(folder, F.lit("/"), _pick(FILES, k)).alias("path"), F.lit(False).alias("is_dir")))
    return binaries.host_artifacts(table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL").select(F.inline(entries)))
