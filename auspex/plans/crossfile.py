"""Queries over modules: the symbol table, importers by symbol, flows across files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.operators import modules
from auspex.plans.duck import q
from auspex.plans.registered import query, table
from auspex.sources.shared import materialize

#: A statement for each form, {n} the document's number, and the rows that it makes: form, local, original, module.
PLANTS: list[tuple[str, list[tuple[str, str | None, str | None, str | None]]]] = [
    ("import { a{n}, b{n} as c{n} } from './m'", [("import_named", "a{n}", "a{n}", "./m"), ("import_named", "c{n}", "b{n}", "./m")]),
    ("import {\n  a{n},\n  b as\n    c,\n} from '../lib/m'", [("import_named", "a{n}", "a{n}", "../lib/m"), ("import_named", "c", "b", "../lib/m")]),
    ('import d{n} from "./m{n}"', [("import_default", "d{n}", None, "./m{n}")]),
    ("import * as n{n} from './m'", [("import_namespace", "n{n}", None, "./m")]),
    ("import './side{n}'", [("import_side_effect", None, None, "./side{n}")]),
    ("import type { T{n}, U as V } from './types'", [("import_type", "T{n}", "T{n}", "./types"), ("import_type", "V", "U", "./types")]),
    ("const later = import('./late{n}')", [("import_dynamic", None, None, "./late{n}")]),
    ("let r{n} = require( './m{n}' )", [("require", "r{n}", None, "./m{n}")]),
    ("var { x{n}, y: z{n} } = require('lib')", [("require_names", "x{n}", "x{n}", "lib"), ("require_names", "z{n}", "y", "lib")]),
    ("export { e{n}, f as g{n} }", [("export_named", "e{n}", "e{n}", None), ("export_named", "f", "g{n}", None)]),
    ("export { h{n} as i } from './m'", [("export_from", "i", "h{n}", "./m"), ("export_named", "h{n}", "i", None)]),
    ("export * from './all{n}'", [("export_star", None, None, "./all{n}")]),
    ("export type { T{n} }", [("export_type", "T{n}", "T{n}", None)]),
    ("export default async function d{n}() {}", [("export_default", "d{n}", "default", None)]),
    ("export default { a: {n} }", [("export_default", None, "default", None)]),
    ("export const k{n} = 1; export async function l{n}() {}", [("export_inline", "k{n}", "k{n}", None), ("export_inline", "l{n}", "l{n}", None)]),
    ("module.exports = w{n}", [("exports_whole", "w{n}", "default", None)]),
    ("module.exports.m{n} = 1", [("exports_member", "m{n}", "m{n}", None)]),
    ("exports.p{n} = 2", [("exports_assigned", "p{n}", "p{n}", None)]),
    ("imports are { a } from 'here', module exports = none", []),
]
#: What module_type is for each of PLANTS in a .js file and in a .ts file.
KINDS = {"es6": (0, 1, 2, 9, 10, 13, 14), "commonjs": (7, 16, 17), "typescript": (5, 12)}


def _numbered(text: str) -> str:
    return f"replace({q(text)}, '{{n}}', doc_id::VARCHAR)"


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of PLANTS after its text; every third is a .ts file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.col("doc_id").cast("string")
    plant = F.replace(F.element_at(F.array(*(F.lit(p) for p, _ in PLANTS)), (F.col("doc_id") % len(PLANTS) + 1).cast("int")), F.lit("{n}"), number)
    path = F.concat(F.lit("src/f"), number, F.when(F.col("doc_id") % 3 == 0, ".ts").otherwise(".js"))
    return docs.select(F.lit("app").alias("package_name"), path.alias("file_path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), plant).alias("content"))


_PATH = "'src/f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.ts' ELSE '.js' END"
_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {q(form)} AS form, {_numbered(local) if local else 'NULL'} AS local, {_numbered(original) if original else 'NULL'} AS original, {_numbered(module) if module else 'NULL'} AS module FROM documents WHERE doc_id % {len(PLANTS)} = {k}"
    for k, (_, rows) in enumerate(PLANTS)
    for form, local, original, module in rows
)


@query("module_symbols", f"SELECT 'app' AS package_name, {_PATH} AS file_path, form, local, original, module, form IN ('import_type', 'export_type') AS type_only, length(text) - length(replace(text, chr(10), '')) + 2 AS line FROM ({_ROWS}) JOIN (SELECT doc_id, coalesce(text, '') AS text FROM documents) USING (doc_id)")
def module_symbols(spark, sf_dir):
    return modules.symbols(planted_files(spark, sf_dir))


@query("module_types", f"SELECT 'app' AS package_name, {_PATH} AS file_path, CASE WHEN k IN {KINDS['typescript']} OR doc_id % 3 = 0 AND k IN {KINDS['es6']} THEN 'typescript' WHEN k IN {KINDS['es6']} THEN 'es6' WHEN k IN {KINDS['commonjs']} THEN 'commonjs' ELSE 'unknown' END AS module_type FROM (SELECT doc_id, doc_id % {len(PLANTS)} AS k FROM documents)")
def module_types(spark, sf_dir):
    return modules.module_types(planted_files(spark, sf_dir))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file that brings in the name of the one of half its number, in five ways of which one loses it; a cycle is 0, 1, 2, 5, 0.

    Names are sources in every seventh file, and given to a call in two of three.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, h = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 2).cast("string")
    ways = ["import { s{h} as s{k} } from './m{h}'", "const { s{h}: s{k} } = require('./m{h}')", "export { s{h} as s{k} } from './m{h}'", "import s{k} from './m{h}'", "import { s{h} } from './m{h}'"]
    way = F.when(F.col("doc_id") == 0, "import { s5 as s0 } from './m5'").otherwise(F.element_at(F.array(*map(F.lit, ways)), (F.col("doc_id") % 5 + 1).cast("int")))
    source = F.when(F.col("doc_id") % 14 == 0, "const s{k} = x => x.codePointAt(0) - 0xFE00;").when(F.col("doc_id") % 14 == 7, "const s{k} = r.headers['x-a'];").otherwise("")
    sink = F.when(F.col("doc_id") % 3 == 1, "eval(s{k})").when(F.col("doc_id") % 3 == 2, "child.exec(s{k})").otherwise("module.exports = s{k}")
    code = F.replace(F.replace(F.concat_ws("\n", way, source, sink), F.lit("{k}"), k), F.lit("{h}"), h)
    return docs.select(F.lit("app").alias("package_name"), F.concat(F.lit("src/m"), k, F.lit(".js")).alias("file_path"), F.concat("text", F.lit("\n"), code).alias("content"))


_AT = "length(text) - length(replace(text, chr(10), ''))"
_LINKS = """l AS (SELECT doc_id AS k, doc_id // 2 AS h, doc_id % 5 AS way FROM documents WHERE doc_id > 0 AND doc_id // 2 IN (SELECT doc_id FROM documents)),
e AS (SELECT h AS a, 's' || h AS there, k AS b, 's' || k AS here FROM l WHERE way < 3 OR way = 3 AND h % 3 = 0
  UNION ALL SELECT h, 's' || h, k, 's' || h FROM l WHERE way = 4 UNION ALL SELECT 5, 's5', doc_id, 's0' FROM documents WHERE doc_id = 0 AND 5 IN (SELECT doc_id FROM documents))"""


@query("symbol_importers", f"WITH {_LINKS} SELECT 'app' AS package_name, 'src/m' || a || '.js' AS from_file, there AS symbol, 'src/m' || b || '.js' AS to_file, here AS local, CASE WHEN b = 0 OR b % 5 IN (0, 4) THEN 'import_named' WHEN b % 5 = 1 THEN 'require_names' WHEN b % 5 = 2 THEN 'export_from' ELSE 'import_default' END AS form FROM e WHERE a % 7 = 0")
def symbol_importers(spark, sf_dir):
    """Who brings in a name that is a source."""
    files = linked_files(spark, sf_dir)
    edges = modules.symbol_edges(materialize(modules.symbols(files), "symbols"), files)
    return modules.importers(edges, modules.defined_sources(files).withColumnRenamed("file_path", "from_file"))


_FLOWS = f"""WITH RECURSIVE {_LINKS},
r AS (SELECT doc_id AS src, doc_id AS k, 's' || doc_id AS symbol, 0 AS hops, ['src/m' || doc_id || '.js'] AS path FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT src, b, here, hops + 1, list_append(path, 'src/m' || b || '.js') FROM r JOIN e ON r.k = e.a AND r.symbol = e.there WHERE NOT list_contains(path, 'src/m' || b || '.js')),
shortest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY src, k, symbol ORDER BY hops, path) = 1),
d AS (SELECT doc_id, {_AT} AS ends FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT 'app' AS package_name, 'src/m' || src || '.js' AS source_file, 's' || src AS source_symbol, CASE WHEN src % 14 = 0 THEN 'stego_decoder' ELSE 'http_header' END AS source_type, a.ends + 3 AS source_line,
  path[-1] AS sink_file, symbol AS sink_symbol, CASE WHEN k % 3 = 1 THEN 'eval' ELSE 'child_process' END AS sink_kind, b.ends + 4 AS sink_line, hops, array_to_string(path, '>') AS path,
  least(1, 0.5 + CASE WHEN hops > 0 THEN 0.2 ELSE 0 END + CASE WHEN hops > 1 THEN 0.1 ELSE 0 END + CASE WHEN src % 14 = 0 THEN 0.3 ELSE 0.2 END)::DOUBLE AS confidence, CASE WHEN hops > 0 OR k % 3 = 2 THEN 'critical' ELSE 'high' END AS severity
FROM shortest JOIN d AS a ON a.doc_id = src JOIN d AS b ON b.doc_id = k WHERE k % 3 > 0 AND symbol = 's' || k"""


@query("cross_file_flows", _FLOWS)
def cross_file_flows(spark, sf_dir):
    files = linked_files(spark, sf_dir)
    edges = materialize(modules.symbol_edges(materialize(modules.symbols(files), "symbols"), files), "symbol-edges")
    found = modules.flows(edges, modules.defined_sources(files), modules.call_sinks(files))
    return found.withColumn("path", F.array_join("path", ">"))


@query("split_payloads", f"SELECT * FROM ({_FLOWS}) WHERE hops > 0")
def split_payloads(spark, sf_dir):
    """Names that one file defines and another runs."""
    return modules.split_payloads(linked_files(spark, sf_dir)).withColumn("path", F.array_join("path", ">"))
