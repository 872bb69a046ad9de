"""The symbol table of modules, importers by symbol, and flows of tainted symbols across files.

A file's statements are found by regular expressions in the JVM; a statement's line is
the number of line ends in the text that lies before it.  Flows are labelled
reachability: a state is (source, file, symbol), an import moves it to the importing
file and to the name that the symbol has there, and a state that was reached before is
dropped, so cycles end.  Each step is one equi-join of the last step's states with the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.operators.graph import resolved
from auspex.operators.positions import statements
from auspex.sources.shared import discard, materialize

_NAME, _LIST, _FROM = r"([\w$]+)", r"\{([^}]*)\}", r"['\"]([^'\"]+)['\"]"
#: The forms of imports and exports.  Form: pattern, the groups of names and module (0: none).
FORMS: dict[str, tuple[str, int, int]] = {
    "import_named": (rf"import\s*{_LIST}\s*from\s*{_FROM}", 1, 2),
    "import_default": (rf"import\s+{_NAME}\s+from\s*{_FROM}", 1, 2),
    "import_namespace": (rf"import\s*\*\s*as\s+{_NAME}\s+from\s*{_FROM}", 1, 2),
    "import_side_effect": (rf"import\s*{_FROM}", 0, 1),
    "import_type": (rf"import\s+type\s+{_LIST}\s+from\s*{_FROM}", 1, 2),
    "import_dynamic": (rf"\bimport\s*\(\s*{_FROM}\s*\)", 0, 1),
    "require": (rf"(?:const|let|var)\s+{_NAME}\s*=\s*require\s*\(\s*{_FROM}\s*\)", 1, 2),
    "require_names": (rf"(?:const|let|var)\s*{_LIST}\s*=\s*require\s*\(\s*{_FROM}\s*\)", 1, 2),
    "export_named": (rf"export\s*{_LIST}", 1, 0),
    "export_from": (rf"export\s*{_LIST}\s*from\s*{_FROM}", 1, 2),
    "export_star": (rf"export\s*\*\s*from\s*{_FROM}", 0, 1),
    "export_type": (rf"export\s+type\s+{_LIST}", 1, 0),
    "export_default": (r"export\s+default\b(?:\s+(?:async\s+)?(?:function\*?|class)\b)?\s*([\w$]*)", 1, 0),
    "export_inline": (rf"export\s+(?:const|let|var|function|class|async\s+function)\s+{_NAME}", 1, 0),
    "exports_whole": (rf"module\.exports\s*=\s*{_NAME}", 1, 0),
    "exports_member": (rf"module\.exports\s*\.\s*{_NAME}", 1, 0),
    "exports_assigned": (rf"(?<!module\.)\bexports\s*\.\s*{_NAME}\s*=", 1, 0),
}
#: Forms with a list of names; a pair is written with ``as``, or with a colon in a require.
LISTS = ("import_named", "import_type", "require_names", "export_named", "export_from", "export_type")
DEFAULTS = ("export_default", "exports_whole")
TYPE_ONLY = ("import_type", "export_type")
#: Forms that bring no name into the file.
NAMELESS = ("import_side_effect", "import_dynamic", "export_star")


def symbols(files: DataFrame) -> DataFrame:
    """package_name, file_path, form, local, original, module, type_only, line of each name that a file imports or exports.

    ``local`` is the name in the file; ``original`` the one that it has where it comes
    from (imports) or goes by (exports), null where a form doesn't tell.  A list's empty
    places are no names.
    """
    met = statements(files, {form: (p, "import" if form.startswith("import") else "require" if form.startswith("require") else "export") for form, (p, _, _) in FORMS.items()})
    form = F.col("name")
    of = lambda k: F.create_map(*(F.lit(x) for f, groups in FORMS.items() for x in (f, groups[k])))[form]
    group = lambda k: F.when(of(k) > 0, F.call_function("regexp_extract", F.col("found"), F.col("pattern"), of(k)))
    rows = met.select("package_name", "file_path", form.alias("form"), group(1).alias("_names"), group(2).alias("module"), form.isin(*TYPE_ONLY).alias("type_only"), "line")
    listed = F.filter(F.transform(F.split("_names", ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = rows.withColumn("_name", F.explode(F.when(F.col("form").isin(*LISTS), listed).otherwise(F.array("_names"))))
    colon = F.col("form") == "require_names"
    pair = F.when(colon, F.split("_name", r"\s*:\s*", 2)).when(F.col("form").isin(*LISTS), F.split("_name", " as ", 2)).otherwise(F.array("_name"))
    left, right = F.trim(F.get(pair, 0)), F.trim(F.coalesce(F.get(pair, 1), F.get(pair, 0)))
    # an import names first what it is there, an export what it is here
    outward = F.col("form").isin("export_named", "export_type")
    none, defaults, whole = F.lit(None).cast("string"), F.col("form").isin(*DEFAULTS), F.col("form").isin("import_default", "import_namespace", "require")
    local = F.when(F.col("form").isin(*NAMELESS), none).when(defaults, F.nullif("_name", F.lit(""))).when(outward, left).otherwise(right)
    original = F.when(F.col("form").isin(*NAMELESS) | whole, none).when(defaults, "default").when(outward, right).otherwise(left)
    return rows.select("package_name", "file_path", "form", local.alias("local"), original.alias("original"), "module", "type_only", "line")


def module_types(files: DataFrame) -> DataFrame:
    """package_name, file_path, module_type: typescript, mixed, es6, commonjs or unknown."""
    has = lambda *forms: F.expr("false") if not forms else F.greatest(*(F.coalesce(F.rlike("content", F.lit(FORMS[f][0])), F.lit(False)) for f in (*forms, forms[0])))
    es6 = has("import_named", "import_default", "export_named", "export_default")
    commonjs, types = has("require", "exports_whole", "exports_member"), has("import_type", "export_type")
    script = F.coalesce(F.col("file_path").rlike(r"\.tsx?$"), F.lit(False))
    kind = F.when(types | (script & es6), "typescript").when(es6 & commonjs, "mixed").when(es6, "es6").when(commonjs, "commonjs").otherwise("unknown")
    return files.select("package_name", "file_path", kind.alias("module_type"))


def symbol_edges(table: DataFrame, files: DataFrame) -> DataFrame:
    """package_name, from_file, symbol, to_file, local, form: a name that to_file brings in from from_file, what it is there (symbol) and here (local).

    ``symbol`` is null for ``export *``, which brings in every name as it is.  An import that
    doesn't tell the original name goes by its own, and means the file's default export
    too.  A name that from_file exports under another is met by the one that it has inside.
    """
    brought = table.where(F.col("module").startswith(".") & F.col("form").isin("import_named", "import_default", "import_namespace", "import_type", "require", "require_names", "export_from", "export_star"))
    found = resolved(brought.select("package_name", F.col("file_path").alias("from_file"), "module", "form").distinct(), files)
    keys = ["package_name", "file_path", "module", "form"]
    met = brought.join(found.withColumnRenamed("from_file", "file_path"), keys).select(
        "package_name", F.col("to_file").alias("from_file"), F.coalesce("original", "local").alias("symbol"), F.col("file_path").alias("to_file"), "local", "form"
    )
    unnamed = met.where(F.col("form").isin("import_default", "require") & (F.col("symbol") == F.col("local"))).withColumn("symbol", F.lit("default"))
    renamed = table.where(F.col("module").isNull() & (F.col("local") != F.col("original"))).select("package_name", F.col("file_path").alias("from_file"), F.col("original").alias("symbol"), F.col("local").alias("_inside")).distinct()
    inside = met.unionByName(unnamed).join(renamed, ["package_name", "from_file", "symbol"]).withColumn("symbol", F.col("_inside")).select(*met.columns)
    return met.unionByName(inside).distinct()


def importers(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``edges`` that bring in a symbol of ``wanted`` (package_name, from_file, symbol)."""
    return edges.join(wanted.select("package_name", "from_file", "symbol").distinct(), ["package_name", "from_file", "symbol"], "left_semi")


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Every flow of a source's symbol to a sink: package_name, source_file, source_symbol, source_type, source_line, sink_file, sink_symbol, sink_kind, sink_line, hops, path, confidence, severity.

    ``sources`` (package_name, file_path, symbol, source_type, line) and ``sinks``
    (package_name, file_path, symbol, kind, line) are met by file and name.  A path
    is the files from source to sink on a shortest way, of several the least.
    """
    origin = ["package_name", "source_file", "source_symbol", "source_type", "source_line"]
    begin = sources.distinct().select(
        "package_name", F.col("file_path").alias("source_file"), F.col("symbol").alias("source_symbol"), "source_type", F.col("line").alias("source_line"),
        F.col("file_path").alias("file"), "symbol", F.lit(0).alias("hops"), F.array("file_path").alias("path"),
    )
    state = [*origin, "file", "symbol"]
    steps = [materialize(begin, "flow-states")]
    there = edges.select("package_name", F.col("from_file").alias("file"), F.col("symbol").alias("_there"), "to_file", "local")
    while not steps[-1].isEmpty():
        named = steps[-1].join(there.where("_there is not null").withColumnRenamed("_there", "symbol"), ["package_name", "file", "symbol"])
        starred = steps[-1].join(there.where("_there is null").drop("_there"), ["package_name", "file"]).withColumn("local", F.col("symbol"))
        moved = named.unionByName(starred).select(*origin, F.col("to_file").alias("file"), F.col("local").alias("symbol"), F.concat("path", F.array("to_file")).alias("path"))
        moved = moved.groupBy(*state).agg(F.min("path").alias("path"))
        met = edges.sparkSession.read.schema(steps[0].schema).parquet(*(t.table_path for t in steps))
        new = moved.join(met.select(*state), state, "left_anti").withColumn("hops", F.lit(len(steps)))
        steps.append(materialize(new.select(*begin.columns), "flow-states"))
    reached = edges.sparkSession.read.schema(steps[0].schema).parquet(*(t.table_path for t in steps))
    ends = sinks.select("package_name", F.col("file_path").alias("file"), "symbol", F.col("kind").alias("sink_kind"), F.col("line").alias("sink_line")).distinct()
    hit = reached.join(ends, ["package_name", "file", "symbol"])
    hit = hit.withColumn("confidence", confidence(F.col("hops"), F.col("source_type"), F.col("sink_kind"))).withColumn("severity", severity(F.col("hops"), F.col("sink_kind")))
    out = materialize(hit.select(*origin, F.col("file").alias("sink_file"), F.col("symbol").alias("sink_symbol"), "sink_kind", "sink_line", "hops", "path", "confidence", "severity"), "flows")
    discard(*steps)
    return out


#: What a kind of source adds to the confidence if it is executed, and kinds of execution.
ADDED = {"stego_decoder": 0.3, "encrypted_payload": 0.25, "http_header": 0.2, "crypto_output": 0.2}
EXECUTION = ("eval", "function_constructor", "child_process", "vm_run")
CRITICAL_KINDS = ("child_process", "vm_run", "process_spawn")


def confidence(hops: Column, source_type: Column, kind: Column) -> Column:
    """0.5; 0.2 more if the flow leaves its file, 0.1 more for several files, and by the source if it is executed; at most 1."""
    added = F.lit(0.0)
    for name, more in ADDED.items():
        added = F.when((source_type == name) & kind.isin(*EXECUTION), more).otherwise(added)
    return F.least(F.round(F.lit(0.5) + F.when(hops >= 1, 0.2).otherwise(0.0) + F.when(hops > 1, 0.1).otherwise(0.0) + added, 2), F.lit(1.0))


def severity(hops: Column, kind: Column) -> Column:
    """Critical across files; in one file by the kind of sink."""
    return F.when((hops >= 1) | kind.isin(*CRITICAL_KINDS), "critical").otherwise("high")


#: Calls that execute or send what they are given, by kind, with a literal that they have.
SINK_CALLS = {
    "eval": (r"\beval", "eval"),
    "function_constructor": (r"\bnew\s+Function", "Function"),
    "child_process": (r"\b(?:exec|execSync)", "exec"),
    "vm_run": (r"\brunIn(?:This|New)?Context", "runIn"),
    "process_spawn": (r"\b(?:spawn|spawnSync)", "spawn"),
    "network_request": (r"\bfetch", "fetch"),
}


def call_sinks(files: DataFrame) -> DataFrame:
    """package_name, file_path, symbol, kind, line: the name that a call of SINK_CALLS is given first."""
    met = statements(files, {kind: (rf"{call}\s*\(\s*(?:await\s+)?{_NAME}", sign) for kind, (call, sign) in SINK_CALLS.items()})
    return met.select("package_name", "file_path", F.call_function("regexp_extract", F.col("found"), F.col("pattern"), F.lit(1)).alias("symbol"), F.col("name").alias("kind"), "line")


#: Definitions, and signs in their bodies that make what they give a source, the first that fits.
DEFINITION = rf"(?:\bfunction\s*\*?|\bconst|\blet|\bvar)\s+{_NAME}"
SOURCE_SIGNS = {
    "stego_decoder": r"(?i)codePointAt[\s\S]*0x(?:FE0|E01)|0x(?:FE0|E01)[\s\S]*codePointAt",
    "crypto_output": r"createDecipher(?:iv)?\s*\(|subtle\s*\.\s*decrypt\s*\(",
    "http_header": r"\.headers\s*(?:\[|\.get\s*\()",
    "encrypted_payload": r"['\"`][A-Za-z0-9+/]{64,}={0,2}['\"`]",
}


def defined_sources(files: DataFrame) -> DataFrame:
    """package_name, file_path, symbol, source_type, line: definitions whose text, up to the next definition, has a sign of SOURCE_SIGNS."""
    kind = F.lit(None).cast("string")
    for name, sign in reversed(SOURCE_SIGNS.items()):
        kind = F.when(F.col("after").rlike(sign), name).otherwise(kind)
    rows = statements(files, {"definition": (DEFINITION, None)}).select("package_name", "file_path", F.regexp_extract("found", DEFINITION, 1).alias("symbol"), kind.alias("source_type"), "line")
    return rows.where("source_type is not null")


def split_payloads(files: DataFrame) -> DataFrame:
    """``flows`` of all sources to all sinks of ``files`` (package_name, file_path, content) that cross files: payloads that one file holds and another runs."""
    table = materialize(symbols(files), "symbols")
    edges = materialize(symbol_edges(table, files), "symbol-edges")
    return flows(edges, defined_sources(files), call_sinks(files)).where("hops >= 1")
