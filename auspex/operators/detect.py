"""Detectors: each gives findings, rows of ``FINDING``.

The corpus is read once (``signed``): of each file the literals that a rule cannot do
without are looked up first, and of the lines of files that have some, those rules
are tried whose literals the file has.  Lines with a sign, few of all, are kept
with their signs as bits; every rule reads them only.  Lines are looked at by code
point only where a class of suspicious ones matches.  Rules on neighbouring lines use
range frames over the lines that carry a sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V
from auspex.operators import contents
from auspex.operators.findings import deduplicated
from auspex.operators.rows import KEY, finding, rows_of
from auspex.operators.rules import DECODER_SIGNS, LINE_RULES, literals
from auspex.sources import corpus
from auspex.sources.shared import materialize, once, spread

INVISIBLE = X.char_class(V.INVISIBLE_RANGES)
SUSPECT = X.char_class(V.INVISIBLE_RANGES, [c for c, *_ in V.BIDI + V.CONFUSABLES])
VS = X.char_class(V.VARIATION_SELECTORS)
MAX_BYTES = 100_000
#: The same classes behind a test that most characters fail at once.
FAST_INVISIBLE, FAST_SUSPECT = rf"(?=[^\x00-\x{{200A}}]){INVISIBLE}", rf"(?=[^\x00-\x{{390}}]){SUSPECT}"
#: Of files of ASCII alone, which have no suspicious code point.
ASCII = "octet_length(content) = char_length(content)"


def prepared(files: DataFrame) -> DataFrame:
    """``files`` with the class of the path and flags that rules ask for."""
    low = F.lower("file_path")
    kind = X.path_class(F.col("file_path"))
    return (
        files.withColumn("bytes", F.octet_length("content"))
        .withColumn("file_class", kind)
        .withColumn("is_i18n", X.is_i18n(F.col("file_path"), F.col("content")))
        .withColumn("has_decoder", X.contains_any(F.col("content"), V.DECODERS))
        .withColumn("n_invisible", F.when(F.expr(ASCII), 0).otherwise(F.regexp_count("content", F.lit(FAST_INVISIBLE))))
        .withColumn("has_invisible", F.col("n_invisible") > 0)
        .withColumn("is_python", low.endswith(".py"))
        .withColumn("plain_source", ~kind.isin("test", "build"))
    )


def _exploded(df: DataFrame, tests: list[tuple[Column, Column]]) -> DataFrame:
    """A row for each test that holds: the single-pass evaluation of many rules.

    The outer form infers no filter on the array: such a filter would evaluate all
    tests a second time, and as a constraint of a union it is costly to optimize.
    """
    hits = F.array_compact(F.array(*(F.when(test, row) for test, row in tests)))
    return rows_of(df.withColumn("f", F.explode_outer(hits)).where("f IS NOT NULL"))


def line_findings(signs: DataFrame) -> DataFrame:
    lines = signs.where("line > 0")
    test = lambda k, r: has(f"rule{k}") & (F.col(r.where) if r.where else F.lit(True)) & ~X.contains_any(F.col("text"), r.unless)
    return _exploded(lines, [(test(k, r), finding(F.col("line"), r.category, r.severity, r.description, r.confidence)) for k, r in enumerate(LINE_RULES)])


def marks(signs: DataFrame) -> DataFrame:
    """Each suspicious code point: line, col, cp, its neighbours and the file's flags."""
    flags = ["bytes", "is_i18n", "has_decoder", "n_invisible"]
    chars = signs.where(has("suspect")).select(*KEY, *flags, "line", "text").withColumn("chars", F.split("text", ""))
    every = [*V.INVISIBLE_RANGES, *((c, c) for c, *_ in V.BIDI + V.CONFUSABLES)]
    points = F.transform("chars", lambda c, i: F.struct((i + 1).alias("col"), F.ascii(c).alias("cp")))
    found = chars.withColumn("mark", F.explode(F.filter(points, lambda p: X.in_ranges(p["cp"], every))))
    near = lambda k: F.ascii(F.get("chars", F.col("mark.col") - 1 + k))
    return found.select(*KEY, *flags, "line", "text", F.col("mark.col").alias("col"), F.col("mark.cp").alias("cp"), near(-1).alias("prev"), near(1).alias("next"))


def char_findings(signs: DataFrame) -> DataFrame:
    """Bidirectional controls, invisible characters, tags and mixed-script identifiers."""
    cp, low = F.col("cp"), F.lower("file_path")
    bidi = {c: s for c, _, s in V.BIDI}
    at = {"col": F.col("col"), "code_point": cp}
    emoji = F.coalesce(X.in_ranges(F.col("prev"), V.EMOJI_BEFORE), F.lit(False)) | F.coalesce(X.in_ranges(F.col("next"), V.EMOJI_AFTER), F.lit(False))
    json = low.endswith(".json")
    skipped = low.endswith(".d.ts") | X.contains_any(low, V.LOCALE_DATA_DIRS) | (json & F.col("is_i18n") & ~F.col("has_decoder")) | (F.col("is_i18n") & F.col("has_decoder") & (F.col("n_invisible") > 10))
    excused = (cp == 0xFFFD) | (cp.between(0xFE00, 0xFE0F) & (F.col("is_i18n") | json | emoji)) | (emoji & ~cp.between(0xFE00, 0xFE0F)) | (cp.isin(0x200C, 0x200D) & F.col("is_i18n"))
    invisible = X.in_ranges(cp, V.INVISIBLE_RANGES) & ~skipped & ~excused
    severity = F.when(X.in_ranges(cp, V.CRITICAL_RANGES), "critical").when(cp.isin(*bidi, *V.ZERO_WIDTH), "high").otherwise("medium")
    before, behind = F.substring("text", F.lit(1), F.col("col") - 1), F.substring("text", F.col("col"), F.length("text"))
    word = r"[\p{L}\p{N}_]*"
    identifier = F.concat(F.regexp_extract(before, f"({word})$", 1), F.regexp_extract(behind, f"^({word})", 1))
    mixed = (F.length(identifier) > 1) & identifier.rlike("[A-Za-z]") & identifier.rlike(X.char_class([(0x370, 0x3FF), (0x400, 0x4FF)]))
    comment = F.trim("text").rlike(r"^(//|\*|/\*|#)")
    similar = X.lookup(cp, {c: s for c, _, _, s in V.CONFUSABLES}, 0.0)
    homoglyph = cp.isin(*(c for c, *_ in V.CONFUSABLES)) & (F.col("bytes") <= MAX_BYTES) & ~F.col("is_i18n") & ~comment & mixed
    return _exploded(
        marks(signs),
        [
            (cp.isin(*bidi) & (F.col("bytes") <= MAX_BYTES), finding(F.col("line"), "bidirectional_override", X.lookup(cp, bidi, "medium"), "bidirectional control", **at)),
            (invisible, finding(F.col("line"), "invisible_character", severity, "invisible character", **at)),
            (X.in_ranges(cp, V.TAG_RANGE), finding(F.col("line"), "unicode_tag", "medium", "tag character", **at)),
            (homoglyph, finding(F.col("line"), "homoglyph", F.when(similar >= 0.99, "critical").when(similar >= 0.95, "high").otherwise("medium"), "mixed-script identifier", **at)),
        ],
    )


def _quoted(keys: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"{q}{k}{q}" for k in keys for q in "\"'")


def _signals(items: tuple[str, ...]) -> Column:
    """How many of the literals the line has."""
    return X.count_of(F.col("text").contains(i) for i in items)


SOCKET_GROUPS = (V.SOCKET_TRANSPORT, V.SOCKET_ENDPOINT, V.SOCKET_TUNNEL)
#: Signs that file rules look for in lines.
FILE_SIGNS = {
    "run": f"{VS}{{16,}}",
    "pipe": f"\\|{VS}{{4,}}",
    "blob": f"{V.HEX_BLOB}|{V.BASE64_BLOB}",
    "decrypt": V.DECRYPT,
    "exec": V.EXEC,
    "http": V.HTTP_CLIENT,
    "header": V.HEADER_ACCESS,
    "header_crypto": V.HEADER_CRYPTO,
    "header_exec": V.HEADER_EXEC,
    "wallet": literals(V.C2_WALLETS),
    "address": literals(V.C2_ADDRESSES),
    "signatures": V.SIGNATURES,
    "five_minutes": V.FIVE_MINUTES,
    "keys": literals(_quoted(V.HIGH_EXFIL_KEYS + V.MEDIUM_EXFIL_KEYS)),
    "ci_check": V.SANDBOX_CI,
    "vm_check": V.SANDBOX_VM,
    **{f"socket{k}": literals(g) for k, g in enumerate(SOCKET_GROUPS)},
    **{f"obf{k}": p for k, (p, _) in enumerate(V.OBFUSCATION)},
    **{f"dec{k}": p for k, (p, _) in enumerate(DECODER_SIGNS)},
}


#: Signs that rules on neighbouring lines look for.
SIGNS = {"locale": V.LOCALE, "exit0": V.EXIT_ZERO, "ci": V.CI_CHECK, "delay": "|".join(V.DELAYS), "sandbox": f"{V.SANDBOX_CI}|{V.SANDBOX_VM}", "exit": V.SANDBOX_EXIT, "from_char": r"String\.fromCharCode", "char_code": r"charCodeAt.*\^|\^.*charCodeAt"}

_CI, _VM, _DELAYED = ("process.env.", "isci", "is_ci"), ("cpus", "totalmem", "freemem"), ("settimeout", "setinterval", "900000", "172800000")
_DECRYPTED, _RUN = ("createdecipher", ".decrypt", "atob", "buffer.from"), ("eval", "function", "runin", "exec", "child_process")
#: Lower-case literals one of which a line has where it has the sign.
GATES = {
    "rule0": ("codepointat",), "rule1": ("settimeout",), "rule2": ("setinterval",), "rule3": ("900000",), "rule4": ("172800000",), "rule5": ("isci",),
    "rule6": V.BROWSER_KILLS, "rule7": V.TYPO_FINGERPRINTS, "rule8": V.FORCED_MARKERS, "rule9": V.EXFIL_HEADERS, "rule10": ("resolvetxt", "dns.resolve"), "rule11": ("github.com",), "rule12": ("memo",), "rule13": ("buffer.from",), "rule14": ("fetch",),
    "decrypt": _DECRYPTED, "exec": _RUN, "http": ("http.get", "https.get", "fetch", "axios.", "request"), "header": ("headers", "getheader"), "header_crypto": ("createdecipher", "decrypt", "decipher."), "header_exec": (*_RUN, "spawn"),
    "wallet": V.C2_WALLETS, "address": V.C2_ADDRESSES, "signatures": ("getsignaturesforaddress",), "five_minutes": ("setinterval", "poll_interval"), "keys": _quoted(V.HIGH_EXFIL_KEYS + V.MEDIUM_EXFIL_KEYS), "ci_check": _CI, "vm_check": _VM,
    **{f"socket{k}": g for k, g in enumerate(SOCKET_GROUPS)},
    "obf1": ("^",), "obf2": ("fromcharcode", "fromcodepoint"), "obf3": ("atob",), "obf4": ("[]",), "obf5": ("^", "atob"), "dec0": ("codepointat",), "dec1": (".filter",), "dec2": ("fromcodepoint",),
    "locale": ("ru-ru", "europe/moscow", "navigator.language"), "exit0": ("process.exit",), "ci": ("259200000", "process.env."), "delay": _DELAYED, "sandbox": (*_CI, *_VM), "exit": ("exit",), "from_char": ("string.fromcharcode",), "char_code": ("charcodeat",),
}
#: Signs without such literals, and those one of which a file has where they have an effect.
BESIDE = {"blob": ("decrypt",), "obf0": ("obf1", "obf2", "obf3", "obf4", "obf5")}
#: Every sign of a line, in the order of its bits.
PATTERNS = {"suspect": FAST_SUSPECT, **{f"rule{k}": r.pattern for k, r in enumerate(LINE_RULES)}, **FILE_SIGNS, **SIGNS}
BIT = {name: 1 << k for k, name in enumerate(PATTERNS)}
SIGNED = (*KEY, "bytes", "file_class", "is_i18n", "has_decoder", "n_invisible", "has_invisible", "is_python", "plain_source", "spaces", "joiners")


def has(sign: str) -> Column:
    return F.col("signs").bitwiseAND(F.lit(BIT[sign])) != 0


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literals() -> str:
    """SQL: the literals that a file has (``_low``: its lower-cased content), with the signs that need them as bits."""
    bits: dict[str, int] = {}
    for sign, needed in GATES.items():
        for literal in needed:
            bits[literal.lower()] = bits.get(literal.lower(), 0) | BIT[sign]
    table = ", ".join(f"named_struct('literal', {_text(x)}, 'bits', {b}L)" for x, b in bits.items())
    return f"filter(array({table}), g -> contains(_low, g.literal))"


#: SQL: signs that need no literal.
_MARKED = f"CASE WHEN {ASCII} THEN 0L WHEN content RLIKE {_text(FAST_SUSPECT)} THEN {BIT['suspect']}L ELSE 0L END | CASE WHEN n_invisible > 0 THEN {BIT['run'] | BIT['pipe']}L ELSE 0L END"


def _line_mask() -> str:
    """SQL: the signs of ``r.t``, as bits; ``r.m`` are those whose literals it has."""
    tests = []
    for name, pattern in PATTERNS.items():
        also = LINE_RULES[int(name[4:])].also if name.startswith("rule") else None
        tests.append(f"CASE WHEN (r.m & {BIT[name]}L) != 0L{f' AND contains(r.t, {_text(also)})' if also else ''} AND r.t RLIKE {_text(pattern)} THEN {BIT[name]}L ELSE 0L END")
    return " | ".join(tests)


def signed(files: DataFrame) -> DataFrame:
    """Lines with a sign: the file's flags (SIGNED), line, text and ``signs`` as bits; a file with invisible characters has a line 0 as well,
    one that a rule on whole contents may find a line -1 with its content.

    The lines are tried inside of one array expression, so only those with a sign become rows.
    """
    count = lambda cp: F.when(F.col("has_invisible"), F.regexp_count("content", F.lit(chr(cp)))).otherwise(0)
    ready = prepared(spread(files)).withColumn("_low", F.lower("content")).withColumns({"_found": F.expr(_literals()), "_marked": F.expr(_MARKED), "_worth": contents.worth(F.col("content"))})
    beside = " | ".join(f"CASE WHEN exists(_found, g -> (g.bits & {sum(BIT[x] for x in needed)}L) != 0L) THEN {BIT[name]}L ELSE 0L END" for name, needed in BESIDE.items())
    some = (F.size("_found") > 0) | (F.col("_marked") != 0)
    ready = ready.withColumns({"_any": F.expr(f"_marked | {beside}"), "spaces": count(0x200B), "joiners": count(0x200C), "_lines": F.when(some, X.lines_of(F.col("content"))), "_low_lines": F.when(some, X.lines_of(F.col("_low")))})
    kind = "array<struct<line:bigint,text:string,signs:bigint>>"
    may = "aggregate(_found, _any, (m, g) -> CASE WHEN contains(get(_low_lines, i), g.literal) THEN m | g.bits ELSE m END)"
    worth = f"filter(transform(_lines, (t, i) -> named_struct('line', CAST(i + 1 AS BIGINT), 't', t, 'm', {may})), r -> r.m != 0L)"
    lines = f"filter(transform({worth}, r -> named_struct('line', r.line, 'text', r.t, 'signs', {_line_mask()})), x -> x.signs != 0L)"
    zero = "CASE WHEN has_invisible THEN array(named_struct('line', 0L, 'text', '', 'signs', 0L)) END"
    whole = "CASE WHEN _worth THEN array(named_struct('line', -1L, 'text', content, 'signs', 0L)) END"
    rows = F.expr(f"concat({', '.join(f'coalesce({x}, CAST(array() AS {kind}))' for x in (lines, zero, whole))})")
    # the outer form infers no filter on the array, which would try all lines a second time
    return ready.select(*SIGNED, F.explode_outer(rows).alias("f")).where("f IS NOT NULL").select(*SIGNED, "f.line", "f.text", "f.signs")


def file_signs(signs: DataFrame) -> DataFrame:
    """For each file with a sign: the first line of each sign (null for none) and counts of signals."""
    lines = signs.where("line > 0").where(F.col("signs").bitwiseAND(F.lit(sum(BIT[k] for k in FILE_SIGNS))) != 0)
    counts = {"n_high": _signals(_quoted(V.HIGH_EXFIL_KEYS)), "n_keys": _signals(_quoted(V.HIGH_EXFIL_KEYS + V.MEDIUM_EXFIL_KEYS)), "n_ci_if": (has("ci_check") & X.contains_any(F.col("text"), ("if", "!", "||", "&&"))).cast("int"), **{f"g{k}": _signals(g) for k, g in enumerate(SOCKET_GROUPS)}}
    return lines.groupBy(*KEY).agg(F.bool_or("plain_source").alias("plain_source"), F.max("n_invisible").alias("n_invisible"), *(F.min(F.when(has(k), F.col("line"))).alias(k) for k in FILE_SIGNS), *(F.sum(c).alias(k) for k, c in counts.items()))


def whole_file_findings(signs: DataFrame) -> DataFrame:
    """Rules on counts over a file's content."""
    one = F.lit(1)
    ratio = F.col("spaces") / F.greatest("joiners", F.lit(1))
    return _exploded(
        signs.where("line = 0").drop("line"),
        [
            (F.col("is_i18n") & F.col("has_decoder") & (F.col("n_invisible") > 10), finding(one, "invisible_character", "critical", "invisible characters with a decoder in a localisation file", 0.85)),
            ((F.col("spaces") >= 50) & (F.col("joiners") >= 50) & ratio.between(0.5, 2.0), finding(one, "stegano_payload", "critical", "binary code of zero-width characters", 0.90)),
        ],
    )


def file_findings(signs: DataFrame) -> DataFrame:
    """Rules on signs in several lines of a file."""
    has = lambda k: F.col(k).isNotNull()
    total = lambda name, table: sum((F.when(has(f"{name}{k}"), w).otherwise(0.0) for k, (_, w) in enumerate(table)), F.lit(0.0))
    wide = file_signs(signs).withColumns({
        "obf": F.round(F.least(total("obf", V.OBFUSCATION), F.lit(1.0)), 6),
        "n_obf": X.count_of(has(f"obf{k}") for k in range(len(V.OBFUSCATION))),
        "stego": F.round(F.least(F.least("n_invisible", F.lit(50)) / 50 * 0.4 + total("dec", DECODER_SIGNS) * 0.6, F.lit(1.0)), 6),
        "n_groups": X.count_of(F.col(f"g{k}") > 0 for k in range(3)),
    })
    level = lambda c, high, top: F.when(F.col(c) >= top, "critical").when(F.col(c) >= high, "high").otherwise("medium")
    source, at = F.col("plain_source"), F.col
    return _exploded(
        wide,
        [
            (has("run"), finding(at("run"), "stegano_payload", "critical", "hidden payload in variation selectors")),
            (has("pipe"), finding(at("pipe"), "pipe_delimiter_stego", "high", "payload behind a pipe")),
            ((F.col("n_invisible") > 0) & (F.col("stego") >= 0.7), finding(F.lit(1), "stego_pattern", level("stego", 0.8, 0.9), "invisible characters and their decoder", F.col("stego"))),
            (F.col("n_obf") >= 2, finding(F.lit(1), "stego_pattern", level("obf", 0.6, 0.8), "obfuscated decoder", F.col("obf"))),
            (source & has("blob") & has("decrypt") & has("exec"), finding(at("blob"), "encrypted_payload", "high", "encrypted payload with dynamic execution")),
            (source & has("http") & has("header") & has("header_crypto") & has("header_exec"), finding(at("header"), "header_c2", "critical", "commands in HTTP headers with dynamic execution")),
            (source & has("wallet"), finding(at("wallet"), "blockchain_c2", "critical", "Known C2 wallet")),
            (source & has("address"), finding(at("address"), "blockchain_c2", "critical", "Known C2 address")),
            (source & has("signatures") & has("five_minutes"), finding(at("signatures"), "blockchain_c2", "high", "polling of transaction signatures")),
            (F.col("n_keys") >= 3, finding(at("keys"), "unknown", F.when(F.col("n_high") > 0, "high").otherwise("medium"), "keys of a credential record")),
            ((F.col("n_groups") >= 2) | ((F.col("n_groups") == 1) & (F.col("g0") + F.col("g1") + F.col("g2") >= 3)), finding(F.coalesce("socket0", "socket1", "socket2"), "unknown", F.when(F.col("n_groups") == 3, "high").when(F.col("n_groups") == 2, "medium").otherwise("info"), "socket tunnel")),
            (source & has("ci_check") & has("vm_check"), finding(F.least("ci_check", "vm_check"), "time_delay_sandbox_evasion", "critical", "CI and virtual machine checks", 0.92)),
            (source & has("ci_check") & ~has("vm_check") & (F.col("n_ci_if") > 0), finding(at("ci_check"), "time_delay_sandbox_evasion", "medium", "condition on CI", 0.60)),
            (source & has("vm_check") & ~has("ci_check"), finding(at("vm_check"), "time_delay_sandbox_evasion", "medium", "virtual machine check", 0.55)),
        ],
    )


def window_findings(signs: DataFrame) -> DataFrame:
    """Rules on a line and those near it: range frames over the lines with a sign."""
    lines = signs.where("plain_source AND line > 0").where(F.col("signs").bitwiseAND(F.lit(sum(BIT[k] for k in SIGNS))) != 0)
    low = {"few_cpus": has("vm_check") & F.col("text").contains("cpus()") & X.contains_any(F.col("text"), ("< 2", "<= 1", "<2")), "little_memory": has("vm_check") & F.col("text").contains("totalmem()") & X.contains_any(F.col("text"), ("2 * 1024 * 1024 * 1024", "2147483648", "2GB"))}
    flagged = lines.select(*KEY, "line", *(has(k).alias(k) for k in (*SIGNS, "ci_check", "vm_check")), *(c.alias(k) for k, c in low.items()))
    in_file = Win.partitionBy(*KEY)
    by_line = in_file.orderBy("line")
    within = lambda sign, a, b: F.coalesce(F.bool_or(sign).over(by_line.rangeBetween(a, b)), F.lit(False))
    near = flagged.withColumns({"exit_follows": within("exit0", 1, 5), "ci_before": within("ci", -10, -1), "sandbox_near": within("sandbox", -15, 15), "xor_near": within("char_code", 0, 4), "both": F.bool_or("ci_check").over(in_file) & F.bool_or("vm_check").over(in_file)})
    return _exploded(
        near,
        [
            (F.col("locale") & F.col("exit_follows"), finding(F.col("line"), "locale_geofencing", "critical", "exit for a locale")),
            (F.col("delay") & F.col("ci_before"), finding(F.col("line"), "time_delay_sandbox_evasion", "critical", "delay after a CI check")),
            (F.col("exit") & F.col("sandbox_near"), finding(F.col("line"), "time_delay_sandbox_evasion", "critical", "exit near a sandbox check", 0.90)),
            (F.col("few_cpus") & ~F.col("both"), finding(F.col("line"), "time_delay_sandbox_evasion", "high", "check for few processors", 0.82)),
            (F.col("little_memory") & ~F.col("both"), finding(F.col("line"), "time_delay_sandbox_evasion", "high", "check for little memory", 0.82)),
            (F.col("from_char") & F.col("xor_near"), finding(F.col("line"), "encrypted_payload", "medium", "XOR decoding", 0.60)),
        ],
    )


def all_findings(files: DataFrame) -> DataFrame:
    """What every detector finds, duplicates included, from one reading of ``files``."""
    signs = materialize(signed(files), "signs")
    return char_findings(signs).unionByName(whole_file_findings(signs)).unionByName(line_findings(signs)).unionByName(file_findings(signs)).unionByName(window_findings(signs)).unionByName(contents.content_findings(signs.where("line = -1")))


def corpus_findings(spark, sf_dir: str) -> DataFrame:
    """The findings of the corpus view, a table that reports, scores and correlations read; it is written once a session for each state of the documents."""
    return once(spark, "findings", f"{sf_dir}/documents.parquet", lambda: all_findings(corpus.files(spark, sf_dir)))


def corpus_unique(spark, sf_dir: str) -> DataFrame:
    """``corpus_findings`` without duplicates, a table too."""
    return once(spark, "unique-findings", f"{sf_dir}/documents.parquet", lambda: deduplicated(corpus_findings(spark, sf_dir)))
