"""Rules on a file's whole content: blockchain polling, exfiltration of the environment, hidden data in fields and comments.

``worth`` tells which files such a rule may find something in; only these carry
their content on to ``content_findings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V
from auspex.operators.rows import KEY, finding, rows_of

#: End points, signs of a library's own source and of a wallet's usual use.
RPC_ENDPOINTS = ("api.mainnet-beta.solana.com", "solana-api.projectserum.com", "rpc.ankr.com/solana", "api.devnet.solana.com", "api.testnet.solana.com")
SDK_SOURCE = (
    "async getSignaturesForAddress(", "async getTransaction(", "async getBalance(", "function getSignaturesForAddress(", "function getTransaction(", "class Connection", "class PublicKey", "class Transaction",
    "export class", "export function", "export {", "module.exports", "exports.", "constructor(rpcUrl", "constructor(props", "implements ConnectionInterface", "extends EventEmitter",
)
WALLET_USE = ("process.env.SOLANA_WALLET", "process.env.PUBLIC_KEY", "process.env.RPC_URL", "props.wallet", "wallet.address", "wallet.publicKey", "useWallet(", "useAnchorWallet", "useConnection", "connection.getAccountInfo", "connection.getBalance", "connection.getParsedAccountInfo")
#: Headers of monitoring tools, and what makes them suspicious, two of it at least.
TELEMETRY_HEADERS = ("X-Sentry-", "X-NewRelic-", "X-Datadog-", "X-Instana-", "X-Dynatrace-", "X-AppDynamics-", "X-Request-ID", "X-Correlation-ID", "X-Trace-ID", "X-Span-ID", "X-B3-", "X-Cloud-Trace-")
TELEMETRY_SIGNS = ("process.env", "Buffer.from", "btoa", "encodeURIComponent", "credentials", "password", "secret", "api_key", "apikey", "Authorization")
REQUESTS, ENCODERS, ADDRESSED = ("fetch(", "axios.", "http.post", "http.get"), ("Buffer.from", "btoa", "encodeURIComponent"), ("http://", "https://", ".post(", ".get(")
#: Characters that hide data, the fields of a manifest that they are looked for in, and the least number of them there and in a comment.
HIDING = (0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060)
FIELDS, FIELD_LEAST, COMMENT_LEAST = ("description", "keywords", "author", "repository", "name", "version"), 5, 3
HIDDEN = "[" + "".join(f"\\x{{{c:X}}}" for c in HIDING) + "]"
COMMENT = r"(//|/\*|\*).*?[A-Za-z0-9+/=\x{200B}\x{200C}\x{200D}\x{FEFF}]{50,}"


def worth(content: Column) -> Column:
    """Whether any rule of this module may find something."""
    has = content.contains
    polled = has("setInterval") & (has("300000") | has("getSignaturesForAddress"))
    chain = polled | (has("decodeCommand") & has("executeCommand(")) | X.contains_any(content, RPC_ENDPOINTS + V.C2_WALLETS)
    sent = has("process.env") & X.contains_any(content, ENCODERS) & (has("fetch") | X.contains_any(content, REQUESTS))
    return chain | sent | X.contains_any(content, TELEMETRY_HEADERS) | X.contains_any(content, map(chr, HIDING))


def _first(lines: Column, test) -> Column:
    """The least line that ``test`` holds for."""
    return F.get(F.filter(lines, lambda x: test(x["t"])), F.lit(0))["line"]


def _each(lines: Column, test, make) -> Column:
    return F.transform(F.filter(lines, lambda x: test(x["t"])), lambda x: make(x))


def _one(test: Column, row: Column) -> Column:
    return F.when(test, F.array(row)).otherwise(F.slice(F.array(row), 1, 0))


#: A line that any rule looks for has one of these.
NOTABLE = (*V.C2_WALLETS, *RPC_ENDPOINTS, *TELEMETRY_HEADERS, "getSignaturesForAddress", "getTransaction", "setInterval", "Buffer.from", "process.env", "fetch", "axios", *map(chr, HIDING))


def _flags(content: Column) -> dict[str, Column]:
    """What rules ask of the whole content, as columns, so that it is looked through once for each."""
    has = content.contains
    commands = has("decodeCommand") & has("executeCommand(")
    return {
        "subject": ~F.col("file_path").endswith(".d.ts") & ~X.contains_any(content, SDK_SOURCE),
        "commands": commands,
        "loop": commands & (has("300000") | has("5 * 60 * 1000") | has("5*60*1000")),
        "five": has("setInterval") & has("300000"),
        "generic": has("getSignaturesForAddress") & has("setInterval"),
        "usual": X.contains_any(content, WALLET_USE),
        "end_point": X.contains_any(content, RPC_ENDPOINTS),
        "telling": X.count_of(has(s) for s in TELEMETRY_SIGNS) >= 2,
        "encoded": has("Buffer.from") & has("process.env") & has("fetch"),
        "together": X.contains_any(content, REQUESTS) & has("process.env") & X.contains_any(content, ENCODERS) & X.contains_any(content, ADDRESSED),
        "exfil_header": X.contains_any(content, V.EXFIL_HEADERS),
    }


def _polling(lines: Column) -> list[tuple[Column, Column]]:
    """Condition and findings of the polling rules; a command loop is found alone."""
    subject, loop, commands, usual, generic = map(F.col, ("subject", "loop", "commands", "usual", "generic"))
    reads = lambda t: t.rlike(r"getTransaction\s*\(")
    timed = lambda t: t.rlike(r"setInterval\s*\(\s*async")
    signed = lambda t: t.rlike(r"getSignaturesForAddress\s*\(")
    notable = lambda t: X.contains_any(t, V.C2_WALLETS + RPC_ENDPOINTS) | signed(t) | timed(t) | (commands & reads(t))
    # a match in the first line counts as none yet
    at = F.coalesce(F.get(F.filter(lines, lambda x: (x["line"] > 1) & notable(x["t"])), F.lit(0))["line"], F.lit(1))
    some = lambda test: F.exists(lines, lambda x: test(x["t"]))
    row = lambda line, severity, description, confidence: finding(line, "blockchain_c2", severity, description, confidence)
    rules = [
        *((F.lit(True), _each(lines, lambda t, w=w: t.contains(w), lambda x: row(x["line"], "critical", "Known C2 wallet", 0.98))) for w in V.C2_WALLETS),
        *((F.lit(True), _each(lines, lambda t, e=e: t.contains(e), lambda x, e=e: row(x["line"], "high", f"chain end point {e}", 0.75))) for e in RPC_ENDPOINTS),
        (commands, _each(lines, reads, lambda x: row(x["line"], "high", "commands from transactions", 0.80))),
        (F.lit(True), _one(F.col("five"), row(at, "critical", "polling every five minutes", 0.90))),
        (F.lit(True), _one(generic & ~usual, row(at, "medium", "polling of a chain", 0.50))),
        (~(generic & usual), _one(F.col("end_point") & some(timed) & ~some(signed) & ~usual, row(at, "high", "chain end point with a polling interval", 0.82))),
    ]
    return [(subject & loop, F.array(row(F.lit(1), "critical", "polling for commands", 0.92))), *((subject & ~loop & test, found) for test, found in rules)]


def _exfiltration(lines: Column) -> list[tuple[Column, Column]]:
    source, encoded = F.col("plain_source"), F.col("encoded")
    row = lambda line, severity, description, confidence: finding(line, "header_c2", severity, description, confidence)
    encoded_at = F.coalesce(_first(lines, lambda t: t.contains("Buffer.from") & t.contains("process.env")), _first(lines, lambda t: t.contains("fetch")), F.lit(1))
    together_at = F.coalesce(_first(lines, lambda t: X.contains_any(t, ("fetch", "axios", "process.env"))), F.lit(1))
    return [
        *((source & F.col("telling"), _each(lines, lambda t, h=h: t.contains(h), lambda x, h=h: row(x["line"], "medium", f"monitoring header {h} beside signs of exfiltration", 0.50))) for h in TELEMETRY_HEADERS),
        (source, _one(encoded, row(encoded_at, "critical", "environment encoded and sent", 0.88))),
        (source, _one(F.col("together") & ~encoded & ~F.col("exfil_header"), row(together_at, "high", "request with the encoded environment", 0.82))),
    ]


def _hidden(lines: Column) -> list[tuple[Column, Column]]:
    """Hidden data in a manifest's fields and in base64 comments.

    As the rules of the reports count lines, one that doesn't start its line is
    said to be in the next.
    """
    count = lambda t: F.regexp_count(t, F.lit(HIDDEN))
    row = lambda x, part, description, confidence: finding(x["line"] + F.when(F.instr(x["t"], part) > 1, 1).otherwise(0), "stegano_payload", "high", description, confidence, code_point=0x200B)
    out = []
    for field in FIELDS:
        for mark in "\"'":
            pattern = rf"{mark}{field}{mark}\s*:\s*{mark}([^{mark}]*){mark}"
            part = lambda t, p=pattern: F.regexp_extract(t, p, 0)
            value = lambda t, p=pattern: F.regexp_extract(t, p, 1)
            out.append((F.col("file_path").endswith("package.json"), _each(lines, lambda t, v=value: count(v(t)) >= FIELD_LEAST, lambda x, p=part, f=field: row(x, p(x["t"]), f"hidden data in the field {f}", 0.88))))
    comment = lambda t: F.regexp_extract(t, COMMENT, 0)
    # the pattern tries each asterisk up to the line's end: only lines that have such characters are worth that
    hides = lambda t: X.contains_any(t, map(chr, HIDING)) & (count(t) >= COMMENT_LEAST)
    out.append((F.lit(True), _each(lines, lambda t: hides(t) & (count(comment(t)) >= COMMENT_LEAST), lambda x: row(x, comment(x["t"]), "hidden characters in a base64 comment", 0.85))))
    return out


def content_findings(files: DataFrame) -> DataFrame:
    """Findings of rows with file_path, plain_source and ``text``, the whole content."""
    numbered = F.transform(X.lines_of(F.col("text")), lambda t, k: F.struct((k + 1).cast("long").alias("line"), t.alias("t")))
    some = F.filter(numbered, lambda x: X.contains_any(x["t"], NOTABLE))
    rows = files.select(*KEY, "plain_source", some.alias("lines"), *(c.alias(k) for k, c in _flags(F.col("text")).items()))
    found = [F.when(test, hits) for test, hits in (*_polling(F.col("lines")), *_exfiltration(F.col("lines")), *_hidden(F.col("lines")))]
    return rows_of(rows.select(*KEY, F.explode_outer(F.flatten(F.array_compact(F.array(*found)))).alias("f")).where("f IS NOT NULL"))
