"""DuckDB SQL for the corpus view and the detectors, which the queries' oracles are made of."""

from __future__ import annotations

from auspex.functions import values as V
from auspex.operators import detect as D
from auspex.operators.rules import DECODER_SIGNS, LINE_RULES, literals
from auspex.sources import corpus as C


def q(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def contains(text: str, items) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(i)})" for i in items) + ")"


def ranges(cp: str, items) -> str:
    return "(" + " OR ".join(f"{cp} BETWEEN {a} AND {b}" for a, b in items) + ")"


def fits(parts, ends, starts) -> str:
    return "(" + " OR ".join([*(f"contains(low, {q(p)})" for p in parts), *(f"suffix(low, {q(e)})" for e in ends), *(f"prefix(low, {q(s)})" for s in starts)]) + ")"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def count_rx(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


_pick = lambda items, by: "[" + ", ".join(q(i) for i in items) + f"][(({by}) % {len(items)} + 1)::INT]"
_turn = f"(doc_id // {len(C.SNIPPETS)})"

FILES = f"""corpus AS (SELECT 'pkg' || (doc_id % {C.PACKAGES}) AS package_name, {_pick([p for p, _ in C.PATHS], _turn)} || doc_id || {_pick([e for _, e in C.PATHS], _turn)} AS file_path, doc_id,
  CASE WHEN {_pick(C.SNIPPETS, "doc_id")} = '' THEN text ELSE text || chr(10) || {_pick(C.SNIPPETS, "doc_id")} END AS content FROM documents)"""

PREPARED = f"""{FILES},
prepared AS (SELECT *, lower(file_path) AS low, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines, strlen(content) AS bytes FROM (SELECT *, string_split(content, chr(10)) AS parts FROM corpus)),
classed AS (SELECT *, CASE WHEN {fits(*V.TEST_PATHS)} THEN 'test' WHEN {fits(*V.BUILD_PATHS)} THEN 'build' WHEN {fits(*V.DATA_PATHS)} THEN 'data' ELSE 'production' END AS file_class,
  {fits(V.LOCALE_DATA_DIRS + V.I18N_PATHS, V.I18N_ENDS, ())} OR ({" + ".join(f"contains(lower(content), {q(i)})::INT" for i in V.I18N_INDICATORS)}) >= 3 AS is_i18n,
  {contains("content", V.DECODERS)} AS has_decoder, {count_rx("content", D.INVISIBLE)} AS n_invisible, suffix(low, '.py') AS is_python FROM prepared),
ready AS (SELECT *, n_invisible > 0 AS has_invisible, file_class NOT IN ('test', 'build') AS plain_source FROM classed),
line AS (SELECT package_name, file_path, has_invisible, is_python, plain_source, bytes, is_i18n, has_decoder, n_invisible, low, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line FROM ready)"""


def _finding(line="line", category="", severity="", description="", confidence=None, col="1", cp="0") -> str:
    severity = severity if severity.startswith("CASE") else q(severity)
    return f"package_name, file_path, ({line})::BIGINT AS line, ({col})::BIGINT AS col, ({cp})::BIGINT AS code_point, {q(category)} AS category, {severity} AS severity, {q(description)} AS description, {confidence if isinstance(confidence, str) else q(confidence)}::DOUBLE AS confidence"


LINE = "\nUNION ALL ".join(
    f"SELECT {_finding(category=r.category, severity=r.severity, description=r.description, confidence=r.confidence)} FROM line WHERE {rx('text', r.pattern)}" + (f" AND {r.where}" if r.where else "") + (f" AND contains(text, {q(r.also)})" if r.also else "") + (f" AND NOT {contains('text', r.unless)}" if r.unless else "") for r in LINE_RULES
)

_points = ", ".join(str(c) for c, *_ in V.BIDI + V.CONFUSABLES)
_bidi = ", ".join(str(c) for c, *_ in V.BIDI)
_case = lambda cp, pairs, other: f"CASE {cp} " + " ".join(f"WHEN {a} THEN {q(b)}" for a, b in pairs) + f" ELSE {q(other)} END"
MARKS = f"""point AS (SELECT *, unicode(substr(text, col, 1)) AS cp, CASE WHEN col > 1 THEN unicode(substr(text, col - 1, 1)) END AS prev, CASE WHEN col < length(text) THEN unicode(substr(text, col + 1, 1)) END AS next
  FROM (SELECT *, unnest(range(1, length(text) + 1)) AS col FROM line WHERE {rx("text", D.SUSPECT)})),
mark AS (SELECT *, coalesce({ranges("prev", V.EMOJI_BEFORE)}, false) OR coalesce({ranges("next", V.EMOJI_AFTER)}, false) AS emoji,
  regexp_extract(substr(text, 1, col - 1), '([\\p{{L}}\\p{{N}}_]*)$', 1) || regexp_extract(substr(text, col), '^([\\p{{L}}\\p{{N}}_]*)', 1) AS ident FROM point WHERE {ranges("cp", V.INVISIBLE_RANGES)} OR cp IN ({_points}))"""

CHAR = f"""SELECT {_finding(category="bidirectional_override", severity=_case("cp", [(c, s) for c, _, s in V.BIDI], "medium"), description="bidirectional control", col="col", cp="cp")} FROM mark WHERE cp IN ({_bidi}) AND bytes <= {D.MAX_BYTES}
UNION ALL SELECT {_finding(category="invisible_character", severity=f"CASE WHEN {ranges('cp', V.CRITICAL_RANGES)} THEN 'critical' WHEN cp IN ({_bidi}, {', '.join(map(str, V.ZERO_WIDTH))}) THEN 'high' ELSE 'medium' END", description="invisible character", col="col", cp="cp")}
  FROM mark WHERE {ranges("cp", V.INVISIBLE_RANGES)} AND NOT (suffix(low, '.d.ts') OR {contains("low", V.LOCALE_DATA_DIRS)} OR suffix(low, '.json') AND is_i18n AND NOT has_decoder OR is_i18n AND has_decoder AND n_invisible > 10)
  AND NOT (cp = 65533 OR cp BETWEEN 65024 AND 65039 AND (is_i18n OR suffix(low, '.json')) OR emoji OR cp IN (8204, 8205) AND is_i18n)
UNION ALL SELECT {_finding(category="unicode_tag", severity="medium", description="tag character", col="col", cp="cp")} FROM mark WHERE {ranges("cp", V.TAG_RANGE)}
UNION ALL SELECT {_finding(category="homoglyph", severity="CASE WHEN cp IN (945, 933) THEN 'high' WHEN cp = 953 THEN 'medium' ELSE 'critical' END".replace("933", str(0x3A5)), description="mixed-script identifier", col="col", cp="cp")}
  FROM mark WHERE cp IN ({", ".join(str(c) for c, *_ in V.CONFUSABLES)}) AND bytes <= {D.MAX_BYTES} AND NOT is_i18n AND NOT {rx("trim(text)", r"^(//|\*|/\*|#)")} AND length(ident) > 1 AND {rx("ident", "[A-Za-z]")} AND {rx("ident", "[\\x{370}-\\x{3FF}\\x{400}-\\x{4FF}]")}"""


def any_line(pattern: str) -> str:
    return f"len(list_filter(lines, lambda x: {rx('x', pattern)})) > 0"


def first_line(pattern: str) -> str:
    return f"list_position(list_transform(lines, lambda x: {rx('x', pattern)}), true)"


def signals(items) -> str:
    return "(" + " + ".join(f"len(list_filter(lines, lambda x: contains(x, {q(i)})))" for i in items) + ")"


_quoted = lambda keys: tuple(f"{s}{k}{s}" for k in keys for s in "\"'")
_groups = (V.SOCKET_TRANSPORT, V.SOCKET_ENDPOINT, V.SOCKET_TUNNEL)
_run, _pipe = f"{D.VS}{{16,}}", f"\\|{D.VS}{{4,}}"
_sum = lambda table: " + ".join(f"CASE WHEN {any_line(p)} THEN {w} ELSE 0 END" for p, w in table)
WIDE = f"""wide AS (SELECT *, (g0 > 0)::INT + (g1 > 0)::INT + (g2 > 0)::INT AS n_groups FROM (SELECT *, round(least({_sum(V.OBFUSCATION)}, 1), 6) AS obf, {" + ".join(f"({any_line(p)})::INT" for p, _ in V.OBFUSCATION)} AS n_obf,
  round(least(least(n_invisible, 50) / 50.0 * 0.4 + ({_sum(DECODER_SIGNS)}) * 0.6, 1), 6) AS stego, length(content) - length(replace(content, chr(8203), '')) AS spaces, length(content) - length(replace(content, chr(8204), '')) AS joiners,
  {signals(_quoted(V.HIGH_EXFIL_KEYS))} AS n_high, {signals(_quoted(V.HIGH_EXFIL_KEYS + V.MEDIUM_EXFIL_KEYS))} AS n_keys, {", ".join(f"{signals(g)} AS g{k}" for k, g in enumerate(_groups))} FROM ready))"""

_file_rules = [
    ("is_i18n AND has_decoder AND n_invisible > 10", _finding("1", "invisible_character", "critical", "invisible characters with a decoder in a localisation file", 0.85)),
    (any_line(_run), _finding(first_line(_run), "stegano_payload", "critical", "hidden payload in variation selectors")),
    (any_line(_pipe), _finding(first_line(_pipe), "pipe_delimiter_stego", "high", "payload behind a pipe")),
    ("spaces >= 50 AND joiners >= 50 AND spaces / joiners BETWEEN 0.5 AND 2", _finding("1", "stegano_payload", "critical", "binary code of zero-width characters", 0.90)),
    ("has_invisible AND stego >= 0.7", _finding("1", "stego_pattern", "CASE WHEN stego >= 0.9 THEN 'critical' WHEN stego >= 0.8 THEN 'high' ELSE 'medium' END", "invisible characters and their decoder", "stego")),
    ("n_obf >= 2", _finding("1", "stego_pattern", "CASE WHEN obf >= 0.8 THEN 'critical' WHEN obf >= 0.6 THEN 'high' ELSE 'medium' END", "obfuscated decoder", "obf")),
    (f"plain_source AND ({any_line(V.HEX_BLOB)} OR {any_line(V.BASE64_BLOB)}) AND {any_line(V.DECRYPT)} AND {any_line(V.EXEC)}", _finding(first_line(f"{V.HEX_BLOB}|{V.BASE64_BLOB}"), "encrypted_payload", "high", "encrypted payload with dynamic execution")),
    (f"plain_source AND {any_line(V.HTTP_CLIENT)} AND {any_line(V.HEADER_ACCESS)} AND {any_line(V.HEADER_CRYPTO)} AND {any_line(V.HEADER_EXEC)}", _finding(first_line(V.HEADER_ACCESS), "header_c2", "critical", "commands in HTTP headers with dynamic execution")),
    (f"plain_source AND {any_line(literals(V.C2_WALLETS))}", _finding(first_line(literals(V.C2_WALLETS)), "blockchain_c2", "critical", "Known C2 wallet")),
    (f"plain_source AND {any_line(literals(V.C2_ADDRESSES))}", _finding(first_line(literals(V.C2_ADDRESSES)), "blockchain_c2", "critical", "Known C2 address")),
    (f"plain_source AND {any_line(V.SIGNATURES)} AND {any_line(V.FIVE_MINUTES)}", _finding(first_line(V.SIGNATURES), "blockchain_c2", "high", "polling of transaction signatures")),
    ("n_keys >= 3", _finding(first_line(literals(_quoted(V.HIGH_EXFIL_KEYS + V.MEDIUM_EXFIL_KEYS))), "unknown", "CASE WHEN n_high > 0 THEN 'high' ELSE 'medium' END", "keys of a credential record")),
    ("n_groups >= 2 OR n_groups = 1 AND g0 + g1 + g2 >= 3", _finding("CASE " + " ".join(f"WHEN g{k} > 0 THEN {first_line(literals(g))}" for k, g in enumerate(_groups)) + " END", "unknown", "CASE n_groups WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'info' END", "socket tunnel")),
    (f"plain_source AND {any_line(V.SANDBOX_CI)} AND {any_line(V.SANDBOX_VM)}", _finding(f"least({first_line(V.SANDBOX_CI)}, {first_line(V.SANDBOX_VM)})", "time_delay_sandbox_evasion", "critical", "CI and virtual machine checks", 0.92)),
    (f"plain_source AND NOT {any_line(V.SANDBOX_VM)} AND len(list_filter(lines, lambda x: {rx('x', V.SANDBOX_CI)} AND {contains('x', ('if', '!', '||', '&&'))})) > 0", _finding(first_line(V.SANDBOX_CI), "time_delay_sandbox_evasion", "medium", "condition on CI", 0.60)),
    (f"plain_source AND {any_line(V.SANDBOX_VM)} AND NOT {any_line(V.SANDBOX_CI)}", _finding(first_line(V.SANDBOX_VM), "time_delay_sandbox_evasion", "medium", "virtual machine check", 0.55)),
]
FILE = "\nUNION ALL ".join(f"SELECT {f} FROM wide WHERE {w}" for w, f in _file_rules)

_near = lambda sign, a, b: f"EXISTS (SELECT 1 FROM sign o WHERE o.package_name = s.package_name AND o.file_path = s.file_path AND o.{sign} AND o.line BETWEEN s.line + ({a}) AND s.line + ({b}))"
SIGN = "sign AS (SELECT package_name, file_path, line, " + ", ".join(f"{rx('text', p)} AS {k}" for k, p in D.SIGNS.items()) + " FROM line WHERE plain_source)"
WINDOW = "\nUNION ALL ".join(
    f"SELECT {_finding(category=c, severity=sv, description=d, confidence=cf)} FROM sign s WHERE {sign} AND {_near(other, a, b)}"
    for sign, other, a, b, c, sv, d, cf in (
        ("locale", "exit0", 1, 5, "locale_geofencing", "critical", "exit for a locale", None),
        ("delay", "ci", -10, -1, "time_delay_sandbox_evasion", "critical", "delay after a CI check", None),
        ("exit", "sandbox", -15, 15, "time_delay_sandbox_evasion", "critical", "exit near a sandbox check", 0.90),
        ("from_char", "char_code", 0, 4, "encrypted_payload", "medium", "XOR decoding", 0.60),
    )
) + "".join(
    f"\nUNION ALL SELECT {_finding(category='time_delay_sandbox_evasion', severity='high', description=d, confidence=0.82)} FROM line WHERE plain_source AND {rx('text', V.SANDBOX_VM)} AND contains(text, '{call}') AND {contains('text', low)}"
    f" AND NOT EXISTS (SELECT 1 FROM line o WHERE o.package_name = line.package_name AND o.file_path = line.file_path AND {rx('o.text', V.SANDBOX_CI)})"
    for call, low, d in (("cpus()", ("< 2", "<= 1", "<2"), "check for few processors"), ("totalmem()", ("2 * 1024 * 1024 * 1024", "2147483648", "2GB"), "check for little memory"))
)

_numbered = "unnest(lines) AS t, unnest(range(1, len(lines) + 1)) AS k"
_sdk = contains("content", ("async getSignaturesForAddress(", "async getTransaction(", "async getBalance(", "function getSignaturesForAddress(", "function getTransaction(", "class Connection", "class PublicKey", "class Transaction", "export class", "export function", "export {", "exports.", "constructor(rpcUrl", "constructor(props", "implements ConnectionInterface", "extends EventEmitter"))
_rpc = ("api.mainnet-beta.solana.com", "solana-api.projectserum.com", "rpc.ankr.com/solana", "api.devnet.solana.com", "api.testnet.solana.com")
_usual = contains("content", ("process.env.SOLANA_WALLET", "process.env.PUBLIC_KEY", "process.env.RPC_URL", "props.wallet", "wallet.address", "wallet.publicKey", "useWallet(", "useAnchorWallet", "useConnection", "connection.getAccountInfo", "connection.getBalance", "connection.getParsedAccountInfo"))
_monitors = ("X-Sentry-", "X-NewRelic-", "X-Datadog-", "X-Instana-", "X-Dynatrace-", "X-AppDynamics-", "X-Request-ID", "X-Correlation-ID", "X-Trace-ID", "X-Span-ID", "X-B3-", "X-Cloud-Trace-")
_telling = "(" + " + ".join(f"contains(content, '{s}')::INT" for s in ("process.env", "Buffer.from", "btoa", "encodeURIComponent", "credentials", "password", "secret", "api_key", "apikey", "Authorization")) + ")"
_zero_width = "\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}"


def _has(*all_of: str) -> str:
    return "(" + " AND ".join(f"contains(content, '{x}')" for x in all_of) + ")"


def _at(test) -> str:
    return f"list_filter(range(1, len(lines) + 1), lambda k: {test('lines[k]')})[1]"


def _lines_where(table: str, test: str) -> str:
    return f"(SELECT package_name, file_path, {_numbered} FROM {table} WHERE {test})"


#: Rules on whole contents; their values are written out again here.
CHAIN = f"""chain AS (SELECT *, {_has("decodeCommand", "executeCommand(")} AND {contains("content", ("300000", "5 * 60 * 1000", "5*60*1000"))} AS looped FROM ready WHERE NOT suffix(file_path, '.d.ts') AND NOT {_sdk}),
calm AS (SELECT *, coalesce(list_filter(range(2, len(lines) + 1), lambda k: {contains("lines[k]", (*V.C2_WALLETS, *_rpc))} OR regexp_matches(lines[k], 'getSignaturesForAddress\\s*\\(|setInterval\\s*\\(\\s*async') OR {_has("decodeCommand", "executeCommand(")} AND regexp_matches(lines[k], 'getTransaction\\s*\\('))[1], 1) AS spot FROM chain WHERE NOT looped)"""
_encoded_at = f"coalesce({_at(lambda x: contains(x, ('Buffer.from',)) + ' AND ' + contains(x, ('process.env',)))}, {_at(lambda x: contains(x, ('fetch',)))}, 1)"
_together_at = f"coalesce({_at(lambda x: contains(x, ('fetch', 'axios', 'process.env')))}, 1)"
_together = f"{contains('content', ('fetch(', 'axios.', 'http.post', 'http.get'))} AND {_has('process.env')} AND {contains('content', ('Buffer.from', 'btoa', 'encodeURIComponent'))} AND {contains('content', ('http://', 'https://', '.post(', '.get('))}"
CONTENT = "\nUNION ALL ".join(
    (
        f"SELECT {_finding('1', 'blockchain_c2', 'critical', 'polling for commands', 0.92)} FROM chain WHERE looped",
        *(f"SELECT {_finding('k', 'blockchain_c2', 'critical', 'Known C2 wallet', 0.98)} FROM {_lines_where('calm', 'true')} WHERE contains(t, '{w}')" for w in V.C2_WALLETS),
        *(f"SELECT {_finding('k', 'blockchain_c2', 'high', f'chain end point {e}', 0.75)} FROM {_lines_where('calm', 'true')} WHERE contains(t, '{e}')" for e in _rpc),
        f"SELECT {_finding('k', 'blockchain_c2', 'high', 'commands from transactions', 0.80)} FROM {_lines_where('calm', _has('decodeCommand', 'executeCommand('))} WHERE regexp_matches(t, 'getTransaction\\s*\\(')",
        f"SELECT {_finding('spot', 'blockchain_c2', 'critical', 'polling every five minutes', 0.90)} FROM calm WHERE {_has('setInterval', '300000')}",
        f"SELECT {_finding('spot', 'blockchain_c2', 'medium', 'polling of a chain', 0.50)} FROM calm WHERE {_has('getSignaturesForAddress', 'setInterval')} AND NOT {_usual}",
        f"SELECT {_finding('spot', 'blockchain_c2', 'high', 'chain end point with a polling interval', 0.82)} FROM calm WHERE {contains('content', _rpc)} AND regexp_matches(content, 'setInterval[ \\t]*\\([ \\t]*async') AND NOT regexp_matches(content, 'getSignaturesForAddress[ \\t]*\\(') AND NOT {_usual}",
        *(f"SELECT {_finding('k', 'header_c2', 'medium', f'monitoring header {h} beside signs of exfiltration', 0.50)} FROM {_lines_where('ready', f'plain_source AND {_telling} >= 2')} WHERE contains(t, '{h}')" for h in _monitors),
        f"SELECT {_finding(_encoded_at, 'header_c2', 'critical', 'environment encoded and sent', 0.88)} FROM ready WHERE plain_source AND {_has('Buffer.from', 'process.env', 'fetch')}",
        f"SELECT {_finding(_together_at, 'header_c2', 'high', 'request with the encoded environment', 0.82)} FROM ready WHERE plain_source AND {_together} AND NOT {_has('Buffer.from', 'fetch')} AND NOT {contains('content', V.EXFIL_HEADERS)}",
        f"SELECT {_finding('k + (strpos(t, m) > 1)::INT', 'stegano_payload', 'high', 'hidden characters in a base64 comment', 0.85, cp='8203')} FROM (SELECT *, regexp_extract(t, '(//|/\\*|\\*).*?[A-Za-z0-9+/={_zero_width}]{{50,}}', 0) AS m FROM {_lines_where('ready', 'true')}) WHERE len(regexp_extract_all(m, '[{_zero_width}\\x{{2060}}]')) >= 3",
    )
)

FINDINGS = f"""WITH {PREPARED}, {MARKS}, {WIDE}, {SIGN}, {CHAIN},
found AS ({CHAR}
UNION ALL {LINE}
UNION ALL {FILE}
UNION ALL {WINDOW}
UNION ALL {CONTENT})"""
