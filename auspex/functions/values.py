"""Fixed values of the detection rules: code points, word lists, weights and thresholds."""

#: Inclusive ranges of invisible code points.
INVISIBLE_RANGES = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x200B, 0x200F), (0x2060, 0x206F), (0x202A, 0x202E), (0x2066, 0x2069), (0xE0000, 0xE007F), (0xFFF0, 0xFFFF))
CRITICAL_RANGES = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x200B, 0x200F), (0x202A, 0x202E))
VARIATION_SELECTORS = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
TAG_RANGE = ((0xE0000, 0xE007F),)
ZERO_WIDTH = (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)

#: Bidirectional controls: code point, name, severity.
BIDI = (
    (0x202A, "LRE", "medium"), (0x202B, "RLE", "high"), (0x202C, "PDF", "medium"), (0x202D, "LRO", "high"), (0x202E, "RLO", "critical"),
    (0x2066, "LRI", "medium"), (0x2067, "RLI", "medium"), (0x2068, "FSI", "medium"), (0x2069, "PDI", "medium"),
    (0x200E, "LRM", "low"), (0x200F, "RLM", "low"), (0x061C, "ALM", "low"),
)

#: Confusable letters: code point, base letter, script, similarity.
CONFUSABLES = (
    (0x0430, "a", "Cyrillic", 1.0), (0x0435, "e", "Cyrillic", 1.0), (0x043E, "o", "Cyrillic", 1.0), (0x0440, "p", "Cyrillic", 1.0), (0x0441, "c", "Cyrillic", 1.0),
    (0x0445, "x", "Cyrillic", 1.0), (0x0443, "y", "Cyrillic", 1.0), (0x0410, "A", "Cyrillic", 1.0), (0x0415, "E", "Cyrillic", 1.0), (0x041E, "O", "Cyrillic", 1.0),
    (0x0420, "P", "Cyrillic", 1.0), (0x0421, "C", "Cyrillic", 1.0), (0x0425, "X", "Cyrillic", 1.0), (0x0423, "Y", "Cyrillic", 1.0), (0x03B1, "a", "Greek", 0.95),
    (0x03BF, "o", "Greek", 1.0), (0x03B9, "i", "Greek", 0.9), (0x0391, "A", "Greek", 1.0), (0x0392, "B", "Greek", 1.0), (0x0395, "E", "Greek", 1.0),
    (0x0396, "Z", "Greek", 1.0), (0x0397, "H", "Greek", 1.0), (0x0399, "I", "Greek", 1.0), (0x039A, "K", "Greek", 1.0), (0x039C, "M", "Greek", 1.0),
    (0x039D, "N", "Greek", 1.0), (0x039F, "O", "Greek", 1.0), (0x03A1, "P", "Greek", 1.0), (0x03A4, "T", "Greek", 1.0), (0x03A7, "X", "Greek", 1.0), (0x03A5, "Y", "Greek", 0.95),
)

#: Before and after an emoji presentation selector.
EMOJI_BEFORE = ((0x2139, 0x2139), (0x2194, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x1F300, 0x1F9FF), (0x1FA00, 0x1FA6F))
EMOJI_AFTER = ((0x1F300, 0x1F9FF), (0x2600, 0x26FF), (0x2700, 0x27BF))

#: Lower-cased paths by class: parts anywhere, ends, starts.
TEST_PATHS = ((".test.", ".spec.", "/test/", "/tests/", "/__tests__/", "/__mocks__/"), ("-test.js", "-test.ts", "-spec.js", "-spec.ts"), ("test/", "tests/"))
BUILD_PATHS = (("/dist/", "/build/", "/out/", "/bundle/", "/compiled/", "/generated/", ".min.js", ".min.ts", ".bundle.js", ".bundle.ts"), (), ("dist/", "build/", "out/"))
DATA_PATHS = (("/data/", "/locale/", "/locales/", "/i18n/", "/lang/", "/languages/", "all-countries", "countries.json", "l10n"), (), ("data/", "locale/", "i18n/"))
LOCALE_DATA_DIRS = ("/locale-data/", "/localedata/", "/cldr/", "/unicode-data/")
I18N_PATHS = ("/i18n/", "/locale/", "/locales/", "/translation/", "/translations/", "/lang/", "/languages/", "/nls/", "i18n.", "i18n/", "translation.", "translations.", "locale.", "locales.", "lang.", "languages.", "gettranslation.", "gettext.", "polyglot.")
I18N_ENDS = (".po", ".mo", ".pot")
I18N_INDICATORS = ('"locale"', '"language"', '"translations"', "i18next", "react-i18next", "react-intl", "gettext", "t(", "i18n:", "datetimeformat", "numberformat", "pluralrules", '"en"', '"de"', '"fr"', '"es"', '"ja"', '"zh"')
DECODERS = ("atob(", "Buffer.from(", "fromCharCode", "String.fromCharCode", "eval(", "Function(", "decodeURIComponent", ".split('').map(", ".reduce((acc")

#: Known indicators from public threat reports.
C2_WALLETS = ("BjVeAjPrSKFiingBn4vZvghsGj9KCE8AJVtbc9S8o8SC", "28PKnu7RzizxBzFPoLp69HLXp9bJL3JFtT2s5QzHsEA2", "G2YxRa6wt1qePMwfJzdXZG62ej4qaTC7YURzuh2Lwd3t", "DSRUBTziADDHSik7WQvSMjvwCHFsbsThrbbjWMoJPUiW", "6YGcuyFRJKZtcaYCCFba9fScNUvPkGXodXE1mJiSzqDJ")
C2_ADDRESSES = ("104.238.191.54", "108.61.208.161", "45.150.34.158", "45.32.150.251", "45.32.151.157", "70.34.242.255", "217.69.3.152", "217.69.3.51", "217.69.11.99", "217.69.0.159")
TYPO_FINGERPRINTS = ("LoadLibararyFail", "Invlaid", "NtAllocVmErr")
FORCED_MARKERS = ("lzcdrtfxyqiplpd", "idzextbcjbgkdih", "aqgqzxkfjzbdnhz", "wogyjaaijwqbpxe")
BROWSER_KILLS = (
    "taskkill /F /IM chrome.exe", "taskkill /F /IM msedge.exe", "taskkill /F /IM brave.exe", "taskkill /F /IM opera.exe", "taskkill /F /IM vivaldi.exe", "taskkill /F /IM firefox.exe", "taskkill /T /F /IM chrome",
    'pkill -9 -f "Google Chrome"', 'pkill -9 -f "Microsoft Edge"', "pkill -9 chrome", "pkill -9 firefox", "killall -9 chrome", "killall -9 firefox",
    "Stop-Process -Name chrome -Force", "Stop-Process -Name msedge -Force", 'Stop-Process "chrome" -Force',
)
HIGH_EXFIL_KEYS = ("sync_oauth_token", "send_tab_private_key", "close_tab_private_key", "walletCount", "creditCardCount", "cookieCount", "loginCount")
MEDIUM_EXFIL_KEYS = ("master_key", "app_bound_key", "dpapi_key", "session_token", "profile_oauth_token")
SOCKET_TRANSPORT = ("io(", "io.connect(", "socket.connect(", "socket.io-client", "socket.io", ".on('connect')", '.on("connect")', ".on('disconnect')", '.on("disconnect")', "SocketIO", "socketIO")
SOCKET_ENDPOINT = (":4789", ":5000", ":8080", ":3001", ":9000", ".onion", "no-ip", "dyndns", "dynu", "45.32.150.251", "45.32.151.157", "70.34.242.255", "217.69.3.152", "217.69.3.51", "217.69.11.99", "217.69.0.159")
SOCKET_TUNNEL = ("tunnel-agent", "socks-proxy-agent", "http-proxy-agent", "https-proxy-agent", "tunnel", "proxy", "dns-over-https", "doh", "binary framing", "binary-framing", "extraHeaders", "auth:", "atob(", "btoa(")
EXFIL_HEADERS = ("X-Exfil-ID", "X-Session-Token", "X-Data-Payload", "X-Env-Vars", "X-Credentials", "X-API-Key", "X-Auth-Token", "X-Secret", "X-Password")
KNOWN_EXFIL_HEADERS = ("X-Exfil-ID", "X-Session-Token", "X-Data-Payload", "X-Env-Vars", "X-Exfiltrated-Data", "X-Stolen-Creds", "X-User-Data", "X-Credential-Data")

#: Regular expressions that both regex dialects read alike.
HEX_BLOB = r"[0-9a-fA-F]{64,}"
BASE64_BLOB = r"[A-Za-z0-9+/=]{64,}"
EXEC = r"\beval\s*\(|\bnew\s+Function\s*\(|\bvm\.runIn(NewContext|ThisContext)\s*\(|\b(exec|execSync)\s*\(|\bchild_process\s*\+"
DECRYPT = r"(?i)(createDecipheriv|createDecipher|\.decrypt|\batob\s*\(|Buffer\.from\s*\([^)]*\)\s*\.toString)"
HTTP_CLIENT = r"\bhttp\.get\s*\(|\bhttps\.get\s*\(|\bfetch\s*\(|\baxios\.|\brequest\s*\(|\bhttps\.request\s*\("
HEADER_ACCESS = r"\bheaders\s*\[|\bheaders\.get\s*\(|\bgetHeader\s*\(|\bresponse\.headers|\bres\.headers"
HEADER_CRYPTO = r"\bcreateDecipheriv\s*\(|\bcreateDecipher\s*\(|\bcrypto\.subtle\.decrypt\s*\(|\bdecipher\.update\s*\(|\bdecipher\.final\s*\(|\b\.decrypt\s*\("
HEADER_EXEC = r"\beval\s*\(|\bnew\s+Function\s*\(|\bvm\.runIn(NewContext|ThisContext)\s*\(|\b(exec|execSync|spawn)\s*\(|\bchild_process\s*\+"
LOCALE = r"['\"]ru-RU['\"]|['\"]Europe/Moscow['\"]|navigator\.language\s*===\s*['\"]ru['\"]"
EXIT_ZERO = r"process\.exit\s*\(\s*0\s*\)"
DELAYS = (r"setTimeout\s*\(\s*[^,]+,\s*([5-9]\d{5}|[1-9]\d{6,})\s*\)", r"setInterval\s*\(\s*[^,]+,\s*([5-9]\d{5}|[1-9]\d{6,})\s*\)", r"\b900000\b", r"\b172800000\b")
CI_CHECK = r"\b259200000\b|process\.env\.(CI|GITHUB_ACTIONS|CIRCLECI|TRAVIS|JENKINS|GITLAB_CI)"
IS_CI = r"\bisCI\b"
SIGNATURES = r"getSignaturesForAddress\s*\("
FIVE_MINUTES = r"(setInterval\s*\([^,]+,\s*300000|POLL_INTERVAL\s*=\s*300000)"
SANDBOX_CI = r"process\.env\.(CI|GITHUB_ACTIONS|TRAVIS|JENKINS|CIRCLECI|GITLAB_CI|BUILDKITE|TEAMCITY)|\bisCI\b|\bis_ci\b"
SANDBOX_VM = r"os\.(cpus|totalmem|freemem)\s*\(\s*\)|require\s*\(\s*[\"']os[\"']\s*\)\s*\.\s*(cpus|totalmem|freemem)\s*\(\s*\)|cpus\s*\(\s*\)\s*\.\s*length|totalmem\s*\(\s*\)|freemem\s*\(\s*\)"
SANDBOX_EXIT = r"process\.exit\s*\(\s*0\s*\)|process\.exit\s*\(\s*0x0+\s*\)|exit\s*\(\s*0\s*\)"
VS_CONSTANT = r"0x[Ff][Ee]00|0x[Ee]0100|\\u\{[Ff][Ee]0[0-9A-Fa-f]\}|\\u\{[Ee]01[0-9A-Fa-f]{2}\}"
#: Signs of a decoder with their confidence.
OBFUSCATION = (
    (r"['\"][a-zA-Z0-9]{3,}['\"].*,.*['\"][a-zA-Z0-9]{3,}['\"].*,.*['\"][a-zA-Z0-9]{3,}['\"]", 0.25),
    (r"\^\s*0x[0-9A-Fa-f]{2,}|\^\s*[0-9]{2,}", 0.25),
    (r"String\s*\[\s*['\"]fromCharCode['\"]\s*\]|String\s*\[\s*['\"]fromCodePoint['\"]\s*\]", 0.30),
    (r"atob\s*\([^)]*\).*\^|\^.*atob\s*\(", 0.30),
    (r"S\s*=\s*\[\].*for.*S\[.*\]\s*=\s*.*S\[.*\]", 0.25),
    (r"(eval|Function)\s*\(\s*[^)]*\^|atob[^)]*\)\s*\)", 0.30),
)

#: Severities in the order in which the duplicate rule and maxima take them: info is the greatest.
SEVERITIES = ("low", "medium", "high", "critical", "info")
BASE_SCORES = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5, "info": 0.5}
RISK_POINTS = {"info": 1, "low": 3, "medium": 8, "high": 15, "critical": 25}
#: Weights of the tiered score by category; others weigh OTHER_WEIGHT.
WEIGHTS = {"invisible_character": 5.0, "homoglyph": 3.0, "stego_pattern": 8.0, "blockchain_c2": 10.0, "header_c2": 8.0, "exfil_schema": 6.0, "locale_geofencing": 7.0, "time_delay_sandbox_evasion": 7.0, "stegano_payload": 8.0, "decoder_function": 8.0, "encrypted_payload": 8.0, "socketio_c2": 10.0}
OTHER_WEIGHT = 5.0
TIER_ONE = ("invisible_character", "stego_pattern")
CHAIN_MULTIPLIERS = {"supply_chain": 2.0, "stego": 1.8, "header_c2": 1.8, "blockchain_c2": 1.6, "encrypted_exec": 1.4, "geofenced_exec": 1.2}
CHAIN_SEVERITY = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5, "info": 0.25}
HIGH_VALUE = ("ielevator_com", "jpd_author", "memexec_loader", "xor_shift_obfuscation", "socketio_c2", "exfil_schema", "blockchain_c2")
