"""The rule tables that both the detectors and their DuckDB counterparts are made from."""

from __future__ import annotations

import re
from dataclasses import dataclass

from auspex.functions import values as V


def literals(items: tuple[str, ...], ignore_case: bool = False) -> str:
    """A regular expression for any of the literals, in both dialects."""
    body = "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", x) for x in items)
    return f"(?i)({body})" if ignore_case else f"({body})"


@dataclass(frozen=True)
class LineRule:
    """A row for each line that ``pattern`` matches, if the file fits ``where`` (a boolean column of files) and the line has ``also`` and none of ``unless``."""

    category: str
    severity: str
    confidence: float | None
    description: str
    pattern: str
    where: str | None = None
    also: str | None = None
    unless: tuple[str, ...] = ()


LINE_RULES = (
    LineRule("decoder_function", "high", None, "variation selector decoder", V.VS_CONSTANT, "has_invisible", "codePointAt"),
    LineRule("time_delay_sandbox_evasion", "low", None, "long timeout", V.DELAYS[0], "plain_source"),
    LineRule("time_delay_sandbox_evasion", "low", None, "long interval", V.DELAYS[1], "plain_source"),
    LineRule("time_delay_sandbox_evasion", "low", None, "15 minute constant", V.DELAYS[2], "plain_source"),
    LineRule("time_delay_sandbox_evasion", "low", None, "48 hour constant", V.DELAYS[3], "plain_source"),
    LineRule("time_delay_sandbox_evasion", "critical", None, "CI check", V.IS_CI, "plain_source"),
    LineRule("unknown", "high", None, "forced browser termination", literals(V.BROWSER_KILLS, True)),
    LineRule("unknown", "high", None, "misspelling of a known loader", literals(V.TYPO_FINGERPRINTS)),
    LineRule("forcememo_python", "critical", None, "known Python loader marker", literals(V.FORCED_MARKERS), "is_python"),
    LineRule("header_c2", "critical", 0.90, "suspicious header for exfiltration", literals(V.EXFIL_HEADERS), "plain_source"),
    LineRule("header_c2", "high", 0.78, "data in DNS TXT lookups", r"resolveTxt\s*\(|dns\.resolve\s*\([^,]+,\s*[\"']TXT[\"']|resolver\.resolveTxt", "plain_source"),
    LineRule("header_c2", "high", 0.72, "data in gists or issues", r"api\.github\.com.*(gists|issues)|github\.com/api.*(gists|issues)", "plain_source"),
    LineRule("blockchain_c2", "high", 0.80, "data in transfer memos", r"Transfer.*Memo|Memo.*Transfer|transaction\.add.*memo|memo.*transaction\.add", "plain_source"),
    LineRule("header_c2", "high", 0.75, "encoded POST body", r"POST.*Buffer\.from|fetch.*method\s*:\s*[\"']POST[\"'].*Buffer\.from", "plain_source"),
    LineRule("header_c2", "medium", 0.55, "request with headers of its own", r"fetch\s*\([^)]*\{[^}]*headers\s*:[^}]*X-", "plain_source", None, V.KNOWN_EXFIL_HEADERS),
)

#: Signs of a decoder of invisible characters, with their confidence.
DECODER_SIGNS = ((r"codePointAt\s*\([^)]*\).*0x[Ff][Ee]00|codePointAt\s*\([^)]*0x[Ff][Ee]00|codePointAt\s*\([^)]*0x[Ee]0100", 0.95), (r"\.filter\s*\([^)]*0x200[BCD]|\.filter\s*\([^)]*0x[Ff][Ee]0", 0.90), (r"fromCodePoint\s*\([^)]*0x[Ff][Ee]0", 0.92))
