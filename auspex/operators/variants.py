"""Variants of texts that detectors are tried on.

Where a variant leaves a choice, it is made by the seed and the place, so reruns agree;
``rate`` is the share of places that are changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X

# Fixed values of the variants.
INVISIBLE = (0x200B, 0x200C, 0x200D, 0xFE00, 0xE0100)
LATIN, ALIKE = "aeopcxABEHIKMNOPTXYZ", "аеорсхΑΒΕΗΙΚΜΝΟΡΤΧΥΖ"
BIDI = (0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)
POP = 0x202C
NOISE = ("// TODO: fix this later\n", "/* deprecated */\n", "var _unused = null;\n", "const __DEV__ = false;\n", "function _helper() { return 0; }\n")
NAMES = {"config": "_0x1a2b", "data": "_0x2c3d", "value": "_0x3e4f", "result": "_0x5g6h", "temp": "_0x7i8j"}
DECODER_NAMES = ("decoder", "decode_func", "decodeFn", "decoder_func", "hidden_decoder")
RENAMINGS = ("d3c0d3r", "_decoder", "__decoder__", "decoder_", "decode_util", "str_decoder", "decoder_v2")
ENCODINGS = {"from('base64')": "from('hex')", 'from("base64")': 'from("hex")', "atob(": "hexDecode(", "btoa(": "hexEncode(", "Buffer.from": "Buffer.hexFrom"}
TURNED = {0xFE0F: 0xFE0E, 0xFE0E: 0xFE0F, 0x200B: 0x200C, 0x200C: 0x200D, 0x200D: 0x200B, 0x200E: 0x200F, 0x200F: 0x200E}


def _hit(at: Column, seed: int, rate: float) -> Column:
    return F.lit(True) if rate >= 1 else F.pmod(F.xxhash64(F.lit(seed), at), F.lit(1_000_000)) < rate * 1_000_000


def _pick(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(at, F.lit(len(items))) + 1).cast("int"))


def _replaced(text: Column, by: dict[str, str]) -> Column:
    for old, new in by.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def with_invisible(text: Column, seed: int, rate: float) -> Column:
    """An invisible character behind the first and then every tenth character."""
    marks = [chr(c) for c in INVISIBLE]
    put = lambda c, i: F.when((i % 10 == 0) & _hit(i, seed, rate), F.concat(c, _pick(marks, F.floor(i / 10) + seed))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), put), "")


def with_look_alikes(text: Column, seed: int, rate: float) -> Column:
    if rate >= 1:
        return F.translate(text, LATIN, ALIKE)
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(_hit(i, seed, rate), F.translate(c, LATIN, ALIKE)).otherwise(c)), "")


def within_bidi(text: Column, seed: int, rate: float) -> Column:
    return F.concat(F.lit(chr(BIDI[seed % len(BIDI)])), text, F.lit(chr(POP)))


def as_selectors(text: Column, seed: int, rate: float) -> Column:
    """Each UTF-8 byte b as the code point 0xFE00 + b."""
    return F.decode(F.unhex(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "FE$1")), "UTF-16BE")


def with_noise(text: Column, seed: int, rate: float) -> Column:
    """A line of noise behind the first and then every fifth line."""
    put = lambda t, i: F.when((i % 5 == 0) & _hit(i, seed, rate), F.concat(t, F.lit("\n"), _pick(list(NOISE), F.floor(i / 5) + seed))).otherwise(F.concat(t, F.lit("\n")))
    return F.array_join(F.transform(X.lines_of(text), put), "")


def with_names(text: Column, seed: int, rate: float) -> Column:
    return _replaced(text, NAMES)


def with_decoder_names(text: Column, seed: int, rate: float) -> Column:
    """Names of decoders as whole words."""
    for k, name in enumerate(DECODER_NAMES):
        new = F.regexp_replace(text, rf"\b{name}\b", RENAMINGS[(seed + k) % len(RENAMINGS)])
        text = new if rate >= 1 else F.when(_hit(F.lit(k), seed, rate), new).otherwise(text)
    return text


def with_encodings(text: Column, seed: int, rate: float) -> Column:
    return _replaced(text, ENCODINGS)


def with_turned(text: Column, seed: int, rate: float) -> Column:
    """Selectors and zero-width characters in place of each other."""
    return F.translate(text, "".join(map(chr, TURNED)), "".join(map(chr, TURNED.values())))


VARIANTS: dict[str, Callable[[Column, int, float], Column]] = {
    "invisible": with_invisible, "look_alikes": with_look_alikes, "bidi": within_bidi, "selectors": as_selectors, "noise": with_noise,
    "names": with_names, "decoder_names": with_decoder_names, "encodings": with_encodings, "turned": with_turned,
}


def variants(texts: DataFrame, key: str, text: str, seed: int = 0, rate: float = 0.3) -> DataFrame:
    """Every variant of each text that isn't null or empty: the key, ``variant`` and ``content``."""
    each = F.array(*(F.struct(F.lit(name).alias("variant"), make(F.col(text), seed, rate).alias("content")) for name, make in VARIANTS.items()))
    return texts.where(F.col(text) != "").select(key, F.explode(each).alias("v")).select(key, "v.variant", "v.content")


def evasion_levels(rates: DataFrame) -> DataFrame:
    """``severity`` by the share that evades, ``risk_level`` of the tried detectors as a whole."""
    r = F.col("evasion_rate")
    severity = F.when(r == 1, "critical").when(r >= 0.75, "high").when(r >= 0.5, "medium").otherwise("low")
    risk = F.when(r >= 0.5, "critical").when(r >= 0.3, "high").when(r >= 0.1, "medium").otherwise("low")
    return rates.withColumns({"severity": severity, "risk_level": risk})
