"""Payloads hidden in variation selectors: decoding, entropy and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first selector of each block, the values of the first block, the least number of selectors of a payload.
LOW, HIGH, LOW_VALUES, LEAST = 0xFE00, 0xE0100, 16, 4


def _units(data: Column, digits: int) -> Column:
    return F.regexp_extract_all(F.hex(data), F.lit(f"(.{{{digits}}})"), F.lit(1))


def selectors(data: Column) -> Column:
    """The text of selectors that stands for the bytes."""
    value = lambda h: F.conv(h, 16, 10).cast("int")
    point = lambda h: F.when(value(h) < LOW_VALUES, value(h) + LOW).otherwise(value(h) - LOW_VALUES + HIGH)
    return F.decode(F.unhex(F.array_join(F.transform(_units(data, 2), lambda h: F.lpad(F.hex(point(h)), 8, "0")), "")), "UTF-32")


def hidden_bytes(text: Column) -> Column:
    """The bytes of the selectors of a text, whatever is between them; null for fewer than LEAST."""
    points = F.transform(_units(F.encode(text, "UTF-32"), 8), lambda h: F.conv(h, 16, 10).cast("int"))
    value = lambda p: F.when(p.between(LOW, LOW + 15), p - LOW).when(p.between(HIGH, HIGH + 239), p - HIGH + LOW_VALUES)
    values = F.filter(F.transform(points, value), lambda v: v.isNotNull())
    return F.when(F.size(values) >= LEAST, F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), "")))


def entropies(rows: DataFrame, key: str, data: str) -> DataFrame:
    """key, entropy of each row's bytes, which aren't empty: counts by value, then a sum."""
    counts = rows.select(key, F.explode(_units(F.col(data), 2)).alias("_b")).groupBy(key, "_b").agg(F.count("*").alias("_n"))
    sums = counts.groupBy(key).agg(F.sum("_n").alias("_total"), F.sum(F.col("_n") * F.log2("_n")).alias("_s"))
    return sums.select(key, (F.log2("_total") - F.col("_s") / F.col("_total")).alias("entropy"))


def payload_class(data: Column, entropy: Column) -> Column:
    text = F.is_valid_utf8(data.cast("string"))
    return F.when(F.octet_length(data) < 16, "too_small").when(entropy > 7, "encrypted").when(entropy >= 6, "suspicious").when(text, "plaintext").otherwise("suspicious")


def payloads(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes, entropy, payload_class and decoded (null if it isn't UTF-8) of the rows that hide something; ``key`` is unique."""
    data = rows.select(key, hidden_bytes(F.col(text)).alias("_data")).where("_data IS NOT NULL")
    both = data.join(entropies(data, key, "_data"), key)
    decoded = F.when(F.is_valid_utf8(F.col("_data").cast("string")), F.col("_data").cast("string"))
    return both.select(key, F.octet_length("_data").alias("n_bytes"), F.round("entropy", 6).alias("entropy"), payload_class(F.col("_data"), F.col("entropy")).alias("payload_class"), decoded.alias("decoded"))
