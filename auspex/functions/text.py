"""Column functions over texts, paths and code points; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auspex.functions import values as V


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(text: Column, literals: Iterable[str]) -> Column:
    return any_of(text.contains(x) for x in literals)


def count_of(tests: Iterable[Column]) -> Column:
    """How many of the conditions hold."""
    return reduce(lambda a, b: a + b, (t.cast("int") for t in tests), F.lit(0))


def in_ranges(cp: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    return any_of(cp.between(a, b) for a, b in ranges)


def char_class(ranges: Iterable[tuple[int, int]], extra: Iterable[int] = ()) -> str:
    """A regular expression's class of code points, for the JVM's and RE2's dialect."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "".join(f"\\x{{{c:X}}}" for c in extra) + "]"


def path_class(path: Column) -> Column:
    """test, build, data or production, the first that fits the lower-cased path."""
    low = F.lower(path)
    fits = lambda parts, ends, starts: any_of([*(low.contains(p) for p in parts), *(low.endswith(e) for e in ends), *(low.startswith(s) for s in starts)])
    return F.when(fits(*V.TEST_PATHS), "test").when(fits(*V.BUILD_PATHS), "build").when(fits(*V.DATA_PATHS), "data").otherwise("production")


def is_i18n(path: Column, content: Column) -> Column:
    low, text = F.lower(path), F.lower(content)
    by_path = contains_any(low, V.LOCALE_DATA_DIRS + V.I18N_PATHS) | any_of(low.endswith(e) for e in V.I18N_ENDS)
    return by_path | (count_of(text.contains(i) for i in V.I18N_INDICATORS) >= 3)


def is_minified(content: Column, n_lines: Column) -> Column:
    """Long lines on average, or one long line, by bytes."""
    size = F.octet_length(content)
    return (size / n_lines > 500) | ((n_lines == 1) & (size > 1000))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.SEVERITIES)), severity).cast("int") - 1


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def lines_of(content: Column) -> Column:
    """The lines of a text: no empty one after a final line feed."""
    parts = F.split(content, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
