"""Which files of a tree are scanned: by extension, excluded folders and size."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Walk:
    """Paths are relative to the walk's root; names are compared with their case, and a name that is all extension (``.js``) has none."""

    extensions: tuple[str, ...]
    excluded: tuple[str, ...]
    most_bytes: int | None = None

    @property
    def wanted(self) -> str:
        return rf"[^/]\.({'|'.join(map(re.escape, self.extensions))})$"

    @property
    def left_out(self) -> str:
        return rf"(^|/)({'|'.join(map(re.escape, self.excluded))})/"

    def takes(self, path: str, size: int) -> bool:
        fits = self.most_bytes is None or size <= self.most_bytes
        return fits and re.search(self.wanted, path) is not None and re.search(self.left_out, path) is None

    def taken(self, path: Column, size: Column) -> Column:
        """``takes`` as a column."""
        fits = F.lit(True) if self.most_bytes is None else size <= self.most_bytes
        return fits & path.rlike(self.wanted) & ~path.rlike(self.left_out)


# Extensions, folders and sizes of each walk.
_ALL = ("js", "mjs", "cjs", "ts", "tsx", "jsx", "py", "rs", "go", "rb", "php", "java", "json", "yaml", "yml", "md", "txt")
WALKS = {
    "tree": Walk(_ALL, ("node_modules", ".git", "dist", "build", "target", "__pycache__", ".cache"), 1 << 20),
    "archive": Walk(_ALL, ("node_modules", ".git")),
    "script": Walk(("js", "mjs", "cjs", "ts", "tsx", "jsx"), ("node_modules", ".git", "target", "dist", "build")),
}
