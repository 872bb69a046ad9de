"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance down the directories.

The vocabulary is that of the templates.  Its document frequencies come from all
files; a word outside of it weighs like one that no file has.  Every line of a file
is compared, windows of consecutive lines that have a line with a ``SIGN``, as
headers are wrapped, and a licence file also as a whole; the vectors are sparse (line,
term) counts in numpy.  Comment marks are no terms.  An SPDX line gives its
expression, with cosine 1.  A file without a licence of its own gets that of
the nearest directory above it that has a licence file, by joins on paths.

Defined cases: a null or empty text has no licence of its own; a null path is in no
directory and inherits nothing; with equal cosines the template that comes first
wins, between licence files of one directory the larger cosine, then the smaller
path; rows with one path are separate files; a very long text is one slice of its
task's work, and its windows are compared in blocks; an empty table gives an empty
result; extra columns are carried, and ones named like a result (in any case) are
replaced.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auspex.llm import words as W
from auspex.llm.rows import carried, own_names
from auspex.sources.shared import fresh, join_keyed, materialize

MIN_COSINE = 0.7
#: Base names of licence files.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense)(\.(txt|md))?$"

#: Windows of so many lines are compared.
WINDOWS = (2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 28, 32)
#: What a line of a window has to have; each template has one of them.
SIGN = re.compile(rb"(?i)licen[cs]|permission|copyright|warrant|redistribut|public domain")
SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)")

#: The customary one-line notices of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    # the standard headers and short texts
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("GPL-2.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("LGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("LGPL-2.1", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("MIT", 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
)
#: Licences that have their full text in ``licence_texts``.
FULL_TEXTS = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def terms(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each term (a run of letters and digits, ASCII ones in lower case); ``edges`` split runs."""
    low = _LOWER[data]
    inside = _IN_TERM[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[edges] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, W.span_hashes(low, starts, np.flatnonzero(ends) + 1)


@functools.cache
def templates() -> tuple[tuple[str, str], ...]:
    folder = resources.files("auspex.llm") / "licence_texts"
    return (*TEMPLATES, *((name, (folder / f"{name}.txt").read_text()) for name in FULL_TEXTS))


@functools.cache
def vocabulary() -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted hashes of all templates' terms, and the terms of each template as places in them."""
    each = []
    for _, text in templates():
        data = np.frombuffer(text.encode(), np.uint8)
        each.append(terms(data, np.array([0, len(data)]))[1])
    known = np.unique(np.concatenate(each))
    return known, [np.searchsorted(known, h) for h in each]


def _places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in ``known``; len(known) if it isn't there."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


def inverse_frequencies(files: DataFrame) -> np.ndarray:
    """ln((1 + files) / (1 + files with the term)) + 1 of each term; the last is for a term of none."""
    known, _ = vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(known) + 1, np.int64), 0
        for part in W.slices(batches, "text"):
            data, at = W.text_buffer(part.column("text"))
            starts, hashes = terms(data, at)
            place = _places(known, hashes)
            text_of = np.searchsorted(at, starts, "right") - 1
            pairs = np.unique(text_of[place < len(known)] * (len(known) + 1) + place[place < len(known)])
            counts += np.bincount(pairs % (len(known) + 1), minlength=len(known) + 1)
            n += part.num_rows
        counts[-1] = n
        yield pa.RecordBatch.from_pydict({"term": np.arange(len(known) + 1), "n": counts})

    # as many rows as there are terms in the templates
    found = files.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(known) + 1)
    for row in found:
        counts[row["term"]] = row["n"]
    n, counts[-1] = counts[-1], 0
    return np.log((1 + n) / (1 + counts)) + 1


def template_lists(idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The templates' unit vectors by term: n + 1 offsets of terms, and the template and weight of each entry."""
    known, each = vocabulary()
    entries = []
    for k, places in enumerate(each):
        term, tf = np.unique(places, return_counts=True)
        weight = tf * idf[term]
        entries.append((term, np.full(len(term), k), weight / np.sqrt((weight**2).sum())))
    term, template, weight = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(len(known) + 1)), template[order], weight[order]


def best_template(data: np.ndarray, bounds: np.ndarray, idf: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest template of each segment of ``data`` (between ``bounds``), and its cosine, by the templates' lists of the segment's terms."""
    known, each = vocabulary()
    n, n_templates = len(bounds) - 1, len(each)
    starts, hashes = terms(data, bounds)
    segment = np.searchsorted(bounds, starts, "right") - 1
    order = np.lexsort((hashes, segment))
    segment, hashes = segment[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(hashes)))
    segment, place = segment[at], _places(known, hashes[at])
    weight = tf * idf[place]
    norm = np.sqrt(np.bincount(segment, weights=weight**2, minlength=n))
    inner = np.flatnonzero(place < len(known))
    offsets, template, share = lists
    first = offsets[place[inner]]
    sizes = offsets[place[inner] + 1] - first
    of = np.repeat(inner, sizes)
    entry = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    dots = np.bincount(segment[of] * n_templates + template[entry], weights=weight[of] * share[entry], minlength=n * n_templates).reshape(n, n_templates)
    cosine = dots / np.where(norm > 0, norm, 1)[:, None]
    best = cosine.argmax(1)
    return best, cosine[np.arange(n), best]


def line_windows(data: np.ndarray, lines: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of WINDOWS the bytes of the windows with a sign, their bounds, and the text of each."""
    signs = np.array([m.start() for m in SIGN.finditer(data.tobytes())], np.int64)
    n = len(lines) - 1
    signed = np.unique(np.searchsorted(lines, signs, "right") - 1)
    text_of = np.searchsorted(at, lines[:-1], "right") - 1
    for size in WINDOWS:
        start = np.unique((signed[:, None] - np.arange(size)).ravel())
        start = start[(start >= 0) & (start + size <= n)]
        start = start[text_of[start] == text_of[start + size - 1]]
        # in blocks, as windows overlap
        for k in range(0, len(start), 4096):
            some = start[k : k + 4096]
            yield np.concatenate([data[lines[i] : lines[i + size]] for i in some]), np.concatenate([[0], np.cumsum(lines[some + size] - lines[some])]), text_of[some]


def own_licences(files: DataFrame, idf: np.ndarray) -> DataFrame:
    """``files`` (path, text) without the text, with is_licence_file, own_licence and cosine."""
    new = {"is_licence_file": T.BooleanType(), "own_licence": T.StringType(), "cosine": T.DoubleType()}
    keep = carried(files, *new, "text", "licence", "from_directory")
    lists = template_lists(idf)
    source = files.select(*keep, "text").withColumn("is_licence_file", F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES), F.lit(False)))
    names = [*keep, *new]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            data, at = W.text_buffer(part.column("text"))
            whole = part.column("is_licence_file").to_numpy(zero_copy_only=False)
            lines = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1]))
            licence, cosine = np.full(part.num_rows, None, object), np.zeros(part.num_rows)
            if len(lines) > 1:
                text_of = lambda bounds: np.searchsorted(at, bounds[:-1], "right") - 1
                compared = [(data, lines, text_of(lines))]
                if whole.any():
                    compared.append((data, np.unique(at), text_of(np.unique(at))))
                for k, (some, bounds, texts) in enumerate(itertools.chain(compared, line_windows(data, lines, at))):
                    best, score = best_template(some, bounds, idf, lists)
                    order = np.lexsort((best, -score, texts))
                    for j in order[np.unique(texts[order], return_index=True)[1]].tolist():
                        text = texts[j]
                        if score[j] > cosine[text] and (k != 1 or len(compared) == 1 or whole[text]):
                            cosine[text] = score[j]
                            licence[text] = templates()[best[j]][0] if score[j] >= MIN_COSINE else None
                for m in reversed(list(SPDX.finditer(data.tobytes()))):  # the first of a text wins
                    text = int(np.searchsorted(at, m.start(), "right")) - 1
                    cosine[text], licence[text] = 1.0, b" ".join(m[1].split()).decode()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("is_licence_file"), pa.array(licence, pa.string()), pa.array(np.round(cosine, 6))], names)

    return source.mapInArrow(run, T.StructType([*files.select(keep).schema.fields, *(T.StructField(k, v) for k, v in new.items())]))


def inherited(files: DataFrame) -> DataFrame:
    """``files`` with licence, and from_directory where a directory above gives it."""
    names = fresh(files, "dir", "key")
    dir_, key = names["dir"], names["key"]
    placed = files.withColumn(dir_, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn(key, F.coalesce(F.concat(F.lit("/"), F.col(dir_)), F.lit("")))
    directories = materialize(placed.groupBy(F.col(key).alias("key")).agg(F.first(dir_).alias("dir"), F.count("*").alias("n"), F.min(F.when(F.col("is_licence_file") & F.col("own_licence").isNotNull(), F.struct(-F.col("cosine"), "path", "own_licence"))).alias("best")), "directories")
    given = directories.where("best IS NOT NULL").select(F.col("dir").alias("above"), F.col("best.own_licence").alias("given"))
    parts = F.split("dir", "/")
    above = directories.where("dir IS NOT NULL").select("key", "dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = above.join(given, "above").groupBy("key").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    dims = directories.select("key", "n").join(nearest, "key", "left").select(F.col("key").alias(key), F.col("n").alias("directory_files"), F.col("near.above").alias("near_above"), F.col("near.given").alias("near_given"))
    own = own_names(files)
    renamed = placed.withColumnsRenamed(own)
    joined = join_keyed(renamed.drop(dir_), materialize(dims, "nearest"), key, "directory_files")
    licence = F.col(f"`{own['own_licence']}`")
    out = [F.col(f"`{name}`").alias(c) for c, name in own.items()]
    return joined.select(*out, F.coalesce(licence, "near_given").alias("licence"), F.when(licence.isNull(), F.col("near_above")).alias("from_directory"))


def scan(files: DataFrame) -> DataFrame:
    own = materialize(own_licences(files, inverse_frequencies(files)), "licences")
    return inherited(own)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/number/name; each twentieth one is a licence file, in source/lang."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    number = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("string")
    name = F.when(F.col("doc_id") % 20 == 7, "LICENSE").otherwise(F.concat(number, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name)
    return scan(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "is_licence_file", "own_licence", "cosine", "licence", "from_directory")
