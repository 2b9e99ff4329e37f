"""Licence scans of file trees (operator 5).

Each line of a file and each of its blocks (lines between blank or comment-only ones, so that wrapped headers count as one) is
compared with licence statements and standard headers, and each file as a whole with full licence texts, by the cosine of sparse TF-IDF
vectors. A file that matches as a whole is a licence file; otherwise its own licence is its best line or block. Files
without one inherit from the licence file in the nearest ancestor directory, found by joins on directory paths.

A line or block is scored only if it holds a strong term. A statement's strong terms carry so much of its weight that a line
without any of them cannot reach the threshold, so nothing is missed. Each full text holds strong terms too, and a file
is compared as a whole if it has any.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import slices

# Usual statements of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Released under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("Proprietary", "All rights reserved. Proprietary and confidential"),
)
# Paragraphs of the standard headers.
_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format("program", ";", "", ";", "2")),
    ("GPL-3.0", _GNU.format("program", ":", "", ",", "3")),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser ", ";", "2.1")),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser ", ",", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero ", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)
#: Licences with a line "SPDX-License-Identifier: ...", and those of them whose full texts lie in the folder licences.
IDENTIFIERS = (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1",
    "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
)
FULL = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0")


@cache
def statements() -> tuple[tuple[str, str], ...]:
    """What lines and blocks are compared with: statements, headers, identifiers."""
    return *TEMPLATES, *HEADERS, *((re.sub("-(only|or-later)$", "", i), f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS)


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """What files are compared with: whole licences, and the statements, for files that hold nothing else."""
    folder = resources.files(__package__).joinpath("licences")
    return *((i, folder.joinpath(f"{i}.txt").read_text("utf-8")) for i in FULL), *TEMPLATES, *HEADERS


#: Usual English words, taken as strong terms only where nothing else is left.
COMMON = frozenset("a all an and any are as at be by for form from free in into is it made may not of on or out public that the this to under use was were which will with without work you".split())
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_BREAK = re.compile(r"\n(?=[^a-z0-9\n]*\n)")


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.7
    #: (licence, text) for lines and blocks, and for whole files; None: the ones above.
    statements: tuple[tuple[str, str], ...] | None = None
    full_texts: tuple[tuple[str, str], ...] | None = None


def terms(text: str) -> Counter:
    """Terms with A-Z lower-cased; digits and inner dots and hyphens count as letters."""
    return Counter(_TERM.findall(lowered(text)))


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Vectors:
    """Unit vectors of templates, with smoothed inverse document frequencies over them."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        counts = [terms(t) for _, t in templates]
        n = len(counts)
        found = Counter(t for c in counts for t in c)
        self.idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in found.items()}
        self.unseen = math.log(1 + n) + 1
        self.names = [name for name, _ in templates]
        self.units: list[dict[str, float]] = []
        self.lists: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            weights = {t: k * self.idf[t] for t, k in c.items()}
            whole = math.sqrt(sum(w * w for w in weights.values()))
            self.units.append({t: w / whole for t, w in weights.items()})
            for t, w in self.units[-1].items():
                self.lists.setdefault(t, []).append((i, w))

    def best(self, counts: Counter) -> tuple[float, str | None]:
        """The highest cosine and its licence; of equal ones the first template."""
        whole = math.sqrt(sum((k * self.idf.get(t, self.unseen)) ** 2 for t, k in counts.items()))
        dots = [0.0] * len(self.names)
        for t, k in counts.items():
            for i, v in self.lists.get(t, ()):
                dots[i] += k * self.idf[t] * v
        at = max(range(len(dots)), key=lambda i: (dots[i], -i), default=None)
        return (dots[at] / whole, self.names[at]) if whole and at is not None else (0.0, None)

    def strong(self, threshold: float) -> set[str]:
        """Terms without any of which no text reaches the threshold with any template, rare ones preferred."""
        out = set()
        for unit in self.units:
            left = 1.0  # a text without the strong terms so far reaches at most the root of this
            for t, w in sorted(unit.items(), key=lambda x: (x[0] in COMMON, len(x[0]) < 3, -self.idf[x[0]], -x[1], x[0])):
                if left < threshold**2 - 1e-9:
                    break
                out.add(t)
                left -= w * w
        return out


class Matcher:
    """Scans texts for licences."""

    def __init__(self, settings: Settings):
        self.threshold = settings.threshold
        self.lines, self.files = Vectors(settings.statements or statements()), Vectors(settings.full_texts or full_texts())
        strong = self.lines.strong(self.threshold)
        for unit in self.files.units:  # one that holds none of them is found by its heaviest term
            if not strong & unit.keys():
                strong.add(max(unit, key=lambda t: (unit[t], t)))
        self.pattern = re.compile("(?<![a-z0-9])(?:" + "|".join(sorted(map(re.escape, strong), key=lambda t: (-len(t), t))) + ")(?![a-z0-9])")

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """Licence, cosine and whether the file as a whole is the match."""
        top, seen, text = (0.0, None), -1, lowered(text)
        breaks, block = None, -1
        for hit in self.pattern.finditer(text):
            if hit.start() < seen:
                continue
            if breaks is None:  # ends of blocks: lines without a letter or digit
                breaks = [m.start() for m in _BREAK.finditer(text)]
            start, seen = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.end())
            seen = len(text) if seen < 0 else seen
            top = max(top, self.lines.best(terms(text[start:seen])), key=lambda x: x[0])
            at = bisect_left(breaks, start)
            low, high = breaks[at - 1] if at else 0, breaks[at] if at < len(breaks) else len(text)
            if at != block and (low + 1 < start or seen < high):  # more than the line
                top = max(top, self.lines.best(terms(text[low:high])), key=lambda x: x[0])
            block = at
        if breaks is None:
            return None, 0.0, False
        whole = self.files.best(terms(text))
        if whole[0] >= self.threshold:
            return whole[1], whole[0], True
        return (top[1], top[0], False) if top[0] >= self.threshold else (None, 0.0, False)


def scan(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``files`` (path, text, and further columns) without text, with own, score, licence_file, inherited_from, licence.

    own: the licence its text states, with its cosine as score (0.0 without one); inherited_from: the nearest ancestor directory with a licence file, for files without
    an own licence; licence: own or inherited. Texts are scanned once, whole, whatever their length. Null and empty texts and texts without a statement have none. A null path inherits
    nothing. In one directory the licence file with the highest cosine counts, then the least path. Repeated rows give repeated
    results. An empty table gives an empty result. Columns named like the results, in any case, are replaced; all others are kept, whatever their names.
    """
    added = ["own", "score", "licence_file", "inherited_from", "licence"]
    carried = [c for c in files.columns if c.lower() not in ("text", *added)]
    kept = [f"kept_{i}" for i in range(len(carried))]  # while it works, so that no name of a column can clash
    named = [F.col("`" + c.replace("`", "``") + "`") for c in carried]
    kinds = ", ".join(f"{k} {files.schema[c].dataType.simpleString()}" for k, c in zip(kept, carried, strict=True))

    def task(batches):
        matcher = Matcher(settings)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [matcher.scan(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in (*kept, "path")), pa.array([f[0] for f in found], pa.string()),
                    pa.array(np.array([f[1] for f in found], float)), pa.array([f[2] for f in found], pa.bool_()),
                ], [*kept, "path", "own", "score", "licence_file"])

    rows = files.select(*(c.alias(k) for k, c in zip(kept, named, strict=True)), F.col("path").alias("path"), F.col("text").alias("text"))
    scanned = rows.mapInArrow(task, ", ".join(filter(None, [kinds, "path string, own string, score double, licence_file boolean"])))
    scanned = scanned.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    # Written without the texts: it is read for the licence files, the directories and the result.
    return _inherited(materialize(scanned, "licence-scan")).select(*(F.col(k).alias(c) for k, c in zip(kept, carried, strict=True)), *added)


def _inherited(scanned: DataFrame) -> DataFrame:
    best = F.min_by("own", F.struct(-F.col("score"), "path"))
    granted = scanned.filter("licence_file and dir is not null").groupBy(F.col("dir").alias("above")).agg(best.alias("granted"))
    # Each directory once, with all its ancestors: rows follow directories, not files.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))
    dirs = scanned.filter("dir is not null").select("dir").distinct()
    near = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", F.col("a.at").alias("above")).join(granted, "above")
    near = near.groupBy("dir").agg(F.max_by(F.struct("above", "granted"), "depth").alias("near")).withColumnRenamed("dir", "own_dir")
    joined = scanned.join(near, F.col("dir") == F.col("own_dir"), "left")
    alone = F.col("own").isNull()
    return joined.withColumns({"inherited_from": F.when(alone, F.col("near.above")), "licence": F.coalesce("own", F.col("near.granted"))})
