"""License scans: TF-IDF cosine of lines, paragraphs and whole files to templates, and inheritance from ancestor directories.

A unit (a line, a paragraph or the whole of a file) and a template (a short
notice or the full text of a licence) are sparse vectors of term frequency
times inverse document frequency; document frequencies are exact counts of
files over the whole corpus. A file that as a whole is like a full text has
that licence, any other that of its best unit, if that is similar enough. A
file that is little more than its licence, or is named LICENSE or COPYING,
declares it for its directory; files without one inherit from their nearest
ancestor directory that has one, found by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import in_batches, small, stored

LEAST_COSINE = 0.6
FULL_COSINE = 0.75  # of a whole file or paragraph to a full text; unrelated legal texts share much of their wording
FILE_SHARE = 0.5  # of a file's words that its licence unit must hold to speak for the directory

# Short notices by which files state their licence.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.", "Licensed under the BSD 3-Clause License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
_OR_LATER = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} License "
             "as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.")
# The longer notices that the GNU licences ask for.
for _name, _words in {
    "GPL-2.0": ("program", ";", "General Public", ";", "2"), "GPL-3.0": ("program", ":", "General Public", ",", "3"),
    "LGPL-2.1": ("library", ";", "Lesser General Public", ";", "2.1"), "LGPL-3.0": ("library", ":", "Lesser General Public", ",", "3"),
    "AGPL-3.0": ("program", ":", "Affero General Public", ",", "3"),
}.items():
    TEMPLATES[_name] = (*TEMPLATES.get(_name, ()), _OR_LATER.format(*_words))


def full_texts() -> dict[str, str]:
    """The whole texts of licences, by name."""
    out = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in (resources.files("cellwarden.llm") / "license_texts").iterdir()
           if f.name.endswith(".txt")}
    # Not at hand: the GPL's text under the other's name, which tells the two apart.
    out["AGPL-3.0"] = re.sub(r"(?i)GNU General", "GNU Affero General", out["GPL-3.0"])
    return out


_TERM = re.compile(r"[0-9a-z]+(?:\.[0-9a-z]+)*")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[0-9a-z][0-9a-z.+-]*\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[0-9a-z][0-9a-z.+-]*\)*)*)", re.I)
_SPDX_ID = re.compile(r"(?<!with )[0-9a-z][0-9a-z.+-]*", re.I)


def terms(unit: str) -> Counter:
    return Counter(_TERM.findall(unit.lower()))


def terms_held(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


_OF_TEMPLATES = [(name, terms(t)) for name, texts in TEMPLATES.items() for t in texts]
_OF_FULL_TEXTS = [(name, terms(t)) for name, t in sorted(full_texts().items())]
VOCABULARY = sorted({t for _, c in _OF_TEMPLATES + _OF_FULL_TEXTS for t in c})
_BY_SPDX = {name.lower(): name for name, _ in _OF_TEMPLATES + _OF_FULL_TEXTS}


def spdx(line: str) -> str | None:
    """The first known licence that a line's SPDX tag names; "" for a tag without one, None without a tag.

    The tag is a template of its own for every licence. It has to agree in
    the licence, which is only a part of its terms.
    """
    m = _SPDX.search(line)
    if not m:
        return None
    ids = (re.sub(r"(-only|-or-later|\+)$", "", i.lower()) for i in _SPDX_ID.findall(" ".join(m[1].split())))
    return next((_BY_SPDX[i] for i in ids if i in _BY_SPDX), "")


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """(files, files that hold each term of the vocabulary), over all of ``docs``."""
    known = frozenset(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                total[""] += 1
                total.update(known & terms_held(t.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["term", "n"])

    rows = in_batches(docs.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}  # at most the vocabulary
    return found.pop("", 0), found


class Templates:
    """Templates of one kind under given weights of terms, indexed by term."""

    def __init__(self, templates: list[tuple[str, Counter]], idf: dict[str, float], rarest: float, least: float, damped: bool):
        self.idf, self.rarest, self.least, self.damped = idf, rarest, least, damped
        self.names = [name for name, _ in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, (_, counts) in enumerate(templates):
            weights = {t: self.tf(n) * idf[t] for t, n in counts.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                self.postings.setdefault(t, []).append((i, w / norm))
        self.known = frozenset(self.postings)

    def tf(self, n: int) -> float:
        return 1 + math.log(n) if self.damped else n

    def reachable(self, held: set[str]) -> bool:
        """Whether any unit of a file that holds these terms can reach ``least``.

        A cosine is at most the norm of the unit template's part in the shared terms.
        """
        squares = [0.0] * len(self.names)
        for t in self.known & held:
            for i, v in self.postings[t]:
                squares[i] += v * v
        return max(squares) >= (self.least - 1e-9) ** 2

    def best(self, found: Counter) -> tuple[float, str]:
        """(cosine, name) of the best template; equal cosines go to the later name. (0.0, "") if none reaches ``least``."""
        shared = self.known.intersection(found)
        tf, idf, rarest = self.tf, self.idf, self.rarest
        dots = [0.0] * len(self.names)
        for t in shared:
            w = tf(found[t]) * idf[t]
            for i, v in self.postings[t]:
                dots[i] += w * v
        norm = math.sqrt(sum((tf(n) * idf.get(t, rarest)) ** 2 for t, n in found.items()))
        got = max(((round(d / norm, 12), name) for d, name in zip(dots, self.names, strict=True)), default=(0.0, "")) if norm else (0.0, "")
        return got if got[0] >= self.least else (0.0, "")


class Scorer:
    """Cosines of units to the templates under given document frequencies; unknown terms weigh as the rarest."""

    def __init__(self, files: int, frequencies: dict[str, int]):
        idf = {t: math.log((1 + files) / (1 + frequencies.get(t, 0))) + 1 for t in VOCABULARY}
        rarest = math.log(1 + files) + 1
        self.notices = Templates(_OF_TEMPLATES, idf, rarest, LEAST_COSINE, damped=False)
        # In long texts plain counts are mostly of the words that all texts share.
        self.full = Templates(_OF_FULL_TEXTS, idf, rarest, FULL_COSINE, damped=True)

    def of_file(self, text: str | None) -> tuple[str | None, float, int, int]:
        """(licence, cosine, words of its unit, words of the file); ties go to the first unit, the cosine is 0 without a licence."""
        text = text or ""
        size = len(text.split())
        held = terms_held(text)
        kinds = [k for k in (self.notices, self.full) if k.reachable(held)]
        if not kinds and not _SPDX.search(text):
            return None, 0.0, 0, size
        best, words = (0.0, ""), 0
        whole: Counter = Counter()
        run: Counter = Counter()  # the terms of a paragraph; a line with an SPDX tag is a unit of its own
        run_lines = run_words = lines = 0

        def better(found: Counter, n: int) -> None:
            nonlocal best, words
            got = max((k.best(found) for k in kinds), default=(0.0, ""))
            if got[0] > best[0]:
                best, words = got, n

        for line in [*text.split("\n"), ""]:
            if not line.strip():
                if run_lines > 1:
                    better(run, run_words)
                run, run_lines, run_words = Counter(), 0, 0
                continue
            found, n, tag = terms(line), len(line.split()), spdx(line)
            whole.update(found)
            lines += 1
            if tag is None:
                run.update(found)
                run_lines, run_words = run_lines + 1, run_words + n
                better(found, n)
            elif tag and best[0] < 1:
                best, words = (1.0, tag), n
        if lines > 1:
            full = self.full.best(whole) if self.full in kinds else (0.0, "")
            if full[0]:
                best, words = full, size
            else:
                better(whole, size)
        return (best[1], best[0], words, size) if best[0] else (None, 0.0, 0, size)


def own_licenses(files: DataFrame) -> DataFrame:
    """path, doc_id, license, cosine, unit_words, file_words for each row of ``files`` (doc_id, path, text)."""
    scorer = Scorer(*document_frequencies(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer.of_file(t.as_py()) for t in batch.column("text")]
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("path"), *[pa.array([g[i] for g in got], t) for i, t in enumerate(types)]],
                names=["doc_id", "path", "license", "cosine", "unit_words", "file_words"])

    return in_batches(
        files.select("doc_id", "path", "text"), run, "doc_id long, path string, license string, cosine double, unit_words long, file_words long")


# LICENSE, COPYING and the like, with a licence's name or the ending of a text; not a program about licences.
LICENSE_FILE = (r"(^|/)(?i:(un)?licen[cs]es?|copying|copyright)([-_][0-9A-Za-z+]+(\.[0-9]+)?)*"
                r"(\.((?i:txt|md|rst|html?)|[A-Z][A-Z0-9.+-]*))?$")


def directory(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def licenses(files: DataFrame, file_share: float = FILE_SHARE) -> DataFrame:
    """doc_id, path, license, cosine, inherited, license_dir for each row of ``files`` (doc_id, path, text).

    * A null or empty text has no licence of its own and may inherit one.
    * A null path lies in no directory and neither gives nor inherits.
    * Where several files speak for one directory the highest cosine wins,
      then the least path; equal cosines of templates go to the later name.
    * Repeated rows are answered alike; an empty table gives an empty result.
    """
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"),
                         F.col("text").cast("string").alias("text"))
    rows = stored(own_licenses(files).withColumn("dir", directory(F.col("path"))), "licenses")
    alone = (F.col("unit_words") >= file_share * F.col("file_words")) | F.col("path").rlike(LICENSE_FILE)
    speaks = rows.filter(F.col("license").isNotNull() & alone)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license"))
    given = speaks.filter("dir is not null").groupBy("dir").agg(best.alias("b")).select(
        F.col("dir").alias("license_dir"), F.col("b.license").alias("dir_license"))
    # Each distinct directory once, with itself and all its ancestors.
    dirs = rows.select("dir").filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    chain = dirs.select("dir", F.explode(F.array_distinct(above)).alias("license_dir"))
    nearest = (chain.join(given, "license_dir").groupBy("dir")
               .agg(F.max_by(F.struct("license_dir", "dir_license"), F.length("license_dir")).alias("n"))
               .select("dir", "n.license_dir", "n.dir_license"))
    out = rows.join(small(stored(nearest, "nearest")), "dir", "left")
    own = F.col("license").isNotNull()
    return out.select("doc_id", "path", F.coalesce("license", "dir_license").alias("license"), "cosine",
                      (~own & F.col("dir_license").isNotNull()).alias("inherited"),
                      F.when(~own, F.col("license_dir")).alias("license_dir"))
