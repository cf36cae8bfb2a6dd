"""License scans: MinHash bands retrieve templates, exact containment verifies them.

Templates and texts are normalised alike (A-Z lower-cased, words are runs of
letters, digits and non-ASCII characters) and cut into shingles of ``length``
words; a template of fewer words is one shingle. Templates are sorted into
classes by size. For a class of up to L words every text is cut into overlapping
windows of 2 L words, one every L words, so that any occurrence lies whole in a
window.

A template of more than L / 2 words that is contained to a share c has at least
a Jaccard similarity of about c / 4 with such a window. With bands of one MinHash
each, ``BANDS`` of them miss it with probability (1 - c / 4) ** BANDS: for
c = 0.8 and 64 bands less than one in a million. Templates of one or two shingles,
for which that does not hold, are looked up by the shingles themselves. What is retrieved is verified
by exact containment of the template's shingles in the window.

Containment alone can't tell siblings apart: the notices of two versions, or of
the GPL and the LGPL, share most shingles. A template may therefore have marks,
phrases that must stand in the window word for word. For a notice of one sentence
that is the whole notice, for a full text its title or the clause that its
siblings lack. Where one template holds another (BSD-3 holds BSD-2, the notice
with a version the one without), the larger is reported.

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netresil.llm.text import IS_ALNUM, Words, bound_batches, chunks, mix, raw, windows, word_hashes, words

LENGTH, CONTAINMENT, BANDS = 3, 0.8, 64
#: Words of templates broadcast at once; more are scanned in several parts.
TEMPLATE_WORDS = 2_000_000
_SMALLEST = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Common notices, as published with the licenses.
NOTICES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}


_PROGRAM = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
_FSF = "as published by the Free Software Foundation"

#: Further notices of one sentence, of the siblings of those above.
FURTHER = [
    *((f"gpl-{v}", f"This work is licensed under the GNU General Public License, version {v[0]}.") for v in ("1.0", "2.0")),
    *((f"{k}-{v}", f"This work is licensed under the GNU {name} General Public License, version {n}.")
      for k, name, v, n in (("lgpl", "Lesser", "2.1", "2.1"), ("lgpl", "Lesser", "3.0", "3"), ("agpl", "Affero", "3.0", "3"))),
    *((f"{k}-notice", f"This {what} {_PROGRAM} {name} General Public License {_FSF}")
      for k, name in (("lgpl", "Lesser"), ("agpl", "Affero")) for what in ("program", "library")),
    ("gpl-notice", f"This library {_PROGRAM} General Public License {_FSF}"),
    *((f"{k}-{v}-{'or-later' if later else 'only'}", f"This {what} {_PROGRAM} {name} General Public License {_FSF}{comma} {'either ' if later else ''}version {n} of the License{', or (at your option) any later version' if later else ''}")
      for k, name, v, n in (("gpl", "", "2.0", "2"), ("gpl", "", "3.0", "3"), ("lgpl", "Lesser", "2.1", "2.1"), ("lgpl", "Lesser", "3.0", "3"), ("agpl", "Affero", "3.0", "3"))
      for what in ("program", "library") for later, comma in ((True, ";"), (False, ","))),
    *((f"cc-{k}-4.0", f"This work is licensed under a Creative Commons Attribution-{name} 4.0 International License.")
      for k, name in (("by-nd", "NoDerivatives"), ("by-nc", "NonCommercial"), ("by-nc-sa", "NonCommercial-ShareAlike"), ("by-nc-nd", "NonCommercial-NoDerivatives"))),
    *((f"cc-{k.lower()}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
]

#: Full texts (``license_texts``) and the phrase that tells each from its siblings.
FULL = {
    "apache-2.0": "Apache License Version 2.0, January 2004",
    "artistic-1.0": "The intent of this document is to state the conditions under which a Package may be copied",
    "bsd-2-clause": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-3-clause": "may be used to endorse or promote products derived from this software",
    "bsd-4-clause": "All advertising materials mentioning features or use of this software",
    "cc-by-sa-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc0-1.0": "CC0 1.0 Universal",
    "epl-1.0": "Eclipse Public License - v 1.0",
    "gfdl-1.2": "GNU Free Documentation License Version 1.2, November 2002",
    "gfdl-1.3": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "gpl-1.0": "GNU General Public License Version 1, February 1989",
    "gpl-2.0": "GNU General Public License Version 2, June 1991",
    "gpl-3.0": "GNU General Public License Version 3, 29 June 2007",
    "isc": "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-2.0": "GNU Library General Public License Version 2, June 1991",
    "lgpl-2.1": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl-3.0": "GNU Lesser General Public License Version 3, 29 June 2007",
    "mit": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mpl-1.1": "Mozilla Public License Version 1.1",
    "mpl-2.0": "Mozilla Public License Version 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib": "Altered source versions must be plainly marked as such",
}


def notices(spark: SparkSession) -> DataFrame:
    """The notices of the first list as ``license, text``."""
    return spark.createDataFrame(list(NOTICES.items()), "license string, text string")


def known_licenses(spark: SparkSession) -> DataFrame:
    """All notices and full texts as ``license, text, mark``; a notice is its own mark."""
    at = Path(__file__).parent / "license_texts"
    short = [(name, text, text) for name, text in [*NOTICES.items(), *FURTHER]]
    full = [(name, (at / f"{name}.txt").read_text(encoding="utf-8"), mark) for name, mark in FULL.items()]
    return spark.createDataFrame(short + full, "license string, text string, mark string")


def _shingles(w: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; ``_NONE`` where the text ends before."""
    out = np.full(len(w), _NONE, np.uint64)
    h = windows(word_hashes(w), size)
    doc = w.documents()
    whole = np.flatnonzero(doc[: len(h)] == doc[size - 1 :])
    out[whole] = h[whole]
    return out


def _level(n: int) -> int:
    """The class of a template: the smallest power of two from four on that holds it."""
    return max(_SMALLEST, 1 << (n - 1).bit_length())


class Templates:
    """Shingles and band values of all templates, by shingle size and class; words of their marks."""

    def __init__(self, rows: list[tuple[str, str, str | None]], length: int, bands: int, containment: float = CONTAINMENT):
        self.seeds = mix(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
        self.names, self.sets, self.groups, self.marks, self.whole = [], [], {}, [], []
        w = words(pa.array([r[1] for r in rows], pa.string()), True, IS_ALNUM)
        count = np.diff(w.bounds)
        m = words(pa.array([r[2] for r in rows], pa.string()), True, IS_ALNUM)
        marked, hashes = word_hashes(m), word_hashes(w)
        shingles, of = {}, []
        for size in range(1, length + 1):
            shingles[size] = all_shingles = _shingles(w, size) if len(w) else np.zeros(0, np.uint64)
            for d in np.flatnonzero(np.minimum(count, length) == size).tolist():
                own = all_shingles[w.bounds[d] : w.bounds[d + 1]]
                own = np.unique(own[own != _NONE])
                self.groups.setdefault(size, {}).setdefault(_level(int(count[d])), []).append(len(self.sets))
                self.names.append(rows[d][0])
                self.sets.append(own)
                mark = marked[m.bounds[d] : m.bounds[d + 1]]
                self.marks.append(mark)
                self.whole.append(np.array_equal(mark, hashes[w.bounds[d] : w.bounds[d + 1]]))
                of.append((d, size))
        # A marked template isn't reported where a larger one stands that would match it by itself.
        self.explains: list[set] = [set() for _ in self.sets]
        for t, (_, size) in enumerate(of):
            if len(self.marks[t]):
                for u, (d, _) in enumerate(of):
                    if len(self.marks[u]) and count[d] > count[of[t][0]]:
                        held = shingles[size][w.bounds[d] : w.bounds[d + 1]]
                        if np.isin(self.sets[t], held).mean() >= (1.0 if self.whole[t] else containment):
                            self.explains[u].add(t)
        # Shingles of the templates that have at most two, and whose they are.
        self.direct: dict[int, dict[int, list[int]]] = {size: {} for size in self.groups}
        for t, (_, size) in enumerate(of):
            if len(self.sets[t]) <= 2:
                for v in self.sets[t].tolist():
                    self.direct[size].setdefault(v, []).append(t)
        self.level = [_level(int(count[d])) for d, _ in of]
        self.bands = {}
        for size, levels in self.groups.items():
            for level, members in levels.items():
                least = np.array([[(self.sets[t] * a).min() for t in members] for a in self.seeds])
                order = np.argsort(least, axis=1)
                self.bands[size, level] = np.take_along_axis(least, order, axis=1), np.array(members)[order]

    def candidates(self, w: Words, size: int, shingles: np.ndarray) -> dict[int, set]:
        """Per class: pairs (first word of a window, template) that agree in a band."""
        levels = sorted(self.groups[size])
        found: dict[int, set] = {level: set() for level in levels}
        count = np.diff(w.bounds)
        # Blocks of the smallest class; a larger class joins two neighbours of a text at a time.
        steps, span, per = [], _SMALLEST, -(-count // _SMALLEST)
        first = np.repeat(w.bounds[:-1], per) + (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)) * span
        steps.append((span, None, first, np.repeat(np.arange(len(per)), per)))
        while span < levels[-1]:
            span *= 2
            at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
            pick = np.flatnonzero(at % 2 == 0)
            per = -(-per // 2)
            steps.append((span, pick, steps[-1][2][pick], steps[-1][3][pick]))
        for b, a in enumerate(self.seeds):
            values = shingles * a
            values[shingles == _NONE] = _NONE
            least = None
            for span, pick, starts, doc in steps:
                least = np.minimum.reduceat(values, starts) if pick is None else np.minimum.reduceat(least, pick)
                if span not in found:
                    continue
                pair = least.copy()
                same = np.flatnonzero(doc[1:] == doc[:-1])
                pair[same] = np.minimum(least[same], least[same + 1])
                keys, members = self.bands[size, span][0][b], self.bands[size, span][1][b]
                at = np.searchsorted(keys, pair)
                for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == pair).tolist():
                    j = int(at[i])
                    while j < len(keys) and keys[j] == pair[i]:
                        found[span].add((int(starts[i]), int(doc[i]), int(members[j])))
                        j += 1
        if self.direct[size]:
            spans = {span: (starts, doc) for span, _, starts, doc in steps}
            for p in np.flatnonzero(np.isin(shingles, np.array(list(self.direct[size]), np.uint64))).tolist():
                for t in self.direct[size][int(shingles[p])]:
                    starts, doc = spans[self.level[t]]
                    i = int(np.searchsorted(starts, p, side="right")) - 1
                    for b in (i - 1, i):
                        if b >= 0 and doc[b] == doc[i]:
                            found[self.level[t]].add((int(starts[b]), int(doc[b]), t))
        return found


def _stands(held: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where the words of a mark stand one after the other."""
    at = np.flatnonzero(held[: max(0, len(held) - len(mark) + 1)] == mark[0])
    for j in range(1, len(mark)):
        at = at[held[at + j] == mark[j]]
    return at


def _find(column: pa.Array, templates: Templates, containment: float) -> list[list[dict]]:
    w = words(column, True, IS_ALNUM)
    out: list[list[dict]] = [[] for _ in range(len(w.bounds) - 1)]
    if not len(w):
        return out
    best: dict = {}
    hashes = word_hashes(w)
    for size in templates.groups:
        shingles = _shingles(w, size)
        for level, pairs in templates.candidates(w, size, shingles).items():
            for start, doc, t in pairs:
                held = shingles[start : min(start + 2 * level, w.bounds[doc + 1])]
                share = np.isin(templates.sets[t], held).mean()
                if share < containment:
                    continue
                mark = templates.marks[t]
                if len(mark):
                    at = _stands(hashes[start : start + len(held)], mark)
                    if not len(at):
                        continue
                    if templates.whole[t]:
                        kept = best.setdefault((doc, t), [])
                        known = {m[0] for m in kept}
                        kept += [[a, a + len(mark), 1.0] for a in (at + start).tolist() if a not in known]
                        continue
                at = np.flatnonzero(np.isin(held, templates.sets[t]))
                first, last = start + int(at[0]), start + int(at[-1]) + size
                kept = best.setdefault((doc, t), [])
                for m in kept:
                    if first < m[1] and m[0] < last:
                        if share > m[2]:
                            m[:] = [first, last, share]
                        break
                else:
                    kept.append([first, last, share])
    larger: dict = {}
    for (doc, t), runs in best.items():
        for x in templates.explains[t]:
            larger.setdefault((doc, x), []).extend(runs)
    for key in larger.keys() & best.keys():
        best[key] = [m for m in best[key] if not any(m[0] < y[1] and y[0] < m[1] for y in larger[key])]
    if best:
        data, offsets = raw(column)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        for (doc, t), runs in best.items():
            base = chars[offsets[doc]]
            for first, last, share in runs:
                out[doc].append({"license": templates.names[t], "start": int(chars[w.starts[first]] - base), "stop": int(chars[w.ends[last - 1]] - base), "containment": float(share)})
    return [sorted(found, key=lambda m: (m["start"], m["stop"], m["license"])) for found in out]


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("containment", pa.float64())]))
_DDL = "licenses array<struct<license:string,start:int,stop:int,containment:double>>"


def license_scan(
    texts: DataFrame, templates: DataFrame, text_col: str = "text", license_col: str = "license", template_col: str = "text",
    length: int = LENGTH, containment: float = CONTAINMENT, bands: int = BANDS, template_words: int = TEMPLATE_WORDS, mark_col: str | None = None,
) -> DataFrame:
    """All columns of ``texts`` with ``licenses``: what was found, in the order of the text.

    Each match has the template's id, character offsets in the original text
    and the share of the template's shingles in the window, at least
    ``containment``. Overlapping matches of one template are one. Null and empty
    texts, templates without id, text or words, match nothing; a repeated
    template counts once. A column named ``licenses`` is replaced.

    With ``mark_col`` a template matches only where the words of its mark stand
    too; one whose mark is its whole text must stand word for word, and each
    place is a match. A marked template is left out where a larger one of the
    same part overlaps that holds it. A null or empty mark asks for nothing.

    Templates are collected and broadcast; their size is checked, and beyond
    ``template_words`` (counted by their spaces) they are scanned in parts, one
    after the other within the same task.
    """
    bound_batches(texts)
    given = templates.where(F.col(license_col).isNotNull() & F.col(template_col).isNotNull()).select(
        F.col(license_col).cast("string").alias("license"), F.col(template_col).alias("body"),
        (F.col(mark_col) if mark_col else F.lit(None)).cast("string").alias("mark")).distinct()
    total = given.agg(F.sum(F.length("body") - F.length(F.replace("body", F.lit(" "), F.lit(""))) + 1)).first()[0] or 0
    parts = max(1, -(-total // template_words))
    keep = [c for c in texts.columns if c != "licenses"]
    out = texts.select(*keep, F.col(text_col).alias("__body"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields)
    for part in range(parts):
        mine = given if parts == 1 else given.where(F.pmod(F.xxhash64("license", "body"), F.lit(parts)) == part)
        held = texts.sparkSession.sparkContext.broadcast(Templates(sorted(((r[0], r[1], r[2]) for r in mine.toLocalIterator()), key=lambda r: (r[0], r[1], r[2] or "")), length, bands, containment))
        last = part == parts - 1

        def scan(batches: Iterator[pa.RecordBatch], held=held, first=part == 0, last=last) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "__body"):
                found = _find(batch.column("__body"), held.value, containment)
                if not first:
                    found = [sorted(a + b, key=lambda m: (m["start"], m["stop"], m["license"])) for a, b in zip(found, batch.column("licenses").to_pylist())]
                names = keep if last else [*keep, "__body"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, _FOUND)], names=[*names, "licenses"])

        fields = [kept] if kept else []
        out = out.mapInArrow(scan, ", ".join([*fields, *([] if last else ["__body string"]), _DDL]))
    return out
