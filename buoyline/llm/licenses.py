"""License scans: templates retrieved through MinHash bands over text windows, verified by exact containment.

Words are runs of letters and digits, lower-cased; a document is its run of
5-word shingles. Windows overlap by half: blocks of M shingles, two adjacent
blocks to a window, for block sizes M of 4, 8, 16, ... A template of m shingles
is looked for in windows of the smallest M of 1.25 * m or more, so each of its
occurrences, small edits included, lies whole in one window, where its
resemblance to the window is at least CONTAINED * m / (2 * M + m / 5). Every one
of BANDS MinHash values is a band of one row: the chance that none collides is
(1 - resemblance) ** BANDS, below 1e-4 for every template. Retrieved windows are
verified by exact shingle containment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from buoyline.llm import common, textops

SHINGLE = 5
CONTAINED = 0.8
BANDS = 96
LEAST_BLOCK = 4

# Well-known license notices and the names reported for them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "gpl-2.0": ["licensed under the GNU General Public License, version 2"],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

_WORD, _FOLD = textops.alphanumeric(), textops.lower_ascii()
_RNG = np.random.default_rng(20240202)
_MUL = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


@dataclass
class Index:
    """Templates by block size: their shingle sets and MinHash values."""

    names: list[str]
    sets: list[np.ndarray]
    block: list[int]
    mins: np.ndarray  # templates x BANDS
    sizes: list[int] = field(default_factory=list)
    rivals: np.ndarray | None = None  # templates that share half their shingles or more


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = textops.column_bytes(pa.array(texts, pa.string()))
    wh, woff, _ = textops.words(buf, offs, _WORD, _FOLD)
    h, soff, _ = textops.shingles(wh, woff, SHINGLE)
    return h, soff, woff


def build(templates: dict[str, list[str]]) -> Index:
    """The index of the templates; one of fewer words than a shingle is an error."""
    flat = [(name, t) for name, texts in templates.items() for t in texts]
    h, soff, woff = _hashes([t for _, t in flat])
    if (np.diff(woff) < SHINGLE).any():
        raise ValueError(f"a template needs {SHINGLE} words at least")
    sets = [np.unique(h[a:b]) for a, b in zip(soff[:-1], soff[1:])]
    block = [max(LEAST_BLOCK, 1 << (-(-5 * len(x) // 4) - 1).bit_length()) for x in sets]
    mins = np.array([[(s * a + b).min() for a, b in zip(_MUL, _ADD)] for s in sets], np.uint64).reshape(len(sets), BANDS)
    rivals = np.array([[2 * np.isin(a, b).sum() >= min(len(a), len(b)) for b in sets] for a in sets], bool).reshape(len(sets), len(sets))
    return Index([n for n, _ in flat], sets, block, mins, sorted(set(block)), rivals)


def _matches(index: Index, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, float]]:
    """(document, template, containment) of verified templates in shingles `h`, `doc` naming each one's document.

    Of rival templates that the same words match, only those of the highest containment count.
    """
    if not len(h):
        return []
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    starts = np.flatnonzero(place % LEAST_BLOCK == 0)
    of = doc[starts]
    ends = np.append(starts[1:], len(h))
    base = np.empty((BANDS, len(starts)), np.uint64)
    for i in range(BANDS):
        base[i] = np.minimum.reduceat(h * _MUL[i] + _ADD[i], starts)
    number = place[starts] // LEAST_BLOCK
    found, size = [], LEAST_BLOCK
    for want in index.sizes:
        while size < want:  # two blocks make one of the next size
            lead = np.flatnonzero(number % 2 == 0)
            base = np.minimum.reduceat(base, lead, axis=1)
            starts, of, ends, number, size = starts[lead], of[lead], np.append(ends[lead[1:] - 1], ends[-1]), number[lead] // 2, size * 2
        paired = base.copy()
        stop = ends.copy()
        joins = np.flatnonzero(of[1:] == of[:-1])
        paired[:, joins] = np.minimum(base[:, joins], base[:, joins + 1])
        stop[joins] = ends[joins + 1]
        for t in [t for t, b in enumerate(index.block) if b == want]:
            for w in np.flatnonzero((paired == index.mins[t][:, None]).any(0)).tolist():
                share = float(np.isin(index.sets[t], h[starts[w]:stop[w]]).mean())
                if share >= CONTAINED:
                    found.append((int(of[w]), t, share, *_stretch(index.sets[t], h, int(starts[w]), int(stop[w]))))
    return _unrivalled(index, found)


def _stretch(template: np.ndarray, h: np.ndarray, start: int, stop: int) -> tuple[int, int]:
    """Where in shingles start to stop the template stands: the stretch of 1.25 times its length with most matches, cut to them."""
    hit = np.isin(h[start:stop], template)
    size = min(len(hit), -(-5 * len(template) // 4))
    total = np.concatenate(([0], np.cumsum(hit)))
    at = int(np.argmax(total[size:] - total[:len(total) - size]))
    own = np.flatnonzero(hit[at:at + size])
    return start + at + int(own[0]), start + at + int(own[-1]) + 1


def _unrivalled(index: Index, found: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float]]:
    """The matches (document, template, containment, start, stop) that no better rival's words explain.

    A rival explains a match if its stretch covers half of the match's or more;
    related notices side by side both count. Stretches lie in one order of
    starts over all documents and their length is bounded, so each looks at its
    neighbours in that order only.
    """
    found = sorted(found, key=lambda f: f[3])
    reach = max((b - a for _, _, _, a, b in found), default=0)
    kept, low = [], 0
    for d, t, share, a, b in found:
        while found[low][3] <= a - reach:
            low += 1
        beaten = False
        for i in range(low, len(found)):
            e, u, more, x, y = found[i]
            if x >= b:
                break
            if d == e and more > share and index.rivals[t, u] and 2 * (min(b, y) - max(a, x)) >= b - a:
                beaten = True
                break
        if not beaten:
            kept.append((d, t, share))
    return kept


MATCH = StructType().add("license", "string").add("containment", "double")
RESULT = (("licenses", "string"), ("n_licenses", "long"), ("best_containment", "double"), ("matches", ArrayType(MATCH)))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's licenses: names joined by commas in order, their number, and the verified containments.

    Whole texts are scanned; null, empty and blank texts have none. A license
    counts once however often it occurs. Extra columns are left out.
    """
    index = build(TEMPLATES if templates is None else templates)
    rows = docs.select(common.column(key).alias("key"), F.col(text).cast("string").alias("text"))
    pairs = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64())]))

    def run(batches):
        for batch in batches:
            best: list[dict[str, float]] = [{} for _ in range(batch.num_rows)]
            buf, offs = textops.column_bytes(batch.column("text"))
            for i, j in textops.blocks(offs, 1 << 20):  # the bands of a block's words are held at once
                wh, woff, _ = textops.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], _WORD, _FOLD)
                h, soff, _ = textops.shingles(wh, woff, SHINGLE)
                for d, t, share in _matches(index, h, np.repeat(np.arange(i, j), np.diff(soff))):
                    best[d][index.names[t]] = max(share, best[d].get(index.names[t], 0.0))
            names = [sorted(b) for b in best]
            cols = [batch.column("key"), pa.array([",".join(n) for n in names], pa.string()), pa.array([len(n) for n in names], pa.int64()),
                    pa.array([max(b.values(), default=0.0) for b in best], pa.float64()),
                    pa.array([[{"license": x, "containment": b[x]} for x in n] for n, b in zip(names, best)], pairs)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "licenses", "n_licenses", "best_containment", "matches"])

    out = rows.select("key").schema
    for part in RESULT:
        out = out.add(*part)
    return rows.mapInArrow(run, out).withColumnRenamed("key", common.name(key))
