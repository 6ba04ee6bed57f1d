"""License scans: MinHash bands over overlapping text windows retrieve license templates.

A text's shingle positions are cut into blocks, and each two neighbouring blocks make a window; a
template that is no longer than a block lies in a window wholly.  Templates are grouped by the least
power-of-two block that holds them.  For each group the number of bands follows from the least
Jaccard similarity of a window and a template at the threshold, so that a match is overlooked with a
probability of at most MISS.  Retrieved pairs are verified by exact shingle containment.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from undula.llm.common import id_column, named, slices, text_array
from undula.llm.shingles import mix, shingles

THRESHOLD = 0.8
#: Probability that a window at the threshold is overlooked, at most.
MISS = 1e-6
#: Shingle positions of the smallest block, and the most hash functions a group of templates may cost.
LEAST_BLOCK, MOST_HASHES = 4, 128

# Names and wording of public license notices.  Where licenses share a wording, a template ends
# soon enough after the name or version that differs for the others to hold less than THRESHOLD of it.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License,"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License,"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "terms of the Eclipse Public License v1.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bands(similarity: float, miss: float = MISS, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective setting within `most` hashes that overlooks `miss` at most.

    Where none is within `most`, rows is 1 and bands as many as it takes.
    """
    best = None
    for rows in range(1, 9):
        n = 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))
        if n * rows <= most or best is None:
            best = (n, rows)
    return best


class TemplateIndex:
    """Templates by group, with their MinHash band keys."""

    def __init__(self, templates: Iterable[tuple[str, str]], threshold: float = THRESHOLD, miss: float = MISS):
        self.threshold = threshold
        self.names, texts = zip(*[(n, t) for n, t in templates if t and t.strip()], strict=True)
        hashes, at = shingles(text_array(pa.array(texts, pa.large_string())))
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        by_block = defaultdict(list)
        for i, length in enumerate(np.diff(at)):
            by_block[max(LEAST_BLOCK, 1 << math.ceil(math.log2(length)))].append(i)
        self.groups = []
        for block, members in sorted(by_block.items()):
            sizes = [(len(self.sets[i]), math.ceil(threshold * len(self.sets[i]) - 1e-9)) for i in members]
            n, rows = bands(min(inside / (2 * block + q - inside) for q, inside in sizes), miss)
            seeds = mix(np.arange(1, n * rows + 1, dtype=np.uint64) * np.uint64(block)).astype(np.uint32) | np.uint32(1)
            keys = np.array([[self.hashed(self.sets[i], s).min() for s in seeds] for i in members], np.uint32)
            self.groups.append((block, members, n, rows, seeds, keys))

    @staticmethod
    def hashed(values: np.ndarray, seed: np.uint32) -> np.ndarray:
        """One of the hash functions of MinHash, as 32 bits."""
        v = (values >> np.uint64(32)).astype(np.uint32) * seed if values.dtype == np.uint64 else values * seed
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        return v

    def scan(self, texts: pa.Array) -> dict[tuple[int, int], float]:
        """The best containment of each (row, template) at or over the threshold."""
        hashes, at = shingles(texts)
        out: dict[tuple[int, int], float] = {}
        n = np.diff(at)
        for block, members, n_bands, rows, seeds, keys in self.groups:
            blocks = -(-n // block)
            first = np.concatenate(([0], np.cumsum(blocks)))
            if first[-1] == 0:
                continue
            owner = np.repeat(np.arange(len(n)), n)
            spot = first[owner] * block + np.arange(len(hashes)) - at[owner]  # each text begins at a block's start
            padded = np.zeros(first[-1] * block, np.uint32)
            padded[spot] = (hashes >> np.uint64(32)).astype(np.uint32)
            filled = np.zeros(len(padded), bool)
            filled[spot] = True
            empty = np.flatnonzero(~filled)
            text_of = np.repeat(np.arange(len(n)), blocks)
            alone = np.ones(first[-1], bool)  # blocks without a next one in their text
            alone[:-1] = text_of[1:] != text_of[:-1]
            pairs: set[tuple[int, int]] = set()
            for band in range(n_bands):
                same = None
                for row in range(rows):
                    k = band * rows + row
                    v = self.hashed(padded, seeds[k])
                    v[empty] = 0xFFFFFFFF
                    least = v[0::block].copy()
                    for j in range(1, block):
                        np.minimum(least, v[j::block], out=least)
                    window = least.copy()
                    np.minimum(window[:-1], least[1:], out=window[:-1], where=~alone[:-1])
                    equal = np.stack([window == key for key in keys[:, k]])
                    same = equal if same is None else same & equal
                pairs.update(zip(*map(np.ndarray.tolist, np.nonzero(same)), strict=True))
            for member, w in pairs:
                i, row = members[member], int(text_of[w])
                start = at[row] + (w - first[row]) * block
                share = float(np.isin(self.sets[i], hashes[start : min(start + 2 * block, at[row + 1])]).mean())
                if share >= self.threshold - 1e-12 and share > out.get((row, i), 0):
                    out[row, i] = share
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, license, containment): licenses of which a window of the text holds `threshold` or more.

    containment is the largest over the windows and the templates of that name.  Texts without words
    (null, empty, blank) give no row, repeated rows each give theirs, null ids are carried along; an
    empty table gives an empty result.  Ids are whole numbers.  Templates are a parameter of the caller's, part of the code.
    """
    index = TemplateIndex(list(templates), threshold)
    rows = docs.select(id_column(docs, id_col).alias("id"), named(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            best: dict[tuple[int, str], float] = {}
            for (row, i), share in index.scan(text_array(part.column("text"))).items():
                key = (row, index.names[i])
                best[key] = max(best.get(key, 0.0), share)
            found = sorted(best.items())
            own = part.column("id").take(pa.array([k[0] for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array([k[1] for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())], ["id", "license", "containment"])

    return rows.mapInArrow(run, "id bigint, license string, containment double").withColumnRenamed("id", id_col)
