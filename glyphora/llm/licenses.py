"""License scan: base phrases, and license texts by diagonal voting.

Hashes of all rolling word k-grams of the documents are joined in Spark to the template positions of the same
hash. Each hit votes for a diagonal (document position less template position); votes are added per document,
template and diagonal. The diagonal with the most votes and those near it are one place, so that it can't drift further. Its words are compared with the
template's, one by one and in order, and it is a span if enough of them agree. Of spans that overlap, the best stay: licenses are much alike.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from glyphora.llm._common import keyed, text_steps, window_hashes, words_of, written

#: Words of a rolling gram; share of a template's words that must stand in a span, in order.
K, COVER = 5, 0.6
#: How far, as a share of the template's words, a place's diagonals may lie from that with the most votes: words put in or left out on the way.
DRIFT = 0.1
#: Least number of grams of a template: shorter texts are phrases, and diagonals add nothing to them.
LEAST = 15
#: Documents with votes that are broadcast to the texts at most; more are joined by a shuffle.
SMALL = 100_000
#: Phrases and their labels. Fixed values of the task.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public license texts, or the notices that licenses ask to be put into files, and their labels.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""


def _gnu(name: str, version: str) -> str:
    """The notice of a GNU license."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software
    Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
    WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


def _cc(name: str, path: str) -> str:
    """The notice of a Creative Commons license."""
    return f"""This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit
    http://creativecommons.org/licenses/{path}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""


TEMPLATES = [
    ("mit", _MIT), ("bsd", _BSD), ("isc", _ISC), ("apache-2.0", _APACHE), ("mpl-2.0", _MPL), ("unlicense", _UNLICENSE), ("zlib", _ZLIB),
    ("gpl-2.0", _gnu("General Public License", "2")), ("gpl-3.0", _gnu("General Public License", "3")), ("lgpl-2.1", _gnu("Lesser General Public License", "2.1")),
    ("lgpl-3.0", _gnu("Lesser General Public License", "3")), ("agpl-3.0", _gnu("Affero General Public License", "3")),
    ("cc-by-4.0", _cc("Attribution", "by")), ("cc-by-sa-4.0", _cc("Attribution-ShareAlike", "by-sa")), ("cc-by-nc-4.0", _cc("Attribution-NonCommercial", "by-nc")),
    ("cc-by-nd-4.0", _cc("Attribution-NoDerivatives", "by-nd")), ("cc-by-nc-sa-4.0", _cc("Attribution-NonCommercial-ShareAlike", "by-nc-sa")),
]
#: Other bytes than digits, letters (A-Z in lower case) and those of non-ASCII characters become spaces.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def license_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts end to end, and how many each has."""
    raw = [(x or b"").translate(_WORD) for x in texts.cast(pa.binary()).to_pylist()]
    return words_of(pa.array(raw, pa.large_binary()).cast(pa.large_string()))


def _hashes(flat: pa.Array) -> np.ndarray:
    """A hash of each word."""
    coded = flat.dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    return np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in known), np.uint64, len(known))[coded.indices.to_numpy()]


def _grams(flat: pa.Array, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams of texts end to end, and how many each has."""
    hashes = _hashes(flat)
    grams = window_hashes(hashes, k)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(hashes))
    return grams[room[: len(grams)] >= k].view(np.int64), np.maximum(sizes - k + 1, 0)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def read(docs: DataFrame, keep: list[str], phrases: dict[str, str], k: int) -> DataFrame:
    """The columns `keep` of every row of docs, n_words, n_base, first_word, last_word, base array<string>, grams array<long>: one pass over the texts."""
    wanted = {p.encode(): label for p, label in phrases.items()}
    more = ["n_words", "n_base", "first_word", "last_word", "base", "grams"]
    schema = docs.select(*keep).schema
    for name in more[:4]:
        schema = schema.add(name, "long")
    schema = schema.add("base", ArrayType(StringType())).add("grams", ArrayType(LongType()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "_text"):
                flat, sizes = license_words(part.column("_text"))
                coded = flat.dictionary_encode()
                number = {w: i for i, w in enumerate(coded.dictionary.cast(pa.large_binary()).to_pylist())}
                words, ends = coded.indices.to_numpy(), np.cumsum(sizes)
                begins = ends - sizes
                count, first, last = np.zeros(len(sizes), np.int64), np.full(len(sizes), np.iinfo(np.int64).max), np.full(len(sizes), -1)
                labels: list[list[str]] = [[] for _ in sizes]
                for phrase, label in wanted.items():
                    ids = [number.get(w, -1) for w in phrase.split()]
                    if -1 in ids or len(words) < len(ids):
                        continue
                    at = np.flatnonzero(words[: len(words) - len(ids) + 1] == ids[0])
                    for j, i in enumerate(ids):
                        at = at[words[at + j] == i]
                    doc = np.searchsorted(ends, at, side="right")
                    whole = at + len(ids) <= ends[doc]
                    at, doc = at[whole], doc[whole]
                    np.add.at(count, doc, 1)
                    np.minimum.at(first, doc, at - begins[doc])
                    np.maximum.at(last, doc, at - begins[doc])
                    for d in np.unique(doc).tolist():
                        labels[d].append(label)
                none = count == 0
                grams, n = _grams(flat, sizes, k)
                cols = [pa.array(sizes), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(set(x)) for x in labels], pa.list_(pa.string())), _lists(pa.array(grams), n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*keep, *more])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(kernel, schema)


def _template_words(templates: list[tuple[str, str]], k: int) -> list[list[bytes]]:
    out = [license_words(pa.array([text]))[0].cast(pa.large_binary()).to_pylist() for _, text in templates]
    if short := [templates[t][0] for t, words in enumerate(out) if len(words) - k + 1 < LEAST]:
        raise ValueError(f"templates of fewer than {LEAST} grams are phrases: {short}")
    return out


def template_grams(spark, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """(h, places array<struct<template, at>>): where each gram stands in the templates; a list in the driver, as long as the templates."""
    places: dict[int, list] = {}
    for t, (_, text) in enumerate(templates):
        for at, h in enumerate(_grams(*license_words(pa.array([text])), k)[0].tolist()):
            places.setdefault(h, []).append((t, at))
    return spark.createDataFrame(list(places.items()), "h long, places array<struct<template:int,at:int>>")


def _running(template: list, words: list) -> list[int]:
    """Length of the longest common subsequence of a template with the words up to each: a bit per word of the template."""
    at: dict = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    full = rest = (1 << len(template)) - 1
    out = []
    for w in words:
        hit = rest & at.get(w, 0)
        rest = (rest + hit | rest & ~at.get(w, 0)) & full
        out.append(len(template) - rest.bit_count())
    return out


def aligned(template: list, words: list) -> tuple[float, int, int]:
    """(covered, first, end): the shortest run of words that holds as many of the template's words in order as all of them do, and how many these are as a share of
    the longer of both."""
    found = _running(template, words)
    if not found or not found[-1]:
        return 0.0, 0, 0
    n = found[-1]
    end = found.index(n) + 1
    first = end - 1 - _running(template[::-1], words[:end][::-1]).index(n)
    return n / max(len(template), end - first), first, end


def diagonals(votes: list[tuple[int, int]], drift: int) -> list[int]:
    """votes (diagonal, number) of one document and template -> the diagonal with the most votes of each place: others within `drift` of it are of that place."""
    out, left = [], dict(votes)
    for diagonal, _ in sorted(votes, key=lambda v: (-v[1], v[0])):
        if diagonal in left:
            out.append(diagonal)
            for near in range(diagonal - drift, diagonal + drift + 1):
                left.pop(near, None)
    return out


def _best(found: list[tuple]) -> list[tuple]:
    """Spans (covered, start, end, …) that no better one overlaps."""
    out, taken = [], []
    for covered in sorted({x[0] for x in found}, reverse=True):
        own = [x for x in found if x[0] == covered and not any(x[1] < e and s < x[2] for s, e in taken[max(0, bisect(taken, (x[1], 0)) - 1) : bisect(taken, (x[2], 0))])]
        out += own
        merged: list[tuple[int, int]] = []
        for s, e in sorted(taken + [(x[1], x[2]) for x in own]):  # taken places, joined where they overlap
            if merged and s <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(merged[-1][1], e)
            else:
                merged.append((s, e))
        taken = merged
    return out


def _verified(templates: list[tuple[str, str]], k: int, cover: float):
    """Kernel: (did, th, text, votes) -> (did, th, label, template, start, end, covered) of verified spans."""
    words_of_template = _template_words(templates, k)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for did, th, text, votes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = license_words(pa.array([text]))[0].cast(pa.large_binary()).to_pylist()
                by: dict[int, list] = {}
                for v in votes:
                    by.setdefault(v["template"], []).append((v["diagonal"], v["n"]))
                found = []
                for t, own in by.items():
                    template = words_of_template[t]
                    drift = max(3, int(DRIFT * len(template)))
                    for diagonal in diagonals(own, drift):
                        begin = max(0, diagonal - drift)
                        covered, first, end = aligned(template, words[begin : diagonal + len(template) + drift])
                        if covered >= cover:
                            found.append((covered, begin + first, begin + end, t))
                out += [(did, th, templates[t][0], t, first, end, covered) for covered, first, end, t in _best(found)]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["did", "th", "label", "template", "start", "end", "covered"])

    return kernel


def _joined(rows: DataFrame, keep: list[str], templates: list[tuple[str, str]], phrases: dict[str, str], k: int) -> DataFrame:
    """rows (did, th, text) -> keep, pos, places and base (a struct), written: a row per gram that stands in a template, and one per row of `rows`, its first gram
    or none, which alone has base."""
    own = read(rows, keep, phrases, k)
    about = ["n_words", "n_base", "first_word", "last_word", "base"]
    each = own.select(*keep, F.struct(*about).alias("base"), F.posexplode_outer("grams").alias("pos", "h"))
    joined = each.join(F.broadcast(template_grams(rows.sparkSession, templates, k)), "h", "left")  # a driver's list, as long as the templates
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return written(joined.where(first | F.col("places").isNotNull()).select(*keep, F.when(first, F.col("base")).alias("base"), "pos", "places"), "grams")


def _spans(rows: DataFrame, joined: DataFrame, templates: list[tuple[str, str]], k: int, cover: float) -> DataFrame:
    hits = joined.where("places is not null").select("did", "th", "pos", F.explode("places").alias("x")).select("did", "th", "pos", "x.template", "x.at").distinct()
    votes = hits.groupBy("did", "th", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("n"))
    by_doc = votes.groupBy("did", "th").agg(F.collect_list(F.struct("template", "diagonal", "n")).alias("votes"))  # fewer than the document has words
    by_doc = written(by_doc, "votes")
    by_doc = F.broadcast(by_doc) if by_doc.count() <= SMALL else by_doc
    ddl = "did long, th long, label string, template int, start long, end long, covered double"
    return rows.select("did", "th", "text").join(by_doc, ["did", "th"]).mapInArrow(_verified(templates, k, cover), ddl).distinct()


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = K, cover: float = COVER) -> DataFrame:
    """docs (doc_id, text) -> (did, th, label, template, start, end, covered): verified spans; did and th are the row's key, equal rows have one.

    start and end count words from 0, end behind the last; covered: how many words stand in order in both, as a share of the longer of template and span. Templates of fewer than
    LEAST grams raise ValueError.
    """
    templates = TEMPLATES if templates is None else templates
    rows = keyed(docs)
    return _spans(rows, _joined(rows, ["did", "th"], templates, {}, k), templates, k, cover)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score double.

    labels: of base phrases and of verified spans, distinct, sorted, comma-joined, empty if none. score: the largest
    covered share of a span; 0.5 at least with a base phrase, else 0. Null texts are empty; repeated rows come back as
    often as they are given.
    """
    templates = TEMPLATES if templates is None else templates
    rows = keyed(docs)
    joined = _joined(rows, ["doc_id", "did", "th"], templates, PHRASES, K)
    found = _spans(rows, joined, templates, K, COVER).groupBy("did", "th").agg(F.collect_set("label").alias("more"), F.max("covered").alias("covered"))
    none = F.array().cast("array<string>")
    full = joined.where("base is not null").select("doc_id", "did", "th", "base.*").join(found, ["did", "th"], "left")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",")
    score = F.greatest(F.coalesce("covered", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return full.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))
