"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, and a name or number of several words one placeholder; what is left are templates, in which a question with other
numbers or names is the same. Hashes of template windows of the documents are joined to those of the benchmark; hits
that agree in document, item and offset are one alignment. Windows with few literal words are joined by their words as they are. Its slots are consistent if a filling of the item
always stands for the same one of the document; if they aren't, only windows with the item's own fillings count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.llm._common import _powers, keyed, text_steps, window_hashes, words_of, written

#: Words of a window, and how many of them must not be placeholders (of a shorter item: more than half) for other fillings to match.
WINDOW, LITERAL = 8, 5
#: Words that an alignment must cover: so many, or this share of a shorter item.
COVER, SHARE = 13, 0.6
#: Words that one placeholder stands for at most: longer runs of capitalised words are headings.
RUN = 3
#: Windows of a benchmark that are broadcast at most (a few tens of bytes each); more are joined by a shuffle.
SMALL = 200_000
MARKS = b"!\"#%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NUMBER = re.compile(rb"[$]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
#: Unit words. Fixed values.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr day week month year ms hz khz mhz ghz kb mb gb tb w kw v a k c f usd eur "
    b"inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound "
    b"pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours days weeks months years dollar dollars euro "
    b"euros cent cents percent degrees".split()
)
QUANTITY = re.compile(rb"([$]?\d[\d.,]*)([a-z]+)$")
_NUM, _UNIT, _NAME, _BOTH = (xxhash.xxh64_intdigest(x, 1) for x in (b"<number>", b"<unit>", b"<name>", b"<quantity>"))
#: Tells hashes of windows as they are from those of templates.
_SAID = np.uint64(0x5A1D5A1D5A1D5A1D)


def _kind(word: bytes) -> tuple[int, int, bool, bool]:
    """Of a word: template hash, hash of its filling (0: none), whether it is a name in mid-sentence, whether it ends a sentence."""
    ends = word.rstrip(b"\"')]}*_")[-1:] in (b".", b"!", b"?", b":", b";", b"|")
    core = word.strip(MARKS)
    low = core.lower()
    fill = xxhash.xxh64_intdigest(low, 3) or 1
    if NUMBER.match(core):
        return _NUM, fill, False, ends
    if low in UNITS and len(low) > 1:
        return _UNIT, fill, False, ends
    if (m := QUANTITY.match(low)) and m[2] in UNITS:
        return _BOTH, fill, False, ends
    letters = core.decode()
    name = letters[:1].isupper() and letters[1:].islower()  # shouted words are none
    if not core:
        return xxhash.xxh64_intdigest(word, 2), 0, False, ends
    return xxhash.xxh64_intdigest(letters.lower().encode(), 2), fill if name else 0, name, ends


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts end to end: template hashes, fillings (0: no placeholder), hashes of what is said, whether they may be names, the number of their first
    word in the text; and how many tokens each text has. A token is a word, or a run of up to RUN names or of numbers.

    A capitalised word is a name unless it begins a text or follows the end of a sentence.
    """
    flat, sizes = words_of(texts.cast(pa.large_string()))
    coded = flat.dictionary_encode()
    kinds = [_kind(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    index = coded.indices.to_numpy()
    template, fill, name, ends = (np.array([k[i] for k in kinds], t)[index] for i, t in enumerate((np.uint64, np.uint64, bool, bool)))
    begins = np.ones(len(index), bool)
    begins[1:] = ends[:-1]
    first = np.cumsum(sizes) - sizes
    begins[first[sizes > 0]] = True
    capital, said = name.copy(), np.where(name | (fill == 0), template, fill)
    plain = name & begins
    name &= ~begins
    template, fill = np.where(name, np.uint64(_NAME), template), np.where(plain, np.uint64(0), fill)
    word = np.arange(len(index)) - np.repeat(first, sizes)
    return _in_runs(template, fill, said, capital, word, sizes)


def _in_runs(template: np.ndarray, fill: np.ndarray, said: np.ndarray, capital: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words with each run of 2 to RUN names, or numbers, made one."""
    if not len(word):
        return template, fill, said, capital, word, sizes
    many = (fill != 0) & ((template == np.uint64(_NAME)) | (template == np.uint64(_NUM)))
    goes_on = np.zeros(len(word), bool)
    goes_on[1:] = many[1:] & many[:-1] & (template[1:] == template[:-1]) & (word[1:] > 0)
    starts = np.flatnonzero(~goes_on)
    length = np.diff(np.append(starts, len(word)))
    goes_on &= np.repeat(length <= RUN, length)
    at = np.flatnonzero(~goes_on)
    place = np.arange(len(word)) - np.repeat(at, np.diff(np.append(at, len(word))))
    power = _powers(RUN)[0][place]  # 1 for all but the second and third word of a run
    text = np.repeat(np.arange(len(sizes)), sizes)
    return template[at], np.add.reduceat(fill * power, at), np.add.reduceat(said * power, at), capital[at], word[at], np.bincount(text[at], minlength=len(sizes))


def _windows(texts: pa.Array, length: int, literal: int) -> tuple[pa.Array, np.ndarray]:
    """Windows of all texts end to end as struct (pos, word, h, fills), and how many each text has.

    Windows with enough literal words are templates. The others are hashed as they are, without slots; so is, once more, a window whose first
    word is a name or none by what stands before it.
    """
    template, fill, said, capital, word, sizes = canonical(texts)
    h = window_hashes(template, length)
    slots = np.concatenate([[0], np.cumsum(fill != 0)])
    begin, end = slots[: len(h)], slots[length : length + len(h)]
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    inside, enough = ends[text] - np.arange(len(h)) >= length, length - (end - begin) >= literal
    as_template, as_said = np.flatnonzero(inside & enough), np.flatnonzero(inside & (~enough | capital[: len(h)]))
    at = np.concatenate([as_template, as_said])
    order = np.argsort(at, kind="stable")
    at = at[order]
    h = np.concatenate([h[as_template], window_hashes(said, length)[as_said] ^ _SAID])[order]
    n = np.concatenate([(end - begin)[as_template], np.zeros(len(as_said), np.int64)])[order]
    fills = fill[fill != 0].view(np.int64)[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(fills), mask=pa.array(n == 0))
    pos = (at - (ends - sizes)[text[at]]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(pos), pa.array(word[at].astype(np.int32)), pa.array(h.view(np.int64)), lists], ["pos", "word", "h", "fills"])
    return found, np.bincount(text[at], minlength=len(sizes))


_FOUND = "array<struct<pos:int,word:int,h:long,fills:array<long>>>"


def windows(rows: DataFrame, keys: list[str], length: int, literal: int) -> DataFrame:
    """rows (keys, text) -> a row per window (two, where `_windows` hashes it twice): keys, pos int, word int, h long, fills array<long> (null: none)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                found, sizes = _windows(part.column("text"), length, literal)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), lists], [*keys, "found"])

    ddl = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + f", found {_FOUND}"
    made = rows.select(*keys, "text").mapInArrow(kernel, ddl)
    return made.select(*keys, F.explode("found").alias("x")).select(*keys, "x.pos", "x.word", "x.h", "x.fills")


def _sized(items: DataFrame) -> DataFrame:
    """items (item_id, text) and n_item, their tokens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(canonical(part.column("text"))[-1].astype(np.int32))], ["item_id", "text", "n_item"])

    return items.mapInArrow(kernel, items.select("item_id", "text").schema.add("n_item", "integer"))


def alignments(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """docs (keys, text), benchmark (item_id, text) -> (keys, item_id, start, covered, share): alignments that by
    windows with consistent slots cover COVER words or, of items shorter than COVER / SHARE, the share SHARE; the best of each pair.

    start: where the aligned item would begin, in words of the document (it may be below 0); covered: words, a name or number of several being one. Items
    shorter than a window are one window as they are; empty ones and null item_ids never match.
    """
    items = benchmark.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    items = written(_sized(items).where("n_item > 0"), "sized")
    short = sorted(r.n for r in items.where(F.col("n_item") < window).select(F.col("n_item").alias("n")).distinct().collect())  # below `window` numbers
    hits = None
    for length, of, need in [(window, items.where(F.col("n_item") >= window), literal)] + [(n, items.where(F.col("n_item") == n), n // 2 + 1) for n in short]:
        own = windows(of, ["item_id", "n_item"], length, need).select("item_id", "n_item", F.col("pos").alias("at"), F.col("word").alias("at_word"), "h", F.col("fills").alias("own"))
        own = written(own, "items")
        if own.count() <= SMALL:
            own = F.broadcast(own)
        both = windows(docs, keys, length, need).join(own, "h").select(*keys, "item_id", "n_item", (F.col("pos") - F.col("at")).alias("diagonal"), (F.col("word") - F.col("at_word")).alias("start"), "at", F.lit(length).alias("w"), "fills", "own")
        hits = both if hits is None else hits.unionByName(both)
    none = F.array().cast("array<struct<own:bigint,fills:bigint>>")
    pairs = F.when(F.size("own") == F.size("fills"), F.arrays_zip("own", "fills"))
    hits = hits.withColumn("pairs", F.when(F.col("own").isNull() & F.col("fills").isNull(), none).otherwise(pairs))
    votes = hits.where("pairs is not null").groupBy(*keys, "item_id", "n_item", "diagonal").agg(
        F.min("start").alias("start"),
        F.collect_set(F.struct("at", "w")).alias("ats"),
        F.collect_set(F.when(F.col("own").eqNullSafe(F.col("fills")), F.struct("at", "w"))).alias("same"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )  # sets, added up map-side: at most an item's windows each, however often a row of docs is given
    agree = F.size(F.array_distinct(F.transform("pairs", lambda p: p["own"]))) == F.size("pairs")
    votes = votes.withColumn("ats", F.when(agree, F.col("ats")).otherwise(F.col("same"))).where(F.size("ats") > 0)
    words = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a["at"], a["at"] + a["w"] - 1))))
    votes = votes.withColumn("covered", F.size(words)).withColumn("share", F.col("covered") / F.col("n_item"))
    votes = votes.where((F.col("covered") >= COVER) | (F.col("share") >= SHARE))
    best = votes.groupBy(*keys, "item_id").agg(F.max_by(F.struct("start", "covered", "share"), F.struct("covered", -F.col("start"))).alias("x"))
    return best.select(*keys, "item_id", "x.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, start int, covered int, share double): documents that hold benchmark items, in themselves or re-parameterised.

    Documents without an item have no row; a null doc_id stays null; repeated rows give one pair.
    """
    return alignments(keyed(docs), benchmark, ["doc_id", "th"]).select("doc_id", "item_id", "start", "covered", "share")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    goes = alignments(keyed(docs), benchmark, ["did", "th"]).select("did", "th").distinct()
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("did"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("th"))
    return own.join(goes.hint("shuffle_hash"), ["did", "th"], "left_anti").select("row.*")
