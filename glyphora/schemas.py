"""Entities of an annotated corpus as fixed schemas, and enumerations whose order counts."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Enumerations in their order.
ENUMS = {
    "sign_variant_type": ["default", "nondefault", "reduced", "augmented", "nonstandard"],
    "language": ["sumerian", "akkadian", "hittite", "eblaite", "other"],
    "sign_type": ["value", "sign", "number", "punctuation", "description", "damage"],
    "indicator_type": ["none", "left", "right", "center"],
    "sign_condition": ["intact", "damaged", "lost", "inserted", "deleted", "erased"],
    "pn_type": ["none", "person", "god", "place", "water", "field", "temple", "month", "object", "ethnicity", "festival"],
    "surface_type": ["obverse", "reverse", "top", "bottom", "left", "right", "fragment", "surface"],
    "block_type": ["column", "summary", "date", "caption", "legend", "bottom_column", "block"],
    "witness_type": ["original", "print", "copy", "variant"],
    "levenshtein_op": ["NONE", "INSERT", "DELETE", "UPDATE"],
}

MEANING = "struct<word_no:int,value_id:int,sign_id:int,indicator_type:string,phonographic:boolean,stem:boolean,capitalized:boolean>"

# Columns of each entity.
_DDL = {
    # a transliteration's own tables
    "sections": "transliteration_id int, section_no int, section_name string, composition_id int",
    "compounds": "transliteration_id int, compound_no int, pn_type string, language string, section_no int, compound_comment string",
    "words": "transliteration_id int, word_no int, compound_no int, capitalized boolean",
    "surfaces": "transliteration_id int, surface_no int, surface_type string, surface_data string, surface_comment string",
    "blocks": "transliteration_id int, block_no int, surface_no int, block_type string, block_data string, block_comment string",
    "lines": "transliteration_id int, line_no int, block_no int, line string, line_comment string",
    "corpus": (
        "transliteration_id int, sign_no int, line_no int, word_no int, value_id int, sign_variant_id int, custom_value string, type string, "
        "indicator_type string, phonographic boolean, stem boolean, condition string, crits string, comment string, newline boolean, "
        "inverted boolean, ligature boolean"
    ),
    # what they belong to
    "corpora": "corpus_id int, name_short string, name_long string, core boolean, date date, reference string",
    "ensembles": "ensemble_id int, ensemble string",
    "compositions": "composition_id int, composition_name string, witness_type string, parent_composition_id int",
    "texts": (
        "text_id int, ensemble_id int, cdli_no string, bdtns_no string, citation string, provenience_id int, provenience_comment string, "
        "period_id int, period_year int, period_comment string, genre_id int, genre_comment string, object_id int, object_subtype_id int, "
        "object_comment string, archive string, composition_id int"
    ),
    "transliterations": "transliteration_id int, text_id int, corpus_id int, reference string",
    "objects": "object_id int, name string, type string",
    "object_subtypes": "object_subtype_id int, object_id int, name string",
    "genres": "genre_id int, name string",
    "periods": "period_id int, name string, years struct<lo:int,hi:int>, super int",
    "proveniences": "provenience_id int, name string, modern_name string, latitude double, longitude double",
    # edits and names
    "edits": "transliteration_id int, edit_no int, timestamp timestamp, user_id int, internal boolean",
    "edit_log": "transliteration_id int, edit_no int, log_no int, entry_no int, key_col string, target string, action string, val string, val_old string",
    "pns": "pn_id int, pn_type string, language string, normal_form string",
    "pn_variants": f"pn_id int, pn_variant_no int, sign_meanings array<{MEANING}>",
    "compounds_pns": "transliteration_id int, compound_no int, pn_id int, pn_variant_no int",
    # sign list
    "glyphs": "glyph_id int, glyph string, unicode string",
    "glyph_synonyms": "synonym string, glyph_id int",
    "graphemes": "grapheme_id int, grapheme string, mzl_no int",
    "allographs": "allograph_id int, grapheme_id int, glyph_id int, variant_type string, specific boolean",
    "signs": "sign_id int",
    "allomorphs": "allomorph_id int, sign_id int, variant_type string, specific boolean",
    "allomorph_components": "allomorph_id int, pos int, grapheme_id int",
    "sign_variants": "sign_variant_id int, sign_id int, allomorph_id int, allograph_ids array<int>, variant_type string, specific boolean",
    "values": "value_id int, sign_id int, main_variant_id int, phonographic boolean",
    "value_variants": "value_variant_id int, value_id int, value string",
    "glyph_values": "value string, value_id int, glyph_ids array<int>",
}


@functools.cache
def schema(name: str) -> StructType:
    """Of an entity; needs a session."""
    return StructType.fromDDL(_DDL[name])



#: Own key of each table of a transliteration, parents before children.
KEYS = {
    "sections": "section_no",
    "compounds": "compound_no",
    "words": "word_no",
    "surfaces": "surface_no",
    "blocks": "block_no",
    "lines": "line_no",
    "corpus": "sign_no",
}
#: (child, column, parent) of a transliteration's tables.
PARENTS = [
    ("compounds", "section_no", "sections"),
    ("words", "compound_no", "compounds"),
    ("blocks", "surface_no", "surfaces"),
    ("lines", "block_no", "blocks"),
    ("corpus", "line_no", "lines"),
    ("corpus", "word_no", "words"),
]


def ordinal(enum: str, value: Column) -> Column:
    """Place of an enumeration's value in its order, from 0; null if it is none."""
    return reduce(lambda rest, k: F.when(value == ENUMS[enum][k], k).otherwise(rest), reversed(range(len(ENUMS[enum]))), F.lit(None).cast("int"))
