"""A small sign list, enough for the examples."""

from glyphora.operators import encoder, signlist
from glyphora.schemas import schema

SIGNS = [("A", ["a"]), ("E", ["e"]), ("NI", ["i3", "ni"]), ("SI", ["si", "sig9"]), ("PA", ["pa"]), ("TE", ["te"]), ("SI.A", ["diri"]), ("PA.TE.SI", ["ensi2"]), ("A.A", ["aya", "ayya"]), ("AN", ["d"]), ("KI", ["ki"])]


def tables(spark):
    names = sorted({g for s, _ in SIGNS for g in s.split(".")})
    no = {g: i + 1 for i, g in enumerate(names)}
    morphs, parts, values, variants = [], [], [], []
    for s, (spelling, readings) in enumerate(SIGNS, 1):
        morphs.append((s, s, "default", True))
        parts += [(s, k, no[g]) for k, g in enumerate(spelling.split("."), 1)]
        for r in readings:
            v = len(values) + 1
            values.append((v, s, v, False))
            variants.append((v, v, r))
    make = lambda name, rows: spark.createDataFrame(rows, schema(name))
    t = {
        "glyphs": make("glyphs", [(i, g, None) for g, i in no.items()]),
        "glyph_synonyms": make("glyph_synonyms", []),
        "graphemes": make("graphemes", [(i, g, None) for g, i in no.items()]),
        "allographs": make("allographs", [(i, i, i, "default", True) for i in no.values()]),
        "allomorphs": make("allomorphs", morphs),
        "allomorph_components": make("allomorph_components", parts),
        "values": make("values", values),
        "value_variants": make("value_variants", variants),
        "glyph_values": make("glyph_values", []),
    }
    t["sign_variants"] = spark.createDataFrame(signlist.numbered(signlist.variants(t)).select(*[f.name for f in schema("sign_variants").fields]).collect(), schema("sign_variants"))
    composed = signlist.composition(t)
    composed = spark.createDataFrame(composed.collect(), composed.schema)
    out = {"composed": composed, "sign_map": signlist.sign_map(t), "values_encoded": encoder.values_encoded(t, composed), "signs_encoded": encoder.signs_encoded(composed), "characters": signlist.characters(t, composed)}
    for k, df in out.items():
        out[k] = spark.createDataFrame(df.collect(), df.schema)
    return t | out
