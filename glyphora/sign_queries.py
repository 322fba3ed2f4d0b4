"""Queries over orders written as signs, and names made of part names, for what needs a sign list; and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.operators import commands, corpus, corpus_search, editing, history, html, names, serialize
from glyphora.queries import B2, B4, B6, _array, _dictionary, _sign_rows, query
from glyphora.schemas import schema
from glyphora.sources import bindings as bind
from glyphora.sources.store import materialized

KEY = bind.KEY

# b7: order lines as signs; b8: names, of a part's sign and the next part's.
B7 = f"""{B2}, {B6}, b7 AS (
  SELECT b2.tid, b2.sign_no, b2.compound_no, b2.line_no, p_name, sg.sign_id, c.sign_variant_id, p_size = 1 AS number, flag, c.graphemes,
         CASE WHEN p_size <> 1 AND flag <> 'R' THEN sg.sign_id END AS value_id, CASE WHEN p_size = 1 THEN 'number' WHEN flag <> 'R' THEN 'value' ELSE 'sign' END AS type,
         CASE p_size % 10 WHEN 3 THEN 'left' WHEN 4 THEN 'right' ELSE 'none' END AS indicator_type, CASE p_size % 10 WHEN 3 THEN false WHEN 4 THEN true END AS phonographic,
         CASE WHEN status = 'F' THEN true END AS stem
  FROM b2 JOIN part ON p_partkey = value_id JOIN sg USING (p_name) JOIN b6c c ON c.sign_id = sg.sign_id AND c.s
)"""
B8 = f"""{B6}, b8 AS (
  SELECT p.p_partkey AS pn_id, a.sign_id AS a, b.sign_id AS b, CASE WHEN p.p_size % 3 <> 0 THEN a.sign_id END AS v, p.p_size % 2 AS w, p.p_size % 7 = 0 AS cap, p.p_size % 5 = 0 AS lang,
         p.p_name AS an, n.p_name AS bn, p.p_size
  FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1 JOIN sg a ON a.p_name = p.p_name JOIN sg b ON b.p_name = n.p_name
)"""
_READ = "replace({}, ' ', '') || '1'"


def _first(spark, sf_dir) -> tuple[str, str]:
    """The reading and the sign of the first part's name."""
    name = bind.table(spark, sf_dir, "part").agg(F.min_by("p_name", "p_partkey")).first()[0] or "none none"
    return f"{name.replace(' ', '')}1", name.upper().replace(" ", ".")


def _names(spark, sf_dir) -> DataFrame:
    """pn_id, pn_variant_no, language, sign_meanings."""
    part = bind.table(spark, sf_dir, "part")
    least = part.groupBy("p_name").agg(F.min(F.col("p_partkey").cast("int")).alias("sign_id"))
    known = part.join(least, "p_name")
    after = known.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("sign_id").alias("next_id"))
    none, size = lambda k: F.lit(None).cast(k), F.col("p_size")
    meaning = lambda word, value, sign: F.struct(word.cast("int").alias("word_no"), value.alias("value_id"), sign.alias("sign_id"), F.lit("none").alias("indicator_type"), none("boolean").alias("phonographic"), none("boolean").alias("stem"), (size % 7 == 0).alias("capitalized"))
    first = meaning(F.lit(0), F.when(size % 3 != 0, F.col("sign_id")), F.col("sign_id"))
    second = meaning(size % 2, F.col("next_id"), F.col("next_id"))
    return known.join(after, "p_partkey").select(F.col("p_partkey").cast("int").alias("pn_id"), F.lit(0).alias("pn_variant_no"), F.when(size % 5 == 0, "sumerian").alias("language"), F.array(first, second).alias("sign_meanings"))


@query(f"""WITH {B6}, p AS (SELECT p_partkey AS id, p_size % 4 AS k, sg.sign_id AS s FROM part JOIN sg USING (p_name))
SELECT id, CASE k WHEN 1 THEN 'compound' WHEN 2 THEN 'encoding' END AS error, CASE k WHEN 0 THEN s || ',' || s WHEN 3 THEN s || ',' || s || ',' || s END AS sign_ids,
CASE k WHEN 0 THEN s || ',-' WHEN 3 THEN s || ',' || s || ',' || s END AS value_ids, CASE k WHEN 0 THEN '0,0' WHEN 3 THEN '0,1,1' END AS word_nos FROM p""")
def names_parse(spark, sf_dir):
    """Spellings of names as code: a reading and its sign, two compounds, an unknown reading, three readings in two words."""
    part = bind.table(spark, sf_dir, "part")
    value, sign = F.concat(F.regexp_replace("p_name", " ", ""), F.lit("1")), F.concat(F.lit("|"), F.upper(F.regexp_replace("p_name", " ", ".")), F.lit("|"))
    kind = F.col("p_size") % 4
    code = F.when(kind == 0, F.concat(value, F.lit("-"), sign)).when(kind == 1, F.concat(value, F.lit(" "), value)).when(kind == 2, F.lit("nope7-nope8")).otherwise(F.concat(value, F.lit("--"), value, F.lit("-"), value))
    rows = names.meanings(part.select(F.col("p_partkey").alias("id"), code.alias("code")), "id", _dictionary(spark, sf_dir))
    listed = lambda f: F.array_join(F.transform("sign_meanings", lambda m: m[f].cast("string")), ",", "-")
    return rows.select("id", "error", listed("sign_id").alias("sign_ids"), listed("value_id").alias("value_ids"), listed("word_no").alias("word_nos"))


@query(f"""WITH {B8} SELECT pn_id, 0 AS pn_variant_no, CASE WHEN lang THEN '%s ' ELSE '' END || CASE WHEN cap THEN '&' ELSE '' END || CASE WHEN v IS NULL THEN '|' || upper(replace(an, ' ', '.')) || '|' ELSE {_READ.format('an')} END
|| CASE WHEN w = 1 THEN '--' || CASE WHEN cap THEN '&' ELSE '' END ELSE '-' END || {_READ.format('bn')} AS pn FROM b8""")
def names_serialized(spark, sf_dir):
    t, rows = _dictionary(spark, sf_dir), _names(spark, sf_dir)
    return names.serialized(rows.drop("language"), rows.select("pn_id", "language"), t["composed"], t["characters"])


@query(f"""WITH {B8}, r AS (SELECT *, replace(an, ' ', '') AS x, replace(bn, ' ', '') AS y FROM b8)
SELECT pn_id, CASE WHEN v IS NULL THEN '<span class=''unknown_reading''><span class=''unknown_value''>' || upper(replace(an, ' ', '.')) || '</span></span>'
ELSE CASE WHEN cap THEN upper(x[1]) || x[2:] ELSE x END || '<span class=''index''>1</span>' END || CASE WHEN w = 1 THEN '–' ELSE '-' END
|| CASE WHEN cap AND w = 1 THEN upper(y[1]) || y[2:] ELSE y END || '<span class=''index''>1</span>' AS html FROM r""")
def names_html(spark, sf_dir):
    t = _dictionary(spark, sf_dir)
    return names.meanings_html(_names(spark, sf_dir), ["pn_id"], t["composed"], html.characters(t, t["composed"]))


@query(f"""WITH {B8}, s AS (SELECT pn_id, 0 AS sign_no, 0 AS word_no, v AS value_id, a AS sign_id FROM b8 UNION ALL SELECT pn_id, 1, w, b, b FROM b8), c AS (SELECT s.*, x.* EXCLUDE sign_id FROM s JOIN b6c x ON x.sign_id = s.sign_id AND x.t = 0)
SELECT pn_id, sign_no, word_no, sign_no * 128 AS pos, (sign_no + 1) * 128 AS next_pos, value_id, sign_variant_id, NULL AS grapheme_id, NULL AS glyph_id FROM c UNION ALL
SELECT pn_id, sign_no, word_no, sign_no * 128 + o, CASE WHEN o = 1 THEN (sign_no + 1) * 128 ELSE sign_no * 128 + 1 END, NULL, NULL, gs[o + 1], glyph_ids[o + 1] FROM c, (VALUES (0), (1)) AS y(o)""")
def names_relation(spark, sf_dir):
    rows = names.relation(_names(spark, sf_dir), _dictionary(spark, sf_dir)["composed"])
    return rows.select("pn_id", "sign_no", "word_no", "pos", "next_pos", "value_id", "sign_variant_id", "grapheme_id", "glyph_id")


@query(f"""WITH {B8}, f AS (SELECT min_by(p_name, p_partkey) AS f FROM part)
SELECT pn_id, 0 AS pn_variant_no FROM b8, f WHERE w = 1 AND (bn = f OR (an = f AND v IS NOT NULL))""")
def names_search(spark, sf_dir):
    """Names in which the first part's reading is a word before or behind another one."""
    t = _dictionary(spark, sf_dir)
    first = _first(spark, sf_dir)[0]
    rows = materialized(names.relation(_names(spark, sf_dir), t["composed"]), "names")
    found = [names.search(rows, text, t, aliases=False) for text in (f"; {first} ; x", f"x ; {first} ;")]
    return found[0].union(found[1]).distinct()


_LEAVES = {
    "{v}": "value_id = f.s AND indicator_type <> 'none' AND NOT phonographic",
    "<v>": "value_id = f.s AND indicator_type <> 'none' AND phonographic",
    "v": "value_id = f.s",
    "|S|": "sign_id = f.s AND NOT number",
    "n": "number",
    "{v}x": "value_id = f.s AND indicator_type = 'right' AND NOT phonographic AND NOT n_number",
    "x<v>": "NOT number AND n_value = f.s AND n_indicator = 'left' AND n_phonographic",
    "x{v}": "NOT number AND n_value = f.s AND n_indicator = 'left' AND NOT n_phonographic",
    "<v>x": "value_id = f.s AND indicator_type = 'right' AND phonographic AND NOT n_number",
    "v n": "value_id = f.s AND n_number",
    "v-x": "value_id = f.s AND NOT n_number AND compound_no = n_compound",
    "// v": "value_id = f.s AND p_line IS DISTINCT FROM line_no",
    "v(S)": "value_id = f.s",
    "n ,": "number AND compound_no IS DISTINCT FROM n_compound",
    "A.B": "sign_id = f.s AND NOT number",
    "X": "NOT number",
}


@query(f"""WITH {B7}, f AS (SELECT min(p_partkey) AS s FROM part), n AS (SELECT *, lead(number) OVER o AS n_number, lead(value_id) OVER o AS n_value, lead(indicator_type) OVER o AS n_indicator, lead(phonographic) OVER o AS n_phonographic,
lead(compound_no) OVER o AS n_compound, lag(line_no) OVER o AS p_line FROM b7 WINDOW o AS (PARTITION BY tid ORDER BY sign_no)) {' UNION ALL '.join(f"SELECT '{p}' AS pattern, tid, sign_no AS first FROM n, f WHERE {c}" for p, c in _LEAVES.items())}""")
def search_leaves(spark, sf_dir):
    """Each kind of leaf, over orders written as signs; v is the first part's reading, S its sign, A and B its components."""
    t = _dictionary(spark, sf_dir)
    value, sign = _first(spark, sf_dir)
    rows = materialized(corpus_search.relation(bind.sign_tables(bind.sign_rows(spark, sf_dir, t["composed"])), t["composed"]), "relation")
    texts = {name: name.replace("S", sign).replace("v", value) if name != "A.B" else " ".join(sign.split(".")) for name in _LEAVES}
    found = corpus_search.search_all(rows, texts, t, aliases=False).where("pattern <> 'A.B' or size(signs) = 1")  # both components of one sign, not those of two
    return found.select("pattern", F.col(KEY).cast("bigint").alias("tid"), F.get("signs", F.lit(0)).alias("first")).distinct()


@query(f"""WITH {B7}, f AS (SELECT min(p_partkey) AS s FROM part), m AS (SELECT DISTINCT tid FROM b7, f WHERE sign_id = f.s AND NOT number)
SELECT tid, sign_no, CASE WHEN sign_id = f.s AND NOT number THEN f.s ELSE value_id END AS value_id, CASE WHEN sign_id = f.s AND NOT number THEN 'value' ELSE type END AS type,
CASE WHEN sign_id = f.s AND NOT number THEN 'none' ELSE indicator_type END AS indicator_type FROM b7, f WHERE tid IN (SELECT tid FROM m)""")
def replace_signs(spark, sf_dir):
    """Orders in which the first part's sign occurs, with or without a reading, with each of these signs written as its reading."""
    t = _dictionary(spark, sf_dir)
    value, sign = _first(spark, sf_dir)
    tables = bind.sign_tables(bind.sign_rows(spark, sf_dir, t["composed"]))
    out = corpus_search.replace(tables, f"|{sign}|", value, t, aliases=False)
    return editing.unpack(out)["corpus"].select(F.col(KEY).cast("bigint").alias("tid"), "sign_no", "value_id", "type", "indicator_type")


def _versions(spark, sf_dir):
    """Orders as signs, and the same without returned parts, numbered anew. One exchange by order serves all numbers."""
    t = _dictionary(spark, sf_dir)
    left = F.col("type") != "sign"
    rank = lambda c: (F.dense_rank().over(Window.partitionBy(KEY, left).orderBy(c)) - 1).alias(f"new_{c}")
    signs = bind.sign_rows(spark, sf_dir, t["composed"]).repartition(KEY)
    both = signs.select("*", F.max(left).over(Window.partitionBy(KEY)).alias("stays"), *[rank(c) for c in ("sign_no", "line_no", "compound_no")])
    both = materialized(both.where("stays").drop("stays"), "signs")
    new = both.where(left).select(*[F.col(f"new_{c}").alias(c) if f"new_{c}" in both.columns else c for c in signs.columns])
    return t, bind.sign_tables(both.select(*signs.columns)), bind.sign_tables(new)


_NEW = f"""{B7}, k AS (SELECT * FROM b7 WHERE type <> 'sign'), z AS (SELECT tid, dense_rank() OVER (PARTITION BY tid ORDER BY sign_no) - 1 AS sign_no, dense_rank() OVER (PARTITION BY tid ORDER BY line_no) - 1 AS line_no,
dense_rank() OVER (PARTITION BY tid ORDER BY compound_no) - 1 AS compound_no, value_id, type FROM k)"""


def _joined(tables) -> DataFrame:
    words = tables["words"].select(KEY, "word_no", "compound_no")
    return tables["corpus"].join(words, [KEY, "word_no"]).select(F.col(KEY).cast("bigint").alias("tid"), "sign_no", "line_no", "compound_no", "value_id", "type")


@query(f"WITH {_NEW} SELECT * FROM z")
def edit_corpus(spark, sf_dir):
    """Orders edited, by logged actions, into themselves without returned parts."""
    _, old, new = _versions(spark, sf_dir)
    return _joined(editing.unpack(materialized(editing.edit_corpus(old, new), "edited")))


@query(f"WITH {_NEW} SELECT tid, sign_no, line_no, compound_no, value_id, type FROM b7 WHERE tid IN (SELECT tid FROM z)")
def undo_edits(spark, sf_dir):
    """The same edits, kept as an edit each, taken back, done again and taken back once more by time."""
    _, old, new = _versions(spark, sf_dir)
    logs = {name: spark.createDataFrame([], schema(name)) for name in ("edits", "edit_log")}
    tables, logs = history.commit(old, logs, editing.edit_corpus(old, new), 1, False, "2020-01-01")
    edits = logs["edits"].select(KEY, "edit_no")
    again = history.redo(history.undo(tables, logs["edit_log"], edits), logs["edit_log"], edits)
    back, left = history.revert_corpus_to(again, logs, "2019-01-01")
    return _joined(back).join(left["edits"].select(F.col(KEY).cast("bigint").alias("tid")), "tid", "left_anti")


@query(f"""WITH {B7} SELECT tid, sign_no, CASE WHEN number THEN p_name WHEN value_id IS NULL THEN graphemes ELSE {_READ.format('p_name')} END AS custom_value FROM b7""")
def unencode_corpus(spark, sf_dir):
    t = _dictionary(spark, sf_dir)
    rows = corpus.unencode_corpus(bind.sign_tables(bind.sign_rows(spark, sf_dir, t["composed"]))["corpus"], t["characters"])
    return rows.select(F.col(KEY).cast("bigint").alias("tid"), "sign_no", "custom_value")


@query(f"""WITH {B7} SELECT tid, sign_no, CASE WHEN number THEN p_name END AS custom_value, value_id, CASE WHEN NOT number THEN sign_variant_id END AS sign_variant_id FROM b7""")
def encode_corpus(spark, sf_dir):
    """What `unencode_corpus` writes out, encoded again."""
    t = _dictionary(spark, sf_dir)
    rows = corpus.unencode_corpus(bind.sign_tables(bind.sign_rows(spark, sf_dir, t["composed"]))["corpus"], t["characters"])
    return corpus.encode_corpus(materialized(rows, "plain"), t).select(F.col(KEY).cast("bigint").alias("tid"), "sign_no", "custom_value", "value_id", "sign_variant_id")


@query(f"""WITH {B7}, r AS (SELECT *, min(sign_no) OVER (PARTITION BY tid, compound_no) AS f FROM b7)
SELECT tid, compound_no, CASE WHEN bool_and(NOT number) THEN string_agg((sign_no - f) || ':' || sign_id, ',' ORDER BY sign_no) END AS sign_meanings, max(sign_no) - max(CASE WHEN stem THEN sign_no END) AS suffix_len FROM r GROUP BY ALL""")
def compounds_sign_meanings(spark, sf_dir):
    t = _dictionary(spark, sf_dir)
    signs = bind.sign_rows(spark, sf_dir, t["composed"]).withColumns({"word_no": F.col("sign_no"), "capitalized": F.lit(False), "sign_id": F.when(F.col("type") != "number", F.col("sign_id"))})
    rows = names.compound_meanings(signs, [KEY, "compound_no"])
    listed = F.array_join(F.transform("sign_meanings", lambda m: F.concat_ws(":", m["word_no"], m["sign_id"])), ",")
    return rows.select(F.col(KEY).cast("bigint").alias("tid"), "compound_no", listed.alias("sign_meanings"), "suffix_len")


@query(f"""WITH {B7} SELECT tid, compound_no, CASE WHEN bool_and(NOT number) THEN string_agg(array_to_string(gs, ','), ',' ORDER BY sign_no) END AS grapheme_ids FROM b7 JOIN b6c USING (sign_variant_id) GROUP BY ALL""")
def compounds_grapheme_ids(spark, sf_dir):
    t = _dictionary(spark, sf_dir)
    signs = bind.sign_rows(spark, sf_dir, t["composed"]).join(t["composed"].select("sign_variant_id", "grapheme_ids"), "sign_variant_id", "left")
    return names.compound_graphemes(signs, [KEY, "compound_no"]).select(F.col(KEY).cast("bigint").alias("tid"), "compound_no", _array("grapheme_ids"))


@query(f"""WITH {B7}, f AS (SELECT min(p_partkey) AS s FROM part), m AS (SELECT tid, line_no, string_agg(DISTINCT CASE WHEN sign_id = f.s AND value_id IS NOT NULL THEN 1 END) AS hit FROM b7, f GROUP BY ALL)
SELECT tid, line_no FROM m WHERE hit IS NOT NULL""")
def search_lines(spark, sf_dir):
    """Lines in which the first part's reading occurs."""
    t = _dictionary(spark, sf_dir)
    value = _first(spark, sf_dir)[0]
    tables = bind.sign_tables(bind.sign_rows(spark, sf_dir, t["composed"]))
    found = corpus_search.search(corpus_search.relation(tables, t["composed"]), value, t, aliases=False)
    return corpus_search.found_lines(found, tables, t["characters"]).select(F.col(KEY).cast("bigint").alias("tid"), "line_no").distinct()


@query(f"""WITH {B7}, r AS (SELECT tid, line_no, sign_no, CASE WHEN number THEN p_name WHEN value_id IS NULL THEN '|' || graphemes || '|' ELSE {_READ.format('p_name')} END AS v FROM b7 WHERE indicator_type = 'none' AND stem IS NULL AND tid NOT IN (SELECT tid FROM b7 WHERE indicator_type <> 'none' OR stem OR type <> 'value'))
SELECT tid, string_agg(line, chr(10) ORDER BY line_no) AS content FROM (SELECT tid, line_no, line_no || chr(9) || string_agg(v || CASE WHEN nl IS NULL THEN '' WHEN nc <> c AND nl <> line_no THEN '' WHEN nc <> c THEN ' ' ELSE '--' END, '' ORDER BY sign_no) AS line
FROM (SELECT r.*, b7.compound_no AS c, lead(b7.compound_no) OVER o AS nc, lead(r.line_no) OVER o AS nl FROM r JOIN b7 USING (tid, sign_no) WINDOW o AS (PARTITION BY tid ORDER BY sign_no)) GROUP BY tid, line_no) GROUP BY tid""")
def serialize_corpus(spark, sf_dir):
    """Whole documents, from ids to code, of orders without numbers, bare signs, indicators or stems."""
    t = _dictionary(spark, sf_dir)
    signs = bind.sign_rows(spark, sf_dir, t["composed"])
    odd = signs.where("indicator_type <> 'none' or stem or type <> 'value'").select(KEY).distinct()
    rows = serialize.serialize(bind.sign_tables(signs.join(odd, KEY, "left_anti")), t["characters"])
    return rows.select(F.col(KEY).cast("bigint").alias("tid"), "content")


@query(f"""WITH {B6}, ids AS (SELECT list(sign_id ORDER BY sign_id) AS s FROM sg), v AS (SELECT CASE WHEN sign_id = s[2] THEN s[1] ELSE sign_id END AS sign_id, value FROM vl, ids WHERE NOT (sign_id IN (s[1], s[2]) AND value LIKE '%x%' AND EXISTS (
  SELECT 1 FROM vl o WHERE o.sign_id IN (s[1], s[2]) AND o.sign_id <> vl.sign_id AND regexp_replace(o.value, '[0-9x]+$', '') = replace(vl.value, 'x', ''))))
SELECT sign_id, value FROM v""")
def merge_signs(spark, sf_dir):
    """Readings of signs after the second sign has been merged into the first."""
    t = _dictionary(spark, sf_dir)
    a, b = [r.sign_id for r in t["values"].select("sign_id").distinct().orderBy("sign_id").limit(2).collect()]
    t = commands.merge_signs(t, a, b)
    return t["value_variants"].join(t["values"].select("value_id", "sign_id"), "value_id").select("sign_id", "value")


@query(f"""WITH {B6}, ids AS (SELECT min(sign_id) AS s FROM sg), u AS (SELECT sign_id, value, vv AS id FROM vl, ids WHERE sign_id <> s + 1 UNION ALL SELECT s, 'newvalue7', max(vv) + 1 FROM vl, ids GROUP BY s)
SELECT sign_id, value, id = sign_id * 10 + 1 OR value = 'newvalue7' AS main FROM u""")
def add_and_delete_values(spark, sf_dir):
    """Readings after the first sign got another one and the second sign's reading was deleted."""
    t = _dictionary(spark, sf_dir)
    first = t["values"].agg(F.min("sign_id")).first()[0]
    t, _ = commands.add_value(t, first, "newvalue7", False)
    t = commands.delete_value(t, first + 1)
    rows = t["value_variants"].join(t["values"], "value_id")
    return rows.select("sign_id", "value", (F.col("value_variant_id") == F.col("main_variant_id")).alias("main"))


@query(f"""WITH RECURSIVE {B4}, l AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY edit_no, log_no) AS o FROM b4 WHERE action <> 'other'), n AS (SELECT tid, max(o) AS n FROM l GROUP BY tid), t AS (
  SELECT tid, n AS k, e::BIGINT AS e, e::BIGINT AS no, NULL::BIGINT AS edit FROM n, range(0, 6) AS r(e) UNION ALL
  SELECT t.tid, t.k - 1, t.e, CASE WHEN t.no IS NULL THEN NULL WHEN l.action = 'insert' AND l.entry_no = t.no THEN NULL WHEN l.action = 'insert' AND l.entry_no < t.no THEN t.no - 1
    WHEN l.action = 'delete' AND l.entry_no <= t.no THEN t.no + 1 ELSE t.no END, CASE WHEN l.action IN ('insert', 'update') AND l.entry_no = t.no THEN l.edit_no END
  FROM t JOIN l ON l.tid = t.tid AND l.o = t.k
) SELECT tid, e AS sign_no, coalesce(string_agg(edit::VARCHAR, ',' ORDER BY k DESC), '') AS edit_nos FROM (SELECT tid, e, edit, max(k) AS k FROM t GROUP BY tid, e, edit) GROUP BY tid, e""")
def corpus_modified(spark, sf_dir):
    """Edits that made or changed each of the first six signs of a user's text."""
    rows = bind.event_log(spark, sf_dir).where("action <> 'other'").withColumnsRenamed({"tid": KEY}).withColumn("target", F.lit("corpus"))
    signs = rows.select(KEY).distinct().select(KEY, F.explode(F.sequence(F.lit(0), F.lit(5))).alias("sign_no"))
    found = history.modified(signs, rows)
    return found.select(F.col(KEY).cast("bigint").alias("tid"), F.col("sign_no").cast("bigint").alias("sign_no"), _array("edit_nos"))


@query(f"""WITH {B2}, r AS (SELECT tid, sign_no, line_no, word_no, compound_no, lower(grapheme) AS v, sign_no // 2 AS e0, CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS e1 FROM b2),
n AS (SELECT *, lag(e0) OVER o AS pe0, lag(e1) OVER o AS pe1, lag(line_no) OVER o AS pl, lead(e0) OVER o AS ne0, lead(e1) OVER o AS ne1, lead(line_no) OVER o AS nl, lead(word_no) OVER o AS nw, lead(compound_no) OVER o AS nk FROM r WINDOW o AS (PARTITION BY tid ORDER BY sign_no)),
m AS (SELECT *, pl IS NULL OR pl <> line_no OR pe0 <> e0 AS o0, pl IS NULL OR pl <> line_no OR pe0 <> e0 OR pe1 IS DISTINCT FROM e1 AS o1, nl IS NULL OR nl <> line_no OR ne0 <> e0 AS c0, nl IS NULL OR nl <> line_no OR ne0 <> e0 OR ne1 IS DISTINCT FROM e1 AS c1 FROM n)
SELECT tid, line_no, string_agg(CASE WHEN o0 THEN '<span class=''extra0-' || e0 || '''>' ELSE '' END || CASE WHEN o1 AND e1 IS NOT NULL THEN '<span class=''extra1-' || e1 || '''>' ELSE '' END || v
|| CASE WHEN c1 AND e1 IS NOT NULL THEN '</span>' ELSE '' END || CASE WHEN c0 THEN '</span>' ELSE '' END
|| CASE WHEN nl IS NULL THEN '' WHEN nk <> compound_no THEN CASE WHEN nl <> line_no THEN '' ELSE ' ' END WHEN nw <> word_no THEN '–' ELSE '-' END, '' ORDER BY sign_no) AS line FROM m GROUP BY ALL""")
def html_extra_spans(spark, sf_dir):
    """Lines with two extra attributes, one within the other."""
    more = bind.order_signs(spark, sf_dir).select("tid", "sign_no", F.floor(F.col("sign_no") / 2).cast("int").alias("e0"), F.when(F.col("flag") == "A", 1).when(F.col("flag") == "R", 2).alias("e1"))
    rows = _sign_rows(spark, sf_dir).withColumn("condition", F.lit("intact")).join(more, ["tid", "sign_no"])
    return html.lines(rows, ["tid"], ("e0", "e1"))
