"""Queries over the driver's tables for the corpus operators, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.functions import labels, position
from glyphora.operators import aggregates, citation, log, stats, trees
from glyphora.plans import search as plan
from glyphora.sources import bindings as bind
from glyphora.sources.store import materialized

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Corpora as SQL: documents (b1), orders (b2) and their texts, the tree of places (b3), the event log (b4), turns (b5).
B1 = r"""b1l AS (
  SELECT doc_id AS tid, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), b1w AS (
  SELECT tid, lang, source, line_no, regexp_replace(lower(unnest(string_split(line, ' '))), '[^\p{L}]', '', 'g') AS value,
         generate_subscripts(string_split(line, ' '), 1) AS k FROM b1l
), b1 AS (
  SELECT tid, lang, source, line_no, value, row_number() OVER (PARTITION BY tid ORDER BY line_no, k) - 1 AS sign_no FROM b1w WHERE value <> ''
)"""
#: b1 with what follows: values and numbers of the next two words, and the line of the one before.
B1N = f"""{B1}, b1n AS (
  SELECT *, lead(value) OVER o AS v1, lead(value, 2) OVER o AS v2, lag(line_no) OVER o AS line_before, lead(line_no) OVER o AS line_after FROM b1 WINDOW o AS (PARTITION BY tid ORDER BY sign_no)
)"""
B2 = """b2r AS (
  SELECT l.*, row_number() OVER o - 1 AS sign_no,
         coalesce((l_returnflag <> lag(l_returnflag) OVER o)::INT, 0) AS w, coalesce((l_linestatus <> lag(l_linestatus) OVER o)::INT, 0) AS c
  FROM lineitem l WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)
), b2 AS (
  SELECT l_orderkey AS tid, sign_no, l_partkey AS value_id, p_type AS grapheme, p_brand AS glyph, l_returnflag AS flag, l_linestatus AS status,
         sum(w) OVER o AS word_no, sum(c) OVER o AS compound_no, sign_no // 3 AS line_no
  FROM b2r JOIN part ON l_partkey = p_partkey WINDOW o AS (PARTITION BY l_orderkey ORDER BY sign_no)
)"""
B2T = """b2t AS (
  SELECT o_orderkey AS tid, o_custkey AS text_id, o_orderpriority AS period, o_orderstatus AS genre, n_name AS provenience, c_mktsegment AS object
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)"""
B3 = """b3 AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL
  SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
)"""
B4 = """b4 AS (
  SELECT user_id AS tid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS log_no,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'update' ELSE 'other' END AS action,
         ((floor(value)::BIGINT % 50) + 50) % 50 AS entry_no, event_type IN ('view', 'purchase') AS internal, event_id AS edit_no FROM events
)"""
B5 = """b5t AS (
  SELECT *, coalesce((role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT, 0) AS t FROM conversations
), b5 AS (
  SELECT conv_id AS tid, turn AS line_no, role, text, sum(t) OVER (PARTITION BY conv_id ORDER BY turn) AS block_no FROM b5t
)"""


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(leaf):
    """Leaves of a corpus whose values are words: value, pattern, x."""
    if leaf.kind == "value":
        return F.col("value") == leaf.text
    if leaf.kind == "pattern":
        return F.col("value").rlike(f"^(?:{leaf.text})$")
    return F.col("value").isNotNull()


def _documents(spark: SparkSession, sf_dir: str, *more: str, edges: bool = False) -> DataFrame:
    """Each word is a sign, a word and a part of its line's compound."""
    rows = bind.document_tokens(spark, sf_dir, *more, edges=edges).withColumns({"word_no": F.col("sign_no"), "compound_no": F.col("line_no")})
    if edges:
        rows = rows.withColumns({f"{side}_{n}": F.col(f"{side}_line") if n == "compound" else F.lit(True) for side in ("starts", "ends") for n in ("compound", "word")})
    return rows


def _find(spark: SparkSession, sf_dir: str, text: str, edges: bool = False, show: str | None = None) -> DataFrame:
    return plan.search(_documents(spark, sf_dir, edges=edges), text, _words, aliases=False, show=show)


def _array(c: str):
    return F.array_join(c, ",").alias(c)


@query(f"WITH {B1N} SELECT tid, sign_no AS first, sign_no + 1 AS second FROM b1n WHERE value = 'the' AND v1 = 'of'")
def search_value_adjacent(spark, sf_dir):
    return _find(spark, sf_dir, "the of").select("tid", F.get("signs", F.lit(0)).alias("first"), F.get("signs", F.lit(1)).alias("second"))


@query(f"WITH {B1} SELECT tid, sign_no, line_no, value FROM b1")
def token_scan(spark, sf_dir):
    return bind.document_tokens(spark, sf_dir).select("tid", "sign_no", "line_no", "value")


@query(f"WITH {B1} SELECT tid AS text_id, value, count(*) AS count FROM b1 GROUP BY ALL")
def values_count_per_text(spark, sf_dir):
    signs = bind.document_tokens(spark, sf_dir)
    return signs.groupBy(F.col("tid").alias("text_id"), "value").agg(F.count("*").alias("count"))


@query(f"WITH {B2}, {B2T} SELECT text_id, glyph, count(*) AS count FROM b2 JOIN b2t USING (tid) GROUP BY ALL")
def sign_variants_count_per_text(spark, sf_dir):
    return stats.per_text(bind.order_signs(spark, sf_dir), bind.order_texts(spark, sf_dir), "glyph")


@query("SELECT o_custkey AS text_id, count(*) AS count FROM orders GROUP BY ALL")
def transliteration_count(spark, sf_dir):
    return stats.transliterations_per_text(bind.order_texts(spark, sf_dir))


def _presence_sql(item: str, kept: str = "true") -> str:
    return f"""WITH {B2}, {B2T}, n AS (SELECT text_id, {item}, count(*) AS c FROM b2 JOIN b2t USING (tid) WHERE {kept} GROUP BY ALL),
    t AS (SELECT text_id, count(*) AS times, min(period) AS period, min(provenience) AS provenience, min(genre) AS genre, min(object) AS object FROM b2t GROUP BY ALL)
    SELECT {item}, period, provenience, genre, object, sum(c)::BIGINT AS count, round(sum(c / times), 6) AS count_norm FROM n JOIN t USING (text_id) GROUP BY ALL"""


@query(_presence_sql("grapheme"))
def presence_cube(spark, sf_dir):
    return stats.presence(bind.order_signs(spark, sf_dir), bind.order_texts(spark, sf_dir), "grapheme")


@query(_presence_sql("glyph"))
def sign_variants_present(spark, sf_dir):
    return stats.presence(bind.order_signs(spark, sf_dir), bind.order_texts(spark, sf_dir), "glyph")


@query(f"WITH {B1N} SELECT tid, sign_no AS first FROM b1n WHERE value = 'of' AND v1 = 'the' AND v2 = 'that'")
def search_three_chain(spark, sf_dir):
    return _find(spark, sf_dir, "of the that").select("tid", F.get("signs", F.lit(0)).alias("first"))


@query(_presence_sql("grapheme", "NOT (tid % 7 = 0 AND flag = 'R')"))
def presence_update(spark, sf_dir):
    """The presence cube after every seventh order has lost its returned parts, from the cube before and these orders alone."""
    signs, texts = bind.order_signs(spark, sf_dir), bind.order_texts(spark, sf_dir)
    kept = materialized(stats.presence(signs, texts, "grapheme", places=None), "presence")
    before = signs.where("tid % 7 = 0")
    return stats.presence_after(kept, before, before.where("flag <> 'R'"), texts, "grapheme").withColumn("count_norm", F.round("count_norm", 6))


@query(f"""WITH {B1} SELECT a.tid, count(*) AS matches FROM b1 a JOIN b1 b ON a.tid = b.tid AND a.sign_no < b.sign_no AND a.line_no = b.line_no
WHERE a.value = 'the' AND b.value = 'of' GROUP BY a.tid""")
def search_ellipsis_same_line(spark, sf_dir):
    return _find(spark, sf_dir, "[the … of]").groupBy("tid").agg(F.count("*").alias("matches"))


@query(f"WITH {B1N} SELECT tid, sign_no AS first, v1 AS second FROM b1n WHERE value = 'the' AND v1 IN ('of', 'that', 'and')")
def search_alternative(spark, sf_dir):
    found = _find(spark, sf_dir, "the (of|that|and)", show="value")
    return found.select("tid", F.get("signs", F.lit(0)).alias("first"), F.get("shown", F.lit(1)).alias("second"))


@query(f"WITH {B1N} SELECT tid, sign_no AS first FROM b1n WHERE (value = 'the' AND v1 = 'that') OR (value = 'that' AND v1 = 'the')")
def search_unordered(spark, sf_dir):
    return _find(spark, sf_dir, "the:that").select("tid", F.get("signs", F.lit(0)).alias("first"))


def _orders_search(spark, sf_dir, text: str) -> DataFrame:
    """value a… stands for the return flag or line status of that letter, a sign X… for a part type."""
    condition = lambda leaf: F.lower("flag") == leaf.text if leaf.kind == "value" else F.upper("grapheme") == leaf.text
    return plan.search(bind.order_signs(spark, sf_dir), text, condition, aliases=False)


@query(f"WITH {B2} SELECT a.tid, a.sign_no AS first FROM b2 a JOIN b2 b ON a.tid = b.tid AND b.sign_no = a.sign_no + 1 AND a.word_no = b.word_no WHERE a.grapheme = 'ECONOMY' AND b.grapheme = 'ECONOMY'")
def search_same_word(spark, sf_dir):
    return _orders_search(spark, sf_dir, "ECONOMY=ECONOMY").select("tid", F.get("signs", F.lit(0)).alias("first"))


@query(f"WITH {B2} SELECT a.tid, a.sign_no AS first FROM b2 a JOIN b2 b ON a.tid = b.tid AND b.sign_no = a.sign_no + 1 AND a.compound_no = b.compound_no WHERE a.grapheme = 'PROMO' AND b.grapheme = 'SMALL'")
def search_same_compound(spark, sf_dir):
    return _orders_search(spark, sf_dir, "PROMO-SMALL").select("tid", F.get("signs", F.lit(0)).alias("first"))


@query(f"""WITH {B2} SELECT a.tid, a.sign_no AS first, b.word_no, b.line_no FROM b2 a JOIN b2 b ON a.tid = b.tid AND b.sign_no = a.sign_no + 1
WHERE a.word_no <> b.word_no AND a.line_no <> b.line_no AND a.grapheme = 'PROMO' AND b.grapheme = 'STANDARD'""")
def search_breaks(spark, sf_dir):
    found = _orders_search(spark, sf_dir, "PROMO ; // STANDARD")
    return found.select("tid", F.get("signs", F.lit(0)).alias("first"), F.get("words", F.lit(1)).alias("word_no"), F.get("lines", F.lit(1)).alias("line_no"))


@query(f"WITH {B1N} SELECT tid, sign_no AS first FROM b1n WHERE value = 'the' AND (line_before IS NULL OR line_before <> line_no)")
def search_anchor(spark, sf_dir):
    return _find(spark, sf_dir, "// the", edges=True).select("tid", F.get("signs", F.lit(0)).alias("first"))


@query(f"WITH {B1N} SELECT tid, sign_no AS first FROM b1n WHERE value = 'the' AND v1 = 'of' AND coalesce(line_before <> line_no, true) AND line_after = line_no")
def search_anchor_chain(spark, sf_dir):
    return _find(spark, sf_dir, "// [the of]", edges=True).select("tid", F.get("signs", F.lit(0)).alias("first"))


_ANCHORS = ["; ECONOMY", ", ECONOMY", "// ECONOMY", "ECONOMY ;", "ECONOMY ,", "ECONOMY //", "; // ECONOMY ,"]


@query(f"""WITH {B2}, n AS (SELECT *, coalesce(lag(word_no) OVER o <> word_no, true) AS w0, coalesce(lag(compound_no) OVER o <> compound_no, true) AS c0, coalesce(lag(line_no) OVER o <> line_no, true) AS l0,
coalesce(lead(word_no) OVER o <> word_no, true) AS w1, coalesce(lead(compound_no) OVER o <> compound_no, true) AS c1, coalesce(lead(line_no) OVER o <> line_no, true) AS l1 FROM b2 WINDOW o AS (PARTITION BY tid ORDER BY sign_no))
SELECT pattern, tid, sign_no AS first FROM n, (VALUES {', '.join(f"('{p}')" for p in _ANCHORS)}) AS x(pattern) WHERE grapheme = 'ECONOMY' AND CASE pattern
WHEN '; ECONOMY' THEN w0 WHEN ', ECONOMY' THEN c0 WHEN '// ECONOMY' THEN l0 WHEN 'ECONOMY ;' THEN w1 WHEN 'ECONOMY ,' THEN c1 WHEN 'ECONOMY //' THEN l1 ELSE w0 AND l0 AND c1 END""")
def search_anchor_kinds(spark, sf_dir):
    """Each break at each end: matches that begin or end a word, a compound or a line."""
    found = [_orders_search(spark, sf_dir, p).select(F.lit(p).alias("pattern"), "tid", F.get("signs", F.lit(0)).alias("first")) for p in _ANCHORS]
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {B1N} SELECT tid, count(*) AS matches FROM b1n WHERE regexp_matches(value, '^th.*n$') AND v1 = 'the' GROUP BY ALL")
def search_pattern_regex(spark, sf_dir):
    return _find(spark, sf_dir, "/th.*n/ the").groupBy("tid").agg(F.count("*").alias("matches"))


@query(f"""WITH {B1N} SELECT tid, sign_no AS first, lang, source FROM b1n
WHERE value = 'the' AND v1 = 'of' AND lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2')""")
def search_filters(spark, sf_dir):
    found = _find(spark, sf_dir, "the of").select("tid", F.get("signs", F.lit(0)).alias("first"))
    texts = bind.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), "lang", "source")
    return plan.filtered(found, texts, lang=["en", "de"], source=["src0", "src1", "src2"], tid=[])


@query(f"WITH {B1N} SELECT tid, sign_no || ',' || (sign_no + 1) AS signs, sign_no || '' AS c1, (sign_no + 1) || '' AS c2 FROM b1n WHERE value = 'that' AND v1 = 'of'")
def search_wildcards(spark, sf_dir):
    found = _find(spark, sf_dir, "(that) (of)")
    return found.select("tid", _array("signs"), F.array_join(F.col("captures")[1], ",").alias("c1"), F.array_join(F.col("captures")[2], ",").alias("c2"))


@query(f"""WITH {B2}, p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS component, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k, len(string_split(p_name, ' ')) AS n FROM part),
c AS (SELECT tid, sign_no, component, sign_no * 128 + k AS pos, CASE WHEN k + 1 = n THEN (sign_no + 1) * 128 ELSE sign_no * 128 + k + 1 END AS next_pos FROM b2 JOIN p ON value_id = p_partkey),
m AS (SELECT min(component) FILTER (WHERE k + 1 = n) AS low, min(component) FILTER (WHERE k = 0) AS high FROM p),
f AS (SELECT *, lead(component) OVER o AS then_component, lead(pos) OVER o AS then_pos, lead(sign_no) OVER o AS then_no FROM c WINDOW o AS (PARTITION BY tid ORDER BY pos))
SELECT tid, sign_no AS first, then_no AS second FROM f, m WHERE component = low AND then_component = high AND next_pos = then_pos""")
def search_component_chain(spark, sf_dir):
    """Components of signs across sign boundaries: words of a part's name."""
    part = bind.table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    p = part.select(F.col("p_partkey").alias("value_id"), F.size(words).alias("n"), F.posexplode(words).alias("k", "component"))
    signs = bind.order_signs(spark, sf_dir).drop("pos", "next_pos").join(p, "value_id")
    packed = position.pack(F.col("sign_no"), F.col("k"), F.col("k") + 1 == F.col("n"))
    rows = signs.withColumn("p", packed).withColumns({"pos": position.key(F.col("p")), "next_pos": position.successor(F.col("p"))})
    ends = p.agg(F.min(F.when(F.expr("k + 1 = n"), F.col("component"))), F.min(F.when(F.expr("k = 0"), F.col("component")))).first()
    low, high = ends if ends[0] is not None else ("", "")
    found = plan.search(rows, "A B", lambda leaf: F.col("component") == (low if leaf.text == "A" else high), aliases=False)
    return found.select("tid", F.get("signs", F.lit(0)).alias("first"), F.get("signs", F.size("signs") - 1).alias("second"))


_RELATION = """SELECT tid, sign_no, (sign_no + 1) * 256 + k * 2 + (k = 1)::INT AS position, word_no, compound_no, line_no, NULL::BIGINT AS value_id, component AS grapheme FROM (
  SELECT *, unnest([grapheme, glyph]) AS component, unnest([0, 1]) AS k FROM b2) UNION ALL
SELECT tid, sign_no, (sign_no + 1) * 256 + 1, word_no, compound_no, line_no, value_id, NULL FROM b2 UNION ALL
SELECT tid, NULL, min(sign_no) * 256 + 1, min(word_no) - 1, min(compound_no) - 1, min(line_no) - 1, NULL, NULL FROM b2 GROUP BY tid UNION ALL
SELECT tid, NULL, (max(sign_no) + 2) * 256 + 1, max(word_no) + 1, max(compound_no) + 1, max(line_no) + 1, NULL, NULL FROM b2 GROUP BY tid UNION ALL
SELECT DISTINCT tid, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL FROM b2"""


@query(f"WITH {B2} {_RELATION}")
def search_relation(spark, sf_dir):
    from glyphora.operators import relation

    signs = bind.order_signs(spark, sf_dir)
    parts = signs.select("tid", "sign_no", F.posexplode(F.array("grapheme", "glyph")).alias("component_no", "grapheme"))
    rows = relation.search_relation(signs.select("tid", "sign_no", "word_no", "compound_no", "line_no", "value_id"), parts, ["tid"])
    return rows.select("tid", "sign_no", "position", "word_no", "compound_no", "line_no", "value_id", "grapheme")


@query(f"""WITH {B2} SELECT tid, sign_no, sign_no * 256 + (sign_no % 3) * 2 + (sign_no % 2) AS packed, sign_no * 128 + sign_no % 3 AS key,
CASE WHEN sign_no % 2 = 1 THEN (sign_no + 1) * 128 ELSE sign_no * 128 + sign_no % 3 + 1 END AS next_key, sign_no || '.' || (sign_no % 3) || '.' || (sign_no % 2) AS shown FROM b2""")
def position_algebra(spark, sf_dir):
    rows = bind.order_signs(spark, sf_dir).select("tid", "sign_no")
    rows = rows.withColumn("packed", position.pack(F.col("sign_no"), F.col("sign_no") % 3, F.col("sign_no") % 2 == 1))
    p = position.parse(position.show(F.col("packed")))
    return rows.select("tid", "sign_no", "packed", position.key(p).alias("key"), position.successor(p).alias("next_key"), position.show(p).alias("shown"))


@query(f"WITH {B2} SELECT tid, word_no, flag, min(sign_no) AS first, max(sign_no) AS last FROM b2 GROUP BY ALL")
def word_runs(spark, sf_dir):
    return bind.order_signs(spark, sf_dir).groupBy("tid", "word_no", "flag").agg(F.min("sign_no").alias("first"), F.max("sign_no").alias("last"))


@query(f"""WITH RECURSIVE {B3}, r AS (SELECT id, id AS ancestor FROM b3 UNION SELECT r.id, b3.parent FROM r JOIN b3 ON r.ancestor = b3.id WHERE b3.parent IS NOT NULL)
SELECT id, ancestor FROM r""")
def closure(spark, sf_dir):
    return trees.closure(bind.places(spark, sf_dir))


@query(f"""WITH RECURSIVE {B3}, r AS (SELECT id, id AS ancestor FROM b3 UNION SELECT r.id, b3.parent FROM r JOIN b3 ON r.ancestor = b3.id WHERE b3.parent IS NOT NULL),
d AS (SELECT o_orderkey AS text_id, 'c' || o_custkey AS id FROM orders UNION SELECT l_orderkey, 's' || l_suppkey FROM lineitem)
SELECT DISTINCT text_id, ancestor AS id FROM d JOIN r USING (id)""")
def texts_compositions(spark, sf_dir):
    orders, lines = bind.table(spark, sf_dir, "orders"), bind.table(spark, sf_dir, "lineitem")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string")).alias("id")
    direct = orders.select(F.col("o_orderkey").alias("text_id"), name("c", "o_custkey")).union(lines.select("l_orderkey", name("s", "l_suppkey")))
    return trees.all_compositions(direct, bind.places(spark, sf_dir))


_TYPE = "CASE {} WHEN 'O' THEN 'reduced' WHEN 'F' THEN 'default' WHEN 'P' THEN 'augmented' WHEN 'A' THEN 'nondefault' WHEN 'R' THEN 'nonstandard' ELSE 'default' END"
_ORD = "CASE {} WHEN 'default' THEN 0 WHEN 'nondefault' THEN 1 WHEN 'reduced' THEN 2 WHEN 'augmented' THEN 3 WHEN 'nonstandard' THEN 4 END"


def _type(c: str):
    return F.when(F.col(c) == "O", "reduced").when(F.col(c) == "F", "default").when(F.col(c) == "P", "augmented").when(F.col(c) == "A", "nondefault").when(F.col(c) == "R", "nonstandard").otherwise("default")


@query(f"""WITH t AS (SELECT DISTINCT {_TYPE.format('l_returnflag')} AS a, {_TYPE.format('o_orderstatus')} AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a, b, CASE WHEN a = b THEN a WHEN greatest({_ORD.format('a')}, {_ORD.format('b')}) IN (2, 3) AND least({_ORD.format('a')}, {_ORD.format('b')}) = 0 THEN CASE WHEN a = 'default' THEN b ELSE a END
WHEN greatest({_ORD.format('a')}, {_ORD.format('b')}) >= 2 THEN 'nonstandard' ELSE 'nondefault' END AS merged FROM t""")
def merge_variant_types(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").join(bind.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_returnflag", "o_orderstatus").distinct().select(_type("l_returnflag").alias("a"), _type("o_orderstatus").alias("b")).distinct()
    return rows.withColumn("merged", aggregates.merge_variant_types(F.col("a"), F.col("b")))


_CONDITION = "CASE {} WHEN 'A' THEN 'damaged' WHEN 'R' THEN 'inserted' ELSE 'lost' END"


@query(f"""WITH c AS (SELECT l_orderkey AS tid, {_CONDITION.format('l_returnflag')} AS c FROM lineitem)
SELECT tid, CASE WHEN min(c) = max(c) THEN min(c) WHEN bool_or(c IN ('inserted', 'deleted')) THEN NULL ELSE 'damaged' END AS condition FROM c GROUP BY tid""")
def condition_merge(spark, sf_dir):
    c = F.when(F.col("l_returnflag") == "A", "damaged").when(F.col("l_returnflag") == "R", "inserted").otherwise("lost")
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), c.alias("c"))
    return rows.groupBy("tid").agg(aggregates.condition_merge(F.col("c")).alias("condition"))


@query(f"WITH {B2} SELECT tid, arg_max(grapheme, sign_no) AS last_value FROM b2 GROUP BY tid")
def last_agg(spark, sf_dir):
    return bind.order_signs(spark, sf_dir).groupBy("tid").agg(aggregates.last(F.col("grapheme"), "sign_no").alias("last_value"))


@query(f"""WITH {B2}, n AS (SELECT *, count(*) OVER (PARTITION BY tid) AS n FROM b2)
SELECT tid, coalesce(bool_and(flag = 'N') FILTER (sign_no + 1 < n), true) AS all_but_last FROM n GROUP BY tid""")
def bool_and_ex_last(spark, sf_dir):
    return aggregates.all_but_last(bind.order_signs(spark, sf_dir), ["tid"], ["sign_no"], F.col("flag") == "N", "all_but_last")


@query(f"""WITH {B5}, cited AS (SELECT * FROM b5 WHERE text LIKE '%the%'), i AS (
  SELECT *, line_no - row_number() OVER (PARTITION BY tid ORDER BY line_no) AS island FROM cited
), r AS (
  SELECT tid, island, min(line_no) AS a, max(line_no) AS z, arg_min(block_no, line_no) AS ab, arg_max(block_no, line_no) AS zb, arg_min(role, line_no) AS ar, arg_max(role, line_no) AS zr FROM i GROUP BY ALL
), p AS (SELECT *, lag(zb) OVER (PARTITION BY tid ORDER BY island) AS pb FROM r)
SELECT tid, string_agg((CASE WHEN pb IS NULL OR pb <> ab THEN ar || ' ' ELSE '' END) || a || (CASE WHEN a = z THEN '' WHEN ab <> zb THEN ' – ' || zr || ' ' || z ELSE '–' || z END), '; ' ORDER BY island) AS citation
FROM p GROUP BY tid""")
def citation_lines(spark, sf_dir):
    rows = bind.turns(spark, sf_dir).where("text like '%the%'")
    none, zero = F.lit("").alias("surface"), F.lit(0).alias("surface_no")
    return citation.cite(rows.select("tid", "line_no", none, zero, F.col("role").alias("block"), "block_no", F.col("line_no").cast("string").alias("line")), ["tid"])


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey AS text_id, CASE WHEN n > 1 THEN c_name || ' ' || c_mktsegment ELSE c_name END AS extended_citation FROM n""")
def citations_display(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("text_id"), F.col("c_nationkey").alias("ensemble_id"), F.col("c_name").alias("citation"), F.col("c_mktsegment").alias("object_type"))
    return citation.extended(rows)


@query("""WITH s AS (SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN 'obverse' WHEN 1 THEN 'reverse' WHEN 2 THEN 'top' WHEN 3 THEN 'bottom' WHEN 4 THEN 'left' WHEN 5 THEN 'right' WHEN 6 THEN 'fragment' ELSE 'surface' END AS k, p_brand AS d FROM part)
SELECT id, CASE k WHEN 'obverse' THEN 'o.' WHEN 'reverse' THEN 'r.' WHEN 'top' THEN 'u.e.' WHEN 'bottom' THEN 'lo.e.' WHEN 'left' THEN 'l.e.' WHEN 'right' THEN 'r.e.' WHEN 'surface' THEN coalesce(d, '') ELSE k || coalesce(' ' || d, '') END AS short,
CASE k WHEN 'obverse' THEN 'obverse' WHEN 'reverse' THEN 'reverse' WHEN 'top' THEN 'upper edge' WHEN 'bottom' THEN 'lower edge' WHEN 'left' THEN 'left edge' WHEN 'right' THEN 'right edge' WHEN 'surface' THEN coalesce(d, '') ELSE k || coalesce(' ' || d, '') END AS long FROM s""")
def surfaces_display(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("obverse", "reverse", "top", "bottom", "left", "right", "fragment", "surface")])
    rows = bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(kinds, F.col("p_size") % 8).alias("k"), F.col("p_brand").alias("d"))
    return rows.select("id", labels.surface_short(F.col("k"), F.col("d")).alias("short"), labels.surface_long(F.col("k"), F.col("d"), F.lit("")).alias("long"))


@query("""WITH s AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'column' WHEN 1 THEN 'block' ELSE 'caption' END AS k, p_size::VARCHAR AS d, p_size AS n FROM part)
SELECT id, CASE k WHEN 'column' THEN repeat('x', n // 10 - CASE WHEN n >= 40 THEN n // 10 ELSE 0 END) || (CASE WHEN n >= 50 THEN 'l' || repeat('x', n // 10 - 5) WHEN n >= 40 THEN 'xl' ELSE '' END) || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]
WHEN 'block' THEN d ELSE k || ' ' || d END AS short FROM s""")
def blocks_display(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("column", "block", "caption")])
    rows = bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(kinds, F.col("p_size") % 3).alias("k"), F.col("p_size").cast("string").alias("d"))
    return rows.select("id", labels.block_short(F.col("k"), F.col("d")).alias("short"))


_MOVE = "CASE WHEN t.no IS NULL THEN NULL WHEN l.action = 'insert' AND l.entry_no <= t.no THEN t.no + 1 WHEN l.action = 'delete' AND l.entry_no = t.no THEN NULL WHEN l.action = 'delete' AND l.entry_no < t.no THEN t.no - 1 ELSE t.no END"


@query(f"""WITH RECURSIVE {B4}, n AS (SELECT tid, max(log_no) + 1 AS n FROM b4 GROUP BY tid), t AS (
  SELECT tid, 0::BIGINT AS k, 25::BIGINT AS no FROM n UNION ALL
  SELECT t.tid, t.k + 1, {_MOVE} FROM t JOIN b4 l ON l.tid = t.tid AND l.log_no = t.k
) SELECT t.tid, t.no AS entry_no FROM t JOIN n ON t.tid = n.tid AND t.k = n.n""")
def log_trace(spark, sf_dir):
    return log.trace(bind.event_log(spark, sf_dir), ["tid"], F.lit(25))


@query(f"""WITH RECURSIVE {B4}, t AS (
  SELECT tid, log_no AS origin, log_no + 1 AS k, entry_no AS no FROM b4 WHERE action IN ('insert', 'update') UNION ALL
  SELECT t.tid, t.origin, t.k + 1, {_MOVE} FROM t JOIN b4 l ON l.tid = t.tid AND l.log_no = t.k WHERE t.no IS NOT NULL
), n AS (SELECT tid, max(log_no) + 1 AS n FROM b4 GROUP BY tid), e AS (SELECT DISTINCT t.tid, no FROM t JOIN n ON t.tid = n.tid AND t.k = n.n WHERE no IS NOT NULL)
SELECT n.tid, coalesce(string_agg(no::VARCHAR, ',' ORDER BY no), '') AS entry_nos FROM n LEFT JOIN e USING (tid) GROUP BY n.tid""")
def log_affected(spark, sf_dir):
    return log.affected(bind.event_log(spark, sf_dir), ["tid"]).select("tid", _array("entry_nos"))


@query(f"""WITH RECURSIVE {B4}, n AS (SELECT tid, max(log_no) + 1 AS n FROM b4 GROUP BY tid), t AS (
  SELECT tid, n AS k, 7::BIGINT AS no, NULL::BIGINT AS edit FROM n UNION ALL
  SELECT t.tid, t.k - 1, CASE WHEN t.no IS NULL THEN NULL WHEN l.action = 'insert' AND l.entry_no = t.no THEN NULL WHEN l.action = 'insert' AND l.entry_no < t.no THEN t.no - 1
    WHEN l.action = 'delete' AND l.entry_no <= t.no THEN t.no + 1 ELSE t.no END, CASE WHEN l.action IN ('insert', 'update') AND l.entry_no = t.no THEN l.edit_no END
  FROM t JOIN b4 l ON l.tid = t.tid AND l.log_no = t.k - 1
) SELECT tid, 7 AS entry_no, coalesce(string_agg(edit::VARCHAR, ',' ORDER BY k DESC), '') AS edit_nos FROM (SELECT tid, edit, max(k) AS k FROM t GROUP BY tid, edit) GROUP BY tid""")
def log_agg(spark, sf_dir):
    rows = bind.event_log(spark, sf_dir)
    entries = rows.select("tid").distinct().withColumn("entry_no", F.lit(7))
    return log.touching(rows, entries, ["tid"]).select("tid", "entry_no", _array("edit_nos"))


@query(f"""WITH {B4}, c AS (SELECT *, coalesce((internal <> lag(internal) OVER (PARTITION BY tid ORDER BY log_no))::INT, 0) AS t FROM b4),
g AS (SELECT *, sum(t) OVER (PARTITION BY tid ORDER BY log_no) AS run_no FROM c)
SELECT tid, run_no, internal, min(log_no) AS first, max(log_no) AS last FROM g GROUP BY ALL""")
def internal_groups(spark, sf_dir):
    rows = aggregates.runs(bind.event_log(spark, sf_dir), ["tid"], ["log_no"], "internal")
    return rows.groupBy("tid", "run_no", "internal").agg(F.min("log_no").alias("first"), F.max("log_no").alias("last"))


# The sign list of part names: signs, graphemes, allographs, allomorphs, components, variants (b6v), composition (b6c).
B6 = """sg AS (SELECT p_name, min(p_partkey) AS sign_id FROM part GROUP BY p_name
), wd AS (SELECT w, min(p_partkey * 10 + k) AS g FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k FROM part) GROUP BY w
), al AS (SELECT g * 10 + 1 AS a, g, w, upper(w) AS glyph, 0 AS t, true AS s FROM wd UNION ALL SELECT g * 10 + 2, g, w, upper(w) || '2', 1, false FROM wd UNION ALL SELECT g * 10 + 3, g, w, upper(w) || '3', 2, false FROM wd WHERE length(w) % 2 = 0
), mo AS (SELECT sign_id * 10 + 1 AS m, sign_id, 0 AS t, true AS s, string_split(p_name, ' ') AS ws FROM sg UNION ALL SELECT sign_id * 10 + 2, sign_id, 1, false, list_reverse(string_split(p_name, ' ')) FROM sg
), mg AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (0, 1, 1), (1, 1, 1), (2, 1, 4), (0, 2, 2), (1, 2, 4), (2, 2, 2), (0, 4, 4), (1, 4, 4), (2, 4, 4)) AS x(a, b, r)
), vr AS (
  SELECT sign_id, m, [x.a, y.a] AS ids, [x.g, y.g] AS gs, [x.a, y.a] AS glyph_ids, upper(x.w) || '.' || upper(y.w) AS graphemes, x.glyph || '.' || y.glyph AS glyphs, mo.t AS mt, q.r AS t, x.s AND y.s AND mo.s AS s
  FROM mo JOIN al x ON x.w = ws[1] JOIN al y ON y.w = ws[2] JOIN mg p ON p.a = x.t AND p.b = mo.t JOIN mg q ON q.a = y.t AND q.b = p.r
), b6v AS (SELECT *, ['default', 'nondefault', 'reduced', 'augmented', 'nonstandard'][t + 1] AS variant_type FROM (SELECT *, rank() OVER (PARTITION BY sign_id, glyph_ids ORDER BY t, mt, gs) AS k FROM vr) WHERE k = 1
), b6c AS (SELECT *, row_number() OVER (ORDER BY sign_id, m, ids) AS sign_variant_id FROM b6v
), vl AS (SELECT sign_id * 10 + 1 AS vv, sign_id, replace(p_name, ' ', '') || '1' AS value FROM sg UNION ALL SELECT sign_id * 10 + 2, sign_id, regexp_replace(p_name, ' .*', '') || 'x' FROM sg
), ve AS (
  SELECT value, sign_spec, value_id, sign_variant_id FROM (SELECT *, row_number() OVER (PARTITION BY value, sign_spec ORDER BY t, value_id, sign_variant_id) AS k FROM (
    SELECT value, glyphs AS sign_spec, sign_id AS value_id, sign_variant_id, t FROM vl JOIN b6c USING (sign_id) UNION ALL
    SELECT value, NULL, sign_id, sign_variant_id, t FROM vl JOIN b6c USING (sign_id) WHERE t = 0 AND value NOT LIKE '%x%' UNION ALL
    SELECT regexp_replace(value, '[0-9]+$', '') || 'x', glyphs, sign_id, sign_variant_id, t FROM vl JOIN b6c USING (sign_id) WHERE value NOT LIKE '%x%')) WHERE k = 1
)"""


def _signlist(spark, sf_dir):
    from glyphora.operators import signlist

    t = bind.part_signlist(spark, sf_dir)
    t["sign_variants"] = materialized(signlist.numbered(signlist.variants(t)), "variants")
    return t, materialized(signlist.composition(t), "composition")


def _dictionary(spark, sf_dir, printed: bool = True):
    """The sign list of part names with what is computed from it, each written once; printed: with the characters too."""
    from glyphora.operators import encoder, signlist

    t, composed = _signlist(spark, sf_dir)
    made = {"sign_map": signlist.sign_map(t), "values_encoded": encoder.values_encoded(t, composed), "signs_encoded": encoder.signs_encoded(composed)}
    if printed:
        made["characters"] = signlist.characters(t, composed)
    return t | {"composed": composed} | {name: materialized(df, name) for name, df in made.items()}


@query(f"WITH {B6} SELECT sign_id, m AS allomorph_id, array_to_string(ids, ',') AS allograph_ids, variant_type, s AS specific FROM b6v")
def variant_enumeration(spark, sf_dir):
    from glyphora.operators import signlist

    return signlist.variants(bind.part_signlist(spark, sf_dir)).select("sign_id", "allomorph_id", _array("allograph_ids"), "variant_type", "specific")


@query(f"WITH {B6} SELECT sign_variant_id, sign_id, graphemes, glyphs, '□□' AS unicode, array_to_string(glyph_ids, ',') AS glyph_ids FROM b6c")
def composition_strings(spark, sf_dir):
    return _signlist(spark, sf_dir)[1].select("sign_variant_id", "sign_id", "graphemes", "glyphs", "unicode", _array("glyph_ids"))


@query(f"WITH {B6} SELECT value, sign_spec, value_id, sign_variant_id FROM ve")
def values_encoded(spark, sf_dir):
    from glyphora.operators import encoder

    return encoder.values_encoded(*_signlist(spark, sf_dir))


@query(f"""WITH {B6} SELECT glyphs AS sign, NULL AS sign_spec, sign_variant_id FROM b6c WHERE s UNION ALL
SELECT a.glyphs, b.glyphs, b.sign_variant_id FROM b6c a JOIN b6c b USING (sign_id) WHERE a.t = 0""")
def signs_encoded(spark, sf_dir):
    from glyphora.operators import encoder

    return encoder.signs_encoded(_signlist(spark, sf_dir)[1])


@query(f"""WITH {B6}, v AS (SELECT upper(value) AS u FROM vl) SELECT DISTINCT * FROM (
  SELECT upper(p_name_1) AS identifier, graphemes, glyphs FROM (SELECT replace(p_name, ' ', '') || '1' AS p_name_1, sign_id FROM sg) JOIN (SELECT sign_id, upper(ws[1]) || '.' || upper(ws[2]) AS graphemes, upper(ws[1]) || '.' || upper(ws[2]) AS glyphs FROM mo WHERE t = 0) USING (sign_id) UNION ALL
  SELECT 'SYN' || glyph, NULL, glyph FROM al WHERE t = 2 UNION ALL
  SELECT upper(w), upper(w), upper(w) FROM wd WHERE upper(w) NOT IN (SELECT u FROM v) UNION ALL
  SELECT glyph, CASE WHEN s THEN upper(w) END, glyph FROM al WHERE glyph NOT IN (SELECT u FROM v) UNION ALL SELECT 'X', 'X', 'X')""")
def sign_map_union(spark, sf_dir):
    from glyphora.operators import signlist

    return signlist.sign_map(bind.part_signlist(spark, sf_dir)).select("identifier", "graphemes", "glyphs").distinct()


@query(f"""WITH {B6}, r AS (SELECT p_partkey AS tid, replace(p_name, ' ', '') || '1' AS value, CASE WHEN p_size % 2 = 0 THEN upper(replace(p_name, ' ', '2.')) END AS sign_spec FROM part)
SELECT tid, value_id, sign_variant_id FROM r JOIN ve ON r.value = ve.value AND r.sign_spec IS NOT DISTINCT FROM ve.sign_spec""")
def encoder_null_safe(spark, sf_dir):
    from glyphora.operators import encoder

    t = _dictionary(spark, sf_dir, printed=False)
    name = F.col("p_name")
    spec = F.when(F.col("p_size") % 2 == 0, F.upper(F.regexp_replace(name, " ", "2.")))
    rows = bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tid"), F.concat(F.regexp_replace(name, " ", ""), F.lit("1")).alias("value"), spec.alias("sign_spec"), F.lit("value").alias("type"))
    found = encoder.encode(rows, ["tid"], t["sign_map"], t["values_encoded"], t["signs_encoded"])
    return found.select("tid", "value_id", "sign_variant_id")


_SIGN_ROWS = f"""{B2}, r AS (SELECT tid, sign_no, word_no, compound_no, line_no, lower(grapheme) AS v, CASE flag WHEN 'A' THEN 'damaged' WHEN 'R' THEN 'lost' ELSE 'intact' END AS c FROM b2),
n AS (SELECT *, lag(c) OVER o AS pc, lag(line_no) OVER o AS pl, lag(word_no) OVER o AS pw, lead(c) OVER o AS nc, lead(line_no) OVER o AS nl, lead(word_no) OVER o AS nw, lead(compound_no) OVER o AS nk FROM r WINDOW o AS (PARTITION BY tid ORDER BY sign_no))"""
_CODE = """CASE WHEN pc IS NULL OR pc <> c OR pl <> line_no THEN CASE c WHEN 'lost' THEN '[' WHEN 'damaged' THEN '⸢' ELSE '' END ELSE '' END || v
|| CASE WHEN nc IS NULL OR nc <> c OR nl <> line_no THEN CASE c WHEN 'lost' THEN ']' WHEN 'damaged' THEN '⸣' ELSE '' END ELSE '' END
|| CASE WHEN nc IS NULL THEN '' WHEN nk <> compound_no THEN CASE WHEN nl <> line_no THEN '' ELSE ' ' END WHEN nw <> word_no THEN '--' ELSE '-' END"""


def _sign_rows(spark, sf_dir):
    rows = bind.order_signs(spark, sf_dir)
    none, no = lambda t: F.lit(None).cast(t), F.lit(False)
    return rows.select(
        "tid", "sign_no", "word_no", "compound_no", "line_no", F.lower("grapheme").alias("value"), F.when(F.col("flag") == "A", "damaged").when(F.col("flag") == "R", "lost").otherwise("intact").alias("condition"),
        none("int").alias("section_no"), none("string").alias("section_name"), F.lit("value").alias("type"), F.lit("none").alias("indicator_type"), none("boolean").alias("phonographic"), none("boolean").alias("stem"),
        none("string").alias("language"), no.alias("inverted"), no.alias("newline"), no.alias("ligature"), none("string").alias("crits"), none("string").alias("comment"), no.alias("capitalized"), none("string").alias("pn_type"), none("string").alias("compound_comment"),
    )


@query(f"WITH {_SIGN_ROWS} SELECT tid, line_no, string_agg({_CODE}, '' ORDER BY sign_no) AS content FROM n GROUP BY ALL")
def serialize_lines(spark, sf_dir):
    from glyphora.operators import serialize

    return serialize.lines(_sign_rows(spark, sf_dir), ["tid"])


@query(f"WITH {_SIGN_ROWS.replace('FROM b2)', 'FROM b2 WHERE sign_no BETWEEN 1 AND 3)')} SELECT tid, line_no, string_agg({_CODE}, '' ORDER BY sign_no) AS content FROM n GROUP BY ALL")
def serialize_range(spark, sf_dir):
    from glyphora.operators import serialize

    return serialize.in_range(_sign_rows(spark, sf_dir), ["tid"], F.lit(1), F.lit(3))


@query(f"""WITH {_SIGN_ROWS} SELECT tid, line_no, string_agg(CASE WHEN c <> 'intact' AND (pc IS NULL OR pc <> c OR pl <> line_no) THEN '<span class=''open-' || c || '''></span>' ELSE '' END
|| CASE WHEN c <> 'intact' AND (pc IS NULL OR pc <> c OR pl <> line_no OR pw <> word_no) THEN '<span class=''' || c || '''>' ELSE '' END || v
|| CASE WHEN c <> 'intact' AND (nc IS NULL OR nc <> c OR nl <> line_no OR nw <> word_no) THEN '</span>' ELSE '' END
|| CASE WHEN c <> 'intact' AND (nc IS NULL OR nc <> c OR nl <> line_no) THEN '<span class=''close-' || c || '''></span>' ELSE '' END
|| CASE WHEN nc IS NULL THEN '' WHEN nk <> compound_no THEN CASE WHEN nl <> line_no THEN '' ELSE ' ' END WHEN nw <> word_no THEN '–' ELSE '-' END, '' ORDER BY sign_no) AS line FROM n GROUP BY ALL""")
def html_spans(spark, sf_dir):
    from glyphora.operators import html

    return html.lines(_sign_rows(spark, sf_dir), ["tid"])


@query(f"""WITH {B5}, l AS (SELECT tid, block_no, min(role) AS role, string_agg(line_no || chr(9) || regexp_replace(text, '[^a-z]', '', 'g'), chr(10) ORDER BY line_no) AS content FROM b5 GROUP BY tid, block_no)
SELECT tid, string_agg('@column ' || role || chr(10) || content, chr(10) ORDER BY block_no) AS content FROM l GROUP BY tid""")
def serialize_document(spark, sf_dir):
    from glyphora.operators import serialize

    t = bind.turns(spark, sf_dir)
    none, no, zero = lambda k: F.lit(None).cast(k), F.lit(False), F.lit(0)
    signs = t.select(
        "tid", F.col("line_no").alias("sign_no"), F.col("line_no").alias("word_no"), F.col("line_no").alias("compound_no"), "line_no", F.regexp_replace("text", "[^a-z]", "").alias("value"), F.lit("intact").alias("condition"),
        none("int").alias("section_no"), none("string").alias("section_name"), F.lit("value").alias("type"), F.lit("none").alias("indicator_type"), none("boolean").alias("phonographic"), none("boolean").alias("stem"),
        none("string").alias("language"), no.alias("inverted"), no.alias("newline"), no.alias("ligature"), none("string").alias("crits"), none("string").alias("comment"), no.alias("capitalized"), none("string").alias("pn_type"), none("string").alias("compound_comment"),
    )
    tables = {
        "lines": t.select("tid", "line_no", "block_no", F.col("line_no").cast("string").alias("line"), none("string").alias("line_comment")),
        "blocks": t.groupBy("tid", "block_no").agg(F.min("role").alias("block_data")).select("tid", "block_no", zero.alias("surface_no"), F.lit("column").alias("block_type"), "block_data", none("string").alias("block_comment")),
        "surfaces": t.select("tid").distinct().select("tid", zero.alias("surface_no"), F.lit("surface").alias("surface_type"), none("string").alias("surface_data"), none("string").alias("surface_comment")),
    }
    return serialize.documents(signs, tables, ["tid"])


@query("""WITH w AS (SELECT conv_id AS tid, turn, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS line_no FROM conversations),
b AS (SELECT coalesce(a.tid, z.tid) AS tid, coalesce(a.line_no, z.line_no) AS line_no, a.text AS o, z.text AS n FROM (SELECT * FROM w WHERE turn = 0) a FULL JOIN (SELECT * FROM w WHERE turn = 1) z ON a.tid = z.tid AND a.line_no = z.line_no),
c AS (SELECT *, line_no - row_number() OVER (PARTITION BY tid ORDER BY line_no) AS g FROM b WHERE o IS DISTINCT FROM n)
SELECT tid, min(line_no) AS line_no_start, max(line_no) AS line_no_end, string_agg(o, ' / ' ORDER BY line_no) AS old, string_agg(n, ' / ' ORDER BY line_no) AS new FROM c GROUP BY tid, g""")
def full_outer_diff(spark, sf_dir):
    from glyphora.operators import diff

    words = bind.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tid"), "turn", F.posexplode(F.split("text", " ", -1)).alias("line_no", "text"))
    return diff.changed_lines(words.where("turn = 0").drop("turn"), words.where("turn = 1").drop("turn"), ["tid"])


@query(f"""WITH {B2}, s AS (SELECT tid, string_agg(grapheme[1], '' ORDER BY sign_no) AS s FROM b2 GROUP BY tid), p AS (SELECT *, lag(s) OVER (PARTITION BY text_id ORDER BY tid) AS old FROM s JOIN (SELECT o_orderkey AS tid, o_custkey AS text_id FROM orders) USING (tid))
SELECT tid, levenshtein(old, s) AS cost FROM p WHERE old IS NOT NULL""")
def levenshtein_cost(spark, sf_dir):
    from glyphora.operators.signlist import ordered

    signs = bind.order_signs(spark, sf_dir).groupBy("tid").agg(F.array_join(ordered(F.substring("grapheme", 1, 1), F.col("sign_no")), "").alias("s"))
    rows = signs.join(bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_custkey").alias("text_id")), "tid")
    rows = rows.withColumn("old", F.lag("s").over(Window.partitionBy("text_id").orderBy("tid"))).where("old is not null")
    return rows.select("tid", F.levenshtein("old", "s").cast("bigint").alias("cost"))


@query(f"""WITH RECURSIVE {B2}, s AS (SELECT tid, list(grapheme ORDER BY sign_no) AS s FROM b2 GROUP BY tid),
p AS (SELECT *, lag(s) OVER (PARTITION BY text_id ORDER BY tid) AS old FROM s JOIN (SELECT o_orderkey AS tid, o_custkey AS text_id FROM orders) USING (tid)),
q AS (SELECT tid, old, s, len(old) AS m, len(s) AS n FROM p WHERE old IS NOT NULL),
d AS (
  SELECT tid, 0 AS i, range(0, n + 1) AS r, old, s, m, n FROM q UNION ALL
  SELECT tid, i + 1, [list_min([CASE WHEN k = 0 THEN i + 1 ELSE least(r[k] + (s[k] <> old[i + 1])::INT, r[k + 1] + 1) END + j - k FOR k IN range(0, j + 1)]) FOR j IN range(0, n + 1)], old, s, m, n FROM d WHERE i < m
), g AS (SELECT tid, list(r ORDER BY i) AS c, any_value(old) AS old, any_value(s) AS s, any_value(m) AS m, any_value(n) AS n FROM d GROUP BY tid),
t AS (
  SELECT tid, m AS i, n AS j, []::VARCHAR[] AS ops, c, old, s FROM g UNION ALL
  SELECT tid, CASE w WHEN 2 THEN i ELSE i - 1 END, CASE w WHEN 1 THEN j ELSE j - 1 END,
    CASE WHEN w = 0 AND old[i] = s[j] THEN ops WHEN w = 0 THEN list_prepend('UPDATE ' || (j - 1) || ' ' || s[j], ops) WHEN w = 1 THEN list_prepend('DELETE ' || j, ops) ELSE list_prepend('INSERT ' || (j - 1) || ' ' || s[j], ops) END, c, old, s
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND c[i + 1][j + 1] = c[i][j] + (old[i] <> s[j])::INT THEN 0 WHEN i > 0 AND c[i + 1][j + 1] = c[i][j + 1] + 1 THEN 1 ELSE 2 END AS w FROM t WHERE i > 0 OR j > 0)
) SELECT t.tid, c[len(old) + 1][len(s) + 1]::INTEGER AS cost, array_to_string(ops, ';') AS script FROM t WHERE i = 0 AND j = 0""")
def edit_script(spark, sf_dir):
    """Script that turns the part types of a customer's order into those of the next."""
    from glyphora.operators.editing import levenshtein
    from glyphora.operators.signlist import ordered

    signs = bind.order_signs(spark, sf_dir).groupBy("tid").agg(ordered(F.col("grapheme"), F.col("sign_no")).alias("s"))
    rows = signs.join(bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_custkey").alias("text_id")), "tid")
    rows = rows.withColumn("old", F.lag("s").over(Window.partitionBy("text_id").orderBy("tid"))).where("old is not null").select("tid", "old", "s")

    def kernel(batches):
        for b in batches:
            found = [levenshtein(list(o), list(s)) for o, s in zip(b["old"], b["s"], strict=True)]
            b["cost"] = [c for c, _ in found]
            b["script"] = [";".join(f"{op} {no} {v or ''}".strip() for op, no, v in ops) for _, ops in found]
            yield b[["tid", "cost", "script"]]

    return rows.mapInPandas(kernel, "tid bigint, cost int, script string")


@query("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def delete_empty(spark, sf_dir):
    from glyphora.operators.editing import empty_parents

    parents = bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return empty_parents(parents, bind.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")), ["id"])


@query(f"""WITH {B2} SELECT tid, compound_no, dense_rank() OVER (PARTITION BY tid ORDER BY compound_no) - 1 AS new_no, count(*) AS n FROM b2 WHERE flag <> 'N' GROUP BY tid, compound_no""")
def split_merge(spark, sf_dir):
    """Compounds that are left when signs go, with their new numbers."""
    from glyphora.operators import diff

    rows = bind.order_signs(spark, sf_dir).where("flag <> 'N'").groupBy("tid", "compound_no").agg(F.count("*").alias("n"))
    return diff.renumbered(rows, ["tid"], ["compound_no"], "new_no")


@query(f"""WITH {B1N}, m AS (SELECT tid, sign_no FROM b1n WHERE regexp_matches(value, '^th.*') AND regexp_matches(v1, '^th.*'))
SELECT tid, sign_no || ',' || (sign_no + 1) AS signs, coalesce(lag(sign_no) OVER o = sign_no - 1, false) OR coalesce(lead(sign_no) OVER o = sign_no + 1, false) AS overlap FROM m WINDOW o AS (PARTITION BY tid ORDER BY sign_no)""")
def replace_overlaps(spark, sf_dir):
    from glyphora.operators import diff

    return diff.overlaps(_find(spark, sf_dir, "/th.*/ /th.*/").select("tid", "signs"), ["tid"]).select("tid", _array("signs"), "overlap")


@query(f"""WITH {B1N}, m AS (SELECT tid, sign_no AS s FROM b1n WHERE value = 'of' AND v1 = 'the'),
r AS (SELECT b1.tid, sign_no, CASE WHEN x.s IS NOT NULL THEN 'ofthe' ELSE value END AS value FROM b1 LEFT JOIN m x ON b1.tid = x.tid AND sign_no = x.s LEFT JOIN m y ON b1.tid = y.tid AND sign_no = y.s + 1 WHERE y.s IS NULL)
SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY sign_no) - 1 AS sign_no, value FROM r WHERE tid IN (SELECT tid FROM m)""")
def replace_tokens(spark, sf_dir):
    """Documents in which `of the` occurs, with it written as one word, and all words numbered anew."""
    from glyphora.operators import diff

    found = _find(spark, sf_dir, "of the").select("tid", F.get("signs", F.lit(0)).alias("a"), F.get("signs", F.lit(1)).alias("b"))
    parts = found.select("tid", F.explode(F.array(F.struct(F.col("a").alias("sign_no"), F.lit("ofthe").alias("new")), F.struct(F.col("b").alias("sign_no"), F.lit(None).cast("string").alias("new")))).alias("x")).select("tid", "x.*").withColumn("hit", F.lit(True))
    words = bind.document_tokens(spark, sf_dir).select("tid", "sign_no", "value").join(found.select("tid").distinct(), "tid", "left_semi")
    rows = words.join(parts, ["tid", "sign_no"], "left").where("hit is null or new is not null").withColumn("value", F.coalesce("new", "value")).drop("new", "hit")
    return diff.renumbered(rows.withColumnRenamed("sign_no", "o"), ["tid"], ["o"], "sign_no").drop("o")


@query(f"""WITH {B2}, c AS (SELECT tid, compound_no, min(status) AS kind, list(grapheme ORDER BY sign_no) AS e FROM b2 GROUP BY ALL),
t AS (SELECT DISTINCT p_type AS a FROM part), s AS (SELECT DISTINCT l_linestatus AS kind FROM lineitem),
n AS (SELECT x.a AS name, kind, [x.a] AS e FROM t x, s UNION ALL SELECT x.a || ' ' || y.a, kind, [x.a, y.a] FROM t x, t y, s WHERE x.a < y.a)
SELECT tid, compound_no, name FROM (SELECT tid, compound_no, name, row_number() OVER (PARTITION BY tid, compound_no ORDER BY len(n.e) DESC, name) AS k FROM c JOIN n USING (kind) WHERE c.e[1:len(n.e)] = n.e) WHERE k = 1""")
def pn_prefix_match(spark, sf_dir):
    from glyphora.operators import names
    from glyphora.operators.signlist import ordered

    signs = bind.order_signs(spark, sf_dir)
    compounds = signs.groupBy("tid", "compound_no").agg(F.min("status").alias("kind"), ordered(F.col("grapheme"), F.col("sign_no")).alias("elements"))
    types = bind.table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_type")).alias("t"))  # the few part types
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: a < b), lambda b: F.array(a, b))))
    spelled = types.select(F.concat(F.transform("t", lambda a: F.array(a)), pairs)).scalar()
    known = bind.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kind")).distinct().withColumn("elements", F.explode(spelled))
    return names.prefix_matches(compounds, known.withColumn("name", F.array_join("elements", " ")), ["tid", "compound_no"], ["name"])


@query(f"""WITH {B2}, f AS (SELECT min_by(p_name, p_partkey) AS name FROM part), c AS (SELECT tid, min(sign_no) AS sign_no FROM b2 GROUP BY tid, compound_no)
SELECT tid, count(*)::INTEGER AS n, string_agg(sign_no, ',' ORDER BY sign_no) AS written FROM c JOIN b2 USING (tid, sign_no) JOIN part ON p_partkey = value_id, f WHERE p_name = f.name GROUP BY tid""")
def pn_alignment(spark, sf_dir):
    """Orders whose parts are written as signs (a word each, as runs of flags don't keep to compounds), with each compound that the first part's name
    begins written like that name: which signs have changed."""
    from glyphora.operators import corpus_search

    t = _dictionary(spark, sf_dir, printed=False)
    first = bind.table(spark, sf_dir, "part").agg(F.min_by("p_name", "p_partkey")).first()[0]
    signs = bind.sign_rows(spark, sf_dir, t["composed"])
    begins = F.col("sign_no") == F.min("sign_no").over(Window.partitionBy(bind.KEY, "compound_no"))
    links = signs.withColumn("begins", begins).where(F.col("begins") & (F.col("p_name") == F.lit(first))).select(bind.KEY, "compound_no")
    plain = signs.withColumns({"stem": begins, "sign_variant_id": F.col("plain_variant_id"), "value_id": F.lit(None).cast("int"), "type": F.lit("sign"), "indicator_type": F.lit("none"), "phonographic": F.lit(None).cast("boolean"), "custom_value": F.lit(None).cast("string")})
    out = corpus_search.respell(bind.sign_tables(plain), links, f"{first.replace(' ', '')}1", t)
    written = F.filter(F.transform("corpus", lambda r, i: F.when(r["value_id"].isNotNull(), i)), lambda i: i.isNotNull())
    return out.select(F.col(corpus_search.KEY).cast("bigint").alias("tid"), F.size(written).alias("n"), F.array_join(written, ",").alias("written"))


@query("""WITH n AS (SELECT p_partkey AS id, string_split(upper(p_name), ' ') AS w FROM part)
SELECT id, w[1] || '.' || w[2] || '.C' AS chain, '(' || w[1] || '.C)&(' || w[2] || '.D)' AS stacks, w[1] || '@t×(' || w[2] || '.A)' AS kept, true AS matched FROM n""")
def sign_tree(spark, sf_dir):
    from glyphora.functions import signtree

    w = F.split(F.upper("p_name"), " ")
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    rows = bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(a, F.lit(".("), b, F.lit(".C)")).alias("x"), F.concat(F.lit("("), a, F.lit("&"), b, F.lit(").(C&D)")).alias("y"), F.concat(a, F.lit("@t×("), b, F.lit(".A)")).alias("z"))
    n = signtree.normalize_column
    return rows.select("id", n(F.col("x")).alias("chain"), n(F.col("y")).alias("stacks"), n(F.col("z")).alias("kept"), signtree.matches_column(F.col("z"), "X×X").alias("matched"))


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 50 GROUP BY ALL), z AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY ALL)
SELECT user_id, event_type, coalesce(o.n, 0) + coalesce(z.n, 0) AS n FROM o FULL JOIN z USING (user_id, event_type)""")
def upsert_merge(spark, sf_dir):
    from glyphora.operators import diff

    count = lambda cond: bind.table(spark, sf_dir, "events").where(cond).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return diff.upsert(count("value < 50"), count("value >= 50"), ["user_id", "event_type"], "n")


@query(f"""WITH {B6} SELECT value, NULL AS sign_spec, 'v' || sign_id AS code FROM vl UNION ALL SELECT value, glyphs, 'v' || sign_id || 's' || sign_variant_id FROM vl JOIN b6c USING (sign_id)""")
def values_search(spark, sf_dir):
    from glyphora.operators import dictionary

    return dictionary.values_search(*_signlist(spark, sf_dir))


@query(f"WITH {B6} SELECT upper(value) AS sign, CASE WHEN i = 2 THEN glyphs END AS sign_spec, 's' || sign_variant_id AS code FROM vl JOIN b6c USING (sign_id), (VALUES (1), (2)) AS x(i)")
def signs_search(spark, sf_dir):
    from glyphora.operators import dictionary

    return dictionary.signs_search(*_signlist(spark, sf_dir))


@query(f"WITH {B6} SELECT a.glyphs AS sign, CASE WHEN i = 2 THEN b.glyphs END AS sign_spec, 's' || b.sign_variant_id AS code FROM b6c a JOIN b6c b USING (sign_id), (VALUES (1), (2)) AS x(i) WHERE a.s")
def sign_descriptions_search(spark, sf_dir):
    from glyphora.operators import dictionary

    return dictionary.sign_descriptions_search(_signlist(spark, sf_dir)[1])


@query(f"""WITH {B6} SELECT upper(value) AS form, NULL AS sign_spec, '(g' || x.g || '|c' || x.a || ')~(g' || y.g || '|c' || y.a || ')' AS code
FROM vl JOIN mo USING (sign_id) JOIN al x ON x.w = ws[1] JOIN al y ON y.w = ws[2] WHERE mo.s AND x.s AND y.s UNION ALL
SELECT upper(value), glyphs, 'c' || glyph_ids[1] || '~c' || glyph_ids[2] FROM vl JOIN b6c USING (sign_id)""")
def forms_search(spark, sf_dir):
    from glyphora.operators import dictionary

    return dictionary.forms_search(*_signlist(spark, sf_dir))


@query(f"""WITH {B6} SELECT upper(w) AS form, NULL AS sign_spec, 'g' || g AS code FROM wd UNION ALL SELECT upper(w), glyph, 'c' || a FROM al UNION ALL SELECT glyph, NULL, 'c' || a FROM al""")
def form_descriptions_search(spark, sf_dir):
    from glyphora.operators import dictionary

    return dictionary.form_descriptions_search(bind.part_signlist(spark, sf_dir))


@query(f"""WITH {B6} SELECT sign_id, sign_variant_id, graphemes, glyphs, variant_type, s AS specific, sign_id AS value_id, vv AS value_variant_id, value, vv = sign_id * 10 + 1 AS main FROM vl JOIN b6c USING (sign_id)""")
def signlist_listing(spark, sf_dir):
    from glyphora.operators import signlist

    return signlist.signlist(*_signlist(spark, sf_dir)).drop("unicode")


from glyphora import sign_queries  # noqa: E402, F401  registers the rest
