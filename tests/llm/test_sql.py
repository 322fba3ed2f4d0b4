"""What SQL can say of queries that as a whole it can't: base columns, rules, places of pieces, over whole tables."""

import duckdb
from glyphora.llm import queries, urls

SF = "/root/testdata/sf0.001"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rows_of(sql, **frames):
    c = duckdb.connect()
    for name in ("documents", "pages"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, df in frames.items():
        c.register(name, df)
    return c.execute(sql).fetchall()


def sorted_rows(rows):
    return sorted((tuple(-1 if v is None else v for v in r) for r in rows), key=repr)


def test_base_columns_of_the_license_scan(spark):
    phrases = "(VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) AS p(p, label)"
    want = rows_of(rf"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    a AS (SELECT r, label, unnest([i FOR i IN range(0, len(w) - len(p) + 1) IF w[i + 1:i + len(p)] = p]) AS i FROM w, {phrases} WHERE len(w) >= len(p)),
    s AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM a GROUP BY r)
    SELECT doc_id, len(w), coalesce(n, 0), a, z, coalesce(labels, '') FROM w LEFT JOIN s USING (r)""")
    got = queries.op9_license_scan(spark, SF).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert sorted_rows(r[:6] for r in got) == sorted_rows(want) and any(r.n_base for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_hosts_paths_and_rules(spark):
    rules = "(VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES) + ") AS r(verdict, h, p)"
    want = rows_of(rf"""
    WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    m AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k FROM s, {rules} WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule, verdict FROM s LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)""")
    got = {r.page_id: r for r in queries.op10_url_filter(spark, SF).collect()}
    assert len(got) == len(want) and sum(w[3] is not None for w in want) > 5
    for page_id, host, path, rule, verdict in want:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_places_of_pieces(spark):
    pieces = queries.op5_best_fit_packing(spark, SF).toPandas()
    bad = rows_of(
        """WITH p AS (SELECT *, sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        sum(length) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told, max(piece) OVER (PARTITION BY doc_id) AS last FROM pieces)
        SELECT * FROM p WHERE "offset" <> coalesce(before, 0) OR start <> coalesce(told, 0) OR "offset" + length > 4096 OR (piece < last AND length <> 4096)""",
        pieces=pieces,
    )
    n, least, docs = rows_of('SELECT count(DISTINCT sequence_id), ceil(sum(length) / 4096), count(DISTINCT doc_id) FROM pieces', pieces=pieces)[0]
    assert not bad and n <= least + 1 and docs == rows_of("SELECT count(*) FROM documents")[0][0]


def test_classes_of_fingerprints(spark):
    """Components from the fingerprints that the query returns, by a recursive closure over pairs of values that differ in at most three bits."""
    found = queries.op1_simhash_neardup(spark, SF).toPandas()
    bad = rows_of(
        """WITH RECURSIVE v AS (SELECT DISTINCT fingerprint, ('0x' || fingerprint)::UBIGINT AS x FROM found), e AS (SELECT a.fingerprint AS a, b.fingerprint AS b FROM v a, v b WHERE bit_count(xor(a.x, b.x)::BIT) <= 3),
        c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), n AS (SELECT a, min(doc_id) AS least FROM c JOIN found ON found.fingerprint = c.b GROUP BY a)
        SELECT * FROM found JOIN n ON a = fingerprint WHERE component_id <> least""",
        found=found,
    )
    assert not bad and len(found) == rows_of("SELECT count(*) FROM documents")[0][0]
