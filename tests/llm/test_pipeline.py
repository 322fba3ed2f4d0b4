import corpus_pipeline
import public_tokenizers
from glyphora.llm import quality, queries

from .helpers import components, edge_documents
from .test_neardup import near, slow_fingerprint
from .test_substring import slow
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def leaked(text, items):
    """Whether most 8-word windows of an item stand in a text."""
    words = lambda t: [w.strip(".,;:!?").lower() for w in t.split()]
    windows = lambda w: {tuple(w[p : p + 8]) for p in range(len(w) - 7)}
    own = windows(words(text or ""))
    return any(len(own & windows(words(i))) >= 0.6 * max(1, len(words(i)) - 7) for i in items)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        made = stage(spark, docs, SF)
        made = spark.createDataFrame(made.collect(), made.schema)
        results.append((given, made.collect()))
        docs = made
    assert all(d[0].__fields__ == columns for _, d in results[:4])

    given, kept = results[0]
    scored = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in scored if r.score >= 0.7} and all(given[r.doc_id] == r for r in kept)

    given, kept = results[1]
    fps = {i: slow_fingerprint(r.text) for i, r in given.items()}
    root = components(sorted(set(fps.values())), near)
    first = {}
    for i, f in fps.items():
        first[root[f]] = min(i, first.get(root[f], i))
    assert {r.doc_id for r in kept} == set(first.values()) and all(given[r.doc_id] == r for r in kept)

    given, kept = results[2]
    want = dict(zip(given, slow([r.text for r in given.values()], 35), strict=True))
    assert {r.doc_id for r in kept} == set(given)
    for r in kept:
        n, removed, _ = want[r.doc_id]
        assert (r.text == given[r.doc_id].text) if not removed else len(r.text.split()) == n - removed and r.n_chars == len(r.text)

    given, kept = results[3]
    assert {r.doc_id for r in kept} == {i for i, r in given.items() if not leaked(r.text, items)}

    given, packed = results[4]
    total = sum(r.length for r in packed)
    assert check_packing(list(given.values()), packed, 4096) <= -(-total // 4096) + 1
    assert corpus_pipeline.TOKENIZER == public_tokenizers.path("word_bpe_49k.json")
    assert sorted(tuple(r[:5]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r[:5]) for r in packed)


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(queries.oracle_sql()) <= set(names)


def test_run_on_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns; then empty tables."""
    docs = edge_documents(spark)
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (7, 1, 0), (11, 0, 0), (14, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "x"), (2, "gnu general public license and more of the same words here")], "item_id long, text string").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "b" / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert rows.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    given = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, given, str(tmp_path / "a"))
        assert made.columns == docs.columns
        given = spark.createDataFrame(made.collect(), docs.schema)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    check_packing(given.collect(), rows.collect(), 4096)
    assert sorted(key(r[:5]) for r in rows.collect()) == sorted(key(r[:5]) for r in corpus_pipeline.best_fit_packing(spark, given, "").collect())
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
