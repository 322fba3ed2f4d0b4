import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphora.llm import substring

from .helpers import edge_documents, empty_documents


def slow(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_edges(spark):
    docs = edge_documents(spark)
    rows = docs.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *w) for r, w in zip(rows, slow([r.text for r in rows], 35), strict=True))
    assert result(substring.dedup(docs)) == want
    assert result(substring.dedup(docs, bucket=2000)) == want  # many buckets
    assert substring.dedup(empty_documents(spark)).count() == 0


def test_lengths():
    assert substring.lengths(35, 9) == [9, 18, 35] and substring.lengths(35, 35) == [35] and substring.lengths(4, 9) == [4]


@settings(max_examples=6, deadline=None, derandomize=True)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), min_size=1, max_size=8), st.sampled_from([3, 5]))
def test_few_words(spark, texts, window):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((k, *w) for k, w in enumerate(slow(texts, window)))
    assert result(substring.dedup(df, window=window, start=2, bucket=40)) == want


def test_cut_repeats(spark):
    docs = edge_documents(spark)
    cut = substring.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    by = {r.doc_id: r for r in cut.collect()}
    assert by[1].text == "" and by[4].text is None and by[6].text == "  \n\t " and by[3].text == ""
    assert by[10].text is not None and by[2].n_chars == len(by[2].text)


def test_windows_that_agree_in_one_hash_alone():
    a = np.array([5, 5, 7, 9, 9, 9], np.uint64)
    b = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    keys, more = np.array([5, 9, 9, 11], np.int64), np.array([2, 6, 4, 1], np.int64)
    assert substring._both_repeated(a, b, keys, more).tolist() == [False, True, False, True, False, True]
    none = np.zeros(0, np.int64)
    assert not substring._both_repeated(a, b, none, none).any()
    texts = substring.Texts(pa.chunked_array([["a b c a b c d", "a b d"]]), 3)
    key, more, n = texts.keys(3, texts.starts)
    assert len(set(zip(key.tolist(), more.tolist(), strict=True))) == len(key) == 5 and sorted(n.tolist()) == [1, 1, 1, 1, 2]
