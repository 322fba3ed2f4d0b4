from pathlib import Path

import numpy as np
import pyarrow as pa

from glyphora.llm import _common


def test_written_tables_are_deleted(spark):
    a, b = _common.written(spark.range(3), "a"), _common.written(spark.range(4), "b")
    paths = [Path(x._glyphora_path.removeprefix("file://")) for x in (a, b)]
    assert a.count() == 3 and all(p.exists() for p in paths)
    _common.drop_written(a)
    assert not paths[0].exists() and paths[1].exists()
    _common.clean(spark)
    assert not paths[1].exists() and not _common._PATHS


def test_steps_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (0, 5, 90, 1, 0, 200, 3)])], ["text"])
    parts = list(_common.text_steps(batch, "text", 100))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) > 2
    assert list(_common.text_steps(batch.slice(0, 0), "text")) == []


def test_window_hashes():
    words = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    twice = np.concatenate([words, words])
    h = _common.window_hashes(twice, 7)
    assert (h[:44] == h[50:94]).all() and len(set(h.tolist())) == 50 and len(_common.window_hashes(words[:3], 7)) == 0


def test_words_of():
    flat, sizes = _common.words_of(pa.array([" a  b\n", "", "\t", "é c\x0bd"], pa.large_string()))
    assert flat.to_pylist() == ["a", "b", "é", "c", "d"] and sizes.tolist() == [2, 0, 0, 3]
