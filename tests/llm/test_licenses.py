import random
import re

import pytest

from glyphora.llm import licenses

from .helpers import edge_documents, empty_documents


def slow(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan(df).collect(), key=lambda r: r.doc_id)]


def test_base_places(spark):
    docs = edge_documents(spark)
    none = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted(none((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.scan(docs).collect())
    assert got == sorted(none((d.doc_id, *slow(d.text))) for d in docs.collect())
    assert licenses.scan(empty_documents(spark)).count() == 0


def test_spans_with_changes(spark):
    mit = dict(licenses.TEMPLATES)["mit"].split()
    changed = mit[:12] + ["really"] + mit[12:40] + mit[41:]  # a word more, a word less
    rows = scan(spark, ["intro words here " + " ".join(mit) + " and more", " ".join(changed), " ".join(mit[:15]), "CC  BY", "licensed under the apache licence", None, ("x " * 400 + " ".join(mit) + " ") * 3])
    assert [r.labels for r in rows] == ["mit", "mit", "", "cc-by", "", "", "mit"]
    assert rows[0].score == 1.0 and 0.98 <= rows[1].score < 1.0 and rows[3].score == 0.5 and rows[2].score == 0.0


def test_the_best_of_licenses_alike(spark):
    own = dict(licenses.TEMPLATES)
    rows = scan(spark, ["Licensed under CC BY-NC 4.0. " + own["cc-by-nc-4.0"], "the gnu General public LICENSE; mit-license", "x " + own["gpl-3.0"] + " y", own["cc-by-sa-4.0"] + " and also " + own["cc-by-4.0"]])
    assert [r.labels for r in rows] == ["cc-by,cc-by-nc-4.0", "gpl,mit", "gpl,gpl-3.0", "cc-by-4.0,cc-by-sa-4.0"] and rows[1].n_base == 2


def common(a, b):
    """Longest common subsequence, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_alignment():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(1, 14))] for _ in range(2))
        covered, first, end = licenses.aligned(a, b)
        n = common(a, b)
        assert common(a, b[first:end]) == n and (not n or covered == n / max(len(a), end - first)) and all(common(a, b[first + 1 : end]) < n or not n for _ in [0])
    assert licenses.diagonals([(5, 1), (7, 9), (10, 2), (40, 1), (13, 3)], 3) == [7, 13, 40]
    spans = [(rng.choice([0.6, 0.7, 0.9]), s := rng.randint(0, 60), s + rng.randint(1, 9), k) for k in range(60)]
    assert sorted(licenses._best(spans)) == sorted(x for x in spans if not any(y[0] > x[0] and y[1] < x[2] and x[1] < y[2] and y in licenses._best(spans) for y in spans))


def test_against_all_places(spark):
    """Labels by the best alignment of each template with any run of words, in texts with words changed, left out and put in."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(200)]
    templates = [(f"t{k}", " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(3)]
    texts, changes = [], []
    for n in range(40):
        words = templates[n % 3][1].split()
        changes.append(rng.choice([0, 1, 2, 3, 14, 18]))
        for _ in range(changes[-1]):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"]])
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] + words + [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.spans(docs, templates).collect():
        got.setdefault(r.did, set()).add((r.label, r.start, r.end, round(r.covered, 9)))
    for n, text in enumerate(texts):
        words = text.split()
        best = {label: max(common(t.split(), words[s : s + size]) / max(30, size) for s in range(len(words)) for size in range(20, 37)) for label, t in templates}
        labels = {x[0] for x in got.get(n, ())}
        for label, covered in best.items():  # stray words may lengthen a span a little
            assert label in labels or covered < licenses.COVER + 0.05 or changes[n] > licenses.DRIFT * 30  # more may drift too far, or leave no gram
            assert label not in labels or covered >= licenses.COVER
        assert all(common(dict(templates)[label].split(), words[s:e]) / max(30, e - s) == pytest.approx(c) for label, s, e, c in got.get(n, ()))
    assert len(got) > 20


def test_short_templates_are_phrases(spark):
    with pytest.raises(ValueError):
        licenses.spans(spark.createDataFrame([(1, "x")], "doc_id long, text string"), [("a", "Released under the MIT License.")])
