"""Documents with everything that may go wrong, and brute-force versions of what the operators do."""

import random

CLASH = ["fp", "root", "score", "predicted", "bucket", "key", "did", "th", "row", "own", "x", "h", "count", "labels", "component_id", "sequence_id", "base"]


def edge_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioukstrnl") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long = prose(60), prose(6000)
    texts = [(1, prose(120)), (2, prose(80) + "\n" + shared + " " + prose(40)), (3, shared), (4, None), (5, ""), (6, "  \n\t "), (7, long), (8, long), (None, prose(50)), (None, None), (9, "a b"), (10, "Ünï cödé 日本語 " * 20), (11, "same " * 300)]
    texts += [(12, texts[0][1]), (12, texts[0][1]), (13, shared + " " + prose(5)), (14, "Released under the MIT License. CC BY x gnu general public license")]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 else "src0", None if k % 5 else len(t or "")) + tuple(f"{c}{k}" if k % 2 else None for c in CLASH) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def components(values, linked):
    """Smallest member of each value's component, by brute force."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(find(i), []).append(v)
    return {v: min(g) for g in groups.values() for v in g}
