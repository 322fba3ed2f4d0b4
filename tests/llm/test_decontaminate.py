import random

from glyphora.llm import decontaminate

from .helpers import edge_documents, empty_documents

ITEM = "schema: A farmer named Tom sells 12 apples for 5 dollars and then Tom buys 12 pears"


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string, start string, covered int")


def found(spark, texts, items):
    docs = table(spark, [(k, t, None, None) for k, t in enumerate(texts)], "doc_id")
    bench = table(spark, [(k, t, "x", 1) for k, t in enumerate(items)], "item_id")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}


def test_other_numbers_names_and_units(spark):
    same = "well. a farmer named Eve sells 7 apples for 9 euros and then Eve buys 7 pears and more"
    other_slots = "well. a farmer named Eve sells 7 apples for 9 euros and then Bob buys 8 pears and more"
    assert found(spark, [ITEM, same, other_slots, "a farmer sells pears and then buys apples"], [ITEM]) == {(0, 0), (1, 0)}


def test_literal_words_must_agree(spark):
    assert found(spark, ["a farmer named Tom eats 12 apples for 5 days and now Tom buys 12 pears"], [ITEM]) == set()


def test_short_items_and_repeats(spark):
    texts = ["what is 3 plus 4", "he asks what is 9 plus 1 today", "what is 3 minus 4", "what is 3 plus 4 " * 50]
    assert found(spark, texts, ["what is 3 plus 4"]) == {(0, 0), (1, 0), (3, 0)}


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{''.join(rng.choice('abcde') for _ in range(4))}" for _ in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 40))) for _ in range(12)]
    texts, want = [], set()
    for k in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if k % 4 == 0:
            i = rng.randrange(len(items))
            at = rng.randrange(len(body))
            body[at:at] = items[i].split()
            want.add((k, i))
        texts.append(" ".join(body))
    assert found(spark, texts, items) == want


def test_edges(spark):
    docs = edge_documents(spark)
    bench = spark.createDataFrame([(1, None), (None, "same same same same same same same same same"), (2, ""), (3, docs.where("doc_id = 1").first().text)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 3), (12, 3)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(empty_documents(spark), bench).count() == 0


def test_a_large_benchmark_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert found(spark, [ITEM], [ITEM]) == {(0, 0)}


def test_copies_dense_in_placeholders(spark):
    title = "What Is The Capital City Of The Republic Of France And When Was It Founded By The Romans"
    sums = "Compute 12 + 15 , 18 + 22 , 31 + 47 , 52 + 60 , 71 + 80 and report 5 sums"
    texts = [f"so he asked {title} today", f"Here: {sums} .", title.replace("Capital City", "Largest Town").replace("France And", "Spain Or"), "Compute 1 + 2 , 3 + 4 , 5 + 6 , 7 + 8 , 9 + 10 and tell 5 sums", "say Paris 7 now"]
    assert found(spark, texts, [title, sums, "Paris 7"]) == {(0, 0), (1, 1), (4, 2)}


def test_slots_need_not_match_one_to_one(spark):
    equal = ITEM.replace("12", "7").replace("for 5", "for 7")
    rest = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    item = f"he had 3 apples and gave them all to her for {rest} and then again 3 pears were left on the table"
    edited, other = item.replace("3 pears", "4 pears"), item.replace("3 apples", "5 apples").replace("3 pears", "4 pears").replace(rest, "nothing at all")
    assert found(spark, [equal, edited, other], [ITEM, item]) == {(0, 0), (1, 1)}


def test_names_and_numbers_of_several_words(spark):
    item = "A train leaves Paris at noon with 300 passengers and Maria Lopez counts 25 of them before the train reaches Lyon in the evening"
    texts = [
        item.replace("Paris", "New York City").replace("Maria Lopez", "Ann").replace("Lyon", "San Jose").replace("300", "1 200"),
        item.replace("Paris", "Rome").replace("Lyon", "Paris"),
        "x " + item + " y",
        item.replace("counts", "paints").replace("train", "boat").replace("passengers", "cows"),
    ]
    assert found(spark, texts, [item]) == {(0, 0), (1, 0), (2, 0)}
    rows = decontaminate.contaminated(table(spark, [(2, texts[2], None, None)], "doc_id"), table(spark, [(0, item, None, None)], "item_id")).collect()
    assert [(r.start, r.share) for r in rows] == [(1, 1.0)]


def test_a_repeated_row_is_one_group(spark):
    docs = table(spark, [(1, ITEM, None, None)], "doc_id").crossJoin(spark.range(3000)).drop("id")
    rows = decontaminate.contaminated(docs, table(spark, [(0, ITEM, None, None)], "item_id")).collect()
    assert len(rows) == 1 and rows[0].share == 1.0
    plan = decontaminate.contaminated(docs, table(spark, [(0, ITEM, None, None)], "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set(pairs" in plan and "collect_list" not in plan


def slow_canonical(text):
    """Tokens by words, one after another."""
    words, out, before = text.split(), [], True
    for w in words:
        core = w.strip(decontaminate.MARKS.decode())
        kind = "num" if decontaminate.NUMBER.match(core.encode()) else "name" if core[:1].isupper() and core[1:].islower() and not before else None
        out.append((kind, core.lower()))
        before = w.rstrip("\"')]}*_")[-1:] in tuple(".!?:;|")
    tokens = []
    for kind, core in out:
        if kind and tokens and tokens[-1][0] == kind:
            tokens[-1][1].append(core)
        else:
            tokens.append((kind, [core]))
    return [t for kind, run in tokens for t in ([(kind, tuple(run))] if len(run) <= decontaminate.RUN else [(kind, (w,)) for w in run])]


def test_reparameterised_items_against_brute_force(spark):
    """Items with slots, whose copies have other names and numbers of one to three words, against all alignments of tokens."""
    rng = random.Random(11)
    names, plain = ["Anna", "Bob Stone", "Carl Van Dam", "Dora"], [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    def make(slots):
        out = []
        for s in slots:
            out += [s] if isinstance(s, str) else [s[0]()]
        return " ".join(out)
    name, number = lambda: rng.choice(names), lambda: rng.choice(["7", "12", "3 000", "45"])
    shapes = [["begin"] + [rng.choice([*plain, *plain, (name,), (number,)]) if k % 4 == 3 else rng.choice(plain) for k in range(rng.randint(16, 24))] for _ in range(6)]
    items, texts = [make(s) for s in shapes], []
    for k in range(60):
        body = [rng.choice(plain) for _ in range(30)]
        texts.append(" ".join(body[:9] + ([make(shapes[k % 6])] if k % 2 else []) + body[9:]))
    want = set()
    for d, t in enumerate(texts):
        doc = slow_canonical(t)
        for i, x in enumerate(items):
            item = slow_canonical(x)
            same = lambda a, b: a[0] == b[0] and (a[0] is not None or a[1] == b[1])
            for shift in range(-len(item), len(doc)):
                on = [p for p in range(len(item)) if 0 <= p + shift < len(doc) and same(item[p], doc[p + shift])]
                whole = {q for p in range(len(item) - 7) if set(range(p, p + 8)) <= set(on) and sum(item[q][0] is None for q in range(p, p + 8)) >= 5 for q in range(p, p + 8)}
                slots = {(item[p][1], doc[p + shift][1]) for p in whole if item[p][0]}
                if len({a for a, _ in slots}) == len(slots) and (len(whole) >= 13 or len(whole) >= 0.6 * len(item)):
                    want.add((d, i))
    got = found(spark, texts, items)
    assert want and want <= got and all(d % 2 for d, _ in got)
