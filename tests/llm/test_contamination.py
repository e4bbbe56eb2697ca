import random

from metascope.llm.contamination import Block, exact_leaks, find_leaks, myers, words

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id string"


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], DOCS)
    e = spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], ITEMS)
    return find_leaks(d, e, **kw)


def brute(docs, items, n=12):
    out = set()
    grams = [{tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)} for t in docs]
    for i, t in enumerate(items):
        mine = {tuple(words(t)[k : k + n]) for k in range(len(words(t)) - n + 1)}
        out |= {(d, i) for d, g in enumerate(grams) if g & mine}
    return out


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rnd = random.Random(4)
    for _ in range(400):
        p, t = [rnd.randint(0, 3) for _ in range(rnd.randint(1, 14))], [rnd.randint(0, 3) for _ in range(rnd.randint(0, 20))]
        assert myers(p, t, 99) == distance(p, t)


def test_random_leaks_match_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(30)] + ["Ёж", "склад"]
    items = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 11, 12, 13, 25, 60]))) for _ in range(25)]
    docs = []
    for _ in range(60):
        ws = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.7:
            src = words(rnd.choice(items))
            a, n = rnd.randrange(len(src)), rnd.choice([5, 11, 12, 13, 40])
            at = rnd.randrange(len(ws) + 1)
            ws[at:at] = src[a : a + n]
        docs.append("".join(w.upper() + rnd.choice([" ", "\r\n> ", ", ", " **", "—"]) if rnd.random() < 0.3 else w + " " for w in ws))
    docs += [None, "", "   "]
    items += [None, "", items[0]]
    got = {(r.doc_id, r.item_id) for r in exact_leaks(leaks(spark, docs, items)).collect()}
    assert got == brute(docs, items)
    small = {(r.doc_id, r.item_id) for r in exact_leaks(leaks(spark, docs, items, block_words=50)).collect()}
    assert small == got, "blocks change nothing"


def test_budget_finds_one_changed_word():
    item = [f"a{i}" for i in range(30)]
    block = Block([(7, item)])
    for change in (lambda w: [*w[:6], "x", *w[7:]], lambda w: [*w[:6], *w[7:]], lambda w: [*w[:6], "x", *w[6:]]):
        for a in range(0, 18):
            text = " ".join(["z"] * 5 + change(item[a : a + 12]) + ["z"] * 5)
            assert [(i, d) for _, i, d, _ in block.search([text])] == [(7, 1)], (a, text)
    assert not list(block.search([" ".join([*item[3:9], "x", "y", *item[11:15]])]))


def test_long_texts_in_parts(monkeypatch):
    rnd = random.Random(2)
    items = [(i, [rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(12, 40))]) for i in range(8)]
    block, docs = Block(items), []
    for _ in range(12):
        ws = [rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(300)]
        for _, item in rnd.sample(items, 3):
            at = rnd.randrange(len(ws))
            ws[at:at] = item
        docs.append(", ".join(ws))
    whole = sorted(block.search(docs))
    monkeypatch.setattr("metascope.llm.contamination.LONG_TEXT", 100)
    monkeypatch.setattr("metascope.llm.contamination.PART_WORDS", 37)
    assert sorted(block.search([*docs, None, "short"])) == whole and len(whole) >= 24


def test_empty_tables(spark):
    assert leaks(spark, [], []).count() == 0 and leaks(spark, ["a b"], []).count() == 0 and leaks(spark, [], ["a " * 20]).count() == 0


def test_a_dotted_capital_i_is_no_end_of_a_word():
    assert words("İstanbul ve ΑΒ2") == ["i̇stanbul", "ve", "αβ2"]


def test_items_stay_off_the_driver(spark, monkeypatch):
    """One scan of the documents, whatever the number of blocks, and one number of the items at the driver."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    monkeypatch.setattr(DataFrame, "collect", None)
    item = " ".join(f"w{i}" for i in range(40))
    out = leaks(spark, [f"a {item} b"], [item, item + " c"] + [item.replace("w", f"v{k}") for k in range(30)], block_words=20)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.undo()
    assert {r.item_id for r in out.collect()} == {0, 1}
