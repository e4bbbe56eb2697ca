import json
import random

from metascope.operators.nested import found_items, flat_items, record_tables

SCHEMA = "record_id bigint, record_kind string, payload string, label string"


def found(spark, *payloads):
    rows = [(i, "form", p if p is None or isinstance(p, str) else json.dumps(p, ensure_ascii=False), "x") for i, p in enumerate(payloads)]
    return sorted(tuple(r) for r in found_items(spark.createDataFrame(rows, SCHEMA)).collect())


FORM = {"form": {"form_name": "F", "events": [{"event": "OnOpen", "handler": "H"}], "elements": [
    {"element_id": 1, "element_name": "a", "elements": {"element_name": "b", "events": {"by_event": {"X": {"module": "M.F", "method": "do"}, "Y": "go"}}}}, {"element_id": "2", "events": {"event": "E", "handler": {"method": "only"}}}]}}
WANT = [
    (0, "element", "F/1", "F"), (0, "element", "F/2", "F"), (0, "element", "F/b", "F/1"), (0, "handler", "E=only", "F/2"), (0, "handler", "OnOpen=H", "F"), (0, "handler", "X=M.F.do", "F/b"), (0, "handler", "Y=go", "F/b"),
]


def test_form(spark):
    assert found(spark, FORM) == WANT


def test_lists_written_in_other_ways(spark):
    other = json.loads(json.dumps(FORM))
    f = other["form"]
    f["events"] = json.dumps(f["events"])
    f["elements"][0]["elements"] = json.dumps([f["elements"][0]["elements"]])
    f["elements"][1]["events"] = [f["elements"][1]["events"]]
    assert found(spark, {"meta": {"export": other}}) == WANT
    assert found(spark, {"exporter": {"build": 1}, "forms": [other["form"]]}) == WANT
    assert found(spark, {"form": {"form_name": "F", "events": {"OnOpen": "H"}, "elements": None}}) == [(0, "handler", "OnOpen=H", "F")]


def test_sources_at_any_depth_once(spark):
    s = {"subscription": {"name": "n", "handler": {"module": "CommonModule.M", "method": "run"}, "sources": [{"group": {"group": [{"type": "A.B"}, "C.D"]}}, {"type_set": ["E.F", "A.B"]}, "A.B", {"group": []}, None]}}
    assert found(spark, s) == [(0, "source", k, "CommonModule.M.run") for k in ("A.B", "C.D", "E.F")]
    assert found(spark, {"subscription": {"handler": "X.Y.z", "sources": "A.B"}}) == [(0, "source", "A.B", "X.Y.z")]


def test_damaged_null_empty_and_repeated(spark):
    assert found(spark, None, "", '{"form": {"form_name"', "[]", "12", "null", json.dumps(FORM) + "x") == []
    df = spark.createDataFrame([(7, "form", json.dumps(FORM), "x")] * 3, SCHEMA)
    assert found_items(df).count() == len(WANT)
    assert found_items(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_and_huge_ids(spark):
    df = spark.createDataFrame([(i, "form", json.dumps(FORM), "x") for i in (None, (1 << 62) + 1)], SCHEMA)
    assert {r.record_id for r in found_items(df).collect()} == {None, (1 << 62) + 1}


def test_any_depth():
    deep = "".join('{"element_id":%d,"elements":[' % i for i in range(30_000))
    text = '{"form":{"form_name":"F","elements":[' + deep + "]}" * 30_000 + "]}}"
    rows = flat_items(1, text, texts=False)
    assert sum(r[3] == "element" for r in rows) == 30_000


def test_lone_halves_of_pairs(spark):
    df = spark.createDataFrame([(1, "form", '{"form":{"form_name":"F","elements":[{"element_id":"\\ud800x"}],"events":{"\\udc00":"h"}}}', "x"), (2, "form", json.dumps(FORM), "x")], SCHEMA)
    got = found_items(df).collect()
    assert {(r.item_key, r.parent_key) for r in got if r.record_id == 1} == {("F/\ufffdx", "F"), ("\ufffd=h", "F")} and len(got) == 2 + len(WANT)


def test_labels_truncate_to_parents(spark):
    tables = record_tables(spark.createDataFrame([(1, "form", json.dumps(FORM), "x")], SCHEMA))
    forms = {r.label for r in tables["forms"].collect()}
    elements = {r.label: r.parent_label for r in tables["elements"].collect()}
    assert all((up in forms or up in elements) and label.startswith(up + ".") for label, up in elements.items())
    assert {r.parent_label for r in tables["handlers"].collect()} <= forms | set(elements)


def test_random_records_match_recursion(spark):
    rnd = random.Random(3)
    want, payloads = [], []

    def element(i, parent, depth, out):
        e, key = {}, None
        if rnd.random() < 0.7:
            e["element_id"], key = i, str(i)
        e["element_name"] = f"n{i}"
        mine = f"F/{key or 'n%d' % i}"
        out.append(("element", mine, parent))
        if rnd.random() < 0.5:
            e["events"] = [{"event": "E", "handler": f"h{i}"}]
            out.append(("handler", f"E=h{i}", mine))
        kids = [element(i * 10 + k, mine, depth + 1, out) for k in range(rnd.randint(0, 3) if depth < 3 else 0)]
        if kids:
            e["elements"] = kids[0] if len(kids) == 1 else json.dumps(kids) if rnd.random() < 0.2 else kids
        return e

    for r in range(20):
        out: list = []
        payloads.append({"form": {"form_name": "F", "elements": [element(k, "F", 0, out) for k in range(1, 3)]}})
        want += [(r, *o) for o in out]
    assert found(spark, *payloads) == sorted(set(want))
