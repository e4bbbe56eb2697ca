import random
from datetime import datetime, timedelta

from metascope.operators import skew
from metascope.operators.orphans import OWNERSHIP, gaps, orphan_edges, orphan_report

T0 = datetime(2025, 1, 1)
EDGES = "seq bigint, config_id string, from_id string, to_id string, edge_type string, observed_at timestamp_ntz, since string"
NODES = "config_id string, id string, is_stub boolean, recorded_at timestamp_ntz, deleted_at timestamp_ntz, key string"
CONFIGS = "config_id string, base_config_id string"


def tables(spark, edges, nodes, configs):
    return (
        spark.createDataFrame([(*e, "x") for e in edges], EDGES), spark.createDataFrame([(*n, "y") for n in nodes], NODES), spark.createDataFrame(configs, CONFIGS),
    )


def key(x):
    x = (x or "").strip().lower()
    return x or None


def brute(edges, nodes, configs):
    """Direct and inherited edges, from the statement: chains are walked from every missing owner."""
    base = dict(configs)
    sees = lambda scope: {scope, base.get(scope)} - {None}
    e = sorted(set(edges), key=str)

    def there(scope, k, t):
        return t is not None and any(n[0] in sees(scope) and key(n[1]) == k and n[2] is not True and n[3] is not None and n[3] <= t and (n[4] is None or t < n[4]) for n in nodes)

    def gap(scope, k, t):
        ends = [n for n in nodes if n[0] in sees(scope) and key(n[1]) == k and n[2] is not True and n[3] is not None and (n[4] is None or n[3] < n[4])]
        return max([n[4] for n in ends if n[4] and n[4] <= t], default=datetime.min), min([n[3] for n in ends if n[3] > t], default=datetime.max)

    direct = [x for x in e if key(x[3]) and not there(x[1], key(x[3]), x[5])]
    inherited = set()
    for scope in {x[1] for x in e} | set(base):
        owned = [x for x in e if x[1] is not None and x[1] in sees(scope) and x[4] in OWNERSHIP and key(x[2]) and key(x[3]) and x[5] is not None]
        for root in owned:
            if there(scope, key(root[2]), root[5]):
                continue
            a, b = gap(scope, key(root[2]), root[5])
            todo, done = [root], set()
            while todo:
                x = todo.pop()
                if x in done:
                    continue
                done.add(x)
                todo += [y for y in owned if key(y[2]) == key(x[3]) and a <= y[5] < b]
            inherited |= {x for x in done if x[1] == scope}
    return direct, [x for x in inherited if x not in direct]


def rows(df):
    return sorted((r.seq, r.orphan_kind) for r in df.collect())


def test_random_graphs_match_brute_force(spark):
    rnd = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    spell = lambda n: rnd.choice([n, n.upper(), f" {n}", f"{n} "])
    for _ in range(3):
        nodes = [(rnd.choice("ab"), spell(rnd.choice(names)), rnd.choice([True, False, None]), T0 + timedelta(days=rnd.randint(0, 9)), rnd.choice([None, T0 + timedelta(days=rnd.randint(3, 12))])) for _ in range(20)]
        edges = [(i, rnd.choice(["a", "b", None]), spell(rnd.choice(names)), rnd.choice([spell(rnd.choice(names)), None, "  ", ""]), rnd.choice([*OWNERSHIP[:2], "calls"]), rnd.choice([T0 + timedelta(days=rnd.randint(0, 14)), None])) for i in range(60)]
        edges += edges[:7]
        configs = [("a", None), ("b", "a")]
        direct, inherited = brute(edges, nodes, configs)
        out = orphan_edges(*tables(spark, edges, nodes, configs))
        assert rows(out) == sorted([(x[0], "direct") for x in direct] + [(x[0], "inherited") for x in inherited])


def test_hot_target_is_salted_and_complete(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    nodes = [("a", "hot", False, T0 + timedelta(days=5), None)]
    edges = [(i, "a", "x", "hot", "calls", T0 + timedelta(days=i % 10)) for i in range(200)]
    assert len(rows(orphan_edges(*tables(spark, edges, nodes, [("a", None)]), cascade=False))) == 100
    assert {(r.config_id, r.key) for r in skew.hot_keys(spark.createDataFrame([("a", "hot")] * 6 + [("a", "cold")] * 4, "config_id string, key string"), ["config_id", "key"]).collect()} == {("a", "hot")}


def test_ends_of_a_span_cycles_and_report(spark):
    nodes = [("a", "m", False, T0, T0 + timedelta(days=2))]
    edges = [
        (1, "a", "x", "m", "calls", T0), (2, "a", "x", "m", "calls", T0 + timedelta(days=2)), (3, "a", "m", "c", "contains_form", T0), (4, "a", "c", "d", "contains_module", T0), (5, "a", "d", "c", "contains_module", T0),
    ]
    out = orphan_edges(*tables(spark, edges, nodes, [("a", None)]))
    assert rows(out) == [(2, "direct"), (3, "direct"), (4, "direct"), (5, "direct")]
    report = {(r.edge_type, r.month): (r.direct, r.inherited) for r in orphan_report(out).collect()}
    assert report[("contains_module", "2025-01")] == (2, 0)


def test_handed_down(spark):
    nodes = [("a", n, False, T0, None) for n in ("c", "d", "e")]
    edges = [(1, "a", "x", "gone", "calls", T0), (2, "a", "gone", "c", "contains_form", T0), (3, "a", "c", "d", "contains_module", T0), (4, "a", "d", "e", "calls", T0)]
    out = orphan_edges(*tables(spark, edges, nodes, [("a", None)]))
    assert sorted((r.seq, r.orphan_kind, r.depth) for r in out.collect()) == [(1, "direct", 0), (2, "inherited", 1), (3, "inherited", 2)]


def test_owner_that_came_later_is_not_missing_later(spark):
    nodes = [("a", "late", False, T0 + timedelta(days=5), None), ("a", "c", False, T0, None), ("a", "d", False, T0, None)]
    edges = [(1, "a", "x", "late", "calls", T0), (2, "a", "late", "c", "contains_form", T0 + timedelta(days=6)), (3, "a", "late", "d", "contains_form", T0 + timedelta(days=1)), (4, "a", "d", "c", "contains_module", T0 + timedelta(days=7)), (5, "a", "d", "c", "contains_module", T0 + timedelta(days=2))]
    assert rows(orphan_edges(*tables(spark, edges, nodes, [("a", None)]))) == [(1, "direct"), (3, "inherited"), (5, "inherited")]


def test_heirs_inherit_from_their_base(spark):
    nodes = [("a", "c", False, T0, None), ("b", "d", False, T0, None), ("b", "mine", False, T0, None)]
    edges = [(1, "a", "gone", "c", "contains_form", T0), (2, "b", "c", "d", "contains_module", T0), (3, "a", "mine", "c", "contains_form", T0 + timedelta(days=1)), (4, "b", "gone", "zz", "contains_form", T0)]
    out = orphan_edges(*tables(spark, edges, nodes, [("a", None), ("b", "a")]))
    assert sorted((r.seq, r.orphan_kind, r.depth, r.owner_depth) for r in out.collect()) == [(1, "inherited", 1, 1), (2, "inherited", 2, 2), (3, "inherited", 1, 1), (4, "direct", 0, 1)]


def test_gaps_of_many_spans(spark):
    spans = [("a", "k", T0 + timedelta(days=x), T0 + timedelta(days=y)) for x, y in ((0, 9), (1, 2), (3, 12), (14, 15), (15, 16), (20, 30))]
    s = spark.createDataFrame(spans, "config_id string, key string, since timestamp_ntz, until timestamp_ntz")
    got = sorted((r.since, r.until) for r in gaps(s, spark.createDataFrame([("a", "k")], "config_id string, key string")).collect())
    days = [((a - T0).days, (b - T0).days) for a, b in got]
    assert days[1:-1] == [(12, 14), (16, 20)] and days[0][1] == 0 and days[-1][0] == 30 and len(days) == 4


def test_empty_tables(spark):
    assert rows(orphan_edges(*tables(spark, [], [], []))) == []
    assert rows(orphan_edges(*tables(spark, [(1, "a", None, "t", None, T0)], [], []))) == [(1, "direct")]
