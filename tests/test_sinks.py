import json
import os

import pytest

from metascope.operators.impact import post_change_status
from metascope.sources.sinks import retried, write_graph_database, write_json_graph


def file_database(folder):
    """Made within a function, so that it goes to the workers by value."""
    import json
    import os

    class FileDatabase:
        """A stand-in for a graph database: each statement is a line of a file; a failure is made once for each label."""

        def __init__(self, folder):
            self.folder = folder

        def run(self, statement, parameters):
            mark = os.path.join(self.folder, "failed-" + str(abs(hash(statement)) % 10**8))
            if "UNWIND" in statement and not os.path.exists(mark):
                open(mark, "w").close()
                raise ConnectionError("busy")
            with open(os.path.join(self.folder, f"out-{os.getpid()}-{id(self)}"), "a", encoding="utf-8") as f:
                f.write(json.dumps([statement, parameters]) + "\n")

        def close(self):
            pass

    return FileDatabase(folder)


def graph(spark):
    n = spark.createDataFrame([("a", f"n{i}", "method" if i % 2 else "form", None if i else "doc") for i in range(7)], "config_id string, id string, kind string, document string")
    return n, spark.createDataFrame([("a", "n1", "n2", "calls"), ("a", "n2", "n3", "x-y")], "config_id string, from_id string, to_id string, edge_type string")


def test_graph_database_in_batches_with_retries(spark, tmp_path):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__(__name__))
    folder, made = str(tmp_path), file_database
    write_graph_database(*graph(spark), "a", lambda: made(folder), batch=2)
    lines = [json.loads(x) for f in os.listdir(folder) if f.startswith("out-") for x in open(os.path.join(folder, f), encoding="utf-8")]
    rows = [(s, r) for s, p in lines for r in p.get("rows", [])]
    assert {r["id"] for s, r in rows if "MERGE (n:Node" in s} == {f"n{i}" for i in range(7)}
    assert {s.split("[r:")[1].split("]")[0] for s, r in rows if "[r:" in s} == {"CALLS", "XY"}
    assert sum("DETACH DELETE" in s for s, _ in lines) == 1 and all(len(p.get("rows", [])) <= 2 for _, p in lines)


def test_json_graph_is_replaced_as_a_whole(spark, tmp_path):
    n, e = graph(spark)
    at = str(tmp_path / "g")
    write_json_graph(n, e, at)
    write_json_graph(n.limit(2), e, at)
    assert spark.read.json(f"{at}/nodes").count() == 2
    broken = n.selectExpr("raise_error('no') as id")
    with pytest.raises(Exception):  # noqa: B017
        write_json_graph(broken, e, at)
    assert spark.read.json(f"{at}/nodes").count() == 2 and os.listdir(tmp_path) == ["g"]


def test_retried():
    seen = []

    def step():
        seen.append(1)
        if len(seen) < 3:
            raise OSError

    retried(step, 3, 0.0)
    with pytest.raises(OSError):
        seen.clear()
        retried(step, 2, 0.0)


@pytest.mark.parametrize(
    ("files", "errors", "warnings", "stale", "nodes", "server", "status"),
    [
        (0, 1, 1, True, 1, None, "no_files"), (1, 1, 1, True, 0, False, "failed_validation"), (1, 0, 1, True, 0, False, "incomplete_bsl_ls_validation"), (1, 0, 1, True, 0, None, "incomplete_graph"),
        (1, 0, 1, True, 1, True, "needs_reindex"), (1, 0, 1, False, 1, None, "passed_with_warnings"), (1, 0, 0, False, 1, None, "ready_for_review"),
    ],
)
def test_status_by_precedence(spark, files, errors, warnings, stale, nodes, server, status):
    v = spark.createDataFrame([(errors, warnings)], "errors int, warnings int")
    fresh = spark.createDataFrame([(stale, False)], "stale boolean, newer_than_graph boolean")
    impact = spark.createDataFrame([(0,)], "callers int")
    f, g = (spark.createDataFrame([("x",)] * n, "id string") for n in (files, nodes))
    assert post_change_status(v, impact, fresh, f, g, server).first().status == status
