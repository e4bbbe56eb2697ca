from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from metascope.llm.splitting import split_documents

SCHEMA = "id string, module_path string, method_name string, document string, piece string"


def split(spark, docs, limit=4000, overlap=200, **kw):
    df = spark.createDataFrame([(str(i), "m", "n", d, "clash") for i, d in enumerate(docs)], SCHEMA)
    out: dict[str, list] = {}
    for r in sorted(split_documents(df, limit, overlap, **kw).collect(), key=lambda r: (int(r.id), r.piece_no)):
        out.setdefault(r.id, []).append(r)
    return out


def check(doc, rows, limit, overlap):
    assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1)) and all(r.n_pieces == len(rows) for r in rows)
    assert all(len(r.piece) <= limit for r in rows)
    assert rows[0].piece + "".join(r.piece[overlap:] for r in rows[1:]) == doc
    for a, b in zip(rows, rows[1:]):
        assert a.piece[-overlap:] == b.piece[:overlap] and doc[b.start_char : b.start_char + len(b.piece)] == b.piece


def test_pieces_of_many_kinds(spark):
    line = "\tЕсли Не Отбор.Пустая() Тогда\r\n\t\tСообщить(\"x\");\r\n\r\n"
    docs = [line * 300, "слово " * 3000, "a" * 9001, "🙂é" * 4500, "x" * 4000, "x" * 4001, "", None, " " * 9000, ("д" * 3000 + ". ") * 4, "\r\n" * 5000, "e\u0301" * 5000, "a🙂" * 6000]
    out = split(spark, docs)
    assert set(out) == {str(i) for i, d in enumerate(docs) if d is not None and len(d) > 4000}
    for i, rows in out.items():
        check(docs[int(i)], rows, 4000, 200)
    assert all(r.piece.endswith("\r\n\r\n") for r in out["0"][:-1]), "cut after an empty line"
    assert all(r.piece.endswith(" ") for r in out["1"][:-1]) and all(r.piece.endswith(". ") for r in out["9"][:-1])
    assert not any(r.piece.endswith("\r") or r.piece[200:].startswith("\u0301") for r in out["10"] + out["11"])


def test_stronger_boundary_before_a_later_weaker_one(spark):
    doc = "w " * 1250 + "\n\n" + "w " * 2000
    assert split(spark, [doc])["0"][0].piece == "w " * 1250 + "\n\n"


def test_whole_items_repeats_and_empty(spark):
    out = split(spark, ["short", "", None], oversized_only=False)
    assert out["0"][0].piece == "short" and out["1"][0].piece == "" and "2" not in out
    df = spark.createDataFrame([("1", "m", "n", "a" * 5000, "x")] * 2, SCHEMA)
    assert split_documents(df).count() == 4 and split_documents(df).distinct().count() == 2
    assert split_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        split_documents(df, 100, 50)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aя .\n\r\t🙂\u0301;", min_size=61, max_size=400), min_size=1, max_size=6))
def test_any_text(spark, docs):
    for i, rows in split(spark, docs, 60, 12).items():
        check(docs[int(i)], rows, 60, 12)
