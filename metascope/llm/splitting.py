"""Splitting oversized items at natural boundaries: one bounded-quantifier pattern, run by the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: A cut is allowed where one of these looks hold, from the strongest to the weakest.
BOUNDARIES = (
    r"(?<=\n)(?:(?<=\n\n)|(?<=\n\r\n)|(?<=\n[ \t]{1,8}\r?\n))",  # after an empty line
    r"(?:(?<=\n)|(?<=[\r\x{85}\x{2028}\x{2029}])(?!\n))",  # after a line
    r"(?<=[\s\x{A0}])(?<=[.!?\x{2026}].)(?![\s\x{A0}])",  # after a sentence
    r"(?<=[\s\x{A0}])(?<=[;,:)].)(?![\s\x{A0}])",  # after a part of a sentence or a statement
    r"(?<=[\s\x{A0}\x{3000}])(?![\s\x{A0}\x{3000}])",  # before a word
)


def cut_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """Alternatives that each take up to limit - overlap characters: the whole rest, else the longest stretch of at
    least half of that before the strongest boundary, else a shorter one before any boundary, else characters, if
    possible not between a letter and its mark or within a line end."""
    most, least = limit - overlap, max(overlap, 1)
    if not 0 <= overlap <= limit // 3:
        raise ValueError("the overlap must be at most a third of the limit")
    half = max(least, most // 2)
    any_ = "(?:" + "|".join(BOUNDARIES[:2] + BOUNDARIES[4:]) + ")"
    far = "|".join(f".{{{half},{most}}}{b}" for b in BOUNDARIES)
    return rf"(?s).{{1,{most}}}+\z|{far}|.{{{least},{half}}}{any_}|.{{{least},{most}}}(?!\p{{M}}|(?<=\r)\n)|.{{1,{most}}}"


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(document: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of the pieces of a text as structs n_pieces, piece_no (from 1), start_char (from 0), piece: the matches of
    cut_pattern, each with the last `overlap` characters of the one before. A text within the limit is one piece; null
    gives null."""
    parts = F.when(F.char_length(document) > limit, F.regexp_extract_all(document, F.lit(cut_pattern(limit, overlap)), F.lit(0))).when(document.isNotNull(), F.array(document))
    start = lambda p: F.aggregate(p, F.expr("cast(array(0) as array<bigint>)"), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.char_length(x)))

    def joined(p: Column) -> Column:
        back = lambda i: F.right(F.element_at(p, F.greatest(i, F.lit(1)).cast("int")), F.lit(overlap))
        return _bind(start(p), lambda at: F.transform(p, lambda x, i: F.struct(
            F.size(p).alias("n_pieces"), (i + 1).alias("piece_no"), (F.get(at, i) - F.when(i == 0, 0).otherwise(overlap)).alias("start_char"), F.when(i == 0, x).otherwise(F.concat(back(i), x)).alias("piece"),
        )))

    return _bind(parts, joined)


def split_documents(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = True) -> DataFrame:
    """id, module_path, method_name, n_pieces, piece_no (from 1), start_char (from 0), piece of each item over the limit
    (with oversized_only=False of every item that isn't null).

    Every piece has at most `limit` characters (Unicode code points), begins with the last `overlap` characters of the
    piece before and ends at the strongest boundary there is; the pieces without their overlaps make up the document
    again. Null documents give no pieces; repeated rows give theirs again, so that no shuffle of texts is needed:
    distinct() on the result removes them. Each text is cut where it lies.
    """
    doc = F.col("document")
    rows = chunks.select("id", "module_path", "method_name", "document").filter(F.char_length(doc) > limit if oversized_only else doc.isNotNull())
    return rows.select("id", "module_path", "method_name", F.inline(pieces(doc, limit, overlap)))
