"""Dropping lines that many documents share.

Normalised lines are exploded and hashed; the distinct documents of each hash are counted, a document with a line first
making one row of it however often it repeats; a line's place is dropped where its hash is in enough documents and this one isn't the first of
them; the lines that stay are put together by place. Everything is DataFrame functions.

What goes through a shuffle is two hashes of a line (128 bits stand for its key), an id and a place; a text goes through one, to its dropped
places. Counts are combined before each shuffle; joins have a plain stored table on one side, so that adaptive execution
can split the lines of a hot key, and the rows of a hot document.

Defined results: a null or empty text is one empty line; lines of keys shorter than ``least`` code points stay; rows of the
same id are one document, so all of them keep a line of which it is the first; null is an id of its own, after all others; rows that are repeated
are all returned; an empty table gives an empty result; other columns of the input may have any names and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines(text: Column) -> Column:
    """The lines of a text, between line feeds; at least one."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normal(line: Column) -> Column:
    """The key of a line: white space at both ends goes and A-Z become lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def exploded(documents: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """(doc, mark, place, h1, h2) of each line with a key of at least ``least`` code points. mark: hash of the whole text, which with the id tells rows apart
    that are not alike."""
    own = documents.select(F.col(key).alias("doc"), mark(text), F.posexplode(lines(F.col(text))).alias("place", "line"))
    keyed = own.select("doc", "mark", "place", normal(F.col("line")).alias("line")).where(F.length("line") >= least)
    return keyed.select("doc", "mark", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark")


def frequent(found: DataFrame, documents: int) -> DataFrame:
    """(h1, h2, n_docs, first) of the hashes of at least so many distinct documents. first: the smallest id."""
    each = found.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    return each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first")).where(F.col("n_docs") >= documents)


def dedup(documents: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10, shared: int = 2, store=stored) -> DataFrame:
    """All rows and columns, with (kept_text, n_lines, n_dropped) in place of columns of these names: the text without lines whose key has at least ``least`` code points and is
    in at least ``shared`` documents, but for those of the document of the smallest id with it."""
    found = exploded(documents, text, key, least)
    many = store(frequent(found, shared).select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "first"), "frequent_lines")
    hits = found.join(many, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2"))).where(~F.col("doc").eqNullSafe(F.col("first")))
    # An id that is null is an entry of the key's two columns, so that the join below is of plain equality.
    name = lambda doc: (F.coalesce(doc.cast("string"), F.lit("")), doc.isNull())
    gone = hits.groupBy("doc", "mark").agg(F.collect_set("place").alias("gone"))
    doc, null = name(F.col("doc"))
    gone = store(gone.select(doc.alias("g_doc"), null.alias("g_null"), F.col("mark").alias("g_mark"), "gone"), "dropped_lines")
    doc, null = name(F.col(key))
    rows = documents.select(F.struct("*").alias("row"), doc.alias("doc"), null.alias("null"), mark(text))
    both = rows.join(gone, (F.col("doc") == F.col("g_doc")) & (F.col("null") == F.col("g_null")) & (F.col("mark") == F.col("g_mark")), "left")
    own = both.select("row", lines(F.col("row").getField(text)).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    kept = F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(kept)
    own = own.select("row", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))
    left = [F.col("row").getField(c).alias(c) for c in documents.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    return own.select(*left, "kept_text", "n_lines", "n_dropped")
