"""Lines that many documents share, kept in one document only.

Everything is DataFrame functions.  A line's key is the line without white space at
its ends, in lower case (ASCII).  Long keys become one row each, (document, place,
128-bit hash); keys are counted by hash with partial sums, so a line of very many
documents is one row a task when it is shuffled.  Rows of keys on enough lines are
few; on them alone documents are counted distinctly, and what goes is named by
place.  Documents are put together again from the places that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.storage import scratch, write

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _lowered(text):
    """A-Z as a-z: once for a whole text, as lines aren't changed by it."""
    return F.translate(text, _UPPER, _LOWER)


def _version(text):
    """Tells rows apart that share a document's id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 40, least_documents: int = 5) -> DataFrame:
    """(key, version, places): the places of the lines that a document loses, written."""
    with scratch():
        each = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), _version(F.col(text)).alias("version"), F.posexplode(_lines(_lowered(F.col(text)))).alias("place", "line"))
        # A key is no longer than its line: short lines go before anything is made of them.
        keyed = each.where(F.length("line") >= least_length).withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.length("line") >= least_length)
        lines = write(keyed.select("doc", "version", "place", F.unhex(F.md5("line")).alias("hash")), "lines").df
        # Lines are counted first: keys on fewer lines than documents asked for are most of all and go without a distinct count.
        often = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents).select("hash")
        # Written tables on both sides of a join: adaptive execution can then split the partition of a very frequent line.
        near = write(lines.hint("merge").join(write(often, "often").df, "hash"), "frequent-lines").df
        counts = near.groupBy("hash").agg(F.count_distinct("doc").alias("documents"), F.max("doc").alias("last")).where(F.col("documents") >= least_documents)
        lost = near.hint("merge").join(write(counts.select("hash", "last"), "shared").df, "hash").where(F.col("doc") < F.col("last"))
        return write(lost.groupBy("doc", "version").agg(F.collect_set("place").alias("places")), "lost-lines", keep=True).df


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 40, least_documents: int = 5) -> DataFrame:
    """All rows and columns of ``docs`` with the lines that stay as text, ``n_lines`` and ``n_dropped`` added.

    A key of at least ``least_length`` code points found in at least ``least_documents`` documents loses all its lines
    but those of the largest key holding it.  A null or empty text is one empty line.  Rows that share a
    document's id are one document: they count once and keep or lose a line together.  Rows without an id count for
    nothing and lose nothing.  A document may lose all its lines; its text is empty then.  Other columns stay as they are, but
    columns named ``n_lines`` or ``n_dropped`` are replaced.  An empty table gives no rows.
    """
    lost = shared_lines(docs, key, text, least_length, least_documents)
    # The row travels as one column, so no name of its own can clash with what is added on the way.
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("doc"), _version(F.col(text)).alias("version"), _lines(F.col(text)).alias("lines"))
    joined = own.hint("merge").join(lost, ["doc", "version"], "left")  # one way at every size; what is lost isn't bounded
    # Both lists are of distinct numbers, so a hash set finds what stays, in order and in time linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("places", F.array().cast("array<int>")))
    kept = joined.withColumn("stay", stay)
    whole = F.when(F.col("places").isNull(), F.col("row")[text]).otherwise(F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n"))
    new = {text: whole, "n_lines": F.size("lines").cast("long"), "n_dropped": (F.size("lines") - F.size("stay")).cast("long")}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns], *[v.alias(c) for c, v in new.items() if c not in docs.columns])


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of the output of ``drop_shared_lines``."""
    return docs.select(F.col(key).alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
