"""Line dedup over content-defined chunks of lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, private, settled

#: Base and modulus of the rolling hash over two lines.
BASE, MODULUS = 1_000_003, 2_147_483_647
#: Keys of repeated chunks are broadcast up to this many (16 bytes each), beyond it the chunks are shuffled.
BROADCAST_KEYS = 500_000
_ROW = ("nul", "d", "tk")


def chunks(docs: DataFrame) -> DataFrame:
    """(nul, d, tk, chunks) from (nul, d, tk, text): a chunk is the two lines at a boundary, struct(i, body, before, after).

    A line's hash is the first 32 bits of its MD5, and a rolling hash goes over
    each two lines in a row. A boundary lies where that hash is not greater than
    both its neighbours', so what stands elsewhere in the document doesn't move
    it, and of any three lines in a row two are a chunk. before and after are
    the MD5s of the lines around a chunk (null at the ends of the text). Two
    empty lines make no chunk.
    """
    lines = docs.select(*_ROW, F.split("text", "\n", -1).alias("lines"))
    hashed = lines.select(*_ROW, "lines", F.expr("transform(lines, x -> md5(x))").alias("m"))
    rolled = hashed.select(*_ROW, "lines", "m", F.expr("transform(m, x -> cast(conv(substring(x, 1, 8), 16, 10) as bigint))").alias("h"))
    rolled = rolled.select(*_ROW, "lines", "m", F.expr(f"if(size(h) > 1, transform(sequence(0, size(h) - 2), i -> (h[i] % {MODULUS}L * {BASE}L + h[i + 1]) % {MODULUS}L), cast(array() as array<bigint>))").alias("r"))
    made = """
        transform(filter(transform(r, (x, i) -> i), i -> (lines[i] <> '' or lines[i + 1] <> '') and
                (i = 0 or i = size(r) - 1 or r[i] <= r[greatest(i - 1, 0)] or r[i] <= r[least(i + 1, size(r) - 1)])),
            i -> named_struct('i', i, 'body', concat(lines[i], '\\n', lines[i + 1]), 'before', if(i > 0, m[greatest(i - 1, 0)], null), 'after', if(i + 2 < size(m), m[least(i + 2, size(m) - 1)], null)))"""
    return rolled.select(*_ROW, settled(F.expr(made)).alias("chunks"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_repeated_chunks, n_removed_lines, kept) for every document.

    A chunk that occurs again, byte for byte, anywhere in the table is kept
    once: in the document with the smallest id (null ids last), there at its
    first place. Elsewhere its lines go, and the line before and after it too
    where they equal those around the first place, so that a run of three lines
    or more that two documents share goes as a whole; of runs of two lines,
    those that are a chunk in both. A removed line always has an equal one at
    an earlier place, so some copy of every line stays. kept is the remaining
    lines joined by newlines. Documents that share an id are told apart by
    their text; equal rows (same id and text) are one occurrence and keep
    alike. Null texts count as empty, which is one empty line; texts of any
    length take time linear in it; other columns can't clash; an empty table
    gives no rows.
    """
    got = private(docs, d=doc_id, text=text).select(F.col("d").isNull().alias("nul"), F.col("d").cast("long").alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = got.select("nul", "d", F.unhex(F.md5("text")).alias("tk"), "text")
    cut = chunks(rows)
    each = cut.select(*_ROW, F.explode("chunks").alias("c")).select(*_ROW, "c.*", F.unhex(F.md5("c.body")).alias("k"))
    # equal rows are one occurrence: least and greatest place differ where there are two
    place = F.struct(*_ROW, "i")
    often = materialize(each.groupBy("k").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("k", "a"), "line-often")
    keys = often.select("k")
    again = materialize(each.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "k", "left_semi"), "line-chunks")
    first = materialize(again.withColumn("a", place).join(often, ["k", "a"]).groupBy("k", "a").agg(F.first(F.struct("body", "before", "after")).alias("f")), "line-first")
    # the comparison of the bodies is the comparison of bytes
    later = again.join(first, "k").where((place != F.col("a")) & (F.col("body") == F.col("f.body")))
    gone = F.array_compact(F.array("i", F.col("i") + 1, F.when(F.col("before") == F.col("f.before"), F.col("i") - 1), F.when(F.col("after") == F.col("f.after"), F.col("i") + 2)))
    removed = later.select(*_ROW, "i", F.explode(gone).alias("line")).groupBy(*_ROW).agg(F.count_distinct("i").alias("n_repeated"), F.collect_set("line").alias("gone"))
    joined = rows.join(removed.withColumnRenamed("d", "__d"), (rows.nul == removed.nul) & rows.d.eqNullSafe(F.col("__d")) & (rows.tk == removed.tk), "left").select(rows.nul, rows.d, rows.tk, "text", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    lines = joined.select("d", F.split("text", "\n", -1).alias("lines"), "n_repeated", "gone")
    stay = lines.select("d", "lines", "n_repeated", F.size("gone").alias("n_gone"), settled(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))).alias("stay"))
    return stay.select(
        F.col("d").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.col("n_repeated").cast("long").alias("n_repeated_chunks"), F.col("n_gone").cast("long").alias("n_removed_lines"),
        F.expr(r"array_join(transform(stay, i -> lines[i]), '\n')").alias("kept"),
    )
