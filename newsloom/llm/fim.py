"""Fill-in-middle: texts cut at two unit borders, their parts put in the order a model is taught to fill the gap in.

A unit is a run of ASCII letters or any other code point. Matches are relational: texts are exploded into pieces of whole
units, window sums say how many units and code points each piece ends at, cut requests are joined by unit ordinal, and only
the pieces that hold a cut are exploded further into single units, whose running lengths give the offset; offsets are
aggregated per document, and substrings make the output. A row for each unit of all texts would be some twenty times as many.
The text is shuffled once: all steps follow the partitioning by document.

Defined results: a null text counts as empty; an empty text and one that holds a mark stay as they are (plain); a null id
is drawn for as an empty one; repeated rows are cut alike, each on its own; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import read

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Code points of a piece, which goes on to the end of its last run of letters. Short pieces make few units to explode
#: where a cut is, long ones few pieces.
PIECE = 64
PIECES = f"(?s).{{1,{PIECE}}}[A-Za-z]*+"

#: Percent of texts that stay plain, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def n_units(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def draw(key: Column, k: int, salt: str = "1") -> Column:
    """The k-th number, from 1, drawn for a key."""
    hexed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hexed, 8 * k - 7, 8), 16, 10).cast("long")


def form(key: Column, text: Column) -> Column:
    marked = reduce(Column.__or__, [text.contains(mark) for mark in MARKS])
    stays = (text == "") | (draw(key, 3) % 100 >= 100 - PLAIN) | marked
    return F.when(stays, "plain").when(draw(key, 4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def requests(texts: DataFrame) -> DataFrame:
    """texts(row, id, text) -> (row, n, cut, ordinal): the units that end before each of the two cuts of a text that is not plain."""
    n = n_units(F.col("text"))
    cuts = texts.select("row", F.when(form(F.col("id"), F.col("text")) != "plain", n).alias("n"), draw(F.col("id"), 1).alias("h1"), draw(F.col("id"), 2).alias("h2"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    return cuts.select("row", "n", F.posexplode(F.when(F.col("n").isNotNull(), F.array(F.least(a, b), F.greatest(a, b)))).alias("cut", "ordinal"))


def offsets(texts: DataFrame) -> DataFrame:
    """texts(row, id, text) -> (row, n, low, high): the code points before each of the two cuts."""
    so_far = Window.partitionBy("row").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # conditions stand within the generators, not in filters, and all columns are read: so all that reads texts shares one shuffle
    parts = F.when(form(F.col("id"), F.col("text")) != "plain", F.regexp_extract_all("text", F.lit(PIECES), 0))
    pieces = texts.select("row", F.posexplode(parts).alias("piece", "part"))
    pieces = pieces.select("*", n_units(F.col("part")).alias("units"), F.char_length("part").alias("chars"))
    pieces = pieces.select("row", "part", "units", "chars", F.sum("units").over(so_far).alias("units_to"), F.sum("chars").over(so_far).alias("chars_to"))
    # a cut behind unit 0 is at no unit's end: it is held by the first piece and finds no unit there, so its offset is 0
    at, first = F.col("ordinal"), F.col("units_to") - F.col("units")
    held = pieces.join(requests(texts), "row").where((at <= F.col("units_to")) & (at > first) | (at == 0) & (first == 0))
    held = held.select("row", "n", "cut", (at - first).alias("wanted"), (F.col("chars_to") - F.col("chars")).alias("before"), "part")
    run = Window.partitionBy("row", "cut").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = held.select("row", "n", "cut", "wanted", "before", F.posexplode(F.regexp_extract_all("part", F.lit(UNIT), 0)).alias("unit", "token"))
    units = units.select("row", "n", "cut", (F.col("unit") + 1 == F.col("wanted")).alias("last"), (F.col("before") + F.sum(F.char_length("token")).over(run)).alias("end"))
    end = lambda k: F.coalesce(F.max(F.when((F.col("cut") == k) & F.col("last"), F.col("end"))), F.lit(0)).cast("int")
    return units.groupBy("row").agg(F.max("n").alias("n"), end(0).alias("low"), end(1).alias("high"))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output) of every row; the parts are null where form is plain."""
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")).repartition("row")
    cuts = offsets(texts).hint("shuffle_hash")  # three numbers a document; the texts need no sorting
    out = texts.join(cuts, "row", "left")
    whole, low, high = F.col("text"), F.col("low"), F.col("high")
    out = out.select(
        "id", "text", F.coalesce("n", n_units(whole)).alias("n"), form(F.col("id"), whole).alias("form"),
        F.substring(whole, F.lit(1), low).alias("prefix"), F.substring(whole, low + 1, high - low).alias("middle"), F.substring(whole, high + 1, F.char_length(whole)).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return out.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(whole))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: no part holds a mark, so each mark stands once, before its part."""

    def after(mark: str, end: str | None = None) -> Column:
        rest = F.substring_index(output, mark, -1)
        return rest if end is None else F.substring_index(rest, end, 1)

    psm = F.concat(after(PREFIX, SUFFIX), after(MIDDLE), after(SUFFIX, MIDDLE))
    spm = F.concat(after(PREFIX, MIDDLE), after(MIDDLE), after(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"), "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM d),
p AS (SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
