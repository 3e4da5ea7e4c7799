"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import written

#: Shorter lines have no edit variants: one changed word would be more than a fifth of them.
MIN_WORDS = 5
#: Size of the tables that spare most rows a shuffle: this many rows of 8 bytes at most.
_PRESENCE = 1 << 22


def _doc_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, doc_key (tells rows of equal ids apart) and text; null ids come last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("doc_key"),
        text.alias("text"))


def _lines(rows: DataFrame, short_lines: bool) -> DataFrame:
    """One row per line of MIN_WORDS or more, or per line that is not blank: place, normal form, its words and two
    hashes that name it."""
    parts = rows.select("doc", "doc_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    norm = parts.select("doc", "doc_key", "line_no", F.trim(F.lower("line")).alias("norm"))
    words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    compared = F.btrim("norm", F.lit(" \t\r\x0b\x0c")) != "" if short_lines else F.col("n") >= MIN_WORDS
    return norm.withColumn("n", words).filter(compared).withColumn("k1", F.xxhash64("norm")).withColumn(
        "k2", F.xxhash64(F.lit("line"), "norm"))


def _halves():
    """Hashes of the first and last k words, for k = (n - 1) / 2 and (n - 2) / 2 rounded down (the same for even n): two
    lines within one word of each other share one of them. Null for lines under MIN_WORDS."""
    def pair(k):
        return [F.expr(f"xxhash64('a', {k}, substring_index(norm, ' ', cast({k} AS int)))"),
                F.expr(f"xxhash64('z', {k}, substring_index(norm, ' ', cast(-({k}) AS int)))")]

    first, second = pair("(n - 1) div 2"), pair("(n - 2) div 2")
    return F.when(F.col("n") >= MIN_WORDS, F.when(F.col("n") % 2 == 1, F.array(*first, *second)).otherwise(F.array(*first)))


def _residue(column: str):
    return F.pmod(F.xxhash64(column), F.lit(_PRESENCE))


def _possible(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted``: the residues of the wanted values, at most
    _PRESENCE rows, are broadcast."""
    residues = F.broadcast(wanted.select(_residue(column).alias("_residue")).distinct())
    return rows.join(residues, _residue(column) == F.col("_residue"), "left_semi")


def _survivors(table: DataFrame) -> DataFrame:
    """Names of the lines that share a half with another line."""
    halves = table.select("k1", "k2", F.explode("halves").alias("half"))
    shared = written(halves.groupBy("half").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter(
        "low <> high").select("half"))
    return _possible(halves, "half", shared).join(shared, "half", "left_semi").select("k1", "k2").distinct()


def _near(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Names of those of the lines ``firsts`` (k1, k2, first, n) that have an earlier line within one word of them.

    Of each line all variants with one word deleted are emitted as hashed keys: exclusive-or of the hashes of (word,
    place), with the places after the deletion moved up. Equal variants of the same place are substitutions, a variant
    equal to a whole line is an insertion. Within a group of equal variants all lines are within one word of each
    other, so each is compared with the earliest only.
    """
    at = F.xxhash64("k1", "k2", "doc", "doc_key", "line_no")
    wanted = firsts.select(F.xxhash64("k1", "k2", "first.doc", "first.doc_key", "first.line_no").alias("at"))
    texts = _possible(lines.withColumn("at", at), "at", wanted).select(
        "k1", "k2", F.struct("doc", "doc_key", "line_no").alias("first"), "norm")
    full = written(texts.join(firsts, ["k1", "k2", "first"]).dropDuplicates(["k1", "k2"]))
    words = full.select("k1", "n", F.posexplode(F.split("norm", " ")).alias("pos", "word"))
    hashed = words.select("k1", "n", "pos", F.xxhash64("word", "pos").alias("here"),
                          F.xxhash64("word", F.col("pos") - 1).alias("moved"))
    line = Window.partitionBy("k1")
    past = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What follows a place is the whole line less what does not: exclusive-or takes it away again.
    follows = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(upto))
    variants = written(hashed.select("k1", "n", "pos", F.coalesce(F.bit_xor("here").over(past), F.lit(0).cast(
        "long")).bitwiseXOR(follows).alias("variant"), F.when(F.col("pos") == 0, F.bit_xor("here").over(line)).alias("whole")))
    name = full.select("k1", "k2", "first", "n")
    # Substitutions: the same variant of the same place.
    groups = variants.groupBy("variant", "pos", "n").agg(F.min("k1").alias("low"), F.max("k1").alias("high"))
    shared = written(groups.filter("low <> high").select("variant", "pos", "n"))
    members = _possible(variants, "variant", shared).join(shared, ["variant", "pos", "n"]).select(
        "k1", "variant", "pos", "n").join(name, ["k1", "n"])
    leaders = members.groupBy("variant", "pos", "n").agg(F.min("first").alias("lead"))
    substituted = members.join(leaders, ["variant", "pos", "n"]).filter("first <> lead").select("k1", "k2", "lead", "pos")
    # Insertions: a line that equals a variant of a line with one word more; the later of the two goes.
    shorter = variants.filter("pos = 0").select("k1", "n", F.col("whole").alias("variant"))
    longer = _possible(variants.select("k1", "n", "pos", "variant"), "variant", shorter).join(name, ["k1", "n"])
    other = shorter.join(name, ["k1", "n"]).select(
        F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("first").alias("short_first"), "variant",
        (F.col("n") + 1).alias("n"))
    later = F.col("short_first") < F.col("first")
    inserted = longer.join(other, ["variant", "n"]).select(
        F.when(later, F.col("k1")).otherwise(F.col("s1")).alias("k1"),
        F.when(later, F.col("k2")).otherwise(F.col("s2")).alias("k2"),
        F.least("first", "short_first").alias("lead"), "pos")
    pairs = substituted.unionByName(inserted).distinct()
    # Hashes only propose: what stands before and after the place must be equal word for word.
    mine = full.select("k1", "k2", F.col("norm").alias("x"), F.col("n").alias("nx"))
    leads = full.select(F.col("first").alias("lead"), F.col("norm").alias("y"), F.col("n").alias("ny"))
    both = pairs.join(mine, ["k1", "k2"]).join(leads, "lead")
    same = F.expr("substring_index(x, ' ', pos) = substring_index(y, ' ', pos)") & F.expr(
        "substring_index(x, ' ', cast(-(greatest(nx, ny) - 1 - pos) AS int)) = "
        "substring_index(y, ' ', cast(-(greatest(nx, ny) - 1 - pos) AS int))")
    return both.filter(same).select("k1", "k2").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  short_lines: bool = False) -> DataFrame:
    """(doc, doc_key, gone): the numbers of the lines that go, for each document that loses any."""
    lines = _lines(_doc_columns(docs, id_col, text_col), short_lines)
    place = F.struct("doc", "doc_key", "line_no")
    # Places and hashes of all lines, without their texts: read several times, made once.
    table = written(lines.select("doc", "doc_key", "line_no", "n", "k1", "k2", _halves().alias("halves")))
    survivors = _survivors(table).withColumn("survives", F.lit(True))
    uniq = table.groupBy("k1", "k2").agg(
        F.min(place).alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("c"))
    marked = written(uniq.join(survivors, ["k1", "k2"], "left").filter("survives OR c > 1"))
    near = _near(lines, marked.filter("survives").select("k1", "k2", "first", "n")).withColumn("near", F.lit(True))
    verdict = written(marked.select("k1", "k2", "first", "c").join(near, ["k1", "k2"], "left").filter("near OR c > 1"))
    gone = _possible(table.select("k1", "k2", "doc", "doc_key", "line_no"), "k1", verdict).join(verdict, ["k1", "k2"]).filter(
        F.coalesce("near", F.lit(False)) | (place != F.col("first")))
    return gone.groupBy("doc", "doc_key").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   short_lines: bool = False) -> DataFrame:
    """``docs`` with the repeated lines cut out of their texts, and two more columns: n_lines (before) and n_removed.

    Lines end at line feeds. Their normal form is lower case without spaces at the ends; words are what single
    spaces separate. A line of MIN_WORDS words or more goes if an earlier line, in the order of document id and line
    number, is equal to it or within one inserted, deleted or replaced word. Lines are judged on the input, not on
    what is left. With ``short_lines`` every other line that is not blank goes too if an earlier one is equal to it.
    All other lines and all documents stay, also those that lose every line.

    Null texts count as one empty line and become empty. Null ids come after all others; rows that repeat an id are
    told apart by a hash of their texts, and rows that repeat both count as one document. Other columns are left
    as they are, but for ones named n_lines or n_removed, which are replaced.
    """
    gone = written(removed_lines(docs, id_col, text_col, short_lines)).select(
        F.col("doc").alias("_doc"), F.col("doc_key").alias("_doc_key"), F.col("gone").alias("_gone"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.drop("n_lines", "n_removed").withColumn("_d", doc).withColumn("_k", F.xxhash64(text))
    # Texts that lose nothing are not shuffled: all but those that share a residue with a document that does.
    residues = F.broadcast(gone.select(_residue("_doc").alias("_residue")).distinct())
    told = rows.join(residues, _residue("_d") == F.col("_residue"), "left")
    met = told.filter("_residue IS NOT NULL").join(
        gone, (F.col("_d") == F.col("_doc")) & (F.col("_k") == F.col("_doc_key")), "left").drop("_doc", "_doc_key")
    every = met.unionByName(told.filter("_residue IS NULL").withColumn("_gone", F.lit(None).cast("array<int>")))
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return every.select(
        *[(F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else c)
          for c in others],
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
