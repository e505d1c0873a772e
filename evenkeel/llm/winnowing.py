"""Winnowing fingerprints over whole texts, in DataFrame functions alone.

A text's words are read in grams of ``gram`` consecutive words, each hashed as it rolls along.
In every ``window`` of consecutive grams the smallest hash is chosen, the rightmost of equal
ones, and kept with its position. Two texts that share ``window + gram - 1`` words in a row
always share a fingerprint, and no passage of fewer than ``gram`` words is ever matched.

A choice is one number: 38 bits of the hash, then 25 bits that fall as the position grows, so
that the least number is the smallest hash at its rightmost place.

Cases: null and empty texts, and texts of white space, have no choices; two such texts are alike
(1.0), and one is unlike any other text (0.0). Texts of fewer words than a gram are one gram, and
texts of fewer grams than a window one window. Equal texts have equal fingerprints. Rows that
repeat a doc_id follow each other by text; null ids come after all others. An empty table gives
no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.shared import documents

GRAM, WINDOW = 5, 20
_PLACE = 25  # bits of a position
_MASK = (1 << _PLACE) - 1
#: Ranges of ids for each shuffle partition.
RANGES = 3
_LAST = -(1 << 63)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _grams(words: str, gram: int) -> Column:
    """Each gram's hash with its position behind it; the least is the rightmost of equal hashes."""
    def choice(i: Column) -> Column:
        high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(words, i, gram)), 26), _PLACE)
        return high.bitwiseOR(F.lit(_MASK) - (i - 1).bitwiseAND(F.lit(_MASK)).cast("long"))

    last = F.greatest(F.size(words) - gram + 1, F.lit(1))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), last), choice)).otherwise(F.array().cast("array<long>"))


def _chosen(grams: str, window: int) -> Column:
    last = F.greatest(F.size(grams) - window + 1, F.lit(1))
    least = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_min(F.slice(grams, i, window)))
    return F.when(F.size(grams) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<long>"))


def winnow(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``name``: the chosen grams of column ``text``, in the order of their positions."""
    words, grams = f"_{name}_words", f"_{name}_grams"
    df = df.withColumn(words, _words(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(grams, _grams(words, gram)).drop(words)
    return df.withColumn(name, _chosen(grams, window)).drop(grams)


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda c: F.shiftright(c, _PLACE)))


def positions(chosen: Column) -> Column:
    """The words at which the chosen grams begin, counted from 0."""
    return F.transform(chosen, lambda c: F.lit(_MASK) - c.bitwiseAND(F.lit(_MASK)))


def shown(chosen: Column) -> Column:
    """One string of hashes and positions."""
    return F.array_join(F.transform(chosen, lambda c: F.concat(
        F.lower(F.hex(F.shiftright(c, _PLACE))), F.lit("@"), (F.lit(_MASK) - c.bitwiseAND(F.lit(_MASK))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes out of all, 1.0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def _tree(key: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds below ``key``, by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(key <= F.lit(bounds[middle]), _tree(key, bounds[:middle], first)).otherwise(
        _tree(key, bounds[middle + 1:], first + middle + 1))


def _with_ranges(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows with a range of ids, so that the next document (by descending id) is in the same range.

    Ranges hold about equally many rows. Behind each range's lowest row stands a copy of the
    next range's highest one (``_copy``), and behind the lowest of all the highest of all. The
    driver sees one id for each range.
    """
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(_LAST)))
    quantiles = keyed.select("_key").approxQuantile("_key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(q) for q in quantiles})
    keyed = keyed.withColumn("_range", _tree(F.col("_key"), bounds))
    highest = sorted((r["_range"], r["high"]) for r in keyed.groupBy("_range").agg(F.max("_key").alias("high")).collect())
    behind = {high: highest[(i + 1) % len(highest)][0] for i, (_, high) in enumerate(highest)}
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy"))
    if behind:
        pairs = F.create_map(*[F.lit(x) for pair in behind.items() for x in pair])
        copy = F.struct(pairs[F.col("_key")].alias("range"), F.lit(True).alias("copy"))
        places = F.when(F.col("_key").isin(list(behind)), F.array(own, copy)).otherwise(F.array(own))
    else:
        places = F.array(own)
    keyed = keyed.withColumn("_place", F.explode(places))
    keyed = keyed.withColumn("_range", F.col("_place.range")).withColumn("_copy", F.col("_place.copy")).drop("_place")
    return keyed, Window.partitionBy("_range").orderBy("_copy", F.desc("_key"), F.desc_nulls_last("text"))


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next one are.

    Texts are shuffled once; both neighbour steps run in the ranges that this makes.
    """
    plain = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    keyed, order = _with_ranges(plain)
    rows = keyed.withColumn("_next", F.lead("text").over(order))
    rows = winnow(rows, "text", "chosen", gram, window)
    rows = rows.withColumn("_hashes", hashes(F.col("chosen")))
    rows = rows.withColumn("_next_hashes", F.lead("_hashes").over(order)).where(~F.col("_copy"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("_next", half)))
    rows = winnow(rows, "edited", "edited_chosen", gram, window)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "chosen", "edited_chosen",
        likeness(F.col("_hashes"), hashes(F.col("edited_chosen"))).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_next_hashes")).alias("near_next"))
