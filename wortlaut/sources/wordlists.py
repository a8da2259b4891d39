"""Word lists, white lists, lemma lists, tag tables and the lookup ledger as CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.functions.text import strip
from wortlaut.operators.wordlist import clean_lemmas

# Accepted headings of a custom list, and what counts as yes in a tag table.
OLD_HEADINGS = ("alt", "old", "alte schreibung")
NEW_HEADINGS = ("neu", "new", "neue schreibung")
YES = ("ja", "yes", "true", "1")


_ORD = "struct<file: string, block: bigint, row: bigint>"


def _read_csv(spark: SparkSession, path: str, sep: str, multi_line: bool = False) -> DataFrame:
    """All columns as strings, and ``ord``, which grows from file to file (by name) and along each file.

    ``multi_line`` is for files with line ends inside quoted fields, which then are read in one piece each.
    """
    table = (
        spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).csv(path)
    )
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return table.select("*", place.alias("ord"))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _column(table: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns with these headings, in any case and with blanks around."""
    by_name = {c.strip().lstrip("\ufeff").lower(): c for c in table.columns}
    found = [F.nullif(strip(F.col(f"`{by_name[n]}`")), F.lit("")) for n in names if n in by_name]
    return F.coalesce(*found, F.lit(""))


def read_wordlist(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """A custom list (alt, neu, ord); headings in any case, German or English; both sides needed."""
    table = _read_csv(spark, path, sep, multi_line)
    pairs = table.select(
        _column(table, *OLD_HEADINGS).alias("alt"), _column(table, *NEW_HEADINGS).alias("neu"), "ord"
    )
    return pairs.filter((F.col("alt") != "") & (F.col("neu") != ""))


def read_spellings(spark: SparkSession, path: str) -> DataFrame:
    """The built-in list or the supplement: ``alt;neu``.  A missing file is an empty list."""
    if not _exists(spark, path):
        return _empty(spark, f"alt string, neu string, ord {_ORD}")
    table = _read_csv(spark, path, ";")
    pairs = table.select(_column(table, "alt").alias("alt"), _column(table, "neu").alias("neu"), "ord")
    return pairs.filter((F.col("alt") != "") & (F.col("neu") != ""))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return _empty(spark, "wort string")
    table = _read_csv(spark, path, ";")
    return table.select(_column(table, "wort").alias("wort")).filter(F.col("wort") != "").distinct()


def newest(spark: SparkSession, directory: str) -> str:
    """The alphabetically last CSV file of a directory."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(s.getPath().getName() for s in found if s.getPath().getName().endswith(".csv"))
    if not names:
        raise FileNotFoundError(f"no CSV file in {directory}")
    return f"{directory.rstrip('/')}/{names[-1]}"


def read_lemmas(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct usable lemmas of the newest list in a directory."""
    table = _read_csv(spark, newest(spark, directory), ",")
    return clean_lemmas(table.select(_column(table, "lemma").alias("lemma")))


def read_tag_selection(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(tag, inkludiert) as the tag table import reads it: both columns lower-cased."""
    table = _read_csv(spark, path, sep)
    flag = F.lower(_column(table, "inkludiert")) if any(c.strip().lower() == "inkludiert" for c in table.columns) else F.lit("ja")
    return table.select(F.lower(_column(table, "tag")).alias("tag"), flag.alias("inkludiert"))


def apply_tag_selection(tags: DataFrame, selection: DataFrame) -> DataFrame:
    """(tag, included): flags from a selection table; tags it does not name stay included, unknown ones are ignored.

    Names in the selection are lower-case, so a tag with capitals is never named.
    """
    chosen = selection.groupBy(F.lower("tag").alias("tag")).agg(
        F.max(F.lower("inkludiert").isin(*YES)).alias("_yes"), F.max(~F.lower("inkludiert").isin(*YES)).alias("_no")
    )
    # A tag named twice with both values ends up on both sides, as in the import; included wins here.
    joined = tags.select("tag").join(chosen, "tag", "left")
    return joined.select("tag", F.coalesce("_yes", F.lit(True)).alias("included"))


def tag_selection(tags: DataFrame) -> DataFrame:
    """The export side: (tag, inkludiert)."""
    return tags.select("tag", F.when(F.col("included"), "ja").otherwise("nein").alias("inkludiert"))


def _write(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def sorted_spellings(pairs: DataFrame) -> DataFrame:
    return pairs.select("alt", "neu").orderBy(F.lower("alt"), "alt")


def write_spellings(pairs: DataFrame, path: str) -> None:
    _write(sorted_spellings(pairs), path)


def write_whitelist(words: DataFrame, path: str) -> None:
    _write(words.select("wort").distinct().orderBy(F.lower("wort"), "wort"), path)


LEDGER = "wort string, fehler_count int, letzter_fehler string, timestamp string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of failed lookups; a word listed twice keeps its last row."""
    if not _exists(spark, path):
        return _empty(spark, LEDGER)
    table = _read_csv(spark, path, ";")
    rows = table.select(
        _column(table, "wort").alias("wort"),
        F.coalesce(_column(table, "fehler_count").try_cast("int"), F.lit(0)).alias("fehler_count"),
        _column(table, "letzter_fehler").alias("letzter_fehler"),
        _column(table, "timestamp").alias("timestamp"),
        "ord",
    ).filter(F.col("wort") != "")
    last = F.max_by(F.struct("fehler_count", "letzter_fehler", "timestamp"), "ord")
    return rows.groupBy("wort").agg(last.alias("r")).select("wort", "r.*")


def write_ledger(ledger: DataFrame, path: str) -> None:
    _write(ledger.select("wort", "fehler_count", "letzter_fehler", "timestamp").orderBy("wort"), path)
