"""Registered queries that build a spelling list from the words of the given texts, and look words up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.functions.sizes import scratch_path, staged
from wortlaut.operators import lookup, wordlist
from wortlaut.plans.common import Registry, spread, table
from wortlaut.sources import wordlists
from wortlaut.sources.results import write_results

registry = Registry()

# Words planted beside those of the texts, so that every rule has something to find.
_PLANTED = (
    "Fluß", "Fluss", "Maß", "Mass", "Straße", "Photographie", "Fotografie", "Phase", "Fase", "Physik", "pHWert",
    "Schifffahrt", "Schiffahrt", "Brennnessel", "Brennessel", "BALLLETT", "BALLETT", "Schritttempo", "Messe", "Nuß",
    "Nuss", "Telephon", "Telefon", "naß-kalt", "nass-kalt", "-los", "ab 1",
)
# A query that ends in a plain join of two uses of lem never ends in DuckDB once a LIMIT is put around it; sorted it does.
_WORDS_SQL = f"""WITH raw AS (
  SELECT unnest(string_split(regexp_replace(text, '[ \\n.,;:!?()"]', ' ', 'g'), ' ')) AS w FROM documents
  UNION ALL SELECT unnest([{", ".join(f"'{w}'" for w in _PLANTED)}])),
lem AS MATERIALIZED (SELECT DISTINCT w AS lemma FROM raw WHERE regexp_full_match(w, '[\\p{{L}}-]+') AND w[1] <> '-'),
ss AS (SELECT lemma AS alt, replace(lemma, 'ß', 'ss') AS neu FROM lem WHERE contains(lemma, 'ß')),
ss_pair AS (SELECT ss.* FROM ss JOIN lem ON neu = lemma WHERE alt <> 'Maß'),
ph AS (SELECT lemma AS alt, replace(replace(lemma, 'Ph', 'F'), 'ph', 'f') AS neu FROM lem
  WHERE contains(lower(lemma), 'ph') AND lemma NOT IN ('Phase', 'Phiale')),
ph_pair AS (SELECT ph.* FROM ph JOIN lem ON neu = lemma),
tri AS (SELECT lemma, regexp_extract(lemma, '(?i)({"|".join(c * 3 for c in wordlist.TRIPLE_CONSONANTS)})') AS m FROM lem),
tri_short AS (SELECT substr(lemma, 1, position(m IN lemma) - 1) || substr(lemma, position(m IN lemma) + 1) AS alt, lemma AS neu
  FROM tri WHERE m <> ''),
tri_pair AS (SELECT DISTINCT alt, neu FROM tri_short JOIN lem ON alt = lemma),
pairs AS (
  SELECT *, 0 AS source FROM ss_pair UNION ALL SELECT *, 1 FROM ph_pair UNION ALL SELECT *, 2 FROM tri_pair)"""

# A supplement from the texts as well: each word of nine letters gets a hyphenated form.
_SUPPLEMENT_SQL = """sup AS (
  SELECT lemma AS alt, lemma || '-neu' AS neu FROM lem WHERE len(lemma) = 9
  UNION ALL SELECT 'Fluß', 'Strom')"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array(*(F.lit(w) for w in _PLANTED)))
    return table(spark, sf_dir, "region").filter("r_regionkey = 0").select(words.alias("lemma"))


def _raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.regexp_replace("text", '[ \\n.,;:!?()"]', " "), " ")
    found = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.explode(words).alias("lemma"))
    return found.unionByName(_planted(spark, sf_dir))


def _lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlist.clean_lemmas(_raw_words(spark, sf_dir))


def _supplement(lemmas: DataFrame) -> DataFrame:
    own = F.struct(F.col("lemma").alias("alt"), F.concat("lemma", F.lit("-neu")).alias("neu"), F.lit(1).alias("ord"))
    river = F.struct(F.lit(" Fluß").alias("alt"), F.lit("Strom ").alias("neu"), F.lit(2).alias("ord"))
    both = F.array(F.when(F.length("lemma") == 9, own), F.when(F.col("lemma") == "Fluß", river))
    return lemmas.select(F.explode(F.array_compact(both)).alias("s")).select("s.*")


@registry.add("a12_lemmas", f"{_WORDS_SQL} SELECT lemma FROM lem")
def a12(spark, sf_dir):
    return _lemmas(spark, sf_dir)


@registry.add("g1_ss_pairs", f"{_WORDS_SQL} SELECT * FROM ss_pair ORDER BY ALL")
def g1(spark, sf_dir):
    return wordlist.ss_pairs(_lemmas(spark, sf_dir))


_WHITE_SQL = "SELECT alt AS wort FROM ss LEFT JOIN lem ON neu = lemma WHERE alt = 'Maß' OR lemma IS NULL"


@registry.add("g2_ss_whitelist", f"{_WORDS_SQL} {_WHITE_SQL} ORDER BY ALL")
def g2(spark, sf_dir):
    return wordlist.ss_whitelist(_lemmas(spark, sf_dir))


@registry.add("g3_ph_pairs", f"{_WORDS_SQL} SELECT * FROM ph_pair ORDER BY ALL")
def g3(spark, sf_dir):
    return wordlist.ph_pairs(_lemmas(spark, sf_dir))


@registry.add("g4_triple_pairs", f"{_WORDS_SQL} SELECT * FROM tri_pair")
def g4(spark, sf_dir):
    return wordlist.triple_pairs(_lemmas(spark, sf_dir))


@registry.add(
    "g5_with_supplement",
    f"{_WORDS_SQL}, {_SUPPLEMENT_SQL} SELECT alt, neu, CAST(source AS BIGINT) AS source FROM pairs UNION ALL SELECT alt, neu, 3 FROM sup",
)
def g5(spark, sf_dir):
    lemmas = _lemmas(spark, sf_dir)
    return wordlist.with_supplement(wordlist.rule_pairs(lemmas), _supplement(lemmas)).drop("ord")


def _built_sql(order: str) -> str:
    return f"""{_WORDS_SQL}, {_SUPPLEMENT_SQL}, every AS (SELECT * FROM pairs UNION ALL SELECT alt, neu, 3 FROM sup)
    SELECT alt, arg_min(neu, ({order}, neu)) AS neu FROM every GROUP BY alt"""


@registry.add("g6_build_spellings", _built_sql("source"))
def g6(spark, sf_dir):
    lemmas = _lemmas(spark, sf_dir)
    return wordlist.build_spellings(lemmas, _supplement(lemmas))


@registry.add("g6_supplement_first", _built_sql("CASE source WHEN 3 THEN -1 ELSE source END"))
def g6_supplement(spark, sf_dir):
    lemmas = _lemmas(spark, sf_dir)
    return wordlist.build_spellings(lemmas, _supplement(lemmas), prefer="supplement")


# Answers of the lexicon, made from the words: by length they fail, find nothing, confirm, correct, or list two entries.
_ANSWERS_SQL = f"""{_WORDS_SQL}, ans AS (
  SELECT lemma AS wort, CASE WHEN len(lemma) % 5 = 0 THEN NULL WHEN len(lemma) % 5 = 1 THEN 'NOT_FOUND'
      WHEN len(lemma) % 5 = 2 THEN lemma ELSE lemma || 'e' END AS canonical,
    CASE WHEN len(lemma) % 5 = 0 THEN 'HTTP 500' END AS error FROM lem)"""


def _responses(lemmas: DataFrame) -> DataFrame:
    kind, word = F.length("lemma") % 5, F.col("lemma")

    def entry(key, lemma):
        return F.struct(key.alias("input"), lemma.alias("lemma"))

    confirmed, corrected = entry(word, word), entry(word, F.concat(word, F.lit("e")))
    other = entry(F.concat(F.lit("x"), word), F.lit("falsch"))
    body = (
        F.when(kind == 1, "[]")
        .when(kind == 2, F.to_json(F.array(confirmed)))
        .when(kind == 3, F.to_json(F.array(corrected)))
        .when(kind == 4, F.to_json(F.array(other, corrected)))
    )
    return lemmas.select(
        word.alias("wort"), body.alias("body"), F.when(kind == 0, "HTTP 500").alias("error"), F.lit("2026-01-01T00:00:00").alias("timestamp")
    )


def _answers(lemmas: DataFrame) -> DataFrame:
    return lookup.parse_lookup(_responses(lemmas))


@registry.add(
    "i6_retry_rounds",
    f"""{_ANSWERS_SQL}, led AS (SELECT lemma AS wort, len(lemma) % 6 AS fehler_count, 'HTTP 429' AS letzter_fehler,
        '2025-12-31T00:00:00' AS timestamp FROM lem WHERE len(lemma) % 2 = 0 AND len(lemma) % 6 > 0)
    SELECT led.wort, CASE WHEN led.fehler_count < 3 AND ans.error IS NOT NULL THEN 3 ELSE CAST(led.fehler_count AS BIGINT) END AS fehler_count,
      CASE WHEN led.fehler_count < 3 THEN coalesce(ans.error, letzter_fehler) ELSE letzter_fehler END AS letzter_fehler
    FROM led JOIN ans ON led.wort = ans.wort WHERE led.fehler_count >= 3 OR ans.error IS NOT NULL ORDER BY ALL""",
)
def i6_rounds(spark, sf_dir):
    """Words whose length is a multiple of five fail in every round; the others have an answer in the first."""
    lemmas = _lemmas(spark, sf_dir)
    index = lemmas.select("lemma", F.lit(0).cast("long").alias("row_ord"))

    def ask(words):
        return lookup.parse_lookup(_responses(words.withColumnRenamed("wort", "lemma")))

    _, left = lookup.retry_rounds(_ledger(lemmas), index, ask)
    return left.select("wort", "fehler_count", "letzter_fehler")


@registry.add("i3_parse_lookup", f"{_ANSWERS_SQL} SELECT * FROM ans")
def i3(spark, sf_dir):
    return _answers(_lemmas(spark, sf_dir)).drop("timestamp")


_CANONICAL_SQL = f"""{_ANSWERS_SQL}, looked AS (
  SELECT p.*, CASE WHEN canonical = 'NOT_FOUND' THEN NULL ELSE canonical END AS canonical FROM pairs p JOIN ans ON wort = alt)"""


def _canonical(lemmas: DataFrame) -> DataFrame:
    return lookup.parse_lookup(_responses(lemmas), not_found=None).select("wort", "canonical")


@registry.add(
    "g7_apply_canonical",
    f"""{_CANONICAL_SQL} SELECT alt, coalesce(canonical, neu) AS neu, CAST(source AS BIGINT) AS source FROM looked
    WHERE canonical IS NULL OR canonical <> alt""",
)
def g7(spark, sf_dir):
    lemmas = _lemmas(spark, sf_dir)
    return wordlist.apply_canonical(wordlist.rule_pairs(lemmas), _canonical(lemmas))[0]


@registry.add(
    "g7_whitelist",
    f"{_CANONICAL_SQL} {_WHITE_SQL} UNION SELECT alt FROM looked WHERE canonical = alt",
)
def g7_whitelist(spark, sf_dir):
    lemmas = _lemmas(spark, sf_dir)
    return wordlist.build_whitelist(lemmas, _canonical(lemmas))


# Lookup runs over a table with one row per word occurrence.
_BASE_SQL = f"""{_ANSWERS_SQL}, occ AS (
  SELECT doc_id * 1000000 + i AS ord, w AS lemma, CASE WHEN len(w) % 7 = 3 THEN w || 'alt' ELSE '' END AS lemma_neu
  FROM (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (
    SELECT doc_id, string_split(regexp_replace(text, '[ \\n.,;:!?()"]', ' ', 'g'), ' ') AS ws FROM documents))),
idx AS (
  SELECT lemma, min(ord) AS first_ord, max(ord) AS row_ord, arg_max(lemma_neu, ord) AS lemma_neu FROM occ
  WHERE regexp_full_match(lemma, '[\\p{{L}}-]+') AND lemma[1] <> '-' GROUP BY lemma),
led AS (SELECT lemma AS wort, len(lemma) % 6 AS fehler_count, 'HTTP 429' AS letzter_fehler, '2025-12-31T00:00:00' AS timestamp
  FROM lem WHERE len(lemma) % 2 = 0 AND len(lemma) % 6 > 0)"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.regexp_replace("text", '[ \\n.,;:!?()"]', " "), " ")
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.posexplode(words).alias("i", "lemma"))
    source = rows.select(
        (F.col("doc_id") * 1000000 + F.col("i") + 1).alias("ord"), "lemma",
        F.when(F.length("lemma") % 7 == 3, F.concat("lemma", F.lit("alt"))).alias("lemma_neu"),
    )
    return lookup.lookup_base(source.drop("lemma_neu"), previous=source)


def _ledger(lemmas: DataFrame) -> DataFrame:
    failed = lemmas.filter((F.length("lemma") % 2 == 0) & (F.length("lemma") % 6 > 0))
    return failed.select(
        F.col("lemma").alias("wort"), (F.length("lemma") % 6).alias("fehler_count"),
        F.lit("HTTP 429").alias("letzter_fehler"), F.lit("2025-12-31T00:00:00").alias("timestamp"),
    )


@registry.add("i1_lookup_index", f"{_BASE_SQL} SELECT * FROM idx")
def i1(spark, sf_dir):
    return lookup.lookup_index(_base(spark, sf_dir))


_CANDIDATES_SQL = f"""{_BASE_SQL}, cand AS (
  SELECT idx.*, row_number() OVER (ORDER BY first_ord) - 1 AS place FROM idx LEFT JOIN led ON lemma = wort AND fehler_count >= 3
  WHERE lemma_neu = '' AND wort IS NULL)"""


@registry.add("i2_candidates", f"{_CANDIDATES_SQL} SELECT lemma, first_ord FROM cand WHERE place >= 10")
def i2(spark, sf_dir):
    index = lookup.lookup_index(_base(spark, sf_dir))
    return lookup.lookup_candidates(index, _ledger(_lemmas(spark, sf_dir)), start=10).select("lemma", "first_ord")


@registry.add(
    "i4_merge_lookups",
    f"""{_BASE_SQL} SELECT o.ord, o.lemma, CASE WHEN i.row_ord IS NOT NULL AND a.error IS NULL AND a.wort IS NOT NULL
      THEN a.canonical ELSE o.lemma_neu END AS lemma_neu
    FROM occ o LEFT JOIN idx i ON o.ord = i.row_ord LEFT JOIN ans a ON a.wort = i.lemma""",
)
def i4(spark, sf_dir):
    base = _base(spark, sf_dir)
    index = staged(lookup.lookup_index(base).select("lemma", "row_ord"))
    # The lemmas of the texts are those of the index, so the texts need not be read for them once more.
    lemmas = index.select("lemma").unionByName(wordlist.clean_lemmas(_planted(spark, sf_dir))).distinct()
    return lookup.merge_lookups(base, index, _answers(lemmas))


_LEDGER_SQL = f"""{_BASE_SQL}, asked AS (SELECT * FROM ans WHERE len(wort) % 3 < 2),
led2 AS (
  SELECT coalesce(l.wort, a.wort) AS wort, coalesce(fehler_count, 0) + (a.error IS NOT NULL)::INT AS fehler_count,
    coalesce(a.error, letzter_fehler) AS letzter_fehler,
    CASE WHEN a.error IS NOT NULL THEN '2026-01-01T00:00:00' ELSE timestamp END AS timestamp
  FROM led l FULL JOIN asked a ON l.wort = a.wort WHERE a.wort IS NULL OR a.error IS NOT NULL)"""


def _new_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemmas = _lemmas(spark, sf_dir)
    return lookup.update_ledger(_ledger(lemmas), _answers(lemmas).filter(F.length("wort") % 3 < 2))


@registry.add(
    "i5_update_ledger",
    f"{_LEDGER_SQL} SELECT wort, CAST(fehler_count AS BIGINT) AS fehler_count, letzter_fehler, timestamp FROM led2 ORDER BY ALL",
)
def i5(spark, sf_dir):
    return _new_ledger(spark, sf_dir)


@registry.add(
    "i6_retry_candidates",
    f"""{_LEDGER_SQL} SELECT lemma, CAST(fehler_count AS BIGINT) AS fehler_count, row_ord FROM led2
    JOIN idx ON lemma = wort WHERE fehler_count < 3""",
)
def i6(spark, sf_dir):
    index = lookup.lookup_index(_base(spark, sf_dir))
    return lookup.retry_candidates(_new_ledger(spark, sf_dir), index)


@registry.add(
    "i7_lookup_stats",
    f"""{_LEDGER_SQL} SELECT (SELECT count(*) FROM occ WHERE trim(lemma_neu) <> '') AS answered,
      (SELECT count(*) FROM occ WHERE lemma_neu NOT IN ('', 'NOT_FOUND') AND lemma_neu <> lemma) AS pairs,
      (SELECT count(*) FROM led2 WHERE fehler_count >= 3) AS given_up""",
)
def i7(spark, sf_dir):
    return lookup.lookup_stats(_base(spark, sf_dir), _new_ledger(spark, sf_dir))


@registry.add(
    "i8_lookup_pairs",
    f"{_BASE_SQL} SELECT lemma AS alt, lemma_neu AS neu FROM occ WHERE lemma_neu NOT IN ('', 'NOT_FOUND') AND lemma_neu <> lemma",
)
def i8(spark, sf_dir):
    return lookup.lookup_pairs(_base(spark, sf_dir))


# Lists as files: written from the words of the texts, read back with the list readers.
@registry.add(
    "a10_custom_list",
    f"{_WORDS_SQL} SELECT lemma AS alt, lemma || ', neu' AS neu FROM lem WHERE len(lemma) % 3 <> 0",
)
def a10(spark, sf_dir):
    rows = _lemmas(spark, sf_dir).select(
        F.concat("lemma", F.lit(" ")).alias("Alte Schreibung"),
        F.when(F.length("lemma") % 3 != 0, F.concat("lemma", F.lit(", neu"))).alias("NEU"), F.lit("x").alias("note"),
    )
    path = scratch_path(spark)
    rows.write.option("header", True).csv(path)
    return wordlists.read_wordlist(spark, path).drop("ord")


@registry.add("a11_spellings", _built_sql("source"))
def a11(spark, sf_dir):
    lemmas, path = _lemmas(spark, sf_dir), scratch_path(spark)
    wordlists.write_spellings(wordlist.build_spellings(lemmas, _supplement(lemmas)), path)
    return wordlists.read_spellings(spark, path).drop("ord")


@registry.add("a11_whitelist", f"{_WORDS_SQL} {_WHITE_SQL} ORDER BY ALL")
def a11_whitelist(spark, sf_dir):
    path = scratch_path(spark)
    wordlists.write_whitelist(wordlist.build_whitelist(_lemmas(spark, sf_dir)), path)
    return wordlists.read_whitelist(spark, path)


@registry.add(
    "a14_export",
    f"{_WORDS_SQL} SELECT lemma, len(lemma) || ';' || lemma AS details FROM lem",
)
def a14(spark, sf_dir):
    rows = _lemmas(spark, sf_dir).select("lemma", F.concat(F.length("lemma"), F.lit(";"), "lemma").alias("details"), F.lit(1).alias("node_id"))
    path = scratch_path(spark)
    write_results(rows, path)
    return spark.read.option("header", True).option("sep", ";").csv(path)


@registry.add(
    "a16_ledger",
    f"{_BASE_SQL} SELECT wort, CAST(fehler_count AS BIGINT) AS fehler_count, letzter_fehler, timestamp FROM led",
)
def a16(spark, sf_dir):
    path = scratch_path(spark)
    wordlists.write_ledger(_ledger(_lemmas(spark, sf_dir)), path)
    return wordlists.read_ledger(spark, path)


@registry.add("a12_read_lemmas", f"{_WORDS_SQL} SELECT lemma FROM lem")
def a12_read(spark, sf_dir):
    """Two lists in one directory, of which the newer is read."""
    folder, rows = scratch_path(spark), _raw_words(spark, sf_dir)
    rows.limit(0).write.option("header", True).csv(f"{folder}/lemmas-1.csv")
    padded = rows.select(F.concat(F.lit(" "), "lemma").alias("Lemma"), F.lit("x, y").alias("note"))
    padded.write.option("header", True).csv(f"{folder}/lemmas-2.csv")
    return wordlists.read_lemmas(spark, folder)


@registry.add(
    "a13_read_tag_selection",
    """SELECT DISTINCT source AS tag, NOT ends_with(source, '1') AS included FROM documents""",
)
def a13_read(spark, sf_dir):
    """Flags of half of the tags come from a file; a tag that the file does not name is included."""
    tags, path = table(spark, sf_dir, "documents").select(F.col("source").alias("tag")).distinct(), scratch_path(spark)
    flags = F.when(F.endswith("tag", F.lit("1")), " Nein").otherwise("JA")
    named = tags.filter(~F.endswith("tag", F.lit("2"))).select(F.upper("tag").alias(" Tag"), flags.alias("Inkludiert"))
    named.write.option("header", True).csv(path)
    return wordlists.apply_tag_selection(tags, wordlists.read_tag_selection(spark, path))
