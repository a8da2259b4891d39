"""Word list rules and lookups."""

from pyspark.sql import functions as F

from wortlaut.operators import lookup, wordlist

WORDS = ["Fluß", "Fluss", "Maß", "Mass", "Straße", "Photographie", "Fotografie", "Phase", "Fase", "pHWert", "Schifffahrt",
         "Schiffahrt", "Brennnessel", "Brennessel", "Stemmmeißel", "-los", "+x", "zwei Wörter", "a1", "", "Fluß",
         "naß-kalt", "nass-kalt", "Massstab", "PPPx", "PPx", "Mußß", "Mussss"]


def lemmas(spark):
    return wordlist.clean_lemmas(spark.createDataFrame([(w,) for w in WORDS], "lemma string"))


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_clean_lemmas(spark):
    kept = {r["lemma"] for r in lemmas(spark).collect()}
    assert kept == set(WORDS) - {"-los", "+x", "zwei Wörter", "a1", ""}
    padded = spark.createDataFrame([(" Haus ",), (None,)], "lemma string")
    assert pairs(wordlist.clean_lemmas(padded)) == [("Haus",)]


def test_rules(spark):
    words = lemmas(spark)
    assert pairs(wordlist.ss_pairs(words)) == [("Fluß", "Fluss"), ("Mußß", "Mussss"), ("naß-kalt", "nass-kalt")]
    assert pairs(wordlist.ss_whitelist(words)) == [("Maß",), ("Stemmmeißel",), ("Straße",)]
    assert pairs(wordlist.ph_pairs(words)) == [("Photographie", "Fotografie"), ("pHWert", "pHWert")]
    assert pairs(wordlist.ph_pairs(words, keep_identity=False)) == [("Photographie", "Fotografie")]
    assert pairs(wordlist.triple_pairs(words)) == [("Brennessel", "Brennnessel"), ("PPx", "PPPx"), ("Schiffahrt", "Schifffahrt")]


def supplement(spark):
    rows = [(" daß ", "dass", 1), ("Fluß", "Strom", 2), ("daß", "DASS", 3), ("leer", " ", 4)]
    return spark.createDataFrame(rows, "alt string, neu string, ord long")


def test_first_source_wins(spark):
    built = dict(pairs(wordlist.build_spellings(lemmas(spark), supplement(spark))))
    assert built["Fluß"] == "Fluss" and built["daß"] == "dass" and "leer" not in built
    manual = dict(pairs(wordlist.build_spellings(lemmas(spark), supplement(spark), prefer="supplement")))
    assert manual["Fluß"] == "Strom" and manual["Schiffahrt"] == "Schifffahrt"


def test_canonical_lookups(spark):
    answers = [("Fluß", "Fluß"), ("Photographie", "Photografie"), ("naß-kalt", None)]
    looked = spark.createDataFrame(answers, "wort string, canonical string")
    built = dict(pairs(wordlist.build_spellings(lemmas(spark), supplement(spark), looked)))
    assert built["Fluß"] == "Strom"  # the rule pair is gone, the supplement's is not
    assert built["Photographie"] == "Photografie" and built["naß-kalt"] == "nass-kalt"
    white = {r["wort"] for r in wordlist.build_whitelist(lemmas(spark), looked).collect()}
    assert white == {"Maß", "Stemmmeißel", "Straße", "Fluß"}


def base(spark):
    rows = [(0, "b", ""), (1, "a", "A"), (2, "b", "x"), (3, "c", ""), (4, "-d", ""), (5, "e", None), (6, "a", "")]
    return lookup.lookup_base(spark.createDataFrame(rows, "ord long, lemma string, lemma_neu string"))


LEDGER = "wort string, fehler_count int, letzter_fehler string, timestamp string"


def test_index_and_candidates(spark):
    index = lookup.lookup_index(base(spark)).cache()
    got = pairs(index, "lemma", "first_ord", "row_ord", "lemma_neu")
    assert got == [("a", 1, 6, ""), ("b", 0, 2, "x"), ("c", 3, 3, ""), ("e", 5, 5, "")]
    ledger = spark.createDataFrame([("c", 3, "HTTP 500", "t"), ("e", 2, "HTTP 500", "t")], LEDGER)
    assert pairs(lookup.lookup_candidates(index, ledger), "lemma") == [("a",), ("e",)]
    assert pairs(lookup.lookup_candidates(index, ledger, max_failures=2), "lemma") == [("a",)]
    every = lookup.lookup_candidates(index, ledger, requery=True)
    assert pairs(every, "lemma") == [("a",), ("b",), ("e",)]
    part = lookup.lookup_candidates(index, ledger, requery=True, start=1, end=2)
    assert pairs(part, "lemma") == [("a",)]  # order of first occurrence: b, a, e
    assert pairs(lookup.retry_candidates(ledger, index), "lemma", "row_ord") == [("e", 5)]


def test_responses(spark):
    rows = [
        ("a", '[{"input":"x","lemma":"X"},{"input":"a","lemma":"A"}]', None),
        ("b", '[{"input":"x","lemma":"X"}]', None),
        ("c", "[]", None),
        ("d", '{"input":"d"}', None),
        ("e", '[{"input":"e","lemma":""}]', None),
        ("f", "not json", None),
        ("g", None, "HTTP 429"),
    ]
    parsed = lookup.parse_lookup(spark.createDataFrame(rows, "wort string, body string, error string"))
    assert pairs(parsed) == [
        ("a", "A", None), ("b", "X", None), ("c", "NOT_FOUND", None), ("d", "NOT_FOUND", None), ("e", "NOT_FOUND", None),
        ("f", None, "JSONDecodeError"), ("g", None, "HTTP 429")]


def test_a_response_is_made_once_for_each_word(spark):
    """However often the word occurs, and whatever is asked of the answer later."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(word):
        made.add(1)
        return f'[{{"input":"{word}","lemma":"{word}e"}}]'

    words = spark.range(300).select(F.get(F.array(F.lit("a"), F.lit("b "), F.lit("1")), (F.col("id") % 3).cast("int")).alias("lemma"))
    lemmas = wordlist.clean_lemmas(words)
    responses = lemmas.select(F.col("lemma").alias("wort"), body("lemma").alias("body"), F.lit(None).cast("string").alias("error"))
    good = lookup.parse_lookup(responses).filter(F.col("error").isNull() & F.col("canonical").isNotNull())
    assert pairs(good, "wort", "canonical") == [("a", "ae"), ("b", "be")]
    assert made.value == 2


def test_forms_of_a_lemma_make_one_row(spark):
    rows = [(4, "a", "x"), (9, " a", " y "), (6, "a\t", "z"), (9, "1", "one"), (7, "-a", ""), (8, "", ""), (5, None, ""), (None, "b", "v")]
    index = lookup.lookup_index(spark.createDataFrame(rows, "ord long, lemma string, lemma_neu string"))
    assert sorted(map(tuple, index.collect())) == [("a", 4, 9, "y"), ("b", None, None, None)]
    answers = spark.createDataFrame([("a", "A", None), ("b", "B", None), ("1", "I", None)], "wort string, canonical string, error string")
    base = spark.createDataFrame(rows, "ord long, lemma string, lemma_neu string")
    merged = {(r["ord"], r["lemma"]): r["lemma_neu"] for r in lookup.merge_lookups(base, index, answers).collect()}
    # the last row of the lemma stands for it, whatever its form, as does every row of the same place
    assert merged == {**{(o, w): n for o, w, n in rows}, (9, " a"): "A", (9, "1"): "A"}


def test_merge_ledger_and_totals(spark):
    answers = spark.createDataFrame(
        [("a", "A!", None, "t2"), ("c", None, "HTTP 500", "t2"), ("e", "NOT_FOUND", None, "t2")],
        "wort string, canonical string, error string, timestamp string",
    )
    start = base(spark)
    merged = lookup.merge_lookups(start, lookup.lookup_index(start), answers)
    assert pairs(merged, "ord", "lemma_neu") == [(0, ""), (1, "A"), (2, "x"), (3, ""), (4, ""), (5, "NOT_FOUND"), (6, "A!")]
    ledger = spark.createDataFrame([("c", 2, "old", "t1"), ("e", 1, "old", "t1"), ("z", 1, "old", "t1")], LEDGER)
    after = lookup.update_ledger(ledger, answers)
    assert pairs(after) == [("c", 3, "HTTP 500", "t2"), ("z", 1, "old", "t1")]
    assert lookup.lookup_stats(merged, after).first().asDict() == {"answered": 4, "pairs": 3, "given_up": 1}
    assert pairs(lookup.lookup_pairs(merged)) == [("a", "A"), ("a", "A!"), ("b", "x")]


def counting_service(spark, answers, words):
    """Words to answers, a failure for the others; ``calls`` counts how often each word was asked."""
    calls = {w: spark.sparkContext.accumulator(0) for w in words}

    def ask(asked):
        def run(batches):
            for batch in batches:
                out = batch.copy()
                for word in batch["wort"]:
                    calls[word].add(1)
                out["body"] = [answers.get(w) for w in batch["wort"]]
                out["error"] = [None if w in answers else "HTTP 500" for w in batch["wort"]]
                out["timestamp"] = "t2"
                yield out

        return lookup.parse_lookup(asked.mapInPandas(run, "wort string, body string, error string, timestamp string"))

    return ask, calls


def test_each_word_is_asked_once_per_round(spark):
    bad = [f"f{i}" for i in range(10)]
    ledger = spark.createDataFrame([(w, 0, "", "t1") for w in [*bad, "good", "late"]] + [("over", 3, "HTTP 429", "t1")], LEDGER)
    index = spark.createDataFrame([(w, i) for i, w in enumerate([*bad, "good", "late", "over"])], "lemma string, row_ord long")
    ask, calls = counting_service(spark, {"good": '[{"input":"good","lemma":"Gut"}]', "late": "[]"}, [*bad, "good", "late", "over"])
    found, left = lookup.retry_rounds(ledger, index, ask)
    for _ in range(3):  # using the results asks nothing again
        assert pairs(found) == [("good", "Gut"), ("late", "NOT_FOUND")]
        assert pairs(left) == sorted([(w, 3, "HTTP 500", "t2") for w in bad] + [("over", 3, "HTTP 429", "t1")])
    assert {w: c.value for w, c in calls.items()} == {**{w: 3 for w in bad}, "good": 1, "late": 1, "over": 0}


def test_rounds_end_when_no_word_is_left(spark):
    ledger = spark.createDataFrame([("a", 1, "x", "t1"), ("b", 2, "x", "t1")], LEDGER)
    index = spark.createDataFrame([("a", 0), ("b", 1)], "lemma string, row_ord long")
    rounds = []
    ask, _ = counting_service(spark, {"a": "[]", "b": "[]"}, ["a", "b"])
    found, left = lookup.retry_rounds(ledger, index, lambda words: rounds.append(1) or ask(words), max_failures=9)
    assert len(rounds) == 1 and left.isEmpty() and pairs(found) == [("a", "NOT_FOUND"), ("b", "NOT_FOUND")]
    found, left = lookup.retry_rounds(ledger, index, ask, rounds=0)
    assert found.isEmpty() and left.count() == 2
