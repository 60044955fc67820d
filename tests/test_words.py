"""Words counted before they are stemmed, and stems told by few expressions, give what stems of every word give."""

from collections import Counter

from pyspark.sql import functions as F

from quillcheck.functions import textexpr as X
from quillcheck.plans import queries
from quillcheck.schemas import NEGATORS

WORDS = "studies ties dies pricing priced prices seeing bed beds feeds need sing rings things bring glasses pass is as use uses used using agreed agreeing trees eding eeds cheese eeeee ing ed des les mining mine étages été naïve ease eases eased".split()


def by_every_word(word):
    """The stem as its three steps, each for every word."""
    n = F.length(word)
    s = F.when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1)).otherwise(word)
    ing = F.regexp_replace(s, r"^(.{3,})ing$|^(.{4,})ed$", "$1$2")
    return F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y"))).otherwise(F.regexp_replace(ing, r"^(.{4,})e$", "$1"))


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", X.stem(F.col("w")).alias("got"), by_every_word(F.col("w")).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_blanks_of_every_kind_become_one(spark):
    texts = ["a b", " a  b ", "a\tb", "a \n\t b", "a b", "a  b\x1c\x85c", "\n", " ", "a \x0b", "plain words only"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.norm_composed(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [" ".join(t.split()) for t in texts]


def test_counts_and_stems_of_words(spark, tmp_path):
    texts = ["Prices, priced and pricing: studies of a study.", "the", "", None, "price price prices"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    top = {r.stem: r.n for r in queries.content_word_top(spark, str(tmp_path)).collect()}
    assert top == {"pric": 6, "study": 2}
    sizes = {r.doc_id: (r.tokens, r.content, r.stems) for r in queries.token_stats(spark, str(tmp_path)).collect()}
    assert sizes == {0: (8, 5, 2), 1: (1, 0, 0), 2: (0, 0, 0), 3: (None, None, None), 4: (3, 3, 1)}


def test_each_word_is_stemmed_once(spark, tmp_path):
    """Stems stand above the first count of words in the plan, and tokens are found by one expression."""
    spark.createDataFrame([(0, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda q: q(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    top, sizes = plan(queries.content_word_top), plan(queries.token_stats)
    assert top.count("Aggregate") == 2 and "ing$" not in top[top.index("Generate") :]
    assert sizes.count("regexp_extract_all") == 1


def test_documents_without_a_sentence_have_no_windows(spark, tmp_path):
    texts = ["One. Two.", "", None, "\n\n", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in queries.passage_windows(spark, str(tmp_path)).collect()] == [(0, 2, 13)]


def test_texts_without_a_negator_are_told_at_a_glance(spark):
    """Every negator, and a text that has none in any word, give what tokens give; tokens stand behind the look in the plan."""
    pairs = [(f"it has {n} phone support", "it has phone support") for n in [*NEGATORS, "cannot lose", "doesn't have"]] + [("it has phone support", "it has phone support"), ("a knot of phone wires", "phone wires"), (None, "no phone"), ("", "no phone"), ("phone", "phone without phone")]
    a, b = F.col("a"), F.col("b")
    shared = X.let(F.array_intersect(X.content_words_n(a), X.content_words_n(b)), lambda s: F.coalesce(X.negated_n(a, s), F.lit(False)) != F.coalesce(X.negated_n(b, s), F.lit(False)))
    rows = spark.createDataFrame(pairs, "a string, b string").select(X.polarity_mismatch_n(a, b).alias("got"), F.coalesce(shared, F.lit(False)).alias("want"))
    got = rows.collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert sum(r.got for r in got) >= len(NEGATORS)
    assert rows._jdf.queryExecution().analyzed().toString().count("CASE WHEN") > 1 and "Contains" in rows._jdf.queryExecution().executedPlan().toString()
