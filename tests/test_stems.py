"""Stems against the examples that were published with the rules."""

from pyspark.sql import functions as F

from larkfield.functions.stems import stem
from larkfield.operators import text_index as ti

# Words and their stems after all steps.
EXAMPLES = """
caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled,
motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall,
hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit,
rational ration, valenci valenc, hesitanci hesit, digitizer digit, conformabli conform, radicalli radic,
differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper,
feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit,
sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr,
hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop,
adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend,
adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog,
effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll,
generalizations gener, oscillators oscil, is is, by by, opinion opinion, nation nation, région région, x1s x1s
"""


def pairs():
    return [tuple(x.split()) for x in EXAMPLES.replace("\n", " ").split(",")]


def test_published_examples(spark):
    df = spark.createDataFrame(pairs(), "word string, want string")
    assert [tuple(r) for r in df.withColumn("got", stem(F.col("word"))).filter("got <> want").collect()] == []


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "word string").select(stem(F.col("word")).alias("s"))
    assert [r.s for r in df.collect()] == [None, ""]


def test_terms_are_added_up_by_stem(spark):
    df = spark.createDataFrame([(1, "Cats cat hopping, hop the this of"), (2, ""), (3, None)], "id long, text string")
    got = sorted((r.id, r.stem, r.tf) for r in ti.stemmed_terms(df, "id", F.col("text"), ["the", "of"]).collect())
    assert got == [(1, "cat", 2), (1, "hop", 2), (1, "thi", 1)]
