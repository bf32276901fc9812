"""The section cut on places that are easy to get wrong."""

from pyspark.sql import functions as F

from strandgraph.functions import sections
from strandgraph.functions.text import boundary_cut

INTRO = "Abstract\n" + "Words here. " * 300
LAST = "The last words"


def cut(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", sections.section_cut(F.col("text")).alias("x"), boundary_cut(F.coalesce("text", F.lit(""))).alias("b")).orderBy("i").collect()
    return [r.x.text if r.x.cut_method == "section" else (None, r.x.text == r.b) for r in rows]


def test_headings_after_any_end_of_a_sentence(spark):
    ends = [".", '."', ".”’", "!" + '"' * 12, "?" + ")" * 40, "." + " " * 70 + "\n" * 10, ". ", ". 　", ".\x1c", '."\t\r', "." + "\n" * 200]
    fine = [f"{INTRO}{LAST}{e}\n" for e in ends]
    assert cut(spark, [f"{x}2. Our Things\nrest" for x in fine]) == fine
    bad = ["", ",", ".x", ". x", '"', ":"]
    assert cut(spark, [f"{INTRO}{LAST}{e}\n2. Our Things\nrest" for e in bad]) == [(None, True)] * len(bad)
    assert cut(spark, [f"{INTRO}{LAST}{e}\n2 Related Work\nrest" for e in bad]) == [f"{INTRO}{LAST}{e}\n" for e in bad]


def test_the_first_heading_that_fits(spark):
    a = f"{INTRO}and so\n2. Our Things\nx"
    cases = {
        f"{a}\n2 Background\n": f"{a}\n",
        f"{a}.\n2. Other Things\ny": f"{a}.\n",
        f"{INTRO}\n2. One\n3. Two\n\nMore. \n2. Things\nrest" + "z" * 700: f"{INTRO}\n2. One\n3. Two\n\nMore. \n",
        f"{INTRO}{LAST}.\n12\n2\nMethods\nrest": f"{INTRO}{LAST}.\n",
        f"{INTRO}{LAST}.\n2. Things\n" + "y" * 600 + "\n3. Other": f"{INTRO}{LAST}.\n",
        f"{INTRO}{LAST}.\n2. Things\n" + "y" * 500 + "\n3. Other": (None, True),
        "\U0001f600" * 40 + f" {INTRO}{LAST}.\n2. Things\nrest": f"{INTRO}{LAST}.\n",
        "x" * 4999 + f" {INTRO}{LAST}.\n2. Things\nrest": f"{INTRO}{LAST}.\n",
        "x. " * 1700 + f"\n{INTRO}{LAST}.\n2. Things\nrest": "x. " * 1700 + f"\n{INTRO}{LAST}.\n",  # abstract stands too late
        "Abstract" + "x" * 2991 + "\n2 Methods\nrest": "Abstract" + "x" * 2991 + "\n",
        "Abstract" + "x" * 2990 + "\n2 Methods\nrest" + "x" * 90: (None, True),  # one character too early
        "Abstract" + "x" * 2992 + "2 Methods\nrest": (None, True),  # no line begins there
        "Abstract" + "x" * 2985 + "." + '"' * 12 + "\n2. Things\nrest": "Abstract" + "x" * 2985 + "." + '"' * 12 + "\n",  # the end goes on beyond the least length
        f"{INTRO}.\n2.Things\nrest": f"{INTRO}.\n",
        f"{INTRO}.\n2Things\nrest": (None, True),
        f"{INTRO}.\n2. things\nrest": (None, True),
        f"{INTRO}.\n2. Things, and more\nrest": (None, True),
        f"{INTRO}.\n2. {'T' * 47}\nrest": (None, True),
        "": (None, True),
        "short": (None, True),
    }
    assert cut(spark, [*cases, None]) == [*cases.values(), (None, True)]


def test_many_candidates_take_linear_time(spark):
    import time

    text = INTRO + "no end\n2. Our Things\n" * 4000 + "The end.\n2. Our Things\nx"
    began = time.time()
    assert cut(spark, [text]) == [text[: text.rindex("2. Our")]]
    assert time.time() - began < 30
