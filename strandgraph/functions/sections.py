"""Where abstract and introduction end: the cut before a paper's second section.

All lines that look like a heading of section 2 are candidates; the text between them and the headings
themselves come as two arrays, so that a candidate's place is the length of what stands before it. One
walk over the candidates takes the first that has a usual title or follows the end of a sentence, and has
no third item of a list close below. Without one the text is cut at a sentence's end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandgraph.functions.text import boundary_cut

#: Limits in characters (fixed values): where an abstract's heading may stand, the least length before
#: a heading of section 2, how much stays without one, how near a third list item must follow.
ABSTRACT_WITHIN, FIRST_HEADING_AFTER, FALLBACK_CHARS, LIST_WITHIN = 5000, 3000, 6000, 600

#: Patterns (fixed values): the heading with an optional line for a page number before it and a short
#: capitalised title; the usual titles; the end of a sentence with any closing marks and white space of any
#: script; the third item of a list.
HEADING = r"(?mdU)^[ \t]*(?:\d{1,4}[ \t]*\n[ \t]*)?2(?=[.)\s])[.)]?[ \t]*(?:\n[ \t]*)?([A-Z][A-Za-z0-9][A-Za-z0-9 \-&]{1,44})[ \t]*$"
USUAL = r"(?i)^(?:related works?|background|preliminaries|methodolog\w*|methods?|approach)$"
SENTENCE = r"(?U)[.!?][\"')\]”’]*[\s\x1C-\x1F]*\z"
THIRD = r"(?md)^[ \t]*3[.)]?(?:[ \t]+|[ \t]*\n[ \t]*)[A-Z]"


def section_cut(text: Column) -> Column:
    """struct(text, cut_method): the abstract and introduction, and how their end was found.

    cut_method is 'section' or 'head6000'. A null text is empty. All is done in column expressions, in
    time linear in the text but for lists that look like headings (each reads the text up to it).
    """
    text = F.coalesce(text, F.lit(""))
    before = F.split(text, r"(?iU)\babstract\b", 2)
    start = F.when((F.size(before) == 2) & (F.length(before[0]) <= ABSTRACT_WITHIN), F.length(before[0])).otherwise(0)
    least = start + FIRST_HEADING_AFTER
    # one character more than may be searched, so that a line's begin is seen; only a line's end counts of it
    edge = F.when(F.substring(text, least, F.lit(1)) == "\n", F.lit("\n")).otherwise(F.lit("x"))
    tail = F.concat(edge, F.substring(text, least + 1, F.length(text)))
    heads = F.regexp_extract_all(tail, F.lit(HEADING), F.lit(0))
    between = F.split(tail, HEADING, -1)
    candidates = F.arrays_zip(F.slice(between, F.lit(1), F.size(heads)).alias("gap"), heads.alias("head"))
    intro = F.substring(text, start + 1, F.lit(FIRST_HEADING_AFTER))

    def step(acc: Column, x: Column) -> Column:
        gap, head = x["gap"], x["head"]
        at = acc["at"] + F.length(gap)
        title = F.regexp_extract(head, HEADING, 1)
        # a heading ends in a title, so only the first gap can go on with what stands before
        said = F.when(acc["n"] == 0, F.concat(intro, F.substring(gap, F.lit(2), F.length(gap)))).otherwise(gap)
        listed = F.substring(text, least + at + F.length(head), F.lit(LIST_WITHIN)).rlike(THIRD)
        fits = (F.trim(title).rlike(USUAL) | said.rlike(SENTENCE)) & ~listed
        after = F.struct((at + F.length(head)).alias("at"), (acc["n"] + 1).alias("n"), F.when(fits, at).alias("found"))
        return F.when(acc["found"].isNotNull(), acc).otherwise(after)

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("found"))
    found = F.aggregate(candidates, zero, step, lambda acc: acc["found"])
    cut = F.when(F.length(text) > least, found)
    section = F.struct(F.substring(text, start + 1, FIRST_HEADING_AFTER - 1 + cut).alias("text"), F.lit("section").alias("cut_method"))
    fallback = F.struct(boundary_cut(text, FALLBACK_CHARS).alias("text"), F.lit("head6000").alias("cut_method"))
    return F.when(cut.isNotNull(), section).otherwise(fallback)
