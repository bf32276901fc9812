"""Reviewing concepts: evidence, similar concepts, cards, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.text import canon, defaulted
from strandgraph.sources.durable import stored

#: Order of confidences in the queue; unknown ones come after, concepts without a card last.
CONFIDENCE = {"low": 0, "med": 1, "high": 2}
UNKNOWN, NO_CARD = 3, 9


def evidence(resolved: DataFrame) -> DataFrame:
    """(rk, n_defs, n_cites): how often each concept is defined and referred to."""
    return resolved.groupBy("rk").agg(F.count_if(F.col("phase") == 0).alias("n_defs"), F.count_if(F.col("phase") == 1).alias("n_cites"))


def evidence_rows(resolved: DataFrame) -> DataFrame:
    """(rk, kind, paper_id, t, definition): every definition, and every citing paper once, as a table.

    A concept's lists may be long, so they stay rows; `evidence_cards` takes the first of each.
    """
    defs = resolved.where("phase = 0").select("rk", F.lit("defined").alias("kind"), "paper_id", "t", "definition")
    cites = resolved.where("phase = 1").groupBy("rk", "paper_id").agg(F.min("t").alias("t"))
    return defs.unionByName(cites.select("rk", F.lit("cited").alias("kind"), "paper_id", "t", F.lit(None).cast("string").alias("definition")))


def evidence_cards(resolved: DataFrame, titles: DataFrame, concepts: DataFrame, n_defs: int = 3, n_cites: int = 6) -> DataFrame:
    """One card per concept (rk, definition): rk, definition, defined_in, cited_in.

    defined_in has the first papers that define it, as (paper_id, title, definition), cited_in the
    first that cite it, as (paper_id, title). Papers (titles: paper_id, title) without a title show
    their id. The definition is the concept's own, else its first paper's.
    """
    rank = F.row_number().over(Window.partitionBy("rk", "kind").orderBy("t"))
    first = evidence_rows(resolved).withColumn("rn", rank).where(((F.col("kind") == "defined") & (F.col("rn") <= n_defs)) | (F.col("rn") <= n_cites) & (F.col("kind") == "cited"))
    named = first.join(titles.select("paper_id", "title"), "paper_id", "left").withColumn("title", F.coalesce("title", F.col("paper_id").cast("string")))
    listed = lambda kind, *fields: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rn", *fields)))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    found = named.groupBy("rk").agg(listed("defined", "paper_id", "title", "definition").alias("defined_in"), listed("cited", "paper_id", "title").alias("cited_in"))
    both = concepts.select("rk", F.col("definition").alias("own")).join(found, "rk", "left")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType))
    told = F.get(F.col("defined_in"), F.lit(0))["definition"]
    return both.select("rk", F.coalesce(F.nullif("own", F.lit("")), told, F.lit("")).alias("definition"), none("defined_in").alias("defined_in"), none("cited_in").alias("cited_in"))


def card_evidence(nodes: DataFrame, resolved: DataFrame, none: str = "(none)") -> DataFrame:
    """(rk, shown, no_evidence): what a card shows as definition, and whether no paper defines the concept."""
    defs = resolved.where("phase = 0").select("rk", F.lit(True).alias("has")).distinct()
    return nodes.join(defs, "rk", "left").select("rk", defaulted(F.col("definition"), none).alias("shown"), F.col("has").isNull().alias("no_evidence"))


def tokens(label: Column) -> Column:
    return F.array_distinct(F.split(canon(label), " "))


def initials(label: Column) -> Column:
    return F.array_join(F.transform(F.split(canon(label), " "), lambda x: F.substring(x, 1, 1)), "")


def find_similar(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """(label, similar, score): for each candidate the approved concept (ord, label) most like it.

    0.95 for initials, 0.8 for a subset of words, the Jaccard index of words from 0.6 on; the first
    of the best. Pairs are found by their rare words: names of Jaccard index 0.6 or more share one of
    the rarest words of either (all but 60 % of its words, and one more), and a subset's rarest word is
    in the other. So a word that a third of all names have joins nothing unless a name has no other.
    """
    a = stored(candidates.select("label").distinct().withColumn("id", F.monotonically_increasing_id()))
    b = stored(approved.select("ord", "label").withColumn("id", F.monotonically_increasing_id()))
    worded = lambda d: d.select("id", F.explode(tokens(F.col("label"))).alias("w"))
    wa, wb = worded(a), worded(b)
    freq = stored(wa.unionByName(wb).groupBy("w").agg(F.count("*").alias("n")))

    def ranked(words: DataFrame) -> DataFrame:
        """(id, w, rarest, prefix): whether the word is its name's rarest, and in its prefix."""
        order = Window.partitionBy("id").orderBy("n", "w")
        rows = words.join(freq, "w").withColumns({"r": F.row_number().over(order), "size": F.count("*").over(Window.partitionBy("id"))})
        return rows.select("id", "w", (F.col("r") == 1).alias("rarest"), (F.col("r") <= F.col("size") - F.ceil(0.6 * F.col("size")) + 1).alias("prefix"))

    ra, rb = stored(ranked(wa)), stored(ranked(wb))
    met = lambda x, y: x.select(F.col("id").alias("ia"), "w").join(y.select(F.col("id").alias("ib"), "w"), "w").select("ia", "ib")
    pairs = met(ra.where("prefix"), rb.where("prefix")).unionByName(met(ra.where("rarest"), rb)).unionByName(met(ra, rb.where("rarest")))
    spelt = lambda d, key: d.select("id", key.alias("w"))
    single = lambda d: d.where(F.size(tokens(F.col("label"))) == 1)
    pairs = pairs.unionByName(met(spelt(single(a), canon(F.col("label"))), spelt(b, initials(F.col("label"))))).unionByName(met(spelt(a, initials(F.col("label"))), spelt(single(b), canon(F.col("label"))))).distinct()
    described = lambda d, p, *more: d.select(F.col("id").alias(f"i{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("label", *more)], canon(F.col("label")).alias(f"{p}_c"), tokens(F.col("label")).alias(f"{p}_t"), initials(F.col("label")).alias(f"{p}_i"))
    full = pairs.join(described(a, "a"), "ia").join(described(b, "b", "ord"), "ib").where("a_c <> b_c")
    both, either = F.size(F.array_intersect("a_t", "b_t")), F.size(F.array_union("a_t", "b_t"))
    acronym = ((F.size("b_t") == 1) & (F.col("a_i") == F.col("b_c"))) | ((F.size("a_t") == 1) & (F.col("b_i") == F.col("a_c")))
    subset = (both == F.size("a_t")) | (both == F.size("b_t"))
    jaccard = both / either
    score = F.greatest(F.when(acronym, 0.95).otherwise(0.0), F.when(subset, 0.8).otherwise(0.0), F.when(jaccard >= 0.6, jaccard).otherwise(0.0))
    scored = full.withColumn("score", score).where("score > 0")
    best = scored.groupBy("a_label").agg(F.max_by(F.struct("b_label", "score"), F.struct("score", -F.col("b_ord"))).alias("x"))
    return best.select(F.col("a_label").alias("label"), F.col("x.b_label").alias("similar"), F.round("x.score", 6).alias("score"))


def queue_rank(confidence: Column, has_card: Column) -> Column:
    known = F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(UNKNOWN))
    return F.when(has_card, known).otherwise(F.lit(NO_CARD))


def review_summary(cards: DataFrame) -> DataFrame:
    a = F.col("action")
    return cards.agg(F.count("*").alias("n"), F.count_if(a == "approve").alias("approve"), F.count_if(a == "reject").alias("reject"), F.count_if(a.startswith("merge")).alias("merge"), F.count_if(F.col("confidence") == "low").alias("low"))


def incremental(cards: DataFrame, pending: DataFrame) -> DataFrame:
    """(label, what): cards of still pending concepts are kept, pending ones without get done."""
    todo = pending.join(cards, "label", "left_anti").select("label", F.lit("todo").alias("what"))
    return todo.unionByName(cards.join(pending, "label", "left_semi").select("label", F.lit("kept").alias("what")))


def paginate(rows: DataFrame, order: list, page: int, size: int, n: int) -> DataFrame:
    """One page (from 0, clamped to the pages there are) of rows in a total order."""
    page = max(0, min(page, -(-n // size) - 1))
    return rows.orderBy(*order).offset(page * size).limit(size)


def attach_cards(items: DataFrame, cards: DataFrame) -> DataFrame:
    """Lexicon items (label, ...) with their card's suggestion (null without one)."""
    return items.join(cards.groupBy("label").agg(F.min(F.struct("action", "confidence")).alias("card")), "label", "left")


def queue(items: DataFrame, cards: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """items (label, status) of a status whose name contains a text, with rank, to be read by (rank, label).

    Undecided concepts with a card come first, those of low confidence before others.
    """
    both = attach_cards(items, cards)
    if status:
        both = both.where(F.col("status") == status)
    if text.strip():
        both = both.where(F.contains(F.lower("label"), F.lit(text.strip().lower())))
    open_ = F.col("card").isNotNull() & F.col("status").isin("pending", "unreviewed")
    return both.select("label", "status", queue_rank(F.col("card.confidence"), open_).alias("rank"))


def report(cards: DataFrame) -> DataFrame:
    """(part, grp, rank, label, line): a review report, to be read in this order.

    First cards of low and medium confidence, one by one, the low ones before; then those of high
    confidence by category. cards has label, status, action, category, reason, confidence.
    """
    high = F.col("confidence") == "high"
    known = cards.where(F.col("confidence").isin(*CONFIDENCE))
    line = F.when(high, F.format_string("- **%s** (%s) - %s", "label", "action", "reason")).otherwise(F.format_string("### %s `%s`: **%s**, %s, %s: %s", "label", "status", "action", "category", "confidence", "reason"))
    return known.select(high.cast("int").alias("part"), F.when(high, F.col("category")).otherwise("").alias("grp"), F.when(high, 0).otherwise(queue_rank(F.col("confidence"), F.lit(True))).alias("rank"), "label", line.alias("line"))
