"""The graph kept up to date by change propagation: a batch of papers touches only what it changes.

A new mention can change what other papers' names mean: a name in parentheses is what it holds only
from the place where that is first mentioned on. So a batch works outward from its own rows:

1. its rows that came and that went, against the stored rows of the same papers;
2. plain names whose first place moved;
3. names with parentheses that have one of these inside or outside, or whose own first unresolved
   place moved: only these are resolved anew;
4. the concepts that gained or lost mentions: gained ones are merged with their stored minima and
   counts; only where a minimum itself was lost, their other mentions are read;
5. nodes of these concepts, and relations: pairs of a paper and a concept that gained or lost mentions,
   and all pairs of concepts that became nodes or ceased to be.

Names in parentheses whose inside the lexicon lists are that entry's concept wherever they stand, so
they count as listed themselves.

Every table is dealt into buckets by the key it is looked up by, and a step reads the buckets of its
keys. The result equals a build over all papers at once (strandgraph.operators.normalize). Positions
(paper_id, phase, idx) are unique. A change of the lexicon needs `build`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.text import NODE_OK, canon, has_paren
from strandgraph.operators import normalize
from strandgraph.sources.catalog import MOST_SENT, Catalog, Draft, State
from strandgraph.sources.durable import stored

RAW = ["paper_id", "phase", "idx", "name", "definition"]
#: Columns of mentions by their concept.
OF_CONCEPT = [*RAW, "rk"]
#: What tells one mention of a concept from another.
SAME = ["rk", "paper_id", "phase", "idx", "name"]
#: Tables and the keys of their buckets.
KEYS = {"mentions": "paper_id", "papers": "paper_id", "aliases": "key", "odd": "k", "sides": "key", "names": "k", "by_concept": "rk", "concepts": "rk", "nodes": "rk", "relations": "rk"}


def parsed(mentions: DataFrame) -> DataFrame:
    return normalize.keyed(mentions.select(*RAW))


def summed(mentions: DataFrame) -> DataFrame:
    """(rk, first, said, n_said, n): a concept's first mention, its first definition that says something, how many
    mentions say something, and how many there are."""
    says, t = normalize.says(mentions), normalize.t_of()
    return mentions.groupBy("rk").agg(
        F.min(F.struct(t, "name", "phase")).alias("first"), F.min(F.when(says, F.struct(t, "definition"))).alias("said"), F.count_if(says).alias("n_said"), F.count("*").alias("n"))


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows that match no row of gone, nulls matching nulls."""
    gone = gone.select(*[F.col(c).alias(f"_{c}") for c in on])
    return rows.join(gone, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left_anti")


def as_nodes(concepts: DataFrame, reps: DataFrame) -> DataFrame:
    """(rk, canonical, definition, def_status, status, is_node) of concepts that are mentioned."""
    known = reps.select("rk", F.struct("label", "status").alias("known"))
    status = F.coalesce("known.status", F.when(F.col("first.phase") == 0, "unreviewed").otherwise("pending"))
    told = F.col("n_said") > 0
    fine = F.when(told | (F.col("first.phase") == 0), "ok").otherwise("placeholder")
    return concepts.join(known, "rk", "left").select(
        "rk", F.coalesce("known.label", "first.name").alias("canonical"), F.when(told, F.col("said.definition")).otherwise("").alias("definition"), fine.alias("def_status"), status.alias("status"),
        status.isin(*NODE_OK).alias("is_node"))


NODE = ["rk", "canonical", "definition", "def_status", "status"]


def build(draft: Draft, mentions: DataFrame, papers: DataFrame, lexicon: DataFrame, buckets: int = 64) -> None:
    """All tables from all mentions. What hangs on names is made from distinct names; mentions are written in
    their table, joined once with their names and written by concept, and read back from there."""
    draft.write("mentions", mentions.select(*RAW), KEYS["mentions"], buckets)
    m = draft.read("mentions")
    aliases = stored(normalize.alias_map(lexicon))
    packed = normalize.packing(m)
    names = normalize.settle(normalize.places(m, packed, counts=True), aliases)
    varying = normalize.varying(m, names, packed)
    draft.write("by_concept", normalize.joined(m, names, varying).select(*OF_CONCEPT), KEYS["by_concept"], buckets)
    every = draft.read("by_concept")

    is_odd = names.where("not known and ik is not null and not (i_rk is not null and i_since is null)")
    odd = every.where(has_paren(F.col("name"))).join(is_odd.select("name", "k", "ik", "ok"), "name")
    at = lambda c: normalize.t_at(F.col(c), m, packed)
    plain = names.where("not known and ik is null").groupBy("k").agg(F.min("first").alias("since"), F.sum("n").alias("n")).select("k", at("since").alias("since"), "n")
    alone = names.where("alone is not null").groupBy("k").agg(F.min("alone").alias("alone")).select("k", at("alone").alias("alone"))
    draft.write("names", plain.join(alone, "k", "full_outer").select("k", "since", "n", "alone"), KEYS["names"], buckets)
    draft.write("odd", odd.select(*RAW, normalize.t_of(), "k", "ik", "ok", "rk"), KEYS["odd"], buckets)
    draft.write("sides", sides(is_odd), KEYS["sides"], buckets)
    draft.write("aliases", aliases, KEYS["aliases"], buckets)
    draft.write("papers", papers, KEYS["papers"], buckets)

    found = normalize.firsts(names, varying, counts=True)
    phase = F.when(F.col("opened") == F.col("first.at"), 0).otherwise(1).cast(m.schema["phase"].dataType)
    found = found.select("rk", F.struct(at("first.at").alias("t"), F.col("first.name").alias("name"), phase.alias("phase")).alias("first"), "n")
    said = summed(every.where(normalize.says(every))).select("rk", "said", "n_said")
    concepts = found.join(said, "rk", "left").select("rk", "first", "said", F.coalesce("n_said", F.lit(0)).alias("n_said"), "n")
    draft.write("concepts", concepts.where("rk is not null").unionByName(summed(every.where("rk is null"))), KEYS["concepts"], buckets)
    nodes = as_nodes(draft.read("concepts"), normalize.representatives(lexicon)).where("is_node").select(*NODE)
    draft.write("nodes", nodes, KEYS["nodes"], buckets)
    draft.write("relations", every.join(draft.read("nodes").select("rk"), "rk", "left_semi").select("paper_id", "rk", normalize.kind_of()).distinct(), KEYS["relations"], buckets)
    if "lexicon" not in draft:
        draft.write("lexicon", lexicon)
    draft.tables["aliases"]["of_lexicon"] = draft.tables["lexicon"]["version"]


def is_current(state: State) -> bool:
    """Whether the tables are there, count mentions and were built with the lexicon's present version."""
    return all(t in state for t in KEYS) and all("n" in state.schema(t).names for t in ("names", "concepts")) and state.tables["aliases"].get("of_lexicon") == state.tables["lexicon"]["version"]


def sides(odd: DataFrame) -> DataFrame:
    """(key, k): which names with parentheses hang on a key. Pairs of rows that went may stay."""
    return odd.select(F.explode(F.array("ik", "ok")).alias("key"), "k").distinct()


def _listed(draft: Draft, rows: DataFrame) -> DataFrame:
    """Rows (k, ik, ok, ...) with rep, the lexicon's concept of the name or of what its parentheses hold."""
    keys = rows.select(F.explode(F.array_compact(F.array("k", "ik"))).alias("key")).distinct()
    aliases = stored(draft.read("aliases", keys))
    one = lambda key, rep: aliases.select(F.col("key").alias(key), F.col("rk").alias(rep))
    plain = rows.where("ik is null").join(one("k", "rep"), "k", "left")
    odd = rows.where("ik is not null").join(one("k", "rep"), "k", "left").join(one("ik", "i_rep"), "ik", "left")
    return plain.select(*rows.columns, "rep").unionByName(odd.select(*rows.columns, F.coalesce("rep", "i_rep").alias("rep")))


def add(draft: Draft, mentions: DataFrame, papers: DataFrame) -> None:
    """Papers with all of their mentions, new ones or in place of what is stored of them."""
    papers = stored(papers)
    ids = stored(papers.select("paper_id").unionByName(mentions.select("paper_id")).distinct())
    had = stored(draft.known("mentions", ids))
    before, after = stored(parsed(draft.read("mentions", had))), stored(parsed(mentions))
    same = [before[c].eqNullSafe(after[c]) for c in RAW]
    came, went = after.join(before, same, "left_anti"), before.join(after, same, "left_anti")

    # what the batch's names stand for: aliases of their keys, and only those
    came, went = stored(_listed(draft, came)), stored(_listed(draft, went))
    is_plain, is_odd = "rep is null and ik is null", "rep is null and ik is not null"

    # plain names: where they are first met now
    moved, names = _first_places(draft, came.where(is_plain), went.where(is_plain))

    # names with parentheses: resolved anew where a key of theirs moved, where rows went, or where they
    # now stand for themselves from another place on
    hang = draft.read("sides", moved.select(F.col("k").alias("key"))).select("k").distinct()
    anew = stored(hang.unionByName(went.where(is_odd).select("k")).distinct())
    columns = [*after.columns]
    new_odd = came.where(is_odd).select(*columns)
    stale = draft.read("odd", anew)
    lookup = _lookup(draft, names, new_odd.unionByName(stale.select(*columns)))
    new_odd = stored(normalize.with_found(new_odd, lookup))
    own = names.select("k", "since", "alone").unionByName(draft.read("names", new_odd.select("k")).join(names, "k", "left_anti").select("k", "since", "alone"))
    first = new_odd.where("found is null").groupBy("k").agg(F.min("t").alias("t"))
    earlier = first.join(own.select("k", "alone"), "k", "left").where("alone is null or t < alone").select("k")
    anew = stored(anew.unionByName(earlier).distinct())
    stale = stored(draft.read("odd", anew))
    rest = stale.join(went.select(*RAW), [stale[c].eqNullSafe(went[c]) for c in RAW], "left_anti").select(*columns)
    lookup = _lookup(draft, names, rest)
    full = stored(normalize.with_found(rest, lookup).unionByName(new_odd.join(anew, "k", "left_semi")))
    alone = normalize.first_alone(full)
    full = normalize.with_concept(full.join(alone, "k", "left")).select(*columns, "rk")
    light = new_odd.join(anew, "k", "left_anti").join(own.select("k", "alone"), "k", "left")
    odd_now = stored(full.unionByName(normalize.with_concept(light).select(*columns, "rk")))

    # mentions that have come to a concept, and that have left one
    with_rk = lambda rows: rows.where("rep is not null or ik is null").select(*RAW, F.coalesce("rep", "k").alias("rk"))
    fresh = odd_now.join(stale, [odd_now[c].eqNullSafe(stale[c]) for c in OF_CONCEPT], "left_anti")
    gone = stale.join(odd_now, [stale[c].eqNullSafe(odd_now[c]) for c in OF_CONCEPT], "left_anti")
    gained, lost = (stored(with_rk(rows).unionByName(more.select(*OF_CONCEPT))) for rows, more in ((came, fresh), (went, gone)))
    _update_graph(draft, gained, lost, ids.join(had, "paper_id", "left_anti"))

    draft.hide("mentions", had, mentions)
    draft.hide("papers", draft.known("papers", ids), papers)
    draft.change("odd", anew, odd_now)
    new_sides = sides(odd_now)
    draft.append("sides", new_sides.join(draft.read("sides", new_sides.select("key")), ["key", "k"], "left_anti"))
    none = F.lit(None).cast(draft.schema("names")["since"].dataType)
    now = names.where("since is not null").select("k", "since", "n", none.alias("alone")).unionByName(alone.select("k", none.alias("since"), F.lit(None).cast("long").alias("n"), "alone"))
    draft.change("names", names.select("k").unionByName(anew).distinct(), now)
    draft.hide("by_concept", lost, gained, SAME)


def _first_places(draft: Draft, came: DataFrame, went: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k) of plain names whose first place moved, and the rows (k, since, n, alone) of all plain names met. Mentions
    are read of those only that lost their first place and have others."""
    met = stored(came.select("k").unionByName(went.select("k")).distinct())
    was = stored(draft.read("names", met))
    more = came.groupBy("k").agg(F.min("t").alias("t"), F.count("*").alias("n_came"))
    less = went.groupBy("k").agg(F.min("t").alias("t_went"), F.count("*").alias("n_went"))
    now = met.join(was, "k", "left").join(more, "k", "left").join(less, "k", "left")
    kept = F.coalesce("n", F.lit(0)) - F.coalesce("n_went", F.lit(0))
    now = stored(now.withColumns({"kept": kept, "lost": F.coalesce(F.col("t_went") == F.col("since"), F.lit(False))}))
    left = draft.read("by_concept", now.where("lost and kept > 0").select(F.col("k").alias("rk")))
    left = without(normalize.keyed(left).where("k = rk and ik is null"), went, ["k", "t", "name"]).groupBy("k").agg(F.min("t").alias("left"))
    since = F.least(F.when(F.col("lost"), F.col("left")).otherwise(F.col("since")), F.col("t"))
    now = stored(now.join(left, "k", "left").select("k", since.alias("since"), (F.col("kept") + F.coalesce("n_came", F.lit(0))).alias("n"), "alone", F.col("since").alias("was")))
    return now.where("not since <=> was").select("k"), now.select("k", "since", "n", "alone")


def _lookup(draft: Draft, names: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, rk, since) of the keys inside and outside the rows' parentheses."""
    keys = stored(rows.select(F.explode(F.array("ik", "ok")).alias("key")).distinct())
    plain = names.select("k", "since", "alone").unionByName(draft.read("names", keys.select(F.col("key").alias("k"))).join(names, "k", "left_anti").select("k", "since", "alone"))
    return stored(normalize.lookup_table(draft.read("aliases", keys), plain.where("since is not null").select("k", "since")))


def _update_graph(draft: Draft, gained: DataFrame, lost: DataFrame, new_papers: DataFrame) -> None:
    """Concepts, nodes and relations of the concepts that gained or lost mentions; mentions by concept are as before."""
    touched = stored(gained.select("rk").unionByName(lost.select("rk")).distinct())
    plus, minus = summed(gained), summed(lost)
    was = stored(draft.read("concepts", touched).join(minus.select("rk", F.struct("first", "said", "n_said", "n").alias("less")), "rk", "left"))
    left = lambda c: F.col(c) - F.coalesce(f"less.{c}", F.lit(0))
    lost_at = lambda c: F.coalesce(F.col(f"less.{c}.t") == F.col(f"{c}.t"), F.lit(False))
    kept = was.select("rk", *[F.when(~lost_at(c), F.col(c)).alias(c) for c in ("first", "said")], *[left(c).alias(c) for c in ("n_said", "n")])
    again = was.where((lost_at("first") & (left("n") > 0)) | (lost_at("said") & (left("n_said") > 0))).select("rk")
    others = summed(without(draft.read("by_concept", stored(again)), lost, SAME)).withColumns({"n_said": F.lit(0), "n": F.lit(0)})
    merged = kept.unionByName(others).unionByName(plus).groupBy("rk").agg(F.min("first").alias("first"), F.min("said").alias("said"), F.sum("n_said").alias("n_said"), F.sum("n").alias("n"))
    concepts = stored(merged.where("n > 0"))
    draft.change("concepts", touched, concepts)
    reps = normalize.representatives(draft.read("lexicon").join(touched, canon(F.col("label")) == F.col("rk"), "left_semi"))
    now = stored(as_nodes(concepts, reps))
    live, were = now.where("is_node").select("rk"), stored(draft.read("nodes", touched).select("rk"))
    draft.change("nodes", touched, now.where("is_node").select(*NODE))

    # relations: only pairs that lost a mention or gained one in a paper that was known before can be there already
    # or have others, and those of concepts that became nodes or ceased to be: these are compared before and after
    changed = live.join(were, "rk", "left_anti").unionByName(were.join(live, "rk", "left_anti"))
    pairs = stored(lost.unionByName(gained.join(new_papers, "paper_id", "left_anti")).select("paper_id", "rk").distinct())
    held = draft.parts("by_concept", draft.buckets_of("by_concept", pairs.select("rk")))
    few = pairs.select("paper_id").distinct()
    few = F.broadcast(few) if pairs.count() <= MOST_SENT else few
    held = held.join(few, "paper_id", "left_semi").select(*SAME).join(pairs, ["paper_id", "rk"], "left_semi")
    others = stored(changed.join(kept.where("n > 0"), "rk", "left_semi"))
    mentioned = draft.read("by_concept", others).select(*SAME)
    held = stored(held.unionByName(mentioned))
    relations = lambda rows, nodes: rows.join(nodes, "rk", "left_semi").select("paper_id", "rk", normalize.kind_of()).distinct()
    old = stored(relations(held, were))
    new = stored(relations(without(held, lost, SAME).unionByName(gained.select(*SAME)), live))
    pair = ["rk", "paper_id", "type"]
    draft.hide("relations", without(old, new, pair), without(new, old, pair), pair)


def merge(draft: Draft, mentions: DataFrame, papers: DataFrame, buckets: int = 64) -> None:
    """Add a batch; build anew if there is no graph yet or the lexicon has changed since."""
    if is_current(draft):
        add(draft, mentions, papers)
        return
    ids = stored(papers.select("paper_id").unionByName(mentions.select("paper_id")).distinct())
    if "mentions" in draft:
        mentions = draft.read("mentions").select(*RAW).join(ids, "paper_id", "left_anti").unionByName(mentions.select(*RAW))
        papers = draft.read("papers").join(ids, "paper_id", "left_anti").unionByName(papers, allowMissingColumns=True)
    build(draft, mentions, papers, draft.read("lexicon"), buckets)


def ingest_batch(catalog: Catalog, mentions: DataFrame, papers: DataFrame, buckets: int = 64) -> State:
    """One batch in one state: readers see all of it or nothing. buckets counts where tables are built anew."""
    return catalog.transact(lambda draft: merge(draft, mentions, papers, buckets))
