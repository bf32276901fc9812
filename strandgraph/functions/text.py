"""Scalar functions over names, ids, titles and document texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses whose concepts are nodes of the graph.
NODE_OK = ("approved", "unreviewed")
STATUSES = ("approved", "unreviewed", "pending", "rejected")
PAPER_TYPES = ("technique", "benchmark", "analysis", "survey", "other")


def squeezed(s: Column) -> Column:
    """White space (of any script) collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def canon(s: Column) -> Column:
    """The key of a name: lower case, hyphens as blanks, white space collapsed."""
    return squeezed(F.replace(F.lower(s), F.lit("-"), F.lit(" ")))


def has_paren(s: Column) -> Column:
    return s.rlike(r"\([^()]*\)")


def paren_inner(s: Column) -> Column:
    """The key of what the first parentheses hold."""
    return canon(F.regexp_extract(s, r"\(([^()]*)\)", 1))


def paren_outer(s: Column) -> Column:
    """The key of the name without any parentheses."""
    return canon(F.regexp_replace(s, r"(?U)\s*\([^()]*\)\s*", " "))


def norm_id(s: Column) -> Column:
    """Last path segment without a version suffix; null gives an empty string."""
    tail = F.element_at(F.split(F.regexp_replace(F.coalesce(s, F.lit("")), "/+$", ""), "/"), -1)
    return F.regexp_replace(tail, r"v\d+$", "")


def id_month(s: Column) -> Column:
    """'20YY-MM' from an id that begins with YYMM, else null."""
    head = F.substring(s, 1, 4)
    return F.when(head.rlike(r"^\d{4}$"), F.concat(F.lit("20"), F.substring(head, 1, 2), F.lit("-"), F.substring(head, 3, 2)))


def norm_title(s: Column) -> Column:
    return F.regexp_replace(F.lower(squeezed(s)), r"[^a-z0-9 ]", "")


def url_id(s: Column) -> Column:
    """The paper id in an abstract or PDF address, else an empty string."""
    return F.coalesce(F.regexp_extract(s, r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1), F.lit(""))


def slug(s: Column) -> Column:
    """A name as the local part of an RDF term."""
    return F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_]+", "_"), r"^_+|_+$", "")


def graph_key(s: Column) -> Column:
    """A prefixed node id as the graph's key: concepts lose their prefix, papers keep it."""
    return F.regexp_replace(s, "^concept:", "")


def after_prefix(s: Column) -> Column:
    return F.when(F.instr(s, ":") > 0, F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1)).otherwise(s)


def defaulted(s: Column, value: str | Column) -> Column:
    """Null and empty strings replaced by a default."""
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(value) if isinstance(value, str) else value)


def embed_text(kind: Column, definition: Column, problem: Column) -> Column:
    """What a node is embedded by: a concept's definition, a paper's problem; blank gives null."""
    return F.nullif(F.trim(F.when(kind == "concept", definition).otherwise(problem)), F.lit(""))


def extract_target(count: Column, default: int = 2, cap: int = 10) -> Column:
    """How many papers to extract: 0 and null mean the default."""
    return F.least(F.coalesce(F.nullif(count, F.lit(0)), F.lit(default)), F.lit(cap))


def month_in(month: Column, first: str | None, last: str | None) -> Column:
    """Whether a 'YYYY-MM' lies in a period; missing months pass."""
    missing = F.coalesce(month, F.lit("")) == ""
    inside = F.lit(True)
    if first:
        inside = inside & (month >= first)
    if last:
        inside = inside & (month <= last)
    return missing | inside


def parse_action(s: Column) -> Column:
    """struct(kind, target) of 'approve', 'reject' or 'merge_into:X'."""
    merge = s.startswith("merge_into:")
    return F.struct(F.when(merge, "merge").otherwise(s).alias("kind"), F.when(merge, F.regexp_extract(s, r"(?s)^merge_into:(.*)$", 1)).alias("target"))


def excerpt(s: Column, n: int = 1800) -> Column:
    """The first n characters, trimmed after the cut."""
    return F.regexp_replace(F.substring(F.coalesce(s, F.lit("")), 1, n), r"(?U)^\s+|\s+$", "")


def abbreviated(n: Column) -> Column:
    """17000 as 17.0k (halves rounded up); below a thousand as it is."""
    tenths = F.floor((n + 50) / 100)
    return F.when(n >= 1000, F.format_string("%d.%dk", F.floor(tenths / 10), tenths % 10)).otherwise(n.cast("string"))


def _last_before(text: Column, separator: str) -> Column:
    """0-based position of the separator's last occurrence, -1 if none."""
    back = F.instr(F.reverse(text), separator[::-1])
    return F.when(back == 0, -1).otherwise(F.length(text) - back - len(separator) + 1)


def boundary_cut(text: Column, limit: int = 6000) -> Column:
    """The text up to its last sentence or paragraph end in the first limit characters.

    Ends are tried in the order '.\\n', '. ', blank line; one in the first half doesn't count.
    """
    head = F.substring(text, 1, limit)
    out = head
    for separator in ("\n\n", ". ", ".\n"):
        at = _last_before(head, separator)
        out = F.when(at > limit * 0.5, F.substring(text, F.lit(1), at + 1)).otherwise(out)
    return out


#: Patterns of what shows that a cut went wrong (fixed values).
_LEAK = r"(?imd)^[ \t]*(2[\.\)]?[ \t]+[A-Z]|related\s+work|background|preliminaries)[ \t]*$"
_TAIL = r"(?i)(contribution|in this (paper|work)|we (propose|present|introduce)|organized as follows|summariz|the remainder)"
_RELATED = r"(?imd)^[ \t]*(?:\d{1,4}[ \t]*\n[ \t]*)?2[.)]?[ \t]*\n?[ \t]*(related works?|background)[ \t]*$"


def ends_clean(text: Column) -> Column:
    return F.rtrim(text).rlike(r"(?s)[.!?\")]\z")


def leaks_section(text: Column) -> Column:
    """Whether the heading of a related-work section is inside the text."""
    return text.rlike(_RELATED)


def cut_signals(text: Column, method: Column, full_chars: Column) -> Column:
    """Array of the signals that a cut text shows; empty if it is fine."""
    chars = F.length(text)
    share = chars / F.greatest(full_chars, F.lit(1))
    marks = F.array(
        F.when(~ends_clean(text), "MIDSENT"),
        F.when(method == "head6000", "FALLBACK"),
        F.when(text.rlike(_LEAK), "OVERCAP"),
        F.when(chars < 3500, "SHORT"),
        F.when(~F.right(text, F.lit(1200)).rlike(_TAIL), "NO_TAIL_HINT"),
        F.when(share < 0.08, F.format_string("LOWFRAC:%.2f", share)),
    )
    return F.array_compact(marks)


def related_work_signals(section: Column, source: Column) -> Column:
    """struct(char_count, citation_density, verbatim_match, heading_found) of a section text."""
    cites = F.regexp_count(section, F.lit(r"\[\d+(?:,\s*\d+)*\]|\([A-Z][^()]*\d{4}[a-z]?\)"))
    n = F.length(section)
    return F.struct(
        n.alias("char_count"),
        F.round(F.coalesce(F.try_divide(1000.0 * cites, n), F.lit(0.0)), 6).alias("citation_density"),
        F.coalesce(F.contains(source, section), F.lit(False)).alias("verbatim_match"),
        section.rlike(r"(?i)^\s*(?:\d+\.?\s*)?(related works?|background)").alias("heading_found"),
    )


def tool_args(s: Column) -> Column:
    """struct(args, error) of a tool call's JSON arguments: compact JSON, or what couldn't be parsed.

    Null and empty strings are no arguments.
    """
    given = F.coalesce(F.nullif(F.trim(s), F.lit("")), F.lit("{}"))
    parsed = F.try_parse_json(F.when(given.rlike(r"(?s)^\{.*\}$"), given))  # an object, with nothing after it
    return F.struct(F.to_json(parsed).alias("args"), F.when(parsed.isNull(), F.concat(F.lit("cannot parse tool arguments: "), s)).alias("error"))


def valid_extraction(paper_type: Column, title: Column, defines: Column) -> Column:
    """Whether an extraction keeps its schema: a known type, a title, named definitions."""
    return F.coalesce(paper_type.isin(*PAPER_TYPES) & title.isNotNull() & (F.size(F.filter(defines, lambda d: d["name"].isNull())) == 0), F.lit(False))
