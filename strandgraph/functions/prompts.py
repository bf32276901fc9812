"""What is asked of a language model: instructions, message, result schema, version; and offline stand-ins.

A prompt's version is part of the key under which results are kept, so a new version asks anew. The
stand-ins follow simple rules; they let every step run, and be tested, without a model.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Names of the models that clients call; the embedding model is that of the stored vectors."""

    extract: str = "small"
    relate: str = "full"
    chat: str = "small"
    embedding: str = "embedding-small"


@dataclass(frozen=True)
class Prompt:
    name: str
    version: str
    instructions: str
    #: Spark columns of a result (fixed values: names and enumerations of the stored records).
    schema: str
    message: Callable[..., Column]
    offline: Callable[[list[str]], list[dict]]


def _joined(items: Column, label: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{label}: "), F.array_join(items, ", "))).otherwise("")


def _extract(texts: list[str]) -> list[dict]:
    found = []
    for text in texts:
        lines = [x.strip() for x in text.split("\n") if x.strip()] or [""]
        names = re.findall(r"\b(?:propose|introduce|present)\s+([A-Z][\w-]*(?: [A-Z][\w-]*)*)", text, re.ASCII)
        kind = keyword_gate([text])[0]["type"]
        found.append({"title": lines[0][:300], "task": [], "defines": [{"name": n, "definition": ""} for n in dict.fromkeys(names)], "uses": [], "problem": lines[-1][:300], "domain": "general", "paper_type": kind})
    return found


def _relate(texts: list[str]) -> list[dict]:
    built = r"\b(?:build(?:s|ing)? (?:up)?on|extend(?:s|ing)?|based on)\s+([A-Z][\w-]*(?: [A-Z][\w-]*)*)"
    return [{"builds_on": list(dict.fromkeys(re.findall(built, t, re.ASCII)))} for t in texts]


def _intent(texts: list[str]) -> list[dict]:
    out = []
    for text in texts:
        years = re.findall(r"\b(?:19|20)\d\d\b", text)
        count = re.search(r"\b(\d{1,2}) papers?\b", text)
        topic = re.sub(r"\b(?:find|collect|get|papers?|about|on|since|from|to|until|after|before|\d+)\b", " ", text, flags=re.I)
        topic = " ".join(topic.split())
        later = years[-1] if len(years) > 1 else ""
        out.append({"topic": topic, "topic_kr": topic, "interpretation": f"papers on {topic}", "period_from": f"{years[0]}-01" if years else "", "period_to": f"{later}-12" if later else "", "count": int(count[1]) if count else None})
    return out


def _expand(texts: list[str]) -> list[dict]:
    out = []
    for text in texts:
        words = text.splitlines()[0].removeprefix("Topic: ").split() if text else []
        out.append({"queries": list(dict.fromkeys(" ".join(words[i : i + n]) for n in (3, 2) for i in range(max(1, len(words) - n + 1)) if words))[:8]})
    return out


def _suggest(texts: list[str]) -> list[dict]:
    out = []
    for text in texts:
        have = dict(line.split(": ", 1) for line in text.splitlines() if ": " in line)
        if have.get("similar"):
            out.append({"category": "duplicate", "action": "merge", "merge_into": have["similar"], "reason": "like an approved name", "confidence": "med"})
        elif have.get("defined in") or have.get("definition"):
            out.append({"category": "lineage", "action": "approve", "merge_into": None, "reason": "a paper defines it", "confidence": "high"})
        else:
            out.append({"category": "generic", "action": "reject", "merge_into": None, "reason": "no paper defines it", "confidence": "low"})
    return out


def keyword_gate(texts: list[str]) -> list[dict]:
    """The paper type by words of its title and abstract."""
    words = {"survey": ("survey", "review of"), "benchmark": ("benchmark", "dataset"), "analysis": ("analysis", "we study")}
    kind = lambda t: next((k for k, ws in words.items() if any(w in t.lower() for w in ws)), "technique")
    return [{"type": kind(t), "reason": "keyword"} for t in texts]


EXTRACT = Prompt(
    "extract", "e1", "From a paper's title, abstract and introduction, name its task, what it defines with a definition each, what it uses, its problem, domain and type.",
    "title string, task array<string>, defines array<struct<name: string, definition: string>>, uses array<string>, problem string, domain string, paper_type string",
    lambda text: F.concat(F.lit("Paper:\n"), text), lambda texts: _extract([t.removeprefix("Paper:\n") for t in texts]),
)
RELATE = Prompt("relate", "r1", "List the named earlier techniques that this paper's method builds on.", "builds_on array<string>", lambda text: F.concat(F.lit("Paper:\n"), text), _relate)
INTENT = Prompt("parse_intent", "i1", "Say which papers the user wants: topic, period as YYYY-MM, number.", "topic string, topic_kr string, interpretation string, period_from string, period_to string, count long", lambda text: text, _intent)
EXPAND = Prompt("expand", "x1", "Give 5 to 8 short search phrases of 2 to 4 words for the topic, one notion each.", "queries array<string>", lambda topic, related: F.concat(F.lit("Topic: "), topic, _joined(related, "Known terms")), _expand)
GATE = Prompt("gate", "g1", "Say which type of paper this is, with a reason.", "type string, reason string", lambda title, abstract: F.concat_ws("\n", title, abstract), keyword_gate)
SUGGEST = Prompt(
    "suggest", "s1", "Judge whether a name is a technique worth a node: approve, reject, or merge into a known one; give category, reason and confidence.",
    "category string, action string, merge_into string, reason string, confidence string",
    lambda name, definition, defined_in, similar: F.concat(F.lit("name: "), name, F.lit("\ndefinition: "), F.coalesce(definition, F.lit("")), F.lit("\ndefined in: "), F.array_join(defined_in, ", "), F.lit("\nsimilar: "), F.coalesce(similar, F.lit(""))), _suggest,
)
PROMPTS = {p.name: p for p in (EXTRACT, RELATE, INTENT, EXPAND, GATE, SUGGEST)}
