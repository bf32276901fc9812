"""Schemas of stored records. They are always given to readers, never inferred."""

from __future__ import annotations

EXTRACTION = "title string, task array<string>, defines array<struct<name string, definition string>>, uses array<string>, problem string, domain string, paper_type string"
RELATIONS = "builds_on array<string>"
PARSED = "paper_id string, ok boolean, reason string, cut_method string, char_count int, text string"
LEXICON_ENTRY = "struct<aliases: array<string>, status: string, definition: string, source: string, first_seen: string>"
LEXICON = f"techniques map<string, {LEXICON_ENTRY}>"
CALL_LOG = "stage string, kind string, model string, prompt_tokens long, completion_tokens long, seconds double"
REVIEWED = "reviewed array<string>, _corrupt_record string"
CARDS = "concept string, status string, similar_existing string, suggestion struct<category string, action string, reason string, confidence string>"
EMBEDDINGS = "node_id string, model string, vector array<float>"
SESSION = "thread_id string, seq long, stage string, state string"
