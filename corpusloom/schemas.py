"""Schemas of the library's tables."""

from __future__ import annotations

METADATA = "selected_text_field string, id string, name string, case_name string, court string, court_id string, date_filed string, decision_date string, citation string, citations array<string>, docket_number string"
OPINIONS = f"id string, source_dataset string, record_index long, token_count int, text string, metadata struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in METADATA.split(', '))}>"
CHUNKS = f"id string, source_id string, source_dataset string, chunk_index int, token_start int, token_end int, token_count int, text string, metadata struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in METADATA.split(', '))}>"
QUESTIONS = "id string, type string, question string, reference_answer string"
RESULTS = "pipeline string, question_id string, question string, answer string, model string, prompt_tokens int, completion_tokens int, total_tokens int, latency_ms double, cost_usd double"

#: The ten graph tables, in the order in which they are written.
GRAPH = {
    "legal_cases": "case_id string, case_name string, citations string, court string, decision_date string",
    "chunks": "chunk_id string, source_id string, chunk_index int, token_count int, text string",
    "citations": "citation_id string, citation_text string",
    "has_chunk": "case_id string, chunk_id string",
    "next_chunk": "from_chunk_id string, to_chunk_id string",
    "cites": "case_id string, citation_id string",
    "entities": "entity_id string, name string, type string, frequency long",
    "mentions": "chunk_id string, entity_id string, weight long",
    "related_to": "from_entity_id string, to_entity_id string, relation_type string, weight long",
    "community_reports": "community_id string, level int, summary string, entity_ids string",
}
