"""Queries of the subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestrata.llm.canonical_mapping import site_and_sheet_types
from lodestrata.llm.chunked_encoding import encode_corpus
from lodestrata.llm.entity_matching import same_places
from lodestrata.llm.eval_leakage import find_leaks
from lodestrata.llm.personal_data import find_personal_data, redact_corpus
from lodestrata.llm.scan_repair import repair_events, repaired_paragraphs
from lodestrata.session import read

QUERIES = {
    "p1_found": lambda s, d: same_places(read(s, d, "sedau"), read(s, d, "usmin_sn"), read(s, d, "mineral_sites")),
    "p3_found": lambda s, d: site_and_sheet_types(read(s, d, "mineral_sites"), read(s, d, "golden_sheet"), read(s, d, "deposit_types")),
    "p6_found": lambda s, d: repair_events(read(s, d, "pdf_content")),
    "p6_paragraphs": lambda s, d: repaired_paragraphs(read(s, d, "pdf_content")),
    "p8_ids": lambda s, d: encode_corpus(read(s, d, "documents")),
    "p9_found": lambda s, d: find_leaks(read(s, d, "documents"), read(s, d, "eval_items")),
    "p10_found": lambda s, d: find_personal_data(read(s, d, "documents")),
    "p10_redacted": lambda s, d: redact_corpus(read(s, d, "documents").select("doc_id", "text")),
}

SQL: dict[str, str] = {}
