"""Schemas of the tables that the engine reads and writes (names and types are an interface and fixed)."""

from __future__ import annotations

PAGES = (
    "id long, url string, final_url string, host string, status string, lang string, doc_type string, title string, text string, description string, author string, "
    "published string, modified string, section string, keywords string, site_name string, extra string, extractor string, xv short, n_chars int, text_hash string, "
    "fetched_at string, processed_at string, session string"
)
CORPUS = PAGES + ", dup_of long, flags string, attempts int"
RAW = "id long, url string, final_url string, host string, charset string, fetched_at string, html string"
LINKS = "id long, url string"
RUN = "qid long, unit_id string, doc_id long, rank int, score float"
PARENTS = "unit_id string, doc_id long, lang string, doc_type string, char_start int, char_end int, text string, ctx string, n_tokens int, h string"
CHILDREN = PARENTS + ", parent_id string"
QUERIES = "id long, query string, lang string"
LABELS = "item string, labeler string, tag string, grade int, note string"
