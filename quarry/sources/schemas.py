"""Explicit schemas: nothing is inferred."""

from __future__ import annotations

RUN = "qid string, q0 string, doc_id string, rank int, score double, run_name string"
QRELS = "qid string, iter string, doc_id string, rel int"
QUERY = "query_id string, query string"
CORPUS = "id string, url string, title string, text string"
EDGE = "src long, dst long, weight double"
PAGE = ", ".join(["page_id int", "page_namespace int", "page_title string", "page_is_redirect string", "page_is_new string", "page_random string",
                  "page_touched string", "page_links_updated string", "page_latest string", "page_len string", "page_content_model string", "page_lang string"])
PAGELINKS = "pl_from int, pl_from_namespace int, pl_target_id int"
