"""Declared schemas of the persisted tables, as DDL. Nothing is inferred."""

from __future__ import annotations

COUNTRIES = (
    "code string, name string, seq int, synonyms array<string>, demonyms array<string>, "
    "host_labels array<string>, mission_labels array<string>, tlds array<string>"
)
DENYLIST = ("domain string, category string")
AUTHORITY_REGISTRY = (
    "code string, name string, trusted array<string>, "
    "reviewed array<struct<domain:string,evidence:string>>, unconfirmable array<string>"
)
LEXICON_TERMS = ("role string, role_seq int, term_seq int, phrase string, weight double")
LEXICON_LISTS = ("list string, seq int, token string")
SEARCH_HITS = (
    "query string, query_seq int, rank int, url string, title string, snippet string"
)
LINKS = (
    "url string, text string, heading string, depth int, discovered_from string, "
    "src_page string, pos int"
)
FETCH_OBSERVATIONS = (
    "url string, requested_at timestamp, seq long, http_status int, error string, "
    "final_url string, content string, content_hash string, content_type string, bytes long, "
    "etag string, last_modified string, policy string"
)
PAGE_CACHE = (
    "url string, final_url string, fetched_at timestamp, content string, content_hash string, "
    "http_status int, etag string, last_modified string"
)
RESOLVED_CORRIDORS = (
    "corridor_key string, resolved_at timestamp, sources array<struct<source_id:string,title:string,"
    "url:string,authority:string,kind:string,roles:array<string>,score:double,decided_by:string,"
    "signals:array<string>>>, unresolved_roles array<string>, notes array<string>, "
    "queries array<string>, model_calls int, pages_fetched int"
)
RECALL_RECORDS = (
    "corridor_key string, recorded_at timestamp, outcome string, url string, title string, "
    "found_by string, depth int, best_role string, best_score double, position long, "
    "shortlisted boolean, fetched boolean"
)
PLANS = (
    "plan_id string, destination string, visa_required boolean, visa_type string, "
    "explanation string, decision_source_ids array<string>, "
    "application_document_source_ids array<string>, where_to_apply struct<authority:string,"
    "application_method:string,location:string,application_url:string,source_ids:array<string>>, "
    "requirements array<struct<name:string,description:string,reason_it_applies:string,"
    "source_ids:array<string>>>, application_steps array<struct<title:string,action:string,"
    "timing:string,source_ids:array<string>,link_target:string,link_source_id:string>>, "
    "sources array<struct<source_id:string,title:string,url:string,authority:string,"
    "retrieved_at:timestamp,supporting_excerpt:string,is_stale:boolean>>, "
    "unresolved_questions array<string>, last_checked timestamp, status string, "
    "unavailable_sources array<struct<source_id:string,title:string,authority:string,"
    "outcome:string,detail:string,attempted_url:string,final_url:string>>"
)
