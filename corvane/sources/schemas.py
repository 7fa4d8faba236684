"""Schemas of the engine's tables."""

FETCH_REQUEST = "url string, headers map<string,string>, timeout_ms bigint, follow_redirects boolean"
FETCH_RESPONSE = "status int, headers map<string,string>, body binary, content_type string, latency_ms bigint, error struct<kind:string,status:int,message:string>"
FETCH_LOG = "event_id bigint, ts timestamp, url string, domain string, strategy string, latency_ms bigint, success boolean, status int, headers map<string,string>"
ROUTE_STATS = "domain string, strategy string, avg_latency_ms bigint, success_rate double, total_requests int, last_success_at timestamp, last_check_at timestamp"
URL_CACHE = (
    "url string, strategy string, extraction_mode string, content_hash string, content string, content_type string, original_size bigint, "
    "created_at timestamp, last_accessed_at timestamp, expires_at timestamp, etag string, last_modified string"
)
PAGE_HISTORY = "id bigint, url string, content_hash string, content_body string, strategy string, fetched_at timestamp"
EVIDENCE = "url string, content_hash string, strategy string, retrieved_at timestamp, confidence string, citations array<struct<text:string,source_url:string,context:string>>"
SECTIONS = "doc_id bigint, section_idx int, level tinyint, heading string, content string, score double"
ROBOTS = "domain string, robots_text string, fetched_at timestamp"
