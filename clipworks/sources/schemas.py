"""Explicit schemas: model tables, and the driver tables the registered queries read."""

from __future__ import annotations

RULE = (
    "whitelist ARRAY<STRING>, allowed_domains ARRAY<STRING>, allowed_hosts ARRAY<STRING>, "
    "allowed_host_patterns ARRAY<STRING>, link_allow_patterns ARRAY<STRING>, link_deny_patterns ARRAY<STRING>, "
    "item_limit INT, max_pages INT, parser STRING"
)

MODEL = {
    "sources": "source_id BIGINT, source_code STRING, name STRING, type STRING, site_url STRING, language STRING, "
               f"trust_level STRING, whitelist_entity_id STRING, active BOOLEAN, rule STRUCT<{RULE.replace(' ARRAY', ': ARRAY').replace(' INT', ': INT').replace(' STRING', ': STRING')}>",
    "heads": "news_id BIGINT, source_id BIGINT, canonical_url STRING, slug STRING, current_version_id BIGINT, "
             "first_seen_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ",
    "versions": "version_id BIGINT, news_id BIGINT, title STRING, summary STRING, body_text STRING, "
                "original_url STRING, published_at TIMESTAMP_NTZ, language STRING, category STRING, "
                "keywords ARRAY<STRING>, region_tags ARRAY<STRING>, entity_ids ARRAY<STRING>, is_related BOOLEAN, "
                "content_hash STRING, url_status STRING",
    "candidates": "candidate_id BIGINT, run_id BIGINT, source_id BIGINT, original_url STRING, canonical_url STRING, "
                  "raw_title STRING, raw_summary STRING, cleaned_title STRING, cleaned_summary STRING, "
                  "published_at TIMESTAMP_NTZ, review_status STRING, reject_reason STRING, body_text STRING",
    "snapshots": "snapshot_id BIGINT, run_id BIGINT, dataset_type STRING, payload STRING, created_at TIMESTAMP_NTZ",
    "entities": "id STRING, name STRING, aliases ARRAY<STRING>, evidence_urls ARRAY<STRING>, category STRING, "
                "relevance STRING",
    "fetches": "url STRING, status_code INT, final_url STRING, html STRING",
}

DRIVER = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}
