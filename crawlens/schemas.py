"""Schemas of the crawl tables, as DDL. Flags are three-valued: null means unknown."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Tables and columns that crawls are exchanged in.
DDL = {
    "urls": """job_id string, id bigint, url string, url_hash string, host string, path string, scheme string, is_internal boolean, crawl_depth int,
        content_type string, content_length bigint, status_code int, status_group string, response_time_ms double, is_html boolean, resource_type string,
        redirect_url string, indexable boolean, body_hash string, first_seen_at timestamp, last_crawled_at timestamp, url_length int, folder_depth int,
        word_count int, text_ratio double, redirect_type int, status_text string, last_modified string, http_version string, transfer_size bigint,
        indexability_status string, blocked_by_robots boolean, inlinks_count int, outlinks_count int, external_outlinks_count int,
        unique_inlinks_count int, pagerank double, in_sitemap boolean""",
    "html_meta": """url_id bigint, title string, title_len int, meta_description string, meta_description_len int, meta_keywords string, meta_robots string,
        x_robots_tag string, canonical_href string, canonical_header string, og_title string, og_description string, og_image string, og_url string,
        og_type string, twitter_card string, twitter_title string, twitter_description string, rel_next string, rel_prev string, title_pixel_width int,
        meta_description_pixel_width int, meta_refresh string, has_meta_outside_head boolean""",
    "headings": "id bigint, url_id bigint, tag string, position int, text string",
    "links": """id bigint, job_id string, from_url_id bigint, to_url string, to_url_hash string, anchor_text string, rel string, is_internal boolean,
        link_position string, follow boolean, target string, alt_text string, link_type string""",
    "hreflang": "id bigint, url_id bigint, lang string, href string, return_tag_ok boolean, lang_valid boolean",
    "structured_data": "id bigint, url_id bigint, raw string, format string, schema_type string, validation_status string, validation_issues array<string>",
    "resources": """id bigint, url_id bigint, resource_url string, resource_type string, alt_text string, size_bytes bigint, width int, height int,
        is_mixed_content boolean""",
    "page_content": """url_id bigint, content_text string, content_length int, content_markdown string, content_text_original string,
        content_markdown_original string, cleaned_at timestamp""",
    "security_headers": """url_id bigint, is_https boolean, has_mixed_content boolean, has_hsts boolean, has_csp boolean, has_x_content_type_options boolean,
        has_x_frame_options boolean, referrer_policy string, has_unsafe_crossorigin boolean""",
    "issues": "id bigint, job_id string, url_id bigint, issue_type string, severity string, details string, detected_at timestamp",
    "semantic_pages": """id bigint, analysis_id string, url_id bigint, embedding array<float>, cluster_id int, ring string, semantic_role string,
        distance_to_centroid double, weight double, pr_norm double, clicks_norm double, x double, y double""",
    "cannibalization": "id bigint, analysis_id string, url_dominant_id bigint, url_weak_id bigint, cosine_similarity double",
    "gsc_job_data": "id bigint, job_id string, url_id bigint, clicks int, impressions int, ctr double, position double",
    "gsc_query_data": "id bigint, job_id string, url_id bigint, query string, clicks int, impressions int, ctr double, position double",
    "cleaning_rulesets": """id bigint, job_id string, group_key string, url_regex string, rules array<struct<type:string,value:string>>, targets string,
        pages_affected int, pages_skipped int, chars_removed bigint, created_at timestamp""",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])
