"""The operations by the name of what a client asks for: group -> operation -> function."""

from __future__ import annotations

from crawlens.operators import cleaning, explorer, graph, rules, scores, semantic, upserts
from crawlens.sources import archive, exports

OPERATIONS = {
    "jobs": {"list": explorer.jobs, "get": explorer.completeness, "pending": graph.frontier, "progress": explorer.crawl_progress, "resume": upserts.merged_config, "delete": upserts.delete_job, "import": archive.import_job},
    "results": {
        "urls": explorer.page, "url": explorer.url_detail, "issues": explorer.issue_counts, "issues/urls": explorer.affected_urls, "issues/any": explorer.affected_by_any, "tabs": explorer.tab, "hosts": explorer.top_hosts, "templates": explorer.template_sample, "outlinks": explorer.outlinks, "inlinks": explorer.inlinks,
        "stats": explorer.job_stats, "export": exports.urls, "links/export": exports.links, "content/export": exports.content, "backup": archive.export_job, "insights": scores.overall, "analyze": rules.run_all,
    },
    "cleaning": {"groups": cleaning.groups, "preview": cleaning.preview, "apply": cleaning.apply, "revert": cleaning.revert, "rulesets": cleaning.rulesets},
    "semantic": {
        "gsc": semantic.gsc_summary, "analyze": semantic.rings, "results": semantic.site_metrics, "cannibalization": semantic.pair_view, "status": semantic.latest_analysis, "shared-queries": semantic.shared_queries, "actions": semantic.action_lists, "scatter": semantic.plane, "ring-data": semantic.ring_layout,
        "target-rings": semantic.target_rings, "gap": semantic.gap, "drift": semantic.drift, "export": exports.semantic, "report": semantic.report,
    },
}
