"""The engine's entry points in one place; every function takes a session or DataFrames."""

from quire.operators.contracts import breaches, operation_breaches, manifest_breaches, read_closed, schema_check, vocabulary_breaches
from quire.operators.evidence import assertions, choices, continuation, prune, unit_texts, units
from quire.operators.events import admission, continuation_violations, current, pending, quality_state, quality_violations, violations
from quire.operators.hierarchy import closure, graph_problems, qualifier_cube, range_join, scope_prefixes
from quire.operators.gates import envelope, row_scope, scope_gate
from quire.operators.interpret import interpret, mentions
from quire.operators.matching import decide, scope_counts
from quire.operators.procedures import Recipe, audit_links, extract_decisions, extract_steps, extract_tables, ordered_steps, specifications
from quire.operators.proposals import proposals
from quire.operators.relations import anchor_candidates, backlinks, lead_members, leads, link_status, membership, navigation_labels, shard_pack, shared_text
from quire.operators.reviewlog import append, event, rebase
from quire.operators.search import bm25, collapse, facets, filtered, indexed_search, postings, save_index, scoped_search
from quire.plans.package import cached, extract, library, normalize, open_package, open_source, read_package, write_package
from quire.plans.publish import ScopeCache, Search, open_current, publish, search
from quire.sources.archives import PodSource, disc_entries, entries, zip_members
from quire.sources.discover import inspect, listing, probe, routes, unpacked
from quire.sources.files import described_vehicles, image_pages, inventory, page_texts, pdf_pages
from quire.sources.html import parse
from quire.sources.svg import safe_svg

__all__ = [name for name in dir() if not name.startswith("_")]
