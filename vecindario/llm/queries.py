"""The numbered queries and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from . import (query_chat, query_html, query_language, query_leaks, query_near, query_ordering, query_packing, query_quality, query_rules, query_sharding,
               query_trie, query_urls, query_whitening)

MODULES = (query_html, query_rules, query_ordering, query_leaks, query_urls, query_quality, query_near, query_language, query_sharding, query_packing,
           query_whitening, query_chat, query_trie)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
