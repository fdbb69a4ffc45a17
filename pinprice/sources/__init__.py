"""Sources (table resolver, zone partitions, stand-in views) and sinks."""

from pinprice.sources.fixtures import FIXTURE_SQL, fixture_cte, fixture_tables, fixture_views
from pinprice.sources.sinks import (
    assert_unique,
    changed_count,
    lookup_keys,
    merge_into_table,
    merge_parts,
    merge_values,
    modified_products,
    price_map,
    price_updates,
    read_kv,
    read_parts,
    replace_kv,
    write_bucketed,
    write_kv,
    write_parts,
    write_table,
)
from pinprice.sources.tables import (
    fetch_by_id,
    match,
    offers_from_documents,
    read_offers,
    read_table,
    to_documents,
    write_offers,
)

__all__ = [
    "assert_unique", "changed_count", "lookup_keys", "merge_into_table", "merge_parts", "merge_values", "modified_products", "price_map",
    "price_updates", "read_kv", "read_parts", "replace_kv", "write_bucketed", "write_kv", "write_parts", "write_table",
    "FIXTURE_SQL", "fetch_by_id", "fixture_cte", "fixture_tables", "fixture_views", "match",
    "offers_from_documents", "read_offers", "read_table", "to_documents",
    "write_offers",
]
