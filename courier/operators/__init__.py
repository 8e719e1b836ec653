"""DataFrame operators. Each takes and returns DataFrames; none collects data to the driver."""

from .bundle import bundle_plan, pack_archives, unpack_archives
from .inventory import (DEFAULT_EXCLUDE, exclude_paths, excluded, list_objects, object_preview,
                        size_report, tree_stats)
from .keys import delivery_keys, file_keys
from .ledger import (MissingObjects, SizeLimitExceeded, fetch_user_archive, key_collisions,
                     latest_delivery, missing_archives, oversized, size_guard, transfer_progress)
from .rollup import folder_sizes
from .scan import running_sum
from .settings import (credential_pairs, endpoint_inventory, endpoints, layered_settings, nested_lookup,
                       redact_presence, settings_report)

__all__ = [
    "DEFAULT_EXCLUDE", "MissingObjects", "credential_pairs", "SizeLimitExceeded", "bundle_plan", "delivery_keys",
    "endpoint_inventory", "endpoints", "exclude_paths", "excluded", "fetch_user_archive",
    "file_keys", "folder_sizes", "key_collisions", "latest_delivery", "layered_settings", "list_objects",
    "missing_archives", "nested_lookup", "object_preview", "oversized", "pack_archives",
    "redact_presence", "running_sum", "settings_report", "size_guard", "size_report", "transfer_progress",
    "tree_stats", "unpack_archives",
]
