"""Sources and sinks: file trees, object writes, connector options, the driver's tables."""

from .connectors import (Resolved, kafka_options, kafka_read, kafka_write, s3a_conf, s3a_read, s3a_session,
                         settings_from_env)
from .tables import documents_inventory, events_deliveries, table
from .tree import binary_inventory, object_inventory

__all__ = [
    "Resolved", "binary_inventory", "documents_inventory", "events_deliveries",
    "kafka_options", "kafka_read", "kafka_write", "object_inventory", "s3a_conf", "s3a_read",
    "s3a_session", "settings_from_env", "table",
]
