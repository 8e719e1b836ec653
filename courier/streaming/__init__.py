"""Structured Streaming jobs."""

from .ledger import (compact_ledger, kafka_delivery_ledger, latest_by_key, read_ledger, read_ledgers,
                     stream_delivery_ledger)
from .observe import observed_stream, observed_transfer

__all__ = ["compact_ledger", "kafka_delivery_ledger", "latest_by_key", "read_ledgers", "observed_stream", "observed_transfer", "read_ledger", "stream_delivery_ledger"]
