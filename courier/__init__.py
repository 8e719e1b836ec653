"""courier: data-delivery jobs on Spark — inventories, keys, bundles, ledgers, settings, streams.

Operators take and return DataFrames and run for all owners at once; Catalyst plans them. Python
workers are used only where bytes are packed, unpacked, listed or written (and for one skew-safe
running sum).
"""

from . import functions, operators, plans, sources, streaming
from .session import local_session, work_dir

__all__ = ["functions", "local_session", "operators", "plans", "sources", "streaming", "work_dir"]
