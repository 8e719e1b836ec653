"""Multi-step jobs built from the operators: publish, copy, restore, and the query contracts."""

from .deliver import current_bundles, deliver, restore_bundles
from .publish import copy_objects, current, publish
from .restore import RestoreError, restore, write_restored

__all__ = ["RestoreError", "write_restored", "copy_objects", "current", "current_bundles", "deliver", "publish", "restore",
           "restore_bundles"]
