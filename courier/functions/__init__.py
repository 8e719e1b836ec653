"""Column expressions used by the operators (all built-in Spark functions)."""

from .endpoints import host, port, url_authority
from .nested import json_path, lookup
from .paths import (archive_name, basename, extension, file_name_for_owner, join_key, s3_uri, slug,
                    stem)
from .sizes import human_bytes, mb_to_bytes
from .text import binary_head, decode_ignore, utf8_head

__all__ = [
    "archive_name", "basename", "binary_head", "decode_ignore", "extension", "file_name_for_owner",
    "host", "human_bytes", "join_key", "json_path", "lookup", "mb_to_bytes", "port", "s3_uri",
    "slug", "stem", "url_authority", "utf8_head",
]
