"""Archives that can be read in part: gzip members of bounded size, and an index of the files in them.

A ``tar.gz`` is one stream: to get one file all before it has to be decompressed. Here the stream is
cut into *blocks*, gzip members of about ``block_bytes``, wherever that many bytes have gone in. The
archive is still an ordinary ``tar.gz`` (members may be concatenated) that any tool unpacks whole, and
the index says for each file which blocks hold it. A file, or a byte range of one, is then read by
seeking to its first block and decompressing only the blocks it touches.

The index is a table (Parquet): one row per file, with its archive, its length, and its blocks: where
each starts in the archive, how long it is there, and which byte of the file it starts at (the first
one before the file, as a rule). It is written by the tasks that write the archives.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundle import _writer, part_rows

#: Bytes of the tar stream in a block.
BLOCK_BYTES = 256 * 1024

_BLOCKS = "array<struct<at: bigint, offset: bigint, size: bigint>>"
INDEX = (f"owner string, folder string, part bigint, path string, kind string, mode int, link_target string, length bigint, "
         f"archive string, blocks {_BLOCKS}")
_READ = "owner string, folder string, path string, content binary, length bigint, bytes_read bigint, _error string"


class _BlockWriter:
    """A file object that compresses what is written in members of about ``block_bytes``."""

    def __init__(self, out, block_bytes: int, level: int):
        self.out, self.block_bytes, self.level = out, block_bytes, level
        self.done, self.blocks, self.member, self.held, self.size = 0, [], None, 0, 0

    def _cut(self):
        if self.member is not None:
            self._put(self.member.flush())
            self.blocks[-1][2] = self.size - self.blocks[-1][1]
            self.member = None

    def _put(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def write(self, data: bytes) -> int:
        import zlib

        for lo in range(0, len(data), self.block_bytes):
            piece = data[lo:lo + self.block_bytes]
            if self.member is None:
                self.member, self.held = zlib.compressobj(self.level, zlib.DEFLATED, 31), 0
                self.blocks.append([self.done, self.size, 0])  # start in the tar stream, in the archive, size there
            self._put(self.member.compress(piece))
            self.done += len(piece)
            self.held += len(piece)
            if self.held >= self.block_bytes:
                self._cut()
        return len(data)

    def tell(self) -> int:
        return self.done

    def close(self):
        self._cut()


def _index_packer(stage: str, root: str | None, block_bytes: int, level: int):
    """Rows sorted by (owner, folder, part, key) → one archive file per part, and its index rows."""

    def pack(batches):
        import bisect
        import os
        import tarfile
        import uuid

        import pandas as pd

        add, now = _writer(root), None
        os.makedirs(stage, exist_ok=True)
        columns = ["owner", "folder", "part", "path", "kind", "mode", "link_target", "length", "archive", "blocks"]

        def begin(row):
            path = os.path.join(stage, f"{uuid.uuid4().hex}.tar.gz")
            out = open(path, "wb")
            writer = _BlockWriter(out, block_bytes, level)
            return {"at": (row["owner"], row["_folder"], row["part"]), "name": row["_name"], "path": path, "out": out,
                    "writer": writer, "tar": tarfile.open(fileobj=writer, mode="w", format=tarfile.PAX_FORMAT), "files": []}

        def end(a):
            a["tar"].close()
            a["writer"].close()
            a["out"].close()
            starts = [b[0] for b in a["writer"].blocks]
            rows = []
            for key, kind, mode, target, first, length in a["files"]:
                blocks = None
                if kind == "file" and length:
                    lo, hi = bisect.bisect_right(starts, first) - 1, bisect.bisect_left(starts, first + length)
                    blocks = [{"at": s - first, "offset": o, "size": n} for s, o, n in a["writer"].blocks[lo:hi]]
                rows.append((*a["at"], key, kind, mode, target, length, a["path"], blocks or []))
            return pd.DataFrame(rows, columns=columns)

        for pdf in batches:
            for row in pdf.to_dict("records"):
                if now is None or now["at"] != (row["owner"], row["_folder"], row["part"]):
                    if now is not None:
                        yield end(now)
                    now = begin(row)
                length = add(now["tar"], now["name"], row)
                kind = "link" if row["_target"] is not None else "folder" if row["_dir"] else "file"
                first = now["tar"].offset - -(-length // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
                now["files"].append((row["key"], kind, int(row["_mode"]), row["_target"], first, length))
        if now is not None:
            yield end(now)

    return pack


def pack_indexed(objects: DataFrame, folder: str, owner_col: str = "owner", *, block_bytes: int = BLOCK_BYTES,
                 compresslevel: int = 6, **options) -> DataFrame:
    """Bundle every owner's files into archives in ``folder`` (a mount every executor sees); returns the
    index, one row per member. It is not stored yet: write it once, as Parquet, and read that (a second
    evaluation would write the archives again). ``options`` are those of :func:`bundle.part_rows`."""
    if block_bytes < 512:
        raise ValueError("block_bytes must be 512 or more")
    rows, root = part_rows(objects, owner_col, **options)
    return rows.mapInPandas(_index_packer(folder, root, block_bytes, compresslevel), INDEX)


def _range_reader(start: int, size: int | None):
    def read(batches):
        import zlib

        import pandas as pd

        columns = ["owner", "folder", "path", "content", "length", "bytes_read", "_error"]
        for pdf in batches:
            rows, held = [], 0
            for r in pdf.itertuples(index=False):
                body, fetched, error = b"", 0, None
                end = r.length if size is None else min(r.length, start + size)
                blocks = list(r.blocks)
                # blocks that begin before the end of the range, from the last that begins at its start or before
                first = max([i for i, b in enumerate(blocks) if b["at"] <= start], default=0)
                wanted = [b for b in blocks[first:] if b["at"] < end] if start < end else []
                try:
                    with open(r.archive, "rb") as f:
                        for b in wanted:
                            f.seek(b["offset"])
                            data = f.read(b["size"])
                            fetched += len(data)
                            out = zlib.decompressobj(31)
                            text = out.decompress(data) + out.flush()
                            if not out.eof:
                                raise zlib.error("a block is cut off")
                            body += text[max(0, start - b["at"]):max(0, end - b["at"])]
                    if len(body) != max(0, end - start):
                        raise ValueError(f"{len(body)} of {max(0, end - start)} bytes")
                except (OSError, zlib.error, ValueError) as e:
                    body, error = None, f"{r.archive}: {e}"
                rows.append((r.owner, r.folder, r.path, body, r.length, fetched, error))
                held += len(body or b"")
                if held >= 32 * 1024 * 1024:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return read


def read_members(index: DataFrame, *, start: int = 0, size: int | None = None) -> DataFrame:
    """Bodies of the files that the index rows name, or ``size`` bytes of each from byte ``start`` on:
    ``(owner, folder, path, content, length, bytes_read, _error)``; ``bytes_read`` is what was read of the
    archive. A block that is damaged or gone gives a row with ``_error``; links and folders are left out."""
    if start < 0 or size is not None and size < 0:
        raise ValueError("start and size must not be negative")
    files = index.where("kind = 'file'").select("owner", "folder", "path", "length", "archive", "blocks")
    return files.mapInPandas(_range_reader(start, size), _READ)


def restore_paths(index: DataFrame, wanted: DataFrame, on: Sequence[str] = ("owner", "path")) -> DataFrame:
    """The files that ``wanted`` names by the columns ``on``, each read from its blocks alone. Rows are
    spread evenly before reading, however few archives hold them."""
    chosen = index.join(wanted.select(*on).distinct(), list(on), "left_semi")
    return read_members(chosen.repartition("owner", "folder", "path"))


def missing_paths(index: DataFrame, wanted: DataFrame, on: Sequence[str] = ("owner", "path")) -> DataFrame:
    """The wanted rows that no archive of the index holds."""
    return wanted.select(*on).distinct().join(index.where(F.col("kind") == "file"), list(on), "left_anti")
