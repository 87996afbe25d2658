"""Captured responses as a data source: spark.read.format("captured_pages").load(path).

Reads files of responses (Parquet, or one JSON object a line) with url, status,
content_type, body and error, of which all but url may be missing.  Every row of
a Parquet file's row group, or of a file of lines, is one partition's work.  A
response that is a page gives its body, cut at `max_chars` characters; any other
gives the reason and the message of a failure: an error's kind, a refusal, a
status, or a content type that is no page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, content_type string, body string, reason string, message string"
# A page's greatest length, content types of pages, kinds of errors and what they say.
MAX_CHARS = 3_000_000
PAGE = re.compile(r"text/html|application/xhtml|text/xml|application/xml", re.I)
REFUSED = {401, 403, 429}
ERRORS = {
    "AbortError": ("timeout", "The page took too long to respond."), "UND_ERR_HEADERS_TIMEOUT": ("timeout", "The page took too long to respond."), "UND_ERR_CONNECT_TIMEOUT": ("timeout", "The page took too long to respond."),
    "ENOTFOUND": ("dns", "That domain could not be found."), "EAI_AGAIN": ("dns", "That domain could not be found."), "ECONNREFUSED": ("connection-refused", "The server refused the connection."), "ECONNRESET": ("connection-refused", "The connection was reset by the server."),
    "CERT_HAS_EXPIRED": ("blocked", "The site's security certificate could not be verified."), "UNABLE_TO_VERIFY_LEAF_SIGNATURE": ("blocked", "The site's security certificate could not be verified."),
}


def judged(status: int | None, content_type: str | None, error: str | None) -> tuple[str | None, str | None]:
    """(reason, message) of a failure; both None for a page."""
    if error:
        return ERRORS.get(error, ("unknown", error))
    if status is not None and not 200 <= status < 300:
        if status in REFUSED:
            return "blocked", f"The site refused the request (HTTP {status}). It may be blocking automated visitors."
        return "http-error", f"The server returned HTTP {status}."
    if content_type and not PAGE.search(content_type):
        return "not-html", f"That address returned {content_type.split(';')[0]}, not a web page."
    return None, None


@dataclass
class Part(InputPartition):
    file: str
    group: int | None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("max_chars", MAX_CHARS))

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = system.get_file_info(root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return system, sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Part]:
        from pyarrow import parquet

        system, files = self._files()
        out = []
        for f in files:
            groups = range(parquet.ParquetFile(system.open_input_file(f)).num_row_groups) if f.endswith(".parquet") else [None]
            out += [Part(f, g) for g in groups]
        return out or [Part("", None)]

    def _rows(self, part: Part) -> Iterator[dict]:
        import json

        from pyarrow import parquet

        system, _ = self._files()
        if not part.file:
            return
        with system.open_input_file(part.file) as source:
            if part.group is None:
                for line in source.read().decode("utf-8", "replace").splitlines():
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue  # a broken line is no response
                    if isinstance(row, dict):
                        yield row
            else:
                file = parquet.ParquetFile(source)
                wanted = [c for c in ("url", "status", "content_type", "body", "error") if c in file.schema_arrow.names]
                for batch in file.iter_batches(batch_size=256, row_groups=[part.group], columns=wanted):
                    yield from batch.to_pylist()

    def read(self, partition: Part) -> Iterator[tuple]:
        for row in self._rows(partition):
            status, kind = row.get("status"), row.get("content_type")
            reason, message = judged(status, kind, row.get("error"))
            body = None if reason else (row.get("body") or "")[: self.limit]
            yield row.get("url"), status, kind, body, reason, message


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
