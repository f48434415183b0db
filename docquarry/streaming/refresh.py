"""Keeping a published snapshot current: debounced change detection and incremental re-reading."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)

REFRESH_INTERVAL = 2.0  # seconds
FILE_IDENTITY = ("relative_path", "size", "mtime_ns")


def changed_files(published: DataFrame, current: DataFrame) -> DataFrame:
    """Files of the current listing that are new or differ in size or modification time."""
    return current.join(published.select(*FILE_IDENTITY), list(FILE_IDENTITY), "left_anti")


class Revalidator:
    """Runs the refresh steps at most once per interval, one caller at a time.

    Digest of the listing, then (if it moved) discovery and the digest of the contents, then
    (if that moved too) publication. A failing step leaves everything published as it was,
    and both digests too, so the next interval starts over. The time of a check is noted
    before its work, so failures are spaced out as well.
    """

    def __init__(
        self,
        listing_digest: Callable[[], str],
        discover: Callable[[], object],
        content_digest: Callable[[object], str],
        publish: Callable[[object], None],
        published_listing: str = "",
        published_content: str = "",
        interval: float = REFRESH_INTERVAL,
        now: Callable[[], float] = time.monotonic,
    ):
        self._steps = listing_digest, discover, content_digest, publish
        self.listing, self.content = published_listing, published_content
        self._interval, self._now = interval, now
        self._last: float | None = None
        self._lock = threading.Lock()

    def revalidate(self) -> bool:
        """True when a new snapshot was published."""
        with self._lock:
            now = self._now()
            if self._last is not None and now - self._last < self._interval:
                return False
            self._last = now
            listing_digest, discover, content_digest, publish = self._steps
            step = "list the content root"
            try:
                listing = listing_digest()
                if listing == self.listing:
                    return False
                step = "discover documents"
                found = discover()
                step = "digest contents"
                content = content_digest(found)
                if content == self.content:
                    self.listing = listing  # touched only
                    return False
                step = "publish"
                publish(found)
            except Exception as error:  # any failure keeps the published snapshot
                log.warning("Catalog refresh failed to %s, retrying next interval: %s", step, error)
                return False
            self.listing, self.content = listing, content
            return True
