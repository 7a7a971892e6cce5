"""Which stored pages can be read, which are to be fetched again, and which of them a job has to take apart at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmill.functions import urls

EMPTY, THROTTLED, REDIRECTED, NO_ADDRESS = "empty page", "throttled", "redirected", "no address"
NOTHING_FOUND = "no title and no price"
#: Most page ids that are broadcast (16 bytes each).
BROADCAST_IDS = 2_000_000


def route_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, reason`` for every stored page; ``reason`` is NULL for a page that can be read.

    One pass with string tests only: no page is taken apart. ``url`` has the shop's own host in place of a regional
    one. A page without HTML is empty, one with the throttle sentence throttled; one that ended elsewhere than at the
    shop, or at its language switch, was redirected. The first reason that holds is given.
    """
    url, html = urls.rewrite_host(F.col("url")), F.col("html")
    reasons = {
        NO_ADDRESS: url.isNull(),
        EMPTY: html.isNull() | ~html.rlike(r"\S"),
        THROTTLED: urls.is_throttled(html),
        REDIRECTED: urls.is_redirected(url),
    }
    reason = F.coalesce(*(F.when(holds, F.lit(name)) for name, holds in reasons.items()))
    return pages.select("page_id", url.alias("url"), reason.alias("reason"))


def readable(routes: DataFrame) -> DataFrame:
    return routes.filter(F.col("reason").isNull()).select("page_id", "url")


def only_pages(pages: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The pages whose ``page_id`` is in ``ids``, a written table with each id once.

    Up to ``limit`` ids are broadcast to the scan, so HTML is read where it lies and pages that are not wanted go no
    further than their id. More ids than that meet the pages in an ordinary join, which moves the HTML of the wanted
    pages once (Spark drops the others before the shuffle by its run-time filter); pages bucketed by id do not move.
    """
    wanted = ids.select("page_id")
    few = wanted.limit(limit + 1).count() <= limit
    return pages.join(F.broadcast(wanted) if few else wanted, "page_id", "left_semi")
