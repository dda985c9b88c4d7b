"""Lists of pages that come in responses, each with a token for the next one: a data source that begins at any token.

    spark.dataSource.register(Pages)
    spark.read.format("pages").option("path", ".../{token}.json").option("start", token).load()
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 500, 502, 503, 504)


def with_backoff(call: Callable[[], bytes], attempts: int = 5, wait: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> bytes:
    """call(), again while it fails for a reason that may pass: after 1, 2, 4... seconds and up to one more. The last failure is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt + 1 == attempts:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt + 1 == attempts:
                raise
        wait(2**attempt + draw())
    raise ValueError("no attempts")


def fetch(url: str, attempts: int = 5) -> dict:
    """A response, from the network or from a recorded file (file:)."""

    def get() -> bytes:
        with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
            return r.read()

    return json.loads(with_backoff(get, attempts))


class Response(InputPartition):
    def __init__(self, token: str):
        self.token = token


class PagesReader(DataSourceReader):
    """The planner follows tokens from `start`, `most` responses at most; tasks read the responses' pages."""

    def __init__(self, options: dict):
        self.pattern, self.start, self.most = options["path"], options.get("start", "first"), int(options.get("most", 1_000_000))

    def url(self, token: str) -> str:
        at = self.pattern.replace("{token}", urllib.request.quote(token, safe=""))
        return at if "://" in at or at.startswith("file:") else f"file://{at}"

    def partitions(self) -> list[Response]:
        out, token, seen = [], self.start, set()
        while token and token not in seen and len(out) < self.most:
            out.append(Response(token))
            seen.add(token)
            token = fetch(self.url(token)).get("continue", {}).get("apcontinue")
        return out

    def read(self, partition: Response) -> Iterator[tuple]:
        found = fetch(self.url(partition.token))
        following = found.get("continue", {}).get("apcontinue")
        for i, page in enumerate(found.get("query", {}).get("allpages", [])):
            yield partition.token, i, page["pageid"], page.get("title"), following


class Pages(DataSource):
    """token (of the response), pos (in it), pageid, title, following (the token behind, null at the end)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "token string, pos int, pageid long, title string, following string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


def resume_token(pages: DataFrame) -> str | None:
    """Where to go on behind these pages: the one token that no response of theirs has. None at the end."""
    following = pages.where("following is not null").select(F.col("following").alias("token")).distinct()
    left = following.join(pages.select("token").distinct(), "token", "left_anti").limit(2).collect()
    if len(left) > 1:
        raise ValueError("pages of several lists")
    return left[0].token if left else None
