"""A MediaWiki category as a DataFrame source: spark.read.format("mediawiki").

Options: api (address of api.php), category, or replay (a folder of recorded
JSON answers, read instead of the network), delay (seconds between requests).
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[dict], dict]
DELAY = 0.15
SCHEMA = "seq long, page_id long, title string, text string, html string, error string"

# The requests of the MediaWiki web API.
LISTING = {"action": "query", "format": "json", "list": "categorymembers", "cmtype": "page", "cmnamespace": "0", "cmlimit": "500"}
EXTRACT = {"action": "query", "format": "json", "prop": "extracts", "explaintext": "1", "exsectionformat": "plain", "redirects": "1"}
MARKUP = {"action": "parse", "format": "json", "prop": "text", "redirects": "1"}


def http_fetch(api: str, delay: float = DELAY) -> Fetch:
    def fetch(params: dict) -> dict:
        request = urllib.request.Request(f"{api}?{urllib.parse.urlencode(params)}", headers={"User-Agent": "lexaloom/1.0"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            out = json.load(answer)
        time.sleep(delay)
        return out

    return fetch


def recording_name(params: dict) -> str:
    return hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest() + ".json"


def replay_fetch(folder: str) -> Fetch:
    def fetch(params: dict) -> dict:
        with open(os.path.join(folder, recording_name(params)), encoding="utf-8") as file:
            return json.load(file)

    return fetch


def category_members(fetch: Fetch, category: str) -> Iterator[tuple[int, str]]:
    """(page id, title) of all articles of a category, over as many answers as it takes."""
    more: dict = {}
    while True:
        answer = fetch({**LISTING, "cmtitle": category, **more})
        for member in answer.get("query", {}).get("categorymembers", []):
            yield member["pageid"], member["title"]
        mark = answer.get("continue", {}).get("cmcontinue")
        if mark is None:
            return
        more = {"cmcontinue": mark}


def page_text(fetch: Fetch, page_id: int) -> str:
    pages = fetch({**EXTRACT, "pageids": str(page_id)}).get("query", {}).get("pages", {})
    return pages.get(str(page_id), {}).get("extract") or ""


def page_html(fetch: Fetch, page_id: int) -> str:
    markup = fetch({**MARKUP, "pageid": str(page_id)}).get("parse", {}).get("text") or {}
    return markup.get("*") or ""


class _Pages(InputPartition):
    def __init__(self, members: list[tuple[int, int, str]]) -> None:
        super().__init__(members[0][0] if members else 0)
        self.members = members


class WikiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def _fetch(self) -> Fetch:
        if "replay" in self.options:
            return replay_fetch(self.options["replay"])
        return http_fetch(self.options["api"], float(self.options.get("delay", DELAY)))

    def partitions(self) -> list[InputPartition]:
        """The listing, cut into runs of pages that tasks fetch side by side."""
        size = int(self.options.get("pagesperpartition", 500))
        members = [(i, page, title) for i, (page, title) in enumerate(category_members(self._fetch(), self.options["category"]))]
        return [_Pages(members[i : i + size]) for i in range(0, len(members), size)] or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        """A page whose text or markup can't be had has an error and no html."""
        fetch = self._fetch()
        for seq, page, title in partition.members:
            text = None
            try:
                text = page_text(fetch, page)
                yield seq, page, title, text, page_html(fetch, page), None
            except Exception as error:  # noqa: BLE001  recorded in the row
                yield seq, page, title, text or "", None, str(error)


class WikiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mediawiki"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WikiReader:
        return WikiReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WikiSource)
