"""URL rules by a sort-merge range join.

The canonical key of a url is its host's labels reversed, each followed by a dot (which no label holds), then a
separator and the path, so the urls of a host and its subdomains are one interval of keys that begins at the rule's key. Urls are dealt to key
ranges, whose borders come from a bounded sample of keys and only decide where rows go; a rule goes to every range
that its interval meets. Each range is sorted and swept once with a stack of the active nested rule hosts; of the
fitting rules the longest (host and path) wins, then the one with the longer host, then the smaller text.

Urls and page_ids are compared together at the borders, so equal urls of a hot host are split too. Defined results:
NULL urls and urls without ``://`` have an empty host and path and match no rule; a NULL page_id is passed on; hosts may
hold any characters; repeated rows stay; an empty table
gives an empty result; an empty rule table leaves every url to the default; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.sampling import hash_sample
from gleaner.workspace import shuffle_width

#: Below every character of a host label.
END = "\x00"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UP, _LOW)


def split_url(url: str | None) -> tuple[str, str]:
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest, cut, _ = rest.partition(mark)
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def host_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


def key_after(key: str) -> str:
    """The smallest key above all that begin with a host's key: the closing dot gives way to the next character."""
    return key[:-1] + "/"


class _Rules:
    """The rules of one host, found by path prefix: one probe for each distinct path length."""

    def __init__(self):
        self.by_path: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def put(self, path: str, rule: str, verdict: str):
        if path not in self.by_path or (rule, verdict) < self.by_path[path]:
            self.by_path[path] = (rule, verdict)
        self.sizes = sorted({len(p) for p in self.by_path}, reverse=True)

    def best(self, path: str):
        for n in self.sizes:
            if n <= len(path) and (hit := self.by_path.get(path[:n])):
                return n, hit
        return None


def sweep(rows: Iterable[tuple], default: str):
    """rows: (part, key, kind, page_id, host, path, rule, verdict) sorted by part, key, kind; kind 0 is a rule."""
    part, stack = None, []
    for p, key, kind, page_id, host, path, rule, verdict in rows:
        if p != part:
            part, stack = p, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key:
                stack.append((key, len(host), _Rules()))
            stack[-1][2].put(path, rule, verdict)
            continue
        best = None
        for _, size, rules in stack:
            if (hit := rules.best(path)) and (best is None or (size + hit[0], size) > best[0]):
                best = ((size + hit[0], size), hit[1])
        yield page_id, host, path, best[1][0] if best else None, best[1][1] if best else default


_ROW = "part int, key string, kind int, page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. ``rules``: host, path (with its leading slash), verdict."""
    spark = pages.sparkSession
    n = shuffle_width(spark)
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    some = hash_sample(urls, ["page_id", "url"], 20 * n).collect()
    keys = sorted((host_key(h) + END + p, r.page_id or 0) for r in some for h, p in [split_url(r.url)])
    borders = [keys[i * len(keys) // n] for i in range(1, n)] if keys else []

    def page_rows(batches):
        for b in batches:
            out = []
            for page_id, url in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                key = host_key(host) + END + path
                out.append((bisect_left(borders, (key, page_id or 0)), key, 1, page_id, host, path, None, None))
            yield _batch(out)

    def rule_rows(batches):
        for b in batches:
            out = []
            for host, path, verdict in zip(*(b.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True):
                host, path = (host or "").translate(_FOLD), path or ""
                key = host_key(host)
                first, last = bisect_left(borders, (key, -(2**63))), bisect_left(borders, (key_after(key), -(2**63)))
                out += [(p, key, 0, None, host, path, host + path, verdict) for p in range(max(0, first - 1), last + 1)]
            yield _batch(out)

    def swept(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        held = []
        for x in sweep(rows(), default):
            held.append(x)
            if len(held) == 10_000:
                yield _result(held)
                held = []
        if held:
            yield _result(held)

    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["part", "key", "kind", "page_id", "host", "path", "rule", "verdict"]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def _result(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[3:])], names[3:])

    given = rules.select(*(F.col(c).cast("string") for c in ("host", "path", "verdict"))).filter("host is not null and verdict is not null")
    both = urls.mapInArrow(page_rows, _ROW).unionByName(given.mapInArrow(rule_rows, _ROW))
    dealt = both.repartition(n, "part").sortWithinPartitions("part", "key", "kind")
    return dealt.mapInArrow(swept, "page_id long, host string, path string, rule string, verdict string")
