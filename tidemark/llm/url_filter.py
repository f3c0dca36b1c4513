"""URL filter over a sorted digest array.

The rule strings (host + path prefix) are hashed to 64-bit xxhash keys, sorted, and kept
with the strings in flat files that Spark ships to each executor (``addFile``), where every
worker memory-maps them. The array also holds the rules' hosts, each with the lengths of its path
prefixes. A batch of urls is probed twice, each time with one vectorised binary search of all
digests: the host suffixes of a length that some rule's host has, and then, for the hosts found,
the path prefixes of their lengths. A hit counts only if the stored string equals the candidate,
so digest collisions cannot produce a verdict. Memory is linear in the urls, however long.

Defined results: a null url, or one without ``://``, has empty host and path and matches
nothing; an empty rule list gives every url the default verdict; repeated urls and repeated
ids keep one row each; an empty table gives an empty result; other columns of the input are
ignored, whatever their names. Two rules of equal length that both fit: the longer host wins.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: Bound of the shipped index; a longer rule list is refused rather than broadcast.
MAX_INDEX_BYTES = 512 << 20

#: The rules of the query's contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def write_index(rules: Iterable[tuple[str, str]], folder: str) -> dict[str, str]:
    """Writes keys, string ends, strings and values, sorted by digest: of the rules their verdicts,
    of their hosts (strings without a slash) the lengths of their paths."""
    entries, paths = dict(rules), defaultdict(set)
    for rule in entries:
        if "/" not in rule:
            raise ValueError(f"rule without a path: {rule}")
        host, _, path = rule.partition("/")
        paths[host].add(len(path) + 1)
    entries |= {host: ",".join(map(str, sorted(n, reverse=True))) for host, n in paths.items()}
    rows = sorted((xxhash.xxh64_intdigest(r), r.encode(), v.encode()) for r, v in entries.items())
    if sum(16 + len(r) + len(v) for _, r, v in rows) > MAX_INDEX_BYTES:
        raise ValueError(f"the rules exceed {MAX_INDEX_BYTES} bytes")
    tag = uuid.uuid4().hex
    parts = {
        "keys": np.array([k for k, _, _ in rows], "<u8"),
        "ends": np.cumsum([0] + [len(x) for _, r, v in rows for x in (r, v)]).astype("<u8"),
        "text": np.frombuffer(b"".join(r + v for _, r, v in rows), "u1"),
    }
    names = {}
    for part, values in parts.items():
        names[part] = f"{tag}-{part}.bin"
        with open(os.path.join(folder, names[part]), "wb") as f:
            f.write(values.tobytes() or b"\0" * 8)
    return names | {"rules": str(len(rows)), "hosts": ",".join(map(str, sorted({len(h) for h in paths})))}


class DigestArray:
    """The memory-mapped index on one executor."""

    def __init__(self, find, names: dict[str, str]):
        n = int(names["rules"])
        self.keys = np.memmap(find(names["keys"]), "<u8", "r")[:n]
        self.ends = np.memmap(find(names["ends"]), "<u8", "r")[: 2 * n + 1]
        self.text = np.memmap(find(names["text"]), "u1", "r")
        self.host_lengths = [int(x) for x in names["hosts"].split(",") if x][::-1]  # longest first

    def _string(self, k: int) -> str:
        return self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes().decode()

    def rule(self, i: int) -> str:
        return self._string(2 * i)

    def verdict(self, i: int) -> str:
        return self._string(2 * i + 1)

    def hosts(self, host: str) -> list[str]:
        """The host and its suffixes at label borders that have the length of a rule's host, longest first."""
        n = len(host)
        return [host[n - k :] for k in self.host_lengths if k == n or k < n and host[n - k - 1] == "."]

    def find(self, texts: list[str]) -> list[int]:
        """The entry of each string, or -1: one binary search, then the stored strings are compared."""
        if not texts or not len(self.keys):
            return [-1] * len(texts)
        digests = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
        low, high = (np.searchsorted(self.keys, digests, side) for side in ("left", "right"))
        out = [-1] * len(texts)
        for k in np.flatnonzero(low < high):
            out[k] = next((i for i in range(low[k], high[k]) if self.rule(i) == texts[k]), -1)
        return out

    def probe(self, hosts: list[str], paths: list[str]) -> list[int]:
        """For each url the index of the rule that decides, or -1."""
        rows, names = [], []
        for i, host in enumerate(hosts):
            if host:
                more = self.hosts(host)
                names += more
                rows += [i] * len(more)
        urls, texts = [], []
        for i, name, entry in zip(rows, names, self.find(names), strict=True):
            if entry >= 0:
                more = [name + paths[i][:n] for n in map(int, self.verdict(entry).split(",")) if n <= len(paths[i])]
                urls += [i] * len(more)
                texts += more
        best, size = [-1] * len(hosts), [0] * len(hosts)
        for i, text, entry in zip(urls, texts, self.find(texts), strict=True):
            if entry >= 0 and len(text) > size[i]:  # of equal length, the longer host comes first
                best[i], size[i] = entry, len(text)
        return best


def split_url(url) -> tuple:
    """Columns host and path of a url column, as the contract words them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule (or null) and verdict."""
    spark = pages.sparkSession
    folder = tempfile.mkdtemp(prefix="url-rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    names = write_index(rules, folder)
    for part in ("keys", "ends", "text"):
        spark.sparkContext.addFile(os.path.join(folder, names[part]))
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def run(batches):
        index = DigestArray(SparkFiles.get, names)
        for b in batches:
            hits = index.probe(b["host"].to_pylist(), b["path"].to_pylist())
            rules_, verdicts = [None if i < 0 else index.rule(i) for i in hits], [default if i < 0 else index.verdict(i) for i in hits]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())], [*b.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, f"{id_col} {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


OP1_SQL = r"""
WITH r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM r),
cut AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT page_id, host, path, max_by(rule, length(rule) * 1000 + length(h)) AS rule, max_by(verdict, length(rule) * 1000 + length(h)) AS verdict
        FROM u JOIN rules ON (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)
"""
