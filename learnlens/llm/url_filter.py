"""Allow and block rules for URLs: a trie over reversed host labels, each with a trie over path segments.

The longest rule that fits a URL decides: more host labels first, then the longer path. A path rule fits every path that starts
with it, so its last segment may be the beginning of a longer one. The trie goes to every task; the number of its
rules is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"
#: Rules that are sent to every task, at most.
MOST_RULES = 1_000_000


@dataclass
class _Paths:
    """Rules below one path: whole segments lead on, and `ends` lists what the next segment may begin with, longest first."""

    below: dict[str, _Paths] = field(default_factory=dict)
    ends: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class _Hosts:
    below: dict[str, _Hosts] = field(default_factory=dict)
    paths: _Paths | None = None


class Trie:
    """Rules (verdict, host, path). Of two rules with the same host and path the block one holds."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        known: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"neither allow nor block: {verdict}")
            if known.get((host.lower(), path)) != BLOCK:
                known[host.lower(), path] = verdict
        if len(known) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.root = _Hosts()
        for (host, path), verdict in known.items():
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.below.setdefault(label, _Hosts())
            node.paths = node.paths or _Paths()
            at, (*whole, last) = node.paths, path.split("/")
            for segment in whole:
                at = at.below.setdefault(segment, _Paths())
            at.ends.append((last, host + path, verdict))
            at.ends.sort(key=lambda end: -len(end[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        node, best = self.root, None
        segments = path.split("/")
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.below.get(label)
                if node is None:
                    break
            if node.paths:
                best = self._longest(node.paths, segments) or best
        return best

    @staticmethod
    def _longest(paths: _Paths, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            end = next((end for end in paths.ends if segment.startswith(end[0])), None)
            if end:
                best = end[1:]
            paths = paths.below.get(segment)
            if paths is None:
                break
        return best


def parse_rule(text: str, verdict: str) -> tuple[str, str, str]:
    """A rule like `example.org/es/`: the host up to the first slash, the path from there."""
    host, slash, rest = text.partition("/")
    return verdict, host, slash + rest


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of `pages` (page_id, url; all else is ignored).

    The host reaches from the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; the path from there to `?`, `#` or the
    end. A null url or one without `://` has an empty host and path. Where no rule fits, rule is null and the verdict is `default`.
    Repeated rows are judged each; an empty table gives an empty result; without rules all get the default.
    """
    trie = Trie(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trie.find(h, p) or (None, default) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            rule, verdict = (pa.array([f[k] for f in found], type=pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    after = F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    parts = pages.select("page_id", url.alias("u")).select("page_id", after.alias("r"))
    host = F.regexp_extract("r", r"^[^/?#]*", 0)
    path = F.regexp_extract("r", r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kind = dict(pages.dtypes)["page_id"]
    return parts.select("page_id", lower.alias("host"), path.alias("path")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
