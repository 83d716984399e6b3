"""URL filters by a bit-parallel wildcard automaton.

Each rule is a glob over the canonical URL ``.host/path?query``: ``*`` stands for any run of bytes but ``/`` and
``?``, ``**`` for any run, ``[a-z0-9]`` for one ASCII character, all else for itself; a rule must fit the whole URL.

All rules are packed side by side into multiword Shift-And masks, one bit for each place in each rule.  For
every byte of a URL all places of all rules move at once: ``D = (D << 1) & fits[byte] | D & stays[byte]``, with the
carry between words.  A batch of URLs moves in step, one column of bytes at a time, so a step is a few
vector operations over (word, URL); the few that are longer than the rest, or than ``STEPS`` bytes, are finished
with Python's long integers.

``Site(host, path, verdict)`` is a rule for a host, its subdomains and the paths that start with ``path``: the
glob ``*.host`` + path + ``**``.  Of the site rules that fit the longest decides, of equal ones the longer host, then block;
where none fits, the longest of the other globs decides; where none fits either, the URL is allowed.

Nothing is shuffled: a host that holds a third of all rows weighs on no task.  The masks travel to the
workers; they take rules x 8 bytes x 257 at most for each 64 places, and ``compiled`` refuses more than ``MASK_BYTES`` of them.
Rows are scanned in blocks of words and URLs, so a task's memory does not grow with either.

Definitions for odd input: a NULL URL, and one without ``://``, has an empty host and path, and no rule fits it; an
empty host or path fits only rules that allow it; very long URLs are read whole; rows are judged one by one, so
repeated rows get repeated verdicts; an empty table gives an empty table.  Only the named columns are read
and they travel under numbers, so extra columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import ascii_lower, slices, table

MASK_BYTES = 32 << 20
BLOCK_CELLS = 1 << 17  # (word, URL) pairs that move in step
STEPS = 2048  # bytes of a URL read in step
FEW = 24  # so few URLs go faster one by one
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A glob, its verdict, the name it is reported by, and how it ranks among those that fit."""

    glob: str
    verdict: str
    name: str | None = None
    rank: tuple = ()


def site(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and the paths that start with ``path``."""
    host = ascii_lower(host)
    quoted = re.sub(r"([*\[])", r"[\1]", f".{host}{path}")
    return Rule(f"*{quoted}**", verdict, host + path, (1, len(host + path), len(host), verdict == "block"))


def glob(pattern: str, verdict: str) -> Rule:
    return Rule(pattern, verdict, None, (0, len(pattern), 0, verdict == "block"))


def places_of(pattern: str) -> tuple[list[frozenset[int]], list[str]]:
    """The byte sets of a glob, and the stars (``""``, ``*`` or ``**``) before each and at the end."""
    sets, stars = [], [""]
    for part in re.findall(r"\*+|\[[^\]]*\]|[^*]", pattern, re.DOTALL):
        if part[0] == "*":
            stars[-1] = max(stars[-1], part[:2])
            continue
        if part[0] == "[" and len(part) > 2:
            if not part.isascii():
                raise ValueError(f"only ASCII characters in brackets: {part}")
            spans = re.findall(r"(.)-(.)|(.)", part[1:-1], re.DOTALL)
            options = [frozenset(b for a, z, c in spans for b in range(ord(a or c), ord(z or c) + 1))]
        else:
            options = [frozenset([b]) for b in part.encode()]
        for option in options:
            sets.append(option)
            stars.append("")
    return sets, stars


class Automaton:
    """The packed masks of all rules, best rule first."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: r.rank, reverse=True)
        parts = [places_of(r.glob) for r in self.rules]
        bits = sum(len(sets) + 1 for sets, _ in parts)
        self.words = max(1, -(-bits // 64))
        if self.words * 8 * 257 * 2 > MASK_BYTES:
            raise ValueError(f"{bits} places need more than {MASK_BYTES} bytes of masks; split the rules")
        fits, stays, start = [0] * 256, [0] * 256, 0
        self.ends: list[int] = []
        at = 0
        for sets, stars in parts:
            start |= 1 << at
            for i, star in enumerate(stars):
                if i:
                    for b in sets[i - 1]:
                        fits[b] |= 1 << at + i
                for b in range(256) if star else ():
                    if star == "**" or b not in b"/?":
                        stays[b] |= 1 << at + i
            at += len(sets) + 1
            self.ends.append(at - 1)
        self.long = (fits, stays, start)
        self.fits, self.stays = self._packed(fits), self._packed(stays)
        self.start = self._packed([start])[:, 0]

    def _packed(self, masks: list[int]) -> np.ndarray:
        """(word, byte) of 64-bit masks."""
        data = b"".join(m.to_bytes(self.words * 8, "little") for m in masks)
        return np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(len(masks), self.words).T)

    def one(self, url: bytes, state: int | None = None) -> int:
        """The places reached after the whole of ``url``, as one long integer."""
        fits, stays, start = self.long
        d = start if state is None else state
        for b in url:
            d = (d << 1) & fits[b] | d & stays[b]
            if not d:
                break
        return d

    def many(self, urls: list[bytes]) -> np.ndarray:
        """For each URL the number of the best rule that fits it, or -1."""
        best = np.full(len(urls), -1)
        width = max(FEW, BLOCK_CELLS // self.words)
        for low in range(0, len(urls), width):
            self._block(urls[low : low + width], best[low : low + width])
        return best

    def _block(self, urls: list[bytes], best: np.ndarray) -> None:
        order = np.array(sorted(range(len(urls)), key=lambda i: -len(urls[i])), np.int64)
        sizes = np.array([len(urls[i]) for i in order])
        steps = min(STEPS, int(sizes[min(FEW, len(sizes)) - 1]))
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # URLs longer than each step
        grid = np.zeros((len(urls), steps), np.uint8)
        for k, i in enumerate(order):
            head = urls[i][:steps]
            grid[k, : len(head)] = np.frombuffer(head, np.uint8)
        grid = np.ascontiguousarray(grid.T)
        state = np.repeat(self.start[:, None], len(urls), axis=1)
        one, high = np.uint64(1), np.uint64(63)
        for p in range(steps):
            n = int(active[p])
            byte, d = grid[p, :n], state[:, :n]
            moved = d << one
            moved[1:] |= d[:-1] >> high
            state[:, :n] = moved & self.fits[:, byte] | d & self.stays[:, byte]
        for k in range(int(np.searchsorted(-sizes, -steps, side="left"))):  # the few that go on
            sofar = int.from_bytes(np.ascontiguousarray(state[:, k]).astype("<u8").tobytes(), "little")
            whole = self.one(urls[order[k]][steps:], sofar)
            state[:, k] = np.frombuffer(whole.to_bytes(self.words * 8, "little"), "<u8")
        found = np.full(len(urls), -1)
        for number in range(len(self.rules) - 1, -1, -1):  # better ones overwrite
            word, bit = divmod(self.ends[number], 64)
            found[(state[word] >> np.uint64(bit)) & one == 1] = number
        best[order] = found


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """``.host/path?query``; NULL where the URL has no host part."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("."), host_of(url), rest))


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule`` (of a site rule, else NULL), ``glob`` (the one that decided) and ``verdict``."""
    value = F.col(f"`{url}`").cast("string")
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(
        *(F.col(f"`{n}`").alias(k) for n, k in zip(keep, names, strict=True)),
        host_of(value).alias("host"), path_of(value).alias("path"), canonical(value).alias("whole"),
    )
    auto = Automaton(rules)
    texts = ("rule", "glob", "verdict")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = [*((r.name, r.glob, r.verdict) for r in auto.rules), (None, None, "allow")]
        columns = [pa.array(c, pa.string()) for c in zip(*answers, strict=True)]
        for piece in slices(batches, "whole"):
            whole = piece.column("whole")
            distinct = whole.dictionary_encode()
            best = auto.many([u.encode() for u in distinct.dictionary.to_pylist()])
            at = pa.compute.take(pa.array(np.where(best < 0, len(auto.rules), best)), distinct.indices)
            at = pa.compute.fill_null(at, len(auto.rules))
            kept = [piece.column(i) for i in range(len(keep) + 2)]
            yield pa.RecordBatch.from_arrays([*kept, *(c.take(at) for c in columns)], [*names, "host", "path", *texts])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, types + "rule string, glob string, verdict string").toDF(*keep, "host", "path", *texts)


SITES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: What is left to the method: advertising and tracking hosts, spam, sessions and searches, and files that hold no text.
BLOCKED = (
    "*.ads[-.]*.*/**", "*.ad[sx][0-9].*/**", "*.track[-.]*.*/**", "*[-.]track.*/**", "*.doubleclick.*/**", "*.spam[-.]*.*/**",
    "*.cheap-pills.*/**", "*.casino[-.]*.*/**", "**/wp-login*", "**/wp-admin/**", "**/cgi-bin/**", "**/cart/**", "**/login",
    "**[?&]sessionid=**", "**[?&]phpsessid=**", "**/search[?]q=**",
    *(f"**.{kind}" for kind in ("jpg", "jpeg", "png", "gif", "ico", "css", "js", "mp3", "mp4", "zip", "gz", "exe")),
)
RULES = (*(site(*s) for s in SITES), *(glob(g, "block") for g in BLOCKED))


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def regex_of(pattern: str) -> str:
    """A glob as a regular expression; for SQL and tests."""
    kinds = {"*": "[^/?]*", "**": ".*"}
    parts = re.findall(r"\*+|\[[^\]]+\]|[^*]", pattern, re.DOTALL)
    return "^" + "".join(kinds[p[:2]] if p[0] == "*" else p.replace("[*]", r"\*").replace("[[]", r"\[") if len(p) > 2 else re.escape(p) for p in parts) + "$"


_FITS = " ".join(
    f"when regexp_matches(host, '(^|\\.){re.escape(h)}$') and starts_with(path, '{p}') then '{h}{p}'"
    for h, p, _ in sorted(SITES, key=lambda s: -len(s[0] + s[1]))
)
_SITES = " ".join(f"when '{h}{p}' then '{v}'" for h, p, v in SITES)
_GLOBS = "|".join(regex_of(g) for g in BLOCKED)

ORACLE = f"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^#]*)', 1, 's') as rest, contains(coalesce(url, ''), '://') as whole
  from pages
), ruled as (
  select *, case {_FITS} end as rule from parts
)
select page_id, host, path, rule, case rule {_SITES} else
  case when whole and regexp_matches('.' || host || rest, '{_GLOBS}', 's') then 'block' else 'allow' end end as verdict
from ruled
"""
