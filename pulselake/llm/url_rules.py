"""URL filters: glob rules simulated by one bit-parallel Shift-And automaton.

All patterns stand side by side in the bits of a few 64-bit words. Reading a byte shifts the
states, ANDs the byte's mask and keeps the states that a wildcard loops on; patterns that ended
in a final state matched. A batch of URLs advances together, one byte position at a time.

The canonical URL is ``.host/path``: the host is lower-cased, ``/`` separates it from the path
(itself empty or beginning with ``/``). A rule (host, path) becomes the glob ``[^/]*.host/path*``;
a free glob of the method is matched within the host (``*`` stands for any run of non-slashes).

Cases: a null URL or one without ``://`` has an empty host and path and is allowed; of rules of
equal length a block wins; repeated rows are judged alike; lengths are not limited (very long
URLs are processed in small groups); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import map_batches, utf8
from pulselake.session import read_table

#: Fixed values: (host, path prefix, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The method's own globs over the host, for URLs that no rule fits; they block.
HOST_GLOBS = ["*spam-farm*", "*cheap-pills*", "*casino*", "*free-download*"]
#: Bytes of one group of URLs, padded to its longest.
GROUP_BYTES = 8_000_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """(host, path) of a URL."""
    _, mark, rest = (url or b"").partition(b"://")
    if not mark:
        return b"", b""
    end = min((k for k in map(rest.find, (b"/", b"?", b"#")) if k >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    return host, rest[: min((k for k in map(rest.find, (b"?", b"#")) if k >= 0), default=len(rest))]


class Automaton:
    """Patterns as token lists: a byte, or a wildcard given by the set of bytes it may run over."""

    def __init__(self, patterns: list[list[int | frozenset]]):
        loops_at: list[tuple[int, frozenset]] = []
        self.first, self.final, bits = [], [], 0
        steps: list[tuple[int, int]] = []
        for tokens in patterns:
            # bit 0 of a pattern is its start; each literal adds a bit, a wildcard loops on the bit before it
            at = bits
            self.first.append(at)
            for token in tokens:
                if isinstance(token, frozenset):
                    loops_at.append((at, token))
                else:
                    at += 1
                    steps.append((at, token))
            self.final.append(at)
            bits = at + 1
        self.words = -(-bits // 64)
        one = lambda k: (k // 64, np.uint64(1) << np.uint64(k % 64))
        self.step, self.loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for at, byte in steps:
            self.step[byte, one(at)[0]] |= one(at)[1]
        for at, of in loops_at:
            for byte in of:
                self.loop[byte, one(at)[0]] |= one(at)[1]
        self.start = np.zeros(self.words, np.uint64)
        for at in self.first:
            self.start[one(at)[0]] |= one(at)[1]

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Whether each pattern matches each text as a whole: (texts, patterns)."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = np.argsort([len(t) for t in texts], kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * (len(texts[order[hi]]) + 1) <= GROUP_BYTES:
                hi += 1
            out[order[lo:hi]] = self._run([texts[k] for k in order[lo:hi]])
            lo = hi
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        """texts by rising length: the rows that have ended are always at the front."""
        lengths = np.array([len(t) for t in texts])
        width = int(lengths[-1])
        grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
        state = np.tile(self.start, (len(texts), 1))
        for k in range(width):
            live = int(np.searchsorted(lengths, k, "right"))
            s, byte = state[live:], grid[live:, k]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[live:] = (moved & self.step[byte]) | (s & self.loop[byte])
        at = np.array(self.final)
        return (state[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) > 0


_ANY, _LABEL = frozenset(range(256)), frozenset(set(range(256)) - {0x2F})


def compile_rules(rules=RULES, host_globs=HOST_GLOBS) -> Automaton:
    """One automaton for the rules, then the host globs."""
    ruled = [[_LABEL, *f".{host}/{path}".encode(), _ANY] for host, path, _ in rules]
    globs = [[0x2E, *(_LABEL if b == 0x2A else b for b in glob.encode()), 0x2F, _ANY] for glob in host_globs]
    return Automaton(ruled + globs)


def judge(pages: DataFrame, rules=RULES, host_globs=HOST_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages."""
    automaton = compile_rules(rules, host_globs)
    names = [host + path for host, path, _ in rules]
    rank = sorted(range(len(rules)), key=lambda k: (-len(names[k]), rules[k][2] != "block"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [split_url(u) for u in utf8(batch, "url")]
        hit = automaton.match([b"." + h + b"/" + p for h, p in parts])
        rule = np.full(len(parts), -1)
        for k in reversed(rank):
            rule[hit[:, k]] = k
        globbed = hit[:, len(rules) :].any(axis=1)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                pa.array([h.decode() for h, _ in parts], pa.string()),
                pa.array([p.decode() for _, p in parts], pa.string()),
                pa.array([names[k] if k >= 0 else None for k in rule], pa.string()),
                pa.array([rules[k][2] if k >= 0 else "block" if g else "allow" for k, g in zip(rule, globbed)], pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    return map_batches(pages.select("page_id", F.col("url").cast("string").alias("url")), run, "page_id long, host string, path string, rule string, verdict string")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(read_table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, rv)),
m AS (SELECT page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM c LEFT JOIN r ON ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp))
SELECT page_id, host, path, rule,
       coalesce(rv, CASE WHEN host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%' OR host LIKE '%casino%' OR host LIKE '%free-download%' THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1
"""
