"""URL filter: all rules at once as one bit-parallel wildcard automaton.

A rule is `host/path`. It fits a URL whose host is the rule's host or one of its
subdomains and whose path starts with the rule's path; of the rules that fit, the
longest decides. Each rule becomes two globs over ``host, separator, path``:
``host|path*`` and ``*.host|path*``, where the leading star does not cross the
separator. The globs are packed side by side into one row of bits over as many
64-bit words as needed, one bit per glob character. A step of the automaton
shifts the row by one, keeps the bits whose character is the one read, and lets
star bits stay. URLs of a batch step together, column by column; a URL leaves the
loop once it has only accepting bits or none.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and gets the default verdict, as does every URL that no rule fits. An
empty path is not ``/``. Ports and user names are part of the host as written.
Rules of equal length cannot both be longest on one URL unless they are the same
rule; a repeated rule must not carry two verdicts. Repeated rows are judged each, rows
without page_id too. Very long URLs are read to their end, or until every bit of theirs is
decided. No rules: the default verdict throughout. An empty table gives no rows. Only page_id
and url are read, so further columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands between host and path; a host ends before '/', '?' and '#', so it cannot hold one.
MARK = ord("#")
DEFAULT = "allow"


@dataclass(frozen=True)
class Automaton:
    """words x 256 masks, one bit per glob character, and the bits that begin, loop and accept."""

    masks: np.ndarray
    first: np.ndarray  # where globs start: no shift may carry into these from the glob before
    begin: np.ndarray  # what the first character may set; behind a star too, as a star may be empty
    loop: np.ndarray
    loop_masks: np.ndarray
    last: np.ndarray
    rule_of: np.ndarray  # the rule of each accepting bit
    bits: np.ndarray  # (word, bit) of each accepting bit


def compile_rules(rules: list[tuple[str, str]]) -> Automaton:
    """Pack the globs of `rules`, pairs of rule and verdict, into masks."""
    seen: dict[str, str] = {}
    for rule, verdict in rules:
        if "/" not in rule or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule with a path and a verdict: {rule!r} {verdict!r}")
        if seen.setdefault(rule, verdict) != verdict:
            raise ValueError(f"two verdicts for {rule!r}")
    globs = []
    for number, (rule, _) in enumerate(rules):
        host, slash, path = rule.partition("/")
        plain = host.lower().encode() + bytes([MARK]) + (slash + path).encode()
        globs += [(number, False, plain), (number, True, b"." + plain)]
    size = sum(len(g) + star for _, star, g in globs)
    words = max(1, -(-size // 64))
    masks = np.zeros((256, words), np.uint64)
    first, begin, loop, last = (np.zeros(words, np.uint64) for _ in range(4))
    loop_masks = np.zeros((256, words), np.uint64)
    at, ends, owners = 0, [], []

    def put(row: np.ndarray, position: int) -> None:
        row[position // 64] |= np.uint64(1 << (position % 64))

    for number, star, glob in globs:
        put(first, at)
        put(begin, at)
        if star:  # one bit that stays on any character of the host, then the rest of the glob
            put(loop, at)
            for char in range(256):
                if char != MARK:
                    put(loop_masks[char], at)
                    put(masks[char], at)
            at += 1
            put(begin, at)
        for char in glob:
            put(masks[char], at)
            at += 1
        put(last, at - 1)
        ends.append(divmod(at - 1, 64))
        owners.append(number)
    return Automaton(masks, first, begin, loop, loop_masks, last, np.array(owners, int), np.array(ends, int).reshape(-1, 2))


def longest_rule(auto: Automaton, lengths: np.ndarray, urls: list[bytes]) -> np.ndarray:
    """For each canonical URL the number of the longest rule that fits, or -1."""
    sizes = np.array([len(u) for u in urls], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(urls) else np.zeros(0, np.int64)
    chars = np.frombuffer(b"".join(urls), np.uint8)
    words = len(auto.begin)
    state = np.zeros((len(urls), words), np.uint64)
    accepted = np.zeros((len(urls), words), np.uint64)
    live = np.arange(len(urls))
    one, top = np.uint64(1), np.uint64(63)
    step = 0
    while True:
        live = live[sizes[live] > step]
        if not len(live):
            break
        read = chars[begins[live] + step]
        old = state[live]
        moved = old << one
        moved[:, 1:] |= old[:, :-1] >> top
        moved &= ~auto.first
        if step == 0:
            moved |= auto.begin
        new = (moved & auto.masks[read]) | (old & auto.loop_masks[read] & auto.loop)
        accepted[live] |= new & auto.last
        state[live] = new & ~auto.last
        live = live[(state[live] != 0).any(axis=1)]
        step += 1
    best = np.full(len(urls), -1)
    for (word, bit), rule in sorted(zip(map(tuple, auto.bits), auto.rule_of), key=lambda x: lengths[x[1]]):
        best[(accepted[:, word] >> np.uint64(bit)) & one != 0] = rule
    return best


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    _, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    for mark in (b"#", b"?"):
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url)."""
    auto = compile_rules(rules)
    lengths = np.array([len(rule) for rule, _ in rules], int)
    names = [rule for rule, _ in rules] + [None]
    verdicts = [verdict for _, verdict in rules] + [default]

    def run(batches):
        for batch in batches:
            parts = [split_url(v.as_buffer().to_pybytes()) if v.is_valid else (b"", b"") for v in batch["url"]]
            found = longest_rule(auto, lengths, [h + bytes([MARK]) + p for h, p in parts])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"],
                    pa.array([h.decode() for h, _ in parts], pa.string()),
                    pa.array([p.decode() for _, p in parts], pa.string()),
                    pa.array([names[k] for k in found], pa.string()),
                    pa.array([verdicts[k] for k in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return picked.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
