"""URL filter: ordered host/path rules over a Bloom filter cascade.

A cascade answers membership exactly for every key of a known universe
without a join: level 1 is a Bloom filter of the listed keys, level 2 one of
the unlisted keys of the universe that level 1 lets through, level 3 one of
the listed keys that level 2 lets through, and so on until a level lets
nothing wrong through. The levels are bit tables held as binary literals of
the plan, so a page is judged by a projection: no join, no shuffle.

The filters are bounded: ``bits_per_key`` bits a key, at most
``max_filter_bytes`` in all, else ``build`` raises and the listed keys have
to be sharded over several cascades. The universe is never held in one
place; only its distinct keys are stored under the shared checkpoint folder.

Nulls: a null url, or one without "://", has an empty host and path; a null
key is in no list. Repeated rows and extra columns pass through unchanged.
Empty universe or list: the cascade has no levels and lists nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.llm.tables import ascii_lower, stored

HASHES = 4


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits this host and its subdomains
    path: str  # fits paths that start with it

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Cascade:
    """Bit tables of the levels; odd levels hold listed keys, even ones false positives."""

    levels: list[bytes] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        # Deepest first: passing all levels means the kind of the last one.
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(_in_filter(key, self.levels[i], i), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(out, F.lit(False)) if self.levels else F.lit(False)


def _positions(key: Column, bits: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(bits)) for j in range(HASHES)]


def _in_filter(key: Column, table: bytes, level: int) -> Column:
    lit, out = F.lit(bytearray(table)), F.lit(True)
    for pos in _positions(key, len(table) * 8, level):
        byte = F.conv(F.hex(F.substring(lit, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(byte, (7 - pos % 8).cast("int")) == 1)
    return out


def _filter_of(keys: DataFrame, n: int, level: int, bits_per_key: int) -> bytes:
    bits = max(64, -(-n * bits_per_key // 8) * 8)
    hit = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, level))).alias("pos"))
    octet = F.call_function("shiftleft", F.lit(1), (7 - F.col("pos") % 8).cast("int"))
    rows = hit.groupBy((F.floor(F.col("pos") / 8)).alias("at")).agg(F.bit_or(octet).alias("octet"))
    table = bytearray(bits // 8)
    for r in rows.toLocalIterator():  # at most bits / 8 rows, bounded by max_filter_bytes
        table[r["at"]] = r["octet"]
    return bytes(table)


def build(universe: DataFrame, listed: Column, bits_per_key: int = 10, max_filter_bytes: int = 16 << 20, max_levels: int = 40) -> Cascade:
    """Cascade of the keys of ``universe`` (column ``key``) for which ``listed`` holds."""
    keys = universe.select("key").where(F.col("key").isNotNull()).distinct()
    keys = stored(keys.select("key", F.coalesce(listed, F.lit(False)).alias("listed")), "cascade-universe")
    cascade, wrong = Cascade(), keys.where("listed")
    for level in range(max_levels):
        n = wrong.count()
        if n == 0:
            return cascade
        if sum(map(len, cascade.levels)) + n * bits_per_key // 8 > max_filter_bytes:
            raise ValueError(f"{n} keys at level {level + 1} need more than {max_filter_bytes} bytes; shard the list")
        cascade.levels.append(_filter_of(wrong, n, level, bits_per_key))
        # keys of the other kind that all levels so far let through
        through = keys.where("listed" if level % 2 else "NOT listed")
        for i, bits in enumerate(cascade.levels):
            through = through.where(_in_filter(F.col("key"), bits, i))
        wrong = through
    raise ValueError(f"false positives remain after {max_levels} levels")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host in lower case up to the first of / ? #, path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, nulls where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, rules: list[Rule], cascade: Cascade) -> DataFrame:
    """Pages with host, path, rule and verdict: the rule's, else block for listed hosts."""
    host, path = split_url(F.col("url"))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(cascade.contains(F.col("host")), "block").otherwise("allow")
    return out.withColumns({"rule": text, "verdict": F.coalesce(verdict, by_list)})
