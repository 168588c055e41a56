"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times. The
whole part of that rate is given to all; the fractional parts are rounded by
the pivotal method: two units meet, one hands random mass to the other until
one of them is 0 or 1, and the other meets the next. So the number of copies
of a source is kept to within one, and every document keeps its probability.

Copies are kept, words are not: a large document that is taken or left moves
its source by more than small ones bring back by chance. So sources are
rounded in tiers, the largest documents first, and each tier's rates are
raised or lowered by the words that the tiers before it took too few or too
many of. The smallest documents absorb what is left, and a rate stays between
0 and ``most``; the expected change is 0, so (but for that bound) a document
keeps its probability.

The meetings form a reduction tree over Spark: units are dealt into small
groups of one source and like size, a group is rounded by one fold over its
members from the largest to the smallest, and at most one unit of each group stays
fractional and goes up to the next level, until a source has one left. A
level shuffles only (source, unit, size, mass); texts stay where they are.
Groups have ``fan_in`` members on average whatever the size of a source, so
a hot source is many groups, not one.

Randomness is a hash of the units that meet and the seed: reruns agree.

Defined cases: a null text has size 0 and counts as a document; sources sort
by code point with null last; a source without words has target 0 and takes
nothing; equal rows (doc_id, source and size) are one unit with that many
copies, spread evenly over the rows; empty input gives an empty result.
Other columns pass through ``mix`` unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerlake.llm.tables import stored

WORD = r"[^\x20\x09-\x0D]+"
UNIT = "struct<id:bigint,source:string,size:bigint,m:bigint>"


def text_size(text: Column) -> Column:
    """Number of words of a text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's
    size and the excess is reshared by weight among the others until none is
    above. That fixed point is a water level: sources sorted by size per
    weight are capped as long as the level of the rest exceeds their cap.
    The windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    order = [F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    # level if all sources before this one are capped and this one is not
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most)
    per = per.withColumn("level", left / F.sum("w").over(rest))
    over = F.col("level") * F.col("w") > F.col("source_size") * F.lit(most)
    # the first source that its level does not overfill sets the level of all
    per = per.withColumn("water", F.min(F.when(~over, F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything))
    target = F.least(F.col("water.level") * F.col("w"), F.col("source_size") * F.lit(most))
    return per.select("source", "source_size", F.coalesce(target, F.col("source_size") * F.lit(most)).cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int, level: Column) -> Column:
    """Pivotal rounding of a group: (decided units with 0 or 1, the unit still fractional)."""
    kind = f"struct<unit:{UNIT},p:double>"
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    eps = 1e-9

    def put(unit, p):
        return F.struct(unit.alias("unit"), p.cast("double").alias("p"))

    def meet(acc, x):
        a, q = acc["open"], acc["open"]["p"]
        p = x["p"]
        total = q + p
        u = _uniform(a["unit"]["id"], x["unit"]["id"], a["unit"]["size"], x["unit"]["size"], level, F.lit(seed))
        # below one: one unit takes both masses, the other ends at 0
        first_takes = u < q / total
        low = F.struct(put(F.when(first_takes, a["unit"]).otherwise(x["unit"]), total).alias("open"), put(F.when(first_takes, x["unit"]).otherwise(a["unit"]), F.lit(0.0)).alias("done"))
        # one or more: one unit fills up to 1, the other keeps the rest
        first_fills = u < (1 - p) / F.greatest(2 - total, F.lit(eps))
        high = F.struct(put(F.when(first_fills, x["unit"]).otherwise(a["unit"]), total - 1).alias("open"), put(F.when(first_fills, a["unit"]).otherwise(x["unit"]), F.lit(1.0)).alias("done"))
        met = F.when(total < 1 - eps, low).otherwise(high)
        # what is left may itself be whole
        whole = met["open"]["p"] < eps
        closed = F.array(met["done"], put(met["open"]["unit"], F.lit(0.0)))
        none = F.lit(None).cast(kind)
        after = F.struct(F.when(whole, none).otherwise(met["open"]).alias("open"), F.concat(acc["done"], F.when(whole, closed).otherwise(F.array(met["done"]))).alias("done"))
        return F.when(a.isNull(), F.struct(x.alias("open"), acc["done"].alias("done"))).otherwise(after)

    return F.aggregate(units, start, meet)


def _groups(todo: DataFrame, fan_in: int) -> DataFrame:
    """(source, fine, cls, n_groups): how the units of a fine size class are dealt.

    Fine classes are 64 to a doubling of the size. A source's classes are as
    wide as it takes to hold about ``fan_in`` units (a small source is one
    class); a class with more units is split into ``n_groups`` by hash. All
    but the first count runs over one row per source and fine class.
    """
    fine = todo.groupBy("source", "fine").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").over(Window.partitionBy("source"))
    fine = fine.withColumn("cls", F.floor(F.col("fine") / 64.0 * F.least(F.lit(64.0), n / (fan_in * 8.0))))
    in_class = F.sum("n").over(Window.partitionBy("source", "cls"))
    return fine.select("source", "fine", "cls", F.ceil(in_class / fan_in).alias("n_groups"))


def round_copies(units: DataFrame, seed: int = 7, fan_in: int = 48) -> DataFrame:
    """Units (unit, p in [0, 1)) with column ``extra``: 0 or 1, the source totals kept to within one.

    Each level deals the units of a source by size into groups of about
    ``fan_in``; what stays fractional goes up until a source has one unit.
    """
    done = units.where("p <= 1e-9").select("unit", F.lit(0.0).alias("p"))
    todo, level = units.where("p > 1e-9"), 0
    while True:
        fine = F.floor(F.log2(F.greatest(F.col("unit.size"), F.lit(1))) * 64)
        todo = todo.select("unit", "p", F.col("unit.source").alias("source"), fine.alias("fine"))
        # the null source joins as well
        same = F.col("u.source").eqNullSafe(F.col("g.source")) & (F.col("u.fine") == F.col("g.fine"))
        dealt = todo.alias("u").join(_groups(todo, fan_in).alias("g"), same).select(
            "u.source", "cls", "unit", "p", F.pmod(F.xxhash64("unit", F.lit(seed + level)), F.col("n_groups")).alias("group")
        )
        folded = dealt.groupBy("source", "cls", "group").agg(
            F.sort_array(F.collect_list(F.struct(F.col("unit.size").alias("size"), F.col("unit.id").alias("id"), "unit", "p")), asc=False).alias("members")
        ).select(_fold(F.transform("members", lambda x: F.struct(x["unit"].alias("unit"), x["p"].alias("p"))), seed, F.lit(level)).alias("f"))
        both = F.concat(F.transform("f.done", lambda x: F.struct(x.alias("x"), F.lit(False).alias("open"))), F.when(F.col("f.open").isNull(), F.array().cast(f"array<struct<x:struct<unit:{UNIT},p:double>,open:boolean>>")).otherwise(F.array(F.struct(F.col("f.open").alias("x"), F.lit(True).alias("open")))))
        rows = stored(folded.select(F.explode(both).alias("r")).select("r.x.unit", "r.x.p", "r.open"), f"pivotal-{level}")
        done = done.unionByName(rows.where("NOT open").select("unit", "p"))
        todo = rows.where("open").select("unit", "p")
        left = todo.groupBy("unit.source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if left <= 1:
            # a last unit per source keeps its probability
            last = F.when(_uniform("unit", F.lit(seed)) < F.col("p"), 1.0).otherwise(0.0)
            return done.unionByName(todo.select("unit", last.alias("p"))).select("unit", F.col("p").cast("long").alias("extra"))
        level += 1


def _tiers(u: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """``u`` with column ``tier``: 0 for the largest units of a source, then the smaller ones.

    Tier t ends where a source's units, from the largest down, hold
    ``shares[t]`` of its words. Units of one fine size class share a tier, so
    the window runs over one row per source and class.
    """
    fine = F.floor(F.log2(F.greatest(F.col("unit.size"), F.lit(1))) * 64)
    u = u.withColumn("fine", fine)
    per = u.groupBy("unit.source", "fine").agg(F.sum(F.col("unit.size") * F.col("unit.m")).alias("words"))
    own = Window.partitionBy("source")
    above = F.sum("words").over(own.orderBy(F.desc("fine")).rowsBetween(Window.unboundedPreceding, -1))
    part = F.coalesce(above, F.lit(0)) / F.greatest(F.sum("words").over(own), F.lit(1))
    tier = sum(((part >= F.lit(x)).cast("int") for x in shares), F.lit(0))
    per = per.select("source", "fine", tier.alias("tier"))
    same = F.col("a.unit.source").eqNullSafe(F.col("b.source")) & (F.col("a.fine") == F.col("b.fine"))
    return u.alias("a").join(per.alias("b"), same).select(*[F.col(f"a.{c}") for c in u.columns if c != "fine"], "b.tier")


def _copies(u: DataFrame, most: float, seed: int, shares: tuple[float, ...]) -> DataFrame:
    """(unit, copies) of units (unit, rate): rounded tier by tier, each making up for the words of those before."""
    tiered = stored(_tiers(u, shares), "mix-tiers")
    done = None
    for tier in range(len(shares) + 1):
        own = tiered.where(F.col("tier") == tier).select("unit", "rate")
        if done is not None:
            words = F.col("unit.size").cast("double")
            off = done.groupBy("unit.source").agg(F.sum((F.col("copies") - F.col("rate")) * words).alias("off"))
            held = own.groupBy("unit.source").agg(F.sum(F.col("rate") * words).alias("held"))
            same = F.col("h.source").eqNullSafe(F.col("o.source"))
            factor = held.where("held > 0").alias("h").join(off.alias("o"), same).select("h.source", (1 - F.col("off") / F.col("held")).alias("factor"))
            met = own.alias("u").join(factor.alias("f"), F.col("u.unit.source").eqNullSafe(F.col("f.source")), "left")
            # ``asked`` is what this tier should take, ``rate`` stays what the document should
            asked = F.col("rate") * F.coalesce("factor", F.lit(1.0))
            own = met.select("unit", "rate", F.least(F.greatest(asked, F.lit(0.0)), F.col("unit.m") * F.lit(float(most))).alias("asked"))
        else:
            own = own.withColumn("asked", F.col("rate"))
        own = stored(own.withColumn("whole", F.floor(F.col("asked") + 1e-9)), f"mix-tier-{tier}")
        extra = round_copies(own.select("unit", F.greatest(F.col("asked") - F.col("whole"), F.lit(0.0)).alias("p")), seed + 1000 * tier)
        # a unit's fate meets its other columns in one aggregation (null ids and sources group as well)
        parts = own.select("unit", "rate", "whole").unionByName(extra.select("unit", "extra"), allowMissingColumns=True)
        rounded = parts.groupBy("unit").agg(F.max("rate").alias("rate"), (F.max("whole") + F.max("extra")).alias("copies"))
        rounded = stored(rounded, f"mix-rounded-{tier}")
        done = rounded if done is None else done.unionByName(rounded)
    return done.select("unit", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, tiers: tuple[float, ...] = (0.5, 0.875)) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per document of ``docs``."""
    sized = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"))
    units = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")
    targets = source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most)
    targets = stored(targets, "mix-targets")
    same = F.col("u.source").eqNullSafe(F.col("t.source"))
    u = units.alias("u").join(targets.alias("t"), same).select(
        F.struct(F.col("doc_id").alias("id"), F.col("u.source"), "size", "m").alias("unit"), "source_size", "target"
    )
    # expected copies of the m equal rows together
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("unit.m")
    copied = _copies(u.select("unit", rate.alias("rate")), most, seed, tiers)
    rows = copied.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("unit.m") - 1)))
    copies = F.floor(F.col("copies") / F.col("unit.m")) + (F.col("i") < F.col("copies") % F.col("unit.m")).cast("long")
    same = F.col("r.unit.source").eqNullSafe(F.col("t.source"))
    return rows.select("unit", copies.alias("copies")).alias("r").join(targets.alias("t"), same).select(
        F.col("unit.id").alias("doc_id"), F.col("unit.size").alias("size"), "source_size", "target", (F.col("copies") * F.col("unit.size")).cast("long").alias("taken")
    )
