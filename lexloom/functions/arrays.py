"""Column builders over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: the state of a fold over nothing stands for a local name.

    Unlike the elements of ``transform``, neither that value nor the result is copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def jump(to: Column) -> Column:
    """Follows pointers of an array (places in it) to their ends by doubling: log2 of the size rounds."""
    rounds = lambda p: F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(p).cast("double") + 1)).cast("int")))
    return let(to, lambda first: F.aggregate(rounds(first), first, lambda p, _: F.transform(p, lambda k: F.coalesce(F.get(p, k), k))))


def depths(to: Column) -> Column:
    """How many steps each pointer of an array takes to its end (a place that points at itself), by doubling."""
    start = lambda p: F.struct(p.alias("p"), F.transform(p, lambda k, i: F.when(k == i, 0).otherwise(1)).alias("d"))
    rounds = lambda p: F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(p).cast("double") + 1)).cast("int")))
    step = lambda s, _: F.struct(F.transform(s["p"], lambda k: F.get(s["p"], k)).alias("p"), F.zip_with(s["d"], s["p"], lambda d, k: d + F.get(s["d"], k)).alias("d"))
    return let(to, lambda p: F.aggregate(rounds(p), start(p), step)["d"])


def running(values: Column) -> Column:
    """The sums of an array up to each place, by doubling: log2 of the size rounds."""
    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double") + 1)).cast("int"))
    before = lambda s, i, r: F.coalesce(F.get(s, i - F.call_function("shiftleft", F.lit(1), r)), F.lit(0))
    return let(values, lambda v: F.aggregate(rounds(v), v, lambda s, r: F.transform(s, lambda x, i: x + before(s, i, r))))


def groups(keys: Column) -> Column:
    """Where equal keys lie in a sorted array: structs (key, at, n) of the first place of each key and how often it comes."""
    firsts = lambda k: F.array_compact(F.transform(k, lambda x, i: F.when((i == 0) | (F.get(k, i - 1) != x), i)))
    group = lambda k, f, i, j: F.struct(F.get(k, i).alias("key"), i.alias("at"), (F.coalesce(F.get(f, j + 1), F.size(k)) - i).alias("n"))
    return let(keys, lambda k: let(firsts(k), lambda f: F.transform(f, lambda i, j: group(k, f, i, j))))


def spread(groups: Column) -> Column:
    """Numbers of ``groups`` (of whole keys) by key, counted from the first key on: which group has the key, null for none. Linear in the span of the keys."""
    gap = lambda g, x, j: F.coalesce(F.get(g, j + 1)["key"] - x["key"], F.lit(1)) - 1
    return let(groups, lambda g: F.flatten(F.transform(g, lambda x, j: F.concat(F.array(j), F.array_repeat(F.lit(None).cast("int"), gap(g, x, j).cast("int"))))))


def below(values: Column, of: Column) -> Column:
    """For each of the ascending ``values`` how many numbers of ``of`` are smaller: all are sorted together, as numbers."""
    both = F.sort_array(F.concat(F.transform(of, lambda x: x.cast("long") * 2 + 1), F.transform(values, lambda x: x.cast("long") * 2)))
    return let(both, lambda v: F.transform(F.array_compact(F.transform(v, lambda x, k: F.when(x % 2 == 0, k))), lambda k, i: k - i))
