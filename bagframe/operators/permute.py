"""Permutations that every row computes for itself.

A permutation of the slots 0 .. n - 1 is a Feistel network on the grid slot = q * width + o: in turn the rest is turned round its row by a
keyed function of the quotient, and the quotient round its column by a keyed function of the rest. Each step undoes itself by the opposite
turn, also in the last, shorter row, so the network is a bijection of exactly n slots, for every key. A row thus knows its partner's slot
in permutation k without any order being made, and rows are dealt to shelves of partner values, which are arrays of bounded size; only partial
aggregates per permutation are shuffled. Up to one shelf of rows the work grows as the rows do, beyond it by the number of shelves too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.operators.scan import hash_position
from bagframe.session import default_blocks

#: Steps of the network, and the prime and multipliers of its keyed function.
STEPS = 6
PRIME, FIRST, SECOND, THIRD = 2_147_483_647, 48_271, 69_621, 16_807
#: Partner values in one array, 2 MB of doubles.
BLOCK_VALUES = 1 << 18
#: Arrays that a task holds at once, 32 MB of doubles: a row tries all permutations once for as many partners.
SHELF = 16


def network(slot: str, n: str, width: str, key: str, seed: int, div: str = "div", steps: int = STEPS) -> list[tuple[str, str]]:
    """The permutation ``key`` of ``slot`` as columns (name, expression), each of which uses those before it; the last one is ``partner``. ``width``
    is about the root of n. Spark and DuckDB compute alike, but for the name of whole division: longs only, and products of numbers below the
    prime, which fit a long. Squares keep the function from being linear."""
    out = [("p_q", f"{slot} {div} {width}"), ("p_o", f"{slot} % {width}")]
    q, o = "p_q", "p_o"
    for step in range(steps):
        value = q if step % 2 == 0 else o
        x, y = f"p_x{step}", f"p_y{step}"
        out += [(x, f"({value} * {FIRST} + {key} * {SECOND} + {(step + 1) * THIRD + seed * FIRST}) % {PRIME}"), (y, f"({x} * {x} + {key}) % {PRIME}")]
        turn = f"({y} * {y} + {x}) % {PRIME}"
        if value == q:
            out.append((f"p_o{step}", f"({o} + {turn}) % least({width}, {n} - {q} * {width})"))
            o = f"p_o{step}"
        else:
            out.append((f"p_q{step}", f"({q} + {turn}) % (({n} - 1 - {o}) {div} {width} + 1)"))
            q = f"p_q{step}"
    return [*out, ("partner", f"{q} * {width} + {o}")]


WIDTH = "cast(ceil(sqrt(cast({n} as double))) as bigint)"


def with_partner(df: DataFrame, n: str, width: str, key: str, seed: int) -> DataFrame:
    """df with the column ``partner``: the slot that permutation ``key`` (a long) gives to ``slot``."""
    return df.selectExpr("*", *[f"{e} as {name}" for name, e in network("slot", n, width, key, seed)]).select(*df.columns, "partner")


def slots(df: DataFrame, id_col: str, blocks: int | None = None) -> DataFrame:
    """df with ``slot``, 0-based, in md5 order of the ids, and ``total``, the number of rows."""
    return hash_position(df, [], [id_col], [F.lit("order")], out="slot", blocks=blocks)


def permuted_statistic(rows: DataFrame, left: Column, right: Column, keep: Column, aggregate: Column, permutations: int, seed: int = 1,
                       block_values: int = BLOCK_VALUES, deals: int | None = None, shelf: int = SHELF) -> DataFrame:
    """(perm, s): ``aggregate`` over the columns a and b for every permutation 1 .. permutations, where a row's a is ``left`` and its b is
    ``right`` of the row at its partner's slot. Rows without ``keep`` have no part as a row, but as partners. ``rows`` has slot and total.

    Partner values are gathered to arrays of ``block_values`` and those to shelves of ``shelf`` arrays. Rows are sent once to every shelf, n /
    (block_values * shelf) times, and there try all permutations; per task and permutation one partial aggregate leaves. An aggregate
    without partial results (a list) would make Spark send its input.
    """
    deals = deals or default_blocks(rows.sparkSession)
    n = rows.agg(F.max("total")).scalar()
    block = F.floor(F.col("slot") / block_values).cast("long")
    values = rows.select(block.alias("block"), "slot", right.alias("b")).groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "b"))), lambda x: x["b"]).alias("bs"))
    values = values.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    # blocks have no gaps, so the place in the shelf is the block's number in it
    values = values.groupBy(F.floor(F.col("block") / shelf).cast("long").alias("shelf"), "deal").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "bs"))), lambda x: x["bs"]).alias("shelved"))
    held = block_values * shelf
    last = F.floor((F.col("n") - 1) / held).cast("long")
    asking = rows.where(keep).select("slot", left.alias("a")).withColumn("n", n).withColumn("width", F.expr(WIDTH.format(n="n")))
    asking = asking.withColumn("deal", F.pmod(F.col("slot"), F.lit(deals)).cast("int")).withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # the rows are few bytes and much work: left to Spark, they would be joined in a handful of tasks; merging holds one shelf at a time
    asking = asking.repartition(deals, "shelf", "deal")
    met = asking.join(values.hint("merge"), ["shelf", "deal"]).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    met = with_partner(met.withColumn("k", F.col("perm").cast("long")), "n", "width", "k", seed)
    # a generator and not a filter: the optimiser would push a filter on the partner below every step of the network, as one huge condition
    at = (F.col("partner") - F.col("shelf") * held).cast("int")
    value = F.get(F.get("shelved", F.expr(f"cast((partner - shelf * {held}) div {block_values} as int)")), F.expr(f"cast((partner - shelf * {held}) % {block_values} as int)"))
    met = met.select("perm", "a", F.explode(F.when(at.between(0, held - 1), F.array(value))).alias("b"))
    return met.groupBy("perm").agg(aggregate.alias("s"))


def permutation_sql(source: str, columns: str, n: str, permutations: int, seed: int = 1) -> str:
    """DuckDB SQL of the same permutations: (slot, columns, k, partner) for every row of ``source`` and every k."""
    inner = f"select slot, {columns}, k, {n} as n, {WIDTH.format(n=n)} as width from {source}, range(1, {permutations + 1}) t(k)"
    for name, expression in network("slot", "n", "width", "k", seed, "//"):
        inner = f"select *, {expression} as {name} from ({inner})"
    return f"select slot, {columns.split(' as ')[-1]}, k, partner from ({inner})"
