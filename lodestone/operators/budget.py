"""Character budgets over ordered rows of any number."""

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REF_CAP = 40  # fixed value: references listed for one node


def listed_within(df: DataFrame, group: list, order: list, cost: str, allowance: int, cap: int = REF_CAP) -> DataFrame:
    """Rows of each group that a bounded list prints: at most `cap`, until the allowance is spent.

    A row is printed while what came before it is under the allowance. The rank filter cuts
    each group to `cap` rows before the shuffle, so the running sum sees no large group.
    """
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= cap)
    before = W.partitionBy(*group).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(before), F.lit(0))
    return ranked.withColumn("spent_before", spent).filter(F.col("spent_before") < allowance)


def fill(df: DataFrame, order: list, cost: str, limit: int) -> tuple[list[Row], int]:
    """(kept rows, number dropped): greedy in order, skipping rows that do not fit.

    `order` names columns that together are unique and sort ascending. A later, smaller row
    may still fit, so a prefix sum would be wrong. Once a row of some cost is skipped, all later
    rows of that cost are: the budget only shrinks. So of each cost c the first limit // c rows
    are all that can be kept, and one job fetches them, at most limit * (1 + ln limit) rows
    however many there are. Costs are positive; others and nulls are refused.
    """
    total, _ = _bounds(df, cost, F.lit(0))
    if limit <= 0 or not total:
        return [], total
    place = F.row_number().over(W.partitionBy(cost).orderBy(*order))
    # The constant bound lets Spark cut each cost's rows before the shuffle.
    candidates = df.filter(F.col(cost) <= limit).withColumn("_place", place).filter(F.col("_place") <= limit)
    candidates = candidates.filter(F.col("_place") <= F.floor(F.lit(limit) / F.col(cost))).drop("_place")
    left, kept = limit, []
    for row in candidates.orderBy(*order).collect():
        if row[cost] <= left:
            left -= row[cost]
            kept.append(row)
    return kept, total - len(kept)


def fill_table(df: DataFrame, order: list, cost: str, limit: int) -> tuple[DataFrame, int]:
    """(kept rows as a table, number dropped): `fill` where a row may cost nothing or have no cost.

    A null cost never fits. A row that costs nothing always does, whatever was kept before it, so those rows take
    no part in the fold and do not pass through the driver, however many they are. Negative costs are refused.
    """
    if limit < 0:
        return df.limit(0), df.count()
    costs = F.col(cost)
    free, unknown = df.agg(F.count_if(costs == 0), F.count_if(costs.isNull())).first()
    kept, dropped = fill(df.filter(costs != 0), order, cost, limit)
    rows = df.sparkSession.createDataFrame(kept, df.schema)
    return rows.unionByName(df.filter(costs == 0)) if free else rows, dropped + unknown


def fill_grouped(
    df: DataFrame, order: list, cost: str, group: str, header: str, limit: int
) -> tuple[list[Row], int]:
    """Like fill, for rows listed under headings: a row whose group was not the last one kept
    also pays for its heading (`header`). `order` starts with the group, which is not null.

    A group can only be begun by a row that fits with its heading, so rows before the first such
    row of their group are left out. The next row of what remains always fits; a round fetches as
    many as the budget could hold and folds them in order, so one very dear row costs no round.
    Each round keeps at least one row; more than a few are needed only where costs are arranged
    so that nearly every fetched row stops fitting within its round.
    """
    total, least = _bounds(df, cost, F.col(header))
    position = F.struct(*[F.col(c) for c in order])
    left, kept, last = limit, [], None
    while total and left > 0:
        fitting = df.filter(F.col(cost) <= left)
        if last is not None:
            reached = F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in order])
            fitting = fitting.filter(position > reached)
        begun = F.when(F.col(cost) + F.col(header) <= left, position)
        if kept:
            begun = F.when(F.col(group) == F.lit(kept[-1][group]), position).otherwise(begun)
        first = fitting.groupBy(F.col(group).alias("_group")).agg(F.min(begun).alias("_first"))
        fitting = fitting.join(first, F.col(group) == F.col("_group")).filter(position >= F.col("_first"))
        batch = fitting.drop("_group", "_first").orderBy(*order).limit(left // least + 1).collect()
        if not batch:
            break
        for row in batch:
            last = row
            charge = row[cost] + (row[header] if not kept or kept[-1][group] != row[group] else 0)
            if charge <= left:
                left -= charge
                kept.append(row)
    return kept, total - len(kept)


def _bounds(df: DataFrame, cost: str, header) -> tuple[int, int]:
    """(rows, least cost) of rows that all cost something."""
    n, priced, least, heading = df.agg(F.count("*"), F.count(cost), F.min(cost), F.min(header)).first()
    if n and (priced < n or least <= 0 or heading is None or heading < 0):
        raise ValueError(f"every row needs a positive {cost}")
    return n, int(least or 0)
