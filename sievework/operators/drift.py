"""Drift between windows: energy distance, permutation test, report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import ordered
from ..plans.staging import staged

#: Rows of a block; the distances of a pair of blocks are one task's.
BLOCK = 512


def energy_distance(sample: DataFrame, key: str, label: str, columns: list[str], groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, statistic) 2 E|X-Y| - E|X-X'| - E|Y-Y'| between the rows of label 1 and label 0 of each group; null where one is absent."""
    return permutation_tests(sample, key, label, {"all": columns}, 0, 0, groups).select(*groups, "statistic")


def permutation_test(sample: DataFrame, key: str, label: str, columns: list[str], permutations: int, seed: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, statistic, p) of one representation."""
    return permutation_tests(sample, key, label, {"all": columns}, permutations, seed, groups).drop("representation")


def permutation_tests(
    sample: DataFrame, key: str, label: str, representations: dict[str, list[str]], permutations: int, seed: int, groups: tuple[str, ...] = (), block: int = BLOCK
) -> DataFrame:
    """(groups, representation, statistic, p): the energy distance of each representation (a list of columns), and
    (permutations with as large a statistic + 1) / (permutations + 1).

    A permutation gives the label to the rows that come first by a keyed uniform, then by key, as many as had it. A group's
    rows are cut into blocks, each with its labels in all permutations as bits; every pair of blocks meets once, and its
    distances are multiplied by both blocks' labels. So a task holds two blocks, whatever the group's size, and rows and
    permutations are packed; blocks sent are the square of their number. keys must differ within a group.
    """
    columns = list(dict.fromkeys(c for r in representations.values() for c in r))
    of = {name: [columns.index(c) for c in r] for name, r in representations.items()}
    gs = [f"_of{i}" for i in range(len(groups))] or ["_of"]
    grouped = [F.col(g).alias(f"_of{i}") for i, g in enumerate(groups)] or [F.lit(0).alias("_of")]
    rows = sample.select(*grouped, F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"), F.array(*(F.col(c).cast("double") for c in columns)).alias("_x"))
    numbered = ordered(rows, "_key", (), tuple(gs), sums={"ones": F.col("_label")}, ranks=False)
    place = numbered.select(*gs, "_key", "_label", "_x", F.col("total").alias("_n"), F.col("all_ones").alias("_ones"), F.floor((F.col("position") - 1) / block).alias("_block"))
    labelled = with_permutations(place, gs, permutations, seed)
    types = "".join(f"`{g}` {labelled.schema[g].dataType.simpleString()}, " for g in gs)

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        x, bits = np.array(part["_x"].tolist(), float), np.array(part["_labels"].tolist(), np.uint8)
        one = part.iloc[:1][[*gs, "_block", "_n", "_ones"]]
        return one.assign(_rows=len(part), _at=[x.tobytes()], _bits=[np.packbits(bits).tobytes()])

    blocks = staged(labelled.groupBy(*gs, "_block").applyInPandas(packed, f"{types}_block long, _n long, _ones long, _rows int, _at binary, _bits binary"), "blocks")
    sent = blocks.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block))).alias("_other"))
    sent = sent.withColumn("_first", F.least("_block", "_other")).withColumn("_second", F.greatest("_block", "_other"))

    def met(pair: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for r in pair.sort_values("_block").to_dict("records"):
            bits = np.unpackbits(np.frombuffer(r["_bits"], np.uint8), count=r["_rows"] * (permutations + 1))
            sides.append((np.frombuffer(r["_at"]).reshape(r["_rows"], len(columns)), bits.reshape(r["_rows"], permutations + 1).T.astype(float)))
        (x, lx), (y, ly) = sides[0], sides[-1]
        out = []
        for name, used in of.items():
            d = np.sqrt(sum((x[:, None, k] - y[None, :, k]) ** 2 for k in used))
            both = ((lx @ d) * ly).sum(1)
            one, whole = lx @ d.sum(1), d.sum()
            if len(sides) == 2:  # each pair counts from both sides
                both, one, whole = 2 * both, one + ly @ d.sum(0), 2 * whole
            out.append(pd.DataFrame({"representation": name, "_p": range(permutations + 1), "_both": both, "_one": one, "_whole": whole}))
        out = pd.concat(out)
        for g in (*gs, "_n", "_ones"):
            out[g] = [pair[g].iloc[0]] * len(out)
        return out[[*gs, "_n", "_ones", "representation", "_p", "_both", "_one", "_whole"]]

    schema = f"{types}_n long, _ones long, representation string, _p int, _both double, _one double, _whole double"
    sums = sent.groupBy(*gs, "_first", "_second").applyInPandas(met, schema)
    total = sums.groupBy(*gs, "representation", "_n", "_ones", "_p").agg(*(F.sum(c).alias(c) for c in ("_both", "_one", "_whole")))
    ones, rest = F.col("_ones"), F.col("_n") - F.col("_ones")
    s = F.try_divide(2 * (F.col("_one") - F.col("_both")), ones * rest) - F.try_divide("_both", ones * ones) - F.try_divide(F.col("_whole") - 2 * F.col("_one") + F.col("_both"), rest * rest)
    each = total.groupBy(*gs, "representation").agg(F.max(F.when(F.col("_p") == 0, s)).alias("statistic"), F.collect_list(F.when(F.col("_p") > 0, s)).alias("_s"))  # an entry per permutation
    as_large = F.size(F.filter("_s", lambda v: v >= F.col("statistic") - 1e-12))
    p = F.when(F.col("statistic").isNotNull(), (as_large + 1) / F.lit(permutations + 1))
    return each.select(*(F.col(f"_of{i}").alias(g) for i, g in enumerate(groups)), "representation", "statistic", p.alias("p"))


def with_permutations(rows: DataFrame, gs: list[str], permutations: int, seed: int) -> DataFrame:
    """rows with _labels: the label itself, then that of each permutation.

    The cut of a permutation, the number and key of the last row that gets the label, lies near the share of labels: numbers
    below a range around it are counted and only those within are collected, some sixteen times the root of the rows; the
    range is widened if the cut is not in it.
    """
    own = F.array(F.col("_label").cast("tinyint"))
    if not permutations:
        return rows.withColumn("_labels", own)
    rows = staged(rows.withColumn("_u", F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda p: S.keyed_uniform(seed, p, "_key"))), "permuted")
    long = rows.select(*gs, "_key", "_n", "_ones", F.posexplode("_u").alias("_p", "_v"))
    share, width = F.col("_ones") / F.col("_n"), 4.0
    while True:
        reach = F.lit(width) / F.sqrt("_n") + F.lit(2.0) / F.col("_n")
        near = F.when(F.abs(F.col("_v") - share) <= reach, F.struct(F.col("_v").alias("v"), F.col("_key").alias("k")))
        found = long.groupBy(*gs, "_p").agg(F.max("_ones").alias("_ones"), F.count_if(F.col("_v") < share - reach).alias("_below"), F.sort_array(F.collect_list(near)).alias("_near"))
        at = (F.col("_ones") - F.col("_below") - 1).cast("int")
        cuts = staged(found.select(*gs, "_p", "_ones", F.when(at >= 0, F.get("_near", at)).alias("cut")), "cuts")
        if cuts.where("cut IS NULL AND _ones > 0").isEmpty():
            break
        width *= 4
    cuts = cuts.groupBy(*(F.col(g).alias(f"c{g}") for g in gs)).agg(F.sort_array(F.collect_list(F.struct("_p", "cut"))).alias("_cuts"))  # one entry per permutation
    on = [F.col(g).eqNullSafe(F.col(f"c{g}")) for g in gs]
    taken = lambda v, c: F.coalesce(F.struct(v.alias("v"), F.col("_key").alias("k")) <= c["cut"], F.lit(False)).cast("tinyint")
    return rows.join(cuts, on).withColumn("_labels", F.concat(own, F.zip_with("_u", "_cuts", taken))).drop("_u", "_cuts", *(f"c{g}" for g in gs))


def psi(df: DataFrame, reference: DataFrame, bin_col: str, groups: tuple[str, ...] = (), eps: float = 1e-6) -> DataFrame:
    """(groups, psi): population stability of the histogram of bin_col against reference (bin, share)."""
    counts = df.groupBy(*groups, bin_col).agg(F.count(F.lit(1)).alias("n"))
    wholes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_all"))
    grid = wholes.join(F.broadcast(reference.select(F.col("bin").alias(bin_col), F.col("share").alias("q"))))
    full = grid.join(counts, [*groups, bin_col], "left").withColumn("p", F.greatest(F.coalesce("n", F.lit(0)) / F.col("_all"), F.lit(eps)))
    q = F.greatest(F.col("q"), F.lit(eps))
    return full.groupBy(*groups).agg(F.sum((F.col("p") - q) * F.ln(F.col("p") / q)).alias("psi"))
