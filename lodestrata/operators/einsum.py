"""Sparse tensor contractions planned by cost: a chain of equi-joins, each followed by a sum over indices no longer needed.

A tensor is a DataFrame with one column an index and a column ``v``. Join order matters as it does for einsum: the planner tries
every way to split the operands in two, prices a step by 0.5 ln(flops) + ln(memory) of dense sizes, and remembers subsets.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import small_list


def plan(equation: str, sizes: dict[str, int]) -> tuple[float, object]:
    """(cost, tree) of the cheapest order; a tree is an operand's position or a pair of trees."""
    left, out = equation.split("->")
    terms = left.split(",")

    def needed(inside: frozenset) -> str:
        rest = set(out) | {i for k, t in enumerate(terms) if k not in inside for i in t}
        return "".join(sorted({i for k in inside for i in terms[k]} & rest))

    volume = lambda idx: math.prod(sizes[i] for i in set(idx)) if idx else 1

    @lru_cache(maxsize=None)
    def best(inside: frozenset) -> tuple[float, object]:
        if len(inside) == 1:
            return 0.0, next(iter(inside))
        items = sorted(inside)
        options = []
        for n in range(1, len(items) // 2 + 1):
            for part in combinations(items, n):
                a = frozenset(part)
                b = inside - a
                if 2 * n == len(items) and items[0] not in a:
                    continue
                ca, ta = best(a)
                cb, tb = best(b)
                flops = volume(needed(a) + needed(b))
                options.append((ca + cb + 0.5 * math.log(max(flops, 1)) + math.log(max(volume(needed(inside)), 1)), (ta, tb)))
        return min(options, key=lambda o: (o[0], str(o[1])))

    return best(frozenset(range(len(terms))))


def einsum(equation: str, *tensors: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """The contraction as ``(output indices…, v)``; absent entries are zero, null values count as zero, a null index is left out.

    Operands without a common index are multiplied out, as the equation asks; the planner leaves that for last where it can.
    An index no other operand or the output needs is summed before any join. ``sizes`` default to 1000 an index.
    """
    left, out = equation.split("->")
    terms = left.split(",")
    sizes = sizes or {i: 1000 for t in terms for i in t}

    def summed(df: DataFrame, keep: list[str]) -> DataFrame:
        return df.groupBy(*keep).agg(F.sum("v").alias("v")) if keep else df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))

    def run(tree, outside: set[str]) -> tuple[DataFrame, list[str]]:
        if isinstance(tree, int):
            idx = sorted(set(terms[tree]))
            t = tensors[tree].select(*idx, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")).dropna(subset=idx)
        else:
            inner = [{i for k in _leaves(x) for i in terms[k]} for x in tree]
            (a, ia), (b, ib) = run(tree[0], outside | inner[1]), run(tree[1], outside | inner[0])
            shared = sorted(set(ia) & set(ib))
            b = b.withColumnRenamed("v", "_w")
            t = (a.join(b, shared) if shared else a.crossJoin(b)).withColumn("v", F.col("v") * F.col("_w")).drop("_w")
            idx = sorted(set(ia) | set(ib))
        keep = [i for i in idx if i in outside]
        return (t if keep == idx and isinstance(tree, int) else summed(t, keep)), keep

    result, kept = run(plan(equation, sizes)[1], set(out))
    return result.select(*out, "v")


def _leaves(tree) -> list[int]:
    return [tree] if isinstance(tree, int) else reduce(lambda a, b: a + b, (_leaves(x) for x in tree))


def set_partitions(n: int) -> list[tuple[int, ...]]:
    """The ways to group ``n`` indices, each as the group number of every index, groups numbered as they first appear."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(n):
        out = [(*p, g) for p in out for g in range(max(p, default=-1) + 2)]
    return out


def symbolic_terms(inputs: int, output: int) -> list[str]:
    """Equations 'abc->d…' of all permutation-equivariant terms from ``inputs`` indices to ``output`` ones: equal letters for grouped
    indices, so that each way to group them all gives one; e.g. (1, 1): 'a->a' and 'a->b'."""
    terms = []
    for p in set_partitions(inputs + output):
        letters = "".join(chr(97 + g) for g in p)
        terms.append(f"{letters[:inputs]}->{letters[inputs:]}")
    return sorted(terms)


def einsum_expanded(equation: str, *tensors: DataFrame, domains: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """As ``einsum``, with letters that repeat in a term (its diagonal), repeat in the output (embedded on its diagonal) or stand in
    the output alone (spread over ``domains[letter]``, a table with that one column, which must have at most 10,000 rows).

    Output columns are named by letter, second and later uses of one letter with a number behind it.
    """
    left, out = equation.split("->")
    terms, plain, frames = left.split(","), [], []
    for term, t in zip(terms, tensors):
        unique = "".join(dict.fromkeys(term))
        if len(unique) < len(term):  # columns of a repeated letter are a, a2, …: only the diagonal counts
            seen: dict[str, int] = {}
            for letter in term:
                seen[letter] = seen.get(letter, 0) + 1
                if seen[letter] > 1:
                    t = t.where(F.col(letter) == F.col(f"{letter}{seen[letter]}")).drop(f"{letter}{seen[letter]}")
        plain.append(unique)
        frames.append(t)
    known = set("".join(plain))
    inner = "".join(dict.fromkeys(c for c in out if c in known))
    result = einsum(f"{','.join(plain)}->{inner}", *frames, sizes=sizes)
    for letter in dict.fromkeys(c for c in out if c not in known):
        result = result.crossJoin(small_list(domains[letter].select(letter).distinct(), 10_000, f"values of {letter}"))
    columns, used = [], {}
    for letter in out:
        used[letter] = used.get(letter, 0) + 1
        columns.append(F.col(letter).alias(letter if used[letter] == 1 else f"{letter}{used[letter]}"))
    return result.select(*columns, "v")


def masked_pooling(equation: str, values: DataFrame, mask: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """A one-operand pooling divided by the same pooling of its mask: means over what is there. Places without any mask give no row."""
    out = equation.split("->")[1]
    total = einsum(equation, values, sizes=sizes)
    count = einsum(equation, mask, sizes=sizes).withColumnRenamed("v", "_n")
    joined = total.join(count, list(out)) if out else total.crossJoin(count)  # one row each
    return joined.where("_n != 0").select(*out, (F.col("v") / F.col("_n")).alias("v"))


def sampled_einsum(equation: str, *tensors: DataFrame, sizes: dict[str, int], share: float, seed: int = 0) -> DataFrame:
    """An estimate: each summed index keeps a ``share`` of its values, drawn by a hash, and the sums are scaled up. The sampling is the feature."""
    left, out = equation.split("->")
    summed = sorted(set(left) - set(out) - {","})
    keep = lambda df, c: df.where(F.pmod(F.xxhash64(F.col(c), F.lit(seed), F.lit(c)), F.lit(1_000_000)) < int(share * 1_000_000))
    thinned = []
    for term, t in zip(left.split(","), tensors):
        for c in summed:
            t = keep(t, c) if c in term else t
        thinned.append(t)
    result = einsum(equation, *thinned, sizes=sizes)
    return result.withColumn("v", F.col("v") / F.lit(share ** len(summed)))
