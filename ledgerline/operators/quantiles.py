"""Exact percentiles by selection: sketches bracket the wanted ranks, counts narrow the brackets, and only a small rest is sorted (Q-2, Q-38, E-16, E-17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: A bracket of at most this many rows is sorted.
SMALL = 4_096
#: The sketches' accuracy; a rank is off by at most one in this many rows.
ACCURACY = 2_000


def percentiles(df: DataFrame, wanted: list[tuple[str, float]], small: int = SMALL) -> list[float | None]:
    """The exact percentiles of (column, share between 0 and 1), between two values in proportion, as F.percentile gives them; None for a column without
    values. Nulls don't count, NaN is greater than all else.

    Each turn is one pass over the rows inside the brackets and cuts a bracket to about a thousandth; rows of one value end a bracket at once, however many
    they are. Only counts, edges and at most `small` values a bracket reach the driver."""
    names = sorted({c for c, _ in wanted})
    rows = stored(df.select(*[F.col(c).cast("double").alias(c) for c in names]))
    sizes = rows.agg(*[F.count(c).alias(c) for c in names]).first()
    needed = {(c, r) for c, p in wanted if sizes[c] for r in _around(p, sizes[c])}
    found = _selected(rows, {c: sizes[c] for c in names}, needed, small)
    out: list[float | None] = []
    for c, p in wanted:
        if not sizes[c]:
            out.append(None)
            continue
        at = p * (sizes[c] - 1)
        a, b = _around(p, sizes[c])
        out.append(found[c, a] if a == b or found[c, a] == found[c, b] else (b - at) * found[c, a] + (at - a) * found[c, b])
    return out


def _around(p: float, n: int) -> tuple[int, int]:
    at = p * (n - 1)
    return int(at), min(int(at) + (at > int(at)), n - 1)


def _selected(rows: DataFrame, sizes: dict[str, int], needed: set[tuple[str, int]], small: int) -> dict[tuple[str, int], float]:
    """The values at the needed ranks (from 0) of their columns."""
    done: dict[tuple[str, int], float] = {}
    # of each needed rank: the bracket's edges (None: open), the rows below it and in it
    open_: dict[tuple[str, int], tuple[float | None, float | None, int, int]] = {k: (None, None, 0, sizes[k[0]]) for k in needed}
    while open_:
        few: dict[tuple, list[int]] = {}
        for (c, r), (low, high, below, n) in open_.items():
            if n <= small:
                few.setdefault((c, low, high, below), []).append(r)
        for (c, low, high, below), ranks in few.items():  # a bracket's rows up to the last rank asked for
            values = [x[0] for x in rows.where(_inside(c, low, high)).select(c).orderBy(c).limit(max(ranks) - below + 1).collect()]
            done |= {(c, r): values[r - below] for r in ranks}
        open_ = {k: v for k, v in open_.items() if k not in done}
        if not open_:
            break
        keys = sorted(open_)
        sketch = rows.agg(*[F.percentile_approx(F.when(_inside(c, low, high), F.col(c)), _shares((r - below) / n), F.lit(ACCURACY)).alias(f"s{i}") for i, (c, r) in enumerate(keys) for low, high, below, n in [open_[c, r]]]).first()
        inner = {k: tuple(sketch[f"s{i}"]) for i, k in enumerate(keys)}
        counts = rows.agg(*[x.alias(f"{name}{i}") for i, k in enumerate(keys) for name, x in _counts(k[0], *open_[k][:2], *inner[k]).items()]).first()
        for i, (c, r) in enumerate(keys):
            low, high, below, n = open_[c, r]
            a, b = inner[c, r]
            under, at_a, between, at_b = (counts[f"{name}{i}"] for name in ("under", "first", "between", "last"))
            place = r - below
            if under <= place < under + at_a:
                done[c, r] = a
                del open_[c, r]
            elif a != b and under + at_a + between <= place < under + at_a + between + at_b:
                done[c, r] = b
                del open_[c, r]
            elif place < under:
                open_[c, r] = (low, a, below, under)
            elif place < under + at_a + between:
                open_[c, r] = (a, b, below + under + at_a, between)
            else:
                open_[c, r] = (b, high, below + under + at_a + between + (at_b if a != b else 0), n - under - at_a - between - (at_b if a != b else 0))
    return done


def _shares(p: float) -> list[float]:
    """Two shares with the wanted one between them, further apart than the sketch can err."""
    return [max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)]


def _inside(c: str, low: float | None, high: float | None):
    """Values strictly between the edges."""
    tests = [F.col(c).isNotNull()] + [F.col(c) > F.lit(low)] * (low is not None) + [F.col(c) < F.lit(high)] * (high is not None)
    return reduce(lambda x, y: x & y, tests)


def _counts(c: str, low: float | None, high: float | None, a: float, b: float) -> dict:
    """How many of the bracket's values are under a, a, between a and b, and b."""
    x, here = F.col(c), _inside(c, low, high)
    return {"under": F.count_if(here & (x < F.lit(a))), "first": F.count_if(here & (x == F.lit(a))), "between": F.count_if(here & (x > F.lit(a)) & (x < F.lit(b))), "last": F.count_if(here & (x == F.lit(b)))}
