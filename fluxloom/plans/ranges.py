"""Range aggregation: merge a series over many closed time ranges without making pairs.

A range ``[lo, hi]`` (whole microseconds, both ends in) is cut into
  * raw edges: at most two base cells that the range covers only in part, and
  * full cells on a ladder of widths ``base, base*fan, base*fan^2, ...``.
Samples are merged once per cell with map-side combine, so a hot series or a burst is
reduced before it is shuffled, and a range touches a few cells per ladder step, whatever
the number of samples in it. Joins are plain equi-joins on (keys, cell).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Part:
    """A mergeable value: what one sample gives, and how two of them combine."""

    name: str
    sample: Column | str
    merge: str  # sum | min | max | first_by | last_by
    by: str = "us"
    lift: Callable[[Column], Column] | None = None  # the value about an origin that much (us) earlier

    def combined(self) -> Column:
        call = {"first_by": f"min_by({self.name}, {self.by})", "last_by": f"max_by({self.name}, {self.by})"}
        return F.expr(call.get(self.merge, f"{self.merge}({self.name})")).alias(self.name)


def cell_of(us: Column | str, width: int) -> Column:
    """Index of the cell of ``width`` microseconds that holds ``us`` (integer arithmetic)."""
    c = F.col(us) if isinstance(us, str) else us
    return F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))


def _cell(x: str, width: int) -> str:
    return f"(({x}) - pmod({x}, {width}L)) div {width}L"


def _cells(start: str, end: str, step: int) -> str:
    """Array of structs (step, cell) for start <= cell < end; empty when there are none."""
    run = f"if({start} < {end}, sequence({start}, {end} - 1), cast(array() as array<bigint>))"
    return f"transform({run}, c -> named_struct('step', {step}, 'cell', c))"


def ladder(base: int, longest: int, fan: int) -> list[int]:
    widths = [base]
    while widths[-1] * fan <= longest:
        widths.append(widths[-1] * fan)
    return widths


def range_aggregate(
    ranges: DataFrame,
    samples: DataFrame,
    *,
    keys: Sequence[str] = (),
    group: Sequence[str],
    parts: Sequence[Part],
    finals: Sequence[Column],
    base: int,
    longest: int,
    fan: int = 6,
    us: str = "us",
    by: Sequence[str] = (),
    keep_empty: bool = True,
) -> DataFrame:
    """Aggregate ``samples`` over every range and finish with ``groupBy(group).agg(finals)``.

    ranges   keys + anything + ``lo``, ``hi``
    samples  keys + ``us`` + whatever the parts read
    group    columns of ``ranges`` (and of ``by``) that name one output row
    finals   aggregates over range columns and part names; a range meets several partial
             rows, so they must merge again (sum of sums, min of mins, ...)
    base     width of the finest cell; longest, an upper bound of ``hi - lo`` that only
             tunes the ladder
    by       sample columns kept apart inside a cell (e.g. a value bin)

    Finals may also read ``origin``, the start (us) of the cell a partial row stands for. A part
    may be kept about its cell's start (``us - origin`` in ``sample``), which keeps sums of
    squares small; its ``lift`` moves it to the start of a wider cell.
    """
    keys, by = list(keys), list(by)
    names = [p.name for p in parts]
    widths = ladder(base, longest, fan)
    placed = samples.where(F.col(us).isNotNull()).withColumn("us", F.col(us))
    placed = placed.withColumn("origin", F.col("us") - F.pmod("us", F.lit(base)))
    points = placed.select(
        *keys, *by, "us", "origin", *[(F.expr(p.sample) if isinstance(p.sample, str) else p.sample).alias(p.name) for p in parts]
    )

    finest = points.groupBy(*keys, *by, cell_of(F.col("us"), base).alias("cell")).agg(
        *[p.combined() for p in parts]
    )
    steps = "array(" + ", ".join(f"named_struct('step', {i}, 'ratio', {w // base}L)" for i, w in enumerate(widths)) + ")"
    shift = F.expr(f"pmod(cell, _s.ratio) * {base}L")
    full = (
        finest.withColumn("_s", F.expr(f"explode({steps})"))
        .select(
            *keys,
            *by,
            F.expr("_s.step as step"),
            F.expr("(cell - pmod(cell, _s.ratio)) div _s.ratio as cell"),
            F.expr(f"(cell - pmod(cell, _s.ratio)) * {base}L as origin"),
            *[(p.lift(shift) if p.lift else F.col(p.name)).alias(p.name) for p in parts],
        )
        .groupBy(*keys, *by, "step", "cell")
        .agg(F.min("origin").alias("origin"), *[p.combined() for p in parts])
    )

    carried = [c for c in ranges.columns if c not in ("lo", "hi")]
    live = ranges.where("lo <= hi")
    spans = live.select(
        "*", F.expr(_cell(f"lo + {base - 1}L", base)).alias("_a0"), F.expr(_cell("hi + 1", base)).alias("_b0")
    )
    pieces = []
    for i in range(len(widths) - 1):
        up_a, up_b, nxt = _cell(f"_a{i} + {fan - 1}", fan), _cell(f"_b{i}", fan), i + 1
        climbs = f"{up_a} < {up_b}"
        spans = spans.select(
            "*", F.expr(f"if({climbs}, {up_a}, 0L)").alias(f"_a{nxt}"), F.expr(f"if({climbs}, {up_b}, 0L)").alias(f"_b{nxt}")
        )
        climbed = f"_a{nxt} < _b{nxt}"
        pieces.append(_cells(f"_a{i}", f"if({climbed}, _a{nxt} * {fan}, _b{i})", i))
        pieces.append(_cells(f"if({climbed}, _b{nxt} * {fan}, _b{i})", f"_b{i}", i))
    top = len(widths) - 1
    pieces.append(_cells(f"_a{top}", f"_b{top}", top))
    covered = (
        spans.select(*carried, F.expr(f"inline(concat({', '.join(pieces)}))"))
        .join(full, keys + ["step", "cell"])
        .select(*carried, *by, "origin", *names)
    )

    left = f"if(pmod(lo, {base}L) != 0, {_cell('lo', base)}, null)"
    right = f"if(pmod(hi + 1, {base}L) != 0, {_cell('hi', base)}, null)"
    same = f"{_cell('lo', base)} = {_cell('hi', base)}"
    inside = F.expr(f"array_compact(if({same}, array(coalesce({left}, {right})), array({left}, {right})))")
    edges = (
        live.withColumn("cell", F.explode(inside))
        .join(points.withColumn("cell", cell_of(F.col("us"), base)), keys + ["cell"])
        .where(F.col("us").between(F.col("lo"), F.col("hi")))
        .select(*carried, *by, "origin", *names)
    )
    merged = covered.unionByName(edges)
    if keep_empty and not by:
        merged = merged.unionByName(ranges.select(*carried), allowMissingColumns=True)
    return merged.groupBy(*group).agg(*finals)


def range_join(ranges: DataFrame, series: DataFrame, *, keys: Sequence[str] = (), width: int, us: str = "us") -> DataFrame:
    """All (range, sample) pairs with ``lo <= us <= hi``, by an equi-join on (keys, bucket).

    A range is copied to the buckets it touches, a sample has one bucket, and a pair meets
    in exactly one of them, so nothing is counted twice.
    """
    touched = F.sequence(cell_of(F.col("lo"), width), cell_of(F.col("hi"), width))
    spread = ranges.where(F.col("lo") <= F.col("hi")).withColumn("_bucket", F.explode(touched))
    placed = series.withColumn("_bucket", cell_of(F.col(us), width))
    pairs = spread.join(placed, list(keys) + ["_bucket"])
    return pairs.where(F.col(us).between(F.col("lo"), F.col("hi"))).drop("_bucket")


def window_join(
    grid: DataFrame,
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    before_us: int,
    after_us: int,
    grid_us: str = "grid_us",
    us: str = "us",
) -> DataFrame:
    """All (grid row, sample) pairs with ``grid_us - before <= us <= grid_us + after``.

    Pairs are the product of this operator; figures over a window come from
    ``range_aggregate``, which makes none. Half-open ends are one microsecond shorter.
    """
    ranges = grid.withColumn("lo", F.col(grid_us) - before_us).withColumn("hi", F.col(grid_us) + after_us)
    return range_join(ranges, series, keys=keys, width=max(before_us + after_us, 1), us=us).drop("lo", "hi")
