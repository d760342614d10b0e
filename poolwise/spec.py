"""The factor design: names and level counts, and the integer codes built on them.

Levels of factor ``i`` run from 0 (inactive) to ``levels[i] - 1``.

* ``policy_id``   mixed radix over the levels, last factor fastest
* ``profile_id``  one bit per factor (level > 0), first factor most significant
* ``cut_mask``    one bit per place where factor ``i`` can be cut, i.e. between
  levels ``j + 1`` and ``j + 2``; factors are packed from the low bits upwards
* ``box_id``      mixed radix over one interval code ``lo * R + hi`` per factor

A pooling that is decided by cut masks splits each profile into products of
level segments, so a pool *is* a box and a ``box_id`` names it for good.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import prod

from pyspark.sql import Column, DataFrame, functions as F


# Per-factor lookup tables are written out up to this many cut positions.
TABLE_BITS = 6


@dataclass(frozen=True)
class FactorSpec:
    names: tuple[str, ...]
    levels: tuple[int, ...]

    def __post_init__(self):
        object.__setattr__(self, "names", tuple(self.names))
        object.__setattr__(self, "levels", tuple(int(r) for r in self.levels))
        if len(self.names) != len(self.levels):
            raise ValueError("one level count per factor is needed")
        if min(self.levels) < 2:
            raise ValueError("a factor needs at least two levels")
        if self.total_bits > 62:
            raise ValueError("cut positions do not fit into one BIGINT")
        if prod(r * r for r in self.levels) >= 2**63:
            raise ValueError("interval codes do not fit into one BIGINT")

    # ---- sizes, all known on the driver -------------------------------------------------

    @property
    def m(self) -> int:
        return len(self.names)

    @cached_property
    def bits(self) -> tuple[int, ...]:
        return tuple(r - 2 for r in self.levels)

    @cached_property
    def offsets(self) -> tuple[int, ...]:
        return tuple(sum(self.bits[:i]) for i in range(self.m))

    @cached_property
    def strides(self) -> tuple[int, ...]:
        return tuple(prod(self.levels[i + 1:]) for i in range(self.m))

    @cached_property
    def box_strides(self) -> tuple[int, ...]:
        return tuple(prod(r * r for r in self.levels[i + 1:]) for i in range(self.m))

    @property
    def total_bits(self) -> int:
        return sum(r - 2 for r in self.levels)

    @property
    def n_policies(self) -> int:
        return prod(self.levels)

    @property
    def n_profiles(self) -> int:
        return 2**self.m

    @property
    def full_profile(self) -> int:
        return self.n_profiles - 1

    @property
    def n_boxes(self) -> int:
        """Most boxes any cell table of this design can fill."""
        return prod(1 + (r - 1) * r // 2 for r in self.levels)

    def active_factors(self, profile_id: int) -> list[int]:
        return [i for i in range(self.m) if profile_id >> (self.m - 1 - i) & 1]

    def full_mask(self, i: int) -> int:
        return (1 << self.bits[i]) - 1

    # ---- SQL expressions ------------------------------------------------------------------
    #
    # Arguments are SQL expressions, by default the column of that name.  Whole
    # expressions are handed to the parser as text: one call per expression
    # instead of one per operator keeps the driver out of the way.

    def policy_sql(self, levels: list[str] | None = None) -> str:
        return _weighted(levels or list(self.names), self.strides)

    def level_sql(self, i: int, policy: str = "policy_id") -> str:
        return f"cast({_digit(policy, self.strides[i], self.levels[i])} as int)"

    def levels_sql(self, policy: str = "policy_id") -> list[str]:
        return [self.level_sql(i, policy) for i in range(self.m)]

    def profile_sql(self, levels: list[str] | None = None) -> str:
        flags = [f"if({c} > 0, {self.profile_bit(i)}, 0)" for i, c in enumerate(levels or self.names)]
        return f"cast({' + '.join(flags)} as int)"

    def profile_bit(self, i: int) -> int:
        return 1 << (self.m - 1 - i)

    def active_sql(self, i: int, profile: str = "profile_id") -> str:
        return f"(({profile}) & {self.profile_bit(i)}) != 0"

    def factor_mask_sql(self, i: int, mask: str = "cut_mask") -> str:
        return f"(shiftright({mask}, {self.offsets[i]}) & {self.full_mask(i)}L)"

    def full_mask_sql(self, profile: str = "profile_id") -> str:
        """Every admissible cut of the profile."""
        parts = [f"if({self.active_sql(i, profile)}, {self.full_mask(i) << self.offsets[i]}L, 0L)" for i in range(self.m)]
        return "(" + " + ".join(parts) + ")"

    def pool_count_sql(self, mask: str = "cut_mask") -> str:
        """Segments multiply over factors; inactive factors carry no bits and count once."""
        parts = [f"(1L + bit_count({self.factor_mask_sql(i, mask)}))" for i in range(self.m) if self.bits[i]]
        return " * ".join(parts) or "1L"

    def segment_sql(self, i: int, level: str, mask: str = "cut_mask") -> str:
        """Rank of the level's segment: the number of cuts below the level."""
        return f"bit_count({self.factor_mask_sql(i, mask)} & (shiftleft(1L, greatest({level} - 1, 0)) - 1))"

    def pool_sql(self, levels: list[str] | None = None, mask: str = "cut_mask") -> str:
        return _weighted([self.segment_sql(i, c, mask) for i, c in enumerate(levels or self.names)], self.strides)

    def segments_sql(self, i: int, mask: str = "cut_mask", profile: str = "profile_id") -> str:
        """ARRAY<BIGINT> of the interval codes, times their radix weight, that the mask makes of factor ``i``.

        Few masks are tabled as a literal, which the generated code indexes;
        factors with many levels compute their segments instead.
        """
        r, n, w = self.levels[i], self.levels[i] - 1, self.box_strides[i]
        fm = self.factor_mask_sql(i, mask)
        if self.bits[i] <= TABLE_BITS:
            rows = []
            for m in range(1 << self.bits[i]):
                ends = [l for l in range(1, n + 1) if l == n or m >> (l - 1) & 1]
                rows.append([(lo * r + hi) * w for lo, hi in zip([1] + [e + 1 for e in ends], ends)])
            codes = f"{_table(rows)}[cast({fm} as int)]"
        else:
            every = f"sequence(1, {n})"
            starts = f"filter({every}, l -> l = 1 or (shiftright({fm}, greatest(l - 2, 0)) & 1L) = 1)"
            ends = f"filter({every}, l -> l = {n} or (shiftright({fm}, l - 1) & 1L) = 1)"
            codes = f"zip_with({starts}, {ends}, (a, b) -> (a * {r} + b) * {w}L)"
        return f"if({self.active_sql(i, profile)}, {codes}, array(0L))"

    def masks_with_segment_sql(self, i: int, code: str) -> str:
        """ARRAY<BIGINT> of the cut masks of factor ``i``, in place, under which the interval ``code`` is a segment.

        Its two ends are cut, nothing inside it is, and all other positions are free.
        """
        r, n, off = self.levels[i], self.levels[i] - 1, self.offsets[i]
        if n == 1:
            return "array(0L)"
        if self.bits[i] <= TABLE_BITS:
            rows = [[0]] + [[] for _ in range(r * r - 1)]
            for m in range(1 << self.bits[i]):
                ends = [l for l in range(1, n + 1) if l == n or m >> (l - 1) & 1]
                for lo, hi in zip([1] + [e + 1 for e in ends], ends):
                    rows[lo * r + hi].append(m << off)
            return f"{_table(rows)}[cast({code} as int)]"
        lo, hi = f"cast({code} div {r} as int)", f"cast({code} % {r} as int)"
        below, above = f"greatest({lo} - 2, 0)", f"greatest({n - 1} - {hi}, 0)"
        ends = f"(if({lo} > 1, shiftleft(1L, {lo} - 2), 0L) | if({hi} < {n}, shiftleft(1L, {hi} - 1), 0L))"
        free = f"(k & (shiftleft(1L, {below}) - 1)) | shiftleft(shiftright(k, {below}), {hi})"
        masks = f"transform(sequence(0L, shiftleft(1L, {below} + {above}) - 1), k -> shiftleft({free} | {ends}, {off}))"
        return f"if({code} > 0, {masks}, array(0L))"

    def covering_sql(self, i: int, level: str) -> str:
        """ARRAY<BIGINT> of the weighted codes of all intervals of factor ``i`` that hold the level."""
        r, n, w = self.levels[i], self.levels[i] - 1, self.box_strides[i]
        if self.bits[i] <= TABLE_BITS:
            rows = [[0]] + [[(a * r + b) * w for a in range(1, l + 1) for b in range(l, n + 1)] for l in range(1, n + 1)]
            return f"{_table(rows)}[cast({level} as int)]"
        codes = (f"flatten(transform(sequence(1, greatest({level}, 1)), a -> "
                 f"transform(sequence(greatest({level}, 1), {n}), b -> (a * {r} + b) * {w}L)))")
        return f"if({level} > 0, {codes}, array(0L))"

    def containing_box_sql(self, levels: list[str], mask: str = "cut_mask") -> str:
        """Box of the partition that holds the cell with the given levels."""
        out = []
        for i, c in enumerate(levels):
            r, n = self.levels[i], self.levels[i] - 1
            if n == 1:
                out.append(f"if({c} > 0, {r + 1}, 0)")
                continue
            fm = self.factor_mask_sql(i, mask)
            below = f"({fm} & (shiftleft(1L, greatest({c} - 1, 0)) - 1))"
            above = f"shiftright({fm}, greatest({c} - 1, 0))"
            lo = f"if({below} = 0, 1, length(bin({below})) + 1)"
            hi = f"if({above} = 0, {n}, {c} + bit_count(({above} & -{above}) - 1))"
            out.append(f"if({c} > 0, {lo} * {r} + {hi}, 0)")
        return _weighted(out, self.box_strides)

    def box_code_sql(self, i: int, box: str = "box_id") -> str:
        return _digit(box, self.box_strides[i], self.levels[i] ** 2)

    def box_low_sql(self, i: int, box: str = "box_id") -> str:
        """Smallest level of factor ``i`` in the box."""
        return f"cast({self.box_code_sql(i, box)} div {self.levels[i]} as int)"

    def box_levels_sql(self, i: int, box: str = "box_id") -> str:
        """ARRAY<INT> of the levels of factor ``i`` inside the box."""
        return f"sequence({self.box_low_sql(i, box)}, cast({self.box_code_sql(i, box)} % {self.levels[i]} as int))"

    def box_width_sql(self, i: int, box: str = "box_id") -> str:
        return f"(1L + {self.box_code_sql(i, box)} % {self.levels[i]} - {self.box_code_sql(i, box)} div {self.levels[i]})"

    def box_volume_sql(self, box: str = "box_id") -> str:
        """Number of cells in the box."""
        return " * ".join(self.box_width_sql(i, box) for i in range(self.m))

    # ---- columns and row expansions ---------------------------------------------------------

    def policy_id(self, levels: list[str] | None = None) -> Column:
        return F.expr(self.policy_sql(levels))

    def profile_id(self, levels: list[str] | None = None) -> Column:
        return F.expr(self.profile_sql(levels))

    def profile_of_policy(self, policy: str = "policy_id") -> Column:
        return F.expr(self.profile_sql(self.levels_sql(policy)))

    def level(self, i: int, policy: str = "policy_id") -> Column:
        return F.expr(self.level_sql(i, policy))

    def level_columns(self, policy: str = "policy_id") -> list[Column]:
        return [self.level(i, policy).alias(n) for i, n in enumerate(self.names)]

    def pool_count(self, mask: str = "cut_mask") -> Column:
        return F.expr(self.pool_count_sql(mask))

    def mask_boxes(self, df: DataFrame, mask: str = "cut_mask", profile: str = "profile_id", only: str | None = None, factors: int | None = None) -> DataFrame:
        """One row per (row, box of its partition), in column ``box_id``.

        ``only`` limits the expansion: other rows pass once with a null box.  With ``factors``, boxes have intervals of
        that many leading factors only.
        """
        def codes(i):
            c = self.segments_sql(i, mask, profile)
            return c if only is None else f"if({only}, {c}, array(cast(null as bigint)))"
        return unfold(df, [codes(i) for i in range(self.m if factors is None else factors)], "box_id")

    def box_policies(self, df: DataFrame, box: str = "box_id", out: str = "policy_id") -> DataFrame:
        """One row per (row, cell inside its box)."""
        first = [f"{self.box_low_sql(i, box)} * {w}L" for i, w in enumerate(self.strides)]
        last = [f"({self.box_code_sql(i, box)} % {r}L) * {w}L" for i, (r, w) in enumerate(zip(self.levels, self.strides))]
        return unfold(df, [f"sequence({a}, {b}, {w}L)" for a, b, w in zip(first, last, self.strides)], out)


def unfold(df: DataFrame, arrays: list[str], out: str) -> DataFrame:
    """One row per choice of one element per array; ``out`` is their sum.

    A chain of explodes over built-in arrays stays inside generated code.
    """
    keep = [c for c in df.columns if c != out]
    for i, a in enumerate(arrays):
        df = df.selectExpr("*", f"explode({a}) as _u{i}")
    return df.selectExpr(*[f"`{c}`" for c in keep], " + ".join(f"_u{i}" for i in range(len(arrays))) + f" as {out}")


def _table(rows: list[list[int]]) -> str:
    cells = ["array(" + ", ".join(f"{x}L" for x in row) + ")" if row else "cast(array() as array<bigint>)" for row in rows]
    return "array(" + ", ".join(cells) + ")"


def _weighted(terms, weights) -> str:
    return "(" + " + ".join(f"({t}) * {w}L" for t, w in zip(terms, weights)) + ")"


def _digit(value: str, stride: int, base: int) -> str:
    # integral division stays exact where a floating quotient would not
    quotient = value if stride == 1 else f"({value} div {stride}L)"
    return f"({quotient} % {base}L)"
