"""Column functions: parsing, recodes, flags, classes. Each is one native expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from odflow.spec import BANDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_num(c: Column | str, kind: str = "double") -> Column:
    """Number of a text; blank or garbage is null."""
    text = F.trim(_col(c))
    return F.when(text != "", text).try_cast(kind)


def nullify_sentinels(c: Column | str, codes: Sequence[str]) -> Column:
    return F.when(~_col(c).isin(*codes), _col(c))


def recode(c: Column | str, table: Mapping[str, Sequence], default=None) -> Column:
    """Class whose list holds the value; ``default`` otherwise (null stays null)."""
    out = F
    for label, values in table.items():
        out = out.when(_col(c).isin(*values), F.lit(label))
    return out.when(_col(c).isNotNull(), F.lit(default)) if default is not None else out


def recode_ranges(c: Column | str, table: Sequence[tuple[str, str, str]]) -> Column:
    """First (label, low, high) whose range holds the code, in text order of zero-padded codes."""
    out = F
    for label, low, high in table:
        out = out.when(_col(c).between(low, high), F.lit(label))
    return out


def bin_le(c: Column | str, cuts: Sequence[float], labels: Sequence[str], null_label: str | None = None) -> Column:
    """Upper bounds inclusive; one label more than cuts."""
    out = F.when(_col(c).isNull(), F.lit(null_label))
    for cut, label in zip(cuts, labels):
        out = out.when(_col(c) <= cut, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def bin_lt(c: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Upper bounds exclusive, null below the first cut: label i is [cut i, cut i + 1)."""
    out = F.when(_col(c) < cuts[0], F.lit(None))
    for cut, label in zip(cuts[1:], labels):
        out = out.when(_col(c) < cut, F.lit(label))
    return out.when(_col(c).isNotNull(), F.lit(labels[-1]))


def pad_code(c: Column | str, width: int) -> Column:
    return F.lpad(_col(c), width, "0")


def cross_label(a: Column | str, b: Column | str) -> Column:
    """a_b, null if either is."""
    return F.concat(_col(a), F.lit("_"), _col(b))


def in_universe(c: Column | str, predicate: Column) -> Column:
    return F.when(predicate, _col(c))


def map_codes(c: Column | str, codes: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[_col(c)]


def flag(predicate: Column) -> Column:
    """Unknown is false: without this, comparison groups lose their rows with nulls."""
    return F.coalesce(predicate, F.lit(False))


def not_measured(kind: str = "boolean") -> Column:
    """What an edition did not ask stays null, never false."""
    return F.lit(None).cast(kind)


def any_yes(columns: Sequence[str], yes: str = "1") -> Column:
    return flag(reduce(lambda a, b: a | b, [_col(c) == yes for c in columns]))


def require(c: Column | str, predicate: Column, message: str) -> Column:
    return F.when(flag(predicate), _col(c)).otherwise(F.raise_error(F.lit(message)))


def to_wage_units(c: Column | str, wage: float) -> Column:
    return _col(c) / F.lit(wage)


def classify_status(prev_local="prev_local", prev_unit="prev_unit", birth_local="birth_local", birth_unit="birth_unit", nationality="nationality", sentinels: Sequence[str] = ("99",)) -> Column:
    """Kind of a mover by the first rule that holds; null for those who did not move.

    From abroad as a citizen (nationality 1 or 2) or a foreigner (any other, unknown included); to the unit of birth; born abroad;
    origin unknown; from the unit of birth; from a later one; the rest of the internal movers.
    """
    came, born, before = _col(prev_local), _col(birth_local), _col(prev_unit)
    inside = came == "2"
    return (
        F.when((came == "3") & _col(nationality).isin("1", "2"), "abroad_citizen").when(came == "3", "abroad_foreigner")
        .when(inside & (born == "1"), "return").when(inside & (born == "3"), "born_abroad").when(inside & before.isin(*sentinels), "unknown_origin")
        .when(inside & (born == "2") & (before == _col(birth_unit)), "first_exit").when(inside & (born == "2") & (before != _col(birth_unit)), "multi_stage")
        .when(inside, "other")
    )


def precision_class(cv: Column | str) -> Column:
    c = _col(cv)
    return F.when(c.isNull(), F.lit("none")).when(c <= 15, F.lit("good")).when(c <= 30, F.lit("caution")).otherwise(F.lit("low"))


def classify_effectiveness(value: Column | str, se: Column | str, z: float = 1.96) -> Column:
    """rotation below 0.15; undefined if not significant; strong from 1/3 on; moderate between."""
    v, size = _col(value), F.abs(_col(value))
    side = F.when(v > 0, F.lit("gain")).otherwise(F.lit("loss"))
    return (
        F.when(v.isNull(), F.lit(None)).when(size < 0.15, F.lit("rotation")).when(size < z * _col(se), F.lit("undefined"))
        .when(size >= 1 / 3, F.concat(F.lit("strong_"), side)).otherwise(F.concat(F.lit("moderate_"), side))
    )


def flow_type(distance: Column | str, share: Column | str) -> Column:
    far, across = _col(distance) >= 200, _col(share) >= 0.5
    return F.when(far & across, F.lit("long_crossing")).when(far, F.lit("long_within")).when(across, F.lit("short_crossing")).otherwise(F.lit("short_within"))


def round_base(c: Column | str, base: int = 5) -> Column:
    """Nearest multiple of the base, halves away from zero."""
    return F.round(_col(c) / float(base)) * base


def band_n(c: Column | str) -> Column:
    """Published band of a sample count."""
    out = F.when(_col(c) < BANDS[0], F.lit(f"<{BANDS[0]}"))
    for low, high in zip(BANDS, BANDS[1:]):
        out = out.when(_col(c) < high, F.lit(f"{low}-{high - 1}"))
    return out.when(_col(c).isNotNull(), F.lit(f"{BANDS[-1]}+"))


def ci95(value: Column, se: Column, floor: bool = True) -> tuple[Column, Column]:
    low = value - 1.96 * se
    return (F.greatest(low, F.lit(0.0)) if floor else low), value + 1.96 * se


def check_digit(c: Column | str, digits: int = 6) -> Column:
    """Check digit of the first ``digits`` figures: modulo 10, weights 1 and 2 in turn, products over 9 less 9."""
    parts = []
    for i in range(digits):
        product = F.substring(_col(c), i + 1, 1).cast("int") * (i % 2 + 1)
        parts.append(F.when(product > 9, product - 9).otherwise(product))
    return ((10 - reduce(lambda a, b: a + b, parts) % 10) % 10).cast("string")


def substitute_stratum(unit: Column | str, area: Column | str) -> Column:
    """Stratum where none is published: unit and kind of area."""
    return F.concat(_col(unit), F.lit("-"), _col(area))


def flag_cross(is_flow: Column | str, before: Column | str, now: Column | str) -> Column:
    """A move over the border of a coarser level; unknown is false."""
    return flag(_col(is_flow) & (_col(before) != _col(now)))


def flag_return(is_flow: Column | str, birth: Column | str, before: Column | str, now: Column | str) -> Column:
    """A move back to the region of birth from another one."""
    return flag(_col(is_flow) & (_col(birth) == _col(now)) & (_col(before) != _col(now)))


def route_destination(employed: Column | str, destination: Column | str, for_work: bool = True) -> Column:
    """One question asked of workers and students: its answer for those of one universe, null for the other."""
    mine = flag(_col(employed))
    return F.when(mine if for_work else ~mine, _col(destination))


def proxy_flow(years: Column | str, last_unit: Column | str, unit: Column | str, age: Column | str, most_years: int = 4, min_age: int = 5) -> Column:
    """Stand-in for the unit of a fixed date: the last residence of those who came within ``most_years``; null for all others."""
    came = flag((_col(age) >= min_age) & (_col(years) <= most_years) & (_col(last_unit) != _col(unit)))
    return F.when(came, _col(last_unit))


def core_periphery(o_core: Column | str, d_core: Column | str) -> Column:
    """Kind of a move inside a region by whether its ends are the core."""
    o, d = flag(_col(o_core)), flag(_col(d_core))
    return F.when(o & ~d, F.lit("core_periphery")).when(~o & d, F.lit("periphery_core")).otherwise(F.lit("periphery_periphery"))


def work_class(commutes: Column | str, work: Column | str, before: Column | str, core: Column | str, local: Column | str) -> Column:
    """Where a mover works, set against the move: where they came from, the core, elsewhere, at home, several places, abroad."""
    going = flag(_col(commutes))
    return (
        F.when(going & (_col(work) == _col(before)), F.lit("origin")).when(going & (_col(work) == _col(core)), F.lit("core")).when(going, F.lit("other"))
        .when(_col(local).isin("1", "2"), F.lit("own")).when(_col(local) == "5", F.lit("several")).when(_col(local) == "4", F.lit("abroad")).otherwise(F.lit("unknown"))
    )


def se_effectiveness(inflow: Column | str, outflow: Column | str, se_in: Column | str, se_out: Column | str) -> Column:
    """Standard error of (I - E) / (I + E) by the delta method, ends taken as independent: 2 sqrt(E^2 Var I + I^2 Var E) / (I + E)^2."""
    i, e = _col(inflow), _col(outflow)
    return F.when(i + e > 0, 2 * F.sqrt(e * e * _col(se_in) * _col(se_in) + i * i * _col(se_out) * _col(se_out)) / ((i + e) * (i + e)))


def classify_breaks(c: Column | str, breaks: Sequence[float]) -> Column:
    """Number of breaks at or below the value; null is class 0."""
    return F.when(_col(c).isNull(), F.lit(0)).otherwise(reduce(lambda a, b: a + b, [(_col(c) >= b).cast("int") for b in breaks]))


def bands_below(least: int) -> list[str]:
    """Bands that lie wholly below a floor of persons."""
    return [f"<{BANDS[0]}", *(f"{low}-{high - 1}" for low, high in zip(BANDS, BANDS[1:]) if high - 1 < least)]


def cell_state(value: Column | str, existed: Column | str, coverage: Column | str, one_member: Column | str, undefined: Column | None = None) -> Column:
    """What a panel cell shows: a number, or why it has none. A null ``existed`` means that the edition has no row."""
    out = F.when(_col(existed).isNull(), "not_measured").when(~_col(existed), "did_not_exist").when(_col(coverage) == "none", "not_covered")
    out = out.when((_col(coverage) == "insufficient") | flag(_col(one_member)), "insufficient").when(_col(value).isNull(), "suppressed")
    return (out.when(flag(undefined), "undefined") if undefined is not None else out).otherwise("number")


def profile_state(unit_state: Column | str, shown: Column | str, dominant: Column | str) -> Column:
    """Reason why a profile bar is not drawn, null if it is: the unit's own state, or its dominant class is suppressed."""
    return F.when(_col(unit_state).isin("did_not_exist", "not_covered", "insufficient"), _col(unit_state)).when((_col(shown) == 0) | _col(dominant).isNull(), "suppressed")
