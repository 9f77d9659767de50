"""Pieces of checking SQL that follow from the fixed values."""

from __future__ import annotations

from smogline import constants as K


def haversine(lat1, lon1, lat2, lon2) -> str:
    return (f"(2 * 6371.0 * asin(sqrt(least(greatest(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1}))"
            f" * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 0.0), 1.0))))")


def flat(lat, lon, ref_lat, ref_lon) -> str:
    return (f"sqrt(pow(({lat} - {ref_lat}) * 111.0, 2) + "
            f"pow(({lon} - {ref_lon}) * 111.0 * cos(radians({lat})), 2))")


def subindex(value: str, pollutant: str, table: str = "domain", gap: str = "continuous") -> str:
    brackets = (K.BREAKPOINTS if table == "domain" else K.STATION_BREAKPOINTS)[pollutant]
    arms = [f"WHEN {value} IS NULL OR {value} < 0 THEN NULL"]
    for low, high, i_low, i_high in brackets:
        test = f"{value} <= {high}" if gap == "continuous" else f"{value} BETWEEN {low} AND {high}"
        at = f"greatest({value}, {low})" if gap == "continuous" else value
        arms.append(f"WHEN {test} THEN {i_low}::DOUBLE + ({i_high - i_low}::DOUBLE / ({high}::DOUBLE - {low}::DOUBLE)) "
                    f"* ({at} - {low})")
    arms.append(f"WHEN {value} > {brackets[-1][1]} THEN 500.0")
    return f"(CASE {' '.join(arms)} ELSE {0.0 if table == 'domain' else 500.0} END)"


def _ladder(value: str, pick: int, missing: str) -> str:
    arms = " ".join(f"WHEN {value} <= {e[0]} THEN '{e[pick]}'" for e in K.CATEGORIES[:-1])
    return f"(CASE WHEN {value} IS NULL THEN {missing} {arms} ELSE '{K.CATEGORIES[-1][pick]}' END)"


def category(index: str, rounding: bool = True) -> str:
    return _ladder(f"round_even({index}, 0)", 1, "'Unknown'") if rounding else _ladder(index, 1, "NULL")


def color(index: str) -> str:
    return _ladder(f"round_even({index}, 0)", 2, "'#808080'")


def advisory(index: str) -> str:
    return _ladder(f"round_even({index}, 0)", 3, "'No data available.'")


def bround(column: str, digits: int = 1) -> str:
    """Half-even rounding of a column by its decimal digits, in exact arithmetic."""
    d = f"(CAST(CAST({column} AS VARCHAR) AS DECIMAL(30, 16)) * {10 ** digits})"
    rest = f"({d} - floor({d}))"
    return (f"(CAST(floor({d}) + CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND floor({d}) % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE)"
            f" / {10 ** digits})")


def with_index(columns: list[str], source: str, table: str = "domain", gap: str = "continuous") -> str:
    """The source rows with aqi and dominant_pollutant."""
    raw = ", ".join(f"{subindex(c, c, table, gap)} AS s_{c}" for c in columns)
    rounded = ", ".join(f"{bround('s_' + c)} AS r_{c}" for c in columns)
    arms = " ".join(f"WHEN r_{c} = aqi THEN '{c.upper()}'" for c in columns)
    names = ", ".join([f"s_{c}" for c in columns] + [f"r_{c}" for c in columns])
    return (f"SELECT * EXCLUDE ({names}), CASE WHEN aqi IS NULL THEN NULL {arms} END AS dominant_pollutant FROM "
            f"(SELECT *, greatest({', '.join('r_' + c for c in columns)}) AS aqi FROM "
            f"(SELECT *, {rounded} FROM (SELECT *, {raw} FROM {source})))")


def local(ts: str) -> str:
    return f"({ts} + INTERVAL {K.LOCAL_OFFSET_MINUTES} MINUTE)"


def round_hour(ts: str) -> str:
    h = f"(epoch_us({ts}) // 3600000000)"
    rest = f"(epoch_us({ts}) % 3600000000)"
    return (f"make_timestamp(3600000000 * ({h} + CASE WHEN {rest} > 1800000000 OR "
            f"({rest} = 1800000000 AND {h} % 2 = 1) THEN 1 ELSE 0 END))")
