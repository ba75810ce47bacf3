"""Column expressions that normalise feeds: markets, statuses, weeks, lines, documents' names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import col

#: Names of markets, their selections, and words for statuses.
MARKETS = {"pregame_moneyline": "moneyline", "moneyline": "moneyline", "h2h": "moneyline", "pregame_ats": "ats", "ats": "ats", "spreads": "ats", "pregame_total": "total", "total": "total", "totals": "total"}
SELECTIONS = {"moneyline": ("home", "away", "tie"), "ats": ("home", "away"), "total": ("over", "under")}
STATUSES = {"DOUBTFUL": "DOUBTFUL", "QUESTIONABLE": "QUESTIONABLE", "NO DESIGNATION": "NO_DESIGNATION", "": "NO_DESIGNATION"}
PRACTICES = {
    "DID NOT PARTICIPATE IN PRACTICE": "DNP", "DID NOT PARTICIPATE": "DNP", "LIMITED PARTICIPATION IN PRACTICE": "LIMITED", "LIMITED PARTICIPATION": "LIMITED",
    "FULL PARTICIPATION IN PRACTICE": "FULL", "FULL PARTICIPATION": "FULL", "": "NOT_LISTED",
}
ROUNDS = ("Wildcard", "Division", "Conference", "Superbowl")
REGULAR_WEEKS = 18


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def market(c: Column | str, strict: bool = False) -> Column:
    """The market's name; null for an unknown one, which fails the query if `strict`."""
    name = looked_up(MARKETS, F.lower(F.trim(col(c))))
    return F.coalesce(name, F.raise_error(F.concat(F.lit("unknown market: "), F.coalesce(col(c), F.lit("null")))).cast("string")) if strict else name


def selection(of: Column | str, c: Column | str) -> Column:
    """The selection's name if the market (normalised) has it, else null."""
    s = F.lower(F.trim(col(c)))
    out = None
    for m, some in SELECTIONS.items():
        hit = (col(of) == m) & s.isin(*some)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out


def status(c: Column | str, words: dict[str, str] = STATUSES) -> Column:
    """Upper-case status; known words by `words` (null and empty: no designation), others with _ for spaces."""
    s = F.coalesce(F.upper(F.trim(col(c))), F.lit(""))
    return F.coalesce(looked_up(words, s), F.replace(s, F.lit(" "), F.lit("_")))


def practice(c: Column | str) -> Column:
    """Share taken in practice: DNP, LIMITED, FULL, NOT_LISTED for null and empty; others with _ for spaces."""
    return status(c, PRACTICES)


def week_order(c: Column | str) -> Column:
    """Place of a week in the season from 0; what is no week comes last."""
    n = col(c).try_cast("int")
    out = F.when((n.between(1, REGULAR_WEEKS)) & (n.cast("string") == col(c)), n - 1)
    for i, name in enumerate(ROUNDS):
        out = out.when(col(c) == name, REGULAR_WEEKS + i)
    return out.otherwise(REGULAR_WEEKS + len(ROUNDS))


def in_order(c: Column | str, names: list[str]) -> Column:
    """Place in a stated order, others after all of them."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), col(c)), F.lit(0).cast("long")), F.lit(len(names) + 1).cast("long"))


def slug(c: Column | str, empty: str = "game") -> Column:
    """Letters, digits, dots, _ and -; other runs are one -, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", empty).otherwise(s)


def shown(c: Column | str, digits: int = 3) -> Column:
    """A number with so many decimals; a dash for null and what is not finite."""
    x = col(c).cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, "—").otherwise(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")))


def seasons(c: Column | str) -> Column:
    """"2020-2023" or "2021,2023" as an array of years."""
    part = F.split(F.trim(col(c)), r"\s*,\s*")
    years = F.transform(part, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.try_element_at(F.split(p, "-"), F.lit(-1)).cast("int")))
    return F.flatten(years)


def home_spread(favourite: Column | str, spread: Column | str, home: Column | str, away: Column | str) -> Column:
    """The spread as the home side's: negative where home is the favourite; 0 for a pick or none; null if neither side."""
    size, f = F.abs(col(spread).cast("double")), col(favourite)
    return F.when(size.isNull(), None).when((F.upper(F.trim(f)) == "PICK") | (size == 0), 0.0).when(f == col(home), -size).when(f == col(away), size)


def implied_points(total: Column | str, spread: Column | str) -> tuple[Column, Column]:
    """Home and away points that a total and the home side's spread imply."""
    t, s = col(total), col(spread)
    return (t - s) / 2, (t + s) / 2


def line_shape(line: Column | str) -> dict[str, Column]:
    """Magnitude, distance to the key numbers 3 and 7, and whether it is whole or ends in a half."""
    size = F.abs(col(line).cast("double"))
    whole = F.abs(size - F.round(size)) <= 1e-8
    return {"magnitude": size, "to_three": F.abs(size - 3), "to_seven": F.abs(size - 7), "is_whole": whole.cast("int"), "is_half": (F.abs(size - F.floor(size) - 0.5) <= 1e-8).cast("int")}


def fresh(age_minutes: Column | str, to_start_minutes: Column | str, near_hours: float = 2.0, near: float = 15.0, far: float = 1440.0) -> Column:
    """Whether a quote is young enough: `near` minutes from `near_hours` before the start on, else `far`; no age: no."""
    close = F.coalesce(col(to_start_minutes) <= near_hours * 60, F.lit(False))
    return F.coalesce(col(age_minutes) <= F.when(close, near).otherwise(far), F.lit(False))


#: Weights of a passer's box score.
PASSER_VALUE = {"attempts": -2.2, "completions": 3.7, "passing_yards": 0.2, "passing_tds": 11.3, "interceptions": -14.1, "sacks": -8.0, "rush_attempts": -1.1, "rush_yards": 0.6, "rush_tds": 15.9}


def passer_value() -> Column:
    out = F.lit(0.0)
    for c, w in PASSER_VALUE.items():
        out = out + F.lit(w) * F.col(c)
    return out


def strength(home: Column, away: Column, league_home: Column, league_away: Column) -> Column:
    """A side's points over the league's, home and away alike: attack by points for, weakness by points against."""
    return (F.try_divide(home, F.when(league_home > 0, league_home)) + F.try_divide(away, F.when(league_away > 0, league_away))) / 2


def blend(base: Column, other: Column, weight: float = 0.7) -> Column:
    return base * weight + other * (1 - weight)


def wind_factor(mph: Column, intercept: float = 45.973, slope: float = -0.3787, least: float = 0.0, most: float | None = None) -> Column:
    """Share of the scoring that a wind leaves, within bounds; null for a negative speed."""
    x = F.greatest(F.lit(least), (intercept + slope * mph) / intercept)
    return F.when(mph >= 0, x if most is None else F.least(F.lit(most), x))


def one_hot(c: Column | str, names: list[str]) -> dict[str, Column]:
    return {n: (F.coalesce(col(c) == n, F.lit(False))).cast("int") for n in names}


def arg_max(columns: dict[str, Column]) -> Column:
    """Name of the greatest, the first of equal ones; null if all are."""
    best = F.greatest(*columns.values())
    return F.coalesce(*[F.when(c == best, n) for n, c in columns.items()])


def json_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and no spaces; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
