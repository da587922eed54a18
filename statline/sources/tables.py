"""Base tables as DataFrames of one declared type each."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statline.constants import CARD_SLOTS, POSITIONS
from statline.functions.exprs import SEASON_PARTITION, season_of, stored_text
from statline.sources.schemas import DDL, schema

SEASON = "season"  # partition column of stored tables


#: The season of a row, for every table that has one.
SEASON_OF = {
    "events": "substring(game_id, 4, 4)",
    "gamelogs": "substring(yyyymmdd, 1, 4)",
    "teams": "yearid",
    **dict.fromkeys(
        ("parkconfig", "batting", "pitching", "allbatters", *(f"fielding_{p}" for p in POSITIONS)),
        "year",
    ),
}


#: Texts that jobs select rows of a table by.
COMPARED = {"allbatters": tuple(f"pos{i}" for i in range(1, CARD_SLOTS + 1))}


def conform(
    df: DataFrame, name: str, keep: Mapping[str, str] | None = None, trimmed: bool = False
) -> DataFrame:
    """Declared columns of table ``name``, cast where a source types them otherwise.

    Trailing blanks of texts go, as comparisons ignore them; ``trimmed`` promises
    that there are none, which lets filters on texts reach the files. Without that
    promise columns in ``COMPARED`` are there once more as they are, under their
    :func:`~statline.functions.exprs.stored_text` names, for ranges that can reach the
    files. Columns named in ``keep`` stay, if present, under the names given there.
    Catcher-only counts may be absent at other positions.
    """
    as_they_are = []
    present = {f.name.lower(): f for f in df.schema}
    columns = []
    for field in schema(name):
        found = present.get(field.name)
        if found is not None:
            source = f"`{found.name}`"
            if found.dataType != field.dataType:
                source = f"cast({source} as {field.dataType.simpleString()})"
            if not trimmed and isinstance(field.dataType, T.StringType):
                if field.name in COMPARED.get(name, ()):
                    as_they_are.append(f"{source} AS `{stored_text(field.name)}`")
                source = f"rtrim({source})"
        elif name.startswith("fielding_") and field.name in ("pb", "sb", "cs"):
            source = f"cast(null as {field.dataType.simpleString()})"
        else:
            raise ValueError(f"table {name} lacks column {field.name}")
        columns.append(f"{source} AS `{field.name}`")
    columns += [f"`{present[k].name}` AS `{v}`" for k, v in (keep or {}).items() if k in present]
    return df.selectExpr(*columns, *as_they_are)


class Tables:
    """Lazily loaded base tables; ``load(name)`` supplies each one."""

    def __init__(self, load: Callable[[str], DataFrame]) -> None:
        self._load = load

    # --- sources --------------------------------------------------------------

    @classmethod
    def from_directory(
        cls, spark: SparkSession, path: str, format: str = "parquet", declared: bool = False
    ) -> Tables:
        """One file or folder per table under ``path``: parquet, orc, csv or json.

        ``declared`` promises files of exactly the declared types, as
        :func:`write_tables` leaves them, and saves looking into them first.
        Text formats are always read that way.
        """

        def load(name: str) -> DataFrame:
            where = f"{path.rstrip('/')}/{name}"
            reader = spark.read
            if declared or format in ("csv", "json"):
                reader = reader.schema(schema(name))
            if format == "csv":
                reader = reader.option("header", True).option("enforceSchema", False)
            # only files of write_tables are known to lie by season
            keep = {SEASON: SEASON_PARTITION} if declared and name in SEASON_OF else None
            return conform(reader.format(format).load(where), name, keep, trimmed=declared)

        return cls(load)

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str]) -> Tables:
        """Catalog tables or views by full name, e.g. ``{"events": "retro.plays"}``."""
        return cls(lambda name: conform(spark.table(names[name]), name))

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame]) -> Tables:
        return cls(lambda name: conform(frames[name], name))

    def of_seasons(self, first: int, last: int, margin: int = 0) -> Tables:
        """The tables' rows of seasons ``first``..``last``, and of ``margin`` more on either
        side where neighbouring seasons count: in game logs and park dimensions.

        Rows without a season are left out. People have none and all stay.
        """
        return SeasonTables(self, first, last, margin)

    # --- tables ---------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self._load("events")

    @cached_property
    def gamelogs(self) -> DataFrame:
        return self._load("gamelogs")

    @cached_property
    def people(self) -> DataFrame:
        return self._load("people")

    @cached_property
    def teams(self) -> DataFrame:
        return self._load("teams")

    @cached_property
    def parkconfig(self) -> DataFrame:
        return self._load("parkconfig")

    @cached_property
    def batting(self) -> DataFrame:
        return self._load("batting")

    @cached_property
    def pitching(self) -> DataFrame:
        return self._load("pitching")

    @cached_property
    def cards(self) -> DataFrame:
        return self._load("allbatters")

    @cached_property
    def fielding(self) -> DataFrame:
        """The seven position tables as one, tagged with ``pos``."""
        return reduce(
            DataFrame.unionByName,
            [self._load(f"fielding_{p}").withColumn("pos", F.lit(p)) for p in POSITIONS],
        )


class SeasonTables(Tables):
    """Some seasons of other tables.

    Bounds are put on the rows themselves, and on the season that files lie by where
    the loader knows of one, so that other seasons' files are not opened.
    """

    def __init__(self, tables: Tables, first: int, last: int, margin: int) -> None:
        self._tables, self._first, self._last, self._margin = tables, first, last, margin

    def _bounded(self, df: DataFrame, year: str, margin: int = 0) -> DataFrame:
        first, last = self._first - margin, self._last + margin
        if SEASON_PARTITION in df.columns:
            df = df.where(F.col(SEASON_PARTITION).between(first, last))
        return df.where(F.col(year).between(first, last))

    def _dated(self, df: DataFrame, date: str, season: Column, margin: int = 0) -> DataFrame:
        """As :meth:`_bounded`, for a date or an id as text that holds the season."""
        first, last = str(self._first - margin), str(self._last + margin)
        if SEASON_PARTITION in df.columns:
            df = df.where(F.col(SEASON_PARTITION).between(int(first), int(last)))
        if date:  # files keep ranges of whole dates
            df = df.where((F.col(date) >= first) & (F.col(date) <= f"{last}~"))
        return df.where(season.between(first, last))

    @cached_property
    def events(self) -> DataFrame:
        return self._dated(self._tables.events, "", season_of())

    @cached_property
    def gamelogs(self) -> DataFrame:
        season = F.substring("yyyymmdd", 1, 4)
        return self._dated(self._tables.gamelogs, "yyyymmdd", season, self._margin)

    @cached_property
    def people(self) -> DataFrame:
        return self._tables.people

    @cached_property
    def teams(self) -> DataFrame:
        return self._bounded(self._tables.teams, "yearid")

    @cached_property
    def parkconfig(self) -> DataFrame:
        return self._bounded(self._tables.parkconfig, "year", self._margin)

    @cached_property
    def batting(self) -> DataFrame:
        return self._bounded(self._tables.batting, "year")

    @cached_property
    def pitching(self) -> DataFrame:
        return self._bounded(self._tables.pitching, "year")

    @cached_property
    def cards(self) -> DataFrame:
        return self._bounded(self._tables.cards, "year")

    @cached_property
    def fielding(self) -> DataFrame:
        return self._bounded(self._tables.fielding, "year")


# --------------------------------------------------------------------------
# sinks
# --------------------------------------------------------------------------


def write_tables(tables: Tables, path: str) -> None:
    """Store every base table as parquet, by season where rows have one.

    Rows are rebalanced by season first: adaptive execution joins small seasons and
    splits large ones by size, so files come out even whatever the mix of seasons.
    """
    for name in DDL:
        if name.startswith("fielding_"):
            here = F.col("pos") == name.removeprefix("fielding_")
            df = tables.fielding.where(here).drop("pos")
        else:
            df = getattr(tables, "cards" if name == "allbatters" else name)
        df = df.drop(SEASON_PARTITION, *map(stored_text, COMPARED.get(name, ())))
        writer = df.write
        if name in SEASON_OF:
            season = F.expr(f"try_cast({SEASON_OF[name]} AS int)")
            df = df.withColumn(SEASON, season).hint("rebalance", SEASON)
            writer = df.write.partitionBy(SEASON)
        writer.mode("overwrite").parquet(f"{path}/{name}")


#: Values come back as they were: quotes doubled, line ends and blanks kept, and an empty
#: text, in quotes, told from a missing value.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
EMPTY = "\0"  # what a reader puts for an empty text, else taken for a missing value


def write_report(report: DataFrame, path: str, format: str = "csv") -> None:
    """Store a report; its sort order runs through the files in name order."""
    writer = report.write.mode("overwrite")
    if format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(format).save(path)


def read_report(
    spark: SparkSession, path: str, kind: T.StructType, format: str = "csv"
) -> DataFrame:
    """A stored report's rows, in any order, with columns of type ``kind``."""
    if format != "csv":
        return spark.read.schema(kind).format(format).load(path)
    reader = spark.read.schema(kind).options(**CSV_OPTIONS, multiLine=True, enforceSchema=False)
    rows = reader.option("emptyValue", EMPTY).csv(path)
    texts = [f.name for f in kind if isinstance(f.dataType, T.StringType)]
    return rows.replace(EMPTY, "", subset=texts) if texts else rows
