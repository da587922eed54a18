"""The fielding value report and the stages it is built from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.operators import claims, leagues, parks, team_totals, win_shares
from statline.operators.team_totals import LEAGUE, TEAM
from statline.sources.durable import Keep, durable, store_of
from statline.sources.tables import Tables


class FieldingWinShares:
    """All stages over one set of tables.

    The stages form a graph in which team-season totals are used many times.
    ``keep`` stores such a total once, after its single pass over the player or
    game rows; everything later reads the small stored rows, whose true sizes
    plans then know. The default is the session's :class:`~statline.sources.durable.StageStore`,
    which two reports over the same files share; ``close`` gives its storage back.
    With ``keep=lambda df: df`` nothing is stored, and a table is read once for each
    use: right for a single small total, not for a report.
    """

    def __init__(self, tables: Tables, keep: Keep = durable) -> None:
        self.tables = tables
        self.keep = keep
        self._scopes: dict[int, FieldingWinShares] = {}

    def of_season(self, year: int) -> FieldingWinShares:
        """The same stages for one season, from this season's rows alone; for park factors
        also from the neighbouring seasons' game logs and park dimensions."""
        if year not in self._scopes:
            self._scopes[year] = _OneSeason(self.tables, year, self.keep)
        return self._scopes[year]

    def close(self) -> None:
        """Clears the store of the session, where this is what ``keep`` stands for.

        Frames asked for before are of no use then; asked for again, they are stored anew.
        """
        if self.keep is durable:
            store_of(self.tables.teams.sparkSession).clear()
            for name in [n for n in vars(self) if isinstance(vars(self)[n], DataFrame)]:
                del vars(self)[name]  # the stages this object remembers
            self._scopes.clear()

    # --- stored totals: one pass over each base table -----------------------

    @cached_property
    def pitching_totals(self) -> DataFrame:
        return self.keep(team_totals.pitching_team_seasons(self.tables.pitching))

    @cached_property
    def fielding_totals(self) -> DataFrame:
        return self.keep(team_totals.fielding_team_seasons(self.tables.fielding))

    @cached_property
    def side_totals(self) -> DataFrame:
        return self.keep(team_totals.side_totals(self.tables.gamelogs))

    @cached_property
    def codes(self) -> DataFrame:
        """Team codes, which game logs' and season tables' rows meet by."""
        return self.keep(self.tables.teams.select("yearid", "lgid", "teamidretro", "teamidbr"))

    @cached_property
    def park_seasons(self) -> DataFrame:
        return self.keep(parks.park_seasons(self.tables.parkconfig))

    @cached_property
    def book(self) -> DataFrame:
        """Batting, pitching, game-log and fielding totals side by side.

        Sums by position ride along: every later stage starts from this row.
        """
        return self.keep(
            leagues.team_book(
                team_totals.team_batting(self.tables.batting),
                self.team_pitching,
                team_totals.home_wins_road_losses(self.side_totals, self.codes),
                self._fielding_record(by_position=True),
            )
        )

    # --- totals and factors --------------------------------------------------

    @cached_property
    def team_pitching(self) -> DataFrame:
        return team_totals.team_pitching(
            self.pitching_totals,
            team_totals.opponent_sacrifices(self.side_totals, self.codes),
        )

    def _fielding_record(self, by_position: bool) -> DataFrame:
        return team_totals.team_fielding_totals(
            self.fielding_totals,
            team_totals.team_double_plays(self.side_totals, self.codes),
            by_position,
        )

    @cached_property
    def team_fielding_totals(self) -> DataFrame:
        return self._fielding_record(by_position=False)

    @cached_property
    def park_factors(self) -> DataFrame:
        counts = parks.vouching_counts(self.park_seasons)
        return parks.factors_from_counts(self.side_totals, counts)

    @cached_property
    def league_totals(self) -> DataFrame:
        return leagues.league_totals(self.book)

    @cached_property
    def league_positions(self) -> DataFrame:
        return leagues.league_position_fielding(self.fielding_totals, self.pitching_totals)

    @cached_property
    def team_positions(self) -> DataFrame:
        return leagues.team_position_fielding(self.fielding_totals, self.pitching_totals)

    @cached_property
    def league_factors(self) -> DataFrame:
        return leagues.league_factors(
            self.league_positions, self.league_totals, leagues.club_counts(self.pitching_totals)
        )

    # --- stages: one wide row per team-season -------------------------------

    @cached_property
    def _board1(self) -> DataFrame:
        return win_shares.stage1(
            win_shares.with_league_and_park(
                self.book, self.league_totals, self.park_factors, self.codes
            )
        )

    @cached_property
    def _board2(self) -> DataFrame:
        return win_shares.stage2(
            win_shares.with_positions(
                self._board1, self.league_positions, leagues.club_counts(self.pitching_totals)
            )
        )

    @cached_property
    def _board3(self) -> DataFrame:
        return win_shares.stage3(self._board2)

    @cached_property
    def stage1(self) -> DataFrame:
        """Offence, pitching and fielding wins with the claims behind them."""
        return self._board1.select(
            F.col("Year").alias("YearID"), "Lg", "Tm", *win_shares.STAGE1_OUTPUT
        )

    @cached_property
    def stage2(self) -> DataFrame:
        """Expected plays."""
        return self._board2.select(*TEAM, *win_shares.STAGE2_OUTPUT)

    @cached_property
    def stage3(self) -> DataFrame:
        """Claim percentage per position."""
        names = [win_shares.claim_column(p) for p in win_shares.K.SHARE_POSITIONS]
        return self._board3.select(*TEAM, *names)

    @cached_property
    def positional_team_shares(self) -> DataFrame:
        return win_shares.positional_team_shares(self._board3)

    # --- players --------------------------------------------------------------

    @cached_property
    def claim_points(self) -> DataFrame:
        return claims.claim_points(
            self.tables.fielding, self.fielding_totals, self.team_pitching
        )

    @cached_property
    def shares(self) -> DataFrame:
        """Player shares by position. Claim rows are stored and read twice: for their totals
        by team and position, and one by one."""
        return claims.fielding_shares(
            self.keep(self.claim_points),
            self.positional_team_shares,
            team_totals.team_starts(self.pitching_totals),
        )

    def report(self, year: int | None = None, player: str | None = None) -> DataFrame:
        """Player shares by position, sorted; optionally one season or player.

        One season reads that season's part of the tables only.
        """
        shares = self.shares if year is None else self.of_season(year).shares
        if player is not None:
            shares = shares.where(F.col("BBRefID") == player)
        return shares.orderBy("Pos", *LEAGUE, "Tm")


class _OneSeason(FieldingWinShares):
    def __init__(self, tables: Tables, year: int, keep: Keep) -> None:
        super().__init__(tables.of_seasons(year, year, parks.REACH), keep)
        self._year = year

    @cached_property
    def park_factors(self) -> DataFrame:
        # the neighbours are there for the season's own factors; theirs would lack neighbours
        return super().park_factors.where(F.col("YearID") == self._year)
