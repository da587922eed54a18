"""Independent SQL statements of every job, for a second engine to run.

Each is one statement over the order tables. It starts with the derived base
tables and states the job again in SQL, with its own structure: no code or
expression of the Spark jobs is used, except the derivation of the inputs.
"""

from __future__ import annotations

from oracle import fielding, pitching, ratings


def statements() -> dict[str, str]:
    return {**pitching.statements(), **ratings.statements(), **fielding.statements()}
