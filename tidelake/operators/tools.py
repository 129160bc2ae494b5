"""What an assistant may call: named tools over a lake, with their help."""

from __future__ import annotations

import dataclasses
import inspect
from collections.abc import Callable

from tidelake import paths
from tidelake.catalog import Lake
from tidelake.operators.browse import TOOL_ROWS
from tidelake.plans.lake_sql import lake_sql
from tidelake.sources.line_protocol import line_protocol
from tidelake.sources.points import to_table


@dataclasses.dataclass
class Tools:
    """Tools over one lake, for one user's grants (patterns of database and table); results are lists of dicts.

    Results have at most TOOL_ROWS rows: tools answer an assistant, not a pipeline. Without `writes` nothing is written.
    """

    lake: Lake
    grants: list[tuple[str, str]] | None = None
    writes: bool = False

    def list_databases(self) -> list[dict]:
        """Names of the databases."""
        return self._rows("SHOW DATABASES")

    def list_measurements(self, database: str) -> list[dict]:
        """A database's measurements with their folders, files and sizes."""
        return self._rows(f'SHOW TABLES FROM "{named(database)}"')

    def describe_measurement(self, database: str, measurement: str) -> list[dict]:
        """A measurement's columns: whether they are time, tags or fields, and their types."""
        return self._rows(f'DESCRIBE "{named(database)}"."{named(measurement)}"')

    def sample_data(self, database: str, measurement: str, rows: int = 10) -> list[dict]:
        """The newest rows of a measurement."""
        return self._rows(f'SELECT * FROM "{named(database)}"."{named(measurement)}" ORDER BY time DESC LIMIT {min(max(int(rows), 0), TOOL_ROWS)}')

    def query(self, sql: str, database: str = "main") -> list[dict]:
        """The rows of one query; tables are db.name, or name in the stated database."""
        return self._rows(sql, database)

    def write_data(self, database: str, lines: str) -> list[dict]:
        """Writes line protocol; gives the rows written of each measurement."""
        if not self.writes:
            raise PermissionError("this assistant may not write")
        spark, out = self.lake.spark, []
        points = paths.stored(line_protocol(spark.createDataFrame([(lines,)], "value string")), "points")
        for r in points.select("measurement").distinct().collect():
            table, tags = to_table(points, r["measurement"])
            self.lake.write(table, named(database), r["measurement"], tags)
            out.append({"measurement": r["measurement"], "rows": table.count()})
        return out

    def help(self) -> list[dict]:
        """All tools: their names, arguments and what they do."""
        return [{"tool": name, "arguments": ", ".join(inspect.signature(f).parameters), "help": inspect.getdoc(f)} for name, f in self.every().items()]

    def every(self) -> dict[str, Callable]:
        return {n: getattr(self, n) for n in ("list_databases", "list_measurements", "describe_measurement", "sample_data", "query", "write_data", "help")}

    def call(self, tool: str, **arguments) -> list[dict]:
        if tool not in self.every():
            raise ValueError(f"no tool {tool!r}; there are {', '.join(self.every())}")
        return self.every()[tool](**arguments)

    def _rows(self, sql: str, database: str = "main") -> list[dict]:
        return [r.asDict(True) for r in lake_sql(self.lake, sql, database, self.grants).limit(TOOL_ROWS).collect()]


def named(name: str) -> str:
    if '"' in name or "`" in name:
        raise ValueError(f"no valid name: {name!r}")
    return name
