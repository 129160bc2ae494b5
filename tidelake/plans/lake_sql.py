"""SQL over a lake: names are resolved in the parsed plan, and bounds on time become pruned folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from tidelake import paths
from tidelake.catalog import Lake
from tidelake.operators.browse import egress
from tidelake.plans import safety
from tidelake.plans.dialect import query, translate
from tidelake.plans.tokens import tokens

Bounds = tuple[datetime | None, datetime | None]


#: The database of the catalog's own tables.
CATALOG = "information_schema"


def lake_sql(lake: Lake, sql: str, default: str = "main", grants: list[tuple[str, str]] | None = None) -> DataFrame:
    """The result of one query over measurements `db.name`, or `name` in the default database; across databases too.

    Anything but a query is refused (safety.Refused), and so are tables that no grant covers, if grants are given.
    Conditions on a measurement's time, also relative to now, are taken from the optimised plan; they prune folders
    by hour before the query is planned again. They only prune: the query's own conditions stay as they are.

    SHOW DATABASES, SHOW TABLES (or MEASUREMENTS) [FROM db] and DESCRIBE [db.]name are answered too, and so are the
    tables schemata, tables and columns of information_schema; they show what the grants cover.
    """
    if (shown := catalog_query(sql, default)) is not None:
        sql = shown
    text = translate(sql).strip().rstrip(";")
    refs = [(start, stop, *named(parts, default)) for start, stop, parts in references(lake.spark, text)]
    tables = sorted({(db, name) for _, _, db, name in refs if db != CATALOG})
    if grants is not None and (hidden := safety.allowed(grants, tables)):
        raise safety.Refused(f"no access to {', '.join('.'.join(t) for t in hidden)}")
    whole = bound(lake, text, refs, {}, True, grants)
    return egress(bound(lake, text, refs, folder_bounds(whole, {t: [lake.path(*t, tier) for tier in lake.tiers()] for t in tables}), False, grants))


def catalog_query(sql: str, default: str) -> str | None:
    """The query over the catalog's tables that a SHOW or DESCRIBE stands for; None for other SQL."""
    words = tokens(sql.strip().rstrip(";"))
    said = [t.text.upper() for t in words]
    if said == ["SHOW", "DATABASES"]:
        return "SELECT schema_name AS database FROM information_schema.schemata ORDER BY 1"
    if said[:2] in (["SHOW", "TABLES"], ["SHOW", "MEASUREMENTS"]) and (len(said) == 2 or len(said) == 4 and said[2] == "FROM"):
        db = words[3].text.strip('`"') if len(said) == 4 else default
        where = literal_of(db)
        return f"SELECT table_schema AS database, table_name, storage_path, file_count, round(total_bytes / 1048576, 2) AS total_size_mb FROM information_schema.tables WHERE table_schema = {where} ORDER BY 2"
    if said[:1] in (["DESCRIBE"], ["DESC"]) and len(said) in (2, 4):
        db, name = (words[1].text if len(said) == 4 else default).strip('`"'), words[-1].text.strip('`"')
        return f"SELECT column_name, column_kind, data_type FROM information_schema.columns WHERE table_schema = {literal_of(db)} AND table_name = {literal_of(name)} ORDER BY ordinal_position"
    return None


def literal_of(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def catalog_table(lake: Lake, name: str, grants: list[tuple[str, str]] | None) -> DataFrame:
    """A table of the catalog, made from folders and properties; of what the grants cover, if given."""
    seen = lambda db, m: grants is None or not safety.allowed(grants, [(db, m)])
    held = [(db, m) for db in lake.databases() if not db.startswith("_") for m in lake.measurements(db) if seen(db, m)]
    spark = lake.spark
    if name == "schemata":
        every = sorted({db for db, _ in held} | ({db for db in lake.databases() if not db.startswith("_")} if grants is None else set()))
        return spark.createDataFrame([("lake", db) for db in every], "catalog_name string, schema_name string")
    if name == "tables":
        rows = []
        for db, m in held:
            found = [(t, f) for t in lake.tiers() if (f := paths.files(spark, lake.path(db, m, t)))]
            rows.append(("lake", db, m, "BASE TABLE", lake.path(db, m), "+".join(t for t, _ in found), sum(len(f) for _, f in found), sum(x[1] for _, f in found for x in f)))
        return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string, storage_path string, tier string, file_count long, total_bytes long")
    if name == "columns":
        rows = []
        for db, m in held:
            properties = lake.properties(db, m)
            for i, (c, kind) in enumerate(properties["columns"].items(), 1):
                rows.append((db, m, c, i, "time" if c == "time" else "tag" if c in properties["tags"] else "field", kind))
        return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, column_kind string, data_type string")
    raise LookupError(f"no table {CATALOG}.{name}")


def named(parts: tuple[str, ...], default: str) -> tuple[str, str]:
    return (parts[-2] if len(parts) > 1 else default), parts[-1]


def references(spark, text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first, last, name's parts) of each reference to a table that is no CTE there: places in the text, which is checked."""
    return sorted(safety.validated(spark, text).relations)


def bound(lake: Lake, text: str, refs: list[tuple[int, int, str, str]], bounds: dict[tuple[str, str], Bounds], planned: bool = False, grants: list[tuple[str, str]] | None = None) -> DataFrame:
    """The query over views of the measurements, each read within its bounds; planned: to look at its plan only."""
    views = {}
    for _, _, db, name in refs:
        if (db, name) not in views:
            views[db, name] = view = f"lake_{uuid.uuid4().hex}"
            rows = catalog_table(lake, name, grants) if db == CATALOG else lake.read(db, name, *bounds.get((db, name), (None, None)), planned=planned)
            rows.createOrReplaceTempView(view)
    for start, stop, db, name in reversed(refs):
        # a reference without an alias is still called by its name
        rest = text[stop + 1 :]
        text = f"{text[:start]}(SELECT * FROM {views[db, name]}){'' if aliased(rest) else f' AS `{name}`'}{rest}"
    out = query(lake.spark, text)
    for view in views.values():
        lake.spark.catalog.dropTempView(view)
    return out


#: Words that may follow a table and are no alias of it.
FOLLOWS = set("where group order having limit offset join inner left right full outer cross natural semi anti lateral on using union intersect except minus window tablesample pivot unpivot sort cluster distribute".split())


def aliased(rest: str) -> bool:
    rest = rest.lstrip()
    word = rest.split(None, 1)[0].lower() if rest.strip() else ""
    word = word.strip("(),;")
    return bool(word) and (rest[0].isalpha() or rest[0] in "_`") and word not in FOLLOWS


def folder_bounds(df: DataFrame, places: dict[tuple[str, str], list[str]]) -> dict[tuple[str, str], Bounds]:
    """For each table the [start, end) of time outside which no scan of it in df's optimised plan needs rows."""
    spark = df.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath().rstrip("/")
    of = {path(p): table for table, ps in places.items() for p in ps}
    found: dict[tuple[str, str], list[Bounds]] = {}
    for relation, conditions in scans(df._jdf.queryExecution().optimizedPlan()):
        if relation is None:
            return {}  # a subquery in an expression, whose scans are not seen here
        roots = relation.relation().location().rootPaths()
        files = [roots.apply(i).toUri().getPath().rstrip("/") for i in range(roots.size())]
        tables = {t for f in files for p, t in of.items() if f == p or f.startswith(f"{p}/")}
        output = relation.output()
        ids = [a.exprId().id() for a in (output.apply(i) for i in range(output.size())) if a.name() == "time"]
        limits = [conditions[i] for i in ids if i in conditions]
        for t in tables:
            found.setdefault(t, []).append(limits[0] if limits else (None, None))
    out = {}
    for t, limits in found.items():
        starts, ends = zip(*limits)
        out[t] = (None if None in starts else min(starts), None if None in ends else max(ends))
    return out


def scans(plan, conditions: dict[int, Bounds] | None = None) -> Iterator[tuple]:
    """(scan of files, bounds by column id) of a plan's leaves; (None, {}) for a subquery in an expression.

    Bounds hold through filters and projections alone: Catalyst has pushed down by then what goes further.
    """
    conditions = conditions or {}
    if plan.subqueries().size():
        yield None, {}
    name = plan.nodeName()
    if name == "LogicalRelation" or name.startswith("Relation"):
        if hasattr(plan.relation(), "location"):
            yield plan, conditions
        return
    if name == "Filter":
        conditions = merged(conditions, conjuncts(plan.condition()))
    elif name != "Project":
        conditions = {}
    children = plan.children()
    for i in range(children.size()):
        yield from scans(children.apply(i), conditions)


def merged(a: dict[int, Bounds], b: list[tuple[int, Bounds]]) -> dict[int, Bounds]:
    out = dict(a)
    for i, (start, end) in b:
        s, e = out.get(i, (None, None))
        out[i] = (max(filter(None, (s, start)), default=None), min(filter(None, (e, end)), default=None))
    return out


TURNED = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "EqualTo": "EqualTo"}


def conjuncts(e) -> list[tuple[int, Bounds]]:
    """(column id, bounds) of the comparisons of a timestamp column with a constant that a condition demands."""
    kind = type_name(e)
    if kind == "And":
        return conjuncts(e.left()) + conjuncts(e.right())
    if kind not in TURNED:
        return []
    left, right = e.left(), e.right()
    if type_name(left) == "Literal":
        left, right, kind = right, left, TURNED[kind]
    if type_name(left) != "AttributeReference" or type_name(right) != "Literal" or left.dataType().typeName() != "timestamp_ntz" or right.value() is None:
        return []
    t = datetime(1970, 1, 1) + timedelta(microseconds=right.value())
    after = t + timedelta(microseconds=1)
    limits = {"GreaterThan": (t, None), "GreaterThanOrEqual": (t, None), "LessThan": (None, t), "LessThanOrEqual": (None, after), "EqualTo": (t, after)}
    return [(left.exprId().id(), limits[kind])]


def type_name(e) -> str:
    return e.getClass().getSimpleName()
