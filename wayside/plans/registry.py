"""All queries of the engine by name."""

from wayside.plans import catalogue, core, further, more, rows

ALL = {**core.QUERIES, **more.QUERIES, **catalogue.QUERIES, **further.QUERIES, **rows.QUERIES}
QUERIES = {name: f for name, (f, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
