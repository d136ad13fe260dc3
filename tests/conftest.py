import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", f"{work}/warehouse").config("spark.checkpoint.dir", f"file://{work}/shared").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB rows of a query over given tables: duck(sql, name=rows of tuples with their types)."""
    import duckdb

    def run(sql, **tables):
        con = duckdb.connect()
        for name, (columns, rows) in tables.items():
            con.execute(f"CREATE TABLE {name} ({columns})")
            if rows:
                con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        return [dict(zip(names, r, strict=True)) for r in found.fetchall()]

    return run


def same(frame, rows):
    """A DataFrame's rows and a list of dicts, whatever their order."""
    key = lambda d: sorted((k, str(v)) for k, v in d.items())
    return sorted(key(r.asDict()) for r in frame.collect()) == sorted(map(key, rows))
