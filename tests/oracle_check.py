"""Run registered queries against their DuckDB text: python tests/oracle_check.py [sf dir] [names...]"""

import sys
import time

sys.path.insert(0, "/root/repo")

import duckdb  # noqa: E402

TIMES = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(frame, con, sql):
    """None when equal, else a short description of the difference."""
    got_rows = [tuple(r) for r in frame.collect()]
    TIMES["spark"] = time.time()
    want = con.execute(sql)
    want_columns = [d[0] for d in want.description]
    want_types = {d[0]: str(d[1]) for d in want.description}
    want_rows = want.fetchall()
    got, got_columns = normal(got_rows, frame.columns)
    expected, columns = normal(want_rows, want_columns)
    if got_columns != columns:
        return f"columns {got_columns} != {columns}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    for name, kind in frame.dtypes:
        if kinds.get(kind, kind) != want_types[name].replace("NUMBER", "?") and kind in kinds:
            want_kind = want_types[name]
            if want_kind != kinds[kind]:
                return f"type of {name}: {kind} != {want_kind}"
        elif kind not in kinds:
            return f"type of {name}: {kind}"
    if got != expected:
        missing = [r for r in expected if r not in set(got)][:3]
        extra = [r for r in got if r not in set(expected)][:3]
        return f"rows {len(got)} vs {len(expected)}; missing {missing}; extra {extra}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from cardloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duck(folder)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracle:
                problem = compare(frame, con, oracle[name])
                status = "ok" if problem is None else "DIFF " + problem
            else:
                status = f"rows only: {len(frame.collect())}"
        except Exception as exc:  # report and go on
            status = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += status.startswith(("DIFF", "ERROR"))
        spark_time = TIMES.pop("spark", time.time()) - start
        print(f"{name:28s} {time.time() - start:6.2f}s spark {spark_time:6.2f}s {status}", flush=True)
    print("bad:", bad)
