from tablescope.operators.types import collect_types, column_types


def test_type_zoo(spark):
    n = 120
    data = {
        "pct": [f"{i % 50}%" for i in range(n)],
        "amount": [f"${i},200.50" for i in range(n)],
        "ints": [str(i) for i in range(n)],
        "floats": [f"{i}.5" for i in range(n)],
        "iso": [f"2025-01-{(i % 28) + 1:02d}" for i in range(n)],
        "us": [f"{(i % 12) + 1}/{(i % 28) + 1}/2024" for i in range(n)],
        "dt": [f"2025-01-{(i % 28) + 1:02d} 10:{i % 60:02d}:00" for i in range(n)],
        "yn": ["yes" if i % 2 else "no" for i in range(n)],
        "mail": [f"u{i}@x.org" for i in range(n)],
        "pic": [f"https://x.org/p{i}.png" for i in range(n)],
        "doc": [f"https://x.org/d{i}.pdf" for i in range(n)],
        "link": [f"https://x.org/page/{i}" for i in range(n)],
        "phone": [f"+1 (555) 010-{i:04d}" for i in range(n)],
        "customer_id": [f"C-{i}" for i in range(n)],
        "few": [f"k{i % 7}" for i in range(n)],
        "many": [f"word{i}" for i in range(n)],
        "empty": [None] * n,
        "num79": [str(i) if i < 94 else f"x{i}" for i in range(n)],
        "num80": [str(i) if i < 96 else f"x{i}" for i in range(n)],
    }
    cols = list(data)
    rows = [tuple(data[c][i] for c in cols) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    got = {t["column_name"]: t for t in collect_types(column_types(df))}
    expect = {"pct": "Percentage", "amount": "Currency", "ints": "Integer", "floats": "Float", "iso": "Date",
              "us": "Date", "dt": "Datetime", "yn": "Boolean", "mail": "Email", "pic": "Image URL",
              "doc": "File URL", "link": "URL", "phone": "Phone Number", "customer_id": "Unique IDs",
              "few": "Category", "many": "Text", "empty": "Text", "num79": "Text", "num80": "Integer"}
    assert {c: got[c]["detected_type"] for c in cols} == expect
    assert got["mail"]["exclude_from_charts"] and got["empty"]["exclude_from_charts"]
    assert got["customer_id"]["is_id"] and not got["ints"]["is_id"]
    assert got["yn"]["is_categorical"] and got["ints"]["is_numeric"] and got["iso"]["is_date"]


def test_typed_columns(spark):
    import datetime as dt
    rows = [(1, 2.5, dt.datetime(2024, 1, 1), True, "a"), (2, 3.0, dt.datetime(2024, 1, 2, 5), False, "b")]
    df = spark.createDataFrame(rows, "total_cost long, ratio double, ts timestamp, flag boolean, s string")
    got = {t["column_name"]: t["detected_type"] for t in collect_types(column_types(df))}
    assert got == {"total_cost": "Currency", "ratio": "Float", "ts": "Datetime", "flag": "Boolean", "s": "Category"}
