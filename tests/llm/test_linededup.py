import hashlib

import duckdb
from pyspark.sql import functions as F
from querylark.llm import linededup


def brute(rows, n=3):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - n + 1):
            w = tuple(lines[p : p + n])
            f = first.setdefault(w, (i, p))
            if f != (i, p):
                gone |= set(range(f[1] + n if f[0] == i and p - f[1] < n else p, p + n))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_equals_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = sorted(tuple(r) for r in linededup.op5_linededup(spark, d).collect())
    assert got == sorted(con.execute(linededup.SQL).fetchall())
    want = brute(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {i: h for i, _, h in got} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}
    assert any(n for _, n, _ in got)


def test_edges(spark):
    rows = [(1, "a\nb\nc\nd", 8), (2, "x\na\nb\nc\nd\ny", 12), (3, "a\nb\nc\nd", 8), (4, None, 0), (5, "", 0), (6, "z\n" * 9, 18), (7, "a\nb", 3), (8, "q\n" * 40000 + "end", 80003), (None, "a\nb\nc", 5), (1, "a\nb\nc\nd", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("mine") for c in ("gone", "id_", "key_", "hash_", "new_", "__gone", "w", "p")})
    got = linededup.remove_repeats(docs)
    assert got.columns == docs.columns
    text = sorted(((r.doc_id or -1), r.text, r.n_chars) for r in got.where("doc_id IS NULL OR doc_id <> 4").collect())
    assert text == [(-1, "a\nb\nc", 5), (1, "a\nb\nc\nd", 8), (1, "a\nb\nc\nd", 8), (2, "x\ny", 3), (3, "", 0), (5, "", 0), (6, "z\nz\nz\n", 6), (7, "a\nb", 3), (8, "q\nq\nq\nend", 9)]
    assert linededup.remove_repeats(docs.limit(0)).count() == 0
