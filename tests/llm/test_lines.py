"""Shared lines against brute force: odd rows, ties, very long texts, hot lines."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from shelfmark.llm import lines, queries
from shelfmark.llm.sql import SQL

BLANK = "[\x20\x09-\x0d]"


def key_of(line):
    bare = re.sub(f"^{BLANK}+|{BLANK}+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(rows, least_chars=40, least_docs=5):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(set)
    for row, (_, own) in enumerate(split):
        for line in own:
            holders[key_of(line)].add(row)

    def size(i):
        return (i is not None, i or 0)

    for i, own in split:
        left = []
        for line in own:
            held = holders[key_of(line)]
            last = max(size(split[row][0]) for row in held)
            if len(key_of(line)) < least_chars or len(held) < least_docs or size(i) == last:
                left.append(line)
        yield i, len(own), len(own) - len(left), "\n".join(left)


A, B, C = "A line of Some Length that is shared " * 2, "ÄÖ" * 20, "short but in many documents"
ODD = [
    (None, None), (None, A), (1, ""), (1, A + "\n" + A), (1, A + "\n" + A), (2, f" {A.upper()}\t\r\n{C}"),
    (3, f"{C}\n\x0b{A.lower()}\n{B}\nown"), (4, B), (5, f"{B}\n\n{A}"), (6, B.lower()), (7, " " + B),
    (8, B), (9, f"x\n{B}"), (9, f"{B}\ny"), (10, "\n"), (-3, f"{C}\n{B} "),
    (11, "\n".join([A] + [f"line {k} " + "z" * 40 for k in range(3000)] + [A, B])),
]
SCHEMA = "doc_id bigint, text string, file string, place int, n int, words string, h1 int, _row_file int"


@pytest.mark.parametrize("block", [1, 2, lines.BLOCK])
def test_shared_lines(spark, block):
    df = spark.createDataFrame([(i, t, "f", 1, 2, "w", 3, 4) for i, t in ODD], SCHEMA)
    got = Counter(map(tuple, lines.without_shared_lines(df, block=block).collect()))
    assert got == Counter(brute(ODD))
    assert sum(r[2] for r in got) > 8


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lines.without_shared_lines(df).count() == 0


def test_a_line_of_all_documents(spark):
    rows = [(k % 700, f"{A}\nown {k}\n{A}") for k in range(1400)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(8)
    got = Counter(map(tuple, lines.without_shared_lines(df, block=64).collect()))
    assert got == Counter(brute(rows)) and sum(n for r, n in got.items() if not r[2]) == 2


def test_bitmaps_hold_only_words_with_dropped_lines(spark):
    rows = [(k, "\n".join(["x"] * 200 + [A])) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    _, found = lines.keep_bitmaps(df)
    found = found.collect()
    assert len(found) == 4
    assert all(r.n_dropped == 1 and [(w.word, w.keep) for w in r.words] == [(3, ~(1 << 8))] for r in found)


def test_query_and_its_sql_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    df.write.parquet(f"{folder}/documents.parquet")
    got = queries.op12_line_dedup(spark, folder).collect()
    want = [
        (i, n, gone, hashlib.sha256(left.encode()).hexdigest()) for i, n, gone, left in brute(ODD)
    ]
    assert Counter(map(tuple, got)) == Counter(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert Counter(con.sql(SQL["op12_line_dedup"]).fetchall()) == Counter(want)
