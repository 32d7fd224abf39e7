"""Operators against brute force on small tables with nulls, ties and a value
that a third of all rows have."""

import hashlib
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

import shelfmark as sm

SCHEMA = "id long, part string, kind string, text string, size long, at timestamp_ntz"


def make_rows(seed, n=400):
    """Every third row has part 'p0' and text 't0'; some values are null."""
    rng = random.Random(seed)

    def maybe(value):
        return None if rng.random() < 0.1 else value

    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append(
            (
                i,
                "p0" if hot else maybe(f"p{rng.randrange(8)}"),
                maybe(f"k{rng.randrange(3)}"),
                "t0" if hot else maybe(f"t{rng.randrange(60)}"),
                maybe(rng.randrange(100)),
                maybe(datetime(2023, 12, 30) + timedelta(minutes=rng.randrange(9000))),
            )
        )
    return rows


@pytest.fixture(scope="module", params=[1, 2, None], ids=["seed1", "seed2", "empty"])
def rows(request):
    return make_rows(request.param) if request.param else []


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def result(df, *columns):
    assert df.columns == list(columns)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def total(values):
    values = [v for v in values if v is not None]
    return sum(values) if values else None


def grouped(rows, *positions):
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(r[p] for p in positions)].append(r)
    return groups


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_profile(df, rows):
    want = {
        (*k, len(g), len({r[3] for r in g} - {None}), total(r[4] for r in g))
        for k, g in grouped(rows, 1, 2).items()
    }
    got = sm.profile(df, ["part", "kind"], "text", "size")
    assert result(got, "part", "kind", "n_items", "n_distinct", "total") == want


def test_profile_of_several_content_columns(df, rows):
    want = {
        (*k, len(g), len({(r[3], r[4]) for r in g if None not in (r[3], r[4])}))
        for k, g in grouped(rows, 2).items()
    }
    got = sm.profile(df, "kind", ["text", "size"])
    assert result(got, "kind", "n_items", "n_distinct") == want


def test_composition(df, rows):
    want = set()
    for over in product((0, 1), repeat=2):
        groups = defaultdict(list)
        for r in rows:
            groups[tuple(None if o else v for o, v in zip(over, r[1:3]))].append(r)
        if not rows and all(over):
            groups[(None, None)] = []
        for k, g in groups.items():
            n = len(g) if rows else None
            want.add((*k, over[0] * 2 + over[1], n, total(r[4] for r in g)))
    got = sm.composition(df, ["part", "kind"], "size")
    got = result(got, "part", "kind", "subtotal", "n_items", "total")
    # of an empty table, a cube over no rows keeps none
    assert got == (want if rows else set())


def test_share(df, rows):
    parents = {k: len(g) for k, g in grouped(rows, 1).items()}
    want = {
        (*k, len(g), parents[k[:1]], len(g) / parents[k[:1]])
        for k, g in grouped(rows, 1, 2).items()
    }
    got = sm.share(df, ["part", "kind"], "part")
    assert result(got, "part", "kind", "n_items", "parent_items", "share") == want


def test_exact_duplicates(df, rows):
    want = {
        (sha(k[0]), len(g), min(r[0] for r in g))
        for k, g in grouped(rows, 3).items()
        if k[0] is not None and len(g) > 1
    }
    got = sm.exact_duplicates(df, "text", "id")
    assert result(got, "text_sha256", "copies", "first_id") == want


def test_duplicates_tell_columns_apart(spark):
    rows = [(1, "ab", "c"), (2, "a", "bc"), (3, None, "c"), (4, None, "c"), (5, "a", "bc")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    got = sm.exact_duplicates(df, ["x", "y"], "id")
    want = {(sha("a"), sha("bc"), 2, 2)}
    assert result(got, "x_sha256", "y_sha256", "copies", "first_id") == want


def test_duplicates_of_arrays(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sm.exact_duplicates(df, "v", "id").collect()
    assert [(list(r.v), r.copies, r.first_id) for r in got] == [([1.0, 2.0], 2, 1)]


def test_whole_texts_count(spark):
    head = "x" * 200_000
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sm.exact_duplicates(df, "text", "id")
    assert result(got, "text_sha256", "copies", "first_id") == {(sha(head + "a"), 2, 1)}


def holdings(rows):
    held = defaultdict(Counter)
    for r in rows:
        held[r[1]][r[3]] += 1
    return held


def known(texts):
    return {t: n for t, n in texts.items() if t is not None}


def want_summary(rows):
    held = holdings(rows)
    want = set()
    for part, texts in held.items():
        others = set().union(*(held[p] for p in held if p != part))
        n_items, texts = sum(texts.values()), known(texts)
        sole = set(texts) - others
        want.add(
            (
                part,
                n_items,
                len(texts),
                len(sole),
                sum(texts[t] for t in sole),
                len(texts) - len(sole),
            )
        )
    return want


def want_shared(rows, anchors):
    held = holdings(rows)
    pairs = {
        (a, b, len(known(held[a]).keys() & held[b].keys()))
        for a in anchors
        for b in list(held)
        if a != b and a in held
    }
    return {p for p in pairs if p[2]}


def want_depth(rows):
    held = holdings(rows)
    found = defaultdict(lambda: [0, 0])
    for text in set().union(*held.values()) - {None}:
        n = sum(text in texts for texts in held.values())
        found[n][0] += 1
        found[n][1] += sum(texts[text] for texts in held.values())
    return {(n, *v) for n, v in found.items()}


SUMMARY = ("part", "n_items", "n_distinct", "n_sole", "sole_items", "n_shared")


def test_overlap(df, rows):
    got = sm.overlap_summary(df, "part", "text")
    assert result(got, *SUMMARY) == want_summary(rows)
    got = sm.overlap_depth(df, "part", "text")
    assert result(got, "n_parts", "n_contents", "n_items") == want_depth(rows)
    anchors = ["p0", "p3", "nowhere", None]
    got = sm.overlap_with(df, "part", "text", anchors)
    assert result(got, "anchor", "other", "n_shared") == want_shared(rows, anchors)


def test_anchors_of_a_table(spark, df):
    # named twice, one of them no part at all
    names = [r[0] for r in df.select("part").distinct().collect()][:2] + [None]
    table = spark.createDataFrame([(n, 1) for n in [*names, names[0], "nobody"]], "name string, x int")
    listed = sm.overlap_with(df, "part", "text", names)
    assert sorted(map(repr, sm.overlap_with(df, "part", "text", table).collect())) == sorted(
        map(repr, listed.collect())
    )
    assert df.isEmpty() or listed.count() > 0


def test_overlap_without_anchors_is_empty(df):
    assert sm.overlap_with(df, "part", "text", []).count() == 0


@pytest.mark.parametrize("reopened", [False, True])
def test_holdings(spark, df, rows, reopened, tmp_path):
    if reopened:
        sm.Holdings.write(df, "part", "text", str(tmp_path / "index"))
        held = sm.Holdings.open(spark, str(tmp_path / "index"))
    else:
        held = sm.Holdings.write(df, "part", "text")
    assert result(held.summary(), *SUMMARY) == want_summary(rows)
    assert result(held.depth(), "n_parts", "n_contents", "n_items") == want_depth(rows)
    got = held.shared_with(["p1", None])
    assert result(got, "anchor", "other", "n_shared") == want_shared(rows, ["p1", None])
    want = set()
    for (text,), g in grouped(rows, 3).items():
        parts = [r[1] for r in g]
        if text is not None and len(parts) > 1:
            want.add((sha(text), len(parts), len(set(parts))))
    assert result(held.copies(), "text_sha256", "copies", "n_parts") == want


FLAG_SCHEMA = "key string, other_key string, good int, bad int"


def make_flags(seed, n=150):
    rng = random.Random(seed)
    return [
        (
            "t0" if i % 3 == 0 else rng.choice([None, f"t{rng.randrange(90)}"]),
            "p0",
            rng.choice([None, 0, 1]),
            1,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("flags", [make_flags(5), []], ids=["flags", "none"])
def test_coverage_gap_and_flag_rate(spark, df, rows, flags, fold):
    other = spark.createDataFrame(flags, FLAG_SCHEMA)
    there = {f[0] for f in flags} - {None}
    want = {
        (*k, len(g), sum(r[3] not in there for r in g)) for k, g in grouped(rows, 1, 2).items()
    }
    got = sm.coverage_gap(df, other, "text", ["part", "kind"], other_on="key", fold=fold)
    assert result(got, "part", "kind", "n_items", "n_missing") == want

    want = set()
    for k, g in grouped(rows, 2).items():
        pairs = [f for r in g for f in flags if r[3] is not None and f[0] == r[3]]
        if pairs:
            want.add((*k, len(pairs), total(f[2] for f in pairs), len(pairs)))
    got = sm.flag_rate(df, other, "text", "kind", ["good", "bad"], flags_on="key", fold=fold)
    assert result(got, "kind", "n_flagged", "good", "bad") == want


def test_two_join_columns(spark, df, rows):
    other = spark.createDataFrame(make_flags(6), FLAG_SCHEMA)
    there = {(f[1], f[0]) for f in make_flags(6) if f[0] is not None}
    want = {
        (*k, len(g), sum((r[1], r[3]) not in there for r in g))
        for k, g in grouped(rows, 2).items()
    }
    got = sm.coverage_gap(df, other, ["part", "text"], "kind", other_on=["other_key", "key"])
    assert result(got, "kind", "n_items", "n_missing") == want


def start(at, unit):
    if unit == "week":
        return (at - timedelta(days=at.weekday())).date()
    if unit == "quarter":
        return date(at.year, (at.month - 1) // 3 * 3 + 1, 1)
    return {
        "second": at.replace(microsecond=0),
        "minute": at.replace(second=0, microsecond=0),
        "hour": at.replace(minute=0, second=0, microsecond=0),
        "day": at.date(),
        "month": date(at.year, at.month, 1),
        "year": date(at.year, 1, 1),
    }[unit]


def want_growth(rows, unit, position=None):
    counts = Counter(
        (None if position is None else r[position], start(r[5], unit))
        for r in rows
        if r[5] is not None
    )
    want = set()
    for (group, at), n in counts.items():
        upto = sum(m for (g, a), m in counts.items() if g == group and a <= at)
        want.add((at, n, upto) if position is None else (group, at, n, upto))
    return want


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "week", "quarter", "year"])
def test_growth(df, rows, unit):
    got = sm.growth(df, "at", unit)
    assert result(got, "period", "n_items", "total_items") == want_growth(rows, unit)
    got = sm.growth(df, "at", unit, "part")
    assert result(got, "part", "period", "n_items", "total_items") == want_growth(rows, unit, 1)


def test_growth_keeps_zoneless_times(spark):
    # 02:30 did not exist in this zone on that day; in October 02:30 came twice
    rows = [
        (datetime(2024, 3, 31, 2, 30, 1, 250_000),),
        (datetime(2024, 3, 31, 3, 5),),
        (datetime(2024, 10, 27, 2, 30),),
    ]
    df = spark.createDataFrame(rows, "at timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for unit in ("second", "minute", "hour"):
            got = {r.period for r in sm.growth(df, "at", unit).collect()}
            assert got == {start(r[0], unit) for r in rows}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_growth_of_zoned_times_and_dates(spark):
    df = spark.sql("select timestamp'2024-02-29 10:59:59' as t, date'2024-02-29' as d")
    assert sm.growth(df, "t", "hour").first().period == datetime(2024, 2, 29, 10)
    assert sm.growth(df, "t", "month").first().period == date(2024, 2, 1)
    assert sm.growth(df, "d", "day").first().period == date(2024, 2, 29)
    with pytest.raises(TypeError):
        sm.growth(df, "d", "hour")
    with pytest.raises(ValueError):
        sm.growth(df, "t", "fortnight")


def test_concentration(df, rows):
    counts = {k[0]: len(g) for k, g in grouped(rows, 3).items()}
    want = {
        (
            text,
            n,
            1 + sum(m > n for m in counts.values()),
            sum(m for m in counts.values() if m >= n),
        )
        for text, n in counts.items()
    }
    got = sm.concentration(df, "text")
    assert result(got, "text", "n_items", "rank", "cum_items") == want

    want = {
        (
            n,
            sum(m == n for m in counts.values()),
            sum(m >= n for m in counts.values()),
            sum(m for m in counts.values() if m >= n),
        )
        for n in counts.values()
    }
    got = sm.concentration_curve(df, "text")
    assert result(got, "n_items", "n_values", "cum_values", "cum_items") == want


def test_arrivals_of_a_table(df, rows):
    counts = Counter(
        (start(r[5], "hour"), r[1]) for r in rows if r[5] is not None
    )
    want = {(at, at + timedelta(hours=1), part, n) for (at, part), n in counts.items()}
    got = sm.arrivals(df, "at", "1 hour", by="part")
    assert result(got, "window_start", "window_end", "part", "n_items") == want


def test_report_columns_are_protected(df):
    clash = df.withColumnRenamed("part", "N_Items")
    for call in (
        lambda: sm.profile(clash, "N_Items", "text"),
        lambda: sm.composition(clash, "N_Items"),
        lambda: sm.concentration(clash, "N_Items"),
        lambda: sm.growth(clash, "at", "day", "N_Items"),
        lambda: sm.share(df, ["part"], "part"),
        lambda: sm.exact_duplicates(df, [], "id"),
        lambda: sm.exact_duplicates(df.withColumnRenamed("size", "copies"), "copies", "id"),
    ):
        with pytest.raises(ValueError):
            call()


def test_flag_rate_keeps_every_digit_of_decimals(spark):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "k int, g string")
    flags = spark.sql("select 1 as k, cast(0.12345678 as decimal(18,8)) as cost")
    got = sm.flag_rate(items, flags, "k", "g", "cost")
    plain = items.join(flags, "k").groupBy("g").agg({"cost": "sum"}).first()
    assert got.first().cost == plain[1] and dict(got.dtypes)["cost"] == "decimal(28,8)"


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 1)], "n_items int, n_flagged int")
    with pytest.raises(ValueError):
        sm.concentration_curve(df, "n_items")
    with pytest.raises(ValueError):
        sm.flag_rate(df, df, "n_items", "n_items", "n_flagged")
    with pytest.raises(ValueError):
        sm.flag_rate(df, df, "n_flagged", "n_flagged", ["n_items", "n_items"])


def test_open_refuses_what_is_no_index(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        sm.Holdings.open(spark, str(tmp_path / "t"))
