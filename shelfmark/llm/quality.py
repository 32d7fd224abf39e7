"""Quality rules, judged per document and per host.

Each document is put to a few rules. The failures of each rule are counted per
host, and a host's failure rate is shrunk towards the rate of all hosts with an
empirical beta prior, so that a host of three documents is not condemned by
two. A host whose shrunk rate is over the limit of a rule is rejected, and its
verdict is joined back to its documents.

Defined results: a null text has no words and fails as too short; an empty
table gives an empty one; repeated rows are judged one by one; a null host is
no site and gets no host verdict; columns of the input beside the named ones
are carried, but one of a result's name gives way to it.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.rows import free_name
from shelfmark.llm.staging import staged

# fixed values of the contract
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SIGNALS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

# rule -> (failed by a document of these signals, does a failure reject the document itself)
RULES = {
    "short": ("{q}.n_words < 10", True),
    "repeats": ("100 * {q}.n_repeat_words > 20 * {q}.n_words", True),
    "symbols": ("2 * {q}.n_symbols > {q}.n_words", False),
    "lines": ("2 * {q}.n_dup_lines > {q}.n_lines", False),
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that are found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered = end = 0
    for start, window in enumerate(windows):
        if found[window] > 1:
            covered += start + WINDOW - max(start, end)
            end = start + WINDOW
    return covered


def text_signals(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()  # at the six blanks and no others
    seen: set[bytes] = set()
    lines = repeated = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        repeated_words(words),
        lines,
    )


@F.arrow_udf(SIGNALS)
def signals(texts: pa.Array) -> pa.Array:
    rows = [text_signals(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=list(COUNTS)
    )


def failed(rule: str, q: str) -> Column:
    return F.expr(RULES[rule][0].format(q=q))


def base_failed(q: str) -> Column:
    """Whether a document fails one of the rules that reject it by themselves."""
    result = F.lit(False)
    for rule, (_, alone) in RULES.items():
        if alone:
            result = result | failed(rule, q)
    return result


def host_failures(judged: DataFrame, host: str, q: str) -> DataFrame:
    """Per known host: documents, and failures of each rule."""
    return (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.sum(failed(r, q).cast("bigint")).alias(f"n_{r}") for r in RULES],
        )
    )


def beta_prior(hosts: DataFrame, rule: str) -> list[Column]:
    """Aggregates from which ``fitted`` makes the rule's prior."""
    n, f = F.col("n_docs").cast("double"), F.col(f"n_{rule}").cast("double")
    return [
        F.sum(f).alias(f"{rule}_f"),
        F.sum(f * f / n).alias(f"{rule}_ff"),
    ]


def fitted(n_hosts: int, n: float, nn: float, f: float, ff: float) -> tuple[float, float]:
    """Alpha and beta by moments: the spread of the hosts' rates beyond what
    drawing documents at one common rate would give.

    Hosts that do not differ more than by chance give the strongest prior there
    is, a weight of all documents.
    """
    mean = f / n
    if n_hosts < 2 or not 0 < mean < 1:
        strength = n
    else:
        # sum over hosts of n_h (rate_h - mean)^2, and its expectation
        spread = ff - n * mean * mean
        between = (spread - (n_hosts - 1) * mean * (1 - mean)) / (n - nn / n)
        strength = min(n, mean * (1 - mean) / between - 1) if between > 0 else n
        strength = max(strength, 1.0)
    return mean * strength, (1 - mean) * strength


def host_verdicts(hosts: DataFrame, limit: float = 0.5) -> DataFrame:
    """Per host: its failures, shrunk rate of each rule, and ``rejected``.

    One row of sums comes to the driver, from which the priors are made.
    """
    n = F.col("n_docs").cast("double")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum(n).alias("n"),
        F.sum(n * n).alias("nn"),
        *[c for r in RULES for c in beta_prior(hosts, r)],
    ).first()
    rejected = F.lit(False)
    rates = []
    for rule in RULES:
        alpha, beta = (0.0, 1.0)
        if sums["hosts"]:
            alpha, beta = fitted(
                sums["hosts"], sums["n"], sums["nn"], sums[f"{rule}_f"], sums[f"{rule}_ff"]
            )
        rate = (F.col(f"n_{rule}") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
        rates.append(rate.alias(f"rate_{rule}"))
        rejected = rejected | (rate > F.lit(limit))
    return hosts.select("*", *rates, rejected.alias("rejected"))


def decisions(
    docs: DataFrame, keys: list[str], text: str = "text", host: str = "source", limit: float = 0.5
) -> DataFrame:
    """``keys`` of every row of ``docs``, and whether it is ``kept``.

    Hosts are counted on the signals, and their verdicts meet those; the texts
    are read once.
    """
    names = [f"k{i}" for i in range(len(keys))]
    measured = staged(
        docs.select(
            *[F.col(k).alias(name) for k, name in zip(keys, names)],
            F.col(host).alias("host"),
            signals(F.col(text)).alias("q"),
        ),
        "signals",
    )
    return host_quality(measured, "host", "q", limit).select(*names, "kept").toDF(*keys, "kept")


def host_quality(
    measured: DataFrame, host: str = "source", q: str = "q", limit: float = 0.5
) -> DataFrame:
    """``measured`` documents (their signals in the struct ``q``) with
    ``base_failed``, the host's verdict and ``kept``.

    Host verdicts meet the documents in a join that adaptive execution can
    split, as one host may hold a third of all documents.
    """
    results = {"base_failed", "host_rejected", "kept"}
    given = measured.columns
    own = free_name(measured, "_host")
    refused = free_name(measured, "_rejected")
    hosts = host_verdicts(host_failures(measured, host, q), limit)
    verdicts = hosts.select(F.col("host").alias(own), F.col("rejected").alias(refused))
    rejected = F.coalesce(F.col(refused), F.lit(False))
    failed_alone = base_failed(q)
    return measured.join(verdicts, measured[host].eqNullSafe(verdicts[own]), "left").select(
        *[F.col(c) for c in given if c.lower() not in results],
        failed_alone.alias("base_failed"),
        rejected.alias("host_rejected"),
        (~failed_alone & ~rejected).alias("kept"),
    )
