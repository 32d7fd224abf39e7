"""The operators for training data against brute force on small tables, with
nulls, empty and long texts, repeated rows, ties, clashing columns, no rows."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shelfmark.llm import (
    chat,
    counts,
    decontaminate,
    html,
    licences,
    packing,
    quality,
    queries,
    simhash,
    suffixes,
)
from shelfmark.llm.components import _large_star, _small_star, components
from shelfmark.llm.staging import staged
from shelfmark.sources.shared import shared_folder

SMALL = "/root/testdata/sf0.001"
ODD = [
    (None, None), (1, ""), (2, " \n\t"), (3, "one"), (3, "one"), (4, "a b c d e f g h i j k l m n"),
    (5, "x " * 5000), (6, "ÀÉ ß 漢字 \U0001f600 " * 40), (7, "A b C d e f g h i j K l m n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src", "n", 0) for i, t in ODD]
    schema = "doc_id bigint, text string, source string, n_words string, kept int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- 1 quality -----------------------------------------------------------------


def brute_signals(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {
        k + j
        for k in range(len(words) - 4)
        if windows[tuple(words[k : k + 5])] > 1
        for j in range(5)
    }
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


def test_signals(documents, odd):
    for df in (documents, odd):
        got = df.select("text", quality.signals("text").alias("q")).collect()
        for r in got:
            assert tuple(r.q)[:5] == brute_signals(r.text)


def test_host_verdicts(spark):
    bad = [("bad", "x", 1)] * 40
    good = [(f"h{k % 8}", "a b c d e f g h i j k l", 0) for k in range(400)]
    few = [("few", "x", 1)] * 2 + [(None, "x", 1)] * 3
    df = spark.createDataFrame(bad + good + few, "source string, text string, kept int")
    df = df.withColumn("q", quality.signals("text"))
    verdicts = {r.source: r.host_rejected for r in quality.host_quality(df).collect()}
    assert verdicts["bad"] and not verdicts["h1"] and not verdicts[None]
    assert quality.host_quality(df.where("false")).count() == 0


def test_host_rejects_its_good_documents_too(spark):
    rows = [("bad", "x")] * 40 + [("bad", "a b c d e f g h i j k l")]
    rows += [("good", "a b c d e f g h i j k l")] * 100
    df = spark.createDataFrame(rows, "source string, text string")
    got = quality.decisions(df.withColumn("kept", df.source), ["source"]).collect()
    assert Counter(r.source for r in got if r.kept) == {"good": 100} and len(got) == 141


# --- 2 chat --------------------------------------------------------------------


@pytest.mark.parametrize("block", [None, 1, 2, chat.BLOCK])
def test_chat_read_back(spark, block):
    how = {"local": block is not None, "block": block or chat.BLOCK}
    rows = [
        (1, 0, "user", "<|im_end|>\\n\\ <|im_start|>"), (1, 1, "assistant", "a<"),
        (2, 1, "assistant", "|>\n"), (2, 0, None, None), (None, None, "user", "x"),
        (3, 0, "assistant", ""), (3, 1, "assistant", "\n"), (3, 1, "a\nb<|", "t"),
        (4, 0, "assistant", "<|é" * 1_000_000), (4, 1, "user", "x"), (4, 1, "user", "x"),
    ] + [(9, k, "assistant" if k % 2 else "user", f"turn {k} \\") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    formatted = chat.format_conversations(df, **how)
    assert block is None or formatted.agg({"n_turns": "max"}).first()[0] <= block
    rows_back = chat.read_back(formatted).collect()
    got = {r.conv_id: r for r in rows_back}
    assert len(got) == len(rows_back)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        own = "".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))
        loss = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        r = got[conv]
        assert r.turns_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.rewritten_at) == (len(turns), len(loss), -1)
        assert r.formatted_chars == len(chat.chat_template([t[1:] for t in sorted(turns)]))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.where("false"), **how)).count() == 0


def test_template_that_rewrites_history():
    def last_only(turns):
        return "".join(t[:3] if k + 1 < len(turns) else t for k, (_, t) in enumerate(turns))

    turns = [("user", "long text"), ("assistant", "answer")]
    assert chat.located(last_only, turns)[2] == 1
    assert chat.located(lambda ts: "".join(t for _, t in ts), turns)[1] == [(0, 9, 0, 9), (9, 15, 9, 15)]


def looking_back():
    """Templates that are not local, the turn at which they rewrite, or -1. They are
    made here since workers do not know this module."""

    def opened(turns):
        return "<s>" + "".join(t for _, t in turns)

    def opened_by_the_first(turns):
        return "<s>" * bool(turns) + "".join(t for _, t in turns)

    def numbered(turns):
        return "".join(f"<{k}>{t}" for k, (_, t) in enumerate(turns))

    def only_the_last(turns):
        return "".join(t[:3] if k + 1 < len(turns) else t for k, (_, t) in enumerate(turns))

    return [(opened, -1), (opened_by_the_first, -1), (numbered, -1), (only_the_last, 1)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_results_do_not_depend_on_partitions(spark, parts):
    rows = [(c, k, "user", f"text {c}") for c in range(40) for k in range(c % 5 + 1)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for template, rewritten in looking_back():
            got = chat.format_conversations(df, template=template).collect()
            assert len(got) == 40 and all(r.whole for r in got)
            for r in got:
                assert r.rewritten_at == (-1 if r.n_turns == 1 else rewritten)
                texts = [r.formatted[s.text_start : s.text_end] for s in r.spans]
                assert texts == [f"text {r.conv_id}"] * (r.n_turns if r.rewritten_at < 0 else 0)
            for block in (1, 2, chat.BLOCK):
                with pytest.raises(Exception, match="NotLocal"):
                    chat.format_conversations(df, template=template, local=True, block=block).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_query_with_its_own_conversation(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list, {-1: [("user", said), ("assistant", said)]})
    for r in rows:
        turns[r.conv_id].append((r.role, r.text))
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, SMALL).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- 3 simhash -----------------------------------------------------------------


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42)
        for k in range(max(1, len(words) - 3))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_simhash(documents, odd):
    for df in (documents, odd):
        rows = texts_of(df)
        prints = [brute_print(t) for _, t in rows]
        label = brute_components(prints, 4)
        least = {}
        for (i, _), root in zip(rows, label):
            if i is not None:
                least[root] = min(i, least.get(root, i))
        want = Counter(
            (i, f"{p:016x}", least.get(root)) for (i, _), p, root in zip(rows, prints, label)
        )
        assert Counter(map(tuple, simhash.simhash_components(df).collect())) == want


def test_triples_lie_in_every_four_positions():
    from itertools import combinations

    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_hot_keys_give_the_same_components(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    near = [base ^ sum(1 << int(b) for b in rng.integers(0, 63, 3)) for _ in range(300)]
    far = [int(x) for x in rng.integers(0, 1 << 62, 300)]
    df = spark.createDataFrame([(x,) for x in {*near, *far}], "fp bigint")
    cold = {tuple(r) for r in components(simhash.links(df)).collect()}
    hot = {tuple(r) for r in components(simhash.links(df, most_in_key=20)).collect()}
    assert cold == hot and len(cold) > 200


# --- 4 suffixes ----------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("ranges", [8, 61])
def test_repeats(spark, odd, ranges, monkeypatch):
    rng = np.random.default_rng(1)
    words = ["ab", "é", "aa", "bé a", "b"]
    base = [" ".join(rng.choice(words, 200)) for _ in range(3)]
    rows = texts_of(odd) + [(9, "z" * 199), (10, "y" * 200), (11, "y" * 200), (12, "ab" * 300)]
    for k in range(30):
        text, at = base[k % 3], int(rng.integers(300))
        rows.append((20 + k, " ".join(rng.choice(words, 30)) + text[at : at + int(rng.integers(400))]))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = Counter((i, *r) for (i, _), r in zip(rows, brute_repeats([t for _, t in rows], 200)))
    monkeypatch.setattr(type(df), "repartitionByRange", ranged(df, ranges))
    got = suffixes.remove_repeats(df)
    assert Counter(map(tuple, got.collect())) == want
    if ranges == 8:
        assert suffixes.remove_repeats(df.where("false")).count() == 0


def ranged(df, n):
    """``repartitionByRange`` into ``n`` ranges that are not put together again."""
    plain = type(df).repartitionByRange
    return lambda df, *columns: plain(df, n, *columns)


def test_passage_in_a_third_of_all_documents(spark, monkeypatch):
    rng = np.random.default_rng(3)

    def words(n):
        return " ".join(map(str, rng.integers(100, 1000, n)))

    passage = words(150)
    rows = [
        (k, words(40) + (passage if k % 3 == 0 else words(100)) + words(40)) for k in range(300)
    ]
    rows += [(300 + k, words(30) + passage[150 + k : 450 + k]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = Counter((i, *r) for (i, _), r in zip(rows, brute_repeats([t for _, t in rows], 200)))
    monkeypatch.setattr(type(df), "repartitionByRange", ranged(df, 37))
    assert Counter(map(tuple, suffixes.remove_repeats(df).collect())) == want


def test_long_texts_are_parsed_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 9000, dtype=np.uint8).tobytes()
    monkeypatch.setattr(suffixes, "BUFFER", 1 << 12)
    found = suffixes.phrases([text, b"", text[:5000]], 200, 64)
    for own, size in zip(found, (9000, 0, 5000)):
        places = [at + k for _, _, at, n, _ in own for k in range(n)]
        assert sorted(places) == list(range(max(0, size - 199)))


# --- 5 decontamination ---------------------------------------------------------


def brute_contamination(docs, items):
    def words(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    windows = defaultdict(set)
    for i, text in items:
        own = words(text)
        for k in range(max(1, len(own) - 12) if own else 0):
            windows[tuple(own[k : k + 13])].add(i)
    for i, text in docs:
        own, hit, held = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                found = windows.get(tuple(own[k : k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    held |= found
        names = ",".join(sorted(str(x) for x in held))
        digest = hashlib.sha256(names.encode()).hexdigest()
        yield i, len(own), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(own)


def test_contamination(spark, documents, odd):
    items = [(k, t) for k, t in enumerate(["one", "", None, "A-b c/d e f g h i j k l m n", "漢字"])]
    items += [(7, "x " * 14), (8, "x " * 14)]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.contamination(odd.select("doc_id", "text"), benchmark).collect()
    assert Counter(map(tuple, got)) == Counter(brute_contamination(texts_of(odd), items))
    real = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [tuple(r) for r in real.select("item_id", "text").collect()]
    got = decontaminate.contamination(documents.select("doc_id", "text"), real).collect()
    assert Counter(map(tuple, got)) == Counter(brute_contamination(texts_of(documents), items))
    none = decontaminate.contamination(odd.select("doc_id", "text"), benchmark.where("false"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(ODD)


# --- 6 html --------------------------------------------------------------------


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_pages_of_the_table(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op6_html_text(spark, folder).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        from html import unescape

        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", article[1])).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_layouts_held_out(spark):
    import random

    table = spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id")
    pages = [r.html for r in table.collect()]
    tagger = html.Crf(2).fit(*html.training_pages(pages[:30], 4))
    right = total = 0
    for k, page in enumerate(pages[30:]):
        blocks = html.leaf_blocks(page)
        own = html.marked_labels(blocks)
        main = [(b.within.tag, b.text) for b, y in zip(blocks, own) if y][:12]
        other = [b.text for b, y in zip(blocks, own) if not y]
        laid = html.leaf_blocks(html.laid_out(main, other, random.Random(99_000 + k)))
        found = tagger.decode(html.features(laid))
        right += sum(a == (b.gold == "main") for a, b in zip(found, laid))
        total += len(laid)
    assert right / total > 0.95


TITLE = "The bridge is open again"
PROSE = (
    "After three years of work the old bridge was opened on Monday. Hundreds of people came to see it.",
    "The mayor said that it had cost less than planned, and thanked all who had taken part.",
)
BODY = f"<h1>{TITLE}</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p>"
BY_HAND = [
    f"<html><body><table><tr><td colspan=2>Town News</td></tr><tr><td><a href=/a>Home</a><br><a href=/b>Sport</a><br>"
    f"<a href=/c>Weather</a></td><td>{BODY}</td></tr><tr><td colspan=2>Copyright 2020 Town News</td></tr></table>",
    f"<html><body>{BODY}</body></html>",
    f"<div id=top><a href=/>Home</a> | <a href=/s>Sport</a></div><div id=story>{BODY}</div><div id=bottom>All rights reserved</div>",
    f"<header><h2>Town News</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>Sport</a></ul></nav><article>{BODY}</article>"
    "<section class=comments><h3>Comments</h3><p>Good news at last, thank you all for it!</p></section><footer>Imprint</footer>",
    f"<div class=wrapper><div class=cookie-banner>We use cookies.</div><div class='post-content entry'>{BODY}</div>"
    "<aside class=sidebar><h3>Related</h3><ul><li><a href=/1>The old bridge</a></ul></aside></div>",
]


@pytest.mark.parametrize("page", BY_HAND)
def test_layouts_of_another_hand(spark, page_tagger, page):
    assert html.main_text(page, page_tagger) == " ".join((TITLE, *PROSE))


@pytest.fixture(scope="module")
def page_tagger(spark):
    return html.fit_tagger(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))


def test_pages_of_many_open_elements(page_tagger):
    import time

    begun = time.time()
    assert [b.text for b in html.leaf_blocks("<div>" * 100_000 + "x")] == ["x"]
    assert len(html.leaf_blocks("<div class=c>a" * 30_000)) == 30_000
    many = "".join(f"<div class=c{k}><p>text<td>" for k in range(10_000))
    assert set(html.main_text(many, page_tagger).split()) <= {"text"}
    html.main_text("<ul><li>" * 20_000 + "</li>" * 20_000, page_tagger)
    assert time.time() - begun < 20


def test_odd_pages(spark):
    tagger = html.Crf(2)
    assert html.main_text(None, tagger) == "" and html.main_text("", tagger) == ""
    blocks = html.leaf_blocks("<p>a &lt; b<p>c\n\n d<script>x='</p>'</script><li>e<li>f<a href='>'>g</a> < h")
    assert [b.text for b in blocks] == ["a < b", "c d", "e", "fg < h"]
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t")], "page_id int, html string, text string")
    assert [r[0] for r in html.extract(df, tagger).select("text").collect()] == ["", ""]
    assert html.fit_tagger(df.where("false")).scores == {}


# --- 7 packing and 8 counts ----------------------------------------------------


def ids_by(special):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = not special
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tokenizer():
    """As the vocabulary is: the string of its special token is that token."""
    return ids_by(True)


@pytest.fixture(scope="module")
def plain_tokenizer():
    return ids_by(False)


@pytest.mark.parametrize("size", [2048, 50])
def test_packing(spark, documents, odd, tokenizer, size):
    special = spark.createDataFrame([(-1, "a<|endoftext|>b <|endoftext|>. c", "s", "n", 0)], odd.schema)
    for df in (documents, odd.where("doc_id is null or doc_id != 3").union(special)):
        ids = {i: [*tokenizer(t), 0] for i, t in texts_of(df)}
        rows = packing.best_fit_packing(packing.token_pieces(df, size=size), size, per_part=40)
        rows = rows.collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            part = ids[r.id][r.start : r.start + r.length]
            assert len(part) == r.length
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.id].append((r.piece, r.start, r.length))
        for i, own in pieces.items():
            own.sort()
            assert [p for p, _, _ in own] == list(range(len(own)))
            assert sum(n for _, _, n in own) == len(ids[i])
            assert all(n == size for _, _, n in own[1:])
        for own in sequences.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= size
        bound = packing.lower_bound(np.array([r.length for r in rows]), size)
        assert len(sequences) <= bound * 1.02 + 1
        assert set(pieces) == set(ids)
        plain = spark.createDataFrame([(r.length, r.sequence_id) for r in rows], "length int, sequence_id bigint")
        assert tuple(packing.certificate(plain, size).first()) == (len(sequences), bound)
    assert packing.best_fit_packing(packing.token_pieces(odd.where("false"))).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, None)] * 3, "doc_id int, text string")
    rows = packing.best_fit_packing(packing.token_pieces(df)).collect()
    assert len(rows) == 9 and len({r.sequence_id for r in rows}) == 1
    assert len({r.offset for r in rows}) == 9 and all(r.certified for r in rows)


def test_rounds_go_on_while_they_save(spark):
    rows = [(k, 0, 0, 300 + 7 * (k % 200), 0) for k in range(600)]
    pieces = spark.createDataFrame(rows, "id int, piece int, start bigint, length bigint, ids_crc32 bigint")
    packed = packing.best_fit_packing(pieces, per_part=150)
    n, bound = packing.certificate(packed).first()
    together = packing.best_fit(np.array([r[3] for r in rows]), packing.SIZE)[0].max() + 1
    assert bound <= n <= together + 2 * 4 + 2  # of four partitions each may lose one or two


def test_lower_bound_is_one():
    assert packing.lower_bound(np.array([6, 6, 6, 4, 4, 4]), 10) == 3
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([], int), 10) == 0


def test_ids_of_words_are_those_of_texts(documents, odd, tokenizer, plain_tokenizer):
    from shelfmark.llm.tokens import encoder

    more = ["a  b", " a", "a ", "a \n b", "a\n b.  c", "it's, 's  ", "x.\t y,  z. ", "<|endoftext|> a"]
    for text in [t or "" for _, t in texts_of(documents) + texts_of(odd)] + more:
        assert np.frombuffer(encoder().text(text), "<u4").tolist() == tokenizer(text)
        plain = encoder(special=False).text(text)
        assert np.frombuffer(plain, "<u4").tolist() == plain_tokenizer(text)


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_counts(spark, documents, odd, plain_tokenizer, block):
    for df in (documents, odd):
        path = shared_folder(spark, "tokens")
        index = counts.write_token_files(df, path, docs_per_file=50)
        found = counts.token_counts(spark, path, block=block)
        assert Counter(r.n_tokens for r in found.collect()) == Counter(
            len(plain_tokenizer(t)) for _, t in texts_of(df)
        )
        linked = counts.document_counts(index, found).collect()
        assert Counter((r.id, r.n_tokens) for r in linked) == Counter(
            (i, len(plain_tokenizer(t))) for i, t in texts_of(df)
        )


def test_counts_of_documents_that_were_filtered(spark, documents, plain_tokenizer):
    some = documents.where("doc_id % 3 = 1")
    path = shared_folder(spark, "tokens")
    index = counts.write_token_files(some, path, docs_per_file=7)
    linked = counts.document_counts(index, counts.token_counts(spark, path)).collect()
    expected = {i: len(plain_tokenizer(t)) for i, t in texts_of(some)}
    assert len(linked) == len(expected) and {r.id: r.n_tokens for r in linked} == expected


def test_counts_query_links_every_document(spark, documents, plain_tokenizer):
    got = {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, SMALL).collect()}
    assert got == {i: len(plain_tokenizer(t)) for i, t in texts_of(documents)}


def brute_counts(ids, separator):
    """(start, tokens) of the documents of a file."""
    found, start = [], 0
    for k, i in enumerate(ids):
        if i == separator:
            found.append((start, k - start))
            start = k + 1
    return found + ([(start, len(ids) - start)] if start < len(ids) else [])


@pytest.mark.parametrize("width, separator", [(2, 50256), (2, 0), (2, 257), (4, 0), (4, 65537), (4, 7)])
@pytest.mark.parametrize("task_bytes", [23, 1 << 27])
def test_counts_of_files_shared_by_tasks(spark, tmp_path, width, separator, task_bytes):
    rng = np.random.default_rng(separator + width)
    # ids whose bytes, at odd places, look like the separator
    near = [0, 1, 256, 257, 80, 196, 0x50C4, 0xC450, 65535]
    near += [1 << 16, 65537, 1 << 24, 7 << 8, 7 << 24] if width == 4 else []
    files = [[], [separator], [separator] * 9, [5], [48111, 191, 5, separator, 6], [48111, 0xBF]]
    files += [rng.choice([separator, *near], n).tolist() for n in (1, 40, 41)]
    files += [rng.choice([3, *near[2:]], 50).tolist()]
    for k, ids in enumerate(files):
        (tmp_path / f"f{k:02}").write_bytes(np.array(ids, f"<u{width}").tobytes())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, str(task_bytes))
    try:
        found = counts.token_counts(spark, str(tmp_path), separator, 16, width)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = found.collect()
    for k, ids in enumerate(files):
        own = sorted(
            (r.ordinal, r.start, r.n_tokens) for r in found if r.path.endswith(f"/f{k:02}")
        )
        assert own == [(n, *d) for n, d in enumerate(brute_counts(ids, separator))], k


def test_counts_refuse_broken_files_and_take_none(spark, tmp_path, odd):
    (tmp_path / "f").write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole ids"):
        counts.token_counts(spark, str(tmp_path)).collect()
    path = shared_folder(spark, "tokens")
    index = counts.write_token_files(odd.limit(0), path)
    assert counts.document_counts(index, counts.token_counts(spark, path)).count() == 0


# --- 9 licences ----------------------------------------------------------------


TEXTS = Path(licences.__file__).parent / "licence_texts"


def rewrapped(text, width, mark=""):
    """Every paragraph in lines of another width."""
    parts = re.split(r"\n\s*\n", text)
    lines = [x for p in parts for x in [*textwrap.wrap(" ".join(p.split()), width), ""]]
    return "\n".join(mark + x for x in lines)


def test_licences_at_every_width(spark):
    rows = []
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text()
        rows += [(file.stem, rewrapped(text, width)) for width in range(40, 121)]
        rows += [(file.stem, "Copyright (c) 2020 A. Body\n" + text.upper().replace(",", " ,"))]
        rows += [(file.stem, "# © 2021-2024 Some Body. All rights reserved.\n" + rewrapped(text, 66, "# "))]
        rows += [(file.stem, text.replace("License", "Licence").replace("license ", "licence "))]
    rows += [("MIT", "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + (TEXTS / "MIT.txt").read_text())]
    apache = (TEXTS / "Apache-2.0.txt").read_text()
    rows += [("Apache-2.0", apache[: apache.index("APPENDIX")])]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(8)
    got = licences.licence_scan(df).collect()
    assert len(got) == len(rows) and [r for r in got if r.license != r.doc_id] == []


def test_no_licences(spark):
    mit = (TEXTS / "MIT.txt").read_text()
    texts = [
        None, "", mit + " more", mit[10:], mit.replace("copies", "programmes"), mit.replace("copies", ""),
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Copyright 2020 A. Body",
    ]
    rows = [(k, t, "x") for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, license string")
    got = licences.licence_scan(df).collect()
    assert len(got) == len(rows) and {r.license for r in got} == {None}
    assert {r.doc_id for r in got if r.canonical_sha256 is None} == {0}
    assert {r.canonical_chars for r in got if r.doc_id in (1, 8)} == {0}
    assert licences.licence_scan(df.where("false")).count() == 0
    unknown = spark.createDataFrame([("none", None), ("own", "Any words")], "license string, text string")
    assert {r.license for r in licences.licence_scan(df, unknown).collect()} == {None}


def test_licence_sql_finds_licences(spark, tmp_path):
    import duckdb

    from shelfmark.llm.sql import SQL

    rows = [(k, rewrapped(f.read_text(), 50)) for k, f in enumerate(sorted(TEXTS.glob("*.txt")))]
    rows += [(97, None), (98, ""), (99, "The programme's licence: programmer, organisations. Per cent per cent.")]
    folder = str(tmp_path)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    query = con.sql(SQL["op9_licence_scan"])
    want = query.select("doc_id, canonical_sha256, canonical_chars, license").fetchall()
    got = queries.op9_licence_scan(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.license is not None for r in got) == len(rows) - 3


# --- plans ---------------------------------------------------------------------


@pytest.fixture
def no_broadcast(spark):
    """As at scale: nothing is small enough, and a skewed partition is soon found."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_hot_nodes_are_split(spark, no_broadcast):
    rows = spark.range(200_000).selectExpr("id + 1 as a", "if(id % 3 = 0, 0, id) as b")
    edges = staged(rows.repartition(8), "edges")
    flipped = edges.selectExpr("-b as a", "-a as b")  # now the hot node is the largest
    for df in (_large_star(edges), _small_star(flipped)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan


# --- registry ------------------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() > 0


def test_unknown_words_of_a_text_are_encoded_together():
    from shelfmark.llm.tokens import Encoder

    texts = [
        "start qxz zxq. plain, plain zxq. qxzw\n<|endoftext|> a<|endoftext|>b é. 漢　x -- 's",
        "one two three", "  x  y ", "a.. b.,", "",
    ]
    for special in (True, False):
        found = Encoder(public_tokenizers.path("byte_bpe_50k.json"), special, 3)
        real, calls = found._tokenizer, []

        class Counted:
            def __getattr__(self, name):
                calls.append(name)
                return getattr(real, name)

        expected = [real.encode(t, add_special_tokens=False).ids for t in texts]
        found._tokenizer = Counted()
        assert [np.frombuffer(found.text(t), "<u4").tolist() for t in texts] == expected
        # the first word, the words with blanks, and all others at once
        assert len(calls) <= 3 * len(texts)
        calls.clear()
        found.text(" ".join(f"word{k}" for k in range(50)))
        assert calls == ["encode_batch_fast", "encode"]


def test_places_of_few_documents_are_held_at_once():
    class Docs:
        columns = ["uid", "text"]
        schema = T.StructType().add("uid", "long").add("text", "string")

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return function

    n = 2 * decontaminate.ROWS + 7
    flags = SimpleNamespace(value=bytes([1]) * decontaminate.SLOTS)
    batch = pa.RecordBatch.from_pydict({"uid": list(range(n)), "text": [f"a b w{k}" for k in range(n)]})
    got = list(decontaminate.candidates(Docs(), "text", flags, 2)([batch]))
    assert max(b.num_rows for b in got) <= decontaminate.ROWS
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["uid"] for r in rows] == list(range(n)) and {r["n_words"] for r in rows} == {3}
    assert [[p["around"] for p in r["places"]] for r in rows] == [["a b", f"a b w{k}", f"b w{k}"] for k in range(n)]
