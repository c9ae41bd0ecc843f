"""Periodic runs, sentence pieces and conversation repair against brute force and the library."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import conversations, periodic, pieces
from tabloom.llm.queries import QUERIES, damaged, piece_model, repeat_tail

TINY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words, least=24):
    """(start, length, period) by trying every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 3 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(draw):
    kinds, words, n = draw.choice([1, 2, 3, 5, 50, 1000]), [], draw.choice([10, 50, 200, 400])
    while len(words) < n:
        m = draw.random()
        if m < 0.4:
            unit = [draw.randrange(kinds) for _ in range(draw.choice([1, 2, 3, 4, 7, 8, 9, 20, 40]))]
            words += (unit * draw.randint(1, 12))[: draw.randint(1, 200)]
        elif m < 0.5 and words:
            at = draw.randrange(len(words))
            words += words[at : at + draw.randint(1, 100)]
        elif m < 0.55:
            a, b = [0], [0, 1]
            for _ in range(draw.randint(3, 9)):
                a, b = b, b + a
            words += b[:150]
        else:
            words += [draw.randrange(kinds) for _ in range(draw.randint(1, 60))]
    return [b"w%d" % w for w in words]


def test_grammar_runs_equal_brute_force():
    draw = random.Random(11)
    total = 0
    for _ in range(150):
        documents = [repetitive(draw) for _ in range(draw.randint(1, 4))]
        found = periodic.block_runs(documents)
        for words, got in zip(documents, found):
            assert got == brute_runs(words)
            total += len(got)
    assert total > 200


def test_every_nonterminal_spells_the_same_words_wherever_it_stands():
    draw = random.Random(3)
    ids = np.array([draw.randrange(3) for _ in range(300)] * 3 + [5] * 100)
    nodes = list(periodic.re_pair(ids, np.array([0, 500])))
    assert any(len(places) > 1 for places, _, _ in nodes)
    for places, left, size in nodes:
        assert 0 < left < size
        assert all((ids[p : p + size] == ids[places[0] : places[0] + size]).all() for p in places)
        assert all((p < 500) == (p + size <= 500) for p in places)


def test_runs_of_a_long_repetitive_text_are_few_and_fast():
    words = [b"a", b"b"] * 100_000 + [b"x%d" % i for i in range(50_000)] * 4
    assert periodic.block_runs([words]) == [[(0, 200_000, 2), (200_000, 200_000, 50_000)]]


ODD = [None, "", " \n\t ", "one", "a " * 30, "x y  " * 12 + "end", "lïne of wörds\x0b\n" * 9, "▁ ▁x  y", "nul\0 here a", "a b c " * 5000]


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(5)
    rows = [(i, t, "k", i) for i, t in enumerate([*ODD, *(" ".join(w.decode() for w in repetitive(draw)) for _ in range(30))])]
    rows += [rows[4], rows[0], (None, "b " * 40, None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, _text long"), rows


def test_runs_of_odd_rows(spark, texts):
    docs, rows = texts
    found = periodic.find_runs(docs)
    assert found.columns == ["doc_id", "_text", "n_words", "runs", "collapsed_text"]
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in found.collect())
    want = []
    for i, text, _, _ in rows:
        words = [w.encode() for w in WORD.findall(text or "")]
        runs = brute_runs(words[:3000]) if len(words) < 10_000 else [(0, len(words), 3)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert got == sorted(want)
    assert periodic.find_runs(docs.limit(0)).collect() == []


def test_op11_digests(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, TINY).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 4000:
            continue
        runs = brute_runs(words)
        some += len(runs)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        r = got[doc_id]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if not runs else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert some > 10 and repeat_tail(None, [b"a"]) == [b"a"]


def test_pieces_equal_the_library(spark, texts):
    opened = pieces.Pieces(piece_model())
    draw = random.Random(3)
    letters = [*"ab e.\n \t▁é中　<s>0x41\r\x0b\x85\U0001f600́\x01", "  ", "\n\n", " the", "ing", "\0", "﻿", "�"]
    for _ in range(40):
        many = ["".join(draw.choices(letters, k=draw.choice([0, 1, 2, 5, 20, 60]))) for _ in range(40)]
        assert [x.tolist() for x in opened.encode(many)] == opened.library.encode(many)
    docs, rows = texts
    found = pieces.encode_pieces(docs.withColumnRenamed("runs", "ids"), piece_model())
    assert found.columns == ["doc_id", "_text", "n_tokens", "ids", "decoded"]
    got = sorted((str(r.doc_id), r.n_tokens, list(r.ids), r.decoded) for r in found.collect())
    want = [(str(i), opened.library.encode(t or "")) for i, t, _, _ in rows]
    assert got == sorted((i, len(x), x, opened.library.decode(x) if x else "") for i, x in want)


def test_op12_digests(spark):
    library = pieces.pieces(piece_model()).library
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_sentence_pieces"](spark, TINY).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "")
        assert got[doc_id] == (doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # state: initial: state


def brute_repair(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault); states are the last role initial."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in NEXT[state]:
                if inserted < 2:
                    c, e, r = best(i, initial, inserted + 1)
                    ways.append((c + 3, "I" + e, (f"{role}:",) + r))
                if i < len(rows) and rows[i][2] not in ("blank", "duplicate"):
                    c, e, r = best(i + 1, initial, 0)
                    ways.append((c + 3 + 3 * (rows[i][2] == "truncated"), "R" + e, (f"{role}:{rows[i][1]}",) + r))
        if i < len(rows):
            role, text, fault = rows[i]
            c, e, r = best(i + 1, state, 0)
            ways.append((c + 4, "D" + e, r))
            if fault not in ("blank", "duplicate") and role[:1] in NEXT[state]:
                c, e, r = best(i + 1, role[:1], 0)
                ways.append((c + 3 * (fault == "truncated"), "K" + e, (f"{role}:{text}",) + r))
        return min(ways) if ways else (10**9, "", ())

    for i in range(len(rows), 0, -1):  # from the back, so that no call goes deep
        for state in NEXT:
            best(i, state, 0)
    return best(0, "", 0)


def brute_reports(rows, harm=True):
    """Rows of the contract's result from (conv_id, turn, role, text)."""
    own, out = {}, []
    for conv, turn, role, text in rows:
        kept = own.setdefault(conv, [])
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20 if harm else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, kept in own.items():
        def digest(role, text):
            return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()

        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
        seen, judged = set(), []
        for _, role, text in kept:
            last = WORD.findall(text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1][-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, repaired = brute_repair(tuple(judged))
        count = [sum(f == x for _, _, f in judged) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *count, illegal, cost, audit, sha("\n".join(repaired))))
    return sorted(out, key=str)


def reports(df):
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


def random_turns(draw, convs, most):
    rows = []
    for conv in range(convs):
        n = draw.randint(1, most)
        for turn in range(n):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "cut off", " ", "", "Is it?\n", None, f"t{turn}.", "again \x0b"])
            at = draw.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv if conv % 7 else None, at, role, text))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def test_walk_takes_the_least_of_the_cheapest_edits():
    draw = random.Random(2)
    for _ in range(400):
        rows = [(draw.choice(["user", "assistant", "system", "x"]), str(i), draw.choice(["", "", "truncated", "blank"])) for i in range(draw.randint(0, 14))]
        codes = bytes("suax".index(r[:1]) + 4 * {"": 0, "truncated": 1, "blank": 2}[f] for r, _, f in rows)
        cost, audit, _ = brute_repair(tuple(rows))
        assert conversations.walk(codes, conversations.END, 0, True)[0] == audit
        cut = draw.randint(0, len(codes))
        first, second = conversations.matrix(codes[:cut]), conversations.matrix(codes[cut:])
        after = conversations._times(second, conversations.END)
        assert conversations._times(first, after)[0] == cost
        edits, state = conversations.walk(codes[:cut], conversations._relative(after), 0, False)
        assert edits + conversations.walk(codes[cut:], conversations.END, state, True)[0] == audit


@pytest.fixture(params=[1, 24])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_of_odd_rows_over_many_ranges(spark, ranges):
    rows = random_turns(random.Random(ranges), 60, 12) + random_turns(random.Random(9), 1, 300)
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", audit string").repartition(3)
    assert reports(conversations.repair_reports(df)) == brute_reports(rows, harm=False)
    assert reports(conversations.repair_reports(damaged(df))) == brute_reports(rows)


def test_one_long_conversation_over_many_ranges(spark, ranges):
    draw = random.Random(1)
    rows = [(5, t, draw.choice(["user", "assistant", "assistant"]), draw.choice([f"{t % 50}.", "cut"])) for t in range(700)]
    df = spark.createDataFrame(rows, TURNS)
    assert reports(conversations.repair_reports(df)) == brute_reports(rows, harm=False)
    found = conversations.segments(conversations.judged(conversations.readable(df)))
    assert found.filter("open").count() > ranges // 2
    repaired = conversations.repaired_rows(df).orderBy("place").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in repaired)
    assert sha(text) == brute_reports(rows, harm=False)[0][-1]
    assert [r.place for r in repaired] == list(range(len(repaired)))


def test_op13_and_empty_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reports(QUERIES["op13_conversation_repair"](spark, TINY)) == brute_reports(rows)
    empty = spark.createDataFrame([], TURNS)
    assert conversations.repair_reports(empty).collect() == [] and conversations.repaired_rows(empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hello.")], TURNS)
    assert reports(conversations.repair_reports(damaged(one))) == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
