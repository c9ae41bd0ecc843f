"""The training-data operators against brute force, SQL and round trips, on small tables."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tools.check import compare, duck
from tabloom.llm import decontaminate, jaccard, langid, licenses, mixing, quality, sharding, substrings, tokens, warc
from tabloom.llm.queries import CHECKS, QUERIES, mix_plan, vocabulary
from tabloom.llm.shingles import shingle_set, shingle_sets

TINY = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string, shard int"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choices(words, k=n)) + "." for n in (80, 90, 120, 300, 12_000)]
    passage = " ".join(f"p{i}" for i in range(70))
    near = texts[2].replace(texts[2].split()[5], "changed", 1)
    rows = [*texts, None, "", " \n\t ", "one", "Two words", texts[1], near, texts[3] + " " + passage, passage + "\nEnd. " + texts[0],
            "Aé  ÀB c \n\n d\x0be", "Released under the MIT License.\nCC BY and GNU\nGeneral public LICENSE", "12345 !!!",
            "a | b | c | d | e\n" * 30, "same line of five words.\n" * 40]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, "x", None, i) for i, t in enumerate(rows)]
    rows += [rows[1], rows[6], (None, texts[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS), rows


@pytest.mark.parametrize("name", sorted(CHECKS))
@pytest.mark.skipif(not os.path.isdir(TINY), reason="the given tables are absent")
def test_query_matches_sql(spark, name):
    ok, note, _ = compare(spark, duck(TINY), name, QUERIES[name], CHECKS[name], TINY)
    assert ok and "TYPES" not in note and "INEXACT" not in note, note


def base_counts(text):
    words = BLANKS.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    spots = {i + o for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if BLANKS.search(x)]
    failed = len(words) < 50 or 100 * len(spots) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(spots), failed


def test_quality_counts_and_cleaning(spark, odd):
    docs, rows = odd
    got = quality.score_lines(docs).select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:8] == base_counts(r.text), r.doc_id
    kept = {r.doc_id for r in got if r.kept}
    assert {0, 1, 2, 3, 4} <= kept and not {5, 6, 17, 18} & kept
    cleaned = quality.clean_documents(docs)
    assert cleaned.columns == docs.columns and {r[0] for r in cleaned.collect()} == kept


def test_decontamination_marks_and_cuts(spark, odd):
    docs, rows = odd
    texts = {r[0]: r[1] for r in rows}
    items = [("b", " ".join(texts[0].split()[10:25])), ("a", "Two WORDS"), (None, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12"), ("c", None), ("d", "not there at all")]
    items = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for name, text in items.collect():
        w = PLAIN.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    got = decontaminate.mark_documents(docs, items).select("doc_id", "text", "n_words", "n_hit", "hit_items").collect()
    assert len(got) == len(rows)
    listed = decontaminate.mark_documents(docs, items, max_broadcast=0, max_listed=0)
    assert sorted(map(str, listed.select(*["doc_id", "text", "n_words", "n_hit", "hit_items"]).collect())) == sorted(map(str, got))
    for r in got:
        w = PLAIN.findall(lower(r.text))
        hit, names = set(), set()
        for run, found in windows.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    names |= found
        assert (r.n_words, r.n_hit, r.hit_items) == (len(w), len(hit), sorted(names - {None})), r.doc_id
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(r.n_hit == 0 for r in got)
    left = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, items).collect()}
    assert left[9] == "" and left[2] == texts[2] and len(left[0].split()) == 80 - 15


def shingles(text):
    w = BLANKS.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    out = []
    for (i, s), g in zip(sets, group):
        ids = [j for (j, _), h in zip(sets, group) if h == g and j is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def test_jaccard_components(spark, odd):
    docs, rows = odd
    got = sorted([tuple(r) for r in jaccard.jaccard_components(docs).collect()], key=str)
    assert got == brute_components([(r[0], r[1]) for r in rows])
    left = jaccard.first_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.filter("doc_id is not null").collect()) == sorted({c for i, _, c in got if i is not None and c is not None and c == i})


def test_jaccard_near_copies_of_many_degrees(spark):
    draw = random.Random(3)
    base = [draw.choice("abcdefghij") + str(draw.randrange(500)) for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(i % 9):
            text[draw.randrange(len(text))] = f"z{draw.randrange(40)}"
        rows.append((i, " ".join(text)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_components(rows)


def test_shingle_sets_read_from_a_buffer_are_those_of_each_text():
    draw = random.Random(5)
    texts = [None, "", " ", "a b c d e", "A b\tC d\ne", "x" * 300_000, "a " * 90_000, " \u00e9 \u00fc", "a", "b", None, ""]
    texts += ["".join(draw.choices("ab \n\0\x0c\u00c4", k=draw.randrange(60))) for _ in range(500)]
    for array in (pa.array(texts), pa.array(texts)[3:], pa.array(texts[:2]), pa.array([], pa.string())):
        got = shingle_sets(array)
        assert len(got) == len(array)
        assert all(np.array_equal(g, shingle_set(t.as_py())) for g, t in zip(got, array))


def test_blocks_of_posting_lists_change_no_pairs(spark):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, [*base[: 40 + draw.randrange(20)], f"t{k % 7}"]) for k in range(40)]
    ids = {k: jaccard._node(jaccard.shingle_sets(pa.array([" ".join(w)]))[0]) for k, w in rows}
    sets = {ids[k]: set(w) for k, w in rows}
    placed = [(zlib.crc32(t.encode()), n, len(s), len(s), 1) for n, s in sets.items() for t in s]
    placed = spark.createDataFrame(placed, "token long, node long, n int, most int, need int")
    marks = spark.createDataFrame([(n, bytes(64)) for n in sets], "node long, mark binary")
    groups = spark.createDataFrame([(n, 1) for n in list(sets)[:5]], "node long, g long")
    alike = {}
    for block in (3, 256):
        pairs = jaccard.group_pairs(placed, groups, marks, block=block).collect()
        alike[block] = sorted(map(tuple, pairs))
        assert len(set(alike[block])) == len(alike[block])
    grouped = set(list(sets)[:5])
    want = {(a, b) for a in sets for b in sets if a < b and not {a, b} <= grouped
            and 175 * min(len(sets[a]), len(sets[b])) >= 75 * (len(sets[a]) + len(sets[b]))}
    assert set(alike[3]) == set(alike[256]) == want


def test_parity_marks_never_exceed_the_difference_of_two_sets():
    draw = np.random.default_rng(5)
    for size in (1, 5, 60, 900, 5000):
        base = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0, 0.1, 0.3, 1):
            new = draw.integers(0, 1 << 63, int(size * share), dtype=np.uint64)
            a, b = np.unique(base), np.unique(np.concatenate([base[len(new) :], new]))
            bits = [np.frombuffer(jaccard._mark(x), dtype=np.uint64) for x in (a, b)]
            apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert apart <= len(np.setxor1d(a, b))
            assert len(bits[0]) * 64 == jaccard.MARK_BITS


def brute_repeats(rows):
    cut = [(i, BLANKS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in cut:
        for k in range(len(w) - 49):
            if i is not None:
                run = tuple(w[k : k + 50])
                first[run] = min(first.get(run, i), i)
    out = []
    for i, w in cut:
        gone = {k + o for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for o in range(50)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("busy", [substrings.BUSY, 0])
def test_substring_removal(spark, odd, busy):
    docs, rows = odd
    got = substrings.remove_repeats(docs, busy=busy).drop("removed").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats([(r[0], r[1]) for r in rows])


def test_suffix_automaton_matches_brute_force():
    draw = random.Random(1)
    texts = [[draw.choice("ab") for _ in range(draw.randrange(3, 40))] for _ in range(12)]
    automaton = substrings.SuffixAutomaton()
    for i, t in enumerate(texts):
        automaton.add(t, i)
    automaton.settle()
    for t in [*texts, list("abbabaab")]:
        want = []
        for k in range(len(t) - 5):
            holders = [i for i, u in enumerate(texts) if any(u[j : j + 6] == t[k : k + 6] for j in range(len(u) - 5))]
            want.append(min(holders, default=None))
        assert automaton.matches(t, 6) == want


def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    docs, rows = odd
    plain = Tokenizer.from_file(vocabulary())
    got = tokens.token_files(docs, vocabulary()).collect()
    want = {(r[0], zlib.crc32(np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in rows}
    assert len(got) == len(rows) and {(r.doc_id, r.ids_crc32) for r in got} == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_token_files_use_a_dictionary_and_random_access(spark):
    from tabloom.sources.shared import fresh_path

    docs = spark.createDataFrame([(i, f"the {i} quick brown fox and the lazy dog of number {i * 7}. " * 6) for i in range(400)], "doc_id long, text string")
    shards = tokens.write_tokens(docs, fresh_path(spark, "tokens-test"), vocabulary())
    found = [x for r in shards.collect() if (x := tokens.read_document(r.path, 123)) is not None]
    assert len(found) == 1 and tokens.encoder(vocabulary()).tokenizer.decode(list(found[0][:-1])).startswith("the 123 quick")
    with open(shards.first().path.removeprefix("file:") + ".tok", "rb") as f:
        assert f.read(38)[6:] != tokens.NO_DICTIONARY


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: 1", None), (4, "u", ""), (None, "u", "<p>x</p>"),
            (5, "u", "é\r\n\r\nWARC/1.1" * 40_000), (2, None, "<p>x</p>"), (6, "u", "only")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.archive_pages(pages).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        revisit = i is None or i < top
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    r = next(r for r in got if r.page_id == 6)
    assert warc.read_record(r.archive, r.offset, r.length).endswith(b"only\r\n\r\n")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(spark, odd):
    docs, rows = odd
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id) if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))


def test_mixing_spends_budgets_on_prefixes(spark, odd):
    docs, rows = odd
    plan = mix_plan("mix_")
    got = mixing.mix(mixing.measure(docs, plan), plan)
    total = sum(len(BLANKS.findall(r[1] or "")) for r in rows)
    spent = got.agg(F.sum("n_tokens")).first()[0]
    assert spent <= total * plan.budget_percent // 100 and set(docs.columns) <= set(got.columns)
    assert got.filter("epoch >= 2").count() == 0


def test_water_filling_gives_shortages_to_siblings_first(spark):
    rows = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 5)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    levels = (mixing.Level("domain", "domain"), mixing.Level("lang", "lang"), mixing.Level("source", "source"))
    got = mixing.leaf_budgets(leaves, mixing.MixPlan(levels, budget_percent=40, max_epochs=1)).collect()
    # 806 tokens: books can use 5; web gets 801, 400 a language; a holds 10, its sibling b takes 390.
    assert {r.source: r.budget for r in got} == {"d": 5, "a": 10, "b": 390, "c": 400}


def brute_shards(groups, shards):
    """Plain longest processing time: {bytes: shards taken, sorted} and the loads."""
    loads, taken = [0] * shards, {}
    for size in sorted(groups, reverse=True):
        s = loads.index(min(loads))
        loads[s] += size
        taken.setdefault(size, []).append(s)
    return {k: sorted(v) for k, v in taken.items()}, loads


def test_runs_of_equal_groups_are_dealt_as_one_by_one():
    draw = random.Random(3)
    for _ in range(400):
        shards = draw.randint(1, 9)
        groups = Counter(draw.choice([1, 2, 3, 7, 50, 1000]) for _ in range(draw.randint(0, 120)))
        groups[draw.randint(1, 5000)] += draw.randint(1, 3)
        heap, got = [(0, s) for s in range(shards)], {}
        for size in sorted(groups, reverse=True):
            turns = sharding.deal(size, groups[size], heap)
            assert len(turns) <= shards and turns[0][0] == 0
            ends = [t[0] for t in turns[1:]] + [groups[size]]
            got[size] = [c[(i - a) % len(c)] for (a, c), z in zip(turns, ends) for i in range(a, z)]
        want, loads = brute_shards(groups.elements(), shards)
        assert {k: sorted(v) for k, v in got.items()} == want
        assert [load for load, _ in sorted(heap, key=lambda x: x[1])] == loads


@pytest.mark.parametrize("per_bucket", [1, 2_000])
def test_sharding_against_plain_lpt(spark, odd, per_bucket):
    docs, rows = odd
    rows = rows + [(100 + i, f"text {i % 40:02d}", None, None, None, None, None, None) for i in range(150)]
    rows += [(None, "text 00", None, None, None, None, None, None)] * 60
    docs = spark.createDataFrame(rows, docs.schema)
    got = sharding.shard_rows(docs, per_bucket=per_bucket).collect()
    text = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], len(t) + 1, zlib.crc32(t), hashlib.md5(t).hexdigest()) for r, t in zip(rows, text))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.group_key) for r in got) == want
    size, shard = Counter(), {}
    for r in got:
        size[r.group_key] += r.size
        assert shard.setdefault(r.group_key, r.shard) == r.shard
    taken = {}
    for k, n in size.items():
        taken.setdefault(n, []).append(shard[k])
    assert {k: sorted(v) for k, v in taken.items()} == brute_shards(size.values(), 8)[0]
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.skipif(not os.path.isdir(TINY), reason="the given tables are absent")
def test_op9_law_and_loads(spark):
    got = QUERIES["op9_lpt_sharding"](spark, TINY).collect()
    size = Counter()
    for (t,) in spark.read.parquet(f"{TINY}/documents.parquet").select("text").collect():
        size[t or ""] += len((t or "").encode()) + 1
    loads = Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
    assert [loads[s] for s in range(8)] == brute_shards(size.values(), 8)[1]


def test_licences_of_odd_rows(spark, odd):
    docs, rows = odd
    got = licenses.scan_licences(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = PLAIN.findall(lower(next((x[1] for x in rows if x[0] == r.doc_id), None))) if r.doc_id is not None else None
        if w is not None:
            places = [(i, l) for p, l in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in places]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
            assert r.base_labels == ",".join(sorted({l for _, l in places}))
    assert next(r for r in got if r.doc_id == 15).labels == "cc-by,gpl,mit,mit-notice"


def test_every_notice_of_a_file_is_found_where_its_key_phrase_fits(spark):
    notices = {t: text for t, (text, _) in licenses.TEMPLATES.items()}
    filler = " some other words of the file "
    rows = [(0, filler.join(notices.values()))]
    rows += [(i + 1, f"Copyright 2020\n{filler}{text.title()}.{filler}") for i, text in enumerate(notices.values())]
    # Words of a notice in another order, and its key phrase far from the rest.
    rows += [(100, " ".join(reversed(notices["bsd"].split()))), (101, notices["bsd"].replace("binary forms", "other things") + filler + "binary forms")]
    rows += [(200 + i, " ".join(random.Random(i).choices(licenses.VOCABULARY, k=3_000))) for i in range(3)]
    got = {r.doc_id: r for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[0].labels.split(",")) >= set(notices) and got[0].n_templates == len(notices)
    for i, t in enumerate(notices):  # recall of whole notices, alone and in company
        assert t in got[i + 1].labels.split(",") and got[i + 1].score == 1.0
    assert got[100].labels == got[101].labels == "" and got[100].score == got[101].score == 0.0
    for i in range(3):  # no template without its key phrase in place
        w = next(text for d, text in rows if d == 200 + i).split()
        held = {t for t, (_, k) in licenses.TEMPLATES.items() if any(w[j : j + len(k.split())] == k.split() for j in range(len(w)))}
        assert set(got[200 + i].labels.split(",")) - set(got[200 + i].base_labels.split(",")) <= held


def test_empty_tables(spark, odd):
    docs = odd[0].limit(0)
    items = spark.createDataFrame([], "item_id string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    plan = mix_plan()
    for frame in (
        quality.score_lines(docs), decontaminate.mark_documents(docs, items), decontaminate.drop_contaminated(docs, items),
        jaccard.jaccard_components(docs), substrings.remove_repeats(docs), tokens.token_files(docs, vocabulary()),
        warc.archive_pages(pages), langid.identify(docs), mixing.mix(mixing.measure(docs, plan), plan),
        sharding.shard_rows(docs), licenses.scan_licences(docs),
    ):
        assert frame.count() == 0
    assert decontaminate.drop_contaminated(odd[0], items).count() == odd[0].count()


def test_native_operators_run_no_python(spark, odd):
    docs = odd[0]
    items = spark.createDataFrame([("a", "some words of an item")], "item_id string, text string")
    plan = mix_plan()
    for frame in (quality.score_lines(docs), decontaminate.mark_documents(docs, items), licenses.scan_licences(docs),
                  mixing.mix(mixing.measure(docs, plan), plan)):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"InPandas|InArrow|PythonUDF|CartesianProduct", text)


@pytest.mark.skipif(not os.path.isdir(TINY), reason="the given tables are absent")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    cleaned = {r.doc_id: r.text for r in quality.clean_documents(docs).collect()}
    firsts = {c for i, _, c in brute_components(sorted(cleaned.items())) if c == i}
    bench = set()
    for (text,) in spark.read.parquet(f"{TINY}/benchmark.parquet").select("text").collect():
        w = PLAIN.findall(lower(text))
        bench |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    clean = set()
    for i in firsts:
        w = PLAIN.findall(lower(cleaned[i]))
        if not any(tuple(w[k : k + 10]) in bench for k in range(len(w))):
            clean.add(i)
    out, frames = docs, {}
    for name, step in P.STAGES:
        out = frames[name] = step(spark, out, TINY).cache()
    assert {r.doc_id for r in frames["benchmark_decontamination"].collect()} == clean
    assert frames["source_mixing"].columns == docs.columns
    mixed = Counter(r.doc_id for r in frames["source_mixing"].collect())
    assert set(mixed) <= clean and max(mixed.values()) <= 2
    assert Counter(r.doc_id for r in out.collect()) == mixed
    assert Counter(r.doc_id for r in P.run(spark, TINY).collect()) == mixed


def test_pairs_bounded_by_short_tokens_keep_every_link(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(-(2**63), 2**63, n, dtype=np.int64).tolist()
    common, own, low = draw(600), draw(2_400), draw(1)[0] >> 20
    same_bits = [low + (i << 16) for i in range(400)]  # one value of 16 bits
    sets = {
        1: common + own[:100], 2: common + own[100:200],  # 600 of 800: just a link
        3: common[:599] + own[200:301], 4: common + own[300:400],  # 598 or 599 of 801 and more
        5: common + own[400:800], 6: common + own[800:1_200],  # far from one
        7: same_bits, 8: same_bits[:300], 9: own[:400],
    }
    frame = spark.createDataFrame(list(sets.items()), "node long, tokens array<bigint>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    met = spark.createDataFrame(pairs, "a long, b long")
    found = {(r.a, r.b) for r in jaccard.possible_pairs(met, frame).collect()}
    share = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b in pairs}
    assert {p for p in pairs if share[p] >= 0.75} >= {(1, 2), (7, 8)}
    assert found >= {p for p in pairs if share[p] >= 0.75}
    assert not found & {p for p in pairs if share[p] < 0.72}
