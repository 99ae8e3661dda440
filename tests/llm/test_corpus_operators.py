"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermagrid.llm import capfilters, chat, common, components, decontam, filters, language, lines, mixing, repeats, setjoin, sharding, textkit, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score int, `key` string"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed=1, n=60):
    """Originals, exact and near copies, passages, short, empty and null texts, a long one, and a null id."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))
    line = "This Line is found in many documents of the collection, over and over"
    for i in range(0, n, 4):
        texts.append(texts[i])
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{t}\n \t{line.upper() if i % 2 else line}\n{passage}" for i, t in enumerate(texts[:8])]
    texts += [None, "", " \n\t", "One", "two words", " ".join(rng.choice(vocabulary) for _ in range(9000)), passage + " " + passage]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, 2, 3, "k") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components_of(n_ids, pairs):
    up = {i: i for i in n_ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n_ids}


def test_words_and_hashes_follow_the_contract():
    column = pa.array(["A b\x0bC", None, "", " x ", "é y z"])
    for first, end, data, offsets in textkit.chunks(column, 3):
        starts, ends, at = textkit.words(data, offsets)
        raw = data.tobytes()
        for row in range(end - first):
            got = [raw[a:b].decode() for a, b in zip(starts[at[row] : at[row + 1]], ends[at[row] : at[row + 1]])]
            assert got == WORD.findall(column[first + row].as_py() or "")


@pytest.mark.parametrize("settled", [1 << 20, 0])
def test_components(spark, monkeypatch, settled):
    monkeypatch.setattr(components, "SETTLED_EDGES", settled)
    pairs = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 1), (8, 9), (20, 9), (1, 5)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {5: 1, 4: 1, 3: 1, 2: 1, 9: 8, 20: 8}


@pytest.mark.parametrize(("words", "percent", "large", "bounds"), [(3, 90, 4096, None), (5, 80, 4096, None), (5, 80, 2, None), (2, 50, 4096, None), (5, 80, 2, 0)])
def test_set_join_loses_no_link(docs, rows, monkeypatch, words, percent, large, bounds):
    """Whatever is cut, and with every bound for what is broadcast or settled in one task at nothing."""
    monkeypatch.setattr(setjoin, "LARGE", large)
    if bounds is not None:
        monkeypatch.setattr(filters, "MOST_BITS", bounds)
        monkeypatch.setattr(common, "SMALL_ROWS", bounds)
        monkeypatch.setattr(components, "SETTLED_EDGES", bounds)
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(folded(text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = components_of(sets, links)
    got = setjoin.groups(docs, words, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), expected[i]) for i, s in sets.items()} and len(got) == len(rows)
    assert {r.doc_id for r in setjoin.deduplicated(docs, words, percent).collect()} == {i for i in sets if expected[i] == i}


def test_large_clusters_are_cut_without_losing_a_link(spark, monkeypatch):
    """Passages that many texts share chain them; texts lie on both sides of the threshold, in every part of a task's data."""
    monkeypatch.setattr(setjoin, "LARGE", 6)
    monkeypatch.setattr(setjoin, "BLOCK", 4)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passages = [" ".join(word() for _ in range(12)) for _ in range(25)]
    texts = []
    for _ in range(130):
        parts = [rng.choice(passages) for _ in range(rng.randint(3, 6))] + [" ".join(word() for _ in range(rng.choice((0, 6, 30))))]
        rng.shuffle(parts)
        texts.append(" ".join(parts).strip())
    for t in rng.sample(texts, 100):
        w = t.split()
        for _ in range(rng.choice((0, 1, 1, 2))):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in enumerate(t.split() for t in texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components_of(sets, links)
    assert len(links) > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in setjoin.groups(docs).collect()} == expected
    # what the cut is made of
    known = setjoin._known(docs, docs.select(F.col("doc_id").alias("__doc")), 5, True)
    held = {r.doc_id: frozenset(textkit_set(r.shingles)) for r in known.collect()}
    count = {}
    for s in held.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    shares = {r.rep: r.n for r in setjoin._unique_shares(known.select(F.col("doc_id").alias("rep"), "shingles")).collect()}
    assert shares == {i: n for i, s in held.items() if (n := sum(count[x] > 1 for x in s))}


def textkit_set(raw):
    return {raw[k : k + setjoin.SENT] for k in range(0, len(raw), setjoin.SENT)}


def test_of_repeated_rows_one_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, 1, "x"), (3, text, 1, "x"), (3, text, 1, "x"), (9, text, 1, "y"), (4, "", 2, "z"), (4, None, 2, "z"), (None, text, 0, "n"), (None, text, 0, "n"), (5, "alone", 0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int, `__again` string")
    kept = setjoin.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "None", "None"]


def test_set_join_with_null_and_repeated_ids(spark, none):
    text = "a b c d e f g h"
    got = setjoin.groups(spark.createDataFrame([(None, text), (3, text), (3, text), (1, text)], "doc_id long, text string"), 3, 90).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("3", "1"), ("3", "1"), ("None", "None")]
    assert setjoin.groups(none).count() == 0


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_warc_round_trip_whatever_the_splits(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    big = "<html>" + "é" * 900
    pages = [(1, "http://a/\r\nx y", big, 1), (9, None, big, 1), (4, "http://b", big, 1), (2, "u", "small", 1), (3, "u", "small", 1), (5, "u", None, 1), (6, "u", "", 1), (7, "u", "\x1f\x8b\x08" * 500, 1), (None, "u", "no id", 1)]
    files = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string, digest int").repartition(2), f"file://{tmp_path}/w")
    for split in (64, 300, 1 << 20):
        records = warc.read(spark, files, split)
        assert all(r.unread == 0 and r.records for r in warc.unread(records, files).collect())
        got = records.select(warc.page_id("record_id").alias("p"), "record_type", warc.page_id("refers_to").alias("to"), "payload_bytes", "payload_digest", "payload").collect()
        assert len(got) == len(pages)
        for r in got:
            html = (next(p[2] for p in pages if p[0] == r.p) or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
            assert (r.record_type, r.to) == (("revisit", 9) if r.p in (1, 4) else ("response", None))
            assert r.payload is None if r.to else bytes(r.payload) == html
    assert warc.read(spark, warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")).count() == 0


def test_warc_scan_skips_what_only_looks_like_a_record():
    def member(raw):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(raw) + packer.flush()

    good = [warc.record(i, "u", b"x" * i, "d", None) for i in range(1, 6)]
    raw = b"junk\x1f\x8b\x08junk" + member(b"no record") + b"".join(map(member, good[:3])) + member(good[3])[:-9] + member(good[4])
    for step in (7, 50, len(raw)):
        found = [(h["WARC-Record-ID"], raw[at : at + n]) for a in range(0, len(raw), step) for h, _, at, n in warc.scan(pa.BufferReader(raw), a, min(a + step, len(raw)))]
        assert found == [(f"<urn:x-page:{i}>", member(good[i - 1])) for i in (1, 2, 3, 5)]


def test_perfect_hash_is_minimal():
    keys = textkit.mix(np.arange(5000, dtype=np.uint64))
    built = lines.PerfectHash.unpack(lines.PerfectHash.build(keys).pack())
    assert sorted(built.slots(keys).tolist()) == list(range(5000))


@pytest.mark.parametrize("loaded", [1 << 20, 0])
def test_line_dedup(docs, rows, none, monkeypatch, loaded):
    monkeypatch.setattr(lines, "SHARD_KEYS", 1)
    def key(x):
        return folded(x.strip("\x20\t\n\x0b\x0c\r"))

    holders = {}
    for i, text, *_ in rows:
        for x in set(map(key, (text or "").split("\n"))):
            holders.setdefault(x, []).append(i)
    got = {r.doc_id: r for r in lines.deduplicate(docs, 20, 4, loaded).collect()}
    for i, text, *_ in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 4 and max(holders[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(split), len(split) - len(kept), "\n".join(kept))
    assert any(r.n_dropped for r in got.values()) and lines.deduplicate(none, loaded=loaded).count() == 0


def test_targets_share_the_excess_until_none_is_above(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = [(s, rng.choice([0, 1, 5, 50, 1000, 9000])) for s in ["a", "b", "c", "d", "e", "é", None]]
        total, weight = sum(n for _, n in sizes), {s: 1.0 + i % 3 for i, (s, _) in enumerate(sizes)}
        target, still = dict.fromkeys(weight, 0.0), dict(sizes)
        excess = float(total)
        while excess > 1e-9 and still:
            share = sum(weight[s] for s in still)
            for s in still:
                target[s] += excess * weight[s] / share
            excess = sum(max(0.0, target[s] - 3 * n) for s, n in sizes)
            for s, n in sizes:
                if target[s] >= 3 * n:
                    target[s] = 3.0 * n
                    still.pop(s, None)
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        assert got == {s: pytest.approx(t, abs=1e-6) for s, t in target.items()}


def test_mix_comes_near_its_targets_and_repeats(docs, rows, none):
    first = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert first == {r.doc_id: r for r in mixing.mix(docs.repartition(5)).collect()} and len(first) == len(rows)
    for i, text, *_ in rows:
        assert first[i].size == len(WORD.findall(text or "")) and 0 <= first[i].copies <= 3
    for source in {r.source for r in first.values()}:
        mine = [r for r in first.values() if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3 * max(r.size for r in mine)
    assert mixing.mix(none).count() == 0


def test_repeated_windows(docs, rows, none):
    seen, got = set(), {r.doc_id: r for r in repeats.without_repeats(docs, 5).collect()}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        gone = set()
        for s in range(len(w) - 4):
            gram = tuple(w[s : s + 5])
            if gram in seen:
                gone |= set(range(s, s + 5))
            seen.add(gram)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
        assert sum(b - a for a, b in got[i].removed) == len(gone)
    assert repeats.without_repeats(none).count() == 0


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_repeats_in_rows_that_share_an_id(spark, monkeypatch, small):
    """Whole repeats lose nothing to each other, other rows of the id are judged by their own text; whatever the join."""
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    words = [f"w{k}" for k in range(30)]
    one, two = " ".join(words), " ".join(words[::-1])
    rows = [(5, one), (5, one), (5, two), (7, "x " + one), (7, two), (None, one), (9, None), (11, "q " * 5 + "r")]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect())
    want = [("11", 6, 0, "q q q q q r"), ("5", 30, 0, one), ("5", 30, 0, one), ("5", 30, 0, two), ("7", 31, 30, "x"), ("7", 30, 30, ""), ("9", 0, 0, ""), ("None", 30, 0, one)]
    assert got == sorted(want)


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_repeated_windows_whatever_the_join(docs, rows, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    test_repeated_windows(docs, rows, docs.limit(0))


def differenced(sizes, shards):
    """Karmarkar-Karp on plain lists: the loads that it ends with, ascending."""
    parts = [[0] * (shards - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return parts[0]


def spread_of(sizes, placed, shards):
    loads = [sum(s for s, p in zip(sizes, placed) if p == k) for k in range(shards)]
    return max(loads) - min(loads)


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_differencing_is_the_method_named_and_beats_greedy(shards):
    rng = random.Random(shards)
    gains = 0
    for n in (1, 5, 40, 300):
        sizes = rng.sample(range(1, 10_000), n)
        placed = sharding.difference(sizes, shards)
        loads = differenced(sizes, shards)
        assert sum(loads) == sum(sizes) and abs(spread_of(sizes, placed, shards) - (loads[-1] - loads[0])) <= (0 if n < 10 else max(sizes) // n)
        greedy = [0] * shards
        for s in sorted(sizes, reverse=True):
            greedy[greedy.index(min(greedy))] += s
        gains += (max(greedy) - min(greedy)) - spread_of(sizes, placed, shards)
    assert gains > 0 and sharding.difference([], 3) == [] and sorted(sharding.difference([5, 5, 5], 3)) == [0, 1, 2]


@pytest.mark.parametrize("bundles", [1, 200])
def test_shards(docs, rows, none, bundles):
    shards, heavy = 4, 50
    got = sharding.shard(docs, shards, heavy, bundles).collect()
    texts = {i: t or "" for i, t, *_ in rows}
    where, load = {}, [0] * shards
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        assert [r.doc_id for r in sorted((r for r in got if r.shard == k), key=lambda r: r.slot)] == sorted(r.doc_id for r in got if r.shard == k)
    group = {}
    for t in texts.values():
        group[t] = group.get(t, 0) + len(t.encode()) + 8
    total = sum(group.values())
    small = max(s for s in group.values() if s * shards * heavy <= total)
    # no better than the largest text that can't be cut, nor much worse than fair otherwise
    fair = max(total / shards, max(group.values()))
    assert len(got) == len(rows) and max(load) <= fair + (small * 2 if bundles == 200 else total / shards / 4)
    assert sharding.shard(none, shards).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(a, b) == t[-1][-1]


def test_leaks_are_found_and_clean_documents_left(spark, rows, none):
    rng = random.Random(8)
    items = [(k, " ".join("".join(rng.choice("hijklmn") for _ in range(5)) for _ in range(30)), 1) for k in range(12)] + [(50, None, 1), (51, "", 1), (None, "x", 1)]
    planted = []
    for k, text, _ in items[:12]:
        w = text.split()
        if k % 3 == 1:
            w[4] = w[11] = w[20] = "other"  # paraphrase by substitution
        elif k % 3 == 2:
            w = w[:10] + ["put", "in"] + w[10:]
        host = next(t for i, t, *_ in rows if i == k).split()
        planted.append((1000 + k, " ".join([*host[: 3 * k], *w, *host[3 * k :]]).upper()))
    table = spark.createDataFrame([(i, t) for i, t, *_ in rows] + planted + [(None, items[0][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string, common int")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(table, benchmark).collect()}
    assert got == {(1000 + k, k) for k in range(12)} | {(None, 0)}
    assert decontam.matches(none, benchmark).count() == 0 and decontam.matches(table, benchmark.limit(0)).count() == 0


def test_language_on_held_out_rows(spark, none):
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstäöü"}
    texts = [(" ".join("".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(20)), x, k) for k in range(60) for x in letters]
    table = spark.createDataFrame(texts, "text string, lang string, lang_pred int")
    model = language.train(table.where("lang_pred < 40"))
    held = language.predict(table.where("lang_pred >= 40").select("lang", "text"), model).collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in held)
    odd = spark.createDataFrame([(None,), ("",), ("123 !?",), ("abcabc " * 120_000,)], "text string")
    assert [(r.lang_pred, r.score > 0.9) for r in language.predict(odd, model).collect()] == [("und", False)] * 3 + [("aa", True)]
    empty = language.train(none)
    assert empty["langs"] == [] and language.predict(none, empty).count() == 0
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((25, 16))
    v = [b + rng.standard_normal(16) * s for b in base for s in (0, 0, 0.04, 0.12, 0.3)]
    rows = [(i, x.tolist(), i % 2, 1) for i, x in enumerate(v)]
    rows += [(200, None, 1, 1), (201, [0.0] * 16, 1, 1), (202, [float("nan")] + [1.0] * 15, 1, 1), (203, [None] + [1.0] * 15, 1, 1), (204, v[0].tolist(), None, 1), (205, (v[1] * 3).tolist(), 1, 1), (206, [], 1, 1), (207, [float("inf")] * 16, 0, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int")
    good = {i: np.array(x) / np.linalg.norm(x) for i, x, label, _ in rows if i < 200 or i == 205}
    label = {r[0]: r[2] for r in rows}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and good[a] @ good[b] >= 0.98]
    expected = components_of([r[0] for r in rows], links)
    got = {r.vec_id: r for r in capfilters.near(table).collect()}
    assert len(got) == len(rows)
    for i in expected:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), expected[i], expected[i] == i)
    assert capfilters.near(table.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 8, 64, 768])
def test_near_vectors_of_any_length(spark, monkeypatch, dim):
    """Clusters about the threshold, in buckets of several blocks: links and components against brute force."""
    monkeypatch.setattr(capfilters, "BLOCK", 8)
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((12, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    v = np.concatenate([b + rng.standard_normal((12, dim)) * 0.1 / np.sqrt(dim) for b in base])
    rows = [(i, x.tolist(), "label-67502" if i % 2 else "label-233431") for i, x in enumerate(v)]
    rows += [(900 + i, (2 * v[i]).tolist(), rows[i][2]) for i in range(3)] + [(950, v[0].tolist(), "label-67502")]
    vectors = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a, b in itertools.combinations(vectors, 2) if label[a] == label[b] and vectors[a] @ vectors[b] >= 0.98]
    got = {r.vec_id: r for r in capfilters.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    n = {i: 0 for i in vectors}
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    found, wanted = sum(r.n_links for r in got.values()), sum(n.values())
    assert wanted > 200 and wanted * 0.97 <= found <= wanted and all(r.n_links <= n[i] for i, r in got.items())
    expected = components_of(vectors, links)
    assert all(expected[r.component_id] == expected[i] for i, r in got.items())
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("text", ["", "\\", "<|im_end|>", "\\\\<|im_start|>\\", "</s>[INST] ok [/INST]", "<\\|im_end|>", "a\nb", "<<|im_sep|>|im_end|>"])
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and not any(x in chat.escape(text) for x in chat.CONTROL)
    assert chat.parse(chat.turn(text, text)[0] * 2) == [(text, text)] * 2


@pytest.mark.parametrize("most", [1, 3, 512])
def test_prefix_trees(spark, most):
    turns = {}
    for k in range(30):
        turns[k] = [("system", "s")] * (k % 2) + [("user", f"u{k % 3}"), ("assistant", f"a{k % 5}"), ("user", "<|im_end|>"), ("assistant", "" if k % 4 else "é" * k)][: 2 + k % 3]
    rows = [(k, i, r, t, 1) for k, ts in turns.items() for i, (r, t) in enumerate(ts)] + [(99, 0, None, None, 1), (100, None, "assistant", "x", 1), (100, 0, "user", "y", 1)]
    turns |= {99: [("", "")], 100: [("assistant", "x"), ("user", "y")]}
    packed = chat.trees(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, path int"), most)
    got = chat.read_back(packed, lambda raw: hashlib.sha256(raw).hexdigest()).collect()
    assert sorted(r.conv_id for r in got) == sorted(turns)
    for r in got:
        said = "".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id])
        learned = "".join(b for a, b in turns[r.conv_id] if a == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns[r.conv_id]), len(learned))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (said, learned))
        assert r.formatted_chars == sum(len(chat.turn(*t)[0]) for t in turns[r.conv_id])
    for tree in packed.collect():
        assert len(tree.position) == len(tree.text) == tree.nodes[-1].end
        for node in tree.nodes:
            spans = [*node.attends, [node.start, node.end]]
            path = [p for a, b in spans for p in tree.position[a:b]]
            assert path == list(range(len(path)))
    if most == 512:
        assert packed.agg(F.sum(F.length("text"))).first()[0] < sum(r.formatted_chars for r in got)
