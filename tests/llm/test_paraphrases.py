"""Decontamination against its own decision over every window of every text, and its candidate search's recall."""

import random

import pytest

from thermagrid.llm import decontam


def accepted(item, text):
    return decontam.judged(item, text) is not None


@pytest.mark.parametrize(("cells", "parts"), [(1 << 22, 1 << 13), (0, 9)])
def test_paraphrases_of_all_kinds_are_found(spark, monkeypatch, cells, parts):
    """In one pass by a whole table of places, or in several by open ones."""
    monkeypatch.setattr(decontam, "TABLE", cells)
    monkeypatch.setattr(decontam, "PARTS", parts)
    rng = random.Random(11)
    common = ["the", "of", "and", "to", "in", "a", "is", "it", "on", "at", "by", "or"] + [f"com{k}" for k in range(20)]

    def word():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(7))

    # every other word of an item is in more than a twentieth of the documents; items of one part and of several
    items = [[rng.choice(common) if rng.random() < 0.5 else word() for _ in range(rng.choice((18, 30, 45, 58, 130)))] for _ in range(25)]
    docs = [[rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(1, 260))] for _ in range(150)]
    texts, whole = [d for d in docs], []
    for i, item in enumerate(items):
        for share in (0.0, 0.3, 0.5, 0.7, 1.0):
            # the share of the rare words that is replaced; the last words stay in every other text
            stay = len(item) - decontam.ANSWER_WORDS if rng.random() < 0.5 else len(item)
            other = [word() if w not in common and k < stay and rng.random() < share else w for k, w in enumerate(item)]
            host = rng.choice(docs)
            cut = rng.randint(0, len(host))
            if not share:
                whole.append((len(texts), i))
            texts.append(host[:cut] + other + host[cut:])
        half = len(item) // 2
        texts.append(item[half:] + item[:half])  # told in another order: half of it in a row at most
    texts += [items[0]] * 40  # a large group of copies makes all words of an item frequent
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    expected = {(k, i) for k, t in enumerate(texts) for i, item in enumerate(items) if accepted(item, t)}
    assert len(expected) > 80
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.matches(table, benchmark).collect()]
    assert len(set(got)) == len(got) and set(got) <= expected and set(whole) <= set(got)
    assert len(set(got)) >= 0.9 * len(expected), len(set(got))
    kept = {r.doc_id for r in decontam.clean(table, benchmark).collect()}
    assert kept == set(range(len(texts))) - {k for k, _ in got}


@pytest.mark.parametrize("item", ["the capital of france", "what is the capital of france", "who was the first man on the moon in july"])
def test_short_items_need_all_their_words_in_a_row(spark, item):
    words = item.split()
    rng = random.Random(3)
    scattered = [w for x in words for w in (x, rng.choice(["and", "it", "green"]))]
    texts = [(1, f"he asked {item} and left"), (2, " ".join(scattered)), (3, " ".join(words[::-1])), (4, " ".join(words[:-1])), (5, item.upper())]
    texts += [(k, " ".join(rng.choice(words + ["tree", "blue", "walks", "home", "often"]) for _ in range(80))) for k in range(10, 40)]
    table = spark.createDataFrame([(k, t) for k, t in texts if k < 10 or f" {item} " not in f" {t} "], "doc_id long, text string")
    found = decontam.matches(table, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.common) for r in found) == [(1, 7, 1.0), (5, 7, 1.0)]
    assert all(-1.000001 <= r.cosine <= 1.000001 for r in found)


def test_clean_keeps_rows_whose_ids_are_null_or_repeat(spark):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("hijklmn") for _ in range(6)) for _ in range(20))
    rows = [(1, "a clean text of its own", "x"), (1, f"before {item} after", "y"), (None, f"{item}", "z"), (None, "another clean text", "w"), (2, None, "v"), (3, "", "u")]
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(4, item), (5, None), (None, "a clean text of its own")], "item_id long, text string")
    assert sorted(r.item_id for r in decontam.clean(table, benchmark).collect()) == ["u", "v", "w", "x"]
    assert decontam.clean(table, benchmark.limit(0)).count() == 6 and decontam.clean(table.limit(0), benchmark).count() == 0
    assert decontam.clean(table, benchmark).columns == table.columns
