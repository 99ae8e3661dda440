"""Very long texts, empty tables, columns with clashing names and odd ids, for every operator; language by plain Bayes."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from thermagrid.llm import capfilters, chat, decontam, language, lines, mixing, repeats, setjoin, sharding, textkit, warc

#: Names that operators use inside, or that their results have.
CLASH = [
    "__doc", "__gone", "__again", "__row", "__lang", "__score", "lang_pred", "score", "n", "rep", "cluster", "size", "copies", "rank", "shard", "slot", "route",
    "component", "component_id", "n_shingles", "variant", "spans", "starts", "kept", "key", "mark", "group", "bundle", "item_id", "common", "cosine",
]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    texts += [texts[0], texts[1] + " tail", None, ""]
    rows = [(i, t, "aa" if i % 2 else "bb", f"s{i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df, df.select("*", *[F.lit(7).alias(c) for c in CLASH])


def same(a, b):
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize(
    "operator",
    [
        setjoin.groups,
        lines.deduplicate,
        lambda d: mixing.mix(d),
        repeats.without_repeats,
        lambda d: sharding.shard(d, 3),
        lambda d: decontam.matches(d, d.select(F.col("doc_id").alias("item_id"), "text")),
        lambda d: language.predict(d.select("doc_id", "text"), language.train(d.select("text", "lang"))),
    ],
)
def test_other_columns_change_nothing(clashing, operator):
    plain, more = clashing
    same(operator(plain), operator(more))


def test_rows_keep_their_other_columns(clashing):
    plain, more = clashing
    benchmark = plain.where("doc_id = 3").select(F.col("doc_id").alias("item_id"), "text")
    for keep in (lambda d: setjoin.deduplicated(d), lambda d: decontam.clean(d, benchmark)):
        kept = keep(more)
        assert kept.columns == more.columns
        same(kept.select(plain.columns), keep(plain))
    said = language.predict(more.drop("lang_pred"), language.train(plain.select("text", "lang")), keep_text=True, named=("said", "sure"))
    assert {r.score for r in said.collect()} == {7} and said.columns[-2:] == ["said", "sure"]


LONG = textkit.CHUNK_BYTES * 2


@pytest.fixture(scope="module")
def long(spark):
    """Two near copies of over two chunks, and a short text that is a part of them."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(6)) for _ in range(30_000)]
    text = [rng.choice(words) for _ in range(LONG // 7)]
    other = [*text[:-30], "one", "two", *text[-30:]]
    passage = text[200_000:200_060]
    line = "a line that comes back in every one of these long texts"
    texts = [f"{line}\n" + " ".join(text), " ".join(other) + f"\n{line}", " ".join(passage), *[f"{line} \nx{k}" for k in range(3)]]
    assert len(texts[0].encode()) > LONG
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts, passage


def test_long_texts_join(long):
    docs, texts, _ = long
    got = {r.doc_id: r for r in setjoin.groups(docs.where("doc_id < 3"), 3, 90).collect()}
    w = texts[0].split()
    assert got[0].n_shingles == len({tuple(w[k : k + 3]) for k in range(len(w) - 2)})
    assert [got[i].component_id for i in range(3)] == [0, 0, 2]


def test_long_texts_lose_lines(long):
    docs, texts, _ = long
    got = {r.doc_id: r for r in lines.deduplicate(docs).collect()}
    assert got[0].kept == texts[0].split("\n")[1] and got[1].kept == texts[1].split("\n")[0] and got[2].n_dropped == 0
    assert got[5].kept == texts[5] and got[3].n_dropped == got[4].n_dropped == 1


def test_long_texts_lose_repeats(long):
    docs, texts, passage = long
    got = {r.doc_id: r for r in repeats.without_repeats(docs.where("doc_id < 3")).collect()}
    # all but the words that were put in, and those at the ends that no whole window covers
    assert got[0].n_removed == 0 and got[1].n_words - 40 <= got[1].n_removed < got[1].n_words and "one two" in got[1].kept
    assert got[2].n_removed == 60 and got[2].kept == ""


def test_long_texts_leak(spark, long):
    docs, _, passage = long
    item = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(passage[::-1]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, item).collect()} == {(0, 1), (1, 1), (2, 1)}
    assert {r.doc_id for r in decontam.clean(docs, item).collect()} == {3, 4, 5}


def test_long_texts_are_sized_and_sharded(long):
    docs, texts, _ = long
    assert {r.doc_id: r.size for r in mixing.mix(docs.withColumn("source", F.lit("s"))).collect()} == {i: len(t.split()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in sharding.shard(docs, 2).collect()} == {i: len(t.encode()) + 8 for i, t in enumerate(texts)}


def test_long_pages_and_turns(spark, tmp_path):
    html = "<p>" + "é" * (3 << 20)
    files = warc.write(spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "x")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = {r.p: (r.record_type, r.payload_digest) for r in warc.read(spark, files, 1 << 12).select(warc.page_id("record_id").alias("p"), "record_type", "payload_digest").collect()}
    digest = hashlib.sha1(html.encode()).hexdigest()
    assert got[1] == ("revisit", digest) and got[2] == ("response", digest) and got[3][0] == "response"
    said = [(1, 0, "user", html), (1, 1, "assistant", html + "!"), (2, 0, "user", html)]
    back = chat.read_back(chat.trees(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")), lambda raw: hashlib.sha256(raw).hexdigest()).collect()
    assert {r.conv_id: r.loss_chars for r in back} == {1: len(html) + 1, 2: 0}


def test_conversations_without_an_id_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "assistant", "c")]
    back = chat.read_back(chat.trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), lambda raw: raw.decode()).collect()
    assert sorted((str(r.conv_id), r.turns_sha256) for r in back) == [("4", "assistant\nc\n"), ("None", "assistant\nb\n"), ("None", "user\na\n")]
    assert chat.trees(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("loaded", [1 << 20, 0])
def test_a_line_of_a_row_without_id_comes_before_any(spark, loaded):
    line = "the same line of more than forty code points, in all"
    rows = [(None, line), (-5, line), (-9, line), (-9, line), (-7, f"{line}\n")]
    got = sorted((str(r.doc_id), r.n_lines, r.kept) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), loaded=loaded).collect())
    assert got == [("-5", 1, line), ("-7", 2, ""), ("-9", 1, ""), ("-9", 1, ""), ("None", 1, "")]


def test_vectors_keep_nothing_but_their_own_columns(spark):
    rows = [(k, [1.0, float(k % 2)], "a", 1, 2) for k in range(6)]
    got = capfilters.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rep int, n int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(k, 2, k % 2) for k in range(6)}


# language by plain Bayes ----------------------------------------------------------------------------------------------


def grams(text):
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    while "  " in folded:
        folded = folded.replace("  ", " ")
    for n in language.ORDERS:
        for k in range(len(folded) - n + 1):
            h = n
            for c in folded[k : k + n]:
                h = (h ^ ord(c)) * 0x9E3779B1 % (1 << 32)
                h ^= h >> 15
            yield (h * 0x85EBCA77 % (1 << 32)) >> 17


def test_language_against_plain_bayes(spark):
    rng = random.Random(6)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "äöüabefq"}
    texts = [(k, " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) + rng.choice(["", "!", " 12\n"]), x) for k in range(40) for x in letters]
    texts += [(90, "ABC\u00c4 efg", None), (91, None, "aa"), (92, "1 2", "bb"), (93, "", "cc"), (94, "a" * 3000, "aa")]
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    model = language.train(table.where("doc_id >= 10"))
    counts = {x: {} for x in letters}
    for k, t, x in texts:
        if k >= 10 and t is not None and x is not None:
            for g in grams(t) if t else ():
                counts[x][g] = counts[x].get(g, 0) + 1
    total = {x: sum(c.values()) + language.SMOOTHING * language.BUCKETS for x, c in counts.items()}
    for i, x in enumerate(model["langs"]):
        for g in range(0, language.BUCKETS, 97):
            assert model["log_p"][g, i] == pytest.approx(math.log((counts[x].get(g, 0) + language.SMOOTHING) / total[x]), rel=1e-5)
    got = {(r.text, r.lang): (r.lang_pred, r.score) for r in language.predict(table.select("text", "lang"), model, keep_text=True).collect()}
    for _, t, x in texts:
        said, score = got[t, x]
        if t is None or not any(c.isalpha() for c in t):
            assert (said, score) == ("und", 0)
            continue
        all_grams = list(grams(t))
        mean = {y: sum(math.log((counts[y].get(g, 0) + language.SMOOTHING) / total[y]) for g in all_grams) / len(all_grams) * min(len(all_grams), 64) for y in letters}
        best = max(sorted(mean), key=mean.get)
        assert said == best and score == pytest.approx(1 / sum(math.exp(v - mean[best]) for v in mean.values()), abs=1e-4)
