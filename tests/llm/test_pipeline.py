"""The pipeline on a small folder: what each stage must drop, keep and return."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = {"en": ["the", "of", "river", "house", "walk", "green", "stone", "paper"], "de": ["der", "und", "fluß", "haus", "gehen", "grün", "stein", "papier"]}

    def text(lang, n=60):
        return " ".join(rng.choice(words[lang]) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))

    item = " ".join("".join(rng.choice("uvwxyz") for _ in range(6)) for _ in range(25))
    docs = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(40)]
    docs += [(100, docs[0][1], "de", "s0", 1), (101, docs[1][1] + " more", "en", "s1", 1), (102, docs[2][1] + " " + item, None, None, 1), (103, None, "en", "s1", 1), (104, "1 2 3", "en", "s1", 1), (105, "", None, "s2", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
        assert name == "shards" or now.columns == columns
    clean = set(range(40))
    assert seen[0] == clean | {100, 101, 102}
    assert seen[1] == clean | {102}
    assert seen[2] == clean
    assert seen[3] <= clean and len(seen[3]) > 20 and seen[4] == seen[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == seen[4]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mix", "shards"]
    left = [p.name for p in (tmp_path / "scratch").glob("stage-*")] if (tmp_path / "scratch").exists() else []
    assert not left


def folder_with(spark, path, rows, schema, items):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = folder_with(spark, tmp_path, [], schema, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "words of a text", None, None, 3), (2, None, None, "s", 0)], schema)
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, some, str(tmp_path)).collect()] == [1]
    assert corpus_pipeline.decontaminate(spark, some, str(tmp_path)).count() == 2


def test_stages_keep_clashing_columns_and_rows_without_ids(spark, tmp_path):
    rng = random.Random(4)
    clash = ["__words", "__doc", "__source", "__size", "__total", "__n", "__copy", "__gone", "__lang", "__score", "size", "copies", "lang_pred"]

    def text(n=30):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    item = " ".join("".join(rng.choice("stuvwx") for _ in range(6)) for _ in range(20))
    one = text()
    rows = [(i, text(), "aa", "s", 1) for i in range(6)] + [(None, text(), "aa", "s", 1), (None, text(), "aa", "s", 1), (7, f"{item} {text()}", "aa", "t", 1), (None, item, "aa", "t", 1)]
    rows += [(8, one, "aa", None, 1), (8, one, "aa", None, 1), (9, "", "aa", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` int" for c in clash)
    docs = folder_with(spark, tmp_path, [(*r, *[5] * len(clash)) for r in rows], schema, [(1, item)])

    def ids(df):
        assert df.columns == docs.columns and df.where(" or ".join(f"`{c}` <> 5" for c in clash)).count() == 0
        return sorted(str(r.doc_id) for r in df.collect())

    every = sorted(str(r[0]) for r in rows)
    assert ids(corpus_pipeline.identify_language(spark, docs, str(tmp_path))) == sorted(x for x in every if x != "9")
    kept = list(every)
    kept.remove("8")
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))) == kept
    clean = list(every)
    clean.remove("7")
    clean.remove("None")
    assert ids(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == clean
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    from thermagrid.llm import mixing

    wanted = {}
    for r in mixing.mix(docs).collect():
        wanted[str(r.doc_id)] = wanted.get(str(r.doc_id), 0) + r.copies
    got = {}
    for x in ids(mixed):
        got[x] = got.get(x, 0) + 1
    assert got == {k: v for k, v in wanted.items() if v}
    assert sorted(r.doc_id for r in corpus_pipeline.assign_shards(spark, docs, str(tmp_path)).where("doc_id is not null").collect()) == sorted(r[0] for r in rows if r[0] is not None)
