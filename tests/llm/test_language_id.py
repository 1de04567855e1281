import numpy as np

from tessera.llm import language_id as op


def test_phrases_are_those_of_greedy_longest_matches():
    text = "abracadabra abra cad banana bandana"
    model = op.Model({"x": text})

    def greedy(s):
        n = i = 0
        while i < len(s):
            k = 1
            while i + k < len(s) and s[i : i + k + 1] in text:
                k += 1
            i += k
            n += 1
        return n

    for s in ("abracadabra", "bananabra", "zzz", "band cad", "a", "dabanazr", "canad", text):
        codes, ends = op._collapsed(model.codes(s))
        assert model.phrases(codes, np.array(ends))[0, 0] == greedy(s), s


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(10_001, None, "en", "x"), (10_002, "", None, "x"), (10_003, "12 ½ %% --", "de", "x"), (10_003, "12 ½ %% --", "de", "x"), (None, "the and of " * 20, None, "x"), (10_005, "日本語", None, "x")], docs.schema)
    docs = docs.unionByName(odd)
    model = op.train(docs.where(~op.held_out()))
    assert model.langs == ["de", "en", "es", "fr"]
    got = {}
    for r in op.identify(docs, model).collect():
        assert 0 <= r["score"] <= 1
        got.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert all(got[i] == ["und"] * n for i, n in ((10_001, 1), (10_002, 1), (10_003, 2)))
    assert got[None] == ["en"] and got[10_005][0] != "und"
    held = docs.where(op.held_out() & op.F.col("lang").isNotNull() & (op.F.length("text") > 60)).collect()
    right = sum(got[r["doc_id"]][0] == r["lang"] for r in held if r["doc_id"] < 10_000)
    assert right > 0.97 * len(held)
    kept = op.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = op.train(none)
    assert op.identify(none, model).count() == 0
    some = spark.createDataFrame([(1, "words here", None)], none.schema)
    assert [tuple(r) for r in op.identify(some, op.train(some)).collect()] == [(1, "und", 0.0)]


def test_prediction_does_not_depend_on_batches():
    model = op.Model({"a": "the cat sat on the mat " * 30, "b": "le chat est sur la table " * 30})
    texts = ["the cat", "la table", None, "x" * 3000, "sat sur " * 400]
    assert model.predict(texts) == tuple(map(list, zip(*[(x[0], y[0]) for x, y in (model.predict([t]) for t in texts)])))


def test_very_long_and_repeated_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat " * 30, "a"), ("le chat est sur la table " * 30, "b")])]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    model, once = op.train(docs), op.train(spark.createDataFrame(rows, docs.schema))
    assert (model.table == once.table).all() and model.langs == once.langs
    # whole texts count: the first part is of the other language, and shorter
    text = "the cat sat " * 30_000 + "le chat est sur " * 60_000
    assert model.predict([text, text + "the cat sat on the mat " * 90_000])[0] == ["b", "a"]


def test_every_language_and_every_letter_counts(spark):
    import random

    def words(script, seed):
        rng = random.Random(seed)
        stems = ["".join(rng.choice(script) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        return lambda i: " ".join(random.Random(i).choices(stems, k=40))

    latin, han = "abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + i) for i in range(600)]
    langs = {f"l{k:02}": words(latin, k) for k in range(20)} | {"x-han": words(han[:400], 1), "y-han": words(han[200:], 2), "z-greek": words("αβγδεζηθικλμνξοπρστυφχψω", 3), "z-greek2": words("αβγδεζηθικλμνξοπρστυφχψω", 4)}
    rows = [(i, make(i), lang) for lang, make in langs.items() for i in range(8 if "-" in lang else 12)]
    model = op.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(langs)
    assert model.predict([make(1000 + i) for make in langs.values() for i in range(3)])[0] == [lang for lang in langs for _ in range(3)]


def test_sample_takes_all_rows_and_any_part_of_them(spark):
    # the language shows in the later part of its texts only; all rows lack a doc_id, and most are copies
    junk = "zq " * 400
    rows = [(None, junk + f"{w} " * 1500 + str(i % 30), lang) for lang, w in (("a", "hello world"), ("b", "bonjour monde")) for i in range(200)]
    model = op.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["hello world hello", "bonjour monde bonjour"])[0] == ["a", "b"]
    assert op._joined(["ab", "x" * 50, "y" * 50], 42) == "ab\n" + "x" * 20 + "\n" + "y" * 20
