import numpy as np

from basalt.llm.language import CLASSES, Incidence, Spectrum, fit_language, identify, language_report

WORDS = {"en": "the and that with from this have which would there about their other these could people through between".split(), "de": "und der die nicht mit sich auch eine nach werden über zwischen können müssen größe straße dieser wieder".split(), "ru": "и в не на что как это было только может человек время когда очень после перед".split()}


def docs(spark, n=60):
    rng, rows = np.random.default_rng(2), []
    for lang, words in WORDS.items():
        rows += [(len(rows) + k, " ".join(rng.choice(words, 25)), lang, "x", 0.0) for k in range(n)]
    return spark.createDataFrame(rows + [(9000, None, "en", "x", 0.0), (9001, "", None, "x", 0.0), (9002, "123 ...", "de", "x", 0.0), (None, "the and that " * 30_000, None, "x", 0.0), (9003, "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), None, "x", 0.0)], "doc_id long, text string, lang string, lang_pred string, score double")


def test_distinct_grams():
    grams = Spectrum().grams("ab, AB!")
    one = {1, *(int(Spectrum().table[ord(c)]) for c in "ab")}
    assert len(grams) == len(set(grams.tolist())) and {g for g in grams.tolist() if g < CLASSES} == one
    sequence = [1, *(int(Spectrum().table[ord(c)]) for c in "ab"), 1, *(int(Spectrum().table[ord(c)]) for c in "ab"), 1]
    want = {tuple(sequence[k : k + n]) for n in (1, 2, 3) for k in range(len(sequence) - n + 1)}
    assert len(grams) == len(want)


def test_held_out_accuracy(spark):
    table = docs(spark)
    found = {r["id"]: r for r in language_report(table).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table.collect() if r["doc_id"] is not None and r["doc_id"] < 9000}
    held = [i for i in truth if found[i]["held_out"]]
    assert len(held) > 20 and sum(found[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (9000, 9001, 9002))
    assert found[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in found.values())


def test_scores_are_kernel_ridge_regression(spark):
    """With every text a landmark, Nyström features give the exact kernel, and the weights those of the dual problem."""
    rows = docs(spark, 12).where("doc_id < 9000")
    model = fit_language(rows, per_language=12, landmarks=12, ridge=1e-3)
    texts = [(r["text"], r["lang"]) for r in rows.collect()]
    sets = [set(Spectrum().grams(t).tolist()) for t, _ in texts]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1.0 if lang == name else -1.0 for name in model.languages] for _, lang in texts])
    weight = np.diag([1 / 12] * len(texts))
    alpha = np.linalg.solve(weight @ k + 1e-3 * np.eye(len(texts)), weight @ y)
    got = model.kernel([Spectrum().grams(t) for t, _ in texts]) @ model.weights
    assert np.abs(got - k @ alpha).max() < 1e-2


def test_nothing_to_learn_and_no_rows(spark):
    table = docs(spark, 2)
    model = fit_language(table.where("false"))
    assert {r["lang_pred"] for r in identify(table, model).collect()} == {"und"}
    assert language_report(table.where("false")).count() == 0


def test_copies_do_not_thin_out_the_training_texts(spark):
    """German has 40 texts, and 8,000 copies of one more."""
    rng = np.random.default_rng(4)
    texts = {lang: [" ".join(rng.choice(words, 25)) for _ in range(40)] for lang, words in WORDS.items()}
    rows = [(t, lang) for lang, own in texts.items() for t in own] + [("haus " * 20, "de")] * 8000 + [(f"{n} ...", "ru") for n in range(8000)]
    table = spark.createDataFrame(rows, "text string, lang string")
    model = fit_language(table, per_language=20, landmarks=20)
    assert model.languages == ["de", "en", "ru"] and len(model.incidence.scale) == 60
    assert model.predict(texts["de"])[0].count("de") > 36 and model.predict(texts["ru"])[0].count("ru") > 36


def test_letters_of_all_scripts_are_told_apart(spark):
    """Cyrillic and Greek texts whose letters differ by 128 places throughout."""
    rng = np.random.default_rng(6)
    words = ["".join(chr(0x3B1 + int(c)) for c in rng.integers(0, 25, 5)) for _ in range(40)]
    greek = [" ".join(rng.choice(words, 25)).replace("ς", "σ") for _ in range(40)]
    cyrillic = ["".join(chr(ord(c) + 128) if c != " " else c for c in t) for t in greek]
    assert set(Spectrum().grams(greek[0]).tolist()) & set(Spectrum().grams(cyrillic[0]).tolist()) == {1}
    model = fit_language(spark.createDataFrame([(t, "el") for t in greek[:30]] + [(t, "ru") for t in cyrillic[:30]], "text string, lang string"))
    assert model.predict(greek[30:])[0] == ["el"] * 10 and model.predict(cyrillic[30:])[0] == ["ru"] * 10
    assert len(Spectrum().grams("".join(chr(0x4E00 + k) for k in range(1000)))) == 3000 + 2


def test_every_language_can_be_predicted(spark):
    """250 languages, each with two letters and words of its own: more than any cut of a list of languages."""
    rng, rows = np.random.default_rng(7), []
    for n in range(250):
        words = ["".join(rng.choice([chr(0x4E00 + 20 * n + k) for k in range(12)], 4)) for _ in range(15)]
        rows += [(" ".join(rng.choice(words, 20)), f"l{n:03d}") for _ in range(10)]
    held = [rows[k] for k in range(0, 2500, 10)]
    model = fit_language(spark.createDataFrame([r for k, r in enumerate(rows) if k % 10], "text string, lang string"), all_texts=2000, all_landmarks=500)
    assert len(model.languages) == 250 and len(model.incidence.scale) == 500
    assert model.predict([t for t, _ in held])[0] == [lang for _, lang in held]


def test_sparse_products():
    rng = np.random.default_rng(8)
    texts = [np.unique(rng.integers(0, 60, size)) for size in (0, 5, 20, 40, 60)]
    marks = [np.unique(rng.integers(10, 50, size)) for size in (1, 10, 30)]
    want = [[len(set(t) & set(m)) / np.sqrt(len(m)) for m in marks] for t in texts]
    assert np.allclose(Incidence.of(marks).product(texts), want)


def test_digits_and_signs_are_no_letters(spark):
    rows = [(n, t, lang) for n, (t, lang) in enumerate([("the cat sat on the mat and the dog", "en"), ("le chat est sur la table avec le chien", "fr")] * 20)]
    odd = ["²", "½", "ⅷ", "１２", "٣", "_", "á".replace("a", ""), "² the", "ª"]
    docs = spark.createDataFrame(rows + [(1000 + n, t, None) for n, t in enumerate(odd)], "doc_id long, text string, lang string")
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in language_report(docs).collect()}
    assert [found[1000 + n] == ("und", 0.0) for n in range(len(odd))] == [True] * 7 + [False, False]


def test_the_sample_is_bounded_and_keeps_every_language(spark):
    words = {"aa": "ka ki ku", "bb": "lo le la", "cc": "zu zo za"}
    rows = [(f"{w} {n} {chr(97 + n % 26)}{chr(97 + n // 26)}", lang) for lang, w in words.items() for n in range(60)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    model = fit_language(frame, per_language=9, landmarks=4)
    assert model.languages == ["aa", "bb", "cc"] and len(model.incidence.scale) == 12
    again = fit_language(frame.repartition(7), per_language=9, landmarks=4)
    assert (model.incidence.vocab == again.incidence.vocab).all() and abs(model.weights - again.weights).max() < 1e-9
