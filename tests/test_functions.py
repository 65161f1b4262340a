from __future__ import annotations

import json
import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import evaluation, learning, localize, plagiarism, scoring, segments, signals, verdict
from scriptorium.operators.features import FEATURE_ORDER, featurize
from scriptorium.plans import engine, queries
from scriptorium.sources import documents, store
from tests.helpers import agree

EDGE = ["", "   ", "una", "¡Hola! ¿Qué tal?... bien.", "uno\r\ndos\rtres\n\ncuatro", "A—B “c” … 3.5 ½ 😀 straße", "- uno\n- dos\n\n1. tres\n\na) x", "sin punto " * 800, "Además, cabe destacar que en general suele ser así. " * 5]


def column(spark, values, c):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r.x for r in rows.select("i", c(F.col("text")).alias("x")).orderBy("i").collect()]


def test_normalized_is_idempotent_and_joins_lines(spark):
    once = column(spark, EDGE, T.normalized)
    assert column(spark, once, T.normalized) == once
    assert column(spark, ["uno\ndos  tres\r\n \r\n\ncuatro ", None], T.normalized) == ["uno dos tres\n\ncuatro", ""]


def test_sentences_keep_offsets(spark):
    for text, found in zip(EDGE, column(spark, EDGE, T.sentences), strict=True):
        for s in found:
            assert text[s.text_start :].startswith(s.text) and s.text == text[s.start : s.end].strip()
        expected = [m.group().strip() for m in re.finditer(r"[^.!?…\n]+[.!?…]*\n*", text) if m.group().strip()]
        assert [s.text for s in found] == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab ñé.,!\n-—1½", max_size=60), min_size=1, max_size=20))
def test_words_and_folding(spark, texts):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    assert column(spark, texts, T.words) == [[w.lower() for w in re.findall(r"[^\W\d_]+", t)] for t in texts]
    plain = [t.replace("½", "") for t in texts]
    assert column(spark, plain, T.match_tokens) == [re.findall(r"\w+", fold(t)) for t in plain]


def test_occurrences_count_substrings(spark):
    assert column(spark, ["no me gusta y me gusta", "pues despues"], lambda c: T.occurrences(c, ["me gusta", "no me gusta", "pues"])) == [3, 2]


def test_features_of_edge_texts(spark):
    rows = featurize(spark.createDataFrame([(i, t) for i, t in enumerate([*EDGE, None])], "id int, text string")).collect()
    assert all(r.f[k] is not None for r in rows for k in FEATURE_ORDER)
    empty = next(r.f for r in rows if r.id == 0)
    assert empty.word_count == 0 and empty.paragraph_len_cv == 0.5 and empty.sentence_start_diversity == 1.0 and empty.char_trigram_diversity == 1.0


def test_lexicons_raise_signals(spark):
    text = " ".join(["Además, cabe destacar que hoy en día la importancia de esto es fundamental."] * 6)
    row = featurize(spark.createDataFrame([(1, text)], "id int, text string")).select(signals.probability(F.col("f")).alias("p"), F.col("f.generic_count").alias("g")).first()
    assert row.g >= 18 and row.p > 50


def test_common_run_and_spans(spark):
    texts = spark.createDataFrame([(1, "Antes. El gato negro duerme en la casa vieja. Después.")], "id long, text string")
    refs = spark.createDataFrame([(7, 7, "fuente", "Dicen que el gato NEGRO duerme en la casa vieja siempre.")], "ref_id long, ref_order long, name string, text string")
    row = plagiarism.located(plagiarism.flagged_sentences(texts, refs), refs).first()
    assert row.copy_text == "El gato negro duerme en la casa vieja" and row.matched_words == 8 and row.source_fragment == "el gato NEGRO duerme en la casa vieja"


def test_blocks_pack_greedily(spark):
    text = "\n\n".join(" ".join(["uno"] * n) for n in (20, 40, 60, 10))
    rows = localize.block_rows(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("block").collect()
    assert [r.words for r in rows] == [60, 70]


def test_regions_extend_and_drop_single(spark):
    values = [0.2, 0.6, 0.7, 0.36, None, 0.2, 0.1, 0.1]
    rows = spark.createDataFrame([(1, i, 10, v, 1.0) for i, v in enumerate(values)], "id long, sent int, words int, score double, confidence double")
    assert [(r["first"], r["last"]) for r in localize.regions(rows).collect()] == [(0, 3)]


@pytest.mark.parametrize(("similarity", "ai", "expected"), [(0, 32, 68), (0, 0, 99), (50, 40, 30)])
def test_originality(spark, similarity, ai, expected):
    assert spark.range(1).select(verdict.originality(F.lit(similarity), F.lit(ai)).alias("x")).first().x == expected


def test_evidence_is_a_slice(spark):
    text = "Además, cabe destacar — hoy en día — que SUELE pasar…"
    found = column(spark, [text], lambda c: segments.evidence(c, F.lit(0)))[0]
    assert [e.kind for e in found] == ["conector", "generica", "tipografia", "generica", "tipografia", "atenuador", "tipografia"]
    assert all(text[e.start : e.end] == e.text for e in found)


def test_analysis_of_copied_text(spark):
    source = "La fotosíntesis convierte la luz del sol en energía química dentro de las hojas verdes de las plantas."
    docs = spark.createDataFrame([(1, source + " Yo creo que es bonito."), (2, "Otra cosa muy distinta, sin nada que ver con plantas."), (3, "  ")], "id long, text string")
    refs = spark.createDataFrame([(7, 7, "fuente", source)], "ref_id long, ref_order long, name string, text string")
    rows = {r.id: r for r in engine.analyze(docs, refs).collect()}
    assert set(rows) == {1, 2} and rows[1].plagiarism >= 50 and rows[2].plagiarism == 0
    assert all(1 <= r.originality <= 99 and 3 <= r.ai_probability <= 97 for r in rows.values())


def test_batch_reports_failures_and_peers(spark):
    text = "el perro corre por el campo verde toda la mañana de abril"
    files = spark.createDataFrame([(1, "a", text, None), (2, "b", text + " sin parar", None), (3, "c", " ", None), (4, "d", None, "malo")], "id long, name string, text string, error string")
    rows = {r.id: r for r in engine.batch(files).collect()}
    assert rows[1].cross_source == "b" and rows[1].ok and not rows[3].ok and rows[4].error == "malo"


def test_model_round_trip(spark):
    texts = [(i, int(i % 2), (["Además, cabe destacar la importancia de esto."] if i % 2 else ["Yo vi un gato ayer, jaja, qué risa me dio."]) * (3 + i % 4)) for i in range(16)]
    rows = featurize(spark.createDataFrame([(i, y, " ".join(t)) for i, y, t in texts], "key long, y int, text string")).select("key", "y", learning.vector(F.col("f")).alias("x"), "f")
    model, report = learning.train(rows.select("key", "y", "x"), epochs=50)
    assert report["trained"] and report["cv"]["accuracy"] > 0.8
    again = learning.Model.from_json(model.to_json())
    assert [round(r.p, 9) for r in rows.select(model.probability(F.col("f")).alias("p")).collect()] == [round(r.p, 9) for r in rows.select(again.probability(F.col("f")).alias("p")).collect()]


def test_store_and_sources(spark, tmp_path):
    table = store.references(spark, f"file://{tmp_path}")
    table.append(spark.createDataFrame([("b", "dos"), ("a", "uno")], "name string, text string").withColumn("created_at", F.current_timestamp()), "name")
    assert [(r.id, r.name) for r in table.read().orderBy("id").collect()] == [(1, "a"), (2, "b")]
    table.delete(F.col("id") == 1)
    assert [r.name for r in table.read().collect()] == ["b"]
    table.delete()
    assert table.read().isEmpty()
    files = spark.createDataFrame([("x.txt", 4, "año".encode()), ("y.md", 3, "año".encode("latin-1")), ("z.exe", 1, b"1")], "path string, length long, content binary")
    found = {r.path: r for r in documents.uploaded(spark, files).collect()}
    assert found["x.txt"].text == found["y.md"].text == "año" and found["z.exe"].error


def one(spark, text, c):
    return spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first().x


def test_offsets_of_very_long_texts(spark):
    text = " ".join(f"Palabra{i} sigue." if i % 7 == 0 else f"w{i}" for i in range(20_000))
    row = one(spark, text, T.sentences(F.col("t")))
    assert all(text[s["start"] : s["end"]].strip() == s["text"] for s in row) and len(row) == 2858
    spans = one(spark, text, plagiarism.token_spans(F.col("t")))
    assert len(spans) > 20_000 and [text[a["start"] : a["end"]] for a in spans[:3]] == ["Palabra0", "sigue", "w1"]
    for odd in ("", " ", "...", "\n\n"):
        assert one(spark, odd, T.sentences(F.col("t"))) == []


def test_a_reference_given_twice(spark):
    table = spark.createDataFrame([("r", "uno dos tres cuatro cinco seis siete"), ("r", "uno dos tres cuatro cinco seis siete")], "name string, text string")
    refs = documents.references(table)
    texts = documents.inline(spark, [(1, "Uno dos tres cuatro cinco seis siete.")])
    assert refs.select("ref_id").distinct().count() == 2
    assert [(r.overlap, r.rank) for r in plagiarism.top_matches(plagiarism.containment(texts, refs)).orderBy("rank").collect()] == [(100, 1), (100, 2)]
    assert plagiarism.flagged_sentences(texts, refs).count() == 1


def test_batch_against_a_corpus(spark):
    copied = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce"
    stored = documents.stored_references(spark.createDataFrame([(1, "viejo", copied), (2, "nuevo", copied)], "id long, name string, text string"))
    files = spark.createDataFrame([(1, "a.txt", copied, None), (2, "b.txt", copied, None), (3, "c.exe", None, "formato no admitido")], "id long, name string, text string, error string")
    rows = {r.id: r for r in engine.batch(files, documents.references(stored)).collect()}
    assert (rows[1].plagiarism, rows[1].cross_source, rows[1].cross_overlap) == (100, "b.txt", 100) and rows[2].cross_source == "a.txt" and not rows[3].ok
    order = plagiarism.batch_matches(engine.normalized(files.where("error is null")), documents.references(stored)).where("id = 1").orderBy("rank").collect()
    assert [r.peer for r in order] == [False, False, True]
    with pytest.raises(ValueError, match="no more than 2"):
        engine.batch(files, most_files=2)


def test_cross_matches_meet_shared_shingles_once(spark, tmp_path):
    line = " ".join(f"palabra{i}" for i in range(24))
    rows = [(i, f"{line} propio{i} texto{i % 7} otro{i % 3} mas{i % 5} fin{i % 2}") for i in range(40)]
    rows += [(50, line), (51, "uno dos"), (52, "Uno, dos"), (53, "uno dos"), (54, None), (54, ""), (None, line), (7, f"{line} otra fila del mismo id"), (60, f"{line} " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/written")
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    agree(spark, queries.QUERIES["batch_cross_match"], queries.ORACLES["batch_cross_match"], str(tmp_path))
    texts = spark.createDataFrame(rows[:41], "ref_id long, text string").withColumn("peer", F.lit(True))
    lists = {len(r.met): r.w for r in plagiarism.shared_lists(texts).collect()}
    assert lists[41] == 20  # the line's shingles, met once


def test_copy_evidence_names_its_source(spark):
    copied = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce"
    texts = documents.inline(spark, [(1, f"Texto propio al principio del documento. {copied.capitalize()}.")])
    refs = documents.references(spark.createDataFrame([("libro", f"Antes. {copied}. Después.")], "name string, text string"))
    marks = engine.scored(texts)
    found = engine.segmented(texts, marks, localize.sentence_scores(texts), engine.copied(texts, refs)[1]).where("overlap > 0").collect()
    assert [(e["kind"], e["source_fragment"], e["matched_words"]) for e in found[0].evidence if e["kind"] == "copia"] == [("copia", copied, 12)]


def test_evaluation_and_model_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", "ia", 80), ("a", "ia", 20), ("c", "humano", 10), ("d", "humano", 50), ("m", "mixto", 30), ("n", "mixto", 71), ("x", "otro", 1)], "path string, label string, ai_probability int")
    judged = evaluation.judged(rows)
    assert [(r.path, r.right) for r in judged.collect()] == [("c", True), ("d", False), ("a", False), ("b", True), ("m", True), ("n", False)]
    found = evaluation.report(judged)
    assert (found["tp"], found["fp"], found["tn"], found["fn"], found["mixed_right"], found["mixed"], found["brier"]) == (1, 1, 1, 1, 1, 2, round((0.04 + 0.64 + 0.01 + 0.25) / 4, 4))
    assert evaluation.report(judged.where("false")) == {}
    path = f"file://{tmp_path}/model"
    assert learning.load(spark, path) is None and learning.status(spark, path) == {"loaded": False, "meta": None}
    for bias in (1.0, 2.0):
        learning.save(spark, learning.Model([0.5], bias, [0.0], [1.0]), path, {"n": bias})
    model, report = learning.load(spark, path)
    assert (model.bias, report, learning.status(spark, path)["loaded"]) == (2.0, {"n": 2.0}, True)
    train, test = learning.split(spark.range(4000), "id")
    assert train.count() + test.count() == 4000 and 900 < test.count() < 1100


def test_history_and_training_files(spark, tmp_path):
    texts = documents.inline(spark, [(1, "Un texto corto para el historial."), (2, "Otro texto, algo distinto.")])
    history = store.history(spark, f"file://{tmp_path}")
    history.append(store.saved(engine.analyze(texts), texts), "id")
    rows = history.read().orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2] and json.loads(rows[0].payload)["originality"] == rows[0].originality and rows[0].title.startswith("Un texto")
    name = store.import_example(spark, f"file://{tmp_path}/training", history.read(), 1, "humano")
    assert (tmp_path / "training" / "humano" / name).read_text() == rows[0].text and name == "hist1_un_texto_corto_para_el_historial.txt"
    with pytest.raises(LookupError):
        store.import_example(spark, f"file://{tmp_path}/training", history.read(), 9, "ia")
    assert store.undo_last_example(spark, str(tmp_path)) is None
    store.add_example(spark, str(tmp_path), "ia", "primero")
    store.add_example(spark, str(tmp_path), "humano", "segundo")
    assert store.undo_last_example(spark, str(tmp_path)).first().text == "segundo"
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/examples").collect()] == ["primero"]
    (tmp_path / "referencias").mkdir()
    (tmp_path / "referencias" / "libro.txt").write_text("texto")
    assert [tuple(r) for r in documents.reference_folders(spark, str(tmp_path)).collect()] == [("libro.txt", "texto")]


def test_only_some_features(spark):
    docs = spark.createDataFrame([(1, "Además, hoy llueve. Sin embargo, salimos — creo — a la calle.\n\nEs fundamental, generalmente."), (2, ""), (3, None)], "id int, text string")
    whole = {r.id: r.f.asDict() for r in featurize(docs).collect()}
    some = {r.id: r.f.asDict() for r in featurize(docs, only=signals.USED).collect()}
    assert some == {k: {x: v for x, v in f.items() if x in signals.USED} for k, f in whole.items()}
    plan = featurize(docs, only=["avg_sentence_len"])._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "log2" not in plan.lower()


def test_openers_look_at_a_text_once(spark):
    texts = ["Además, sí", "  ADEMAS no", "Ademáséñ no", "en resumen", "En resúmenes", "", " Por ello.", "por ellos"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.starts_with_opener(F.col("t")).alias("o"))
    assert [r.o for r in sorted(rows.collect())] == [True, True, False, True, False, False, True, False]
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("translate(") == 1


def test_gathered_rows_are_the_same(spark):
    scores = spark.createDataFrame([(1, 0, 5, 0.5), (1, 1, 6, None), (2, 0, 7, 0.1)], "id int, sent int, words int, score double")
    assert sorted(localize.gathered(scores).collect()) == sorted(scores.collect()) and localize.gathered(scores).columns == scores.columns


def test_few_pieces_are_dealt_out(spark):
    from scriptorium.session import spread

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(100).coalesce(cores)
    assert spread(rows).rdd.getNumPartitions() == cores and spread(rows, 4).rdd.getNumPartitions() == 4 * cores


def test_analyze_scores_sentences_once(spark):
    texts = spark.createDataFrame([(1, "Uno dos tres. Cuatro cinco seis.")], "id int, text string")
    scores = localize.gathered(localize.sentence_scores(engine.normalized(texts)))
    both = localize.mixture(scores).join(localize.regions(scores), "id", "outer")
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_scores_of_windows_and_blocks_are_those_of_their_features(spark):
    rng = random.Random(4)
    parts = ["Además, en la actualidad", "suele", "SUELE ", "ΟΔΟΣ", "además²", "1. ", "- uno", "jaja…", "...", " . ", "“dos” — tres", "e\u0301l mi_7", "x", "\x0b", "\u2028", "por un lado", "Por", "otro lado", "İ", "creo que", "me gusta", "\n", "\n\n", "\x1c\n", ".", "?!", "podría, pues", "ⅷ ½", "٣)", "a) b", "日本"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", ". "]) for _ in range(rng.randrange(1, 160))) for _ in range(150)]
    texts += ["", " ", "Título\nDice algo más. " * 30, "palabra " * 130 + "fin. Otra frase corta.", "\n\n".join(["Además, es esencial decir algo de esto."] * 20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    by = ["id", "sent"]
    plain = featurize(localize.sentence_windows(rows), "window", only=signals.USED).select(*by, "words", F.col("f.word_count").alias("n"), F.when(F.col("f.word_count") >= 12, signals.heuristic(F.col("f"))).alias("p"))
    assert sorted(scoring.over_sentences(rows, 12).collect()) == sorted(plain.collect())
    whole = rows.withColumn("words", F.lit(1))
    assert sorted(scoring.over_texts(whole).collect()) == sorted(featurize(whole, only=signals.USED).select("id", "words", signals.heuristic(F.col("f"))).collect())
    every = [*FEATURE_ORDER, *queries.RAW]
    listed = lambda d: sorted(d.select("id", *[F.col(f"f.{k}").alias(k) for k in every]).collect())
    assert listed(scoring.featured(rows)) == listed(featurize(rows))


@pytest.mark.parametrize("short", [False, True])
def test_only_texts_that_share_a_shingle_are_cut_into_sentences(spark, short):
    texts = spark.createDataFrame([(1, "Nada. Uno dos tres cuatro cinco seis. Corta."), (2, "Otra cosa sin relación con nada. Muy corta."), (3, "uno")], "id long, text string")
    refs = spark.createDataFrame([(7, 7, "uno dos tres cuatro cinco seis")] + [(8, 8, "muy corta")] * short, "ref_id long, ref_order long, text string")
    right = plagiarism.shingle_rows(refs, "ref_id", "ref_order")
    assert {r.id for r in plagiarism.sharing(texts, refs, right).collect()} == ({1, 2, 3} if short else {1})
    assert {(r.id, r.sent, r.ref_id, r.overlap) for r in plagiarism.flagged_sentences(texts, refs).collect()} == {(1, 1, 7, 100)} | ({(2, 1, 8, 100)} if short else set())
