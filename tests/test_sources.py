import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from thinset import load_dataset
from thinset.operators import prompts
from thinset.plans import experiment, model
from thinset.sources import catalogues, files, tables, vocabulary


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy("row_id").collect()]


def test_custom_csv(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        'review_text,rating,user_id\n"Loved it, ""really""!",1,101\n"two\nlines",0,102\n,0,105\n')
    (tmp_path / "test.csv").write_text("review_text,rating\nDecent,0\nAmazing,1\n")
    config = {"train_path": str(tmp_path / "train.csv"), "test_path": str(tmp_path / "test.csv"),
              "text_col": "review_text", "label_col": "rating", "nrows_test": 1}
    data = load_dataset(spark, "custom_csv", config)
    assert data.train.columns == ["row_id", "sentence", "label"]
    assert rows(data.train, "sentence", "label") == [
        ('Loved it, "really"!', 1), ("two\nlines", 0), (None, 0)]
    assert rows(data.test, "sentence") == [("Decent",)] and data.num_labels == 2
    config["test_path"] = str(tmp_path / "absent.csv")
    assert load_dataset(spark, "custom_csv", config).test is None
    config["test_path"] = None
    assert load_dataset(spark, "custom_csv", config).test is None


def test_csv_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    read = lambda name, *cols: files.read_labelled_csv(spark, str(tmp_path / name), *cols)
    for name, cols in (("none.csv", "xy"), ("empty.csv", "xy"), ("a.csv", "qy"), ("a.csv", "xq")):
        with pytest.raises(files.SourceError):
            read(name, *cols)
    with pytest.raises(files.SourceError, match="unknown data set"):
        load_dataset(spark, "unknown_format", {})
    with pytest.raises(files.SourceError):
        load_dataset(spark, "custom_csv", {"train_path": "x"})


def test_sst2(spark, tmp_path):
    for name in ("train.tsv", "test.tsv"):
        (tmp_path / name).write_text("sentence\tlabel\nso good\t1\nso bad\t0\n")
    data = load_dataset(spark, "sst2", {"train_path": str(tmp_path)})
    assert rows(data.train, "row_id", "sentence", "label") == [(0, "so good", 1), (1, "so bad", 0)]
    assert data.test.count() == 2 and data.num_labels == 2


SAMPLES = {
    "P991": [{"tokens": ["Ann", "won", "New", "York"], "h": ["ann", "Q1", [[0]]], "t": ["ny", "Q2", [[2, 3]]]}],
    "P1001": [{"tokens": ["a", "b"], "h": ["b", "Q", [[1], [0]]], "t": ["a", "Q", [[0]]]},
              {"tokens": ["c"], "h": ["c", "Q", [[0]]], "t": ["c", "Q", [[0]]]}],
}


def test_fewrel(spark, tmp_path):
    (tmp_path / "train.json").write_text(json.dumps(SAMPLES, indent=1))
    (tmp_path / "test.json").write_text(json.dumps(SAMPLES))
    data = load_dataset(spark, "fewrel", {"train_path": str(tmp_path)})
    want = [("Head Entity : Ann , Tail Entity : New York , Context : Ann won New York", 63),
            ("Head Entity : b , Tail Entity : a , Context : a b", 0),
            ("Head Entity : c , Tail Entity : c , Context : c", 0)]
    assert rows(data.train, "sentence", "label") == want
    assert data.num_labels == 2
    (tmp_path / "bad.json").write_text(json.dumps({"P0": SAMPLES["P991"]}))
    with pytest.raises(Exception, match="not in vocabulary"):
        files.load_fewrel(spark, str(tmp_path / "bad.json")).collect()


BIO = "EU B-organisation\nrejects O\n\nGerman\tB-misc\n   \n\nPeter B-person\nBlack I-person"


def test_bio(spark, tmp_path):
    for name in ("train.txt", "test.txt"):
        (tmp_path / name).write_text(BIO)
    (tmp_path / "dev.txt").write_text(BIO.replace("\n", "\r\n") + "\r\n\r\n")
    data = load_dataset(spark, "crossner", {"train_path": str(tmp_path)})
    sentences = ["EU rejects", "German", "Peter Black"]
    assert rows(data.train, "row_id", "sentence", "label") == [
        (i, s, None) for i, s in enumerate(sentences * 2)]
    data = load_dataset(spark, "crossner", {"train_path": str(tmp_path), "sentences": False})
    got = sorted(tuple(r) for r in data.train.select("sentence_id", "token_pos", "sentence", "label").collect())
    one = [(0, 0, "EU", "B-organisation"), (0, 1, "rejects", "O"), (1, 0, "German", "B-misc"),
           (3, 0, "Peter", "B-person"), (3, 1, "Black", "I-person")]
    assert got == one + [(s + 4, *rest) for s, *rest in one]
    assert data.num_labels == 5
    late = files.load_crossner(spark, str(tmp_path), sentences=False, dev_offset=2700)[0]
    assert late.agg(F.max("sentence_id")).first()[0] == 2703
    (tmp_path / "test.txt").write_text("one two three\n")
    with pytest.raises(Exception, match="token and a tag"):
        files.load_bio_tokens(spark, str(tmp_path / "test.txt")).collect()


def test_bio_ids_go_on_over_files_and_blocks(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"{part}.txt").write_text("\n\n".join(f"w{part}{i} O" for i in range(40)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = files.load_bio_tokens(spark, str(tmp_path)).orderBy("sentence_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.sentence for r in got] == [f"w{p}{i}" for p in range(3) for i in range(40)]
    assert [r.sentence_id for r in got] == list(range(120))


def test_vocabularies(spark):
    assert len(vocabulary.RELATION_IDS) == 64
    assert {d: len(t) for d, t in vocabulary.BIO_TAGS.items()} == {
        "politics": 19, "science": 35, "music": 27, "literature": 25, "ai": 29}
    assert vocabulary.bio_vocabulary(spark).count() == 135


def test_catalogues(spark, tmp_path):
    (tmp_path / "prompt_P7.txt").write_text(
        "Make pairs.\nRelation: part of\nRelation Definition: a piece: of it\nRelation: part of\n"
        "Head Entity: Arm; Tail Entity: Body\nHead Entity:")
    (tmp_path / "prompt_generate_sentence_P7.txt").write_text(
        "Make a sentence.\nRelation: part of\nHead Entity: Arm; Tail Entity: Body\n"
        "Sentence: The arm is on the body .\nRelation: part of\nHead Entity1: ; Tail Entity2:\nSentence:")
    (tmp_path / "prompt_label.txt").write_text("Relation: x")
    found = catalogues.read_relation_catalogue(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [
        ("P7", "part of", "a piece: of it", "Arm", "Body", "The arm is on the body .")]
    (tmp_path / "defs").write_text("Relation: a\nRelation Definition: A\nRelation: b\nRelation Definition: B\n####\nx")
    assert {tuple(r) for r in catalogues.read_relation_definitions(spark, str(tmp_path / "defs")).collect()} == {
        ("a", "A"), ("b", "B")}
    (tmp_path / "country.txt").write_text(
        "Country: a nation.\nExamples: 1. Japan 2. Peru\nGenerate 15 different Country entities in the AI domain.\n"
        "Country:\n1. Japan\n2. Peru\n")
    rows_ = catalogues.read_entity_catalogue(spark, str(tmp_path / "country.txt")).orderBy("place").collect()
    assert [(r.entity, r.wanted, r.domain, r.place, r.example) for r in rows_] == [
        ("Country", 15, "AI", 1, "Japan"), ("Country", 15, "AI", 2, "Peru")]


def test_rendered_prompts(spark):
    row = spark.createDataFrame(
        [("part of", "a piece", "Arm", "Body", "The arm .", "Leg", "Table")],
        "name string, definition string, example_head string, example_tail string, "
        "example_sentence string, head string, tail string")
    pair, sentence = row.select(prompts.pair_prompt(), prompts.sentence_prompt()).first()
    assert pair.split("\n") == [
        "Generate 50 different Head Entity and Tail Entity with the given Relation.",
        "Relation: part of", "Relation Definition: a piece", "Relation: part of",
        "Head Entity: Arm; Tail Entity: Body", "Head Entity:"]
    assert sentence.split("\n")[-2:] == ["Head Entity1: Leg; Tail Entity2: Table", "Sentence:"]
    with pytest.raises(ValueError):
        prompts.exemplar("other")


def test_prediction_files_and_models(spark, tmp_path):
    train = spark.createDataFrame(
        [(i, ("good fine great" if i % 2 else "bad awful poor") + f" w{i % 5}", i % 2) for i in range(60)],
        "row_id long, sentence string, label int")
    fitted, report = experiment.run_experiment(train, method="random", k=40, epochs=10)
    assert experiment.summary(report)["acc"] == 1.0
    stored = model.train_classifier(train, epochs=10, path=str(tmp_path / "model"))
    (tmp_path / "in.csv").write_text("id,text\n1,great good\n2,\n3,awful bad\n")
    inputs = spark.read.csv(str(tmp_path / "in.csv"), header=True)
    target = tables.predictions_path(str(tmp_path / "in.csv"), str(tmp_path))
    assert target.endswith("/in_predictions.csv")
    tables.write_predictions(model.predict(str(tmp_path / "model"), inputs), target)
    got = spark.read.csv(target, header=True).orderBy("id").collect()
    assert [(r.id, r.predicted_label) for r in got] == [("1", "1"), ("3", "0")]

    def lengths():
        return lambda texts: np.array([len(t) for t in texts])

    assert [r.predicted_label for r in model.predict_with(lengths, inputs).orderBy("id").collect()] == [10, 9]
    found = experiment.sweep(train, train, ["none", "random"], [20, 60], 2, "demo", skip_full=True)
    assert [(r.k, r.method, r.seed) for r in found.collect()] == [
        (20, "none", 42), (20, "none", 84), (20, "random", 42), (20, "random", 84)]


def test_entity_and_diverse_prompts(spark, tmp_path):
    text = ("City: The city entity.\nExamples: 1. Rome 2. Oslo\n"
            "Generate 15 different City entities in the AI domain.\nCity:\n1. Rome\n2. Oslo")
    (tmp_path / "prompt_city.txt").write_text(text)
    listed = catalogues.read_entity_catalogue(spark, str(tmp_path / "prompt_city.txt"))
    assert [tuple(r) for r in prompts.entity_list_prompts(listed).collect()] == [("City", text)]
    row = spark.createDataFrame([("a", "b", "r")], "head string, tail string, name string")
    assert row.select(prompts.diverse_sentence_prompt()).first()[0] == (
        "Generate a sentence with the given entities and relation in a diverse style.\n"
        "Head Entity: a; Tail Entity: b\nRelation: r\nSentence:")
