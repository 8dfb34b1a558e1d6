"""One query per operator; each takes ``(spark, folder of parquet tables)``."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thinset.functions import arrays, text
from thinset.operators import cover, degree, links, metrics, prompts, sampling, similarity
from thinset.operators.coverage import coverage_search, sample_acs
from thinset.plans import experiment, model
from thinset.plans.downsample import downsample, register_sampler
from thinset.sources import catalogues, files, tables, vocabulary
from thinset.workspace import new_path, save, save_packed, spread, with_position

SEED = 42


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rated(spark, folder) -> DataFrame:
    """Documents that have labels."""
    docs = table(spark, folder, "documents")
    return docs.join(table(spark, folder, "labels"), "doc_id")


def rated_text(spark, folder) -> DataFrame:
    return rated(spark, folder).select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"),
        F.col("quality").alias("label"),
    )


# ---- samplers -------------------------------------------------------------

def random_sample(spark, folder):
    docs = table(spark, folder, "documents")
    return sampling.sample_random(docs, 100, SEED, "doc_id").select("doc_id", "lang", "n_chars")


def random_sample_events(spark, folder):
    return sampling.sample_random(table(spark, folder, "events"), 5000, SEED, "event_id").select(
        "event_id", "user_id", "event_type"
    )


def stratified_sample(spark, folder):
    rows = sampling.sample_stratified(rated(spark, folder), 100, "quality", SEED, "doc_id")
    return rows.select("doc_id", "quality", "n_chars")


def stratified_sample_events(spark, folder):
    events = table(spark, folder, "events")
    rows = sampling.sample_stratified(events, 1000, "event_type", SEED, "event_id")
    return rows.select("event_id", "event_type")


def group_sample(spark, folder):
    talk = table(spark, folder, "conversations")
    return sampling.sample_groups(talk, 20, "conv_id", SEED).select("conv_id", "turn", "role")


def score_sample(spark, folder):
    """First places of a stored ranking (here: longest documents first)."""
    docs = table(spark, folder, "documents")
    ranking = with_position(
        docs.select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], "rank"
    ).select(F.lit("large_loss").alias("method"), "rank", F.col("doc_id").alias("row_id"))
    path = new_path(spark, "ranking")
    tables.write_ranking(ranking, path)
    stored = tables.read_ranking(spark, path, "large_loss")
    return sampling.sample_score(docs, 200, stored, "doc_id").select("doc_id", "n_chars")


def selection_replay(spark, folder):
    docs = table(spark, folder, "documents")
    path = new_path(spark, "selection")
    for k in (50, 150):
        chosen = sampling.sample_random(docs, k, SEED, "doc_id").select(
            F.lit("kmeans").alias("method"), F.lit(k).alias("k"), F.col("doc_id").alias("row_id")
        )
        tables.write_selection(chosen, path)
    stored = tables.read_selection(spark, path, "kmeans", 150)
    return sampling.sample_selection(docs, stored, "doc_id").select("doc_id", "source")


def holdout(spark, folder):
    rows = sampling.mark_holdout(rated(spark, folder), 0.1, SEED, "doc_id")
    return rows.select("doc_id", "is_holdout")


def holdout_stratified(spark, folder):
    rows = sampling.mark_holdout(rated(spark, folder), 0.1, SEED, "doc_id", "quality")
    return rows.select("doc_id", "quality", "is_holdout")


def shuffled_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return with_position(docs, [sampling.lot(SEED, "doc_id"), F.col("doc_id")], "place")


def dispatcher_cases(spark, folder):
    """The cases of the dispatcher: no sampling, k not below n, a registered sampler with an extra."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")

    def longest(df, k, *, column, id_col, **_):
        return df.orderBy(F.col(column).desc(), id_col).limit(k)

    register_sampler("longest", longest)
    cases = {
        "none": downsample(docs, "None"), "whole": downsample(docs, "random", docs.count(), id_col="doc_id"),
        "random": downsample(docs, "random", 50, SEED, id_col="doc_id"),
        "longest": downsample(docs, "longest", 50, id_col="doc_id", column="n_chars"),
    }
    parts = [found.select(F.lit(name).alias("method"), "doc_id") for name, found in cases.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- counts, text, vocabulary ---------------------------------------------

def label_distribution(spark, folder):
    return metrics.label_distribution(table(spark, folder, "embeddings"))


def label_counts(spark, folder):
    return metrics.count_labels(table(spark, folder, "embeddings"))


def last_group(spark, folder):
    return table(spark, folder, "conversations").agg(F.max("conv_id").alias("last_id"))


def linearized_orders(spark, folder):
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    context = text.join_tokens(text.fields(F.concat_ws(" ", "o_orderpriority", "c_mktsegment")))
    return orders.select(
        "o_orderkey", text.linearize(context, "c_name", "o_orderpriority").alias("sentence"),
        text.linearize_tagged(context, "c_name", "o_orderpriority", "c_mktsegment").alias("tagged"),
        text.relation_sentence("c_name", "o_orderpriority", "c_mktsegment").alias("stated"),
    )


def marked_entities(spark, folder):
    talk = table(spark, folder, "conversations")
    words = text.fields("text")
    return talk.select(
        "conv_id", "turn",
        text.mark_entities(
            "text", F.coalesce(F.get(words, F.lit(0)), F.lit("")),
            F.coalesce(F.get(words, F.size(words) - 1), F.lit("")),
        ).alias("marked"),
    )


def vocabulary_index(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("label"))
    ordered = with_position(parts.select("label").distinct(), ["label"], "idx")
    return vocabulary.index_labels(parts, ordered).select("p_partkey", "label", "label_idx")


def cleaned_text(spark, folder):
    return text.clean_text(table(spark, folder, "events"), "props").select("event_id", "props")


def joined_splits(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    english, other = docs.filter("lang = 'en'"), docs.filter("lang <> 'en'")
    return english.unionByName(other)


def array_scores(spark, folder):
    rows = table(spark, folder, "embeddings")
    best = arrays.argmax("embedding")
    return rows.select(
        "vec_id", best.alias("best"),
        F.round(F.get(arrays.softmax("embedding"), best), 6).alias("best_share"),
        F.round(arrays.total(arrays.sigmoid("embedding")), 6).alias("sigmoid_sum"),
        F.round(arrays.cosine("embedding", F.reverse("embedding")), 6).alias("mirror"),
    )


# ---- similarity graph -----------------------------------------------------

VECTORS = {"id_col": "vec_id", "digits": 6}


def label_edges_at(spark, folder, floor, **options):
    return similarity.cosine_edges(
        table(spark, folder, "embeddings"), floor, label_col="label", **VECTORS, **options
    )


def vector_ids(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"))


def cosine_edges(spark, folder):
    return similarity.cosine_edges(table(spark, folder, "embeddings"), 0.2, **VECTORS)


def cosine_edges_pivots(spark, folder):
    """The same pairs by cells around pivots and small blocks."""
    return similarity.cosine_edges(
        table(spark, folder, "embeddings"), 0.2, pivots=8, block_rows=90, **VECTORS)


def strongest_edges(spark, folder):
    """At most five pairs around each lower id, over many small blocks."""
    return similarity.cosine_edges(
        table(spark, folder, "embeddings"), 0.1, max_degree=5, block_rows=90, **VECTORS)


def label_edges(spark, folder):
    return label_edges_at(spark, folder, 0.1)


def node_degrees(spark, folder):
    return degree.node_degrees(label_edges_at(spark, folder, 0.1))


def degree_histogram(spark, folder):
    return degree.degree_histogram(label_edges_at(spark, folder, 0.1), vector_ids(spark, folder))


def top_neighbors(spark, folder):
    return degree.top_neighbors(label_edges_at(spark, folder, 0.05), 5)


def mutual_cap(spark, folder):
    return degree.cap_degree_mutual(label_edges_at(spark, folder, 0.05), 5)


def sequential_cap(spark, folder):
    # Pairs that the cap is sure to drop (see similarity.py) are not stored.
    return degree.cap_degree(save_packed(label_edges_at(spark, folder, 0.05, max_degree=5)), 5)


def insertion_order(spark, folder):
    pairs = similarity.similar_pairs(
        table(spark, folder, "embeddings"), 0.1, label_col="label", with_first=True, **VECTORS
    )
    firsts = similarity.first_seen(pairs.filter(F.col("kind") == similarity.FIRST), 0.1)
    return cover.node_order(vector_ids(spark, folder), firsts).select("id", "ord")


def _cover(spark, folder, theta, k, label_col):
    vectors = table(spark, folder, "embeddings")
    nodes = vector_ids(spark, folder)
    if label_col:
        nodes = vectors.select(F.col("vec_id").alias("id"), F.col(label_col).alias("grp"))
    graph = links.linked(vectors, k, vec_col="embedding", label_col=label_col, **VECTORS)
    if graph:  # pairs that are too many to store are computed where they are asked for
        edges = graph.at(theta)
        firsts = edges.first_seen()
    else:
        pairs = similarity.similar_pairs(  # stored there, as both kinds are read
            vectors, theta, label_col=label_col, with_first=True, **VECTORS
        )
        firsts = similarity.first_seen(pairs.filter(F.col("kind") == similarity.FIRST), theta)
        edges = pairs.filter(F.col("kind") == similarity.EDGE)
    return cover.max_cover(edges, nodes, k, save(cover.node_order(nodes, firsts)))


def max_cover(spark, folder):
    return _cover(spark, folder, 0.25, 25, "label")


def max_cover_unlabelled(spark, folder):
    return _cover(spark, folder, 0.25, 25, None)


def acs_sample(spark, folder):
    rows = table(spark, folder, "embeddings")
    return sample_acs(rows, 50, id_col="vec_id", digits=6).select("vec_id", "label")


def acs_picks(spark, folder):
    """Picks of the last probe with gains, over all labels at once."""
    found = coverage_search(
        table(spark, folder, "embeddings"), 50, 0.5, sim_lb=0, id_col="vec_id", digits=6
    )
    return found.picks


def coverage_probes(spark, folder):
    """Every probe of a search: threshold, coverage, picks and covered rows."""
    return coverage_search(
        table(spark, folder, "embeddings"), 12, 0.5, label_col="label", sim_lb=0, id_col="vec_id",
        digits=6, max_degree=1_000_000, epsilon=0.0,
    ).probe_table()


def acs_duplicates(spark, folder):
    """The branch for samples larger than the wanted coverage: copies (of another
    length) are picked once, zero vectors are copies of nothing."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    longer = rows.filter("vec_id % 3 = 0").select(
        F.col("vec_id") + 1_000_000_000, F.transform("embedding", lambda x: x * F.lit(2).cast("float")))
    zeros = rows.filter("vec_id % 7 = 0").select(
        F.col("vec_id") + 2_000_000_000, F.transform("embedding", lambda x: F.lit(0).cast("float")))
    vectors = save(rows.union(longer).union(zeros))
    return coverage_search(vectors, vectors.count(), 0.5, id_col="vec_id").picks


def duplicate_cover(spark, folder):
    docs = table(spark, folder, "documents")
    return cover.duplicate_cover(docs, ["text"], 50, "doc_id")


# ---- scores ---------------------------------------------------------------

def _guessed(spark, folder):
    return rated(spark, folder).select(
        "doc_id", F.col("quality").alias("label"),
        (F.col("n_chars") > 500).cast("int").alias("prediction"),
    )


def classification_report(spark, folder):
    report = metrics.classification_report(_guessed(spark, folder))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                         "support")


def stored_report(spark, folder):
    gold = rated(spark, folder).select("doc_id", F.col("toxic").alias("label"))
    guess = table(spark, folder, "documents").select(
        "doc_id", (F.col("lang") == "de").cast("int").alias("prediction")
    )
    report = metrics.classification_report(metrics.align(gold, guess, "doc_id"))
    path = new_path(spark, "report")
    tables.write_report(report, path)
    stored = spark.read.schema(report.schema).json(path)
    return stored.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                         "support")


def named_metrics(spark, folder):
    found = metrics.evaluate(_guessed(spark, folder), model.DEFAULT_METRICS)
    return found.select("metric", F.round("value", 6).alias("value"))


def _tokens(spark, folder):
    """Words of the conversation turns, tagged by length and by their first letter."""
    talk = table(spark, folder, "conversations")
    words = talk.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sentence_id"),
        F.posexplode(text.fields("text")).alias("token_pos", "sentence"),
    )
    long, capital = F.length("sentence") >= 7, F.col("sentence").rlike("^[A-Z]")
    gold = (F.when(capital, "B-name").when(long, "I-name")
            .when(F.length("sentence") == 6, "I-term").otherwise("O"))
    guess = (F.when(capital & long, "B-name").when(long, "I-name")
             .when(F.length("sentence") >= 5, "I-term").otherwise("O"))
    return words.withColumn("label", gold).withColumn("guess", guess)


def bio_spans(spark, folder):
    return metrics.bio_spans(_tokens(spark, folder))


def _rounded_scores(found):
    return found.select(
        *[F.col(c).cast("long").alias(c) for c in ("gold", "predicted", "matched")],
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
    )


def entity_scores(spark, folder):
    tokens = _tokens(spark, folder)
    gold = tokens.select("sentence_id", "token_pos", "label")
    guess = tokens.select("sentence_id", "token_pos", F.col("guess").alias("label"))
    return _rounded_scores(metrics.entity_scores(gold, guess))


def tuple_scores(spark, folder):
    events = table(spark, folder, "events")
    keys = ["user_id", "event_type"]
    gold = events.filter(F.col("event_id") % 3 != 0).select(*keys)
    guess = events.filter(F.col("value") > 50).select(*keys)
    return _rounded_scores(metrics.set_scores(gold, guess, keys))


# ---- sources and sinks ----------------------------------------------------

def csv_source(spark, folder):
    """Labelled text written as TSV and loaded through the CSV source."""
    path = new_path(spark, "tsv")
    rated_text(spark, folder).select("sentence", "label").write.options(
        header=True, sep="\t", escape='"', quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    loaded, _ = files.load_custom_csv(
        spark, {"train_path": path, "text_col": "sentence", "label_col": "label", "separator": "\t"}
    )
    return loaded.select(F.md5("sentence").alias("text_key"), "label")


def relation_source(spark, folder):
    """Relation samples derived from the turns, stored as JSON lines and loaded."""
    ids = F.array(*[F.lit(x) for x in vocabulary.RELATION_IDS])
    words = text.fields("text")

    def mention(*at):
        # In a turn of fewer words the last one stands for those that are missing.
        last = F.col("n_words") - 1
        where = F.to_json(F.array(F.array(*[F.least(F.lit(i), last) for i in at])))
        return F.concat(F.lit('["n","Q1",'), where, F.lit("]"))

    rows = table(spark, folder, "conversations").filter(F.size(words) > 0).select(
        F.get(ids, (F.col("conv_id") % 64).cast("int")).alias("rel"),
        F.to_json(F.struct(words.alias("tokens"))).alias("tokens"), F.size(words).alias("n_words"),
    )
    sample = F.concat(
        F.expr("substring(tokens, 1, length(tokens) - 1)"),
        F.lit(',"h":'), mention(0), F.lit(',"t":'), mention(1, 2), F.lit("}"),
    )
    path = new_path(spark, "relations")
    rows.select(F.concat(F.lit('{"'), "rel", F.lit('":['), sample, F.lit("]}"))).write.text(path)
    return files.load_fewrel(spark, path, lines=True).select("sentence", "label")


def _write_bio(spark, folder, path=None, which="true"):
    path = path or new_path(spark, "bio")
    lines = _tokens(spark, folder).filter(which).groupBy("sentence_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "token_pos", F.concat_ws(" ", "sentence", "label").alias("line")
        ))).alias("_l")
    )
    (
        lines.orderBy("sentence_id")
        .select(F.concat(F.array_join(F.col("_l.line"), "\n"), F.lit("\n")))
        .write.text(path)
    )
    return path


def bio_token_source(spark, folder):
    """Tagged turns as blank-line separated token files; ids restart densely."""
    tokens = files.load_bio_tokens(spark, _write_bio(spark, folder))
    dense = with_position(tokens.select("sentence_id").distinct(), ["sentence_id"], "place")
    return tokens.join(dense, "sentence_id").select(
        F.col("place").alias("sentence_id"), "token_pos", "sentence", "label"
    )


def bio_sentence_source(spark, folder):
    return files.load_bio_sentences(spark, _write_bio(spark, folder)).select("row_id", "sentence")


def train_and_dev_source(spark, folder):
    """Tagged turns as train, dev and test files; the dev part goes on after train."""
    path = new_path(spark, "tagged")
    for name, which in (("train", "sentence_id % 2 = 0"), ("dev", "sentence_id % 2 = 1"), ("test", "true")):
        _write_bio(spark, folder, f"{path}/{name}.txt", which)
    data = files.load_dataset(spark, "crossner", {"train_path": path})
    return data.train.select("row_id", "sentence")


def _write_segments(spark, folder, path):
    """Customers as labelled TSV in order of their keys."""
    table(spark, folder, "customer").orderBy("c_custkey").select(
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("sentence"), F.col("c_nationkey").alias("label")
    ).write.options(header=True, sep="\t").csv(path)


def sst2_source(spark, folder):
    """Both splits of a folder of TSV files, through the router by name."""
    path = new_path(spark, "splits")
    for name in ("train.tsv", "test.tsv"):
        _write_segments(spark, folder, f"{path}/{name}")
    data = files.load_dataset(spark, "sst2", {"train_path": path})
    parts = [part.select(F.lit(name).alias("split"), "row_id", "sentence", "label")
             for name, part in (("train", data.train), ("test", data.test))]
    return parts[0].unionByName(parts[1])


def limited_source(spark, folder):
    """The first 100 rows of delimited files in file order."""
    path = new_path(spark, "tsv")
    _write_segments(spark, folder, path)
    return files.read_labelled_csv(spark, path, "sentence", "label", sep="\t", limit=100)


def stored_embeddings(spark, folder):
    path = new_path(spark, "vectors")
    table(spark, folder, "embeddings").write.parquet(path)
    vectors = tables.read_embeddings(spark, path, "vec_id")
    return vectors.select("vec_id", F.size("embedding").alias("dims"),
                          F.round(arrays.norm("embedding"), 4).alias("norm"))


def entity_catalogue(spark, folder):
    """One prompt file per region that lists its nations, read back as rows."""
    rows = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    place = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey"))
    numbered = rows.select("r_regionkey", "r_name", place.alias("place"), "n_name")
    entity = F.lower("r_name")
    text_ = numbered.groupBy("r_regionkey", "r_name").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "n_name"))),
        lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["n_name"])), "\n").alias("items")
    ).select("r_regionkey", F.concat(
        entity, F.lit(": a nation of it\nExamples: see below\nGenerate 15 different "), entity,
        F.lit(" entities in the AI domain.\n"), F.col("items")).alias("value"))
    path = new_path(spark, "entities")
    text_.repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return catalogues.read_entity_catalogue(spark, path)


def relation_definitions(spark, folder):
    path = new_path(spark, "definitions")
    table(spark, folder, "part").select(F.concat(
        F.lit("Relation: "), "p_partkey", F.lit("\nRelation Definition: made by "), "p_brand").alias("value")
    ).write.text(path)
    return catalogues.read_relation_definitions(spark, path)


def relation_catalogue(spark, folder):
    """One prompt file per supplier, read back as catalogue rows."""
    rows = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.concat(F.lit("P"), "s_suppkey").alias("pid"), F.col("n_name").alias("name"),
        F.concat(F.lit("supplies from "), "n_name").alias("definition"),
        F.col("s_name").alias("example_head"), F.col("n_name").alias("example_tail"),
    )
    path = new_path(spark, "prompts")
    catalogues.write_prompt_files(rows.select("pid", prompts.pair_prompt().alias("value")), path)
    return catalogues.read_relation_catalogue(spark, path).drop("example_sentence")


def batch_predictions(spark, folder):
    """Whole texts scored by a foreign model in Arrow batches, through the CSV sink."""
    def make_model():
        return lambda texts: np.array([len(str(t)) % 2 for t in texts], dtype=np.int64)

    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    path = new_path(spark, "out") + "/" + tables.predictions_path("in/documents.csv", "").strip("/")
    tables.write_predictions(model.predict_with(make_model, docs).drop("text"), path)
    return spark.read.option("header", True).schema(
        "doc_id long, lang string, predicted_label long"
    ).csv(path)


# ---- prompts --------------------------------------------------------------

def _customer_relations(spark, folder):
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return customers.select(
        "c_custkey", F.col("n_name").alias("name"),
        F.concat(F.lit("customer in "), "n_name").alias("definition"),
        F.col("c_name").alias("example_head"), F.col("n_name").alias("example_tail"),
        F.concat("c_name", F.lit(" buys in "), "n_name").alias("example_sentence"),
        F.col("c_mktsegment").alias("head"), F.col("c_name").alias("tail"),
    )


def pair_prompts(spark, folder):
    return _customer_relations(spark, folder).select("c_custkey", prompts.pair_prompt().alias("prompt"))


def sentence_prompts(spark, folder):
    return _customer_relations(spark, folder).select(
        "c_custkey", prompts.sentence_prompt().alias("prompt")
    )


def _order_examples(spark, folder):
    return table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", F.concat(F.lit("order of "), "o_orderpriority").alias("sentence"),
        F.lit("order").alias("head"), F.col("o_orderpriority").alias("tail"),
        F.col("o_orderstatus").alias("name"),
    )


def few_shot_prompts(spark, folder):
    return prompts.few_shot_block(_order_examples(spark, folder), ["o_custkey"], "o_orderkey", "marked", shots=8)


def exemplars(spark, folder):
    return _order_examples(spark, folder).select(
        "o_orderkey", *[prompts.exemplar(s).alias(s) for s in ("plain", "sentence", "tagged")]
    )


def entity_set_prompts(spark, folder):
    items = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return prompts.entity_set_prompts(items, "l_orderkey", "p_brand")


# ---- models ---------------------------------------------------------------

def embedded_texts(spark, folder):
    """Vectors of a foreign embedder, called in batches of 32."""
    def embedder():
        def run(texts):
            return np.array([[len(str(t)), str(t).count("e")] for t in texts], dtype=np.float32)
        return run

    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    vectors = model.embed(docs, "text", embedder)
    return vectors.select(
        "doc_id", F.get("embedding", F.lit(0)).cast("double").alias("length"),
        F.get("embedding", F.lit(1)).cast("double").alias("e_count"),
    )


def embedded_tfidf(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    vectors = model.embed(docs, "text")
    return vectors.select(
        "doc_id", F.size("embedding").alias("dims"), F.round(arrays.norm("embedding"), 4).alias("norm")
    )


def train_and_report(spark, folder):
    """Classes and support of a whole run's report; the scores depend on the model."""
    _, report = experiment.run_experiment(
        rated_text(spark, folder), method="stratified", k=200, stratify=True
    )
    return report.select("class", "support")


def stored_model(spark, folder):
    """Every text labelled by a model that was trained, stored and loaded again."""
    path = new_path(spark, "classifier")
    model.train_classifier(rated_text(spark, folder), path=path)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = model.predict(path, docs)
    return found.select("doc_id", F.col("predicted_label").isin("0", "1").alias("known"))


def method_sweep(spark, folder):
    train, test = sampling.holdout_split(rated_text(spark, folder), 0.1, SEED)
    found = experiment.sweep(
        train, test, ["random", "stratified"], experiment.size_grid(train.count(), 3),
        dataset="documents",
    )
    path = new_path(spark, "sweep")
    tables.write_sweep(found, path)
    stored = spark.read.schema(experiment.SWEEP_SCHEMA).parquet(path)
    return stored.select("dataset", "method", "k", "repeat", "seed")


QUERIES = {
    f.__name__: f
    for f in (
        random_sample, random_sample_events, stratified_sample, stratified_sample_events,
        group_sample, score_sample, selection_replay, holdout, holdout_stratified, shuffled_rows,
        label_distribution, label_counts, last_group, linearized_orders, marked_entities,
        vocabulary_index, cleaned_text, joined_splits, array_scores, cosine_edges, label_edges,
        cosine_edges_pivots, strongest_edges, coverage_probes,
        node_degrees, degree_histogram, top_neighbors, mutual_cap, sequential_cap,
        insertion_order, max_cover, max_cover_unlabelled, acs_sample, acs_picks, duplicate_cover,
        classification_report, stored_report, named_metrics, bio_spans, entity_scores,
        tuple_scores, csv_source, relation_source, bio_token_source, bio_sentence_source,
        relation_catalogue, batch_predictions, pair_prompts, sentence_prompts, few_shot_prompts,
        exemplars, entity_set_prompts, embedded_texts, embedded_tfidf, train_and_report,
        method_sweep, dispatcher_cases, acs_duplicates, train_and_dev_source, sst2_source,
        limited_source, stored_embeddings, entity_catalogue, relation_definitions, stored_model,
    )
}
