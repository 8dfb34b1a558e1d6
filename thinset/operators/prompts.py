"""Prompt texts rendered from catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import linearize_tagged, mark_entities, relation_sentence

# Fixed wording of the prompts.
PAIRS_TASK = "Generate {count} different Head Entity and Tail Entity with the given Relation."
SENTENCE_TASK = "Generate a sentence with the given entities and relation."
DIVERSE_TASK = "Generate a sentence with the given entities and relation in a diverse style."
LISTED_TASK = "Generate {count} different {entity} entities in the {domain} domain."
ENTITIES_TASK = "Generate text with all the given entities in the {domain} domain."
LABEL_TASK = "Identify the relation between the head entity and the tail entity in the given sentence."
SEPARATOR = "#####"


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _named(title: str, value) -> Column:
    return F.concat(F.lit(title), F.col(value) if isinstance(value, str) else value)


def _pair(head, tail) -> Column:
    return F.concat(F.lit("Head Entity: "), F.col(head), F.lit("; Tail Entity: "), F.col(tail))


def pair_prompt(count: int = 50) -> Column:
    """Ask for entity pairs of a catalogue row's relation."""
    return _lines(
        F.lit(PAIRS_TASK.format(count=count)), _named("Relation: ", "name"),
        _named("Relation Definition: ", "definition"), _named("Relation: ", "name"),
        _pair("example_head", "example_tail"), F.lit("Head Entity:"),
    )


def sentence_prompt(head: str = "head", tail: str = "tail") -> Column:
    """Ask for a sentence on a pair, after the catalogue row's example."""
    return _lines(
        F.lit(SENTENCE_TASK), _named("Relation: ", "name"),
        _pair("example_head", "example_tail"), _named("Sentence: ", "example_sentence"),
        _named("Relation: ", "name"),
        F.concat(F.lit("Head Entity1: "), F.col(head), F.lit("; Tail Entity2: "), F.col(tail)),
        F.lit("Sentence:"),
    )


def diverse_sentence_prompt(head: str = "head", tail: str = "tail") -> Column:
    """Ask for a sentence on a pair and the relation ``name``, without an example."""
    return _lines(F.lit(DIVERSE_TASK), _pair(head, tail), _named("Relation: ", "name"), F.lit("Sentence:"))


def entity_list_prompts(catalogue: DataFrame) -> DataFrame:
    """Ask for more entities of each type of an entity catalogue (``entity, prompt``).

    The examples of a type are numbered by ``place``; a type without any ends at its
    heading.  The lists come from one small file a type.
    """
    item = F.when(F.col("example").isNotNull(), F.struct(
        "place", F.concat(F.col("place").cast("string"), F.lit(". "), F.col("example")).alias("line")))
    kinds = catalogue.groupBy("entity", "definition", "examples", "wanted", "domain").agg(
        F.sort_array(F.collect_list(item)).alias("_items"))
    task = F.lit(LISTED_TASK)
    for slot, value in (("count", "wanted"), ("entity", "entity"), ("domain", "domain")):
        task = F.replace(task, F.lit("{" + slot + "}"), F.col(value).cast("string"))
    return kinds.select("entity", F.array_join(F.concat(
        F.array("definition", F.concat(F.lit("Examples: "), "examples"), task,
                F.concat("entity", F.lit(":"))), F.col("_items.line")), "\n").alias("prompt"))


def entity_set_prompts(
    df: DataFrame, group_col: str, entity_col: str, domain: str = "AI"
) -> DataFrame:
    """Ask for one text per group of entities (in order of the entity)."""
    names = F.array_join(F.sort_array(F.collect_set(entity_col)), ", ")
    return df.groupBy(group_col).agg(
        F.concat(F.lit(ENTITIES_TASK.format(domain=domain) + "\nEntities: "), names).alias("prompt")
    )


def exemplar(style: str, sentence="sentence", head="head", tail="tail", relation="name") -> Column:
    """One labelled example: ``plain``, ``sentence``, ``marked`` or ``tagged``."""
    if style == "plain":
        return _lines(_named("Sentence: ", sentence), _pair(head, tail), _named("Relation: ", relation))
    if style == "sentence":
        return _lines(_named("Sentence: ", sentence), relation_sentence(head, tail, relation))
    if style == "marked":
        return F.concat(mark_entities(sentence, head, tail), _named(" Relation: ", relation))
    if style == "tagged":
        return linearize_tagged(sentence, head, tail, relation)
    raise ValueError(f"unknown exemplar style {style!r}")


def few_shot_block(
    examples: DataFrame, group_cols: list[str], order_col: str, style: str = "plain", *,
    shots: int,
) -> DataFrame:
    """Labelling prompt head per group: task, relation names, exemplars in order.

    A prompt shows the first ``shots`` exemplars of its group, but names all of the
    group's relations, in order of their first exemplar.  Names are made distinct and
    exemplars chosen before they are gathered, so a big group never is.
    """
    names = examples.groupBy(*group_cols, "name").agg(F.min(order_col).alias("_first")).groupBy(*group_cols).agg(
        F.sort_array(F.collect_list(F.struct("_first", "name"))).alias("_names"))
    turn = F.row_number().over(Window.partitionBy(*group_cols).orderBy(order_col))
    ready = examples.withColumn("_turn", turn).filter(F.col("_turn") <= shots).select(
        *group_cols, order_col, exemplar(style).alias("_text"))
    listed = F.sort_array(F.collect_list(F.struct(order_col, "_text")))
    return ready.groupBy(*group_cols).agg(listed.alias("_all")).join(names, group_cols).select(
        *group_cols,
        _lines(
            F.lit(LABEL_TASK),
            _named("Relation: ", F.array_join(F.col("_names.name"), "; ")),
            F.lit(SEPARATOR),
            F.array_join(F.col("_all._text"), "\n"),
        ).alias("prompt"),
    )
