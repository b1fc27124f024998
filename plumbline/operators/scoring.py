"""Counting what a model claimed that the ground truth lacks.

Both graphs of a case become *facts*, one row each:

    (case, side, kind, a, b, c)   kind "object":   a = head, b = attribute or NULL
                                  kind "relation": a = subject, b = relation, c = object

and every count is an aggregate over facts of both sides together. No join is needed, each
shuffle moves combined rows only, and a hot case, head or relation is spread by the columns
behind it before anything is grouped by the case alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import indices, let
from plumbline.operators.nesting import PART_ROWS, nest_ordered
from plumbline.operators.scenegraph import named_relations

TRUTH, MODEL = "gt", "vlm"
OBJECT, RELATION = "object", "relation"

# Modifiers that are no attributes.
NO_ATTRIBUTE = ["a", "the", "an", ""]

_FACT = "struct<kind:string,a:string,b:string,c:string>"


def attributes(modifiers: Column) -> Column:
    """Lower-cased modifier texts without articles."""
    return F.filter(F.transform(modifiers, lambda m: F.lower(m["span"])), lambda x: ~x.isin(NO_ATTRIBUTE))


def _object_facts(head: Column, attrs: Column) -> Column:
    def fact(attribute: Column) -> Column:
        return F.struct(
            F.lit(OBJECT).alias("kind"), head.alias("a"), attribute.alias("b"), F.lit(None).cast("string").alias("c")
        )

    return F.when(F.size(attrs) > 0, F.transform(attrs, fact)).otherwise(
        F.array(fact(F.lit(None).cast("string")))
    )


def graph_facts(graphs: DataFrame, case: str, side: Column | str) -> DataFrame:
    """Facts of scene graphs. A graph without facts still leaves one empty row for its case."""
    objects = F.flatten(
        F.transform("entities", lambda e: _object_facts(F.lower(e["head"]), attributes(e["modifiers"])))
    )
    relations = F.transform(
        named_relations(F.col("entities"), F.col("relations")),
        lambda r: F.struct(
            F.lit(RELATION).alias("kind"), r["subject"].alias("a"), r["relation"].alias("b"), r["object"].alias("c")
        ),
    )
    side = F.col(side) if isinstance(side, str) else side
    return graphs.select(
        case, side.alias("side"), F.explode_outer(F.concat(objects, relations).cast(f"array<{_FACT}>")).alias("f")
    ).select(case, "side", "f.*")


def table_facts(objects: DataFrame, relations: DataFrame, case: str = "case_id") -> DataFrame:
    """Facts of reduced graphs: obj(case, side, head, attributes), rel(case, side, subj, rel, obj)."""
    from_objects = objects.select(
        case, "side", F.explode(_object_facts(F.col("head"), F.coalesce("attributes", F.array().cast("array<string>")))).alias("f")
    ).select(case, "side", "f.*")
    from_relations = relations.select(
        case, "side", F.lit(RELATION).alias("kind"),
        F.col("subj").alias("a"), F.col("rel").alias("b"), F.col("obj").alias("c"),
    )
    return from_objects.unionByName(from_relations)


def _compared(facts: DataFrame, case: str) -> DataFrame:
    """Each fact once per case: is it true, how often did the model claim it."""
    return facts.groupBy(case, "kind", "a", "b", "c").agg(
        F.max(F.col("side") == TRUTH).alias("true"),
        F.sum(F.when(F.col("side") == MODEL, 1).otherwise(0)).alias("claims"),
    )


def _judged(facts: DataFrame, case: str) -> DataFrame:
    """One row per claimed head and one per case for its relations."""
    claimed = F.col("claims") > 0
    return (
        _compared(facts, case)
        .groupBy(case, "kind", F.when(F.col("kind") == OBJECT, F.col("a")).alias("head"))
        .agg(
            F.max("true").alias("known"),
            F.max(claimed).alias("claimed"),
            F.max(claimed & F.col("b").isNotNull() & ~F.col("true")).alias("attribute_missing"),
            F.sum("claims").alias("claims"),
            F.sum(F.when(F.col("true"), 0).otherwise(F.col("claims"))).alias("unsupported"),
        )
    )


def _is_bad_object() -> Column:
    return F.col("claimed") & (~F.col("known") | F.col("attribute_missing"))


def unsupported_objects(facts: DataFrame, case: str) -> DataFrame:
    """Claimed heads the ground truth lacks, or has without one of the claimed attributes."""
    return (
        _judged(facts.where(F.col("kind") == OBJECT), case)
        .where(_is_bad_object())
        .select(case, "head", F.when(F.col("known"), F.lit("attribute")).otherwise(F.lit("object")).alias("missing"))
    )


def unsupported_relations(facts: DataFrame, case: str) -> DataFrame:
    """Claimed triples the ground truth lacks, with how often each was claimed."""
    return (
        _compared(facts.where(F.col("kind") == RELATION), case)
        .where((F.col("claims") > 0) & ~F.col("true"))
        .select(
            case, F.col("a").alias("subject"), F.col("b").alias("relation"), F.col("c").alias("object"), "claims"
        )
    )


def score_facts(facts: DataFrame, case: str, *, with_model_side: bool = True) -> DataFrame:
    """Per case the object and relation hallucination counts and what they are out of.

    A head counts once, whether it or any number of its attributes is missing; every claim of
    a missing relation counts. Cases without facts keep a zero row; cases the model never
    answered are left out unless ``with_model_side`` is false.
    """
    is_object = F.col("kind") == OBJECT
    is_relation = F.col("kind") == RELATION
    bad_object = is_object & _is_bad_object()

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("long")

    scores = (
        _judged(facts, case)
        .groupBy(case)
        .agg(
            total(is_object & F.col("claimed"), F.lit(1)).alias("objects"),
            total(is_relation, F.col("claims")).alias("relations"),
            total(bad_object, F.lit(1)).alias("object_hallucination_num"),
            total(is_relation, F.col("unsupported")).alias("relation_hallucination_num"),
            F.max("claimed").alias("_answered"),
        )
    )
    return (scores.where("_answered") if with_model_side else scores).drop("_answered")


def score_tables(objects: DataFrame, relations: DataFrame, case: str = "case_id", cases: DataFrame | None = None) -> DataFrame:
    """Scores of reduced graph tables; ``cases`` adds zero rows for cases without any fact."""
    facts = table_facts(objects, relations, case)
    if cases is not None:
        empty = cases.select(
            case, F.lit(MODEL).alias("side"), *[F.lit(None).cast("string").alias(n) for n in ("kind", "a", "b", "c")]
        )
        facts = facts.unionByName(empty)
    return score_facts(facts, case, with_model_side=False)


def metric_report(scores: DataFrame) -> DataFrame:
    """Both counters over all cases."""
    return scores.agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.sum("object_hallucination_num"), F.lit(0)).alias("object_hallucination_num"),
        F.coalesce(F.sum("relation_hallucination_num"), F.lit(0)).alias("relation_hallucination_num"),
    )


def merged_in_row(entities: Column) -> Column:
    """A document's entities, all in one row, merged by lower-cased head: array<struct<head, attributes>>.

    Attribute lists are joined in entity order, duplicates kept. Sorted by head, so each head is one
    stretch: the work is linear but for the sort, and nothing is shuffled.
    """
    by_head = F.sort_array(
        F.transform(
            entities,
            lambda e, i: F.struct(F.lower(e["head"]).alias("head"), i.alias("i"), attributes(e["modifiers"]).alias("attrs")),
        )
    )

    def merged(rows: Column) -> Column:
        starts = F.filter(indices(rows), lambda i: (i == 0) | ~F.get(rows, i)["head"].eqNullSafe(F.get(rows, i - 1)["head"]))

        def one(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, k: F.struct(
                    F.get(rows, s)["head"].alias("head"),
                    F.flatten(
                        F.transform(
                            F.slice(rows, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s), lambda r: r["attrs"]
                        )
                    ).alias("attributes"),
                ),
            )

        return let(starts, one)

    return let(by_head, merged)


def merge_entities(entities: DataFrame, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """The same for entities stored as a table: (keys, head, part, attributes).

    A head of more than ``part_rows`` entities comes in parts. The scores need no such lists.
    """
    rows = entities.select(
        *keys, F.lower("head").alias("head"), "entity_id", attributes(F.col("modifiers")).alias("attrs")
    )
    return nest_ordered(rows, [*keys, "head"], ["entity_id"], F.col("attrs"), "attributes", part_rows).withColumn(
        "attributes", F.flatten("attributes")
    )


def endpoint_heads(relations: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Relation table with lower-cased heads for its entity indexes.

    For tables stored apart; on graphs in one row ``named_relations`` needs no join.
    """
    heads = entities.select(*keys, F.col("entity_id"), F.lower("head").alias("_head"))
    rows = relations
    for end in ("subject", "object"):
        side = heads.withColumnsRenamed({"entity_id": end, "_head": f"_{end}"})
        rows = rows.join(side, [*keys, end])
    return rows.select(
        *keys, "relation_id", F.col("_subject").alias("subject"), F.lower("relation").alias("relation"), F.col("_object").alias("object")
    )
