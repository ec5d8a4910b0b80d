"""Selection and quality criteria from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "ARRAY<STRUCT<label: STRING, description: STRING>>"
_SELECTION = f"""review_topic STRING, additional_context STRING,
inclusion_criteria {_ITEM}, exclusion_criteria {_ITEM}"""
_QUALITY = """topic STRING, criteria ARRAY<STRUCT<
label: STRING, category: STRING, question: STRING, description: STRING, scoring: STRING>>"""


def criteria_problems(criteria: DataFrame, kinds: list[str]) -> DataFrame:
    """``(kind, problem, label)``: kinds without criteria, labels used twice."""
    twice = (
        criteria.groupBy("kind", "label")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("kind", F.lit("duplicate label").alias("problem"), "label")
    )
    wanted = criteria.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    empty = wanted.join(criteria.select("kind"), "kind", "left_anti").select(
        "kind", F.lit("no criteria").alias("problem"), F.lit(None).cast("string").alias("label")
    )
    return twice.unionByName(empty)


def _checked(criteria: DataFrame, kinds: list[str]) -> DataFrame:
    # One row per kind and problem, however many labels have it.
    kinds_of = criteria_problems(criteria, kinds).groupBy("kind", "problem")
    found = kinds_of.agg(F.count("*").alias("n"), F.min("label").alias("first")).orderBy("kind", "problem").collect()
    if found:
        text = "; ".join(f"{r['kind']}: {r['problem']} {r['first'] or ''}".strip() + f" ({r['n']})" for r in found)
        raise ValueError(f"invalid criteria: {text}")
    return criteria


# What a criterion of each kind of file has to say, and the texts of the file itself.
_SHAPES = {
    "selection": (("review_topic",), {"inclusion_criteria": ("label", "description"),
                                      "exclusion_criteria": ("label", "description")}),
    "quality": (("topic",), {"criteria": ("label", "category", "question", "description", "scoring")}),
}


def criteria_violations(files: DataFrame, shape: str = "selection") -> DataFrame:
    """Everything wrong with many criteria files: ``(path, code, place, value)``.

    ``files`` has ``path`` and the JSON ``text`` of each file. Reported are
    texts that are no JSON of this shape, texts that are missing or no strings,
    lists without criteria and labels used twice, all of them at once. A file is
    one row from end to end: nothing is shuffled, and rows are as independent as files.
    """
    texts, lists = _SHAPES[shape]
    schema = ", ".join(
        [f"{t} VARIANT" for t in texts]
        + [f"{name} ARRAY<STRUCT<{', '.join(f'{f}: VARIANT' for f in fields)}>>" for name, fields in lists.items()]
    )
    read = F.from_json("text", f"{schema}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    found = files.select("path", "text", read.alias("c"))

    def one(code: str, place: Column, value: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), place.alias("place"), value.cast("string").alias("value"))

    nothing = F.lit(None).cast("string")
    never = F.filter(F.array(one("", F.lit(""), nothing)), lambda _: F.lit(False))

    def no_text(value: Column, place: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        wrong = F.array(one("not_a_text", place, F.to_json(value)))
        absent = F.array(one("missing_text", place, nothing))
        return F.when(kind == "VOID", absent).when(kind != "STRING", wrong).otherwise(never)

    def listed(name: str, fields: tuple[str, ...]) -> Column:
        items = F.coalesce(F.col("c")[name], F.array().cast(found.schema["c"].dataType[name].dataType))
        empty = F.when(F.size(items) == 0, F.array(one("no_criteria", F.lit(name), nothing))).otherwise(never)

        def item_texts(item: Column, i: Column) -> Column:
            return F.concat(*[no_text(item[f], F.format_string(f"{name}[%d].{f}", i)) for f in fields])

        labels = F.filter(F.transform(items, lambda item: F.try_variant_get(item["label"], "$", "string")), F.isnotnull)
        again = F.transform(labels, lambda x, i: F.when(F.array_position(labels, x) <= i, x))
        twice = F.array_distinct(F.filter(again, F.isnotnull))
        named_twice = F.transform(twice, lambda x: one("duplicate_label", F.lit(name), x))
        return F.concat(empty, F.flatten(F.transform(items, item_texts)), named_twice)

    parts = [no_text(F.col("c")[t], F.lit(t)) for t in texts] + [listed(*entry) for entry in lists.items()]
    broken = F.col("c").isNull() | F.col("c._broken").isNotNull() | (F.trim(F.coalesce("text", F.lit(""))) == "")
    violations = F.when(broken, F.array(one("invalid_json", F.lit(""), nothing))).otherwise(F.concat(*parts))
    return found.select("path", F.explode(violations).alias("v")).select("path", "v.*")


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, context, kind, ord, label, description)``."""
    config = spark.read.schema(_SELECTION).json(path, multiLine=True)
    parts = [
        config.select(
            F.col("review_topic").alias("topic"),
            F.col("additional_context").alias("context"),
            F.lit(kind).alias("kind"),
            F.posexplode(f"{kind}_criteria").alias("ord", "c"),
        ).select("topic", "context", "kind", "ord", "c.*")
        for kind in ("inclusion", "exclusion")
    ]
    return _checked(parts[0].unionByName(parts[1]), ["inclusion", "exclusion"])


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, kind, ord, label, category, question, description, scoring)``."""
    config = spark.read.schema(_QUALITY).json(path, multiLine=True)
    rows = config.select(
        "topic", F.lit("quality").alias("kind"), F.posexplode("criteria").alias("ord", "c")
    ).select("topic", "kind", "ord", "c.*")
    return _checked(rows, ["quality"])
