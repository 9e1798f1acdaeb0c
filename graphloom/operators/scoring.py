"""Answer scoring and the tables made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import anls, bound, clean_answer, clean_answer_with_units, float_equal, needs_exact_match


def answer_score(answer: Column, pred: Column, kind: Column) -> Column:
    """0 to 1 for a given answer, by its format; ``answer`` and ``pred`` are arrays, of one item but for lists.

    Int: equal as whole numbers. Float: ``float_equal``. Str and None: the cleaned texts' ANLS, or equality where the
    answer is of a class that needs it. List: 0 for other lengths, 1 for two empty ones; cleaned and sorted items are equal where the first is a
    number or needs it, else the worst ANLS counts.
    """
    a, p = F.get(answer, F.lit(0)), F.get(pred, F.lit(0))
    number = lambda c: clean_answer(c).try_cast("double")
    whole = F.coalesce(a.try_cast("long") == p.try_cast("double").cast("long"), F.lit(False)).cast("double")
    floats = F.coalesce(float_equal(number(a), number(p)), F.lit(False)).cast("double")
    cleaned = F.struct(clean_answer(a).alias("x"), clean_answer(p).alias("y"))
    text = bound(cleaned, lambda v: F.when(needs_exact_match(v["x"]), (v["x"] == v["y"]).cast("double")).otherwise(anls(v["x"], v["y"])))

    def by_item(v: Column) -> Column:
        first = F.get(v["x"], F.lit(0))
        exact = first.try_cast("double").isNotNull() | needs_exact_match(first)
        worst = F.array_min(F.zip_with(v["x"], v["y"], anls))
        return F.when(F.size(v["x"]) != F.size(v["y"]), 0.0).when(F.size(v["x"]) == 0, 1.0).when(exact, (v["x"] == v["y"]).cast("double")).otherwise(worst)

    lists = bound(F.struct(*(F.array_sort(F.transform(c, clean_answer)).alias(n) for c, n in ((answer, "x"), (pred, "y")))), by_item)
    return F.when(kind == "Int", whole).when(kind == "Float", floats).when(kind.isin("Str", "None"), text).otherwise(lists)


def document_answer_score(answer: Column, pred: Column, kind: Column) -> Column:
    """0 to 1 by the rules for long documents, on arrays as in ``answer_score``; formats Integer, Float, String, None, List.

    Numbers lose commas and units. A list's score is the mean over its answers of the best ANLS among the predictions,
    times the root of the share of answers among predictions where there are more of the latter; lists that start
    with a number or an exact class must be equal. A null answer or prediction counts as an empty text.
    """
    text = lambda c: clean_answer_with_units(F.coalesce(F.get(c, F.lit(0)), F.lit("")))

    def single(v: Column) -> Column:
        whole = F.coalesce(v["x"].try_cast("long") == v["y"].try_cast("long"), F.lit(False)).cast("double")
        floats = F.coalesce(float_equal(v["x"].try_cast("double"), v["y"].try_cast("double")), F.lit(False)).cast("double")
        words = F.when(needs_exact_match(v["x"]), (v["x"] == v["y"]).cast("double")).otherwise(anls(v["x"], v["y"]))
        return F.when(kind == "Integer", whole).when(kind == "Float", floats).otherwise(words)

    def listed(v: Column) -> Column:
        first = F.get(v["x"], F.lit(0))
        best = F.transform(v["x"], lambda x: F.array_max(F.transform(v["y"], lambda y: anls(x, y))))
        mean = F.aggregate(best, F.lit(0.0), lambda s, b: s + F.coalesce(b, F.lit(0.0))) / F.size(v["x"])
        share = F.sqrt(F.least(F.lit(1.0), F.size(v["x"]) / F.size(v["y"])))
        exact = first.try_cast("double").isNotNull() | needs_exact_match(first)
        return F.when((F.size(v["x"]) == 0) | (F.size(v["y"]) == 0), 0.0).when(exact, (v["x"] == v["y"]).cast("double")).otherwise(mean * share)

    items = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: clean_answer_with_units(F.coalesce(t, F.lit(""))))
    lists = bound(F.struct(items(answer).alias("x"), items(pred).alias("y")), listed)
    return F.when(kind.isin("Integer", "Float", "String", "None"), bound(F.struct(text(answer).alias("x"), text(pred).alias("y")), single)).otherwise(lists)


# The elements of the fine-grained table, and its names for questions that locate something.
ELEMENTS = ("Text", "Layout", "Figure", "Table")
LOCATING = {"topic2title": "Cross_Title", "summary2title": "Para_Title", "summary2tab": "Cross_Table", "extract_fig2tab": "Figure_Table"}


def fine_grained(rows: DataFrame) -> DataFrame:
    """``dimension, value, n, total, score`` of ``task_tag, question_type, evidence_sources, pages, score``: sums and means by
    task, element, single or several pages, several elements, and by task with pages and element or kind of location.
    A question counts once for each element it names.
    """
    known = F.filter("evidence_sources", lambda e: e.isin(*ELEMENTS))
    pages = F.when(F.col("pages") > 1, "Multi_Page").when(F.col("pages") == 1, "Single_Page")
    key = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    path = lambda *parts: F.concat(*(x for p in parts for x in (F.lit("/"), p)))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in LOCATING.items() for x in kv)), F.col("question_type"))
    none = F.array(key("Fine_Grained", F.lit(None).cast("string")))
    fine = F.when(F.col("task_tag").isin("Understanding", "Reasoning"), F.transform(known, lambda e: key("Fine_Grained", path(F.col("task_tag"), pages, e))))
    fine = fine.when(F.col("task_tag") == "Locating", F.array(key("Fine_Grained", path(F.col("task_tag"), F.lit("Cross_Element"), kind))))
    plain = F.array(key("Main_Task", F.col("task_tag")), key("Evidence_Pages", pages), key("Num_of_Element_Types", F.when(F.size("evidence_sources") > 1, "Cross_Element")))
    keys = F.concat(plain, F.transform(known, lambda e: key("Element_Type", e)), F.coalesce(fine, none))
    each = rows.select("score", F.explode(F.filter(keys, lambda k: k["value"].isNotNull())).alias("k")).select("k.*", "score")
    return each.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"), F.round(F.avg("score"), 6).alias("score"))


def generalized_accuracy(rows: DataFrame, by: list[str], asked: int) -> DataFrame:
    """Mean ``score`` of what was answered, and rectified to all the questions that were asked."""
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    return m.select(*by, "n", F.round("m", 6).alias("generalized"), F.round(F.col("m") * F.col("n") / asked, 6).alias("rectified"))


def accuracy_f1(rows: DataFrame) -> DataFrame:
    """Accuracy over all; F1 of recall over answerable questions and precision over given answers.

    ``answer`` and ``pred`` are text, ``score`` 0 to 1; "Not answerable" stands for no answer.
    """
    none = "Not answerable"
    good = F.sum(F.when(F.col("answer") != none, F.col("score")))
    recall = good / F.count_if(F.col("answer") != none)
    precision = good / F.count_if(F.col("pred") != none)
    m = rows.agg(F.count("*").alias("n"), F.avg("score").alias("acc"), recall.alias("recall"), precision.alias("precision"))
    m = m.withColumn("f", 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision")))
    return m.select("n", F.round("acc", 6).alias("acc"), F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("f", 6).alias("f1"))


def breakdown(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Mean score and number by each dimension alone, and overall."""
    sets = rows.groupingSets([[], *([d] for d in dimensions)], *dimensions).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.grouping_id().alias("g"))
    name = F.lit("overall")
    for i, d in enumerate(dimensions):
        name = F.when(F.col("g") == (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i)), d).otherwise(name)
    return sets.select(name.alias("dimension"), F.coalesce(*(F.col(d).cast("string") for d in dimensions)).alias("value"), "n", "score")


def unanswered(questions: DataFrame, models: DataFrame, subsets: DataFrame, answered: DataFrame) -> DataFrame:
    """The grid of question, model and modality subset without what has been answered; the latter two are small."""
    grid = questions.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(subsets)).withColumn("subset_key", F.array_join(F.array_sort("subset"), ","))
    return grid.join(answered, ["question_id", "model", "subset_key"], "left_anti").select("question_id", "model", "subset_key")
