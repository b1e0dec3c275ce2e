"""Grouped questions: one aggregate, optional filters, up to two group columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.columns import SUMMARY, ColumnInfo, SpecError, columns_from_schema
from tabscope.functions import vocabulary as V
from tabscope.functions.values import number_text
from tabscope.operators.aggregates import aggregate, apply_filters, bucket_label, default_grain, drop_summary_rows, text_form

AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max")
NUMERIC_AGGREGATES = ("sum", "avg", "min", "max")
SORTS = ("desc", "asc", "label")
MAX_SERIES = 6
MAX_HEADLINES = 6


@dataclass(frozen=True)
class Question:
    """A small spec; ``filters`` use the dashboard form."""
    measure: str | None = None
    agg: str = "count"
    group_by: tuple[str, ...] = ()
    filters: tuple[dict, ...] = ()
    grain: str | None = None
    sort: str = "desc"
    limit: int = V.DEFAULT_GROUP_ROWS
    id: str = "Q-001"
    purpose: str = ""


@dataclass
class Answer:
    """``summary``: one row (value, matched, excluded_summary_rows).
    ``groups``: key1[, key2], value, share, groups_total, truncated, position."""
    question: Question
    summary: DataFrame | None = None
    groups: DataFrame | None = None
    grain: str | None = None
    error: str | None = None
    columns: dict[str, ColumnInfo] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.error is None


def _check(question: Question, columns: dict[str, ColumnInfo]) -> None:
    if question.agg not in AGGREGATES:
        raise SpecError(f"unknown aggregate {question.agg!r}")
    if question.measure is None:
        if question.agg != "count":
            raise SpecError(f"{question.agg} needs a column")
    else:
        info = columns.get(question.measure)
        if info is None:
            raise SpecError(f"unknown column {question.measure!r}")
        if question.agg in NUMERIC_AGGREGATES and info.role != "measure" and info.data_type not in ("number", "mixed"):
            raise SpecError(f"{info.name} is not numeric")
    if len(question.group_by) > 2 or len(set(question.group_by)) != len(question.group_by):
        raise SpecError("group by one or two different columns")
    for name in question.group_by:
        if name not in columns:
            raise SpecError(f"unknown group column {name!r}")


def ask(df: DataFrame, question: Question, columns: dict[str, ColumnInfo] | None = None) -> Answer:
    """Plan one question.  Raises ``SpecError`` when it does not fit the table."""
    columns = columns or columns_from_schema(df)
    _check(question, columns)
    limit = min(question.limit, V.MAX_GROUP_ROWS) if isinstance(question.limit, int) and question.limit >= 1 else V.DEFAULT_GROUP_ROWS
    sort = question.sort if question.sort in SORTS else "desc"
    matched = apply_filters(drop_summary_rows(df), list(question.filters), columns)
    value = aggregate(df, question.agg, question.measure)
    excluded = (df.agg(F.count_if(F.col(SUMMARY)).alias("n")).scalar() if SUMMARY in df.columns else F.lit(0)).cast("bigint")
    summary = matched.agg(value.alias("value"), F.count(F.lit(1)).alias("matched")).withColumn("excluded_summary_rows", excluded)
    answer = Answer(question, summary, columns=columns)
    if not question.group_by:
        return answer

    labels = []
    for i, name in enumerate(question.group_by, 1):
        info = columns[name]
        if info.role == "time" or info.data_type == "date":
            answer.grain = question.grain if question.grain in V.GRAINS else default_grain(matched, info)
            labels.append(bucket_label(df, info, answer.grain).alias(f"key{i}"))
        else:
            labels.append(text_form(df, name).alias(f"key{i}"))
    keys = [f"key{i}" for i in range(1, len(labels) + 1)]
    # Null groups stay in until the total is known: the share base is every matched row.
    every = matched.groupBy(*labels).agg(value.alias("value"))
    shown = every.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "value"]]))
    shares = question.agg in ("sum", "count")
    base = every.agg(F.sum("value").alias("t")).scalar() if shares else F.lit(None)
    order = {"desc": [F.col("value").desc()], "asc": [F.col("value").asc()], "label": []}[sort] + [F.col(k).asc() for k in keys]
    top = shown.orderBy(*order).limit(limit)
    total = shown.agg(F.count(F.lit(1)).alias("n")).scalar()
    answer.groups = (top.withColumn("_base", base.cast("double")).withColumn("groups_total", total)
                     .select(*keys, "value", F.when(F.col("_base") != 0, F.col("value") / F.col("_base") * 100).alias("share"),
                             "groups_total", (F.col("groups_total") > limit).alias("truncated")))
    return answer


def merge_questions(questions: list[Question]) -> list[Question]:
    """Equal questions become one that keeps the larger limit."""
    merged: dict[str, Question] = {}
    for q in questions:
        key = repr((q.measure, q.agg, q.group_by, q.grain, q.filters))
        kept = merged.get(key)
        if kept is None:
            merged[key] = q
        elif q.limit > kept.limit:
            merged[key] = Question(**{**kept.__dict__, "limit": q.limit})
    return list(merged.values())


def ask_many(df: DataFrame, questions: list[Question], columns: dict[str, ColumnInfo] | None = None) -> list[Answer]:
    """Up to 12 questions; one that does not fit, or comes after the twelfth, fails alone, with a message."""
    columns = columns or columns_from_schema(df)
    answers = []
    for question in merge_questions(list(questions)[:V.MAX_QUESTIONS]):
        try:
            answers.append(ask(df, question, columns))
        except SpecError as error:
            answers.append(Answer(question, error=str(error), columns=columns))
    answers += [Answer(q, error=f"more than {V.MAX_QUESTIONS} questions in one batch", columns=columns) for q in list(questions)[V.MAX_QUESTIONS:]]
    return answers


def answers_table(spark, answers: list[Answer]) -> DataFrame:
    """All answers in one table: id, ok, error, key1, key2, value, share."""
    parts = []
    for a in answers:
        head = [F.lit(a.question.id).alias("id"), F.lit(a.ok).alias("ok"), F.lit(a.error).cast("string").alias("error")]
        if not a.ok:
            parts.append(spark.range(1).select(*head, F.lit(None).cast("string").alias("key1"), F.lit(None).cast("string").alias("key2"),
                                               F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("share")))
            continue
        source = a.summary if a.groups is None else a.groups
        columns = set(source.columns)
        parts.append(source.select(
            *head, *[(F.col(k) if k in columns else F.lit(None).cast("string")).alias(k) for k in ("key1", "key2")],
            F.col("value").cast("double").alias("value"), (F.col("share") if "share" in columns else F.lit(None).cast("double")).alias("share")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def to_series(answer: Answer) -> DataFrame:
    """Two-key result as one row per first key and a column per second key (first six)."""
    groups = answer.groups
    order = _position(answer)
    # At most 50 result rows by the question's limit, so the driver may list the series.
    seen = [r["key2"] for r in groups.select("key2", order.alias("o")).orderBy("o").collect()]
    series = list(dict.fromkeys(seen))[:MAX_SERIES]
    return groups.groupBy("key1").pivot("key2", series).agg(F.first("value"))


def _position(answer: Answer):
    """Sortable position of a result row in the order the question asked for."""
    keys = [F.col(f"key{i}") for i in range(1, len(answer.question.group_by) + 1)]
    if answer.question.sort == "label":
        return F.struct(*keys)
    value = F.col("value").cast("double")
    return F.struct((-value if answer.question.sort == "desc" else value).alias("v"), *keys)


def to_evidence(answer: Answer) -> DataFrame:
    """One sentence per answer that quotes every shown figure: ``evidence_id, text``."""
    q = answer.question
    subject = f"{q.agg} {q.measure}" if q.measure else "rows"
    only = "; ".join(_filter_text(f) for f in q.filters)
    head = F.concat(F.lit(f"{q.purpose or q.id}: {subject}{f' (only {only})' if only else ''} from "), number_text(F.col("matched")), F.lit(" rows"))
    if answer.groups is None:
        return answer.summary.select(F.lit(q.id).alias("evidence_id"), F.concat(head, F.lit(" = "), number_text("value")).alias("text"))
    keys = [f"key{i}" for i in range(1, len(q.group_by) + 1)]
    one = F.concat(F.concat_ws(" / ", *keys), F.lit(" = "), number_text("value"),
                   F.coalesce(F.concat(F.lit(" ("), number_text("share"), F.lit("%)")), F.lit("")))
    # At most 50 rows are joined into the sentence.
    rows = answer.groups.select(F.struct(_position(answer).alias("o"), one.alias("t")).alias("x"), "truncated", "groups_total")
    listed = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "; ").alias("rows"),
                      F.max("truncated").alias("cut"), F.max("groups_total").alias("n"), F.count(F.lit(1)).alias("shown"))
    more = F.when(F.col("cut"), F.concat(F.lit(" (showing "), F.col("shown").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" groups)"))).otherwise("")
    return (listed.withColumn("s", answer.summary.select(F.struct("value", "matched")).scalar())
            .select("*", F.col("s.value").alias("value"), F.col("s.matched").alias("matched"))
            .select(F.lit(q.id).alias("evidence_id"),
                    F.concat(head, F.lit(f" by {' and '.join(q.group_by)}: "), F.col("rows"), more, F.lit("; total "), number_text("value")).alias("text")))


def _filter_text(item: dict) -> str:
    if "values" in item:
        return f"{item['column']} = {', '.join(item['values'][:5])}{' …' if len(item['values']) > 5 else ''}"
    low, high = item.get("from", item.get("min")), item.get("to", item.get("max"))
    return f"{item['column']} {low if low is not None else '…'} to {high if high is not None else '…'}"


def headline(spark, answers: list[Answer]) -> DataFrame:
    """Totals and single-group results, at most six: ``id, label, value, note``."""
    parts = []
    for order, a in enumerate(answers):
        if not a.ok:
            continue
        q = a.question
        base = [F.lit(order).alias("o"), F.lit(q.id).alias("id"), F.lit(q.purpose or q.id).alias("label"), F.col("value").cast("double").alias("value")]
        if a.groups is None:
            parts.append(a.summary.select(*base, F.lit(q.measure or "rows").alias("note")))
        else:
            keys = [f"key{i}" for i in range(1, len(q.group_by) + 1)]
            counted = a.groups.withColumn("_n", F.when(F.col("groups_total") < q.limit, F.col("groups_total")).otherwise(F.lit(q.limit)))
            parts.append(counted.filter("_n = 1").select(*base, F.concat_ws(" / ", *keys).alias("note")))
    table = reduce(lambda a, b: a.unionByName(b), parts)
    return table.filter(F.col("value").isNotNull()).orderBy("o").limit(MAX_HEADLINES).drop("o")
