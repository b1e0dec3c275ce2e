"""Column profiles, roles and quality of one table.

Profiles are long: one row per column.  Only such rows (as many as the table is
wide) ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.columns import ROW, ColumnInfo, data_columns, physical_kind
from tabscope.functions import vocabulary as V
from tabscope.functions.quantiles import exact_quantiles
from tabscope.functions.values import tidy
from tabscope.operators.aggregates import drop_summary_rows, numeric

TOP_VALUES = 10
HEAD_TAIL = 10
LABEL_LENGTH = 120


def _kinds(df: DataFrame) -> dict[str, str]:
    return {c: physical_kind(df.schema[c].dataType) for c in data_columns(df)}


def _long(wide: DataFrame, names: list[str], fields: dict[str, callable]) -> DataFrame:
    """One aggregated row (columns made by ``fields``) as one row per table column."""
    return (wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), *[make(i, n).alias(f) for f, make in fields.items()])
        for i, n in enumerate(names)])).alias("x")).select("x.*"))


def shorten(c: Column, limit: int = LABEL_LENGTH) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``position, column, unique_count``: exact, each column in its own type."""
    wide = df.agg(*[F.count_distinct(F.col(f"`{n}`")).alias(f"u{i}") for i, n in enumerate(names)])
    return _long(wide, names, {"unique_count": lambda i, n: F.col(f"u{i}")})


def basic_counts(df: DataFrame, names: list[str], kinds: dict[str, str]) -> DataFrame:
    """Counts and moments of every column in one scan."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        if kinds[n] == "number":
            v = c.cast("double")
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"avg{i}"),
                     F.stddev_samp(v).alias(f"sd{i}"), F.sum(v).alias(f"sum{i}"), F.count_if(v != F.floor(v)).alias(f"frac{i}")]
        elif kinds[n] == "date":
            aggs += [F.min(c).cast("string").alias(f"from{i}"), F.max(c).cast("string").alias(f"to{i}"),
                     F.count_if(c.cast("timestamp_ntz") != c.cast("date").cast("timestamp_ntz")).alias(f"clock{i}")]
    number = lambda field, kind="double": (lambda i, n: F.col(f"{field}{i}") if kinds[n] == "number" else F.lit(None).cast(kind))
    day = lambda field, kind="string": (lambda i, n: F.col(f"{field}{i}") if kinds[n] == "date" else F.lit(None).cast(kind))
    return _long(df.agg(*aggs), names, {
        "data_type": lambda i, n: F.lit(kinds[n]), "rows": lambda i, n: F.col("rows"), "count": lambda i, n: F.col(f"n{i}"),
        "min": number("lo"), "max": number("hi"), "mean": number("avg"),
        "std": lambda i, n: F.when(F.col(f"n{i}") > 0, F.coalesce(F.col(f"sd{i}"), F.lit(0.0))) if kinds[n] == "number" else F.lit(None).cast("double"),
        "sum": number("sum"), "fractional": number("frac", "bigint"), "date_min": day("from"), "date_max": day("to"), "clock": day("clock", "bigint")})


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: rows, missing, distinct, statistics, quartile fences with the number
    of values outside them, and the date range."""
    rows = drop_summary_rows(df)
    names, kinds = data_columns(rows), _kinds(rows)
    measured = [n for n in names if kinds[n] == "number"]
    base = basic_counts(rows, names, kinds).join(F.broadcast(distinct_counts(rows, names)).drop("position"), "column")
    if measured:
        fences = [(q["column"], q["q1"], *_fence(q["q0"], q["q2"], q["n"])) for q in exact_quantiles(rows, measured, [.25, .5, .75]).collect()]
        fenced = [f for f in fences if f[2] is not None]
        side = rows.sparkSession.createDataFrame(fences, "column string, median double, lower double, upper double")
        if fenced:
            wide = rows.agg(*[F.count_if((F.col(f"`{n}`") < lo) | (F.col(f"`{n}`") > hi)).alias(f"o{i}") for i, (n, _, lo, hi) in enumerate(fenced)])
            out = _long(wide, [f[0] for f in fenced], {"outliers": lambda i, n: F.col(f"o{i}")}).drop("position")
            side = side.join(F.broadcast(out), "column", "left")
        else:
            side = side.withColumn("outliers", F.lit(None).cast("bigint"))
        base = base.join(F.broadcast(side), "column", "left")
    else:
        for c, t in (("median", "double"), ("lower", "double"), ("upper", "double"), ("outliers", "bigint")):
            base = base.withColumn(c, F.lit(None).cast(t))
    missing = F.col("rows") - F.col("count")
    return base.select("position", "column", "data_type", "rows", missing.alias("missing_count"),
                       F.round(F.when(F.col("rows") > 0, missing / F.col("rows") * 100).otherwise(0), 4).alias("missing_percentage"),
                       "unique_count", F.when(F.col("data_type") == "number", F.col("count")).alias("count"),
                       "min", "max", "mean", "median", "std", "sum", "fractional", "lower", "upper", "outliers", "date_min", "date_max", "clock")


def _fence(q1, q3, n):
    if n < 4:
        return None, None
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``rows, duplicate_rows``: rows minus distinct rows over all data columns."""
    rows = drop_summary_rows(df)
    return (rows.groupBy(*[F.col(f"`{c}`") for c in data_columns(rows)]).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")))


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns, missing cells, missing % and duplicate rows."""
    rows = drop_summary_rows(df)
    names = data_columns(rows)
    counted = rows.agg(F.count(F.lit(1)).alias("rows_count"), sum((F.count_if(F.col(f"`{c}`").isNull()) for c in names), F.lit(0)).alias("missing_count"))
    cells = F.col("rows_count") * len(names)
    return (counted.withColumn("duplicate_rows", duplicate_rows(df).select("duplicate_rows").scalar())
            .select(F.lit(name).alias("table"), "rows_count", F.lit(len(names)).cast("bigint").alias("columns_count"), "missing_count",
                    F.round(F.when(cells > 0, F.col("missing_count") / cells * 100).otherwise(0), 4).alias("missing_percentage"), "duplicate_rows"))


def workbook_quality(profiles: DataFrame) -> DataFrame:
    """Completeness weighted by cells; stacked, pivot and picture-read tables are left out
    when the profile marks them with ``derived``."""
    kept = profiles.filter(~F.col("derived")) if "derived" in profiles.columns else profiles
    cells = F.sum(F.col("rows_count") * F.col("columns_count"))
    return kept.agg(F.sum("rows_count").alias("rows_count"), F.sum("missing_count").alias("missing_count"),
                    F.sum("duplicate_rows").alias("duplicate_rows"), cells.alias("cells"),
                    F.round(F.when(cells > 0, (cells - F.sum("missing_count")) / cells * 100).otherwise(0), 4).alias("completeness"))


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """``n, lower, upper, outliers``.  With no spread, anything off the quartile counts."""
    q = exact_quantiles(df.select(numeric(df, column).cast("double").alias(column)), [column], [.25, .75]).first()
    lower, upper = _fence(q["q0"], q["q1"], q["n"])
    value = numeric(df, column)
    outside = F.lit(0).cast("bigint") if lower is None else F.count_if((value < lower) | (value > upper))
    return df.agg(F.count(value).alias("n"), outside.alias("outliers")).select(
        "n", F.lit(lower).cast("double").alias("lower"), F.lit(upper).cast("double").alias("upper"), "outliers")


def iqr_outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """``_row, value`` of the outliers.  With no spread nothing is flagged; needs 8
    values and 3 distinct ones."""
    values = df.select(F.col(ROW), numeric(df, column).cast("double").alias("value")).filter("value is not null")
    q = exact_quantiles(values, ["value"], [.25, .75]).first()
    few = q["n"] < 8 or values.select("value").distinct().limit(3).count() < 3
    if few or q["q1"] <= q["q0"]:
        return values.filter(F.lit(False))
    lower, upper = _fence(q["q0"], q["q1"], q["n"])
    return values.filter((F.col("value") < lower) | (F.col("value") > upper))


def date_range(df: DataFrame, column: str) -> DataFrame:
    """``first, last``: earliest and latest as written, compared as UTC instants."""
    if physical_kind(df.schema[column].dataType) == "date":
        return df.agg(F.min(column).cast("string").alias("first"), F.max(column).cast("string").alias("last"))
    raw = tidy(column)
    instant = F.when(raw.rlike(V.ISO_DATE), F.try_to_timestamp(raw))
    return df.agg(F.min_by(raw, instant).alias("first"), F.max_by(raw, instant).alias("last"))


def top_values(df: DataFrame, names: list[str], k: int = TOP_VALUES) -> DataFrame:
    """``column, rank, value, count``; ties keep the value that appears first."""
    rows = drop_summary_rows(df)
    first = F.col(ROW) if ROW in rows.columns else F.lit(0)
    long = rows.select(first.alias("r"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])).alias("x"))
    counts = (long.filter("x.value is not null").groupBy("x.column", "x.value")
              .agg(F.count(F.lit(1)).alias("count"), F.min("r").alias("r")))
    # rank <= k is pruned in every task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), "r", "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select("column", "rank", shorten(F.col("value")).alias("value"), "count")


# ---------------------------------------------------------------- roles

def infer_roles(df: DataFrame, data_types: dict[str, str] | None = None, number_formats: dict[str, str] | None = None) -> DataFrame:
    """One row per column with ``semantic_type, role, meaning, time_format`` from its name and values.

    ``data_types`` overrides the physical kind (``mixed`` for text columns that also hold numbers)."""
    rows = drop_summary_rows(df)
    names, kinds = data_columns(rows), _kinds(rows)
    declared = {n: (data_types or {}).get(n, kinds[n]) for n in names}
    texts = [n for n in names if kinds[n] == "text"]
    base = basic_counts(rows, names, kinds).join(F.broadcast(distinct_counts(rows, names)).drop("position"), "column")
    aggs, fields = [], {}
    for i, n in enumerate(texts):
        raw = tidy(n)
        iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}(?:T.*)?$") & F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd").isNotNull()
        aggs += [F.count_if(iso).alias(f"d{i}"), F.count_if(iso & raw.contains("T")).alias(f"t{i}"), F.count_if(F.col(f"`{n}`").rlike(V.YEAR_MONTH)).alias(f"y{i}")]
        if declared[n] == "mixed":
            v = numeric(rows, n).cast("double")
            aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count_if(v != F.floor(v)).alias(f"f{i}")]
    if texts:
        mixed = lambda f, kind: (lambda i, n: F.col(f"{f}{i}") if declared[n] == "mixed" else F.lit(None).cast(kind))
        fields = {"dates": lambda i, n: F.col(f"d{i}"), "clocks": lambda i, n: F.col(f"t{i}"), "months": lambda i, n: F.col(f"y{i}"),
                  "numbers": mixed("n", "bigint"), "nlo": mixed("lo", "double"), "nhi": mixed("hi", "double"), "nfrac": mixed("f", "bigint")}
        base = base.join(F.broadcast(_long(rows.agg(*aggs), texts, fields).drop("position")), "column", "left")
    else:
        for c, t in (("dates", "bigint"), ("clocks", "bigint"), ("months", "bigint"), ("numbers", "bigint"), ("nlo", "double"), ("nhi", "double"), ("nfrac", "bigint")):
            base = base.withColumn(c, F.lit(None).cast(t))
    # Fixed facts about each column, one row per column.
    facts = rows.sparkSession.createDataFrame([(n, declared[n], (number_formats or {}).get(n)) for n in names], "column string, kind string, number_format string")
    p = base.drop("data_type").join(F.broadcast(facts), "column")
    name, present, unique = F.col("column"), F.col("count"), F.col("unique_count")
    # Underscores join words in machine names; \b treats them as letters, as the rules do.
    values = F.coalesce(F.when(F.col("min").isNotNull(), present), F.col("numbers"), F.lit(0))
    low, high = F.coalesce("min", "nlo"), F.coalesce("max", "nhi")
    whole = F.coalesce("fractional", "nfrac") == 0
    days = F.when(F.col("kind") == "date", present).otherwise(F.coalesce("dates", F.lit(0)))
    sequential = (values >= 5) & whole & (unique == values) & (high - low == values - 1)
    is_id = name.rlike(V.KEY_NAME) | F.coalesce(sequential, F.lit(False))
    is_text = F.col("kind").isin("text", "mixed")
    meaning = (F.when(F.col("number_format").contains("%"), "percent")
               .when(F.col("number_format").rlike(V.CURRENCY_FORMAT), F.when(name.rlike(V.PRICE_NAME) & ~name.rlike(V.TOTAL_NAME), "price").otherwise("money"))
               .when(name.rlike(V.PERCENT_NAME) & ~name.rlike(V.TOTAL_NAME), "percent")
               .when(name.rlike(V.SCORE_NAME), "score")
               .when(name.rlike(V.TOTAL_NAME) | (name.rlike(V.PRICE_NAME) & name.rlike(V.CURRENCY_NAME)), "money")
               .when(name.rlike(V.PRICE_NAME), "price")
               .when(name.rlike(V.QUANTITY_NAME) & (low >= 0), "quantity"))
    missing = F.col("rows") - present
    attribute = (unique <= 1) | name.rlike(V.NOTE_NAME) | name.rlike(V.UNIT_NAME) | (missing > F.col("rows") * .6)
    grouping = (unique <= V.CATEGORY_MAX_UNIQUE) & ((unique <= 20) | (unique <= present * .5))
    case = (F.when(present == 0, _role("empty", "attribute"))
            .when(F.col("kind") == "boolean", _role("boolean", "dimension"))
            .when(days / present >= .8, F.struct(F.when(F.coalesce("clock", "clocks", F.lit(0)) > 0, "datetime").otherwise("date").alias("s"), F.lit("time").alias("r"), F.lit("iso").alias("t")))
            .when((F.col("kind") == "text") & (F.col("months") == present), _role("date", "time", "year_month"))
            .when(values / present >= .8, F.struct(
                F.when(is_id, "identifier").when(whole, "integer").otherwise("decimal").alias("s"),
                F.when(is_id, "identifier").otherwise("measure").alias("r"), F.lit(None).cast("string").alias("t")))
            .when(is_text & ((name.rlike(V.ID_NAME) & (unique >= present * .9)) | ((unique == present) & (present > 200))), _role("identifier", "identifier"))
            .when(is_text & attribute, F.struct(F.when(unique <= V.CATEGORY_MAX_UNIQUE, "category").otherwise("text").alias("s"), F.lit("attribute").alias("r"), F.lit(None).cast("string").alias("t")))
            .when(is_text & grouping, _role("category", "dimension"))
            .when(is_text, _role("text", "attribute"))
            .otherwise(_role("mixed", "attribute")))
    return (p.withColumn("_x", case)
            .select("position", "column", F.col("kind").alias("data_type"), F.col("_x.s").alias("semantic_type"), F.col("_x.r").alias("role"),
                    F.when(F.col("_x.r") == "measure", meaning).alias("meaning"), F.col("_x.t").alias("time_format"),
                    "rows", missing.alias("missing_count"), "unique_count", "min", "max"))


def _role(semantic: str, role: str, time_format: str | None = None) -> Column:
    return F.struct(F.lit(semantic).alias("s"), F.lit(role).alias("r"), F.lit(time_format).cast("string").alias("t"))


def role_columns(roles: DataFrame) -> dict[str, ColumnInfo]:
    """Role rows (one per column) as driver-side facts, in column order."""
    return {r["column"]: ColumnInfo(r["column"], r["data_type"], r["role"], r["semantic_type"], r["meaning"], r["time_format"],
                                    r["unique_count"], r["missing_count"]) for r in roles.orderBy("position").collect()}


# ---------------------------------------------------------------- first-generation profile

def profile_strict(df: DataFrame) -> DataFrame:
    """Stricter profile over raw text cells: numeric at 85 %, dates at 90 %, dimension up to
    30 values; with invalid counts, three samples and a confidence."""
    rows = drop_summary_rows(df)
    names, kinds = data_columns(rows), _kinds(rows)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        text = tidy(n) if kinds[n] == "text" else c.cast("string")
        filled = c.isNotNull() & (text != "")
        number = c.cast("double") if kinds[n] == "number" else F.when(
            filled & text.rlike(V.STRICT_NUMBER) & ~text.rlike(r"^0\d+"), text.try_cast("double")) if kinds[n] == "text" else F.lit(None).cast("double")
        day = filled if kinds[n] == "date" else (F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}($|T)"), F.lit(False))
                                                & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()) if kinds[n] == "text" else F.lit(False)
        aggs += [F.count_if(filled).alias(f"n{i}"), F.count(number).alias(f"num{i}"), F.count_if(day).alias(f"day{i}"),
                 F.count_if(filled & text.rlike(V.STRICT_CODE)).alias(f"code{i}") if kinds[n] == "text" else F.lit(0).alias(f"code{i}")]
    shapes = _long(rows.agg(*aggs), names, {"rows": lambda i, n: F.col("rows"), "n": lambda i, n: F.col(f"n{i}"), "numbers": lambda i, n: F.col(f"num{i}"),
                                            "days": lambda i, n: F.col(f"day{i}"), "codes": lambda i, n: F.col(f"code{i}"), "kind": lambda i, n: F.lit(kinds[n])})
    cleaned = rows.select(*[(F.nullif(tidy(n), F.lit("")) if kinds[n] == "text" else F.col(f"`{n}`")).alias(n) for n in names])
    order = F.col(ROW) if ROW in rows.columns else F.lit(0)
    long = (rows.select(order.alias("r"), F.explode(F.array(*[F.struct(F.lit(n).alias("column"), (F.nullif(tidy(n), F.lit("")) if kinds[n] == "text" else F.col(f"`{n}`").cast("string")).alias("v"))
                                                              for n in names])).alias("x")).select("r", "x.*").filter("v is not null"))
    first3 = (long.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("r", "v"))).filter("k <= 3")
              .groupBy("column").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.substring("v", 1, 100).alias("v")))), lambda s: s["v"]), " | ").alias("samples")))
    p = (shapes.join(F.broadcast(distinct_counts(cleaned, names).drop("position")), "column").join(F.broadcast(first3), "column", "left"))
    n = F.col("n")
    numeric_column = (n > 0) & (F.col("numbers") / n >= .85)
    date_column = (n > 0) & (F.col("days") / n >= .9)
    id_column = F.col("column").rlike(V.STRICT_ID_NAME) | ((n > 0) & (F.col("codes") == n))
    group = F.col("unique_count") <= 30
    return p.select(
        "position", "column",
        F.when(date_column, "datetime").when(numeric_column, "numeric").when((n > 0) & (F.col("kind") == "boolean"), "boolean").otherwise("text").alias("type"),
        F.when(id_column, "identifier").when(date_column, "datetime").when(numeric_column, "numeric_measure").when(group, "category").otherwise("free_text").alias("semantic_type"),
        F.when(id_column, "identifier").when(date_column, "time_dimension").when(numeric_column, "measure").when(group, "dimension").otherwise("label").alias("role"),
        F.col("unique_count").alias("unique"), (F.col("rows") - n).alias("missing"),
        F.round(F.when(F.col("rows") > 0, (F.col("rows") - n) / F.col("rows") * 100).otherwise(0), 2).alias("null_pct"),
        F.when(numeric_column, F.col("numbers")).otherwise(n).alias("valid_count"),
        F.when(numeric_column, n - F.col("numbers")).otherwise(0).alias("invalid_count"), F.coalesce("samples", F.lit("")).alias("samples"),
        F.when((n > 0) & (numeric_column | date_column | id_column), .9).otherwise(.7).alias("confidence"), "rows")


def quality_issues(df: DataFrame, profile: DataFrame, excluded: int = 0, unresolved: int = 0, metadata_rows: int = 0) -> DataFrame:
    """``kind, severity, column, count`` from a strict profile and the table itself."""
    spark = df.sparkSession
    rows = drop_summary_rows(df)
    texts = [n for n, k in _kinds(rows).items() if k == "text"]
    none = F.lit(None).cast("string").alias("column")

    def head(kind, severity):
        return F.lit(kind).alias("kind"), F.lit(severity).alias("severity")
    per_table = [
        profile.agg(F.sum("missing").alias("count")).select(*head("missing", "warning"), none, "count"),
        duplicate_rows(rows).select(*head("duplicates", "warning"), none, F.col("duplicate_rows").alias("count")),
        rows.agg(sum((F.count_if(tidy(n).rlike(V.SLASH_DATE)) for n in texts), F.lit(0)).alias("count")).select(*head("dates", "warning"), none, "count"),
        spark.createDataFrame([("summary", "warning", None, unresolved), ("excluded", "info", None, excluded), ("metadata", "info", None, metadata_rows)],
                              "kind string, severity string, column string, count bigint")]
    per_column = [
        profile.filter("invalid_count > 0").select(*head("mixed", "warning"), "column", F.col("invalid_count").alias("count")),
        profile.filter("unique = 1").select(*head("constant", "info"), "column", F.lit(1).alias("count")),
        profile.filter("role = 'label'").select(*head("cardinality", "info"), "column", F.col("unique").alias("count"))]
    out = per_table[0]
    for part in per_table[1:]:
        out = out.unionByName(part)
    out = out.filter("count > 0")
    for part in per_column:
        out = out.unionByName(part)
    return out


def slash_dates(df: DataFrame, names: list[str]) -> DataFrame:
    """``column, count`` of texts such as 3/4/2024 whose day and month are unclear."""
    wide = df.agg(*[F.count_if(tidy(n).rlike(V.SLASH_DATE)).alias(f"s{i}") for i, n in enumerate(names)])
    return _long(wide, names, {"count": lambda i, n: F.col(f"s{i}")}).drop("position")


def coverage(sheets: DataFrame, tables: DataFrame) -> DataFrame:
    """Per sheet: tables, rows, and why there is none.  ``sheets``: sheet, filled_rows;
    ``tables``: sheet, rows_count."""
    found = tables.groupBy("sheet").agg(F.count(F.lit(1)).alias("tables_count"), F.sum("rows_count").alias("rows_count"))
    joined = sheets.join(found, "sheet", "left")
    none = F.col("tables_count").isNull()
    return joined.select("sheet", F.coalesce("tables_count", F.lit(0)).alias("tables_count"), F.coalesce("rows_count", F.lit(0)).alias("rows_count"),
                         F.when(none, "no_table").otherwise("ready").alias("status"),
                         F.when(~none, "").when(F.col("filled_rows") == 0, "empty sheet").otherwise("no table with at least two rows").alias("reason"))


def group_head_tail(df: DataFrame, column: str, by_month: bool = False, k: int = HEAD_TAIL) -> DataFrame:
    """Groups by size (or months in order): the first ten and last ten, with what was left out.

    ``label, count, first_row, last_row, groups_total, groups_omitted, omitted_rows``."""
    label = F.date_format(F.col(column).cast("timestamp_ntz"), "yyyy-MM") if by_month else F.col(column).cast("string")
    row = F.col(ROW) if ROW in df.columns else F.lit(None).cast("bigint")
    groups = (df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"), F.min(row).alias("first_row"), F.max(row).alias("last_row"))
              .filter("label is not null"))
    ahead = [F.col("label").asc()] if by_month else [F.col("count").desc(), F.col("label").asc()]
    back = [F.col("label").desc()] if by_month else [F.col("count").asc(), F.col("label").desc()]
    shown = groups.orderBy(*ahead).limit(k).unionByName(groups.orderBy(*back).limit(k)).distinct()
    whole = groups.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).alias("w")).scalar()
    seen = shown.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).alias("w")).scalar()
    return (shown.withColumn("_w", whole).withColumn("_s", seen)
            .select("label", "count", "first_row", "last_row", F.col("_w.n").alias("groups_total"), (F.col("_w.n") - F.col("_s.n")).alias("groups_omitted"),
                    (F.col("_w.rows") - F.col("_s.rows")).alias("omitted_rows")))


def example_rows(df: DataFrame, limit: int = 60) -> DataFrame:
    """At most 60 rows, each with the reasons it was picked: spread positions, numeric
    extremes, worst outliers, first and last row of every shown group."""
    from tabscope.functions.ordered import rows_at_ranks
    roles = {r["column"]: r["role"] for r in profile_strict(df).orderBy("position").select("column", "role").collect()}

    def spread(n: int) -> list[int]:
        return [0] if n == 1 else [round(k * (n - 1) / min(19, n - 1)) for k in range(min(20, n))]
    picks = [rows_at_ranks(df.select(ROW), ROW, spread, 20).select(ROW, F.col("_rank").alias("o"), F.lit("spread_across_rows").alias("reason"))]
    for j, (name, role) in enumerate(roles.items(), 1):
        start = F.lit(j * (1 << 40))
        if role == "measure":
            v = df.select(F.col(ROW), numeric(df, name).cast("double").alias("v")).filter("v is not null")
            reason = F.lit(f"numeric_extreme:{name}").alias("reason")
            ends = v.agg(F.min(F.struct("v", ROW)).alias("lo"), F.max(F.struct(F.col("v"), (-F.col(ROW)).alias("r"))).alias("hi"))
            picks.append(ends.select(F.explode(F.array(
                F.struct(F.col(f"lo.{ROW}").alias(ROW), start.alias("o")), F.struct((-F.col("hi.r")).alias(ROW), (start + 1).alias("o")))).alias("x"))
                .select(f"x.{ROW}", "x.o", reason).filter(f"{ROW} is not null"))
            q = exact_quantiles(v, ["v"], [.25, .75]).first()
            if q["n"] and q["q1"] > q["q0"]:
                spread_iqr = q["q1"] - q["q0"]
                low, high = q["q0"] - 1.5 * spread_iqr, q["q1"] + 1.5 * spread_iqr
                far = F.greatest(F.lit(low) - F.col("v"), F.col("v") - F.lit(high))
                worst = v.filter((F.col("v") < low) | (F.col("v") > high)).orderBy(far.desc(), ROW).limit(3)
                picks.append(worst.withColumn("k", F.row_number().over(Window.orderBy(far.desc(), ROW)))  # three rows
                             .select(ROW, (start + 1 + F.col("k")).alias("o"), reason))
        elif role in ("dimension", "time_dimension", "label"):
            groups = group_head_tail(df, name, by_month=role == "time_dimension")
            # At most twenty groups.
            if role == "time_dimension":
                place = F.row_number().over(Window.orderBy("label"))
            else:
                place = F.when(F.col("groups_total") > 20, F.row_number().over(Window.orderBy("label"))).otherwise(
                    F.row_number().over(Window.orderBy(F.col("count").desc(), "label")))
            picks.append(groups.withColumn("k", place).select(F.explode(F.array(
                F.struct(F.col("first_row").alias(ROW), (start + F.col("k") * 2).alias("o")),
                F.struct(F.col("last_row").alias(ROW), (start + F.col("k") * 2 + 1).alias("o")))).alias("x"))
                .select(f"x.{ROW}", "x.o", F.lit(f"group_or_period:{name}").alias("reason")))
    every = picks[0]
    for part in picks[1:]:
        every = every.unionByName(part)
    chosen = (every.groupBy(ROW).agg(F.min("o").alias("o"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "reason"))), lambda s: s["reason"]), ", ").alias("reasons"))
              .orderBy("o").limit(limit))
    return df.join(F.broadcast(chosen.drop("o")), ROW)  # at most 60 rows


def check_limits(df: DataFrame, max_rows: int, max_columns: int = 200, max_cells: int | None = None) -> DataFrame:
    """Counts of a table; raises when it is over a limit.  Nothing is ever sampled or cut."""
    columns = len(data_columns(df))
    rows = df.count()
    over = [f"{what} {have} over {limit}" for what, have, limit in (
        ("rows", rows, max_rows), ("columns", columns, max_columns), ("cells", rows * columns, max_cells)) if limit is not None and have > limit]
    if over:
        raise ValueError("; ".join(over))
    return df.sparkSession.createDataFrame([(rows, columns, rows * columns)], "rows bigint, columns bigint, cells bigint")
