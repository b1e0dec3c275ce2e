"""Checking that figures quoted in text appear in the evidence the text cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions import vocabulary as V
from tabscope.functions.values import as_column, number_text, tidy

# Limits of statements, reports and outlines.
MAX_CITATIONS, MAX_STATEMENT = 6, 1800
MAX_SECTIONS, MAX_PARAGRAPHS, SECTION_EVIDENCE, MAX_PARAGRAPH, MIN_SECTIONS = 8, 6, 12, 2000, 2
MAX_EVIDENCE_ROWS, STATEMENT_LENGTH = 120, 450
OUTLINE_SECTIONS, DISPLAY_ITEMS = 12, 3
TOPICS = ("quality", "statistics", "frequency", "category", "trend", "distribution", "outliers", "correlation", "other")
SALTS = 32


def without_citations(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(as_column(c), V.CITATION, " "), "−", "-")


def figure_tokens(c: Column | str, signed: bool = True) -> Column:
    """Figures in a text, as written less thousands commas.  A hyphen between digits is a
    range, not a sign; evidence ids hold no figures."""
    text = without_citations(c)
    if signed:
        text = F.regexp_replace(text, r"(?<=\d)[-–](?=\d)", " ")
    return F.transform(F.regexp_extract_all(text, F.lit("(" + V.FIGURE + ")"), F.lit(1)), lambda t: F.regexp_replace(t, ",", ""))


def strip_citations(c: Column | str) -> Column:
    """Evidence ids are for checking, not for readers."""
    text = F.regexp_replace(as_column(c), V.CITATION_GROUP, "")
    text = F.regexp_replace(text, V.CITATION_LOOSE, "")
    return tidy(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\s+([.,;:])", "$1"))


def extract_figures(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys, position, token, value``, one row per figure."""
    return (df.select(*keys, F.posexplode(figure_tokens(text)).alias("position", "token"))
            .withColumn("value", F.col("token").try_cast("double")))


def _decimals(token: Column, exponents: bool = True) -> Column:
    mantissa = F.regexp_extract(token, r"\.(\d+)", 1)
    places = F.length(mantissa)
    if exponents:
        places = places - F.coalesce(F.nullif(F.regexp_extract(token, r"[eE]([+-]?\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.greatest(F.lit(-308), F.least(F.lit(308), places))


def _rounded(actual: Column, places: Column) -> Column:
    factor = F.pow(F.lit(10.0), places)
    return F.round(F.abs(actual) * factor) / factor


def check_grounding(statements: DataFrame, evidence: DataFrame, mode: str = "signed") -> DataFrame:
    """Statements with ``grounded``: every figure equals a cited figure, exactly or rounded
    half away from zero to the precision used, with the same sign (``mode='unsigned'``
    lets the sign be dropped).  Digits outside 0–9 cannot be checked and fail.

    ``statements``: statement_id, text, evidence_ids; ``evidence``: evidence_id, text.
    Each evidence text is read once into an array; hot ids are spread over salts."""
    signed = mode == "signed"
    facts = evidence.select("evidence_id", F.filter(F.transform(figure_tokens("text", signed), lambda t: t.try_cast("double")), lambda v: v.isNotNull()).alias("_figures"))
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cited = (statements.select("statement_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
             .withColumn("_salt", F.pmod(F.hash("statement_id"), F.lit(SALTS))).join(salted, ["evidence_id", "_salt"])
             .groupBy("statement_id").agg(F.flatten(F.collect_list("_figures")).alias("_known")))  # a statement's own citations
    claim = statements.withColumn("_claims", F.transform(F.array_distinct(figure_tokens("text", signed)), lambda t: F.struct(
        t.try_cast("double").alias("v"), _decimals(t, signed).alias("p"))))
    foreign = F.regexp_replace(without_citations("text"), "[0-9]", "").rlike(r"\p{N}")

    def supported(c, known):
        if signed:
            return F.exists(known, lambda a: (a == c["v"]) | ((F.signum(a) == F.signum(c["v"])) & (F.signum(a) * _rounded(a, c["p"]) == c["v"])))
        return F.exists(known, lambda a: _rounded(a, c["p"]) == F.abs(c["v"]))
    joined = claim.join(cited, "statement_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<double>")))
    ok = F.forall("_claims", lambda c: F.coalesce(supported(c, F.col("_known")), F.lit(False)))
    return joined.withColumn("grounded", ok & ~foreign).drop("_claims", "_known")


def _known_ids(df: DataFrame, key: list[str], evidence: DataFrame) -> DataFrame:
    ids = df.select(*key, F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    return ids.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi").groupBy(*key).agg(F.sort_array(F.collect_set("evidence_id")).alias("_found"))


def filter_statements(statements: DataFrame, evidence: DataFrame, max_length: int = MAX_STATEMENT) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): grounded statements with 1–6 known ids and a sensible length."""
    checked = check_grounding(statements, evidence).join(_known_ids(statements, ["statement_id"], evidence), "statement_id", "left")
    cited = F.size("evidence_ids")
    known = F.coalesce(F.size(F.array_distinct("evidence_ids")) == F.size("_found"), F.lit(False))
    fits = (F.length(tidy("text")) >= 1) & (F.length("text") <= max_length)
    judged = checked.withColumn("_keep", (cited >= 1) & (cited <= MAX_CITATIONS) & known & fits & F.col("grounded"))
    kept = judged.filter("_keep").select("statement_id", strip_citations("text").alias("text"), F.array_distinct("evidence_ids").alias("evidence_ids"))
    return kept, judged.agg(F.count_if("_keep").alias("kept"), F.count_if(~F.col("_keep")).alias("dropped"))


def filter_paragraphs(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Report paragraphs kept one by one against their section's known evidence.

    ``sections``: report_id, section, title, paragraphs, evidence_ids.  Reports with fewer
    than two usable sections are marked ``usable = false``."""
    key = ["report_id", "section"]
    first = sections.filter((F.col("section") < MAX_SECTIONS) & F.length(tidy("title")).between(1, 120))
    found = first.join(_known_ids(first, key, evidence), key, "left").withColumn("evidence_ids", F.slice(F.coalesce("_found", F.array().cast("array<string>")), 1, SECTION_EVIDENCE)).drop("_found")
    lines = found.select(*key, F.posexplode(F.slice("paragraphs", 1, MAX_PARAGRAPHS)).alias("n", "text"), "evidence_ids").withColumn("statement_id", F.concat_ws(":", *key, "n"))
    good = check_grounding(lines.filter(F.length(tidy("text")).between(1, MAX_PARAGRAPH) & (F.length("text") <= MAX_PARAGRAPH)), evidence).filter("grounded")
    shown = good.withColumn("text", strip_citations("text")).filter("text <> ''").groupBy(*key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]).alias("paragraphs"))  # at most six
    counts = shown.groupBy("report_id").agg(F.count(F.lit(1)).alias("_n"))
    return (found.drop("paragraphs").join(shown, key).join(counts, "report_id")
            .select(*key, tidy("title").alias("title"), "paragraphs", "evidence_ids", (F.col("_n") >= MIN_SECTIONS).alias("usable")))


def evidence_rows(tiles: DataFrame, prefix: str = "BOQ") -> DataFrame:
    """Numbered evidence from computed tile points, at most 120: ``id, title, statement``.

    ``tiles``: tile (order), title, label, series, value."""
    statement = F.concat(F.col("title"), F.lit(" — "), F.col("label"), F.lit(" / "), F.col("series"), F.lit(": "), number_text("value"))
    top = tiles.filter("value is not null").withColumn("statement", F.substring(statement, 1, STATEMENT_LENGTH)).orderBy("tile", "label", "series").limit(MAX_EVIDENCE_ROWS)
    number = F.row_number().over(Window.orderBy("tile", "label", "series"))  # at most 120 rows
    return top.select(F.format_string(f"{prefix}-%03d", number).alias("id"), F.substring("title", 1, 160).alias("title"), "statement")


def merge_sections(sections: DataFrame, types: DataFrame) -> DataFrame:
    """Outlines without repeats, one row per cited analysis:
    ``report_id, seq, title, question, analysis_id``.

    Sections citing the same evidence set collapse to the first; a report above 12 is
    regrouped by kind of analysis under the title of the first section that holds it.
    ``types``: report_id, evidence_id, type.  Ids stay rows, so no report is gathered."""
    keyed = sections.withColumn("analysis_ids", F.array_distinct("analysis_ids")).filter(F.size("analysis_ids") > 0)
    keyed = keyed.withColumn("_key", F.array_join(F.array_sort("analysis_ids"), "\u0001"))
    firsts = keyed.groupBy("report_id", "_key").agg(F.min_by(F.struct("seq", "title", "question", "analysis_ids"), "seq").alias("s")).select("report_id", "s.*")
    counted = firsts.groupBy("report_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = _spread(firsts, counted, ["report_id"], "seq").select("*", F.explode("analysis_ids").alias("analysis_id"))
    small = sized.filter(F.col("_n") <= OUTLINE_SECTIONS).select("report_id", "seq", "title", "question", "analysis_id")
    kind = F.when(F.col("type").isin(*TOPICS), F.col("type")).otherwise("other")
    typed = sized.filter(F.col("_n") > OUTLINE_SECTIONS).join(types.withColumnRenamed("evidence_id", "analysis_id"), ["report_id", "analysis_id"], "left").withColumn("type", kind)
    topic = F.array_position(F.array(*[F.lit(t) for t in TOPICS]), F.col("type")).cast("bigint")
    heads = typed.groupBy("report_id", "type").agg(F.min_by(F.struct("title", "question"), "seq").alias("h")).withColumn("_topic", topic)
    # At most nine topics per report; topics under one title and question become one section.
    same = Window.partitionBy("report_id", F.lower(tidy("h.title")), F.lower(tidy("h.question")))
    heads = heads.select("report_id", "type", F.min("_topic").over(same).alias("seq"), F.min_by("h", "_topic").over(same).alias("h"))
    large = _spread(typed.select("report_id", "type", "analysis_id").distinct(), heads, ["report_id", "type"], "analysis_id")
    return small.unionByName(large.select("report_id", "seq", F.col("h.title").alias("title"), F.col("h.question").alias("question"), "analysis_id").distinct())


def _spread(rows: DataFrame, facts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Join facts to rows with hot keys split over salts."""
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash(by), F.lit(SALTS))).join(salted, [*keys, "_salt"]).drop("_salt")


def pick_display(items: DataFrame, keys: list[str], limit: int = DISPLAY_ITEMS) -> DataFrame:
    """Up to three items per section, different tables first: ``keys, seq, evidence_id, table_id, pick``."""
    nth = F.row_number().over(Window.partitionBy(*keys, "table_id").orderBy("seq"))
    # Ranks up to the limit are pruned in every task before the shuffle.
    some = items.withColumn("_nth", nth).filter(F.col("_nth") <= limit)
    pick = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("_nth") > 1).cast("int"), "seq"))
    return some.withColumn("pick", pick).filter(F.col("pick") <= limit).drop("_nth")
