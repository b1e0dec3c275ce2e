"""Bids side by side and single cost estimates, on long tables.

Lines: ``line, category, item, party, party_order, total[, material, labour]`` — one row
per line and party, ``total`` null when the party left the line out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.columns import ROW
from tabscope.functions import vocabulary as V
from tabscope.functions.ordered import running, running_sorted
from tabscope.functions.values import is_blank, one_line, tidy

# Sizes of the reports and thresholds.
SPREAD_LINES, TOP_LINES, PARETO_SHARE = 15, 15, .8
STATED_TOLERANCE_PCT = .5
MIN_PRICED_LINES = 3
LABEL_LENGTH, ITEM_LENGTH, PARTY_LENGTH = 60, 120, 80


# ---------------------------------------------------------------- columns

def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _axis(c: Column) -> Column:
    return F.when(_matches(c, V.BID_LABOUR), "labour").when(_matches(c, V.BID_MATERIAL), "material")


def clean_party(c: Column) -> Column:
    """Repeated neighbouring words collapse; the name stays whole, so bidders are never merged by a prefix."""
    words = F.split(one_line(c), " ")
    kept = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), w)), lambda w: w.isNotNull())
    return F.array_join(kept, " ")


def read_roles(columns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Role of every column: item, quantity, unit, category, or priced with
    ``party, is_benchmark, measure (unit|amount), axis``.

    ``columns``: keys, position, name, data_type.  Windows run over the columns of one
    table, never over its rows."""
    keys = keys or ["table"]
    parts = F.split("name", " / ")
    c = (columns.withColumn("metric", F.regexp_replace(tidy(F.get(parts, F.size(parts) - 1)), r"\s*\(\d+\)$", ""))
         .withColumn("prefix", F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: tidy(p)), " / ")))
    plain = F.col("prefix") == ""
    textual = plain & F.col("data_type").isin("text", "mixed")
    table = Window.partitionBy(*keys)

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("position"))).over(table)
    c = c.withColumn("_cat", first(textual & _matches(F.col("name"), V.BID_CATEGORY)))
    c = c.withColumn("_unit", first(textual & ~F.col("position").eqNullSafe(F.col("_cat")) & _matches(F.col("name"), V.BID_UNIT)))
    free2 = ~F.col("position").eqNullSafe(F.col("_cat")) & ~F.col("position").eqNullSafe(F.col("_unit"))
    c = c.withColumn("_item", first(textual & free2 & _matches(F.col("name"), V.BID_ITEM)))
    c = c.withColumn("_weak", first(textual & free2 & ~F.col("position").eqNullSafe(F.col("_item")) & _matches(F.col("name"), V.BID_ITEM_WEAK)))
    taken = ~free2 | F.col("position").eqNullSafe(F.col("_item"))
    number = F.col("data_type").isin("number", "mixed") & ~taken
    c = c.withColumn("_qty", first(number & plain & _matches(F.col("name"), V.BID_QUANTITY) & ~_matches(F.col("name"), V.BID_PRICE_WORD)))
    m = F.col("metric")
    measure = F.when(number & ~F.col("position").eqNullSafe(F.col("_qty")),
                     F.when(_matches(m, V.BID_UNIT_PRICE), "unit").when(_matches(m, V.BID_AMOUNT), "amount")
                     .when(_matches(m, V.BID_PRICE_WORD) | _matches(m, V.BID_MATERIAL) | _matches(m, V.BID_LABOUR),
                           F.when(_matches(m, V.BID_UNIT_WORD), "unit").otherwise("amount")))
    benchmark = ~plain & _matches(F.col("prefix"), V.BID_BENCHMARK)
    prefix_axis = F.when(~plain & ~benchmark, _axis(F.col("prefix")))
    other = _matches(F.col("prefix"), V.BID_PRICE_WORD) | _matches(F.col("prefix"), V.BID_AMOUNT) | _matches(F.col("prefix"), V.BID_QUANTITY)
    party = F.when(benchmark | (~plain & prefix_axis.isNull() & ~other), clean_party(F.col("prefix")))
    c = (c.withColumn("measure", measure).withColumn("is_benchmark", F.col("measure").isNotNull() & benchmark)
         .withColumn("party", F.when(F.col("measure").isNotNull(), party)).withColumn("axis", F.when(F.col("measure").isNotNull(), F.coalesce(_axis(m), prefix_axis))))
    # An amount without an axis follows the unit price right before it; a line total never does.
    before = F.last(F.when(F.col("measure").isNotNull(), F.struct("measure", "axis", "party", "is_benchmark")), ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_p", before)
    inherits = ((F.col("measure") == "amount") & F.col("axis").isNull() & (F.col("_p.measure") == "unit") & F.col("_p.axis").isNotNull()
                & F.col("_p.party").eqNullSafe(F.col("party")) & F.col("_p.is_benchmark").eqNullSafe(F.col("is_benchmark")) & ~_matches(m, V.BID_LINE_TOTAL))
    p = F.col("position")
    role = (F.when(p.eqNullSafe(F.col("_cat")), "category").when(p.eqNullSafe(F.col("_unit")), "unit").when(p.eqNullSafe(F.coalesce("_item", "_weak")), "item")
            .when(p.eqNullSafe(F.col("_qty")), "quantity").when(F.col("measure").isNotNull(), "priced"))
    return c.select(*keys, "position", "name", role.alias("role"), "party", "is_benchmark", "measure",
                    F.when(F.coalesce(inherits, F.lit(False)), F.col("_p.axis")).otherwise(F.col("axis")).alias("axis"))


# ---------------------------------------------------------------- lines

def line_total(cells: DataFrame, keys: list[str], quantity: str = "quantity") -> DataFrame:
    """``keys, total, material, labour`` from priced cells (``measure, axis, position, value``).

    The stated total wins, else material and labour amounts, else unit prices × quantity."""
    def amount(axis):
        return F.sum(F.when((F.col("measure") == "amount") & (F.col("axis") == axis), F.col("value")))

    def rate(condition):
        pick = (F.col("measure") == "unit") & condition & F.col("value").isNotNull()
        return F.min_by("value", F.when(pick, F.col("position")))
    stated = (F.col("measure") == "amount") & F.col("axis").isNull() & F.col("value").isNotNull()
    g = cells.groupBy(*keys).agg(
        F.max(quantity).alias("_q"), amount("material").alias("_m"), amount("labour").alias("_l"), rate(F.col("axis") == "material").alias("_rm"),
        rate(F.col("axis") == "labour").alias("_rl"), rate(F.col("axis").isNull()).alias("_r"), F.min_by("value", F.when(stated, F.col("position"))).alias("_t"))
    none = F.col("_m").isNull() & F.col("_l").isNull()
    material = F.when(none, F.col("_rm") * F.col("_q")).otherwise(F.col("_m"))
    labour = F.when(none, F.col("_rl") * F.col("_q")).otherwise(F.col("_l"))
    both = F.when(material.isNotNull() | labour.isNotNull(), F.coalesce(material, F.lit(0.0)) + F.coalesce(labour, F.lit(0.0)))
    return g.select(*keys, F.coalesce("_t", both, F.col("_r") * F.col("_q")).alias("total"), material.alias("material"), labour.alias("labour"))


def section_category(rows: DataFrame, group: list[str], order: str = ROW) -> DataFrame:
    """Line items with ``category``: a label without quantity or price is a heading that
    names the rows below; an explicit category wins.  ``rows``: label, quantity, priced,
    category_text and optionally _is_summary (left out)."""
    kept = rows.filter(~F.col("_is_summary")) if "_is_summary" in rows.columns else rows
    explicit = F.when(~is_blank("category_text"), tidy("category_text"))
    has_label = ~is_blank("label")
    heading = explicit.isNull() & has_label & ~F.col("priced") & F.col("quantity").isNull()
    marked = kept.withColumn("_heading", heading)
    filled = running(marked, group, order, fills={"category": F.coalesce(explicit, F.when(heading, tidy("label")))})
    return (filled.filter(~F.col("_heading") & (has_label | F.col("priced"))).drop("_heading")
            .withColumn("category", F.coalesce("category", F.lit(V.NO_CATEGORY))))


def drop_empty_parties(lines: DataFrame) -> DataFrame:
    """Leaves out template slots: parties without any figure, or named only by filler."""
    filled = lines.groupBy("party").agg(F.count("total").alias("_n")).filter(
        (F.col("_n") > 0) & (F.regexp_replace("party", V.PARTY_PLACEHOLDER, "") != "")).select("party")
    return lines.join(filled, "party", "left_semi")


def party_totals(lines: DataFrame) -> DataFrame:
    """``party, party_order, total, material, labour, priced``; absent parts stay null."""
    return (lines.groupBy("party").agg(F.min("party_order").alias("party_order"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.sum("material").alias("material"),
                                       F.sum("labour").alias("labour"), F.count("total").alias("priced")).filter("priced > 0"))


def _bidders(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("total").isNotNull())


def common_lines(lines: DataFrame) -> DataFrame:
    """One row per line every bidder priced, with its low and high bidder (first bidder on ties)."""
    priced = _bidders(lines)
    bidders = priced.agg(F.count_distinct("party").alias("n")).scalar()
    low = F.struct("total", "party_order")
    high = F.struct(F.col("total"), (-F.col("party_order")).alias("o"))
    return (priced.groupBy("line").agg(F.count_distinct("party").alias("_n"), F.min("category").alias("category"), F.min_by("party", low).alias("low_party"), F.min("total").alias("low"),
                                       F.max_by("party", high).alias("high_party"), F.max("total").alias("high"))
            .withColumn("_b", bidders).filter(F.col("_n") == F.col("_b")).drop("_n", "_b"))


def common_totals(lines: DataFrame) -> DataFrame:
    """``party, common_total, common_lines``: totals over the lines every bidder priced."""
    shared = common_lines(lines).select("line")
    return _bidders(lines).join(shared, "line").groupBy("party").agg(F.sum("total").alias("common_total"), F.count(F.lit(1)).alias("common_lines"))


def rank_bids(lines: DataFrame, benchmark_total: Column | float | None = None) -> DataFrame:
    """Bidders by total: difference to the lowest, against the benchmark, lines priced,
    lines missing that another bidder priced, and the like-for-like total."""
    totals = party_totals(lines)
    whole = totals.agg(F.struct(F.min("total").alias("low"), F.count(F.lit(1)).alias("n")).alias("w")).scalar()
    offered = _bidders(lines).agg(F.count_distinct("line").alias("n")).scalar()
    reference = benchmark_total if isinstance(benchmark_total, Column) else F.lit(benchmark_total).cast("double")
    rank = F.row_number().over(Window.orderBy("total", "party_order"))  # one row per bidder
    ranked = totals.withColumn("rank", rank).withColumn("_low", whole["low"]).withColumn("_any", offered).withColumn("_ref", reference)
    return (ranked.join(common_totals(lines), "party", "left")
            .select("rank", "party", "total", "material", "labour", (F.col("total") - F.col("_low")).alias("diff"),
                    F.when(F.col("_low") != 0, (F.col("total") - F.col("_low")) / F.col("_low") * 100).alias("diff_pct"),
                    F.when(F.col("_ref") != 0, (F.col("total") - F.col("_ref")) / F.col("_ref") * 100).alias("vs_benchmark_pct"),
                    "priced", (F.col("_any") - F.col("priced")).alias("missing"), "common_total"))


def price_spread(lines: DataFrame, limit: int | None = SPREAD_LINES) -> DataFrame:
    """Common lines whose prices differ, widest first."""
    out = (common_lines(lines).filter((F.col("low") > 0) & (F.col("high") > F.col("low")))
           .withColumn("spread_pct", (F.col("high") - F.col("low")) / F.col("low") * 100))
    return out.orderBy((F.col("high") - F.col("low")).desc(), "line").limit(limit) if limit else out


def wins(lines: DataFrame) -> DataFrame:
    """``party, wins``: common lines on which the bidder is lowest."""
    return common_lines(lines).groupBy(F.col("low_party").alias("party")).agg(F.count(F.lit(1)).alias("wins"))


def best_of(lines: DataFrame) -> DataFrame:
    """``best_of, low_on_common, negotiable``: cheapest price of every common line against
    the lowest bidder there."""
    lowest = party_totals(lines).agg(F.min_by("party", F.struct("total", "party_order")).alias("p")).scalar()
    low = common_totals(lines).withColumn("_p", lowest).filter(F.col("party") == F.col("_p")).agg(F.max("common_total").alias("x")).scalar()
    return (common_lines(lines).agg(F.sum("low").alias("best_of")).withColumn("low_on_common", low)
            .withColumn("negotiable", F.col("low_on_common") - F.col("best_of")))


def category_matrix(lines: DataFrame, parties: list[str]) -> DataFrame:
    """Category × party totals, largest category first.  ``parties`` are the bid columns."""
    wide = _bidders(lines).groupBy("category").pivot("party", parties).agg(F.sum("total"))
    largest = F.greatest(*[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)) for p in parties]) if len(parties) > 1 else F.coalesce(F.col(f"`{parties[0]}`"), F.lit(0.0))
    return wide.orderBy(largest.desc(), "category")


def stated_total(summary_rows: DataFrame, computed: DataFrame) -> DataFrame:
    """``party, stated, total, differs``: the file's last grand total that is not VAT.

    ``summary_rows``: _row, label, party, value; ``computed``: party, total."""
    grand = _matches(F.col("label"), V.GRAND_TOTAL) & ~_matches(F.col("label"), V.VAT_LABEL) & F.col("value").isNotNull()
    stated = summary_rows.groupBy("party").agg(F.max_by("value", F.when(grand, F.col(ROW))).alias("stated"))
    far = F.abs(F.col("stated") - F.col("total")) > F.abs("total") * STATED_TOLERANCE_PCT / 100
    return computed.join(stated, "party", "left").select("party", "stated", "total", F.coalesce(far, F.lit(False)).alias("differs"))


def classify_table(roles: DataFrame, lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, kind, priced_lines, preferred``: comparison, estimate or general.

    ``roles`` from ``read_roles``; ``lines``: keys, line, party (null in a one-price file),
    is_benchmark, total."""
    keys = keys or ["table"]
    has = lambda role: F.max((F.col("role") == role).cast("int"))
    shape = roles.groupBy(*keys).agg(has("item").alias("item"), has("quantity").alias("quantity"), has("unit").alias("unit"),
                                     F.max(((F.col("measure") == "unit") & F.col("party").isNull()).cast("int")).alias("rate"))
    filled = F.col("total").isNotNull()
    named = filled & F.col("party").isNotNull() & (F.regexp_replace(F.coalesce("party", F.lit("")), V.PARTY_PLACEHOLDER, "") != "")
    use = lines.groupBy(*keys).agg(F.count_distinct(F.when(named & ~F.col("is_benchmark"), F.col("party"))).alias("bidders"), F.max((filled & F.col("is_benchmark")).cast("int")).alias("bench"),
                                   F.max((filled & F.col("party").isNull()).cast("int")).alias("single"), F.count_distinct(F.when(filled, F.col("line"))).alias("priced_lines"))
    base = shape.join(use, keys, "left")
    enough = (F.coalesce("item", F.lit(0)) == 1) & (F.col("priced_lines") >= MIN_PRICED_LINES)
    comparison = enough & (F.col("bidders") >= 1) & (F.col("bidders") + F.col("bench") >= 2)
    estimate = enough & (F.col("single") == 1) & (F.col("quantity") == 1) & ((F.col("unit") == 1) | (F.coalesce("rate", F.lit(0)) == 1))
    kind = F.when(comparison, "comparison").when(estimate, "estimate").otherwise("general")
    ranked = base.select(*keys, kind.alias("kind"), F.coalesce("priced_lines", F.lit(0)).alias("priced_lines"))
    best = ranked.filter("kind <> 'general'").agg(F.max_by(F.struct(*keys), F.struct((F.col("kind") == "comparison").alias("a"), "priced_lines", *keys)).alias("k")).scalar()
    return ranked.withColumn("_k", best).withColumn("preferred", F.struct(*keys).eqNullSafe(F.col("_k"))).drop("_k")


# ---------------------------------------------------------------- estimates

def estimate_totals(lines: DataFrame) -> DataFrame:
    """One row: total, material, labour, their shares, priced and unpriced lines."""
    total = F.coalesce(F.sum("total"), F.lit(0.0))
    share = lambda part: F.when(total != 0, F.sum(part) / total * 100)
    return lines.agg(total.alias("total"), F.sum("material").alias("material"), F.sum("labour").alias("labour"), share("material").alias("material_share"),
                     share("labour").alias("labour_share"), F.count("total").alias("priced"), F.count_if(F.col("total").isNull()).alias("unpriced"))


def category_share(lines: DataFrame) -> DataFrame:
    groups = _bidders(lines).groupBy("category").agg(F.sum("total").alias("value"), F.count(F.lit(1)).alias("items"))
    whole = groups.agg(F.sum("value").alias("t")).scalar()
    return (groups.withColumn("_t", whole).select("category", "value", "items", F.when(F.col("_t") != 0, F.col("value") / F.col("_t") * 100).alias("share"))
            .orderBy(F.col("value").desc(), "category"))


def pareto_count(lines: DataFrame, share: float = PARETO_SHARE) -> DataFrame:
    """``lines_needed, priced, total``: how many of the largest lines reach ``share`` of the value.

    Equal values are counted together first, so a value shared by many lines is one row."""
    groups = _bidders(lines).groupBy("total").agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.col("total") * F.col("n"))
    whole = groups.agg(F.struct(F.coalesce(F.sum("s"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).alias("w")).first()["w"]
    goal = whole["total"] * share
    ranked = running_sorted(groups, [F.col("total").desc()], "s", "_upto").withColumn("_before", F.col("_upto") - F.col("s"))
    some = F.when(F.col("total") > 0, F.least(F.col("n"), F.ceil((F.lit(goal) - F.col("_before")) / F.col("total")))).otherwise(F.col("n"))
    needed = F.sum(F.when(F.col("_before") < goal, some).otherwise(0)) if whole["total"] else F.lit(0)
    return ranked.agg(F.coalesce(needed, F.lit(0)).cast("bigint").alias("lines_needed")).select(
        "lines_needed", F.lit(whole["n"]).alias("priced"), F.lit(whole["total"]).alias("total"))


def top_lines(lines: DataFrame, limit: int = TOP_LINES) -> DataFrame:
    """Largest lines with their share and the cumulative share."""
    priced = _bidders(lines)
    whole = priced.agg(F.sum("total").alias("t")).scalar()
    top = priced.orderBy(F.col("total").desc(), "line").limit(limit).withColumn("_t", whole)
    running_share = Window.orderBy(F.col("total").desc(), "line").rowsBetween(Window.unboundedPreceding, 0)  # `limit` rows
    return top.select("line", "category", F.col("total").alias("value"), F.when(F.col("_t") != 0, F.col("total") / F.col("_t") * 100).alias("share"),
                      F.when(F.col("_t") != 0, F.sum("total").over(running_share) / F.col("_t") * 100).alias("cumulative_share"))
