"""Priced items against a reference price.

Axes are quantity, material and labour; roles are benchmark, proposal and normalized.
A record is one (row, vendor) with columns ``<axis>_<role>`` and ``total_<role>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions import vocabulary as V
from tabscope.functions.ordered import running
from tabscope.functions.values import any_word, is_blank, literal_pattern, one_line, tidy
from tabscope.operators.grid import SHEET, drop_blank_rows, filled_cells, head_rows, join_by_sheet
from tabscope.session import durable

AXES = ("quantity", "material", "labour")
RATES = ("material", "labour")
ROLES = ("benchmark", "proposal", "normalized")
FIELDS = tuple(f"{a}_{r}" for a in AXES for r in ROLES) + tuple(f"total_{r}" for r in ROLES)
HEADER_SCAN = 12
LABEL_CELLS = 400


# ---------------------------------------------------------------- headers

def axis_of(header: Column) -> Column:
    out = F.lit(None).cast("string")
    for axis in reversed(AXES):
        out = F.when(any_word(header, V.AXIS_WORDS[axis]), axis).otherwise(out)
    return out


def role_of(header: Column) -> Column:
    return F.when(any_word(header, V.NORMALIZED_WORDS), "normalized").when(any_word(header, V.BENCHMARK_WORDS), "benchmark").otherwise("proposal")


def party_label(header: Column, role: Column) -> Column:
    """The party a header names: the header less its axis and role words; never invented."""
    text = one_line(header)
    base = [w for words in V.AXIS_WORDS.values() for w in words] + list(V.PARTY_NOISE_WORDS)
    strip = lambda words: tidy(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)" + literal_pattern(words), " "), r"(?U)\s+", " "), r"^[ \-–—:]+|[ \-–—:]+$", ""))
    bench = F.regexp_extract(text, "(?i)(" + "|".join("\\Q" + w + "\\E" for w in V.BENCHMARK_WORDS) + ")", 1)
    return F.when(role == "benchmark", bench).when(role == "normalized", strip(base + list(V.NORMALIZED_WORDS))).otherwise(strip(base))


def map_headers(headers: DataFrame) -> DataFrame:
    """Adds ``axis, role, derived, line_total, category, item, label`` to rows with ``header``."""
    h = F.col("header")
    low = F.col("low") if "low" in headers.columns else F.lower(one_line(h))
    axis, role = axis_of(low), role_of(low)
    derived = any_word(low, V.DERIVED_WORDS)
    total = any_word(low, V.TOTAL_WORDS) & axis.isNull()
    return (headers.withColumn("axis", axis).withColumn("role", role).withColumn("derived", derived).withColumn("line_total", total)
            .withColumn("category", any_word(low, V.CATEGORY_WORDS) & axis.isNull() & ~total & ~derived)
            .withColumn("item", any_word(low, V.ITEM_WORDS) & axis.isNull() & ~total)
            .withColumn("label", F.when(F.col("axis").isNotNull(), party_label(h, F.col("role"))).otherwise("")))


def header_cells(grid: DataFrame) -> DataFrame:
    """Header cells of every comparison sheet: ``row_number, position, header`` of the row
    among the first 12 that resolves to the most axis and role pairs (at least two)."""
    # The plain text form is made once, before the many word tests.
    texts = F.transform("cells", lambda c: F.struct(c.alias("header"), F.lower(one_line(c)).alias("low")))
    cells = head_rows(grid, HEADER_SCAN).select(*SHEET, "row_number", F.posexplode(texts).alias("position", "x")).select(*SHEET, "row_number", "position", "x.*")
    mapped = map_headers(cells.filter(~is_blank("header")))
    pairs = mapped.filter(F.col("axis").isNotNull() & ~F.col("derived")).groupBy(*SHEET, "row_number").agg(F.count_distinct("axis", "role").alias("n"))
    best = pairs.groupBy(*SHEET).agg(F.max(F.struct("n", (-F.col("row_number")).alias("r"))).alias("b")).filter("b.n >= 2")
    # A row per header cell, read by every mapping step: written once.
    return durable(mapped.drop("low").join(best.select(*SHEET, (-F.col("b.r")).alias("row_number")), [*SHEET, "row_number"]))


def map_vendors(headers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, vendor, field, position``: columns of every vendor with at least two axes.

    Benchmark columns are shared; of several proposal columns for one axis the nearest to
    the left of its benchmark is taken.  All joins are over the columns of one sheet."""
    keys = keys or SHEET
    cols = headers.filter(F.col("axis").isNotNull() & ~F.col("derived")).select(*keys, "position", "axis", "role", "label")
    bench = cols.filter("role = 'benchmark'").groupBy(*keys, "axis").agg(F.min("position").alias("ref"))
    props = cols.filter("role = 'proposal'")
    named = props.filter("label <> ''").select(*keys, F.col("label").alias("vendor")).distinct()
    counted = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sheets = headers.select(*keys).distinct().join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    vendors = sheets.join(named, keys, "left").select(*keys, F.coalesce("vendor", F.lit("")).alias("vendor"), (F.greatest("n", F.lit(1)) == 1).alias("alone"))
    mine = (F.col("label") == F.col("vendor")) | ((F.col("label") == "") & F.col("alone"))
    # A sheet has few columns, so vendor × column stays small.
    owned = vendors.join(cols.filter("role <> 'benchmark'"), keys).filter(mine).join(bench, [*keys, "axis"])
    pick = owned.groupBy(*keys, "vendor", "axis", "ref").agg(
        F.coalesce(F.max(F.when((F.col("role") == "proposal") & (F.col("position") < F.col("ref")), F.col("position"))), F.min(F.when(F.col("role") == "proposal", F.col("position")))).alias("proposal"),
        F.min(F.when(F.col("role") == "normalized", F.col("position"))).alias("normalized")).filter("proposal is not null")
    wide = pick.withColumn("_axes", F.count(F.lit(1)).over(Window.partitionBy(*keys, "vendor"))).filter("_axes >= 2")
    fields = wide.select(*keys, "vendor", F.explode(F.array(*[F.struct(F.concat("axis", F.lit(f"_{r}")).alias("field"), F.col(c).alias("position"))
                                                               for r, c in (("benchmark", "ref"), ("proposal", "proposal"), ("normalized", "normalized"))])).alias("x")).select(*keys, "vendor", "x.*").filter("position is not null")
    kept = wide.select(*keys, "vendor").distinct()
    many = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    totals = headers.filter("line_total and not derived").select(*keys, "position", "role", F.lower(one_line("header")).alias("h"))
    holds = (F.col("vendor") != "") & F.contains(F.col("h"), F.lower("vendor"))
    claimed = totals.join(kept, keys).join(many, keys).withColumn("_own", holds)
    named_any = F.max(F.col("_own").cast("int")).over(Window.partitionBy(*keys, "position"))
    owners = claimed.withColumn("_any", named_any).filter(F.col("_own") | ((F.col("_any") == 0) & ((F.col("role") == "benchmark") | (F.col("_v") == 1))))
    total_fields = owners.groupBy(*keys, "vendor", F.concat(F.lit("total_"), "role").alias("field")).agg(F.min("position").alias("position"))
    return fields.unionByName(total_fields)


def number_of(c: Column) -> Column:
    return F.replace(tidy(c), F.lit(","), F.lit("")).try_cast("double")


def note_class(c: Column) -> Column:
    text = one_line(c)
    return F.when(any_word(text, V.OUT_OF_SCOPE_WORDS), "out_of_scope").when(any_word(text, V.NOT_QUOTED_WORDS), "not_quoted")


def group_key(sheet: Column, category: Column) -> Column:
    prefix = F.nullif(F.regexp_extract(tidy(sheet), r"^([A-Za-z]{2,})[_\s-]", 1), F.lit(""))
    return F.coalesce(F.upper(prefix), category, tidy(sheet))


def sheet_prefix(sheet: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(tidy(sheet), r"^([A-Za-z]{2,})[_\s-]", 1), F.lit("")))


def drop_aggregate_sheets(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, skipped sheets with a reason): sheets that restate others would count twice."""
    restates = any_word(one_line("sheet"), V.AGGREGATE_SHEET_WORDS)
    skipped = grid.filter(restates).select(*SHEET).distinct().withColumn("reason", F.lit("summary or analysis sheet"))
    return grid.filter(~restates), skipped


def to_long(grid: DataFrame, headers: DataFrame, vendors: DataFrame) -> DataFrame:
    """Records of every comparison sheet, one per (row, vendor), headings flagged ``parent``."""
    shape = headers.groupBy(*SHEET).agg(
        F.max("row_number").alias("_h"), F.min(F.when(F.col("category"), F.col("position"))).alias("_cat"), F.min(F.when(F.col("item"), F.col("position"))).alias("_item"),
        F.sort_array(F.collect_list(F.when(any_word(F.col("header"), V.NOTE_WORDS), F.col("position")))).alias("_notes"))
    maps = vendors.groupBy(*SHEET, "vendor").agg(F.map_from_entries(F.collect_list(F.struct("field", "position"))).alias("_map"))
    sides = shape.join(maps.groupBy(*SHEET).agg(F.collect_list(F.struct("vendor", "_map")).alias("_vendors")), SHEET)  # as many as the sheet has columns
    rows = join_by_sheet(drop_blank_rows(grid).select(*SHEET, "row_number", "cells"), sides, among=grid).filter(F.col("row_number") > F.col("_h"))
    # A small file is one task's scan, however many rows it holds: its rows are dealt out before the work on them.
    rows = rows.repartition(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SHEET, "row_number")
    cell = lambda pos: F.get("cells", F.col(pos))
    notes = F.filter(F.transform("_notes", lambda p: note_class(F.get(F.col("cells"), p))), lambda x: x.isNotNull())
    r = (rows.withColumn("category", F.when(~is_blank(cell("_cat")), tidy(cell("_cat")))).withColumn("item", F.coalesce(F.lower(one_line(cell("_item"))), F.lit("")))
         .withColumn("note", F.get(notes, F.lit(0))).withColumn("_x", F.explode("_vendors")))
    for f in FIELDS:
        r = r.withColumn(f, number_of(F.get("cells", F.try_element_at("_x._map", F.lit(f)))))
    has_value = F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in FIELDS], F.lit(False))
    headless = sheet_prefix(F.col("sheet")).isNull() & F.col("_cat").isNotNull() & F.col("category").isNull()
    return flag_parents(r.filter(has_value).withColumn("vendor", F.col("_x.vendor")).withColumn("group", group_key(F.col("sheet"), F.col("category"))).withColumn("_headless", headless)).select(
        *SHEET, F.col("row_number").alias("row"), "vendor", "group", "category", "item", "note", *FIELDS, "priced", "parent")


def flag_parents(records: DataFrame) -> DataFrame:
    """``priced`` and ``parent``: a heading has its own total without prices, or no category
    while the sheet has a category column (``_headless``).  A quoted zero is a price."""
    priced = F.col("material_proposal").isNotNull() | F.col("labour_proposal").isNotNull() | F.col("quantity_proposal").isNotNull()
    own = (F.coalesce("total_proposal", F.lit(0.0)) != 0) | (F.coalesce("total_normalized", F.lit(0.0)) != 0)
    headless = F.col("_headless") if "_headless" in records.columns else F.lit(False)
    return records.withColumn("priced", priced).withColumn("parent", headless | (own & ~priced))


# ---------------------------------------------------------------- one bill on several sheets

def match_vendor_sheets(lines: DataFrame) -> DataFrame:
    """Sheets that are one bill priced by different vendors: ``source, sheet, cluster, vendor, accepted``.

    ``lines``: source, sheet, row_number, item, quantity, material, labour (reference values).
    Sheets agree when at least 90 % of their positions do; a cluster counts only if it
    covers every sheet of its prefix.  Sheets with the same lines are merged first, and
    only sheets of one workbook are compared.
    """
    used = lines.filter("quantity is not null and quantity <> 0")
    placed = running(used, SHEET, "row_number", sums={"pos": F.lit(1)})
    # Named fields: a hash of the bare columns would skip nulls and mix up the two prices.
    signature = F.xxhash64(F.to_json(F.struct("item", "quantity", "material", "labour")))
    signed = placed.select(*SHEET, "pos", signature.alias("sig"))
    # Order-free digest of (position, signature): equal sheets get equal digests.
    digests = signed.groupBy(*SHEET).agg(F.sum(F.xxhash64("pos", "sig").cast("decimal(38,0)")).alias("d"), F.count(F.lit(1)).alias("n"))
    groups = digests.groupBy("source", "d", "n").agg(F.min("sheet").alias("rep"))
    member = durable(digests.join(groups, ["source", "d", "n"]).select(*SHEET, "rep", "n"))
    reps = member.filter("sheet = rep").select("source", F.col("rep").alias("sheet"), "n")
    lean = join_by_sheet(signed, reps, order="pos")
    a, b = lean.alias("a"), lean.alias("b")
    same = (a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.sig") == F.col("b.sig")) & (F.col("a.sheet") < F.col("b.sheet")))
            .groupBy(F.col("a.source").alias("source"), F.col("a.sheet").alias("x"), F.col("b.sheet").alias("y"), F.greatest("a.n", "b.n").alias("n")).agg(F.count(F.lit(1)).alias("m"))
            .filter(F.col("m") / F.col("n") >= V.SAME_BILL))
    edges = durable(same.select("source", "x", "y").unionByName(same.select("source", F.col("y").alias("x"), F.col("x").alias("y"))))
    labels = durable(reps.select("source", "sheet", F.col("sheet").alias("cluster")))
    while True:
        heard = edges.join(labels.select("source", F.col("sheet").alias("y"), "cluster"), ["source", "y"]).groupBy("source", F.col("x").alias("sheet")).agg(F.min("cluster").alias("best"))
        moved = durable(labels.join(heard, ["source", "sheet"], "left").select("source", "sheet", F.least("cluster", "best").alias("cluster"), (F.col("best") < F.col("cluster")).alias("moved")))
        labels = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    named = member.join(labels.select("source", F.col("sheet").alias("rep"), "cluster"), ["source", "rep"]).withColumn("prefix", F.coalesce(sheet_prefix(F.col("sheet")), F.lit("")))
    clusters = named.groupBy("source", "cluster").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("prefix").alias("prefixes"))
    whole = named.groupBy("source", "prefix").agg(F.count(F.lit(1)).alias("all"))
    checked = named.join(clusters, ["source", "cluster"]).join(whole, ["source", "prefix"])
    rest = F.trim(F.substr("sheet", F.length("prefix") + 2))
    vendor = F.when((F.col("prefix") != "") & (F.length("sheet") > F.length("prefix") + 1) & (rest != ""), rest).otherwise(tidy("sheet"))
    return checked.select(*SHEET, "cluster", vendor.alias("vendor"), ((F.col("size") >= 2) & (F.col("prefixes") == 1) & (F.col("all") == F.col("size"))).alias("accepted"))


# ---------------------------------------------------------------- classes, tolerance, money

def classify_rows(records: DataFrame) -> DataFrame:
    """Adds ``kind``: a note's class, comparable, out_of_scope or not_quoted."""
    comparable, unlisted = F.lit(False), F.lit(True)
    for a in AXES:
        comparable = comparable | F.coalesce((F.col(f"{a}_benchmark") > 0) & F.col(f"{a}_proposal").isNotNull(), F.lit(False))
        unlisted = unlisted & (F.coalesce(f"{a}_benchmark", F.lit(0.0)) == 0)
    return records.withColumn("kind", F.coalesce("note", F.when(comparable, "comparable").when(unlisted, "out_of_scope").otherwise("not_quoted")))


def infer_tolerance(records: DataFrame) -> DataFrame:
    """``vendor, tolerance, sample``: the smallest over-ratio the file itself set down to the
    benchmark, floored to half a percent; null below 20 samples."""
    ratio = F.array(*[F.when(
        (F.col(f"{a}_benchmark") > 0) & (F.col(f"{a}_proposal") > F.col(f"{a}_benchmark")) & (F.abs(F.col(f"{a}_normalized") - F.col(f"{a}_proposal")) > 1e-9)
        & (F.abs(F.col(f"{a}_normalized") - F.col(f"{a}_benchmark")) <= F.col(f"{a}_benchmark") * 1e-6), F.col(f"{a}_proposal") / F.col(f"{a}_benchmark")) for a in AXES])
    found = records.select("vendor", F.explode(ratio).alias("r")).groupBy("vendor").agg(F.count("r").alias("sample"), F.min("r").alias("low"))
    half = F.greatest(F.lit(0.0), F.floor((F.col("low") - 1) * 100 * 2) / 2) / 100
    return found.select("vendor", F.when(F.col("sample") >= V.MIN_TOLERANCE_SAMPLE, half).alias("tolerance"), "sample")


def choose_tolerance(inferred: DataFrame | None = None, declared: float | None = None) -> tuple[float, str]:
    """One tolerance for all vendors: declared, else the largest inferred, else 15 %."""
    if declared is not None:
        return declared, "declared"
    largest = inferred.agg(F.max("tolerance")).first()[0] if inferred is not None else None
    return (largest, "inferred") if largest is not None else (V.DEFAULT_TOLERANCE, "default")


def flag_mismatch(records: DataFrame) -> DataFrame:
    """``mismatch``: comparable, with a rate over 20 times the benchmark."""
    over = F.lit(False)
    for a in RATES:
        over = over | F.coalesce((F.col(f"{a}_benchmark") > 0) & (F.try_divide(F.col(f"{a}_proposal"), F.col(f"{a}_benchmark")) > V.RATIO_CAP), F.lit(False))
    return records.withColumn("mismatch", (F.col("kind") == "comparable") & over)


def line_money(records: DataFrame, tolerance: float) -> DataFrame:
    """Adds ``original`` and ``normalized`` values to classified, mismatch-flagged records.

    A stated total wins over quantity × rates.  Quantity and rates are capped at the
    benchmark only when over tolerance, and the cap is scaled to the stated total."""
    zero, limit = F.lit(0.0), F.lit(1 + tolerance)
    qb, qr, stated = F.col("quantity_proposal"), F.col("quantity_benchmark"), F.col("total_proposal")
    bids = {a: F.col(f"{a}_proposal") for a in RATES}
    used = {a: F.when((F.col(f"{a}_benchmark") > 0) & (bids[a] > F.col(f"{a}_benchmark") * limit), F.col(f"{a}_benchmark")).otherwise(bids[a]) for a in RATES}
    bid_rate, used_rate = (sum((F.coalesce(x[a], zero) for a in RATES), zero) for x in (bids, used))
    priced = bids["material"].isNotNull() | bids["labour"].isNotNull()
    quantity = F.when((qr > 0) & (qb > qr * limit), qr).otherwise(qb)
    calc = F.when(priced & qb.isNotNull(), qb * bid_rate)
    original = F.coalesce(stated, calc, zero)
    capped = quantity * used_rate
    normalized = F.when(F.coalesce(calc, zero) == 0, original).when(stated.isNotNull(), original * F.try_divide(capped, calc)).otherwise(capped)
    lump = F.coalesce(stated, F.coalesce(qb, zero) * bid_rate)
    return (records.withColumn("original", F.when(F.col("mismatch"), lump).otherwise(original))
            .withColumn("normalized", F.when(F.col("mismatch"), lump).otherwise(normalized)))


def priced_records(records: DataFrame, tolerance: float) -> DataFrame:
    return line_money(flag_mismatch(classify_rows(records)), tolerance)


def aggregate_groups(money: DataFrame, tolerance: float) -> DataFrame:
    """Counts, values and weighted deviation sums per (vendor, group)."""
    line = ~F.col("parent")
    fair = line & (F.col("kind") == "comparable") & ~F.col("mismatch")
    aggs = [F.count_if(line).alias("total"), *[F.count_if(line & (F.col("kind") == k)).alias(k) for k in ("comparable", "out_of_scope", "not_quoted")],
            F.count_if("parent").alias("parent_rows"), F.coalesce(F.sum(F.when(F.col("parent"), F.col("total_proposal"))), F.lit(0.0)).alias("parent_value"),
            F.count_if(line & F.col("mismatch")).alias("mismatch"), F.coalesce(F.sum(F.when(line, F.col("original"))), F.lit(0.0)).alias("original"),
            F.coalesce(F.sum(F.when(line, F.col("normalized"))), F.lit(0.0)).alias("normalized"), F.sum(F.when(line, F.col("total_normalized"))).alias("stated_normalized")]
    for a in AXES:
        ref, bid, weight = F.col(f"{a}_benchmark"), F.col(f"{a}_proposal"), F.col("quantity_benchmark")
        aggs += [F.count_if(fair & (ref > 0) & (bid > ref * (1 + tolerance))).alias(f"{a}_over"), F.count_if(fair & (bid < ref)).alias(f"{a}_under"),
                 F.count(F.when(line, ref)).alias(f"{a}_listed")]
        if a in RATES:
            counted = fair & (ref > 0) & bid.isNotNull() & (weight != 0)
            aggs += [F.coalesce(F.sum(F.when(counted, weight * ref)), F.lit(0.0)).alias(f"{a}_w_ref"), F.coalesce(F.sum(F.when(counted, weight * bid)), F.lit(0.0)).alias(f"{a}_w_bid")]
    return money.groupBy("vendor", "group").agg(*aggs)


def summarize(groups: DataFrame) -> DataFrame:
    """Ratios per group and per vendor (``group`` null); null where there is no base."""
    measures = [c for c in groups.columns if c not in ("vendor", "group")]
    # Group rows are few; grouping sets add the vendor totals without reading the records twice.
    both = groups.groupingSets([["vendor", "group"], ["vendor"]], "vendor", "group").agg(*[F.sum(c).alias(c) for c in measures])
    both = both.withColumn("benchmark_items", F.col("comparable") + F.col("not_quoted")).withColumn("savings", F.col("original") - F.col("normalized"))
    out = both.withColumn("savings_pct", F.try_divide(F.col("savings"), F.nullif("original", F.lit(0.0))) * 100)
    for a in AXES:
        out = out.withColumn(f"{a}_over_pct", F.try_divide(F.col(f"{a}_over"), F.nullif("benchmark_items", F.lit(0))) * 100)
    for a in RATES:
        out = out.withColumn(f"{a}_dev_pct", (F.try_divide(F.col(f"{a}_w_bid"), F.nullif(f"{a}_w_ref", F.lit(0.0))) - 1) * 100)
    return out


# ---------------------------------------------------------------- comparisons

def comparison_matrix(summary: DataFrame, metric: str, vendors: list[str]) -> DataFrame:
    """Group × vendor.  A vendor without the axis stays null, never zero."""
    axis = metric.split("_")[0]
    value = F.when(F.col(f"{axis}_listed") > 0, F.col(metric))
    return summary.filter("group is not null").groupBy("group").pivot("vendor", vendors).agg(F.max(value)).orderBy("group")


def leaders(summary: DataFrame) -> DataFrame:
    """``vendor, metric, group, value``: the largest group of each metric; a deviation claim
    needs five comparable items behind it."""
    groups = summary.filter("group is not null")
    metrics = (("quantity_over", 0), ("labour_dev_pct", V.MIN_LEADER_ITEMS), ("material_dev_pct", V.MIN_LEADER_ITEMS), ("savings", 0))
    long = groups.select("vendor", "group", "comparable", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(least).alias("least")) for m, least in metrics])).alias("x")).select("vendor", "group", "comparable", "x.*")
    return (long.filter("value is not null and comparable >= least").groupBy("vendor", "metric")
            .agg(F.min_by("group", F.struct((-F.col("value")).alias("v"), "group")).alias("group"), F.max("value").alias("value")))


def pattern_labels(summary: DataFrame) -> DataFrame:
    """``vendor, pattern, top_groups``: which axis carries the deviation, and the two groups
    with the largest savings."""
    totals = summary.filter("group is null")
    padding = totals.agg(F.max(F.coalesce("quantity_over_pct", F.lit(0.0))).alias("m")).scalar()
    lab, mat, qty = (F.coalesce(c, F.lit(0.0)) for c in ("labour_dev_pct", "material_dev_pct", "quantity_over_pct"))
    price = F.when((lab > 15) & (lab > mat + 10), "labour-heavy").when((mat > 15) & (mat > lab + 10), "material-heavy").when((lab > 15) & (mat > 15), "labour and material high")
    named = totals.withColumn("_max", padding).select("vendor", F.concat_ws(" + ", price, F.when((qty > 5) & (qty >= .8 * F.col("_max")), "quantity padding")).alias("pattern"))
    rank = F.row_number().over(Window.partitionBy("vendor").orderBy(F.col("savings").desc(), "group"))
    worst = (summary.filter("group is not null and savings > 0").withColumn("_k", rank).filter("_k <= 2").groupBy("vendor")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "group"))), lambda s: s["group"]), ", ").alias("top_groups")))
    return (named.join(worst, "vendor", "left")
            .select("vendor", F.when(F.col("pattern") == "", "close to benchmark").otherwise(F.col("pattern")).alias("pattern"), F.coalesce("top_groups", F.lit("")).alias("top_groups")))


def field_summary(summary: DataFrame) -> DataFrame:
    """``vendors, items, closest, furthest, average_savings, average_savings_pct`` over priced vendors."""
    totals = summary.filter("group is null")
    priced = F.col("savings_pct").isNotNull()
    return totals.agg(F.count(F.lit(1)).alias("vendors"), F.sum("benchmark_items").alias("items"),
                      F.min_by("vendor", F.when(priced, F.struct("savings_pct", "vendor"))).alias("closest"),
                      F.min_by("vendor", F.when(priced, F.struct((-F.col("savings_pct")).alias("s"), "vendor"))).alias("furthest"),
                      F.avg(F.when(priced, F.col("savings"))).alias("average_savings"), F.avg("savings_pct").alias("average_savings_pct"))


def disambiguate(prepared: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vendors, skipped files): a vendor named in several files becomes ``vendor (file)``."""
    stem = F.regexp_replace("source", r"\.[A-Za-z0-9]+$", "")
    counts = prepared.groupBy("vendor").agg(F.count(F.lit(1)).alias("_n"))
    named = prepared.join(counts, "vendor").withColumn("vendor", F.when(F.col("_n") > 1, F.concat("vendor", F.lit(" ("), stem, F.lit(")"))).otherwise(F.col("vendor"))).drop("_n")
    skipped = files.join(prepared.select("source").distinct(), "source", "left_anti").withColumn("reason", F.lit("no comparison columns found"))
    return named, skipped


def scan_labels(grid: DataFrame) -> DataFrame:
    """``source, vendor, project`` from labelled cells (``label: value`` or the label beside
    its value), the first found in sheet order among the first cells of each sheet."""
    head = head_rows(drop_blank_rows(grid), LABEL_CELLS + 1).withColumn("f", filled_cells())
    # At most 401 rows of each sheet are left.
    before = F.coalesce(F.sum(F.size("f")).over(Window.partitionBy(*SHEET).orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = (head.withColumn("_b", before).filter(F.col("_b") <= LABEL_CELLS)
             .select(*SHEET, "row_number", F.posexplode("f").alias("i", "t"), F.col("f")).withColumn("next", F.get("f", F.col("i") + 1)).drop("f"))

    def said(labels):
        alt = "(?:" + "|".join(labels) + ")"
        direct = tidy(F.regexp_extract("t", rf"(?i){alt}\s*[:：]\s*([^|\n]+)", 1))
        beside = F.when(F.col("t").rlike(rf"(?i)^\s*{alt}\s*[:：]?\s*$") & (F.coalesce(number_of(F.col("next")), F.lit(0.0)) == 0), tidy("next"))
        return F.coalesce(F.nullif(direct, F.lit("")), F.nullif(beside, F.lit("")))
    vendor = F.coalesce(said(V.VENDOR_LABELS), F.nullif(F.regexp_extract("t", V.OFFERED_BY, 1), F.lit("")))
    project = F.coalesce(said(V.PROJECT_LABELS), F.nullif(tidy(F.regexp_extract("t", r"(?i)^\s*(?:" + "|".join(V.PROJECT_LABELS) + r")\s+([^|\n:]{2,60})", 1)), F.lit("")))
    found = cells.select("source", F.struct("sheet", "row_number", "i").alias("at"), vendor.alias("vendor"), project.alias("project"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return found.groupBy("source").agg(first("vendor").alias("vendor"), first("project").alias("project"))


def reconcile(summary: DataFrame) -> DataFrame:
    """``vendor, normalized, stated_normalized, difference, difference_pct`` against the file's own total."""
    t = summary.filter("group is null and stated_normalized is not null")
    gap = F.col("normalized") - F.col("stated_normalized")
    return t.select("vendor", "normalized", "stated_normalized", gap.alias("difference"), (F.try_divide(gap, F.nullif("stated_normalized", F.lit(0.0))) * 100).alias("difference_pct"))


def benchmark_totals(summary: DataFrame) -> DataFrame:
    """One row over all vendors: offered, normalized, savings, values over tolerance, items."""
    over = sum((F.col(f"{a}_over") for a in AXES), F.lit(0))
    return summary.filter("group is null").agg(F.sum("original").alias("original"), F.sum("normalized").alias("normalized"), F.sum("savings").alias("savings"),
                                               F.sum(over).alias("over"), F.sum("benchmark_items").alias("items"))
