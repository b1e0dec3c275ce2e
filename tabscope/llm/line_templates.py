"""Line dedup with a log-template tree, in DataFrame operations only.

Lines go down a tree of fixed depth: first by number of words, then by their leading words, words
with digits standing as ``<*>``.  In a leaf, a place is *variable* if no word fills it in half of
the leaf's lines; variable places become ``<*>`` too.  What results is the line's template, as long
as enough of its words are fixed; else the line is masked for digits only, or stands as it is.

A template is dropped wherever it stands if it recurs in at least ``min_docs`` documents that really
differ.  Copies and near copies count as one document: texts are linked where the bottom-k sketches of
their word triples agree in ``ALIKE`` or more, and linked texts are one *family*.  So copied text is
left to the operators that find copies, however often it is copied, while navigation, notices and
boilerplate go, whatever else their documents share.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C
from tabscope.llm.components import components

BLANKS = "\t\x0b\x0c\r"
DIGITS = r"[^ ]*[0-9][^ ]*"
ANY = "<*>"
#: Parts of the rows of one hot leaf or template, so that a very common line is not one task's work.
SALTS = 16
#: A key is hot if it holds this share of all lines or more, so there are at most ``1 / HOT`` of them.
HOT = 0.001
#: Word triples of a text's sketch (its smallest hashes), those of them that propose links, and the
#: share that must agree.
SKETCH, KEYS, ALIKE = 64, 16, 0.6


def _words(plain: Column) -> Column:
    return F.split(plain, " ", -1)


def _masked(plain: Column) -> Column:
    """The line with words that hold digits masked; whole lines at once, not word by word."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, DIGITS, ANY)).otherwise(plain)


def _lines(docs: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """``row, whole, line, leaf, plain``: one row per line with words; ``plain`` has single spaces."""
    rows = docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("row"), F.xxhash64(F.col(text)).alias("whole"),
                       F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "own"))
    # Most lines have single spaces only and need no pattern.
    blank = reduce(or_, [F.col("own").contains(c) for c in BLANKS])
    spaced = rows.select("row", "whole", "line", F.btrim(F.when(blank, F.regexp_replace("own", f"[{BLANKS}]", " ")).otherwise(F.col("own"))).alias("spaced")).filter("spaced != ''")
    plain = spaced.select("row", "whole", "line", F.when(F.col("spaced").contains("  "), F.regexp_replace("spaced", " {2,}", " ")).otherwise(F.col("spaced")).alias("plain"))
    cut = plain.withColumn("words", _words(_masked(F.col("plain"))))
    return cut.select("row", "whole", "line", F.xxhash64(F.size("words"), F.slice("words", 1, depth)).alias("leaf"), "plain")


def _join(lines: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Lines with the facts (one row per key, ``n`` lines each) of their leaf or template.

    The facts grow with the lines, so they are never broadcast; hot keys are, being at most
    ``1 / HOT``, and their lines are dealt over ``SALTS`` parts."""
    hot = F.col("n") >= F.lit(HOT * total)
    heavy = facts.filter(hot).select(key, F.lit(True).alias("_hot"))
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0))))).drop("n").hint("merge")
    dealt = lines.join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def families(docs: DataFrame, room: str, text: str = "text") -> DataFrame:
    """``whole, root`` of every text (by its hash) that has near copies; ``root`` names its family."""
    spark = docs.sparkSession
    words = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("whole"), F.split(F.btrim(F.col(text), F.lit(" \n" + BLANKS)), f"[ \n{BLANKS}]+").alias("w"))
    triples = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    prints = C.stored(words.select("whole", F.slice(F.sort_array(F.array_distinct(triples)), 1, SKETCH).alias("sketch")).groupBy("whole").agg(F.min("sketch").alias("sketch")), f"{room}/prints")
    keys = prints.select(F.explode(F.slice("sketch", 1, KEYS)).alias("key"), "whole")
    # Each text of a bucket is compared with two leaders: the least of all and the least by hash.
    turned = F.min_by("whole", F.xxhash64("whole"))
    led = keys.groupBy("key").agg(F.min("whole").alias("x"), turned.alias("y"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = max(1, prints.count() * KEYS)
    led = C.stored(led, f"{room}/leaders")
    met = _join(keys.withColumn("row", F.col("whole")), led, "key", total)
    pairs = C.stored(met.select("whole", F.explode(F.array("x", "y")).alias("leader")).filter("whole <> leader").distinct(), f"{room}/proposed")
    both = pairs.join(prints, "whole").join(prints.select(F.col("whole").alias("leader"), F.col("sketch").alias("other")), "leader")
    union = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    alike = F.size(F.array_intersect(union, F.array_intersect("sketch", "other"))) >= F.lit(ALIKE) * F.size(union)
    links = C.stored(both.filter(alike).select(F.col("whole").alias("a"), F.col("leader").alias("b")), f"{room}/alike")
    C.discard(spark, f"{room}/prints", f"{room}/leaders", f"{room}/proposed")
    return C.stored(components(links, f"{room}/families").select(F.col("node").alias("whole"), "root"), f"{room}/roots")


def recurring_lines(docs: DataFrame, room: str, doc_id: str = "doc_id", text: str = "text", depth: int = 3, fixed: float = 0.6, min_docs: int = 3) -> DataFrame:
    """``row, line`` of every line whose template recurs; ``row`` is the hash of id and text."""
    roots = families(docs, room, text)
    lines = C.stored(_lines(docs, doc_id, text, depth), f"{room}/lines")
    total = max(1, lines.count())
    # Only leaves with enough lines can hold a recurring template.
    leaves = C.stored(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs), f"{room}/leaves")
    held = C.stored(_join(lines, leaves, "leaf", total), f"{room}/held")
    C.discard(docs.sparkSession, f"{room}/lines", f"{room}/leaves")
    held = held.withColumn("raw", _words(F.col("plain"))).withColumn("words", _words(_masked(F.col("plain"))))
    places = (held.select("leaf", F.posexplode("words").alias("place", "word")).groupBy("leaf", "place", "word").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("leaf", "place").agg(F.max("n").alias("most"), F.sum("n").alias("all")))
    variable = C.stored(places.filter("2 * most < all").groupBy("leaf").agg(F.collect_list("place").alias("free"), F.max("all").alias("n")), f"{room}/variable")
    marked = _join(held, variable, "leaf", total, "left")
    general = F.when(F.col("free").isNull(), F.col("words")).otherwise(F.transform("words", lambda w, i: F.when(F.array_contains("free", i), ANY).otherwise(w)))

    def enough(words):
        return F.size(F.filter(words, lambda w: w != ANY)) >= F.lit(fixed) * F.size(words)

    template = F.when(enough(general), general).when(enough(F.col("words")), F.col("words")).otherwise(F.col("raw"))
    marked = C.stored(marked.select("row", "whole", "line", F.md5(F.encode(F.array_join(template, " "), "UTF-8")).alias("template")), f"{room}/templates")
    texts = marked.groupBy("template", "whole").agg(F.count(F.lit(1)).alias("n")).join(roots, "whole", "left")
    counts = (texts.groupBy("template", F.coalesce("root", "whole").alias("family")).agg(F.sum("n").alias("n"))
              .groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")))
    often = C.stored(counts.filter(F.col("docs") >= min_docs).select("template", "n"), f"{room}/often")
    C.discard(docs.sparkSession, f"{room}/held", f"{room}/variable")
    return _join(marked, often, "template", total).select("row", "line")


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 3, fixed: float = 0.6, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` rid of lines whose template recurs, and ``lines_before``, ``lines_dropped``.

    All rows stay, with all their columns.  Lines end at a line feed; blank lines are never
    dropped.  A null text stays null and has no lines; an empty one has a single blank line.  Rows
    repeating id and text count as one document and lose the same lines, as do copies under other
    ids.  A very long text is one document like any other: its sketch has ``SKETCH`` values.  An
    empty table gives no rows.  If ``docs`` has a column ``lines_before`` or ``lines_dropped``, it stays
    and the count gets a ``_`` behind its name.
    """
    room = C.workroom(docs.sparkSession, "lines")
    gone = C.stored(recurring_lines(docs, room, doc_id, text, depth, fixed, min_docs), f"{room}/gone").groupBy("row").agg(F.collect_set("line").alias("gone"))
    row, out = C.fresh(docs, "_row"), C.fresh(docs, "_gone")
    joined = docs.withColumn(row, F.xxhash64(F.col(doc_id).cast("string"), F.col(text))).join(gone.select(F.col("row").alias(row), F.col("gone").alias(out)).hint("merge"), row, "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains(out, i))
    return (joined.withColumn(C.fresh(docs, "lines_before"), F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("bigint"))
            .withColumn(C.fresh(docs, "lines_dropped"), F.when(F.col(out).isNull(), F.lit(0)).otherwise(F.size(out)).cast("bigint"))
            .withColumn(text, F.when(F.col(out).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).drop(row, out))
