"""Rule-based checks of documents and their merge into reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import banned_phrases, bullets, overlap, review_passed, word_count, word_keys

# Endings by which a code span is taken for a path.
PATH_ENDINGS = "py js ts tsx jsx go rs java md json yaml yml toml sh html css".split()


def references(documents: DataFrame) -> DataFrame:
    """(name, ref): the distinct code spans of documents (name, text) that look like paths; web addresses do not."""
    spans = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!`)`([^`\n]+)`(?!`)"), F.lit(1))))
    r = F.regexp_replace("ref", r"^\./", "")
    ext = F.lower(F.regexp_extract("ref", r"\.([A-Za-z0-9]+)$", 1))
    return documents.select("name", spans.alias("ref")).where(~F.col("ref").rlike(r"[\s()<>{}*]|://") & (ext.isin(*PATH_ENDINGS) | F.col("ref").endswith("/"))).select("name", r.alias("ref")).distinct()


def missing_references(documents: DataFrame, files: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(name, ref) of the references that are no path, base name (if they have no slash) or directory of files (file_path), and none of the known names."""
    p = F.col("file_path")
    parts = F.split(p, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    real = files.select(F.explode(F.concat(dirs, F.array(F.element_at(parts, -1)))).alias("ref")).distinct()
    wanted = references(documents)
    if known:
        wanted = wanted.where(~F.col("ref").isin(*known))
    return wanted.join(real, "ref", "left_anti").select("name", "ref")


def findings(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(name, issues): what the rules object to in each document, sorted; documents without objections have no row."""
    phrases = documents.select("name", F.explode(F.array_distinct(banned_phrases(F.col("text")))).alias("p")).select("name", F.format_string('contains a banned generic phrase: "%s"', "p").alias("issue"))
    refs = missing_references(documents, files).select("name", F.format_string("mentions `%s`, which doesn't exist in this repository", "ref").alias("issue"))
    return phrases.unionByName(refs).groupBy("name").agg(F.array_sort(F.collect_set("issue")).alias("issues"))


def merge_reviews(reviews: DataFrame, found: DataFrame) -> DataFrame:
    """(name, passed, issues, error): reviews with the findings added; a review that failed is replaced where there are findings."""
    f = found.withColumnRenamed("issues", "_f")
    j = reviews.join(f, "name", "full")
    has = F.size(F.coalesce("_f", F.array().cast("array<string>"))) > 0
    old = F.when(has & F.col("error").isNotNull(), F.array().cast("array<string>")).otherwise(F.coalesce("issues", F.array().cast("array<string>")))
    return j.select("name", F.when(has, F.lit(False)).otherwise(F.coalesce("passed", F.lit(True))).alias("passed"), F.array_distinct(F.concat(old, F.coalesce("_f", F.array().cast("array<string>")))).alias("issues"), F.when(~has, F.col("error")).alias("error"))


def grounded(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(name, prompt): each document (name, text) with the facts (name, facts) that a reviewer checks it against."""
    told = F.coalesce("facts", F.lit("(none)"))
    return documents.join(facts.dropDuplicates(["name"]), "name", "left").select("name", F.concat(F.lit("Document:\n"), "text", F.lit("\n\nFacts:\n"), told).alias("prompt"))


def review_of(reply) -> tuple:
    """(passed, issues) of a reviewer's reply, as columns: its status line and its bullets; without a status line it passes."""
    return review_passed(reply), bullets(reply)


def review_document(reviews: DataFrame) -> DataFrame:
    """(text): one document of all reviews (name, passed, issues, error), by name."""
    issues = F.when(F.size("issues") > 0, F.concat(F.lit("- "), F.array_join("issues", "\n- "))).otherwise("No issues found.")
    status = F.when(F.col("error").isNotNull(), F.format_string("**Status:** not reviewed (%s)", "error")).otherwise(F.concat(F.lit("**Status:** "), F.when(F.col("passed"), "PASS").otherwise("ISSUES FOUND"), F.lit("\n\n"), issues))
    part = F.format_string("## %s\n\n%s", "name", status)
    return reviews.agg(F.concat(F.lit("# Documentation Review\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("p")))), lambda x: x["p"]), "\n\n"), F.lit("\n")).alias("text"))


def dedupe_bullets(rows: DataFrame, keys: list[str], text: str, order: str, most: int = 5, near: float = 0.55) -> DataFrame:
    """keys, kept: the first bullets of each group that overlap with no kept one by near or more, at most so many, as one fold."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    same = lambda acc, x: F.exists(acc, lambda k: (k == x) | (overlap(word_keys(k), word_keys(x)) >= near))
    return rows.groupBy(*keys).agg(F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) >= most) | same(acc, x), acc).otherwise(F.array_append(acc, x))).alias("kept"))


def near_duplicates(rows: DataFrame, keys: list[str], id_: str, text: str, near: float = 0.8) -> DataFrame:
    """(a, b, share) of the pairs within a group whose sets of words overlap by near or more, by a prefix filter.

    Two sets that overlap by near share one of the rarest words of the smaller: only the rarest words of each set are joined.
    """
    words = rows.select(*keys, F.col(id_).alias("id"), word_keys(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = words.select(*keys, "id", F.explode("w").alias("x"))
    ranked = each.join(each.groupBy(*keys, "x").agg(F.count("*").alias("n")), [*keys, "x"])
    sets = ranked.groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))
    sets = sets.withColumn("s", F.transform("s", lambda y: y["x"])).withColumn("p", F.slice("s", F.lit(1), (F.size("s") - F.ceil(F.size("s") * near) + 1).cast("int")))
    small = sets.select(*keys, F.col("id").alias("a"), F.col("s").alias("sa"), F.explode("p").alias("x"))
    large = sets.select(*keys, F.col("id").alias("b"), F.col("s").alias("sb"), F.explode("s").alias("x"))
    pairs = small.join(large, [*keys, "x"]).where((F.size("sa") <= F.size("sb")) & (F.col("a") != F.col("b"))).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), overlap(F.col("sa"), F.col("sb")).alias("share"))
    return pairs.where(F.col("share") >= near).distinct()


def document_metrics(documents: DataFrame) -> DataFrame:
    """(name, words, has_overview, has_installation, has_usage, has_license, has_toc) of each document."""
    low = F.lower("text")
    return documents.select("name", word_count(F.col("text")).alias("words"), *(low.contains(h).alias(f"has_{h.split()[-1]}") for h in ("## overview", "## installation", "## usage", "## license")), low.contains("## table of contents").alias("has_toc"))


def issue_classes(reviews: DataFrame) -> DataFrame:
    """(name, banned, missing, other): issues of each kind; the first kind that fits counts."""
    x = reviews.select("name", F.explode_outer("issues").alias("i"))
    kind = F.when(F.col("i").contains("banned generic phrase"), "banned").when(F.col("i").contains("doesn't exist in this repository"), "missing").when(F.col("i").isNotNull(), "other")
    return x.withColumn("k", kind).groupBy("name").agg(*(F.count_if(F.col("k") == n).alias(n) for n in ("banned", "missing", "other")))


def summarise(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, least, most) over runs, the mean to two places."""
    long = runs.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 2).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
