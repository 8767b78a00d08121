"""Checks of evaluation labels: schema, grounding, claims; corpus profiles and plain chunkers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T

REQUIRED = ("id", "question", "source_docs", "answer", "difficulty")
OPTIONAL = ("answer_spans", "failure_mode")
DIFFICULTIES = ("easy", "medium", "hard")


def schema_problems(rows: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """line, problem, detail of rows(line, fields map<string,string>, id, difficulty, source_docs).

    A row with missing fields gets no further checks. Unknown documents are
    reported only if there is a corpus (name).
    """
    keys = F.map_keys("fields")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    checked = rows.withColumns({"missing": missing, "unknown": F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL)))})
    whole = checked.where(F.size("missing") == 0)
    seen = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    found = [
        checked.where(F.size("missing") > 0).select("line", F.lit("missing fields").alias("problem"), F.array_join(F.array_sort("missing"), ",").alias("detail")),
        whole.where(F.size("unknown") > 0).select("line", F.lit("unknown fields").alias("problem"), F.array_join(F.array_sort("unknown"), ",").alias("detail")),
        whole.withColumn("seen", seen).where("seen > 1").select("line", F.lit("duplicate id").alias("problem"), F.col("id").alias("detail")),
        whole.where(~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False))).select("line", F.lit("bad difficulty").alias("problem"), F.col("difficulty").alias("detail")),
        whole.where(F.coalesce(F.size("source_docs"), F.lit(0)) <= 0).select("line", F.lit("no source_docs").alias("problem"), F.lit("").alias("detail")),
    ]
    if corpus is not None:
        cited = whole.select("line", F.explode("source_docs").alias("detail"))
        found.append(cited.join(corpus, cited["detail"] == corpus["name"], "left_anti").select("line", F.lit("unknown source_doc").alias("problem"), "detail"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def ungrounded(golden: DataFrame, corpus: DataFrame, by: str = "id") -> DataFrame:
    """id, kind, missing: configuration keys (case counts) and spans (it doesn't) that the cited texts lack.

    Cited texts are joined without a separator, in their listed order. ``by``
    names the column that tells rows apart (``line`` where ids may be repeated)
    and is a column of the result too.
    """
    cited = golden.select(by, F.posexplode_outer("source_docs").alias("pos", "name")).join(corpus.select("name", "text"), "name", "left")
    body = cited.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "").alias("body"))
    rows, names = golden.join(body, by), dict.fromkeys([by, "id"])
    keys = F.filter(F.array_distinct(T.config_keys(F.col("answer"))), lambda k: ~F.col("body").contains(k))
    spans = F.filter(F.coalesce("answer_spans", F.array().cast("array<string>")), lambda s: ~F.lower("body").contains(F.lower(s)))
    one = rows.select(*names, F.lit("key").alias("kind"), F.explode(keys).alias("missing"))
    return one.unionByName(rows.select(*names, F.lit("span").alias("kind"), F.explode(spans).alias("missing")))


def claim_coverage(claims: DataFrame, passages: DataFrame, by: str = "qid") -> DataFrame:
    """qid, claim, coverage, paragraph: the paragraph (qid, ord, paragraph) with most of a claim's content words; the first of equals.

    ``by`` names the column that ties claims to passages (``line`` where ids
    may be repeated) and is a column of the result too.
    """
    names = list(dict.fromkeys([by, "qid"]))
    words = claims.select(*names, "claim", T.content_words(F.col("claim")).alias("words"))
    pairs = words.join(passages.select(by, "ord", "paragraph", F.array_distinct(T.content_words(F.col("paragraph"))).alias("has")), by, "left")
    hits = F.size(F.filter("words", lambda w: F.array_contains(F.coalesce("has", F.array().cast("array<string>")), w)))
    scored = pairs.withColumn("coverage", hits / F.greatest(F.size("words"), F.lit(1)))
    best = scored.groupBy(*names, "claim").agg(F.max(F.struct("coverage", (-F.coalesce("ord", F.lit(0))).alias("o"), "paragraph")).alias("b"))
    return best.select(*names, "claim", "b.coverage", F.when(F.col("b.coverage") > 0, F.col("b.paragraph")).otherwise("").alias("paragraph"))


def profile(files: DataFrame) -> DataFrame:
    """Counts of each file(name, text): characters, headings, fenced blocks, HTML tables and rows, Markdown rows."""
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return files.select(
        "name", F.char_length("text").cast("long").alias("chars"), count("(?m)^#{1,6} ").alias("headings"), F.floor(count("(?m)^```") / 2).cast("long").alias("fenced_blocks"),
        count("<table").alias("html_tables"), count("<tr>").alias("html_rows"), count(r"(?m)^\|").alias("md_table_rows"))


def fixed_windows(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """id, ord, text, n_tokens: windows over white-space words, ``overlap`` of them shared by neighbours."""
    step = size - overlap
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(step))
    rows = rows.select("id", "w", F.posexplode(starts).alias("ord", "at")).withColumn("part", F.slice("w", F.col("at") + 1, F.lit(size)))
    return rows.select("id", "ord", F.array_join("part", " ").alias("text"), F.size("part").alias("n_tokens"))


def whole_documents(docs: DataFrame) -> DataFrame:
    """id, ord, text, n_tokens: every document with words as one chunk, its words joined by single blanks."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("id", words.alias("w")).where(F.size("w") > 0)
    return rows.select("id", F.lit(0).alias("ord"), F.array_join("w", " ").alias("text"), F.size("w").alias("n_tokens"))


def table_rows(pages: DataFrame) -> DataFrame:
    """id, ord, row, is_header of the HTML table rows in a text."""
    rows = pages.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("ord", "row"))
    header = F.min(F.when(F.col("row").rlike(r"(?i)<th\b"), F.col("ord"))).over(Window.partitionBy("id"))
    return rows.withColumn("is_header", F.coalesce(F.col("ord") == header, F.lit(False)))


def weakest_first(report: DataFrame) -> DataFrame:
    return report.orderBy("coverage", "qid", "claim", "paragraph")


def squashed_report(report: DataFrame) -> Column:
    return T.squashed(F.col("paragraph"))
