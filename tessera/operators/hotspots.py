"""Change hotspots over commit history, and the history look-ups around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_path, truncate

# Extensions counted by default.
EXTENSIONS = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".rs", ".go", ".java")


def has_extension(file: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    return F.exists(F.array(*[F.lit(e) for e in extensions]), lambda e: F.endswith(file, e))


def commit_log(commits: DataFrame, n: int = 10, author: str | None = None, grep: str | None = None, since=None) -> DataFrame:
    for cond in ((F.col("author").rlike(author) if author else None), (F.col("subject").rlike(grep) if grep else None), (F.col("ts") >= F.lit(since) if since is not None else None)):
        commits = commits if cond is None else commits.where(cond)
    return commits.orderBy(F.desc("ts"), "sha").limit(n)


def churn(commits: DataFrame, commit_files: DataFrame, n: int = 100, since=None) -> DataFrame:
    """file, changes over the last n commits. The n commits are few, so they are the broadcast side."""
    recent = (commits.where(F.col("ts") >= F.lit(since)) if since is not None else commits).orderBy(F.desc("ts"), "sha").limit(n).select("sha")
    return commit_files.join(F.broadcast(recent) if n <= 100_000 else recent, "sha").groupBy(normal_path(F.col("file")).alias("file")).agg(F.count("*").alias("changes"))


def score(changes: Column, authors: Column) -> Column:
    return F.round(changes * (1 + F.sqrt(authors.cast("double"))), 1)


def risk_level(changes: Column, authors: Column) -> Column:
    return F.when((changes > 10) & (authors > 3), "CRITICAL").when((changes > 5) & (authors > 2), "HIGH").when(changes > 3, "MEDIUM").otherwise("LOW")


def hotspots(counts: DataFrame, authorship: DataFrame, min_changes: int = 2, candidates: int = 15, top: int = 10) -> DataFrame:
    """file, changes, authors, score, risk, top_authors (the first three by name).

    counts: file, changes. authorship: file, author, over a window of its own. Authors are looked
    up for the `candidates` most changed files only (other files can't reach the top ranks, and
    that is part of the meaning: they count 0 authors). Ties go by file.
    """
    best = counts.orderBy(F.desc("changes"), "file").limit(candidates)
    names = authorship.where(F.trim("author") != "").join(F.broadcast(best.select("file")), "file", "left_semi").groupBy("file").agg(F.countDistinct("author").alias("n"), F.slice(F.array_sort(F.collect_set("author")), 1, 3).alias("top"))
    out = counts.where(F.col("changes") >= min_changes).join(F.broadcast(names), "file", "left")
    authors = F.coalesce("n", F.lit(0)).cast("long")
    out = out.select("file", "changes", authors.alias("authors"), score(F.col("changes"), authors).alias("score"), risk_level(F.col("changes"), authors).alias("risk"), F.coalesce("top", F.array().cast("array<string>")).alias("top_authors"))
    return out.orderBy(F.desc("score"), "file").limit(top)


def authors_of(rows: DataFrame, keys: Sequence[str], author: Column, cap: int = 10) -> DataFrame:
    return rows.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set(author)), 1, cap).alias("authors"))


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """sha|author|email|subject lines; bars in the subject stay."""
    p = F.split(col, r"\|", 4)
    return lines.where(F.size(p) == 4).select(p[0].alias("sha"), p[1].alias("author"), p[2].alias("email"), p[3].alias("subject"))


def blame_authors(lines: DataFrame, col: str = "value") -> DataFrame:
    """Distinct authors of porcelain blame lines, sorted, ten at most."""
    return lines.where(F.startswith(col, F.lit("author "))).agg(F.slice(F.array_sort(F.collect_set(F.substring(col, 8, 1_000_000))), 1, 10).alias("authors"))


# What stands below a table of hotspots.
TABLE_NOTES = (
    "Churn = commits touching the file in the analysis window.",
    "Score = churn × (1 + √authors)  (coordination complexity).",
    "CRITICAL (>10 churn, >3 authors) → audit before fuzzing.",
)


def table_line(spots: DataFrame) -> DataFrame:
    """spots with line: names over 44 characters keep their last 41."""
    name = F.when(F.length("file") > 44, F.concat(F.lit("..."), F.right("file", F.lit(41)))).otherwise(F.col("file"))
    return spots.withColumn("line", F.format_string("%-45s %6d %5d %8s %6.1f", name, "changes", "authors", "risk", "score"))


def table(spots: DataFrame) -> DataFrame:
    """text: the ten best hotspots as a table with a head and notes."""
    head = [f"{'File':<45} {'Churn':>6} {'Auth':>5} {'Risk':>8} {'Score':>6}", "-" * 72]
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "file", "line"))), lambda r: r["line"])
    best = table_line(spots.orderBy(F.desc("score"), "file").limit(10))
    return best.agg(F.array_join(F.concat(F.array(*[F.lit(x) for x in head]), rows, F.array(*[F.lit(x) for x in ("", *TABLE_NOTES)])), "\n").alias("text"))


def short_lines(lines: Column, n: int = 200) -> Column:
    return truncate(lines, n, "...")


def blame(rows: DataFrame, file: str, line: int | None = None) -> DataFrame:
    """Blame rows (file, line, author, sha) of a file, or of one line of it."""
    if not file:
        raise ValueError("blame needs a file")
    out = rows.where(F.col("file") == file)
    return out if line is None else out.where(F.col("line") == line)
