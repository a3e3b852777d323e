"""Per-sheet operators over graded answers (sheet, q, choice, note, fill, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def questions_where(flag: Column) -> Column:
    """The question numbers that are flagged, as text 'Q1,Q5'; one sheet's list is bounded by its template."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(flag, F.col("q")))), lambda q: F.concat(F.lit("Q"), q.cast("string"))), ",")


def sheet_rollup(answers: DataFrame) -> DataFrame:
    """One result row a sheet. Ambiguous answers do not make a sheet invalid."""
    blank, double = F.col("choice").isNull(), F.col("note") == "double_mark"
    return answers.groupBy("sheet").agg(
        F.count("*").alias("questions"),
        F.count("choice").alias("answered"),
        questions_where(blank).alias("unanswered"),
        questions_where(double).alias("double_marked"),
        questions_where(F.col("note") == "ambiguous").alias("ambiguous"),
        (F.count_if(blank | double) == 0).alias("valid"),
    )


def answer_map(answers: DataFrame) -> DataFrame:
    """sheet, answers: JSON object of question to choice, in question order (unanswered: null)."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("q", "choice"))), lambda p: F.struct(p["q"].cast("string").alias("key"), p["choice"].alias("value")))
    return answers.groupBy("sheet").agg(F.to_json(F.map_from_entries(pairs)).alias("answers"))


def answers_of_map(maps: DataFrame) -> DataFrame:
    """The way back from answer_map: sheet, q, choice; no rows from text that is no JSON object."""
    read = F.from_json("answers", "map<string,string>")
    return maps.select("sheet", F.explode(read).alias("q", "choice")).withColumn("q", F.col("q").cast("int"))


def answer_pivot(answers: DataFrame, width: int = 10) -> DataFrame:
    """sheet, decade, c0..: answers laid out `width` to a row ('-' for none)."""
    place = (F.col("q") - 1) % width
    cells = [F.coalesce(F.max(F.when(place == i, F.col("choice"))), F.lit("-")).alias(f"c{i}") for i in range(width)]
    return answers.groupBy("sheet", F.floor((F.col("q") - 1) / width).cast("int").alias("decade")).agg(*cells)


def blank_runs(answers: DataFrame, least: int = 10) -> DataFrame:
    """sheet, q, run, flag: every question at which a run of unanswered questions is `least` long or longer."""
    by_q = Window.partitionBy("sheet").orderBy("q")
    island = F.sum(F.col("choice").isNotNull().cast("int")).over(by_q)
    runs = answers.select("sheet", "q", "choice", island.alias("island"))
    nth = F.row_number().over(Window.partitionBy("sheet", "island").orderBy("q"))
    # the answered question that opens an island is not part of its run
    run = nth - (F.col("island") > 0).cast("int")
    return runs.withColumn("run", run).where(F.col("choice").isNull() & (F.col("run") >= least)).select(
        "sheet", "q", "run", F.concat(F.lit("blank_run_ends_at_Q"), F.col("q").cast("string")).alias("flag")
    )


def flag_strings(answers: DataFrame) -> DataFrame:
    """A row for each flagged question of a sheet: EMPTY_Qn or MULTIPLE_Qn."""
    flag = F.when(F.col("choice").isNull(), "EMPTY_Q").when(F.col("note") == "double_mark", "MULTIPLE_Q")
    return answers.withColumn("kind", flag).where("kind IS NOT NULL").select("sheet", "q", F.concat("kind", F.col("q").cast("string")).alias("flag"))


def issues(answers: DataFrame) -> DataFrame:
    """sheet, valid, issues: what is wrong with a sheet, as one text."""
    rolled = answers.groupBy("sheet").agg(questions_where(F.col("choice").isNull()).alias("unanswered"), questions_where(F.col("low_confidence")).alias("low"))
    named = lambda c, text: F.when(F.col(c) != "", F.concat(F.lit(text), F.col(c)))
    text = F.concat_ws("; ", named("unanswered", "unanswered questions: "), named("low", "low-confidence answers: "))
    return rolled.select("sheet", (text == "").alias("valid"), text.alias("issues"))


def previews(items: DataFrame, most: int = 10) -> DataFrame:
    """sheet, n, preview: the first items (q, rank, label) of each sheet in order of question and rank, then
    '...' if there are more; a sheet has at most as many as its template has bubbles."""
    rows = items.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("q", "rank", "label"))).alias("a"))
    shown = F.array_join(F.transform(F.slice("a", 1, most), lambda x: x["label"]), ",")
    return rows.select("sheet", F.size("a").alias("n"), F.concat(shown, F.when(F.size("a") > most, ",...").otherwise("")).alias("preview"))


def type_summary(overrides: DataFrame, questions: int, default: str, types: dict[str, str]) -> DataFrame:
    """sheet, and how many of its questions are of each type, as '3xtwo | 7xfour' in the order of types.
    overrides: sheet, q, type (one a question); the other questions are of the default type."""
    inside = F.col("q").between(1, questions)
    counts = overrides.groupBy("sheet").agg(*[F.count_if(inside & (F.col("type") == t)).alias(t) for t in types], F.count_if(inside).alias("given"))
    n = {t: F.col(t) + (questions - F.col("given") if t == default else 0) for t in types}
    parts = [F.when(n[t] > 0, F.concat(n[t].cast("string"), F.lit("x"), F.lit(name))) for t, name in types.items()]
    return counts.select("sheet", F.concat_ws(" | ", *parts).alias("summary"))
