"""Grading policies: from bubble fills to one answer per question.

Bubbles of a question are first laid side by side (fill of rank 0..4 in one row), which is one
aggregation with map-side combining; every policy is then a projection over that row, without
windows, lists or joins. Policies differ on purpose and are never blended; thresholds are fields of
frozen dataclasses, not globals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LETTERS, clip, nano, rounded, total
from ..sources.marks import MASK

RANKS = range(5)


def question_rows(marks: DataFrame, by: tuple[str, ...] = ("sheet", "q")) -> DataFrame:
    """by..., f0..f4: the darkest fill of each rank, null where no bubble was seen."""
    return marks.groupBy(*by).agg(*[F.max(F.when(F.col("rank") == r, F.col("dark"))).alias(f"d{r}") for r in RANKS]).select(*by, *[(F.col(f"d{r}") / F.lit(float(MASK))).alias(f"f{r}") for r in RANKS])


def detected_rows(marks: DataFrame, detections: DataFrame) -> DataFrame:
    """question_rows with, per rank, the confidence y0..y4 and the verdict z0..z4 (filled or not) of the most
    confident detection (sheet, q, rank, conf, filled); one aggregation over both tables, no join."""
    both = marks.select("sheet", "q", "rank", "dark").unionByName(detections.select("sheet", "q", "rank", "conf", "filled"), allowMissingColumns=True)
    at = [F.when(F.col("rank") == r, F.col("dark")) for r in RANKS]
    seen = [F.when((F.col("rank") == r) & F.col("conf").isNotNull(), F.struct("conf", "filled")) for r in RANKS]
    rows = both.groupBy("sheet", "q").agg(*[F.max(d).alias(f"d{r}") for r, d in enumerate(at)], *[F.max(x).alias(f"x{r}") for r, x in enumerate(seen)])
    return rows.select("sheet", "q", *[(F.col(f"d{r}") / F.lit(float(MASK))).alias(f"f{r}") for r in RANKS], *[F.col(f"x{r}.conf").alias(f"y{r}") for r in RANKS], *[F.col(f"x{r}.filled").alias(f"z{r}") for r in RANKS])


def with_spine(answers: DataFrame, questions: int, blank: dict) -> DataFrame:
    """A row for each question 1..questions of each sheet; blank has the values of questions that
    answers lacks. A sheet has at most `questions` rows, so its map is small; no join is needed."""
    names = [c for c in answers.columns if c not in ("sheet", "q")]
    sheets = answers.where(F.col("q").between(1, questions)).groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("q", F.struct(*names).alias("v")))).alias("m"))
    sheets = sheets.select("sheet", "m", F.explode(F.sequence(F.lit(1), F.lit(questions))).alias("q")).select("sheet", "q", F.try_element_at("m", F.col("q")).alias("v"))
    return sheets.select("sheet", "q", *[F.when(F.col("v").isNull(), F.lit(blank[c])).otherwise(F.col(f"v.{c}")).alias(c) for c in names])


def named(letter: str, n: int = len(RANKS)) -> list[Column]:
    return [F.col(f"{letter}{r}") for r in range(n)]


def fills() -> list[Column]:
    return named("f")


def numbered(letter: str, values: list[Column]) -> dict[str, Column]:
    return {f"{letter}{r}": v for r, v in enumerate(values)}


def count(flags: list[Column]) -> Column:
    return total([F.coalesce(f.cast("int"), F.lit(0)) for f in flags])


def letters(flags: list[Column]) -> Column:
    """Letters of the flagged ranks, in rank order."""
    return F.concat_ws("", *[F.when(f, F.lit(LETTERS[r])) for r, f in enumerate(flags)])


def arg_max(values: list[Column], flags: list[Column] | None = None) -> Column:
    """The letter of the largest flagged value; the first rank wins ties."""
    values = [F.when(f, v) for f, v in zip(flags, values)] if flags else values
    top = F.greatest(*values)
    return F.coalesce(*[F.when(v == top, F.lit(LETTERS[r])) for r, v in enumerate(values)])


def first_rank(flags: list[Column]) -> Column:
    return F.coalesce(*[F.when(f, F.lit(r)) for r, f in enumerate(flags)])


def second(values: list[Column]) -> Column:
    """The second largest of the non-null values (equal to the largest on ties); null with fewer than two."""
    return F.get(F.sort_array(F.array_compact(F.array(*values)), asc=False), 1)


def mean(values: list[Column]) -> Column:
    """Mean of the non-null values, added up in rank order."""
    return total([F.coalesce(v, F.lit(0.0)) for v in values]) / F.nullif(count([v.isNotNull() for v in values]), F.lit(0))


def nano_mean(values: list[Column]) -> Column:
    """Mean of the non-null values from whole billionths; 0 without values."""
    n = count([v.isNotNull() for v in values])
    return F.when(n == 0, F.lit(0.0)).otherwise(total([F.coalesce(nano(v), F.lit(0)) for v in values]) / n / F.lit(1e9))


@dataclass(frozen=True)
class TemplateDriven:
    """v3o and v3: fill ratio with an ambiguous band and a filter relative to the darkest bubble. v3o compares
    fills of single precision, v3 of double, which differ where a fill lies on a bound."""

    filled: float = 0.35
    low: float = 0.18
    high: float = 0.55
    relative: float = 0.65
    single: bool = True

    def statuses(self, rows: DataFrame) -> DataFrame:
        """rows with, per rank, filled and ambiguous flags s0.., b0.. and confidence c0... Steps are
        separate projections, so that no expression repeats another's tree."""
        centre, half, tiny = (self.low + self.high) / 2, (self.high - self.low) / 2, 1e-6
        rows = rows.withColumns({f"g{r}": f.cast("float").cast("double") if self.single else f for r, f in enumerate(fills())})
        fs = named("g")
        rows = rows.withColumn("top", F.greatest(*fs))
        rows = rows.withColumns(
            {f"k{r}": F.when((f > self.filled) & (f < F.lit(self.relative) * F.col("top")), 1).when(f > self.filled, 3).when((f >= self.low) & (f <= self.high), 2).when(f.isNotNull(), 0) for r, f in enumerate(fs)}
        )  # 0: pale, 1: dark but weak beside the darkest, 2: in the band, 3: filled
        conf = [
            F.when(k == 1, clip(1 - f, 0.0, 1.0))
            .when(k == 3, clip((f - self.filled) / (1 - self.filled + tiny) + 0.5, 0.5, 1.0))
            .when(k == 2, clip(1 - F.abs(f - F.lit(centre)) / F.lit(half + tiny), 0.0, 1.0))
            .when(k == 0, clip(1 - f / F.lit(self.low + tiny), 0.0, 1.0))
            for f, k in zip(fs, named("k"))
        ]
        return rows.withColumns({f"s{r}": F.coalesce(k == 3, F.lit(False)) for r, k in enumerate(named("k"))} | {f"b{r}": F.coalesce(k == 2, F.lit(False)) for r, k in enumerate(named("k"))} | {f"c{r}": c for r, c in enumerate(conf)})

    blank = {"choice": None, "note": "blank", "all_filled": "", "fill": 0.0, "confidence": 0.0}

    def grade(self, rows: DataFrame) -> DataFrame:
        rows = self.statuses(rows).withColumns({"n": count(named("s")), "m": count(named("b"))})
        n, m, filled, band = F.col("n"), F.col("m"), named("s"), named("b")
        rows = rows.withColumn("best", F.greatest(*[F.when(s | ((n == 0) & b), f) for f, s, b in zip(fills(), filled, band)]))
        best = F.coalesce(*[F.when((s | ((n == 0) & b)) & (f == F.col("best")), F.lit(LETTERS[r])) for r, (f, s, b) in enumerate(zip(fills(), filled, band))])
        choice = F.when((n > 0) | (m == 1), best)
        note = F.when(n > 1, "double_mark").when(n == 1, "ok").when(m == 1, "ambiguous").otherwise("blank")
        marked = F.when(n > 0, letters(filled)).when(m == 1, letters(band)).otherwise("")
        return rows.select("sheet", "q", choice.alias("choice"), note.alias("note"), marked.alias("all_filled"), nano_mean(fills()).alias("fill"), nano_mean(named("c")).alias("confidence"))


@dataclass(frozen=True)
class BinaryFallback:
    """v2: a bubble is filled or not; with several, the first of them in option order is taken."""

    filled: float = 0.35
    half: float = 0.175
    relative: float = 0.65

    blank = {"choice": None, "note": "no_circles", "all_filled": ""}

    def grade(self, rows: DataFrame) -> DataFrame:
        fs = fills()
        top = F.greatest(*fs)
        hit = [(f >= self.filled) & ((top < self.half) | (f >= F.lit(self.relative) * top)) for f in fs]
        n = count(hit)
        choice = F.when(n > 0, F.coalesce(*[F.when(h, F.lit(LETTERS[r])) for r, h in enumerate(hit)]))
        note = F.when(count([f.isNotNull() for f in fs]) == 0, "no_circles").when(n == 0, "unanswered").when(n > 1, "double_mark").otherwise("")
        return rows.select("sheet", "q", choice.alias("choice"), note.alias("note"), letters(hit).alias("all_filled"))


@dataclass(frozen=True)
class ModelStatus:
    """v2 with a classifier: rows have, per rank, the probabilities p0.. of filled and u0.. of ambiguous. An
    ambiguous bubble never answers, but asks for a review of a question that has no or one filled bubble."""

    filled: float = 0.70
    unsure: float = 0.50

    blank = {"choice": None, "note": "no_circles", "all_filled": ""}

    def grade(self, rows: DataFrame) -> DataFrame:
        ps, us, hit = named("p"), named("u"), named("s")
        rows = rows.withColumns(numbered("s", [F.coalesce(p >= self.filled, F.lit(False)) for p in ps]))
        rows = rows.withColumns(numbered("v", [F.when(h, rounded(p, 3)) for h, p in zip(hit, ps)]) | {"n": count(hit), "m": count([~h & (u >= self.unsure) for h, u in zip(hit, us)])})
        n, m = F.col("n"), F.col("m")
        choice = arg_max(named("v"))
        note = F.when(count([p.isNotNull() for p in ps]) == 0, "no_circles").when(n > 1, "double_mark").when(m > 0, "ambiguous_review").when(n == 0, "unanswered").otherwise("")
        return rows.select("sheet", "q", choice.alias("choice"), note.alias("note"), letters(hit).alias("all_filled"))


@dataclass(frozen=True)
class Tiered:
    """s8 and v1: absolute, relative and dominant tiers, over fills less the row's minimum (s8) or as they are (v1)."""

    background: bool
    filled: float
    margin: float
    signal: float
    dominant: float
    choices: int = 5
    status: float | None = None
    double: float = 0.70
    close: float = 0.85
    trusted: float = 0.25
    last: float = 0.30

    blank = {"choice": None, "note": "no_circles", "tier": "none", "all_filled": ""}

    def grade(self, rows: DataFrame, detected: bool = False) -> DataFrame:
        """detected: rows are detected_rows. A trusted detection then says whether a bubble is filled, not
        its fill, and a question without candidates takes its darkest bubble if that alone is confirmed."""
        k, no = self.choices, F.lit(False)
        raw, adj, sure, rel, extra, pick, ok = (named(x, k) for x in "fasrepo")
        low = F.least(*raw)
        rows = rows.withColumns(numbered("a", [f - low for f in raw] if self.background else raw))
        rows = rows.withColumns({"average": mean(adj), "top": F.greatest(*adj), "after": second(adj), "primary": F.greatest(*[F.when(a >= self.filled, a) for a in adj])})
        average, top, after, primary = map(F.col, ("average", "top", "after", "primary"))
        bound = F.greatest(F.lit(self.filled), primary * self.double) if self.background else F.lit(self.filled)  # with background, weaker sure hits are bleeding ink
        rows = rows.withColumns(numbered("s", [F.coalesce(a >= bound, no) & primary.isNotNull() for a in adj]) | numbered("r", [F.coalesce((a >= average + self.margin) & (a >= self.signal), no) for a in adj]))
        rows = rows.withColumns(numbered("e", [r & ~s & F.coalesce(a >= primary * self.double, no) for r, s, a in zip(rel, sure, adj)]) | {"n_sure": count(sure), "n_rel": count(rel)})
        rel_values = [F.when(r, a) for r, a in zip(rel, adj)]
        rows = rows.withColumns({"rel_top": F.greatest(*rel_values), "rel_second": second(rel_values)})
        rows = rows.withColumns({"rel_first": first_rank([r & (a == F.col("rel_top")) for r, a in zip(rel, adj)]), "top_first": first_rank([a == top for a in adj])})
        n_sure, n_rel, near = F.col("n_sure"), F.col("n_rel"), F.col("rel_second") >= F.col("rel_top") * self.close
        clear = F.coalesce((top >= self.signal) & (after.isNull() | ((after < 1e-6) if self.background else no) | (top >= after * self.dominant)), no)
        rows = rows.withColumns(
            numbered("p", [F.when(n_sure > 0, s | e).when((n_rel > 1) & ~near, F.col("rel_first") == i).when(n_rel > 0, r).otherwise(clear & (F.col("top_first") == i)) for i, (s, e, r) in enumerate(zip(sure, extra, rel))])
        )
        dark = [f > F.lit(self.status) if self.status is not None else no for f in raw]
        if detected:
            dark = [F.when(y >= self.trusted, z).otherwise(d) for y, z, d in zip(named("y", k), named("z", k), dark)]
        status = [p & d for p, d in zip(pick, dark)]
        rows = rows.withColumns({f"p{i}": F.coalesce(F.col(f"p{i}"), no) for i in range(k)}).withColumns(numbered("o", [F.coalesce(x, no) for x in status]) | {"n": count(pick)})
        rows = rows.withColumn("alone", (F.col("n") > 1) & (count(ok) == 1))
        rows = rows.withColumns(numbered("p", [F.when(F.col("alone"), o).otherwise(p) for p, o in zip(pick, ok)]))
        n, alone = F.col("n"), F.col("alone")
        seen = count([f.isNotNull() for f in raw])
        tier = F.when(n == 0, "none").when(n_sure > 0, "absolute").when((n_rel > 0) | F.lit(not self.background), "relative").otherwise("dominant")
        note = F.when(seen == 0, "no_circles").when(n == 0, "unanswered").when(n == 1, "").when(alone, "yolo_resolved").otherwise("double_mark")
        choice, marked = arg_max(adj, pick), letters(pick)
        if detected:
            sure_of = [d & (y >= self.last) & (a == top) & (a >= self.signal) for d, y, a in zip(dark, named("y", k), adj)]
            rows = rows.withColumns(numbered("h", [F.coalesce(h, no) for h in sure_of]))
            hit = named("h", k)
            rows = rows.withColumns({"only": (n == 0) & (count(hit) == 1), "conf": F.greatest(*[F.when(h, y) for h, y in zip(hit, named("y", k))])})
            rows = rows.withColumn("conf", rounded(F.col("conf"), 2))
            only = F.col("only")
            choice, marked = (F.when(only, letters(hit)).otherwise(x) for x in (choice, marked))
            tier = F.when(only, "yolo").otherwise(tier)
            note = F.when(only, F.format_string("yolo_conf=%.2f", "conf")).otherwise(note)
        return rows.select("sheet", "q", choice.alias("choice"), note.alias("note"), tier.alias("tier"), marked.alias("all_filled"))


@dataclass(frozen=True)
class Darkest:
    """v0: fills over the threshold, else the darkest bubble if it comes near it."""

    filled: float = 0.42
    soft: float = 0.72

    blank = {"choice": None, "double_mark": False, "low_confidence": False}

    def grade(self, rows: DataFrame) -> DataFrame:
        fs = fills()
        hit = [f > self.filled for f in fs]
        n, top = count(hit), F.greatest(*fs)
        low = (n == 0) & (top > F.lit(self.filled * self.soft))
        choice = F.when(n > 0, arg_max(fs, hit)).when(low, arg_max(fs))
        return rows.select("sheet", "q", choice.alias("choice"), (n > 1).alias("double_mark"), F.coalesce(low, F.lit(False)).alias("low_confidence"))


def graded(marks: DataFrame, policy, questions: int) -> DataFrame:
    """Answers to all questions of all sheets that have a mark."""
    return with_spine(policy.grade(question_rows(marks)), questions, policy.blank)


V3O = TemplateDriven()
V3 = TemplateDriven(single=False)
V2 = BinaryFallback()
V2_MODEL = ModelStatus()
S8 = Tiered(background=True, filled=0.35, margin=0.12, signal=0.20, dominant=2.0, status=0.35)
V1 = Tiered(background=False, filled=0.40, margin=0.06, signal=0.28, dominant=1.35, choices=4)
V0 = Darkest()
