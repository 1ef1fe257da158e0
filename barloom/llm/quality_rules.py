"""Quality rules as learned decision lists.

``text_stats`` computes statistics of each whole text by column expressions alone. ``learn`` runs
sequential covering over labelled rows of such statistics: it grows one conjunction of thresholds
at a time by information gain on two thirds of the rows, prunes it on the rest, and removes what it
covers before it goes on. Counting is a grouped aggregate (statistic, bin, label) per step, so the
driver only ever sees a few hundred counts however many labelled rows there are. The ordered rules
become one ``CASE WHEN`` expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_WS, col, fresh, materialize

WS_CLASS = r"[\x20\x09-\x0D]+"
COMMON = r"[^#*$%&|<>!?0-9\p{Lu}]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "pipe_share", "digit_share", "line_words"]


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the columns in ``keep``, the five base counts (long) and the ratios (double).

    A null or empty text, or one of white space alone, has no words: all counts and ratios are 0.
    Repeated rows are computed row by row. Any id type and any column names will do, but for those of
    the statistics themselves.
    """
    # Inside, the columns that pass through have names of their own.
    names = {c: f"qs_{k}" for k, c in enumerate((id_col, *keep))}
    own = list(names.values())
    text = F.coalesce(col(text_col), F.lit(""))
    removed = lambda pattern: F.char_length("rare") - F.char_length(F.regexp_replace("rare", pattern, ""))
    a = docs.select(*[col(c).alias(k) for c, k in names.items()], text.alias("t"))
    b = a.select(
        *own,
        # The characters that are counted, in one pass over the text: each count below reads these alone.
        F.regexp_replace("t", COMMON, "").alias("rare"),
        F.array_remove(F.split("t", WS_CLASS), "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_WS)) != "").alias("lines"),
    )
    c = b.select(
        *own,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        removed(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        removed(r"\p{Lu}+").alias("n_upper"),
        removed(r"[!?]+").alias("n_marks"),
        removed(r"\|+").alias("n_pipes"),
        removed(r"[0-9]+").alias("n_digits"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("tri"),
    )
    # Only texts in which some window comes twice need their windows sorted with positions.
    d = c.withColumn(
        "srt",
        F.when(
            F.size(F.array_distinct("tri")) < F.size("tri"),
            F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("tri")
    twice = F.filter(
        "srt",
        lambda x, i: F.coalesce(F.get("srt", i + 1)["h"] == x["h"], F.lit(False))
        | ((i > 0) & F.coalesce(F.get("srt", F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False))),
    )
    e = d.withColumn("at", F.transform(twice, lambda x: x["i"])).drop("srt")
    f = e.withColumn(
        "n_repeat_words",
        F.size(F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2)))).cast("long"),
    )
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    stats = [
        *map(F.col, BASE),
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "n_words").alias("mark_share"),
        share("n_pipes", "n_words").alias("pipe_share"), share("n_digits", "word_chars").alias("digit_share"),
        share("n_words", "n_lines").alias("line_words"),
    ]
    # A generator, since a filter on the statistics would else be pushed below these projections
    # and evaluate them anew inside every lambda.
    return f.select(*[F.col(k).alias(c) for c, k in names.items()], F.inline(F.array(F.struct(*stats))))


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    wrong: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + f" -> reject ({self.covered} bad, {self.wrong} good)"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def rule_number(self) -> Column:
        """1, 2, … for the first rule that fires; 0 if none does."""
        out = None
        for k, r in enumerate(self.rules, 1):
            out = F.when(r.column(), k) if out is None else out.when(r.column(), k)
        return F.lit(0) if out is None else out.otherwise(0)

    def keeps(self) -> Column:
        return self.rule_number() == 0


#: Steps per doubling of the grid on which the quantiles of a statistic are found.
GRID = 64


def _cuts(rows: DataFrame, label_col: str, features: list[str], n_bins: int) -> list[list[float]] | None:
    """Thresholds of each statistic: ``n_bins`` quantiles over either class; None without both classes.

    Values are counted on a fixed logarithmic grid (a quantile is right to about one percent), so the
    cuts are the same for any partitioning; a cut is the largest value of its grid step. The driver gets one
    row for each class, statistic and step with a value, at most 2 x 5,122 a statistic.
    """
    value = lambda f: F.col(f).cast("double")
    step = lambda f: F.when(value(f) > 0, F.greatest(F.lit(-2560), F.least(F.lit(2560), F.floor(F.log2(value(f)) * GRID)))).otherwise(-2561).cast("int")
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), step(f).alias("g"), value(f).alias("v")) for i, f in enumerate(features)]))
    counted = rows.select(F.col(label_col).cast("int").alias("y"), each).groupBy("y", "f", "g").agg(F.count("*").alias("n"), F.max("v").alias("top")).collect()
    if {0, 1} - {r["y"] for r in counted}:
        return None
    steps: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for r in counted:
        steps.setdefault((r["f"], r["y"]), []).append((r["g"], r["n"], r["top"]))
    cuts: list[set[float]] = [set() for _ in features]
    for (f, _), found in steps.items():
        total, seen, k = sum(n for _, n, _ in found), 0, 0
        for _, n, top in sorted(found):
            seen += n
            while k < n_bins and (2 * k + 1) * total <= seen * 2 * n_bins:
                cuts[f].add(top)
                k += 1
    return [sorted(c) for c in cuts]


def learn(
    labelled: DataFrame,
    label_col: str,
    id_col: str,
    features: list[str],
    max_rules: int = 8,
    max_conditions: int = 4,
    n_bins: int = 32,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> DecisionList:
    """A decision list for label 0 (reject) over ``features``; unmatched rows are kept.

    Rows whose label is null are left out. Without rows of both labels the list is empty, which
    keeps everything. All labelled rows count; thresholds are ``n_bins`` quantiles of each
    statistic over either class, found on a fixed grid. Ties in gain go to the first feature in the given order, then to
    the lower threshold, so the list is the same whatever the partitioning.
    """
    rows = materialize(labelled.where(F.col(label_col).isNotNull()).select(id_col, label_col, *features), "labelled_stats")
    cuts = _cuts(rows, label_col, features, n_bins)
    if cuts is None:
        return DecisionList(())
    # A statistic becomes the number of cuts below it: value > cuts[j] is the same as bin > j.

    def bin_of(i: int) -> Column:
        value = F.col(features[i]).cast("double")
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[i]]), lambda c: c < value)).alias(f"b{i}")

    bins = [bin_of(i) for i in range(len(features))]
    table = materialize(
        rows.select((F.col(label_col) == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("prune"), F.col(id_col)), F.lit(3)) == 0).alias("held"), *bins)
        .groupBy("bad", "held", *[f"b{i}" for i in range(len(features))]).agg(F.count("*").alias("n")),
        "labelled_bins",
    )

    def holds(conds: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for i, above, j in conds:
            out = out & ((F.col(f"b{i}") > j) if above else (F.col(f"b{i}") <= j))
        return out

    def counts(at: DataFrame) -> dict[tuple[int, int], list[int]]:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(len(features))])).alias("cell")
        got = at.select("bad", "n", cells).groupBy("cell.f", "cell.b").agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q")
        )
        return {(r["f"], r["b"]): [r["p"], r["q"]] for r in got.collect()}

    left, rules = table, []
    while len(rules) < max_rules:
        conds: list[tuple[int, bool, int]] = []
        now = None
        while len(conds) < max_conditions:
            cells = counts(left.where(~F.col("held") & holds(conds)))
            p0 = sum(v[0] for k, v in cells.items() if k[0] == 0)
            q0 = sum(v[1] for k, v in cells.items() if k[0] == 0)
            now = (p0, q0)
            if p0 < min_covered or q0 == 0:
                break
            best, gain = None, 1e-9
            for i in range(len(features)):
                p = q = 0
                for j in range(len(cuts[i])):
                    a = cells.get((i, j), (0, 0))
                    p, q = p + a[0], q + a[1]
                    for above, pp, qq in ((False, p, q), (True, p0 - p, q0 - q)):
                        if pp >= min_covered:
                            g = pp * (math.log2(pp / (pp + qq)) - math.log2(p0 / (p0 + q0)))
                            if g > gain + 1e-9:
                                best, gain = (i, above, j), g
            if best is None:
                break
            conds.append(best)
        if not conds or now is None or now[0] < min_covered:
            break
        checks = [F.sum(F.when(holds(conds[:k]) & (F.col("bad") == b), F.col("n")).otherwise(0)) for k in range(1, len(conds) + 1) for b in (True, False)]
        held = list(left.where("held").agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).first())
        pairs = [(held[2 * k] or 0, held[2 * k + 1] or 0) for k in range(len(conds))]
        worth = [((p - q) / (p + q) if p + q else -1.0, -k) for k, (p, q) in enumerate(pairs)]
        size = 1 - max(worth)[1]
        p, q = pairs[size - 1]
        if p + q == 0 or p / (p + q) < min_precision:
            break
        conds = conds[:size]
        rules.append(Rule(tuple(Condition(features[i], above, cuts[i][j]) for i, above, j in conds), p, q))
        left = left.where(~holds(conds))
    return DecisionList(tuple(rules))


FEATURES = BASE[2:4] + RATIOS


def _learned(stats: DataFrame, labels: DataFrame, id_col: str, **settings) -> DecisionList:
    """The list for statistics that were computed before: only numbers are joined with labels. Ids that
    carry both labels are left out."""
    known = labels.select(col(id_col).alias("qs_id"), F.col("quality").cast("int").alias("qs_label")).where("qs_id IS NOT NULL AND qs_label IN (0, 1)")
    known = known.groupBy("qs_id").agg(F.min("qs_label").alias("qs_label"), F.max("qs_label").alias("most")).where("qs_label = most").drop("most")
    rows = stats.select(col(id_col).alias("qs_id"), *BASE, *RATIOS).where(~base_failed()).join(known, "qs_id")
    return learn(rows, "qs_label", "qs_id", FEATURES, **settings)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> tuple[DataFrame, DecisionList]:
    """Statistics of all ``docs`` with ``base_failed``, ``rule`` (number of the rule that fired, 0
    if none) and ``kept``; and the list, learned from rows of ``labels`` (id, quality) that have
    a document. Null ids match no label but are judged like any other row; labels other than 0 and 1 and
    ids with both labels teach nothing; repeated rows are judged alike."""
    stats = materialize(text_stats(docs, id_col, text_col), "text_stats")
    rules = _learned(stats, labels, id_col, **settings)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, columns unchanged.

    Rows and statistics are written side by side once; learning then reads the numbers alone, and
    no text is shuffled."""
    (own,) = fresh(docs, "qr_source_row")
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(own), col(id_col).alias("k"), col(text_col).alias("x"))
    judged = materialize(text_stats(packed, "k", "x", keep=(own,)), "judged")
    rules = _learned(judged.withColumnRenamed("k", id_col), labels, id_col, **settings)
    return judged.where(~base_failed() & rules.keeps()).select(*[F.col(own)[c].alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out, _ = judge(docs, labels)
    return out.select("doc_id", *BASE, "base_failed", "kept", "rule")
