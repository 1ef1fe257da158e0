"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A text is the set of its paragraphs' digests. A sketch spreads each digest over one cell of each of three
tables; a cell keeps the number of its digests and the XOR of them and of their checks. The difference
of two sketches, cell by cell, is the sketch of what only one side has: equal paragraphs cancel. A cell
with a single digest shows it (its check tells), taking it out of its other cells shows more, and so
the difference peels. Where cells remain, the difference was too large for the sketch: both texts are sketched again with
more cells and other places for the digests, until nothing remains.

The small sketch of fixed size is the published fingerprint. Peeling works on rows, one per cell, that
lie together by pair: a round takes the single digests of one table (each digest is in one cell
of it, so none is taken twice) and sums cells anew. All rounds of an attempt are one stage behind one
shuffle, in built-in functions alone, and a document of any size is just more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, fresh, keep, materialize, scratch

#: A longer paragraph counts as several, cut at every so many code points.
PARAGRAPH = 200
TABLES = 3
#: Cells per table of a fingerprint, and how many times as many the next attempt has.
CELLS, GROWTH = 12, 8
#: Rounds of peeling of one attempt; what is not peeled by then is tried again, larger.
ROUNDS = 15
_FIELD = 1 << 20
#: No sketch of an attempt needs more cells a table than this for each digest of both sides, plus CELLS.
_AMPLE = 0.7


def digests(text: Column, size: int = PARAGRAPH) -> Column:
    """The distinct 60-bit digests of a text's paragraphs (lines that are not empty); null has none."""
    paragraphs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{size}}}"), F.lit(0))
    return F.array_distinct(F.transform(paragraphs, lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long")))


def check_of(x: Column) -> Column:
    """A check of 31 bits that XOR does not carry over."""
    return ((x % F.lit(2**31)) * F.lit(2654435761) + F.shiftright(x, 31) * F.lit(40503) + F.lit(12345)) % F.lit(2**31 - 1)


def place_of(x: Column, table: int, cells: Column, attempt: int = 0) -> Column:
    """Where a digest lies in a table: by 20 of its own bits in a fingerprint, hashed anew in any later attempt."""
    if attempt == 0:
        return F.shiftright(x, 20 * table) % F.lit(_FIELD) % cells
    return F.pmod(F.xxhash64(F.lit(attempt * TABLES + table), x), cells)


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("long").alias("c"), k.cast("long").alias("k"), h.cast("long").alias("h"))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(found: Column, cells: int = CELLS) -> Column:
    """The cells of an array of digests: an array of ``c`` (digests), ``k`` (their XOR), ``h`` (XOR of their checks)."""
    at = lambda x: F.array(*[place_of(x, t, F.lit(cells)) + t * cells for t in range(TABLES)])
    placed = F.transform(found, lambda x: F.struct(x.alias("x"), check_of(x).alias("h"), at(x).alias("at")))
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))
    add = lambda acc, d: _cell(acc["c"] + 1, acc["k"].bitwiseXOR(d["x"]), acc["h"].bitwiseXOR(d["h"]))

    def cell(all_: Column, slot: Column) -> Column:
        mine = lambda acc, d: F.when(F.get(d["at"], (slot / cells).cast("int")) == slot, add(acc, d)).otherwise(acc)
        return F.aggregate(all_, zero, mine)

    return _once(placed, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(TABLES * cells - 1)), lambda slot: cell(all_, slot)))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of what one of two sketches of equal size holds and the other does not."""
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def as_text(cells: Column) -> Column:
    """A sketch as hexadecimal digits: 2 of the count (its last byte), 15 of the digests, 8 of the checks a cell."""
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(digits(c["c"] % 256, 2), digits(c["k"], 15), digits(c["h"], 8))), ""))


def _single(c: Column, k: Column, h: Column) -> Column:
    return (F.abs(c) == 1) & (h == check_of(k))


def peel(cells: DataFrame, attempt: int, rounds: int = ROUNDS) -> DataFrame:
    """Differences peeled: ``cells`` has a row per cell that is not zero (``pair, cells, slot, c, k, h``), all
    rows of a pair in one partition. The result has rows with ``found`` (``k`` is a recovered digest, ``c``
    1 or -1 for the side that has it) and those of the cells that remain."""
    state = cells.select("pair", "cells", F.lit(False).alias("found"), "slot", "c", "k", "h")
    names = ("found", "slot", "c", "k", "h")
    row = lambda *v: F.struct(*[F.lit(x).cast("boolean" if n == "found" else "long").alias(n) if not isinstance(x, Column) else x.alias(n) for n, x in zip(names, v, strict=True)])
    for r in range(rounds):
        t = r % TABLES
        single = ~F.col("found") & (F.col("slot") >= F.col("cells") * t) & (F.col("slot") < F.col("cells") * (t + 1)) & _single(F.col("c"), F.col("k"), F.col("h"))
        out = [row(True, F.col("k"), F.col("c"), F.col("k"), 0)]
        out += [row(False, place_of(F.col("k"), u, F.col("cells"), attempt) + F.col("cells") * u, -F.col("c"), F.col("k"), F.col("h")) for u in range(TABLES) if u != t]
        moved = state.select("pair", "cells", F.inline(F.when(single, F.array(*out)).otherwise(F.array(F.struct(*names)))))
        # A recovered digest is alone in its group, so its k stays what it is.
        state = moved.groupBy("pair", "cells", "found", "slot").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where("found OR c <> 0 OR k <> 0 OR h <> 0")
    return state


def _judged(state: DataFrame, with_digests: bool) -> DataFrame:
    """Per pair: has all been peeled, and what was recovered from either side."""
    side = lambda sign: F.col("found") & (F.col("c") == sign)
    more = [F.collect_list(F.when(side(s), F.col("k"))).alias(n) for s, n in ((1, "only_a"), (-1, "only_b"))] if with_digests else []
    return state.groupBy("pair").agg(F.bool_and("found").alias("whole"), F.count_if(side(1)).alias("n_only_a"), F.count_if(side(-1)).alias("n_only_b"), *more)


def reconcile(pairs: DataFrame, cells: int = CELLS, with_digests: bool = True) -> DataFrame:
    """What differs between two sets of digests, from their sketches: ``pair, n_a, n_b, n_only_a, n_only_b`` and
    the digests ``only_a, only_b``, one row per pair.

    ``pairs`` has a unique long ``pair`` and the distinct digests ``a`` and ``b`` (null: none); it is read
    again in every attempt, so it should be a written table. The first attempt subtracts the fixed
    sketches of ``cells`` cells a table; each further one sketches the pairs that are left ``GROWTH`` times
    as large (but no larger than the two sets could need, from where it doubles) with other places.
    """
    none = F.array().cast("array<long>")
    pairs = pairs.select("pair", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = pairs.select("pair", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"))
    listed = [F.coalesce(c, none).alias(c) for c in ("only_a", "only_b")] if with_digests else []
    with scratch(pairs.sparkSession):
        gaps = pairs.select("pair", subtract(sketch(F.col("a"), cells), sketch(F.col("b"), cells)).alias("gap"))
        at = gaps.select("pair", F.posexplode("gap").alias("slot", "x")).select("pair", F.lit(cells).cast("long").alias("cells"), F.col("slot").cast("long").alias("slot"), "x.*")
        done = [_attempt(at.where("c <> 0 OR k <> 0 OR h <> 0").repartition(n, "pair"), 0, with_digests)]
        tried, attempt = done[0], 0
        while not (left := tried.where("NOT whole").select("pair")).isEmpty():
            attempt += 1
            again = pairs.join(left.hint("merge"), "pair", "left_semi")
            ample = F.ceil(F.lit(_AMPLE) * (F.size("a") + F.size("b"))) + cells
            # At the ample size a failure is bad luck, which a doubled sketch makes rarer and rarer.
            size = F.least(F.lit(cells * GROWTH**attempt).cast("long"), ample * F.lit(1 << max(0, attempt - 3)))
            sides = again.select("pair", size.alias("cells"), F.inline(F.array(F.struct(F.lit(1).alias("c"), F.col("a").alias("of")), F.struct(F.lit(-1).alias("c"), F.col("b").alias("of")))))
            each = sides.select("pair", "cells", "c", F.explode("of").alias("k")).repartition(n, "pair")
            spread = each.select("pair", "cells", "c", "k", check_of(F.col("k")).alias("h"), F.explode(F.array(*[place_of(F.col("k"), t, F.col("cells"), attempt) + F.col("cells") * t for t in range(TABLES)])).alias("slot"))
            summed = spread.groupBy("pair", "cells", "slot").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where("c <> 0 OR k <> 0 OR h <> 0")
            tried = _attempt(summed, attempt, with_digests)
            done.append(tried)
        found = done[0].where("whole")
        for more in done[1:]:
            found = found.unionByName(more.where("whole"))
        # A pair without a row had no cell left at all: both sides are equal.
        out = sized.join(found.drop("whole").hint("merge"), "pair", "left")
        return keep(materialize(out.select("pair", "n_a", "n_b", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_only_a", "n_only_b")], *listed), "reconciled"))


def _attempt(cells: DataFrame, attempt: int, with_digests: bool) -> DataFrame:
    return materialize(_judged(peel(cells, attempt), with_digests), "peeled")


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """The shared part of both sets' union; 1 for two empty ones."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differing) / (n_a + n_b + differing))


def _bucket(id_: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie below an id, found in two steps."""
    step = 64
    if not bounds:
        return F.lit(0)
    whole = F.array(*map(F.lit, bounds))
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds[step - 1 :: step] or [bounds[-1]])), lambda b: id_ > b)) * (step if len(bounds) >= step else 0)
    return coarse + F.size(F.filter(F.slice(whole, coarse + 1, F.lit(step)), lambda b: id_ > b))


def with_next(docs: DataFrame, columns: list[str], names: list[str], id_col: str = "doc_id", tie: str = "h") -> DataFrame:
    """``docs`` with ``columns`` of the next row by ascending id as ``names`` (behind the last: the first) and a
    unique long ``uid``. Rows of one id are ordered by ``tie``; rows without an id have no next row.

    Ids are cut into ranges of about equal numbers, one a partition; the first row of a range is
    handed to the range before it as well, so that no row needs a task that sees all.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    guest, bucket, no = fresh(docs, "fp_guest", "fp_bucket", "fp_no")
    known = docs.where(col(id_col).isNotNull())
    bounds = known.agg(F.percentile_approx(col(id_col).cast("long"), [k / n for k in range(1, n)] or [0.5], max(1000, 20 * n))).first()[0] or []
    ranged = known.withColumn(bucket, _bucket(col(id_col).cast("long"), sorted(set(bounds))).cast("int"))
    # At most one row per range comes to the driver.
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in ranged.groupBy(bucket).agg(F.min(F.struct(col(id_col).cast("long"), col(tie)))).collect())
    if firsts:
        before = {b: firsts[k - 1][0] for k, (b, _, _) in enumerate(firsts)}
        at = lambda values, kind: F.get(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(max(before) + 1)]), F.col(bucket))
        first = (col(id_col).cast("long") == at({b: i for b, i, _ in firsts}, "long")) & (col(tie) == at({b: t for b, _, t in firsts}, "long"))
        homes = F.array(F.struct(F.col(bucket).alias("b"), F.lit(False).alias("g")), F.when(first, F.struct(at(before, "int").alias("b"), F.lit(True).alias("g"))))
        ranged = ranged.select(*[col(c) for c in docs.columns], F.explode(F.array_compact(homes)).alias(guest)).select(*[col(c) for c in docs.columns], F.col(f"{guest}.b").alias(bucket), F.col(f"{guest}.g").alias(guest))
    else:
        ranged = ranged.withColumn(guest, F.lit(False))
    w = Window.partitionBy(bucket).orderBy(guest, col(id_col), col(tie))
    led = ranged.repartitionById(n, F.col(bucket)).withColumns({"fp_next": F.lead(F.struct(*[col(c) for c in columns])).over(w), no: F.row_number().over(w)}).where(~F.col(guest))
    uid = F.shiftleft(F.col(bucket).cast("long"), 40) + F.col(no)
    mine = led.select(*[col(c) for c in docs.columns], uid.alias("uid"), *[F.col(f"fp_next.{c}").alias(n_) for c, n_ in zip(columns, names, strict=True)])
    kinds = dict(docs.dtypes)
    lost = docs.where(col(id_col).isNull()).select(*[col(c) for c in docs.columns], (-1 - F.monotonically_increasing_id()).alias("uid"), *[F.lit(None).cast(kinds[c]).alias(n_) for c, n_ in zip(columns, names, strict=True)])
    return mine.unionByName(lost)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edited version (its second half replaced by the beginning of the next
    document) and beside the next document: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``, the likenesses by subtracted sketches.

    A null text is empty; two texts without paragraphs are alike (1), one without is unlike any other
    (0). Rows that repeat an id are documents of their own, next to each other in order of a hash of their text.
    Rows without an id have no next document: their edited text is their first half, ``near_next`` that
    to an empty text. Ids are integers. An empty table gives an empty result; other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).select("doc_id", text.alias("text"), F.xxhash64("text").alias("h"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    with scratch(docs.sparkSession):
        texts = with_next(slim, ["text"], ["next_text"]).withColumn("edited", edited)
        sets = materialize(
            texts.select("uid", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"), digests(F.col("next_text")).alias("next")),
            "digests",
        )
        both = F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("edited").alias("b")), F.struct(F.lit(1).alias("which"), F.col("next").alias("b"))))
        pairs = sets.select("uid", F.col("own").alias("a"), both).select((F.col("uid") * 2 + F.col("which")).alias("pair"), "a", "b")
        near = reconcile(pairs, with_digests=False).select(F.shiftright("pair", 1).alias("uid"), F.pmod("pair", F.lit(2)).alias("which"), likeness(F.col("n_a"), F.col("n_b"), F.col("n_only_a") + F.col("n_only_b")).alias("near"))
        near = near.groupBy("uid").agg(F.max(F.when(F.col("which") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("which") == 1, F.col("near"))).alias("near_next"))
        return keep(materialize(sets.join(near.hint("merge"), "uid").select("doc_id", "n_chars", "edited_sha256", as_text(sketch(F.col("own"))).alias("fingerprint"), as_text(sketch(F.col("edited"))).alias("edited_fingerprint"), "near_edited", "near_next"), "fingerprints"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CELL = "lower(lpad(to_hex(count(x) % 256), 2, '0') || lpad(to_hex(coalesce(bit_xor(x), 0)), 15, '0') || lpad(to_hex(coalesce(bit_xor(h), 0)), 8, '0'))"
#: The likeness of the sets themselves, since peeling gives the whole difference; cells as in a fingerprint.
OP13_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS next FROM documents
), texts AS (
  SELECT doc_id, t, next, substr(t, 1, length(t) - length(t) // 2) || substr(next, 1, length(t) // 2) AS edited FROM docs
), versions AS (
  SELECT doc_id, 'a' AS v, t AS x FROM texts UNION ALL SELECT doc_id, 'e', edited FROM texts UNION ALL SELECT doc_id, 'n', next FROM texts
), pieces AS (
  SELECT DISTINCT doc_id, v, CAST('0x' || substr(md5(p), 1, 15) AS BIGINT) AS x FROM (SELECT doc_id, v, unnest(regexp_extract_all(x, '[^\n]{{1,{PARAGRAPH}}}')) AS p FROM versions)
), checked AS (
  SELECT *, ((x % 2147483648) * 2654435761 + (x >> 31) * 40503 + 12345) % 2147483647 AS h FROM pieces
), slots AS (
  SELECT d.doc_id, v.v, s.slot FROM texts d, (SELECT unnest(['a', 'e']) AS v) v, (SELECT unnest(range({TABLES * CELLS})) AS slot) s
), placed AS (
  SELECT doc_id, v, x, h, unnest([{", ".join(f"((x >> {20 * t}) & 1048575) % {CELLS} + {t * CELLS}" for t in range(TABLES))}]) AS slot FROM checked WHERE v <> 'n'
), cells AS (
  SELECT s.doc_id, s.v, s.slot, {_CELL} AS cell FROM slots s LEFT JOIN placed p ON p.doc_id = s.doc_id AND p.v = s.v AND p.slot = s.slot GROUP BY ALL
), prints AS (
  SELECT doc_id, string_agg(cell, '' ORDER BY slot) FILTER (WHERE v = 'a') AS fingerprint, string_agg(cell, '' ORDER BY slot) FILTER (WHERE v = 'e') AS edited_fingerprint FROM cells GROUP BY doc_id
), sizes AS (
  SELECT doc_id, count(*) FILTER (WHERE v = 'a') AS a, count(*) FILTER (WHERE v = 'e') AS e, count(*) FILTER (WHERE v = 'n') AS n FROM pieces GROUP BY doc_id
), shared AS (
  SELECT p.doc_id, count(*) FILTER (WHERE q.v = 'e') AS e, count(*) FILTER (WHERE q.v = 'n') AS n FROM pieces p JOIN pieces q ON p.doc_id = q.doc_id AND p.x = q.x WHERE p.v = 'a' AND q.v <> 'a' GROUP BY p.doc_id
), counts AS (
  SELECT t.doc_id, coalesce(s.a, 0) AS a, coalesce(s.e, 0) AS e, coalesce(s.n, 0) AS n, coalesce(b.e, 0) AS be, coalesce(b.n, 0) AS bn
  FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN shared b ON b.doc_id = t.doc_id
)
SELECT t.doc_id, length(t.t) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN a + e = 0 THEN 1e0 ELSE (2e0 * be) / (2e0 * (a + e - be)) END AS near_edited, CASE WHEN a + n = 0 THEN 1e0 ELSE (2e0 * bn) / (2e0 * (a + n - bn)) END AS near_next
FROM texts t JOIN prints USING (doc_id) JOIN counts USING (doc_id)
"""
